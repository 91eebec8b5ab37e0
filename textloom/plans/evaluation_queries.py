"""Queries over monitoring, evaluation, summaries and grouping, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking as C
from ..operators import documents as D
from ..operators import evaluation as E
from ..operators import ingestion as W
from ..operators import lexical as L
from ..operators import models as N
from ..operators import monitoring as M
from ..operators import relational as R
from ..sources import stored as S
from .common import rows_df, table, values_sql
from .ops_queries import CASES, CHUNKS_SQL, TARGETS
from .search_queries import _asked, _bm25_sql
from .text_queries import TOKENS_SQL

PRICES = {"small": (0.5, 1.5), "large": (10.0, 30.0)}
COMPLEXITIES = {"simple": 0.5, "reasoning": 0.25, "multi_context": 0.25}

_docs = lambda s, d: table(s, d, "documents")


def _traces(s, d):
    """Traces of events: tokens, cost and cache lookups follow from the id."""
    e = table(s, d, "events")
    hit = F.when(F.col("event_id") % 3 != 0, F.col("event_id") % 5 == 0)
    return e.select("event_id", "ts", F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed"), (F.col("event_id") % 500).alias("tokens"), ((F.col("event_id") % 500) / 1000).alias("cost_usd"), hit.alias("cache_hit"))


def monitoring_stats(s, d):
    return M.monitoring_stats(_traces(s, d))


def monitoring_last_n(s, d):
    return M.monitoring_stats(_traces(s, d), last_n=250)


def quality_scores(s, d):
    """Quality recorded for each label of the corpus: a score of each source's documents."""
    rows = table(s, d, "labels").join(_docs(s, d).select("doc_id", "source"), "doc_id")
    return M.quality_means(rows.select(F.col("source").alias("metric"), F.when(F.col("toxic") == 0, F.col("quality").cast("double")).alias("score")))


def cache_miss_alerts(s, d):
    """INFO alerts: traces at which over 80 % of all cache lookups so far had missed."""
    placed = R.positioned(_traces(s, d).select("event_id", "ts", "cache_hit"), "ts", "event_id")
    return M.alerts(M.with_cache_misses(placed), miss_pct=80.0)


def recent_errors(s, d):
    traces = table(s, d, "events").select("event_id", "ts", F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed"))
    return M.recent_alerts(M.alerts(M.rolling_health(traces), p95_ms=300.0, error_pct=20.0), "ERROR", 50)


def _spans(s, d):
    """Two spans of each event, the second of which fails where the event is an error."""
    e = table(s, d, "events")
    one = lambda name, ms, error: F.struct(F.lit(name).alias("component"), ms.alias("latency_ms"), error.alias("error"))
    failed = F.when(F.col("event_type") == "error", "boom")
    return M.spans(e.select("event_id", F.array(one("retrieval", F.col("value") * 0.25, F.lit(None).cast("string")), one("generation", F.col("value") * 0.75, failed)).alias("spans")))


def span_rows(s, d):
    return _spans(s, d).groupBy("component").agg(F.count("*").alias("n"), F.count_if("failed").alias("failures"), F.round(F.avg("latency_ms"), 6).alias("mean_ms"))


def traces_of_spans(s, d):
    return M.traced(_spans(s, d)).withColumn("latency_ms", F.round("latency_ms", 6))


def usage_cost(s, d):
    e = table(s, d, "events").select("event_type", F.when(F.col("event_id") % 3 == 0, "small").when(F.col("event_id") % 3 == 1, "large").otherwise("unknown").alias("model"), (F.col("event_id") % 700).alias("tokens_in"), (F.col("event_id") % 300).alias("tokens_out"))
    costs = M.costed(e, PRICES)
    return costs.groupBy("event_type", "model").agg(F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.round(F.sum("cost_usd"), 6).alias("cost_usd"))


# --- evaluation -----------------------------------------------------------------------


def keyword_coverage(s, d):
    """Of the distinct words of each passage, the share that its best document has."""
    best = L.fetched(L.bm25(_asked(s, d), _docs(s, d), 1), _docs(s, d).select("doc_id", "text")).join(_asked(s, d), "query_id")
    words = F.array_distinct(T.tokens(F.col("query")))
    return best.select("query_id", F.round(E.keyword_coverage(F.col("text"), words), 6).alias("coverage"))


def _cases(s, d):
    """Each passage as a question, its best document as the answer, its three best documents as contexts."""
    best = L.fetched(L.bm25(_asked(s, d), _docs(s, d), 3).select("query_id", "doc_id", "rank"), _docs(s, d).select("doc_id", "text"))
    context = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    rows = _asked(s, d).join(context, "query_id")
    return rows.select(F.col("query_id").alias("id"), F.col("query").alias("question"), F.col("c")[0]["text"].alias("answer"), F.transform("c", lambda x: x["text"]).alias("contexts"), F.when(F.col("query_id") % 4 != 0, F.col("query")).alias("ground_truth"))


def answer_scores(s, d):
    return E.lexical_scores(_cases(s, d))


def answer_score_means(s, d):
    means = E.metric_means(E.lexical_scores(_cases(s, d)))
    return means.select("n", "passed", *(F.round(m, 4).alias(m) for m in E.THRESHOLDS))


def template_cases(s, d):
    return E.templates(CASES.df(s, d), rows_df(s, TARGETS, "category string, target long"))


def synthetic_cases(s, d):
    return E.synthetic_cases(_docs(s, d).where("doc_id IS NOT NULL"), COMPLEXITIES, 200)


def synthetic_summary(s, d):
    return E.summary_by(synthetic_cases(s, d), "complexity", [*COMPLEXITIES, "conditional"])


# --- summaries ------------------------------------------------------------------------


def indexing_summary(s, d):
    """Documents, chunks, and chunks with equations or figures, by source."""
    chunks = D.enrich(C.fixed_windows(_docs(s, d)), "content").select("doc_id", "has_equations", F.size("figure_references").alias("figures"), F.char_length("content").alias("n"))
    rows = _docs(s, d).select("doc_id", "source").join(chunks, "doc_id")
    return rows.groupBy("source").agg(F.countDistinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.count_if("has_equations").alias("with_equations"), F.count_if(F.col("figures") > 0).alias("with_figures"), F.round(F.avg("n"), 6).alias("mean_chars"))


def conversion_rollup(s, d):
    """Pages as conversions: recognised if they hold a table, by fallback if they hold a list only; the rate counts what needed no fallback."""
    html = F.lower("html")
    rows = table(s, d, "pages").select((F.col("page_id") % 5).alias("batch"), (F.contains(html, F.lit("<p")) | F.contains(html, F.lit("<li"))).alias("recognised"), (~F.contains(html, F.lit("<p")) & F.contains(html, F.lit("<li"))).alias("fallback"))
    n, good = F.count("*"), F.count_if("recognised") - F.count_if("fallback")
    return rows.groupBy("batch").agg(n.alias("total"), F.count_if("recognised").alias("recognised"), F.count_if("fallback").alias("fallbacks"), F.round(F.try_divide(good * 100.0, n), 6).alias("success_rate"))


def knowledge_base_stats(s, d):
    per = C.fixed_windows(_docs(s, d)).agg(F.count("*").alias("chunks"))
    return _docs(s, d).agg(F.count("*").alias("documents"), F.countDistinct("lang").alias("languages")).join(F.broadcast(per))


def entity_counts(s, d):
    """Entities of each kind in all documents of a language."""
    found = _docs(s, d).select("lang", *(F.size(c).alias(k) for k, c in D.dictionary_entities(F.col("text")).items()))
    kinds = ("companies", "technologies", "people", "locations")
    return found.groupBy("lang").agg(*(F.sum(k).alias(k) for k in kinds), F.sum(sum((F.col(k) for k in kinds[1:]), F.col(kinds[0]))).alias("total"))


def basic_metadata(s, d):
    text = F.col("text")
    lines = F.size(F.split(text, "\n", -1))
    return _docs(s, d).select("doc_id", lines.cast("long").alias("line_count"), F.size(F.array_remove(F.split(text, r"[ \t\n\r\f]+"), "")).cast("long").alias("word_count"), F.octet_length(text).cast("long").alias("file_size"))


def _ingested(s, d):
    """Chunks of all documents in four batches and one that can't be written; short chunks are rejected."""
    chunks = C.fixed_windows(_docs(s, d)).select("doc_id", "chunk_index", "content")
    batches = [(f"part{i}", chunks.where(F.col("doc_id") % 4 == i)) for i in range(4)]
    broken = chunks.withColumn("content", F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("the parser failed")).cast("string")))
    path = S.new_path(s, "ingested")
    return path, W.ingest_batches(s, [*batches, ("broken", broken)], path, valid=F.char_length("content") >= 100, attempts=2)


def ingestion_check(s, d):
    """Counters of the writes themselves beside what was counted afterwards."""
    return W.summary(_ingested(s, d)[1])


def ingestion_batches(s, d):
    return _ingested(s, d)[1].select("batch", "rows", "rejected", "chars", "written", F.col("attempts").cast("long").alias("attempts"), F.col("error").isNotNull().alias("failed"))


def ingestion_rows(s, d):
    """What the batches have stored, read back."""
    return s.read.parquet(f"{_ingested(s, d)[0]}/rows").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.min("batch").alias("batch"))


def embed_resume(s, d):
    """Documents without a label are embedded in batches; those of the labelled are there already."""
    done = table(s, d, "labels").select(F.col("doc_id").alias("key"))
    out = N.embedded_batches(_docs(s, d), done, "text", "doc_id")
    return out.select(F.col("key").cast("long").alias("doc_id"), F.size("vector").cast("long").alias("dims"), F.col("attempts").cast("long").alias("attempts"), "failed")


def graph_reach_orders(s, d):
    """Suppliers and customers as a graph: nation to nation where the one's suppliers sold to the other's customers, up to two steps."""
    li, o = table(s, d, "lineitem").where("l_quantity >= 50").select("l_orderkey", "l_suppkey"), table(s, d, "orders").select("o_orderkey", "o_custkey")
    su, c = table(s, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src")), table(s, d, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    edges = li.join(su, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).select("src", "dst").distinct()
    return R.reach(edges, 2)


def latest_versions(s, d):
    """Events as versions of their users: of each the newest row."""
    e = table(s, d, "events").select("user_id", "event_id", F.col("event_type").alias("payload"))
    return R.upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "user_id", "event_id")


def term_frequencies(s, d):
    """How often each document has each word of the passages' first five."""
    terms = _asked(s, d).select(F.explode(T.tokens(F.col("query"))).alias("term"))
    return L.postings(_docs(s, d), terms=terms)


# --- grouping -------------------------------------------------------------------------


def cube_orders(s, d):
    o = table(s, d, "orders")
    return o.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("total"), F.grouping_id().cast("long").alias("level"))


def grouping_sets_orders(s, d):
    o = table(s, d, "orders")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return o.groupingSets([[status], [priority], []], status, priority).agg(F.count("*").alias("n"))


def pivot_events(s, d):
    e = table(s, d, "events")
    kinds = ["click", "error", "purchase"]
    out = e.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).pivot("event_type", kinds).agg(F.count("event_id"))
    return out.select("day", *(F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in kinds))


def distinct_sketch(s, d):
    """Distinct users by day: exact, and whether a sketch is within ten percent of that."""
    e = table(s, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"))
    found = e.agg(F.countDistinct("user_id").alias("users"), F.approx_count_distinct("user_id", 0.02).alias("about"))
    return found.select("day", "users", (F.abs(F.col("about") - F.col("users")) <= F.greatest(F.lit(1.0), F.col("users") * 0.1)).alias("near"))


QUERIES = {f.__name__: f for f in (monitoring_stats, monitoring_last_n, quality_scores, cache_miss_alerts, recent_errors, span_rows, traces_of_spans, usage_cost, keyword_coverage, answer_scores, answer_score_means, template_cases, synthetic_cases, synthetic_summary, indexing_summary, conversion_rollup, knowledge_base_stats, entity_counts, basic_metadata, ingestion_check, ingestion_batches, ingestion_rows, embed_resume, graph_reach_orders, latest_versions, term_frequencies, cube_orders, grouping_sets_orders, pivot_events, distinct_sketch)}

# --- SQL ------------------------------------------------------------------------------

_T = "t AS (SELECT event_id, ts, value, event_type = 'error' AS failed, event_id % 500 AS tokens, (event_id % 500) / 1000.0::DOUBLE AS cost, CASE WHEN event_id % 3 <> 0 THEN event_id % 5 = 0 END AS hit FROM events)"
_M = """SELECT count(*) AS n, count(*) FILTER (failed) AS failures, round(count(*) FILTER (failed) * 100.0 / count(*), 6)::DOUBLE AS error_pct, round(avg(value), 6) AS mean_ms,
    round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(stddev_pop(value), 6) AS std_ms, round(1000.0 / avg(value), 6) AS per_second,
    CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(cost), 6) AS total_cost_usd, round(count(*) FILTER (hit) * 100.0::DOUBLE / count(hit), 6) AS cache_hit_pct"""
_SYNTH = """(SELECT doc_id, CASE WHEN s < 0.5 THEN 'simple' WHEN s < 0.75 THEN 'reasoning' ELSE 'multi_context' END AS complexity
    FROM (SELECT doc_id, ((doc_id * 40503) % 65536) / 65536.0::DOUBLE AS s, (doc_id * 2654435761) % 4294967296 AS p FROM documents WHERE doc_id IS NOT NULL ORDER BY p, doc_id LIMIT 200))"""


def _toks(of: str) -> str:
    return TOKENS_SQL.replace("text", of)


_SHARE = lambda a, b: f"coalesce(len(list_intersect({a}, {b}))::DOUBLE / nullif(len(list_distinct({a})), 0), 0)"
_SCORES = f"""
    {_bm25_sql('m', 3)},
    c AS (SELECT query_id, list(text ORDER BY rank) AS contexts, first(text ORDER BY rank) AS answer FROM mk JOIN documents USING (doc_id) GROUP BY query_id),
    k AS (SELECT query_id AS id, text AS question, answer, contexts, CASE WHEN item_id % 4 <> 0 THEN text ELSE '' END AS truth FROM benchmark JOIN c ON query_id = item_id),
    w AS (SELECT id, {_toks('question')} AS question, {_toks('answer')} AS answer, {_toks('truth')} AS truth, list_transform(contexts, lambda x: {_toks('x')}) AS contexts FROM k),
    g AS (SELECT *, flatten(contexts) AS seen, list_transform(contexts, lambda x: CASE WHEN {_SHARE('CASE WHEN len(truth) > 0 THEN truth ELSE question END', 'x')} >= 0.5 THEN 1 ELSE 0 END) AS good FROM w),
    e AS (SELECT id, round(coalesce(list_sum(list_transform(range(1, len(good) + 1), lambda i: CASE WHEN good[i] = 1 THEN list_sum(good[1:i])::DOUBLE / i ELSE 0 END)) / nullif(list_sum(good), 0), 0), 6) AS context_precision,
        round({_SHARE('truth', 'seen')}, 6) AS context_recall, round({_SHARE('answer', 'seen')}, 6) AS faithfulness, round({_SHARE('question', 'answer')}, 6) AS answer_relevancy FROM g)"""
_ENTITY = lambda names, test: "len(list_filter([" + ", ".join("'" + n.replace("'", "''") + "'" for n in names) + f"], lambda n: {test}))"
_COMPANY = r"regexp_matches(lower(text), '\b' || lower(n) || '\b')"

ORACLES = {
    "monitoring_stats": f"WITH {_T} {_M} FROM t",
    "monitoring_last_n": f"WITH {_T} {_M} FROM (SELECT * FROM t ORDER BY ts DESC, event_id DESC LIMIT 250)",
    "quality_scores": "SELECT source AS metric, count(*) AS n, round(avg(quality::DOUBLE), 6) AS mean FROM labels JOIN documents USING (doc_id) WHERE toxic = 0 AND quality IS NOT NULL GROUP BY source",
    "cache_miss_alerts": f"""WITH {_T}, r AS (SELECT event_id, row_number() OVER w AS position, 100 - coalesce(count(*) FILTER (hit) OVER w * 100.0::DOUBLE / nullif(count(hit) OVER w, 0), 0) AS miss FROM t WINDOW w AS (ORDER BY ts, event_id))
        SELECT event_id, position, 'INFO' AS level, 'cache_miss_rate' AS metric, round(miss, 6) AS value FROM r WHERE miss > 80""",
    "recent_errors": """WITH r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position, round(avg(CASE WHEN event_type = 'error' THEN 100.0::DOUBLE ELSE 0 END) OVER (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 6) AS value FROM events)
        SELECT event_id, position, 'ERROR' AS level, 'error_rate' AS metric, value FROM r WHERE value > 20 ORDER BY position DESC LIMIT 50""",
    "span_rows": "SELECT component, count(*) AS n, count(*) FILTER (component = 'generation' AND event_type = 'error') AS failures, round(avg(value * CASE component WHEN 'retrieval' THEN 0.25::DOUBLE ELSE 0.75::DOUBLE END), 6) AS mean_ms FROM events, (SELECT unnest(['retrieval', 'generation']) AS component) GROUP BY component",
    "traces_of_spans": "SELECT event_id, round(value * 0.25::DOUBLE + value * 0.75::DOUBLE, 6) AS latency_ms, 2::BIGINT AS spans, CASE WHEN event_type = 'error' THEN 'generation' END AS failed_in FROM events",
    "usage_cost": """SELECT event_type, CASE event_id % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'large' ELSE 'unknown' END AS model, CAST(sum(event_id % 700) AS BIGINT) AS tokens_in, CAST(sum(event_id % 300) AS BIGINT) AS tokens_out,
        round(sum(CASE event_id % 3 WHEN 0 THEN ((event_id % 700) * 0.5::DOUBLE + (event_id % 300) * 1.5::DOUBLE) / 1000 WHEN 1 THEN ((event_id % 700) * 10.0::DOUBLE + (event_id % 300) * 30.0::DOUBLE) / 1000 ELSE 0 END), 6) AS cost_usd FROM events GROUP BY 1, 2""",
    "keyword_coverage": f"""WITH {_bm25_sql('m', 1)}, k AS (SELECT query_id, documents.text AS body, list_distinct_ordered AS words FROM mk JOIN documents USING (doc_id) JOIN (SELECT item_id, list_transform(list_sort(list_transform(list_distinct(t), lambda w: {{'p': list_position(t, w), 'w': w}})), lambda x: x.w) AS list_distinct_ordered FROM (SELECT item_id, {TOKENS_SQL} AS t FROM benchmark)) ON item_id = query_id)
        SELECT query_id, round(len(list_filter(words, lambda w: contains(lower(body), w)))::DOUBLE / len(words), 6) AS coverage FROM k""",
    "answer_scores": f"WITH {_SCORES} SELECT * FROM e",
    "answer_score_means": f"WITH {_SCORES}, a AS (SELECT count(*) AS n, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in E.THRESHOLDS) + " FROM e) SELECT n, " + ", ".join(f"round({m}, 4) AS {m}" for m in E.THRESHOLDS) + ", " + " AND ".join(f"({m} = 0 OR {m} >= {v})" for m, v in E.THRESHOLDS.items()) + " AS passed FROM a",
    "template_cases": f"""WITH g AS (SELECT category, count(*) AS n FROM {CASES.sql()} GROUP BY category), n AS (SELECT t.category, unnest(range(1, target - coalesce(g.n, 0) + 1)) AS i FROM {values_sql(TARGETS, 'category, target').replace('AS v', 'AS t')} LEFT JOIN g USING (category))
        SELECT substr(category, 1, 4) || '-' || lpad(i::VARCHAR, 3, '0') AS id, category, 'medium' AS difficulty, '[TODO: Add ' || category || ' question ' || i || ']' AS question, '[TODO: Add ground truth answer]' AS ground_truth, 'Template for ' || category || ' case ' || i AS notes FROM n""",
    "synthetic_cases": f"SELECT * FROM {_SYNTH}",
    "synthetic_summary": f"SELECT complexity, count(doc_id) AS n FROM (SELECT unnest(['simple', 'reasoning', 'multi_context', 'conditional']) AS complexity) LEFT JOIN {_SYNTH} USING (complexity) GROUP BY complexity",
    "indexing_summary": rf"""SELECT source, count(DISTINCT doc_id) AS documents, count(*) AS chunks, count(*) FILTER (regexp_matches(content, '\$\$[^$]+\$\$|\\begin\{{equation\}}|\\begin\{{align\}}|\\\[|\$[^$]+\$')) AS with_equations,
        count(*) FILTER (regexp_matches(content, '(?i)fig\.?\s*\d+|figure\s+\d+')) AS with_figures, round(avg(length(content)), 6) AS mean_chars FROM documents JOIN {CHUNKS_SQL} c USING (doc_id) GROUP BY source""",
    "conversion_rollup": "WITH r AS (SELECT page_id % 5 AS batch, contains(lower(html), '<p') AS p, contains(lower(html), '<li') AS l FROM pages) SELECT batch, count(*) AS total, count(*) FILTER (p OR l) AS recognised, count(*) FILTER (NOT p AND l) AS fallbacks, round((count(*) FILTER (p OR l) - count(*) FILTER (NOT p AND l)) * 100.0::DOUBLE / count(*), 6) AS success_rate FROM r GROUP BY batch",
    "knowledge_base_stats": f"SELECT count(*) AS documents, count(DISTINCT lang) AS languages, (SELECT count(*) FROM {CHUNKS_SQL}) AS chunks FROM documents",
    "entity_counts": f"WITH f AS (SELECT lang, {_ENTITY(D.COMPANIES, _COMPANY)} AS companies, {_ENTITY(D.TECHNOLOGIES, 'contains(lower(text), lower(n))')} AS technologies, {_ENTITY(D.PEOPLE, 'contains(text, n)')} AS people, {_ENTITY(D.LOCATIONS, 'contains(text, n)')} AS locations FROM documents) SELECT lang, CAST(sum(companies) AS BIGINT) AS companies, CAST(sum(technologies) AS BIGINT) AS technologies, CAST(sum(people) AS BIGINT) AS people, CAST(sum(locations) AS BIGINT) AS locations, CAST(sum(companies + technologies + people + locations) AS BIGINT) AS total FROM f GROUP BY lang",
    "basic_metadata": r"SELECT doc_id, len(string_split(text, chr(10))) AS line_count, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')) AS word_count, octet_length(encode(text)) AS file_size FROM documents",
    "ingestion_check": f"WITH c AS (SELECT count(*) AS n, count(*) FILTER (length(content) >= 100) AS w FROM {CHUNKS_SQL}) SELECT 5::BIGINT AS batches, 1::BIGINT AS failed_batches, w AS rows, w AS written, round(w * 100.0 / n, 6)::DOUBLE AS success_rate, 20.0::DOUBLE AS batch_failure_rate, true AS verified FROM c",
    "ingestion_batches": f"SELECT 'part' || doc_id % 4 AS batch, count(*) FILTER (length(content) >= 100) AS rows, count(*) FILTER (length(content) < 100) AS rejected, CAST(sum(length(content)) FILTER (length(content) >= 100) AS BIGINT) AS chars, count(*) FILTER (length(content) >= 100) AS written, 1::BIGINT AS attempts, false AS failed FROM {CHUNKS_SQL} GROUP BY 1 UNION ALL SELECT 'broken', 0, 0, 0, 0, 2, true",
    "ingestion_rows": f"SELECT doc_id, count(*) AS chunks, 'part' || doc_id % 4 AS batch FROM {CHUNKS_SQL} WHERE length(content) >= 100 GROUP BY doc_id",
    "embed_resume": "SELECT doc_id, 256::BIGINT AS dims, 1::BIGINT AS attempts, false AS failed FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "graph_reach_orders": """
        WITH e AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity >= 50),
        w AS (SELECT src, dst, 1 AS depth FROM e WHERE src <> dst UNION ALL SELECT a.src, b.dst, 2 FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> a.dst AND a.src <> b.dst) SELECT src, dst, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY src, dst""",
    "latest_versions": "SELECT user_id, event_id, event_type AS payload FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "term_frequencies": f"WITH q AS (SELECT DISTINCT unnest({TOKENS_SQL}) AS term FROM benchmark), t AS (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents), w AS (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t) SELECT doc_id, dl, term, count(*) AS tf FROM w JOIN q USING (term) GROUP BY doc_id, dl, term",
    "cube_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(round(sum(o_totalprice), 2) AS DOUBLE) AS total, CAST(grouping(o_orderstatus, o_orderpriority) AS BIGINT) AS level FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "grouping_sets_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "pivot_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY 1",
    "distinct_sketch": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS users, true AS near FROM events GROUP BY 1",
}
