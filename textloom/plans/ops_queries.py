"""Queries over chunks, sessions, stores, graphs, monitoring, citations and evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bitemporal as B
from ..operators import chunking as C
from ..operators import citations as G
from ..operators import lexical as L
from ..operators import models as N
from ..operators import monitoring as M
from ..operators import relational as R
from .common import Derived, rows_df, table, values_sql
from .search_queries import _asked, _bm25_sql

EDGES = [("acme", "foo", "owns"), ("foo", "bar", "uses"), ("bar", "acme", "knows"), ("bar", "baz", "uses"), ("baz", "end", "uses"), ("x", "y", "owns")]
FACTS = [("acme", "founded", "2001-01-01", None), ("acme", "sold foo", "2010-05-01", "2012-01-01"), ("acme", "undated", None, None), ("foo", "started", "2005-03-02", None)]
USES = [(1, "c1", 0.9, 0.8, 1), (1, "c2", 0.7, 0.9, 2), (1, "c1", 0.2, 0.1, 3), (1, "c3", 0.4, 0.9, 4), (2, "c1", 0.5, 0.5, 1), (2, "c4", 0.5, 0.95, 2), (2, "c4", 0.5, 0.95, 3)]
META = [
    (1, "c1", "document=Beams|section=3.2|page=45"), (2, "c2", "document=Plates|chapter=4|figure=2-1|url=http://a.b"), (3, "c3", "table=7|document_path=/p/d.pdf|page=3"), (4, "c4", ""),
]
ANSWERS = [(1, "By $$P = EI$$ and $x$, not $q = 1$."), (2, "No equations"), (3, "See $ x $ twice $x$")]
SOURCES = [(1, "a", "P=EI holds", 1), (1, "b", "where x is", 2), (1, "c", "P = EI and x", 3), (3, "z", "nothing", 1), (3, "y", "x", 2)]
GOLDEN = [
    ("t1", "factual", "easy", "What is a beam?", "A beam is a long member that carries load across its axis."), ("t2", "weird", "easy", "Short?", "Too short"), ("t3", "equation", "hard", "", None), ("t1", "factual", "medium", "A duplicate of an id?", "It has the id of the first case in this list."),
]
TARGETS = [("factual", 400), ("equation", 3), ("procedural", 2), ("comparative", 20)]
SCORES = [("faithfulness", 0.76, 0.80), ("recall", 0.84, 0.90), ("precision", 0.95, 0.90)]
POINTS = [(1, "old", 1), (2, "old", 5), (None, "lost", 1)]
NEWER = [(1, "new", 2), (2, "stale", 4), (3, "added", 1), (3, "added again", 1 + 1)]

#: The literal cases united with rows made from the tables.
CASES = Derived(GOLDEN, "id string, category string, difficulty string, question string, ground_truth string", ("benchmark", "concat('b', CAST(item_id % 37 AS STRING))", "CASE item_id % 5 WHEN 0 THEN 'factual' WHEN 1 THEN 'equation' WHEN 2 THEN 'procedural' WHEN 3 THEN 'other' ELSE 'conceptual' END", "CASE item_id % 4 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' WHEN 2 THEN 'hard' ELSE 'unknown' END", "CASE WHEN item_id % 11 = 0 THEN 'short' ELSE text END", "CASE WHEN item_id % 3 = 0 THEN NULL ELSE text END"))
GRAPH = Derived(EDGES, "src string, dst string, kind string", ("supplier", "concat('s', CAST(s_suppkey AS STRING))", "concat('n', CAST(s_nationkey AS STRING))", "'in'"), ("nation", "concat('n', CAST(n_nationkey AS STRING))", "concat('r', CAST(n_regionkey AS STRING))", "'in'"))
HISTORY = Derived(FACTS, "entity string, fact string, valid_at string, invalid_at string", ("events", "concat('user ', CAST(user_id AS STRING))", "concat(event_type, ' ', CAST(event_id AS STRING))", "CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(CAST(ts AS DATE) AS STRING) END", "CASE event_id % 3 WHEN 0 THEN CAST(CAST(ts AS DATE) AS STRING) WHEN 1 THEN '2009-12-31' END"))
OLDER = Derived(POINTS, "id int, payload string, version int", ("labels", "doc_id + 10", "concat('quality ', CAST(quality AS STRING))", "doc_id % 5"))
NEWEST = Derived(NEWER, "id int, payload string, version int", ("documents", "doc_id + 10", "lang", "n_chars % 7", "doc_id % 2 = 0"))
CITED = Derived(META, "rank int, chunk_id string, meta string", ("documents", "doc_id % 9 + 1", "concat('d', CAST(doc_id AS STRING))", "concat('document=Doc ', lang, CASE WHEN doc_id % 2 = 0 THEN concat('|section=', CAST(doc_id % 7 AS STRING)) ELSE '' END, '|page=', CAST(n_chars % 50 AS STRING), CASE WHEN doc_id % 3 = 0 THEN concat('|url=http://x/', CAST(doc_id AS STRING)) WHEN doc_id % 3 = 1 THEN '|document_path=/p/d.pdf' ELSE '' END)"))
ANSWERED = Derived(ANSWERS, "answer_id int, answer string", ("documents", "doc_id + 100", "concat('By $a_{', CAST(doc_id AS STRING), '}$ and $$ b = ', CAST(doc_id % 3 AS STRING), ' $$ and $none$.')"))
HELD = Derived(SOURCES, "answer_id int, chunk_id string, content string, use int", ("documents", "doc_id + 100", "concat('k', CAST(doc_id AS STRING))", "concat('a_{', CAST(doc_id AS STRING), '} ', text)", "2"), ("documents", "doc_id + 100", "concat('l', CAST(doc_id AS STRING))", "concat(text, ' b=', CAST(doc_id % 2 AS STRING), ' a_{', CAST(doc_id AS STRING), '}')", "3"))

_docs = lambda s, d: table(s, d, "documents")
_chunks = lambda s, d: C.fixed_windows(_docs(s, d))


def _traces(s, d):
    return table(s, d, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("component"), F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed"))


def _uses(s, d):
    """The literal uses of chunks and one for each event, of twenty chunks by its user's answer."""
    e, part = table(s, d, "events"), lambda k: (F.col("event_id") * k % 101) / 100
    made = e.select((F.col("user_id") + 1000).cast("int").alias("answer_id"), F.concat(F.lit("c"), (F.col("event_id") % 20).cast("string")).alias("chunk_id"), part(37).alias("relevance"), part(53).alias("confidence"), F.col("event_id").cast("int").alias("use"))
    return rows_df(s, USES, "answer_id int, chunk_id string, relevance double, confidence double, use int").unionByName(made)


def chunk_fixed_stride(s, d):
    return _chunks(s, d).select("doc_id", F.col("chunk_index").cast("long"), F.col("start_char").cast("long"), F.col("end_char").cast("long"), F.md5("content").alias("digest"))


def chunk_overlap_lag(s, d):
    return C.with_overlap(C.fixed_windows(_docs(s, d), 1000, 0), 20).select("doc_id", F.col("chunk_index").cast("long"), F.md5("content").alias("digest"))


def _split(kernel):
    def query(s, d):
        return C.split(_docs(s, d), kernel).select("doc_id", "chunk_index", "start_char", "end_char", "token_count", F.md5("content").alias("digest"))

    return query


def document_summaries(s, d):
    per = _chunks(s, d).groupBy("doc_id").agg(F.count("*").alias("chunk_count"), F.round(F.avg(F.floor(F.char_length("content") / 4)), 6).alias("avg_tokens"), F.sum(F.floor(F.char_length("content") / 4)).cast("long").alias("tokens"))
    return _docs(s, d).select("doc_id", "source").join(per, "doc_id", "left")


def list_documents_page(s, d):
    per = _chunks(s, d).groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return _docs(s, d).select("doc_id", "lang").join(per, "doc_id", "left").orderBy(F.desc("chunk_count"), "doc_id").offset(20).limit(20)


def session_messages_recent(s, d):
    return R.recent_messages(table(s, d, "conversations"), 5).select("conv_id", "turn", "role", "position", F.char_length("text").cast("long").alias("n"))


def session_summary(s, d):
    c = table(s, d, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "user").alias("user_messages"), F.max("turn").alias("last_turn"), F.sum(F.char_length("text")).cast("long").alias("chars"))


def session_active(s, d):
    """Sessions of events: 60 minutes after a user's last event a session ends; those active at the last event of all."""
    e = table(s, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("seen"))
    return last.join(F.broadcast(e.agg(F.max("ts").alias("now")))).where(F.col("seen") + F.expr("INTERVAL 60 MINUTES") > F.col("now")).select("user_id")


def session_expiry(s, d):
    """Sessions of users with an expiry, a day after their last event, or with none for every fourth: those that are valid at the last event of all."""
    e = table(s, d, "events").select("user_id", "ts")
    last = e.groupBy("user_id").agg(F.max("ts").alias("seen"))
    expires = F.when(F.col("user_id") % 4 != 0, F.col("seen") + F.expr("INTERVAL 1 DAY"))
    now = F.broadcast(e.agg(F.max("ts").alias("now")))
    return last.withColumn("expires_at", expires).join(now).where(R.unexpired(F.col("expires_at"), F.col("now"))).select("user_id", F.col("expires_at").isNull().alias("forever"))


def metadata_merge(s, d):
    e = table(s, d, "events").select("event_id", F.from_json("props", "map<string,int>").alias("m"))
    merged = F.map_concat(F.map_filter("m", lambda k, v: k != "source"), F.create_map(F.lit("source"), F.lit(7)))
    return e.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(merged), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))), ",").alias("merged"))


def upsert_latest(s, d):
    return R.upsert(OLDER.df(s, d), NEWEST.df(s, d), "id", "version")


def delete_points_anti(s, d):
    return table(s, d, "embeddings").select("vec_id").join(table(s, d, "labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti")


def resume_pending_anti(s, d):
    done = table(s, d, "labels").where("quality = 1").select("doc_id")
    return _docs(s, d).join(done, "doc_id", "left_anti").select("doc_id", F.sha2("text", 256).alias("content_key"))


def semi_labelled(s, d):
    return _docs(s, d).join(table(s, d, "labels").where("toxic = 1"), "doc_id", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


def scroll_page(s, d):
    return R.scroll(table(s, d, "embeddings").select("vec_id", "label"), "vec_id", 100, 25)


def graph_reach_recursive(s, d):
    return R.reach(GRAPH.df(s, d), 3)


def timeline(s, d):
    """Each entity's facts that hold after a day, the newest first by `place`."""
    facts = HISTORY.df(s, d).where("invalid_at IS NULL OR CAST(invalid_at AS DATE) > DATE'2011-01-01'")
    order = Window.partitionBy("entity").orderBy(F.desc_nulls_last("valid_at"), "fact")
    return facts.select("entity", "fact", "valid_at", F.row_number().over(order).cast("long").alias("place"))


def _versions(s, d):
    """What each user last did, as it was known: events tell of a day up to four before they came."""
    e = table(s, d, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    day = 86_400_000_000
    return e.select(F.col("user_id").cast("string").alias("key"), (F.floor(ts / day) * day - F.col("event_id") % 5 * day).cast("long").alias("valid_from"), ts.alias("known_from"), F.concat("event_type", F.lit(" "), F.col("event_id").cast("string")).alias("value"))


def facts_as_of(s, d):
    """For every seventh event: what was known of its user a day before, about three days before."""
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    day = 86_400_000_000
    asked = table(s, d, "events").where("event_id % 7 = 0").select(F.col("event_id").alias("query_id"), F.col("user_id").cast("string").alias("key"), (ts - 3 * day).alias("valid_at"), (ts - day).alias("known_at"))
    return B.as_of(_versions(s, d), asked, per_block=2000)


def fact_intervals(s, d):
    """Validity and transaction intervals of the same versions."""
    return B.intervals(_versions(s, d), "key").select("key", "value", "valid_from", "valid_to", "known_from", "known_to")


def rerank_cache_key(s, d):
    """The key of each passage with its ten best documents."""
    best = L.bm25(_asked(s, d), _docs(s, d), 10).groupBy("query_id").agg(F.collect_list("doc_id").alias("ids")).join(_asked(s, d), "query_id")
    return best.select("query_id", N.cache_key(F.col("query"), F.col("ids")).alias("cache_key"))


def monitor_stats(s, d):
    return M.trace_stats(_traces(s, d))


def component_latency(s, d):
    return M.trace_stats(_traces(s, d), "component")


def rolling_p95(s, d):
    h = M.rolling_health(_traces(s, d))
    return h.select("event_id", "position", F.round("p95_ms", 6).alias("p95_ms"), F.round("error_pct", 6).alias("error_pct"))


def alerts(s, d):
    return M.alerts(M.rolling_health(_traces(s, d)), p95_ms=300.0, error_pct=20.0)


def ttl_simulate(s, d):
    ops = table(s, d, "events").select("event_id", "ts", F.col("user_id").alias("key"), F.when(F.col("event_type") == "purchase", "set").otherwise("get").alias("op"))
    return M.ttl_hits(ops, 86400).groupBy("key").agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"))


def lru_simulate(s, d):
    acc = table(s, d, "events").select("event_id", "ts", F.col("user_id").alias("key"), F.col("event_type").alias("cache"))
    return M.lru_hits(acc, 75).groupBy("cache").agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"))


def cache_hit_rate(s, d):
    """A cache of users that keeps an entry for a day after its last use: hits and misses of each day's lookups."""
    asked = M.renewed_hits(table(s, d, "events").select("event_id", "ts", F.col("user_id").alias("key")), 86400)
    return M.cache_stats(asked, F.date_format("ts", "yyyy-MM-dd").alias("day"))


def ingestion_report(s, d):
    docs = _docs(s, d)
    per = _chunks(s, d).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return docs.select("doc_id", "lang").join(per, "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.round(F.avg("chunks"), 6).alias("chunks_per_document"), F.ceil(F.sum("chunks") / 1000).cast("long").alias("batches"))


def golden_validate(s, d):
    g = CASES.df(s, d)
    errors = F.array_compact(F.array(
        F.when(~F.col("category").isin("factual", "equation", "procedural", "conceptual", "comparative"), "category"),
        F.when(~F.col("difficulty").isin("easy", "medium", "hard"), "difficulty"),
        F.when(F.char_length(F.coalesce("question", F.lit(""))) < 10, "question"),
        F.when(F.char_length(F.coalesce("ground_truth", F.lit(""))) < 20, "ground_truth"),
    ))
    return g.select("id", "question", F.array_join(errors, ",").alias("errors"))


def duplicate_ids(s, d):
    return CASES.df(s, d).groupBy("id").count().where("count > 1").select("id", F.col("count").alias("n"))


def category_progress(s, d):
    g = CASES.df(s, d).groupBy("category").agg(F.count("*").alias("n"))
    t = rows_df(s, TARGETS, "category string, target long")
    return t.join(g, "category", "left").select("category", "target", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.round(F.coalesce("n", F.lit(0)) * 100.0 / F.col("target"), 6).alias("progress"))


def _relevant(s, d):
    """All documents that hold a benchmark passage whole."""
    return L.holding(_asked(s, d), _docs(s, d))


def retrieval_quality(s, d):
    return M.retrieval_metrics(L.bm25(_asked(s, d), _docs(s, d), 10), _relevant(s, d), 10)


def degradation_gate(s, d):
    """The literal scores, and the labels' quality in each language against how many of them aren't toxic."""
    labelled = table(s, d, "labels").join(_docs(s, d).select("doc_id", "lang"), "doc_id").groupBy("lang")
    rows = rows_df(s, SCORES, "metric string, score double, baseline double").unionByName(labelled.agg(F.avg("quality").alias("score"), F.avg(1 - F.col("toxic")).alias("baseline")).withColumnRenamed("lang", "metric"))
    return M.degraded(rows.select("metric", "score"), rows.select("metric", "baseline"))


def citation_rank(s, d):
    return G.tracked(_uses(s, d))


def citation_confidence(s, d):
    return G.confidence(citation_rank(s, d))


def citation_format(s, d):
    m = CITED.df(s, d).withColumn("meta", F.expr("str_to_map(meta, '[|]', '=')"))
    info = G.source_info(F.col("meta"), F.col("chunk_id"))
    return m.select("chunk_id", info.alias("info"), G.source_link(F.col("meta")).alias("link"), *(G.citation_text(k, F.col("rank"), info).alias(k) for k in ("ieee", "numeric", "inline", "apa")))


def link_equations(s, d):
    return G.linked_equations(ANSWERED.df(s, d), HELD.df(s, d)).select("answer_id", "equation", "chunk_id")


def qa_prompt(s, d):
    """A prompt for each benchmark passage with its five best documents as context."""
    best = L.fetched(L.bm25(_asked(s, d), _docs(s, d), 5).select("query_id", "doc_id", "rank"), _docs(s, d).select("doc_id", "text"))
    context = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    rows = _asked(s, d).join(context, "query_id", "left").select("query_id", G.qa_prompt(F.col("query"), F.transform("c", lambda x: x["text"])).alias("p"))
    return rows.select("query_id", F.char_length("p").cast("long").alias("n"), F.md5("p").alias("digest"))


def order_revenue(s, d):
    """Plain SQL passes through with bound parameters: revenue by nation and segment with subtotals."""
    for t in ("customer", "orders", "lineitem", "nation"):
        table(s, d, t).createOrReplaceTempView(f"tl_{t}")
    return s.sql(
        """SELECT n_name, c_mktsegment, count(*) AS n, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue
           FROM tl_customer JOIN tl_orders ON o_custkey = c_custkey JOIN tl_lineitem ON l_orderkey = o_orderkey JOIN tl_nation ON n_nationkey = c_nationkey
           WHERE l_discount <= :most GROUP BY ROLLUP (n_name, c_mktsegment)""",
        args={"most": 0.05},
    )


QUERIES = {f.__name__: f for f in (chunk_fixed_stride, chunk_overlap_lag, document_summaries, list_documents_page, session_messages_recent, session_summary, session_active, session_expiry, metadata_merge, upsert_latest, delete_points_anti, resume_pending_anti, semi_labelled, scroll_page, graph_reach_recursive, timeline, facts_as_of, fact_intervals, rerank_cache_key, monitor_stats, component_latency, rolling_p95, alerts, ttl_simulate, lru_simulate, cache_hit_rate, ingestion_report, golden_validate, duplicate_ids, category_progress, retrieval_quality, degradation_gate, citation_rank, citation_confidence, citation_format, link_equations, qa_prompt, order_revenue)} | {f"chunk_{k}": _split(k) for k in C.KERNELS}

CHUNKS_SQL = """(SELECT doc_id, i AS chunk_index, i * 800 AS start_char, substr(text, i * 800 + 1, 1000) AS content
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil((length(text) - 200) / 800.0) AS BIGINT)))) AS i FROM documents))"""
PLAIN_SQL = """(SELECT doc_id, i AS chunk_index, substr(text, i * 1000 + 1, 1000) AS content
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(length(text) / 1000.0) AS BIGINT)))) AS i FROM documents))"""
_STATS = """count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(count(*) FILTER (event_type = 'error') * 100.0 / count(*), 6)::DOUBLE AS error_pct, round(avg(value), 6) AS mean_ms,
    round(quantile_cont(value, 0.5), 6) AS p50_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(value, 0.99), 6) AS p99_ms, round(stddev_pop(value), 6) AS std_ms, round(1000.0 / avg(value), 6) AS per_second"""
_ROLL = """SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS position,
    round(quantile_cont(value, 0.95) OVER w, 6) AS p95_ms, round(avg(CASE WHEN event_type = 'error' THEN 100.0::DOUBLE ELSE 0 END) OVER w, 6) AS error_pct
    FROM events WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"""
_CITED = f"""
    WITH u AS (SELECT CAST(answer_id AS INTEGER) AS answer_id, chunk_id, arg_min(relevance, use)::DOUBLE AS relevance, arg_min(confidence, use)::DOUBLE AS confidence, count(*) AS usage_count
               FROM (SELECT * FROM {values_sql(USES, 'answer_id, chunk_id, relevance, confidence, use')} UNION ALL SELECT user_id + 1000, 'c' || (event_id % 20), (event_id * 37 % 101) / 100.0::DOUBLE, (event_id * 53 % 101) / 100.0::DOUBLE, event_id FROM events) GROUP BY answer_id, chunk_id),
    c AS (SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY relevance DESC, usage_count DESC, chunk_id) AS rank FROM u WHERE relevance >= 0.5 AND confidence >= 0.5)"""
_VERSIONS = "WITH v AS (SELECT user_id::VARCHAR AS key, CAST(epoch_us(ts) // 86400000000 * 86400000000 - event_id % 5 * 86400000000 AS BIGINT) AS valid_from, epoch_us(ts) AS known_from, event_type || ' ' || event_id AS value FROM events)"
_G = CASES.sql()
_E = GRAPH.sql()

_CHUNK = r"doc_id, chunk_index, start_char, end_char, CAST(len(list_filter(regexp_split_to_array(content, '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+'), lambda w: w <> '')) AS INTEGER) AS token_count, md5(content) AS digest"


#: Where a window of 1000 characters from {s} on ends: after the last sentence end or line end of its last 200 characters, if the text goes on.
_WINDOW_END = """CASE WHEN {s} + 1000 >= length(text) THEN length(text) ELSE {s} + 1000 - coalesce(list_min(list_filter(list_transform(['.', '!', '?', chr(10)], lambda v: instr(reverse(substr(text, {s} + 801, 200)), v)), lambda k: k > 0)) - 1, 0) END"""


def _packed_sql(parts: str, size: str, most: int) -> str:
    """Chunks of greedily packed parts: a part begins a chunk if the chunk before has anything and would grow beyond `most`."""
    return rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {parts} AS parts FROM documents WHERE text <> ''),
        p AS MATERIALIZED (SELECT doc_id, i, parts[i] AS part, CAST({size} AS BIGINT) AS n FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM d)),
        g AS (SELECT doc_id, i, 0 AS chunk, n AS held FROM p WHERE i = 1
              UNION ALL SELECT p.doc_id, p.i, chunk + CASE WHEN held > 0 AND held + n > {most} THEN 1 ELSE 0 END, CASE WHEN held > 0 AND held + n > {most} THEN n ELSE held + n END FROM g JOIN p ON p.doc_id = g.doc_id AND p.i = g.i + 1),
        c AS (SELECT g.doc_id, CAST(chunk AS INTEGER) AS chunk_index, string_agg(part, '' ORDER BY g.i) AS content FROM g JOIN p USING (doc_id, i) GROUP BY g.doc_id, chunk),
        e AS (SELECT *, CAST(sum(length(content)) OVER (PARTITION BY doc_id ORDER BY chunk_index) AS INTEGER) AS end_char FROM c)
        SELECT {_CHUNK} FROM (SELECT *, CAST(end_char - length(content) AS INTEGER) AS start_char FROM e)"""


_SLIDING = rf"""
        WITH RECURSIVE w AS (
            SELECT doc_id, text, 0 AS chunk_index, 0 AS start_char, {_WINDOW_END.format(s='0')} AS end_char FROM documents WHERE text <> ''
            UNION ALL SELECT doc_id, text, chunk_index + 1, a, {_WINDOW_END.format(s='a')} FROM (SELECT *, greatest(end_char - 100, start_char + 1) AS a FROM w WHERE end_char < length(text))),
        s AS MATERIALIZED (SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, CAST(start_char AS INTEGER) AS start_char, CAST(end_char AS INTEGER) AS end_char, substr(text, start_char + 1, end_char - start_char) AS content FROM w)"""
_WORDS_OF = r"len(list_filter(regexp_split_to_array(parts[i], '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+'), lambda w: w <> ''))"

ORACLES = {
    "chunk_sentences": _packed_sql(r"regexp_extract_all(text, '(?s).*?[.!?]+\s+|.+')", _WORDS_OF, 200),
    "chunk_paragraphs": _packed_sql(r"CASE WHEN regexp_matches(text, '\n\s*\n') THEN regexp_extract_all(text, '(?s).*?\n\s*\n|.+') ELSE regexp_extract_all(text, '(?s).*?\n|.+') END", "length(parts[i])", 1000),
    "chunk_sliding": rf"""{_SLIDING}
        SELECT {_CHUNK} FROM s""",
    "chunk_sliding_tail": rf"""{_SLIDING},
        l AS (SELECT doc_id, max(chunk_index) AS i, max(start_char) AS a FROM s GROUP BY doc_id HAVING count(*) > 1),
        t AS (SELECT doc_id, CAST(i + 1 AS INTEGER) AS chunk_index, CAST(greatest(length(text) - 100, a + 1) AS INTEGER) AS start_char, CAST(length(text) AS INTEGER) AS end_char, substr(text, greatest(length(text) - 100, a + 1) + 1) AS content FROM l JOIN documents USING (doc_id) WHERE greatest(length(text) - 100, a + 1) < length(text))
        SELECT {_CHUNK} FROM (SELECT * FROM s UNION ALL SELECT * FROM t)""",
    "chunk_fixed_stride": f"SELECT doc_id, chunk_index, start_char, start_char + length(content) AS end_char, md5(content) AS digest FROM {CHUNKS_SQL}",
    "chunk_overlap_lag": rf"""
        WITH b AS (SELECT *, list_filter(regexp_split_to_array(lag(content) OVER (PARTITION BY doc_id ORDER BY chunk_index), '\s+'), lambda w: w <> '') AS p FROM {PLAIN_SQL})
        SELECT doc_id, chunk_index, md5(CASE WHEN len(p) > 20 THEN array_to_string(p[-20:], ' ') || ' ' ELSE '' END || content) AS digest FROM b""",
    "document_summaries": f"SELECT d.doc_id, d.source, count(*) AS chunk_count, round(avg(length(content) // 4), 6) AS avg_tokens, CAST(sum(length(content) // 4) AS BIGINT) AS tokens FROM documents d JOIN {CHUNKS_SQL} c USING (doc_id) GROUP BY d.doc_id, d.source",
    "list_documents_page": f"SELECT d.doc_id, d.lang, count(*) AS chunk_count FROM documents d JOIN {CHUNKS_SQL} c USING (doc_id) GROUP BY d.doc_id, d.lang ORDER BY chunk_count DESC, doc_id LIMIT 20 OFFSET 20",
    "session_messages_recent": "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, length(text) AS n FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 5)",
    "session_summary": "SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'user') AS user_messages, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY conv_id",
    "session_active": "SELECT user_id FROM events GROUP BY user_id HAVING max(ts) + INTERVAL 60 MINUTES > (SELECT max(ts) FROM events)",
    "metadata_merge": "SELECT event_id, 'k=' || (props::JSON ->> 'k') || ',source=7' AS merged FROM events",
    "session_expiry": "WITH l AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id) SELECT user_id, user_id % 4 = 0 AS forever FROM l WHERE user_id % 4 = 0 OR seen + INTERVAL 1 DAY > (SELECT max(ts) FROM events)",
    "upsert_latest": f"SELECT id, payload, version FROM (SELECT *, 0 AS n FROM {OLDER.sql()} UNION ALL SELECT *, 1 FROM {NEWEST.sql()}) WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY version DESC, n DESC) = 1",
    "delete_points_anti": "SELECT vec_id FROM embeddings ANTI JOIN (SELECT doc_id AS vec_id FROM labels) USING (vec_id)",
    "resume_pending_anti": "SELECT doc_id, sha256(text) AS content_key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "semi_labelled": "SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source",
    "scroll_page": "SELECT vec_id, label FROM embeddings WHERE vec_id >= 100 ORDER BY vec_id LIMIT 26",
    "graph_reach_recursive": f"""
        WITH RECURSIVE w AS (SELECT DISTINCT src, dst, 1 AS depth FROM {_E} WHERE src <> dst UNION SELECT w.src, e.dst, depth + 1 FROM w JOIN {_E} AS e ON e.src = w.dst WHERE depth < 3 AND w.src <> e.dst)
        SELECT src, dst, CAST(min(depth) AS BIGINT) AS depth FROM w GROUP BY src, dst""",
    "timeline": f"SELECT entity, fact, valid_at, row_number() OVER (PARTITION BY entity ORDER BY valid_at DESC NULLS LAST, fact) AS place FROM {HISTORY.sql()} WHERE invalid_at IS NULL OR invalid_at > '2011-01-01'",
    "facts_as_of": f"""{_VERSIONS},
        q AS (SELECT event_id AS query_id, user_id::VARCHAR AS key, epoch_us(ts) - 259200000000 AS valid_at, epoch_us(ts) - 86400000000 AS known_at FROM events WHERE event_id % 7 = 0),
        m AS (SELECT query_id, v.*, row_number() OVER (PARTITION BY query_id ORDER BY valid_from DESC, known_from DESC, value DESC) AS i FROM q JOIN v ON v.key = q.key AND valid_from <= valid_at AND known_from <= known_at QUALIFY i = 1)
        SELECT q.query_id, value, valid_from, known_from FROM q LEFT JOIN m USING (query_id)""",
    "fact_intervals": f"""{_VERSIONS}, k AS (SELECT *, lead(known_from) OVER (PARTITION BY key, valid_from ORDER BY known_from) AS known_to FROM v)
        SELECT key, value, valid_from, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS valid_to, known_from, known_to FROM k WHERE known_to IS NULL UNION ALL SELECT key, value, valid_from, NULL, known_from, known_to FROM k WHERE known_to IS NOT NULL""",
    "rerank_cache_key": f"WITH {_bm25_sql('m', 10)} SELECT query_id, sha256('reranking:' || any_value(text) || ':' || string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR)) AS cache_key FROM mk JOIN benchmark ON item_id = query_id GROUP BY query_id",
    "monitor_stats": f"SELECT {_STATS} FROM events",
    "component_latency": f"SELECT event_type AS component, {_STATS} FROM events GROUP BY event_type",
    "rolling_p95": _ROLL,
    "alerts": f"WITH r AS ({_ROLL}) SELECT event_id, position, 'WARNING' AS level, 'latency_p95' AS metric, p95_ms AS value FROM r WHERE p95_ms > 300 UNION ALL SELECT event_id, position, 'ERROR', 'error_rate', error_pct FROM r WHERE error_pct > 20",
    "ttl_simulate": """
        WITH o AS (SELECT user_id AS key, ts, event_type = 'purchase' AS is_set, max(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM events)
        SELECT key, count(*) AS lookups, count(*) FILTER (ts - last <= INTERVAL 1 DAY) AS hits FROM o WHERE NOT is_set GROUP BY key""",
    "lru_simulate": """
        WITH o AS (SELECT event_type AS cache, user_id AS key, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
        p AS (SELECT *, lag(i) OVER (PARTITION BY cache, key ORDER BY i) AS prev FROM o),
        dist AS (SELECT p.cache, p.i, count(DISTINCT o.key) AS n FROM p JOIN o ON o.cache = p.cache AND o.i > p.prev AND o.i < p.i GROUP BY p.cache, p.i)
        SELECT p.cache, count(*) AS lookups, count(*) FILTER (p.prev IS NOT NULL AND coalesce(dist.n, 0) < 75) AS hits FROM p LEFT JOIN dist ON dist.cache = p.cache AND dist.i = p.i GROUP BY p.cache""",
    "cache_hit_rate": """
        WITH o AS (SELECT ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY AS hit FROM events)
        SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS lookups, count(*) FILTER (hit) AS hits, count(*) FILTER (hit IS NOT TRUE) AS misses, round(count(*) FILTER (hit) * 100.0::DOUBLE / count(*), 6) AS hit_rate FROM o GROUP BY 1""",
    "ingestion_report": f"""
        WITH c AS (SELECT doc_id, count(*) AS chunks FROM {CHUNKS_SQL} GROUP BY doc_id)
        SELECT lang, count(*) AS documents, CAST(sum(chunks) AS BIGINT) AS chunks, round(avg(chunks), 6) AS chunks_per_document, CAST(ceil(sum(chunks) / 1000.0) AS BIGINT) AS batches FROM documents JOIN c USING (doc_id) GROUP BY lang""",
    "golden_validate": f"""
        SELECT id, question, array_to_string(list_filter([CASE WHEN category NOT IN ('factual', 'equation', 'procedural', 'conceptual', 'comparative') THEN 'category' END, CASE WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'difficulty' END,
            CASE WHEN length(coalesce(question, '')) < 10 THEN 'question' END, CASE WHEN length(coalesce(ground_truth, '')) < 20 THEN 'ground_truth' END], lambda x: x IS NOT NULL), ',') AS errors FROM {_G}""",
    "duplicate_ids": f"SELECT id, count(*) AS n FROM {_G} GROUP BY id HAVING count(*) > 1",
    "category_progress": f"SELECT t.category, CAST(t.target AS BIGINT) AS target, coalesce(g.n, 0) AS n, round(coalesce(g.n, 0) * 100.0::DOUBLE / t.target, 6) AS progress FROM {values_sql(TARGETS, 'category, target').replace('AS v', 'AS t')} LEFT JOIN (SELECT category, count(*) AS n FROM {_G} GROUP BY category) g USING (category)",
    "retrieval_quality": f"""
        WITH {_bm25_sql('m', 10)},
        rel AS (SELECT h.query_id, h.doc_id, mk.rank FROM (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)) h LEFT JOIN mk ON mk.query_id = h.query_id AND mk.doc_id = h.doc_id),
        q AS (SELECT query_id, count(*) AS n, count(*) FILTER (rank <= 10) AS hits, min(rank) FILTER (rank <= 10) AS first, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM rel GROUP BY query_id)
        SELECT query_id, round(hits / 10.0::DOUBLE, 6) AS precision, round(hits / n::DOUBLE, 6) AS recall, round(coalesce(1.0::DOUBLE / first, 0), 6) AS reciprocal_rank,
               round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg FROM q""",
    "degradation_gate": f"""WITH r AS (SELECT metric, score::DOUBLE AS score, baseline::DOUBLE AS baseline FROM {values_sql(SCORES, 'metric, score, baseline')} UNION ALL SELECT lang, avg(quality), avg(1 - toxic) FROM labels JOIN documents USING (doc_id) GROUP BY lang)
        SELECT metric, score, baseline, round(score - (baseline - 0.05), 9) >= 0 AS passed FROM r""",
    "citation_rank": _CITED + " SELECT * FROM c",
    "citation_confidence": _CITED + " SELECT answer_id, round(avg(relevance) * 0.6 + avg(confidence) * 0.4, 6) AS overall, round(avg(relevance), 6) AS avg_relevance, round(avg(confidence), 6) AS avg_confidence, count(*) AS sources, count(*) FILTER (confidence >= 0.8) AS high, count(*) FILTER (confidence < 0.5) AS low FROM c GROUP BY answer_id",
    "citation_format": r"""
        WITH m AS (SELECT rank, chunk_id, """ + ", ".join(rf"nullif(regexp_extract(meta, '(?:^|\|){k}=([^|]*)', 1), '') AS {k}" for k in ("document", "section", "chapter", "page", "figure", "table", "url", "document_path")).replace("AS table", 'AS "table"') + f" FROM {CITED.sql()})," + """
        i AS (SELECT *, coalesce(nullif(concat_ws(', ', document, coalesce('Section ' || section, 'Chapter ' || chapter), 'p. ' || page, coalesce('Figure ' || figure, 'Table ' || "table")), ''), 'Source ' || chunk_id) AS info FROM m)
        SELECT chunk_id, info, coalesce(url, 'file://' || document_path || '#page=' || page) AS link, '[' || rank || ']' AS ieee, '[Source ' || rank || ']' AS numeric, '(' || info || ')' AS inline, '(Source ' || rank || ')' AS apa FROM i""",
    "link_equations": rf"""
        WITH e AS (SELECT answer_id, unnest(regexp_extract_all(answer, '(?s)\$\$?(.*?)\$\$?', 1)) AS e, generate_subscripts(regexp_extract_all(answer, '(?s)\$\$?(.*?)\$\$?', 1), 1) AS i FROM {ANSWERED.sql()})
        SELECT CAST(e.answer_id AS INTEGER) AS answer_id, trim(e) AS equation, arg_min(chunk_id, use) AS chunk_id FROM e JOIN {HELD.sql()} AS c ON c.answer_id = e.answer_id
        WHERE contains(replace(replace(content, ' ', ''), '\\', '\'), replace(replace(trim(e), ' ', ''), '\\', '\')) GROUP BY e.answer_id, i, e""",
    "qa_prompt": f"""
        WITH {_bm25_sql('m', 5)},
        c AS (SELECT query_id, string_agg('[Context ' || rank || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM mk JOIN documents USING (doc_id) GROUP BY query_id),
        p AS (SELECT item_id AS query_id, CASE WHEN context IS NULL THEN text ELSE 'Context:' || chr(10) || context || chr(10) || chr(10) || 'Question:' || chr(10) || text || chr(10) || chr(10) || '{G.CLOSING}' END AS p FROM benchmark LEFT JOIN c ON query_id = item_id)
        SELECT query_id, length(p) AS n, md5(p) AS digest FROM p""",
    "order_revenue": """
        SELECT n_name, c_mktsegment, count(*) AS n, CAST(round(sum(l_extendedprice * (1 - l_discount)), 2) AS DOUBLE) AS revenue
        FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
        WHERE l_discount <= 0.05 GROUP BY ROLLUP (n_name, c_mktsegment)""",
}
