"""Queries over stored indexes and stores, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import keyed_store as K
from ..operators import late_interaction as M
from ..operators import postings as P
from ..operators import trigrams as G
from ..operators import vector_index as I
from ..sources import stored as S
from .common import table
from .search_queries import COS, _asked, _bm25_sql
from .text_queries import TOKENS_SQL

# --- vectors in lists -----------------------------------------------------------------


def _index(s, d):
    return I.IvfIndex.build(table(s, d, "embeddings"), S.new_path(s, "ivf"), payload=("label",))


def _asks(s, d):
    return table(s, d, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def ivf_all_lists(s, d):
    """Every list probed: the exact ten nearest."""
    return _index(s, d).search(_asks(s, d), 10)


def ivf_filtered(s, d):
    """Three lists probed with a filter that few rows pass; queries that find too few are asked again of all lists."""
    return _index(s, d).search(_asks(s, d), 100, probes=3, where=F.col("label").isin(1, 2)).groupBy("query_id").agg(F.count("*").alias("n"))


def ivf_probed(s, d):
    """As many lists as a sample needs for a recall of 0.95."""
    index = _index(s, d)
    return index.search(_asks(s, d), 10, probes=index.probes_for(0.95))


# --- postings with places -------------------------------------------------------------


def _postings(s, d):
    return P.Postings.write(table(s, d, "documents"), S.new_path(s, "postings"))


def bm25_from_postings(s, d):
    return _postings(s, d).bm25(_asked(s, d)).withColumn("score", F.round("score", 6))


def cover_density(s, d):
    """Documents with all words of a passage, by the density of the covers of these."""
    return _postings(s, d).cover_density(_asked(s, d)).withColumn("score", F.round("score", 6))


def cover_density_pairs(s, d):
    """For each two neighbouring words of the passages, the ten documents in which they stand closest."""
    words = T.tokens(F.col("query"))
    pairs = _asked(s, d).select("query_id", F.posexplode(F.zip_with(words, F.slice(words, 2, 1_000_000), lambda a, b: F.concat(a, F.lit(" "), b))).alias("i", "query")).where("query IS NOT NULL")
    asked = pairs.groupBy("query").agg(F.min(F.col("query_id") * 10_000 + F.col("i")).alias("query_id"))
    return _postings(s, d).cover_density(asked, normalised=True).withColumn("score", F.round("score", 6))


# --- words by trigrams ----------------------------------------------------------------


def similar_words(s, d):
    """Words of the passages with all words of the documents that share half of their trigrams."""
    asked = table(s, d, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("a"))
    words = table(s, d, "documents").select(F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("b"))
    return G.similar(asked, words, 0.5).withColumn("similarity", F.round("similarity", 6))


# --- many vectors for a text ----------------------------------------------------------


def _tokens(s, d):
    """Eight neighbouring vectors are a text's tokens."""
    return table(s, d, "embeddings").select(F.expr("vec_id div 8").alias("doc_id"), (F.col("vec_id") % 8).alias("place"), F.col("embedding").alias("v"))


def _token_queries(s, d):
    """Every fifth text asks with every second of its tokens."""
    return _tokens(s, d).where("doc_id % 5 = 0 AND place % 2 = 0").select(F.col("doc_id").alias("query_id"), "place", F.col("v").alias("q"))


def late_interaction(s, d):
    return M.TokenIndex.build(_tokens(s, d), S.new_path(s, "tokens")).search(_token_queries(s, d), 10)


def late_interaction_probed(s, d):
    """Each token's nearest fifth of the tokens in two thirds of the lists, and the best third of the texts that have them."""
    tokens = _tokens(s, d)
    n = tokens.count()
    lists = max(3, round(n**0.5))
    index = M.TokenIndex.build(tokens, S.new_path(s, "tokens"), lists=lists)
    return index.search(_token_queries(s, d), 10, probes=2 * lists // 3, nearest=n // 5, depth=max(25, n // 24))


# --- a store with a key ---------------------------------------------------------------


def _store(s, d):
    """Users' last events: a batch of a third of the events, one of all, and deletes of some users as of a day."""
    events = table(s, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    store = K.KeyedStore.create(s, S.new_path(s, "store"), "user_id long, ts timestamp_ntz, event_id long, event_type string, value double", "user_id", "event_id", buckets=16)
    store.upsert(events.where("event_id % 3 = 0"))
    store.delete(events.where("user_id % 7 = 0 AND event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id")))
    store.upsert(events, where=F.col("event_type") != "error")
    return store


def store_after_batches(s, d):
    return _store(s, d).read().select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))


def store_lookup(s, d):
    return _store(s, d).get(table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))).select("user_id", "event_id")


def store_info(s, d):
    return _store(s, d).info().agg(F.sum("rows").alias("rows"), F.sum("tombstones").alias("tombstones"))


QUERIES = {f.__name__: f for f in (ivf_all_lists, ivf_filtered, ivf_probed, bm25_from_postings, cover_density, cover_density_pairs, similar_words, late_interaction, late_interaction_probed, store_after_batches, store_lookup, store_info)}

_NEAR = f"SELECT q.vec_id AS query_id, a.vec_id AS id, a.label, round({COS}, 6) AS score FROM embeddings q JOIN embeddings a ON q.vec_id % 20 = 0 AND a.vec_id <> q.vec_id"
_GRAMS = "list_distinct(list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))"


def _covers(asked: str, score: str) -> str:
    """Covers by joins: each place with the last place of every term up to it; the least of these starts the cover that ends here."""
    return f"""
    q AS MATERIALIZED ({asked}), n AS (SELECT query_id, count(*) AS need FROM q GROUP BY query_id),
    t AS (SELECT doc_id, unnest(toks) AS term, unnest(range(0, len(toks))) AS place FROM (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents)),
    m AS MATERIALIZED (SELECT query_id, doc_id, term, place FROM q JOIN t USING (term)),
    h AS (SELECT query_id, doc_id, need FROM m JOIN n USING (query_id) GROUP BY ALL HAVING count(DISTINCT term) = need),
    o AS MATERIALIZED (SELECT m.* FROM m JOIN h USING (query_id, doc_id)),
    l AS (SELECT a.query_id, a.doc_id, a.place, b.term, max(b.place) AS last FROM o a JOIN o b ON a.query_id = b.query_id AND a.doc_id = b.doc_id AND b.place <= a.place GROUP BY ALL),
    c AS (SELECT query_id, doc_id, place, min(last) AS p FROM l JOIN n USING (query_id) GROUP BY query_id, doc_id, place, need HAVING count(*) = need),
    x AS (SELECT query_id, doc_id, p, min(place) AS e FROM c GROUP BY ALL),
    y AS (SELECT x.*, (SELECT count(*) FROM o WHERE o.query_id = x.query_id AND o.doc_id = x.doc_id AND place BETWEEN p AND e) AS held FROM x),
    z AS (SELECT query_id, doc_id, sum(0.1::DOUBLE / (1 + (e - p) - (held - 1))) AS w FROM y GROUP BY ALL),
    r AS (SELECT query_id, doc_id, round({score}, 9) AS score FROM z)
    SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10"""


_STORED = """
    b AS (SELECT user_id, max(event_id) AS event_id FROM (SELECT user_id, event_id FROM events WHERE event_id % 3 = 0 OR event_type <> 'error') WHERE user_id IS NOT NULL GROUP BY user_id),
    g AS (SELECT user_id, max(event_id) AS event_id FROM events WHERE user_id % 7 = 0 AND event_id % 2 = 0 GROUP BY user_id),
    k AS (SELECT b.user_id, b.event_id, coalesce(g.event_id > b.event_id OR (g.event_id = b.event_id AND e.event_type = 'error'), false) AS gone FROM b LEFT JOIN g USING (user_id) JOIN events e ON e.event_id = b.event_id)"""

ORACLES = {
    "ivf_all_lists": f"SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ({_NEAR}) QUALIFY rank <= 10",
    "ivf_filtered": f"SELECT query_id, least(count(*), 100) AS n FROM ({_NEAR}) WHERE label IN (1, 2) GROUP BY query_id",
    "bm25_from_postings": f"WITH {_bm25_sql('m', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM mk",
    "cover_density": "WITH " + _covers(f"SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark", "w"),
    "cover_density_pairs": f"""WITH p AS (SELECT item_id, unnest(range(1, len(toks))) AS i, toks FROM (SELECT item_id, {TOKENS_SQL} AS toks FROM benchmark)),
        u AS (SELECT min(item_id * 10000 + i - 1) AS query_id, toks[i] AS a, toks[i + 1] AS b FROM p GROUP BY ALL),"""
    + _covers("SELECT query_id, a AS term FROM u UNION SELECT query_id, b FROM u", "w / (w + 1)"),
    "similar_words": f"""
        WITH a AS (SELECT DISTINCT unnest({TOKENS_SQL}) AS w FROM benchmark), b AS (SELECT DISTINCT unnest({TOKENS_SQL}) AS w FROM documents),
        x AS (SELECT w, {_GRAMS} AS g FROM a), y AS (SELECT w, {_GRAMS} AS g FROM b),
        p AS (SELECT x.w AS a, y.w AS b, len(list_intersect(x.g, y.g)) AS n, len(x.g) AS nx, len(y.g) AS ny FROM x JOIN y ON len(x.g) >= 0.5 * len(y.g) AND len(y.g) >= 0.5 * len(x.g))
        SELECT a, b, round(n / (nx + ny - n), 6) AS similarity FROM p WHERE n / (nx + ny - n) >= 0.5""",
    "late_interaction": """
        WITH t AS (SELECT vec_id // 8 AS doc_id, vec_id % 8 AS place, embedding::DOUBLE[] AS v FROM embeddings),
        u AS (SELECT doc_id, place, v, sqrt(list_inner_product(v, v)) AS n FROM t),
        b AS (SELECT q.doc_id AS query_id, q.place, d.doc_id, max(list_inner_product(q.v, d.v) / (q.n * d.n)) AS best FROM u q JOIN u d ON q.doc_id % 5 = 0 AND q.place % 2 = 0 GROUP BY ALL),
        r AS (SELECT query_id, doc_id, round(sum(best), 6) AS score FROM b GROUP BY ALL)
        SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 10""",
    "store_after_batches": f"WITH {_STORED} SELECT k.user_id, k.event_id, event_type, round(value, 6) AS value FROM k JOIN events USING (event_id) WHERE NOT gone",
    "store_lookup": f"WITH {_STORED} SELECT user_id, event_id FROM k WHERE NOT gone AND user_id IN (SELECT c_custkey FROM customer)",
    "store_info": f"WITH {_STORED} SELECT CAST(count(*) FILTER (NOT gone) AS BIGINT) AS rows, CAST(count(*) FILTER (gone) AS BIGINT) AS tombstones FROM k",
}
