"""Queries through the library's SQL functions, and their SQL for the other engine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sql as Q
from ..functions import text as T
from ..operators import postings as P
from ..sources import stored as S
from .common import table
from .evaluation_queries import _docs
from .index_queries import _covers
from .ops_queries import ORACLES as OPS_ORACLES
from .search_queries import COS
from .structure_queries import BOOK_SQL, _books, _spans_sql
from .text_queries import TOKENS_SQL

SLIDING_SQL = OPS_ORACLES["chunk_sliding"]


def _registered(s, d, terms=False):
    """Five documents each are the chunks of a larger one."""
    docs = _docs(s, d)
    vectors = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    chunks = docs.join(vectors, "doc_id", "left").select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 5").alias("document_id"), (F.col("doc_id") % 5).cast("int").alias("chunk_index"), F.col("text").alias("content"), "embedding", F.to_json(F.struct("lang", "n_chars")).alias("metadata"))
    whole = docs.groupBy(F.expr("doc_id div 5").alias("document_id")).agg(F.min("source").alias("source")).withColumn("title", F.concat(F.lit("Document "), F.col("document_id").cast("string")))
    places = P.Postings.write(docs, S.new_path(s, "postings")).rows().select("term", F.col("doc_id").alias("chunk_id"), "places") if terms else None
    Q.register(s, "loom_", documents=whole, chunks=chunks, terms=places)


def sql_match_chunks(s, d):
    _registered(s, d)
    return s.sql("SELECT chunk_id, document_title, round(similarity, 6) AS similarity, CAST(place AS BIGINT) AS place FROM match_chunks((SELECT embedding FROM loom_chunks WHERE chunk_id = 3), 12, 0D)")


def sql_hybrid_search(s, d):
    """Three passages, each with the vector of its own id."""
    _registered(s, d, terms=True)
    asked = table(s, d, "benchmark").select("item_id", F.col("text").alias("query"))
    asked.createOrReplaceTempView("loom_asked")
    one = "SELECT {i} AS query_id, chunk_id, round(combined_score, 6) AS score, round(text_similarity, 6) AS text_similarity, CAST(place AS BIGINT) AS place FROM hybrid_search((SELECT embedding FROM loom_chunks WHERE chunk_id = {i}), (SELECT query FROM loom_asked WHERE item_id = {i}), 8, 0.5D)"
    return s.sql(" UNION ALL ".join(one.format(i=i) for i in (0, 1, 2)))


def sql_document_chunks(s, d):
    _registered(s, d)
    return s.sql("SELECT chunk_id, CAST(chunk_index AS BIGINT) AS chunk_index, md5(content) AS digest, metadata FROM get_document_chunks(2)")


def sql_scalars(s, d):
    """BM25 of the words of all documents by scalar functions alone."""
    Q.register(s, "loom_")
    _docs(s, d).createOrReplaceTempView("loom_texts")
    counted = s.sql("""
        WITH t AS (SELECT doc_id, text_tokens(text) AS toks FROM loom_texts)
        SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, size(toks) AS dl, explode(toks) AS term FROM t) GROUP BY doc_id, dl, term""")
    S.stored(counted, "counted").createOrReplaceTempView("loom_counted")  # read twice, counted once
    return s.sql("""
        WITH n AS (SELECT count(*) AS n, avg(size(text_tokens(text))) AS avgdl FROM loom_texts), f AS (SELECT term, count(*) AS df FROM loom_counted GROUP BY term)
        SELECT doc_id, round(sum(bm25_term(tf, dl, avgdl, df, n)), 5) AS weight FROM loom_counted JOIN f USING (term) CROSS JOIN n GROUP BY doc_id""")


def sql_chunks_lateral(s, d):
    """The windows of every text by a table function, called laterally."""
    Q.register(s, "loom_")
    _docs(s, d).createOrReplaceTempView("loom_texts")
    return s.sql("SELECT d.doc_id, count(*) AS n, sum(c.token_count) AS words, min(md5(c.content)) AS least FROM loom_texts d, LATERAL chunk_text('sliding', d.text) c GROUP BY d.doc_id")


def sql_latex_lateral(s, d):
    Q.register(s, "loom_")
    _books(s, d).createOrReplaceTempView("loom_books")
    return s.sql("SELECT b.id, e.kind, CAST(e.start AS BIGINT) AS start, CAST(e.stop AS BIGINT) AS stop FROM loom_books b, LATERAL latex_spans('equation', b.text) e")


QUERIES = {f.__name__: f for f in (sql_match_chunks, sql_hybrid_search, sql_document_chunks, sql_scalars, sql_chunks_lateral, sql_latex_lateral)}

ORACLES = {
    "sql_match_chunks": f"""SELECT a.vec_id AS chunk_id, 'Document ' || (doc_id // 5) AS document_title, round({COS}, 6) AS similarity, row_number() OVER (ORDER BY {COS} DESC, a.vec_id) AS place
        FROM embeddings a JOIN documents ON doc_id = vec_id, (SELECT embedding FROM embeddings WHERE vec_id = 3) q WHERE {COS} >= 0 QUALIFY place <= 12""",
    "sql_hybrid_search": "WITH w AS (SELECT * FROM (WITH " + _covers(f"SELECT DISTINCT item_id AS query_id, unnest({TOKENS_SQL}) AS term FROM benchmark WHERE item_id < 3", "w").rsplit("SELECT query_id, doc_id, round(score, 6)", 1)[0] + f"""SELECT * FROM r)),
        v AS (SELECT q.vec_id AS query_id, a.vec_id AS doc_id, {COS} AS v FROM embeddings a JOIN documents ON doc_id = a.vec_id JOIN embeddings q ON q.vec_id < 3),
        c AS (SELECT coalesce(v.query_id, w.query_id) AS query_id, coalesce(v.doc_id, w.doc_id) AS chunk_id, coalesce(w.score, 0) AS t, coalesce(v, 0) * 0.5::DOUBLE + coalesce(w.score, 0) * 0.5::DOUBLE AS s FROM v FULL JOIN w ON v.query_id = w.query_id AND v.doc_id = w.doc_id)
        SELECT CAST(query_id AS INTEGER) AS query_id, chunk_id, round(s, 6) AS score, round(t, 6) AS text_similarity, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS place FROM c QUALIFY place <= 8""",
    "sql_document_chunks": """SELECT doc_id AS chunk_id, doc_id % 5 AS chunk_index, md5(text) AS digest, '{"lang":"' || lang || '","n_chars":' || n_chars || '}' AS metadata FROM documents WHERE doc_id // 5 = 2""",
    "sql_scalars": f"""
        WITH t AS (SELECT doc_id, {TOKENS_SQL} AS toks FROM documents), n AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM t),
        p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM t) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
        SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 5) AS weight FROM p JOIN f USING (term), n GROUP BY doc_id""",
    "sql_chunks_lateral": f"SELECT doc_id, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS words, min(digest) AS least FROM ({SLIDING_SQL}) GROUP BY doc_id",
    "sql_latex_lateral": f"WITH b AS MATERIALIZED (SELECT * FROM {BOOK_SQL}) SELECT id, kind, start, stop FROM {_spans_sql(dict(T.EQUATION_KINDS))}",
}
