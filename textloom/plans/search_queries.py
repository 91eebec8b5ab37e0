"""Queries over vectors, lexical search and fusion, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import lexical as L
from ..operators import vectors as O
from .common import Derived, table
from .text_queries import TOKENS_SQL

QUESTIONS = [
    (1, "What is the stress-strain relationship?"), (2, "Calculate the moment of inertia for a rectangular beam"), (3, "Show me equations for beam deflection"), (4, "FEM analysis of wing structures"),
    (5, "Overview of aerospace structures in chapter 3"), (6, "Euler buckling in chapter 10"), (7, "stress analysis with equations"), (8, "deflection formulas on page 50 to 60"),
    (9, "material properties from chapter 3 with equations, pages 4-9"), (10, "HNSW and CFD diagrams on page 7 of Section 12"), (11, "the ann algorithm, dof"), (12, ""),
]
#: The literal questions, and every passage with words that name filters.
ASKED = Derived(QUESTIONS, "id int, query string", ("benchmark", "item_id + 100", "concat(text, CASE item_id % 7 WHEN 1 THEN ' in chapter 3 with equations' WHEN 2 THEN ' pages 4-9' WHEN 3 THEN ' explain the FEM stress of a beam equation' WHEN 4 THEN ' from chapter 12 on pages 7 to 30' WHEN 5 THEN ' overview with diagrams of HNSW' WHEN 6 THEN ' page 5, containing a formula' ELSE '' END)"))

_emb = lambda s, d: table(s, d, "embeddings")
_q = lambda s, d: _emb(s, d).where("vec_id = 0").select(F.col("embedding").alias("q"))


def vector_topk(s, d):
    return O.top_k(_emb(s, d), _q(s, d), 10)


def vector_topk_filtered(s, d):
    return O.top_k(_emb(s, d), _q(s, d), 10, where=F.col("label").isin(1, 2, 3), least=0.05)


def _batches(s, d, vectors=None):
    e = _emb(s, d)
    return O.batch_top_k(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), vectors if vectors is not None else e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 10)


def vector_batch_topk(s, d):
    return _batches(s, d)


def vector_normalize(s, d):
    v = V.normalize(F.transform(F.col("embedding"), lambda x: x * 2))
    return _emb(s, d).select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(F.get(v, F.lit(0)), 6).alias("first"), F.round(F.get(v, F.lit(63)), 6).alias("last"))


def matryoshka_truncate(s, d):
    v = V.truncate(F.col("embedding"), 16)
    return _emb(s, d).select("vec_id", F.size(v).cast("long").alias("dims"), F.round(F.get(v, F.lit(15)), 6).alias("last"), F.round(V.norm(v), 6).alias("norm"))


def binary_quantize(s, d):
    code = V.binary_code(F.col("embedding"))
    return _emb(s, d).select("vec_id", F.array_join(code.cast("array<string>"), ",").alias("code"))


def binary_dequantize(s, d):
    back = V.binary_decode(V.binary_code(F.col("embedding")), 64)
    return _emb(s, d).select("vec_id", F.aggregate(back, F.lit(0), lambda a, x: a + x).cast("long").alias("balance"))


def int8_quantize(s, d):
    q = O.int8_quantize(_emb(s, d))
    return q.select("vec_id", F.array_join(q["code"].cast("array<string>"), ",").alias("code"))


def int8_roundtrip_error(s, d):
    q = O.int8_quantize(_emb(s, d)).join(_emb(s, d).select("vec_id", "embedding"), "vec_id")
    err = F.zip_with(V.int8_decode(F.col("code"), F.col("low"), F.col("scale")), V.as_double(F.col("embedding")), lambda a, b: F.abs(a - b))
    return q.select("vec_id", F.round(F.array_max(err), 6).alias("max_error"))


def hamming_topk(s, d):
    return O.hamming_rescored(_emb(s, d), _q(s, d), 10)


def accuracy_retention(s, d):
    e = _emb(s, d)
    coded = O.int8_quantize(e).select(F.col("vec_id").alias("id"), V.int8_decode(F.col("code"), F.col("low"), F.col("scale")).alias("v"))
    return O.retention(_batches(s, d), _batches(s, d, coded), 10)


def centroids_by_label(s, d):
    rows = _emb(s, d).select("label", F.posexplode(V.as_double(F.col("embedding"))).alias("i", "x"))
    return rows.groupBy("label", F.col("i").cast("long").alias("dim")).agg(F.round(F.avg("x"), 6).alias("mean"))


def intra_inter_similarity(s, d):
    return O.label_similarity(_emb(s, d))


def storage_estimate(s, d):
    mb = lambda n: F.round(n / 1048576.0, 6)
    size = F.sum(F.size("embedding")).cast("long")
    return _emb(s, d).agg(F.count("*").alias("n"), mb(size * 4).alias("float_mb"), mb(F.sum(F.ceil(F.size("embedding") / 8)).cast("long")).alias("binary_mb"), mb(F.count("*") * 1024).alias("metadata_mb"))


def idf_table(s, d):
    return L.document_frequencies(table(s, d, "documents"))


def _asked(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


def bm25_topk(s, d):
    return _rounded(L.bm25(_asked(s, d), table(s, d, "documents")))


def bm25_filtered(s, d):
    return _rounded(L.bm25(_asked(s, d), table(s, d, "documents").where("lang = 'en'"), k=5))


def query_analyze(s, d):
    return L.analyze(ASKED.df(s, d))


def query_filters_v2(s, d):
    return ASKED.df(s, d).select("id", *(c.alias(k) for k, c in L.filters_v2(F.col("query")).items()))


def query_preprocess(s, d):
    return ASKED.df(s, d).select("id", L.preprocess_query(F.col("query")).alias("processed"))


def _two_lists(s, d):
    """The ten nearest rows of each query by whole vectors and by their first sixteen dimensions."""
    short = _emb(s, d).select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 16).alias("v"))
    near = O.batch_top_k(short.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q")), short, 10)
    return tuple(x.withColumnRenamed("id", "doc_id") for x in (_batches(s, d), near))


def rrf_fuse(s, d):
    out = None
    whole, short = _two_lists(s, d)
    for a in (0.3, 0.5, 0.7):
        part = L.rrf(whole, short, a).select(F.lit(a).alias("alpha"), "query_id", "doc_id", "score", F.col("rank").cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def hybrid_rrf(s, d):
    """The best twenty documents of each passage by BM25 and by nearness of vectors, fused by rank; a passage's vector is the one of its own id."""
    e = _emb(s, d).select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = _asked(s, d)
    near = O.batch_top_k(e.join(asked.select(F.col("query_id").alias("id")), "id").select(F.col("id").alias("query_id"), F.col("v").alias("q")), e, 20).withColumnRenamed("id", "doc_id")
    return L.rrf(near, L.bm25(asked, table(s, d, "documents"), 20), 0.5, top=10).select("query_id", "doc_id", "score", F.col("rank").cast("long"))


def weighted_hybrid(s, d):
    return L.weighted(*_two_lists(s, d)).select("query_id", "doc_id", "vector_score", "text_score", "score", F.col("rank").cast("long"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_filtered, vector_batch_topk, vector_normalize, matryoshka_truncate, binary_quantize, binary_dequantize, int8_quantize, int8_roundtrip_error, hamming_topk, accuracy_retention, centroids_by_label, intra_inter_similarity, storage_estimate, idf_table, bm25_topk, bm25_filtered, query_analyze, query_filters_v2, query_preprocess, rrf_fuse, hybrid_rrf, weighted_hybrid)}

COS = "list_sum(list_transform(list_zip(a.embedding, q.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))))"
CODE = "list_transform(range(0, 8), lambda b: list_sum(list_transform(range(0, 8), lambda i: CASE WHEN embedding[b * 8 + i + 1] > 0 THEN 1 << i ELSE 0 END))::INTEGER)"
BATCH = """
    q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
    {name} AS (
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM (SELECT q.query_id, a.vec_id AS id, round({cos}, 6) AS score FROM q JOIN {source} a ON a.vec_id <> q.query_id)
        QUALIFY rank <= 10)"""
BM25 = """
    {p}t AS (SELECT doc_id, {tokens} AS toks FROM documents {where}),
    {p}s AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM {p}t),
    {p}p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {p}t) GROUP BY ALL),
    {p}f AS (SELECT term, count(*) AS df FROM {p}p GROUP BY term),
    {p}q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({tokens}) AS term FROM benchmark) GROUP BY ALL),
    {p}r AS (
        SELECT query_id, doc_id, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM {p}q JOIN {p}p USING (term) JOIN {p}f USING (term), {p}s GROUP BY query_id, doc_id),
    {p}k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {p}r QUALIFY rank <= {k})"""


def _bm25_sql(p: str, k: int, where: str = "") -> str:
    return BM25.format(p=p, k=k, where=where, tokens=TOKENS_SQL)


_WORDS = lambda words: "(" + " OR ".join(f"contains(lower(query), '{w}')" for w in words) + ")"
_QUESTIONS_SQL = ASKED.sql()
_KIND = f"CASE WHEN {_WORDS(L.EQUATION_WORDS)} THEN 'equation' WHEN {_WORDS(L.PROCEDURAL_WORDS)} THEN 'procedural' WHEN {_WORDS(L.EXPLORATORY_WORDS)} THEN 'exploratory' WHEN {_WORDS(L.CONCEPTUAL_WORDS)} THEN 'conceptual' ELSE 'factual' END"
_SPELLED = "lower(query)"
for _k, _v in L.ABBREVIATIONS.items():
    _SPELLED = rf"regexp_replace({_SPELLED}, '\b{_k}\b', '{_v}', 'g')"
_TERMS = "len(list_filter([" + ", ".join(f"'{t.lower()}'" for t in L.TECHNICAL_TERMS) + "], lambda t: contains(lower(query), t)))"

_LISTS = f"""
    e AS (SELECT vec_id, embedding[1:16] AS embedding FROM embeddings), {BATCH.format(name='s', cos=COS, source='embeddings')},
    b AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
          FROM (SELECT q.vec_id AS query_id, a.vec_id AS id, round({COS}, 6) AS score FROM e q JOIN e a ON q.vec_id % 20 = 0 AND a.vec_id <> q.vec_id) QUALIFY rank <= 10)"""

ORACLES = {
    "vector_topk": f"SELECT a.vec_id, round({COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 10",
    "vector_topk_filtered": f"SELECT * FROM (SELECT a.vec_id, round({COS}, 6) AS score FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE a.label IN (1, 2, 3)) WHERE score >= 0.05 ORDER BY score DESC, vec_id LIMIT 10",
    "vector_batch_topk": f"WITH {BATCH.format(name='r', cos=COS, source='embeddings')} SELECT * FROM r",
    "vector_normalize": "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: 4 * x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, 1.0::DOUBLE AS norm, round(2 * embedding[1]::DOUBLE / n, 6) AS first, round(2 * embedding[64]::DOUBLE / n, 6) AS last FROM n",
    "matryoshka_truncate": "WITH n AS (SELECT vec_id, embedding, sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) SELECT vec_id, 16::BIGINT AS dims, round(embedding[16]::DOUBLE / n, 6) AS last, 1.0::DOUBLE AS norm FROM n",
    "binary_quantize": f"SELECT vec_id, array_to_string({CODE}, ',') AS code FROM embeddings",
    "binary_dequantize": "SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE -1 END)) AS BIGINT) AS balance FROM embeddings",
    "int8_quantize": "WITH r AS (SELECT min(list_min(embedding))::DOUBLE AS low, (max(list_max(embedding))::DOUBLE - min(list_min(embedding))::DOUBLE) / 255 AS scale FROM embeddings) SELECT vec_id, array_to_string(list_transform(embedding, lambda x: (floor((x::DOUBLE - low) / scale) - 128)::INTEGER), ',') AS code FROM embeddings, r",
    "int8_roundtrip_error": "WITH r AS (SELECT min(list_min(embedding))::DOUBLE AS low, (max(list_max(embedding))::DOUBLE - min(list_min(embedding))::DOUBLE) / 255 AS scale FROM embeddings) SELECT vec_id, round(list_max(list_transform(embedding, lambda x: abs(floor((x::DOUBLE - low) / scale) * scale + low - x::DOUBLE))), 6) AS max_error FROM embeddings, r",
    "hamming_topk": f"""
        WITH c AS (SELECT vec_id, embedding, {CODE} AS code FROM embeddings),
        n AS (SELECT a.*, q.embedding AS qe, CAST(list_sum(list_transform(list_zip(a.code, q.code), lambda z: bit_count(xor(z[1], z[2])))) AS BIGINT) AS distance
              FROM c a, (SELECT * FROM c WHERE vec_id = 0) q ORDER BY distance, a.vec_id LIMIT 30)
        SELECT vec_id, distance, round({COS.replace('a.embedding', 'embedding').replace('q.embedding', 'qe')}, 6) AS score FROM n ORDER BY score DESC, vec_id LIMIT 10""",
    "accuracy_retention": f"""
        WITH m AS (SELECT min(list_min(embedding))::DOUBLE AS low, (max(list_max(embedding))::DOUBLE - min(list_min(embedding))::DOUBLE) / 255 AS scale FROM embeddings),
        coded AS (SELECT vec_id, list_transform(embedding, lambda x: floor((x::DOUBLE - low) / scale) * scale + low) AS embedding FROM embeddings, m),
        {BATCH.format(name='exact', cos=COS, source='embeddings')}, near AS (
        SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
        FROM (SELECT q.query_id, a.vec_id AS id, round({COS}, 6) AS score FROM q JOIN coded a ON a.vec_id <> q.query_id) QUALIFY rank <= 10)
        SELECT round(count(*) * 100.0 / ((SELECT count(*) FROM q) * 10), 6)::DOUBLE AS retention, (SELECT count(*) FROM q) AS n FROM exact JOIN near USING (query_id, id)""",
    "centroids_by_label": "SELECT label, dim, round(avg(x), 6) AS mean FROM (SELECT label, unnest(range(0, 64)) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, dim",
    "intra_inter_similarity": f"SELECT round(avg(c) FILTER (same), 6) AS intra, round(avg(c) FILTER (NOT same), 6) AS inter FROM (SELECT a.label = q.label AS same, {COS} AS c FROM embeddings a JOIN embeddings q ON a.vec_id <> q.vec_id)",
    "storage_estimate": "SELECT count(*) AS n, round(sum(len(embedding)) * 4 / 1048576.0::DOUBLE, 6) AS float_mb, round(sum((len(embedding) + 7) // 8) / 1048576.0::DOUBLE, 6) AS binary_mb, round(count(*) * 1024 / 1048576.0::DOUBLE, 6) AS metadata_mb FROM embeddings",
    "idf_table": f"WITH f AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS_SQL})) AS term FROM documents) GROUP BY term) SELECT term, df, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM f",
    "bm25_topk": f"WITH {_bm25_sql('m', 10)} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM mk",
    "bm25_filtered": f"WITH {_bm25_sql('m', 5, chr(87) + 'HERE lang = ' + chr(39) + 'en' + chr(39))} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM mk",
    "query_analyze": rf"""
        WITH t AS (SELECT CAST(id AS INTEGER) AS id, query, {_KIND} AS query_type, {_TERMS} AS terms FROM {_QUESTIONS_SQL}),
        a AS (SELECT *, round(greatest(0.0, least(1.0, CASE query_type {' '.join(f"WHEN '{k}' THEN {v}" for k, v in L.BASE_ALPHA.items())} END + CASE WHEN terms >= 3 THEN 0.1 WHEN terms = 0 THEN -0.1 ELSE 0 END)), 6)::DOUBLE AS alpha FROM t)
        SELECT id, query, query_type, alpha, query {' '.join(f"|| CASE WHEN contains(query, '{k}') THEN ' {v}' ELSE '' END" for k, v in L.EXPANSIONS.items())} AS expanded_query,
               'chapter_' || nullif(regexp_extract(query, '(?i)(?:chapter|section)\s+(\d+)', 1), '') AS document_id, regexp_matches(query, '(?i)with\s+equations?') AS has_equations,
               CAST(nullif(regexp_extract(query, '(?i)pages?\s+(\d+)(?:\s*-\s*(\d+))?', 1), '') AS INTEGER) AS page_gte,
               CAST(coalesce(nullif(regexp_extract(query, '(?i)pages?\s+(\d+)(?:\s*-\s*(\d+))?', 2), ''), nullif(regexp_extract(query, '(?i)pages?\s+(\d+)(?:\s*-\s*(\d+))?', 1), '')) AS INTEGER) AS page_lte,
               regexp_matches(query, '(?i)with\s+figures?|diagrams?') AS has_figures,
               printf('Query type: %s. %s. Fusion weight: %.2f (0=semantic, 1=BM25).', query_type, CASE query_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in L.STRATEGY.items())} END, alpha) AS strategy
        FROM a""",
    "query_filters_v2": rf"""
        SELECT CAST(id AS INTEGER) AS id, CASE WHEN regexp_matches(query, '(?i)(?:in|from)\s+chapter\s+(\d+)') THEN 'chapter_' || lpad(regexp_extract(query, '(?i)(?:in|from)\s+chapter\s+(\d+)', 1), 2, '0') END AS document_id,
               regexp_matches(query, '(?i)\b(with|containing|has)\s+(equation|formula)') AS has_equations,
               CAST(nullif(regexp_extract(query, '(?i)pages?\s+(\d+)\s*(?:to|-)\s*(\d+)', 1), '') AS INTEGER) AS page_number_min, CAST(nullif(regexp_extract(query, '(?i)pages?\s+(\d+)\s*(?:to|-)\s*(\d+)', 2), '') AS INTEGER) AS page_number_max
        FROM {_QUESTIONS_SQL}""",
    "query_preprocess": rf"SELECT CAST(id AS INTEGER) AS id, trim(regexp_replace(regexp_replace({_SPELLED}, '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '\s+', ' ', 'g')) AS processed FROM {_QUESTIONS_SQL}",
    "rrf_fuse": f"""
        WITH {_LISTS}, w AS (SELECT unnest([0.3, 0.5, 0.7])::DOUBLE AS alpha),
        f AS (SELECT alpha, coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.id, b.id) AS doc_id, round(coalesce(alpha / (60 + s.rank), 0) + coalesce((1 - alpha) / (60 + b.rank), 0), 9) AS score FROM (s FULL JOIN b ON s.query_id = b.query_id AND s.id = b.id), w)
        SELECT *, row_number() OVER (PARTITION BY alpha, query_id ORDER BY score DESC, doc_id) AS rank FROM f""",
    "hybrid_rrf": f"""
        WITH {_bm25_sql('m', 20)}, nk AS (
            SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
            FROM (SELECT q.vec_id AS query_id, a.vec_id AS doc_id, round({COS}, 6) AS score FROM embeddings q JOIN benchmark ON item_id = q.vec_id JOIN embeddings a ON a.vec_id <> q.vec_id) QUALIFY rank <= 20),
        f AS (SELECT coalesce(mk.query_id, nk.query_id) AS query_id, coalesce(mk.doc_id, nk.doc_id) AS doc_id, round(coalesce(0.5::DOUBLE / (60 + mk.rank), 0) + coalesce(0.5::DOUBLE / (60 + nk.rank), 0), 9) AS score
              FROM mk FULL JOIN nk ON mk.query_id = nk.query_id AND mk.doc_id = nk.doc_id)
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
    "weighted_hybrid": f"""
        WITH {_LISTS}, f AS (SELECT coalesce(s.query_id, b.query_id) AS query_id, coalesce(s.id, b.id) AS doc_id, coalesce(s.score, 0)::DOUBLE AS vector_score, coalesce(b.score, 0)::DOUBLE AS text_score FROM s FULL JOIN b ON s.query_id = b.query_id AND s.id = b.id)
        SELECT query_id, doc_id, vector_score, text_score, round(vector_score * 0.7::DOUBLE + text_score * 0.3::DOUBLE, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(vector_score * 0.7::DOUBLE + text_score * 0.3::DOUBLE, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
}
