"""The library's operators as functions of SQL.

`register` puts views and functions into a session: scalar expressions and
table functions are SQL of their own, so Spark inlines and plans them like any
other; chunkers and LaTeX structure are table functions over Arrow batches, to
be called laterally.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..operators import chunking, latex, postings
from . import text as T

SCALARS = {
    "dot_product(a array<double>, b array<double>) RETURNS double": "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)",
    "cosine_similarity(a array<double>, b array<double>) RETURNS double": "coalesce(try_divide(dot_product(a, b), sqrt(dot_product(a, a)) * sqrt(dot_product(b, b))), 0D)",
    "text_tokens(t string) RETURNS array<string>": f"array_remove(split(lower(t), r'{T.BETWEEN}'), '')",
    "bm25_term(tf double, dl double, avgdl double, df double, n double) RETURNS double": "ln((n - df + 0.5D) / (df + 0.5D) + 1D) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * dl / avgdl))",
    "rrf_term(weight double, place int) RETURNS double": "coalesce(weight / (60D + place), 0D)",
}

#: Views the table functions read: the columns each must have.
VIEWS = {
    "documents": ("document_id", "title", "source"),
    "chunks": ("chunk_id", "document_id", "chunk_index", "content", "embedding", "metadata"),
    "terms": ("term", "chunk_id", "places"),
}

_FOUND = "chunk_id bigint, document_id bigint, content string, {scores}, metadata string, document_title string, document_source string, place int"
TABLES = {
    # the nearest chunks of a vector; a row number that is at most a constant is a top-k of every task first
    f"match_chunks(q array<double>, match_count int DEFAULT 10, least double DEFAULT -1) RETURNS TABLE({_FOUND.format(scores='similarity double')})": """
        SELECT chunk_id, document_id, content, similarity, metadata, title, source, place FROM (
            SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS place FROM (
                SELECT c.*, d.title, d.source, cosine_similarity(c.embedding, match_chunks.q) AS similarity
                FROM {chunks} c JOIN {documents} d ON c.document_id = d.document_id WHERE c.embedding IS NOT NULL)
            WHERE similarity >= match_chunks.least)
        WHERE place <= match_chunks.match_count""",
    f"hybrid_search(q array<double>, query_text string, match_count int DEFAULT 10, text_weight double DEFAULT 0.3) RETURNS TABLE({_FOUND.format(scores='combined_score double, vector_similarity double, text_similarity double')})": """
        WITH words AS (SELECT explode(t) AS term FROM (SELECT array_distinct(text_tokens(hybrid_search.query_text)) AS t)),
        near AS (SELECT chunk_id, cosine_similarity(embedding, hybrid_search.q) AS v FROM {chunks} WHERE embedding IS NOT NULL),
        named AS (SELECT t.chunk_id, cover_weight(collect_list(t.places)) AS w FROM {terms} t JOIN words USING (term) GROUP BY t.chunk_id HAVING count(*) = (SELECT count(*) FROM words)),
        scored AS (SELECT coalesce(near.chunk_id, named.chunk_id) AS chunk_id, coalesce(v, 0D) AS v, coalesce(w, 0D) AS w FROM near FULL JOIN named ON near.chunk_id = named.chunk_id),
        ranked AS (SELECT *, v * (1 - hybrid_search.text_weight) + w * hybrid_search.text_weight AS score FROM scored),
        best AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, chunk_id) AS place FROM ranked) WHERE place <= hybrid_search.match_count)
        SELECT b.chunk_id, c.document_id, c.content, b.score, b.v, b.w, c.metadata, d.title, d.source, b.place
        FROM best b JOIN {chunks} c ON c.chunk_id = b.chunk_id JOIN {documents} d ON c.document_id = d.document_id""",
    "get_document_chunks(id bigint) RETURNS TABLE(chunk_id bigint, content string, chunk_index int, metadata string)": """
        SELECT chunk_id, content, chunk_index, metadata FROM {chunks} WHERE document_id = get_document_chunks.id ORDER BY chunk_index""",
}


def _chunk_text():
    @F.udtf(returnType="chunk_index int, start_char int, end_char int, content string, token_count int")
    class ChunkText:
        """Chunks of a text by a kernel's name; a null or empty text has none."""

        def eval(self, kernel: str, text: str) -> Iterator[tuple]:
            for i, (a, b) in enumerate(chunking.KERNELS[kernel](text) if text else ()):
                yield i, a, b, text[a:b], chunking.words_in(text[a:b])

    return ChunkText


def _latex_spans():
    compiled = {"section": {level: latex.HEADING.format(level=level) for level in T.HEADINGS}, "equation": T.EQUATION_KINDS, "figure": {kind: rf"(?s)\\begin\{{{kind}\}}(.+?)\\end\{{{kind}\}}" for kind in latex.FIGURE_KINDS}}

    @F.udtf(returnType="kind string, start int, stop int, line int, found string")
    class LatexSpans:
        """Headings, equations or figures (`section`, `equation`, `figure`) of a LaTeX text with their places."""

        def eval(self, what: str, text: str) -> Iterator[tuple]:
            for kind, a, b, line, found, _, _ in latex.span_rows(text, latex.compiled(compiled[what])) if text else ():
                yield kind, a, b, line, found

    return LatexSpans


def register(spark: SparkSession, prefix: str, documents: DataFrame | None = None, chunks: DataFrame | None = None, terms: DataFrame | None = None) -> None:
    """Create the session's functions, and those over tables for the views that are given.

    Views are named `prefix` + the name in VIEWS, so that they hide no table;
    functions read the views of the last call.
    """

    def cover(places: pa.Array) -> pa.Array:
        return pa.array([postings.cover_weights(p) for p in places.to_pylist()], pa.float64())

    spark.udf.register("cover_weight", F.arrow_udf(cover, DoubleType()))
    spark.udtf.register("chunk_text", _chunk_text())
    spark.udtf.register("latex_spans", _latex_spans())
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    given = {"documents": documents, "chunks": chunks, "terms": terms}
    for name, frame in given.items():
        if frame is not None:
            if missing := set(VIEWS[name]) - set(frame.columns):
                raise ValueError(f"{name} lacks {sorted(missing)}")
            frame.createOrReplaceTempView(prefix + name)
    held = {name for name, frame in given.items() if frame is not None}
    for head, body in TABLES.items():
        if all(name in held for name in VIEWS if "{" + name + "}" in body):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body.format(**{v: prefix + v for v in VIEWS})}")
