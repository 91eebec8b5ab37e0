"""SQL functions against the DataFrame forms."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from textloom.functions import sql
from textloom.functions import text as T
from textloom.operators import chunking, latex, postings, vectors
from textloom.plans import sql_queries
from textloom.sources import stored

TEXTS = [(1, "One two three. Four five? " * 90), (2, ""), (3, None), (4, "\\section{A} $x$ and $$y$$\n\\begin{figure}f\\end{figure} é")]


@pytest.fixture(scope="module")
def texts(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    sql.register(spark, "t_")
    frame.createOrReplaceTempView("t_texts")
    return frame


@pytest.mark.parametrize("kernel", sorted(chunking.KERNELS))
def test_chunk_text(spark, texts, kernel):
    got = spark.sql(f"SELECT d.doc_id, c.* FROM t_texts d, LATERAL chunk_text('{kernel}', d.text) c").collect()
    want = chunking.split(texts, kernel).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got


def test_latex_spans(spark, texts):
    for what, patterns in (("equation", T.EQUATION_KINDS), ("section", {level: latex.HEADING.format(level=level) for level in T.HEADINGS})):
        got = spark.sql(f"SELECT d.doc_id, e.* FROM t_texts d, LATERAL latex_spans('{what}', d.text) e").collect()
        want = texts.select("doc_id", F.explode(latex.all_spans(F.col("text"), patterns)).alias("s")).select("doc_id", "s.kind", "s.start", "s.stop", "s.line", "s.found").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and got
    assert spark.sql("SELECT e.kind, e.found FROM t_texts d, LATERAL latex_spans('figure', d.text) e").collect() == [("figure", "\\begin{figure}f\\end{figure}")]


def test_scalars(spark, texts):
    row = spark.sql("SELECT cosine_similarity(array(1D, 0D), array(1D, 1D)) AS c, cosine_similarity(array(0D), array(0D)) AS z, text_tokens('A b-c, d_e! f') AS t, rrf_term(0.5D, 1) AS r, rrf_term(0.5D, NULL) AS n").first()
    assert row["c"] == pytest.approx(2**-0.5) and row["z"] == 0 and row["t"] == ["a", "b-c", "d_e", "f"] and row["r"] == 0.5 / 61 and row["n"] == 0
    assert spark.sql("SELECT doc_id FROM t_texts WHERE text_tokens(text) = array()").collect() == [(2,)]


def test_match_chunks_equals_top_k_and_prunes_in_every_task(spark):
    sql_queries._registered(spark, SMALL)
    found = spark.sql("SELECT * FROM match_chunks((SELECT embedding FROM loom_chunks WHERE chunk_id = 7), 5)")
    embeddings = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    own = embeddings.join(spark.read.parquet(f"{SMALL}/documents.parquet").select(F.col("doc_id").alias("vec_id")), "vec_id")
    want = vectors.top_k(own, embeddings.where("vec_id = 7").select(F.col("embedding").alias("q")), 5).collect()
    assert [r["chunk_id"] for r in found.orderBy("place").collect()] == [r["vec_id"] for r in want]
    assert "TakeOrderedAndProject(limit=5" in found._jdf.queryExecution().executedPlan().toString()


def test_hybrid_search_without_words_is_a_vector_search(spark):
    sql_queries._registered(spark, SMALL, terms=True)
    near = spark.sql("SELECT chunk_id FROM match_chunks((SELECT embedding FROM loom_chunks WHERE chunk_id = 7), 6) ORDER BY place").collect()
    both = spark.sql("SELECT chunk_id FROM hybrid_search((SELECT embedding FROM loom_chunks WHERE chunk_id = 7), 'zzqx nowhere', 6) ORDER BY place").collect()
    assert near == both


def test_register_checks_its_views(spark):
    with pytest.raises(ValueError, match="embedding"):
        sql.register(spark, "bad_", chunks=spark.createDataFrame([(1,)], "chunk_id long"))


def test_postings_view_has_what_the_function_reads(spark):
    index = postings.Postings.write(spark.createDataFrame([(1, "a b a")], "doc_id long, text string"), stored.new_path(spark, "p"))
    assert {"term", "doc_id", "places"} <= set(index.rows().columns)
