"""Literal cases, invariants and edges of the operators."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.functions import vectors as V
from textloom.operators import chunking, documents, lexical, monitoring, relational
from textloom.operators import vectors as O


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("broken", "fixed"),
    [("\\frac{1{2", "\\frac{1{2}}"), ("\\begin{array} x", "\\begin{array} x \\end{array}"), ("\\left( x", "\\left( x \\right."), ("x    y", "x y"), ("x_", "x"), ("", ""), (None, None)],
)
def test_latex_repair(spark, broken, fixed):
    rows = documents.clean_latex(spark.createDataFrame([(broken,)], "x string"), "x")
    assert rows.first()["cleaned"] == fixed
    if fixed:
        assert one(spark, fixed, T.latex_error(F.col("x"))) is None


def test_markdown(spark):
    got = one(spark, "\\section{A}\\label{s} \\emph{b}", T.to_markdown(F.col("x")))
    assert got == "\n## A\n b"


def test_enrichment_of_the_known_sentence(spark):
    text = "The Euler buckling formula is $$P_{cr} = \\frac{\\pi^2 EI}{L^2}$$. See Figure 2-1."
    row = documents.enrich(spark.createDataFrame([(text,)], "text string")).first()
    assert (row["equation_count"], row["figure_references"], row["chunk_type"]) == (2, ["2-1"], "mixed")
    assert row["latex_source"] == "P_{cr} = \\frac{\\pi^2 EI}{L^2}"


def test_binary_code(spark):
    v = [1.0, -1.0, 1.0, -1.0, 1.0, 1.0, 1.0, -1.0]
    assert one(spark, v, V.binary_code(F.col("x")), "array<float>") == [117]
    assert one(spark, v, V.binary_decode(V.binary_code(F.col("x")), 8), "array<float>") == [int(x) for x in v]


def test_zero_vector(spark):
    assert one(spark, [0.0, 0.0], V.normalize(F.col("x")), "array<float>") == [0.0, 0.0]


def test_constant_vectors_have_scale_one(spark):
    rows = spark.createDataFrame([(1, [2.0, 2.0])], "vec_id long, embedding array<float>")
    assert O.int8_quantize(rows).first()["scale"] == 1.0


def test_fusion_hand_values(spark):
    a = spark.createDataFrame([(1, "doc_1", 1), (1, "doc_2", 2)], "query_id int, doc_id string, rank int")
    b = spark.createDataFrame([(1, "doc_2", 1), (1, "doc_1", 3)], "query_id int, doc_id string, rank int")
    got = {r["doc_id"]: round(r["score"], 6) for r in lexical.rrf(a, b, 0.5).collect()}
    assert got == {"doc_2": 0.016261, "doc_1": 0.016133}


def test_fusion_of_an_empty_side(spark):
    a = spark.createDataFrame([(1, "d", 1)], "query_id int, doc_id string, rank int")
    assert lexical.rrf(a, a.limit(0), 1.0).count() == 1


@pytest.mark.parametrize("kernel", sorted(chunking.KERNELS))
def test_chunks_cover_the_text_and_advance(spark, kernel):
    r = random.Random(1)
    texts = ["", "a", "x" * 5000, "Word. " * 900, "\n\n".join("Line of words, more; end. " * r.randint(1, 30) for _ in range(20)), "# H\n- a\n- b\n```\ncode\n```\n" * 40]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    found: dict[int, list] = {}
    for row in chunking.split(docs, kernel).orderBy("doc_id", "chunk_index").collect():
        found.setdefault(row["doc_id"], []).append((row["start_char"], row["end_char"], row["content"]))
    assert sorted(found) == [i for i, t in enumerate(texts) if t]
    for i, parts in found.items():
        assert parts[0][0] == 0 and parts[-1][1] == len(texts[i])
        for (a, b, c), (d, _, _) in zip(parts, parts[1:], strict=False):
            assert a < d <= b
            assert c == texts[i][a:b]


def test_overlap_must_be_below_size(spark):
    with pytest.raises(ValueError):
        chunking.fixed_windows(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 10, 10)


def test_unknown_filter_column():
    with pytest.raises(ValueError):
        relational.filters(chunk_type="text", columns=["document_id"])
    assert relational.filters() is None


def test_rolling_equals_plain_loop(spark):
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(minutes=7 * i), float((i * 37) % 101), i % 9 == 0) for i in range(400)]
    traces = spark.createDataFrame(data, "event_id long, ts timestamp, latency_ms double, failed boolean")
    placed = relational.positioned(traces, "ts", "event_id")
    got = {r["event_id"]: r["s"] for r in relational.rolling(placed, 10, {"s": F.sum("latency_ms")}, block=32).collect()}
    assert got == {i: sum(d[2] for d in data[max(0, i - 9) : i + 1]) for i in range(400)}


def test_lru_keeps_the_recent(spark):
    start = dt.datetime(2024, 1, 1)
    keys = ["a", "b", "a", "c", "b", "a"]
    rows = spark.createDataFrame([("x", k, start + dt.timedelta(seconds=i), i) for i, k in enumerate(keys)], "cache string, key string, ts timestamp, event_id long")
    got = {r["event_id"]: r["hit"] for r in monitoring.lru_hits(rows, 2).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False, 5: False}


def test_prefix_property_of_top_k(spark):
    r = random.Random(4)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(60)], "id long, v array<double>")
    queries = rows.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    short = {tuple(x) for x in O.batch_top_k(queries, rows, 3, block=16).collect()}
    assert short <= {tuple(x) for x in O.batch_top_k(queries, rows, 7, block=64).collect()}
    assert len(short) == 15


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    assert {(r["src"], r["dst"], r["depth"]) for r in relational.reach(edges, 5).collect()} == {("a", "b", 1), ("b", "a", 1)}
