"""What the findings of round 3 asked for."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import chunking, late_interaction, models, parallel, postings, prompts
from textloom.plans import file_queries
from textloom.sources import stored


@pytest.mark.parametrize("block_tokens", [1, 40, 1 << 21])
def test_searches_score_documents_where_their_block_is(spark, block_tokens):
    rng = random.Random(3)
    texts = {i: [rng.choice("abcdefg") for _ in range(rng.randint(0, 30))] for i in range(60)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b"), (2, "c d e"), (3, "g"), (4, "a zz")], "query_id long, query string")
    index = postings.Postings.write(docs, stored.new_path(spark, "postings"), buckets=3, block_tokens=block_tokens)
    want = {}
    for query, terms in ((1, "ab"), (2, "cde"), (3, "g")):
        places = {i: [[p for p, w in enumerate(t) if w == term] for term in terms] for i, t in texts.items()}
        scores = [(-round(postings.cover_weights(p), 9), i) for i, p in places.items() if all(p)]
        want[query] = [i for _, i in sorted(scores)[:5]]
    found = index.cover_density(asked, 5)
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["doc_id"])
    assert got == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan  # no row for each query and document
    rows = {(r["term"], r["doc_id"]): list(r["places"]) for r in index.rows().collect()}
    assert rows == {(w, i): [p for p, x in enumerate(t) if x == w] for i, t in texts.items() for w in set(t)}
    assert index.blocks().agg(F.countDistinct("block")).first()[0] >= (20 if block_tokens == 1 else 1)


def test_scores_of_a_summary_are_rounded_as_in_sql(spark):
    scores = [12.3125, 0.0625, 0.1875, 12.3445, 1.0005, 2.0015, 3.14159, 1234.5678, 0.0]
    rows = spark.createDataFrame([(i, 1, x, "t", "s", "c") for i, x in enumerate(scores)], "query_id long, rank int, score double, title string, source string, content string")
    got = {r["query_id"]: r["summary"] for r in prompts.context_summary(rows).collect()}
    assert got == {i: f"Chunk 1 (Score: {x:.3f}):\nSource: t (s)\nContent: c..." for i, x in enumerate(scores)}


def test_files_that_are_read_whole_are_bounded(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"line {i}", "en", "web", 6) for i in range(2500)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    made = spark.read.text(file_queries._files(spark, str(tmp_path))).groupBy(F.input_file_name()).count().collect()
    assert max(r["count"] for r in made) <= 1000 and sum(r["count"] for r in made) == 2500
    assert [tuple(r) for r in file_queries.file_texts(spark, str(tmp_path)).collect()] == [("en", 2500, sum(len(f"line {i}") for i in range(2500)), 2500)]


@pytest.mark.parametrize("long", [1 << 17, 6])
def test_queries_and_documents_meet_in_tiles(spark, long, monkeypatch):
    for name, value in (("QUERY_TILE", 8), ("DOC_TILE", 20), ("LONG", long)):
        monkeypatch.setattr(late_interaction, name, value)
    rng = np.random.default_rng(5)
    docs = {i: rng.normal(size=(rng.integers(1, 12), 4)) for i in range(25)}
    asks = {i: rng.normal(size=(rng.integers(1, 5), 4)) for i in range(9)}
    table = lambda sets, names: spark.createDataFrame([(i, p, v.tolist()) for i, m in sets.items() for p, v in enumerate(m)], names)
    index = late_interaction.TokenIndex.build(table(docs, "doc_id long, place long, v array<double>"), stored.new_path(spark, "tokens"), lists=3)
    found = index.search(table(asks, "query_id long, place long, q array<double>"), 4)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = set()
    for q, a in asks.items():
        scores = sorted((-round(float((unit(a) @ unit(m).T).max(axis=1).sum()), 6), i) for i, m in docs.items())
        want |= {(q, i, -s, r) for r, (s, i) in enumerate(scores[:4], 1)}
    assert {(r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in found.collect()} == want
    if long > 20:
        assert "CoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no row for each pair


def test_python_sees_a_batch_in_slices(spark, monkeypatch):
    seen = []
    made = parallel.sliced(lambda a: (seen.append(len(a)), pa.array(a.to_pylist(), pa.int64()))[1], 4)(pa.array(range(10)))
    assert made.to_pylist() == list(range(10)) and seen == [4, 4, 2]
    assert parallel.sliced(lambda a: a, 4)(pa.array([], pa.int64())).to_pylist() == []

    texts = pd.Series([f"beam load {i}" for i in range(600)] + ["", None])
    embed = models.hashing_embedder(8)
    assert embed(texts) == [v for i in range(len(texts)) for v in embed(texts.iloc[i : i + 1])] and embed(texts.iloc[:0]) == []
    sizes, lower = [], models.pc.utf8_lower
    monkeypatch.setattr(models.pc, "utf8_lower", lambda a: (sizes.append(len(a)), lower(a))[1])
    embed(texts)
    assert max(sizes) <= parallel.SLICE

    docs = spark.createDataFrame([(i, "One. Two. Three.") for i in range(700)], "doc_id long, text string").coalesce(1)
    assert chunking.split(docs, "sentences").count() == 700
