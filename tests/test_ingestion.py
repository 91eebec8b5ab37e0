"""Observed writes, containment in JSON and cached reranking against plain versions."""

from __future__ import annotations

import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import ingestion, keyed_store, models, relational
from textloom.sources import stored

ROWS = [(1, "long enough"), (2, "no"), (3, None), (4, "also long enough")]


def frame(spark, rows=ROWS):
    return spark.createDataFrame(rows, "id long, content string")


def by_batch(report):
    return {r["batch"]: r for r in report.collect()}


def test_counters_are_of_the_write_itself(spark):
    path = stored.new_path(spark, "in")
    broken = frame(spark).withColumn("content", F.when(F.col("id") < 3, F.col("content")).otherwise(F.raise_error(F.lit("cannot parse")).cast("string")))
    batches = [("a", frame(spark)), ("bad", broken), ("empty", frame(spark, []))]
    report = ingestion.ingest_batches(spark, batches, path, valid=F.char_length("content") > 3, attempts=2)
    got = by_batch(report)
    assert (got["a"]["rows"], got["a"]["rejected"], got["a"]["chars"], got["a"]["written"], got["a"]["attempts"], got["a"]["error"]) == (2, 2, 27, 2, 1, None)
    assert "cannot parse" in got["bad"]["error"] and got["bad"]["attempts"] == 2 and got["bad"]["written"] == 0
    assert (got["empty"]["rows"], got["empty"]["written"], got["empty"]["error"]) == (0, 0, None)
    one = ingestion.summary(report).first()
    assert (one["batches"], one["failed_batches"], one["rows"], one["written"], one["verified"]) == (3, 1, 2, 2, True) and one["success_rate"] == 50.0
    assert sorted(r["id"] for r in spark.read.parquet(f"{path}/rows").where("batch = 'a'").collect()) == [1, 4]


def test_a_run_goes_on_where_it_ended(spark, monkeypatch):
    path = stored.new_path(spark, "in")
    broken = frame(spark).withColumn("content", F.raise_error(F.lit("down")).cast("string"))
    first = by_batch(ingestion.ingest_batches(spark, [("a", frame(spark)), ("b", broken)], path, attempts=1))
    assert first["b"]["error"] and first["a"]["written"] == 4
    again = by_batch(ingestion.ingest_batches(spark, [("a", broken), ("b", frame(spark))], path, attempts=1))  # the first batch isn't written again
    assert again["a"]["written"] == 4 and again["a"]["error"] is None and again["b"]["written"] == 4
    assert spark.read.parquet(f"{path}/rows").count() == 8


def plain_contains(held, wanted):
    if isinstance(wanted, dict):
        return isinstance(held, dict) and all(k in held and plain_contains(held[k], v) for k, v in wanted.items())
    if isinstance(wanted, list):
        return isinstance(held, list) and all(any(plain_contains(h, w) for h in held) for w in wanted)
    if isinstance(wanted, bool) or wanted is None or isinstance(held, bool) or held is None:
        return held is wanted
    return type(held) in (int, float) and type(wanted) in (int, float) and held == wanted or isinstance(held, str) and held == wanted


def test_containment_in_json(spark):
    held = [{"k": 7}, {"k": "7"}, {"k": 7.0}, {"k": True}, {"k": "true"}, {"k": None}, {}, [], {"a": [1, "1", {"b": 2, "c": [3, 4]}]}, {"a": {"b": {"c": 1.5}}, "k": 7}, [1, [2, 3]], {"a b": {"x.y": 1}}, {"k": [7]}, "7", 7, None, {"k": -2}, {"k": 1e300}, {"a": []}]
    wanted = [{"k": 7}, {"k": "7"}, {"k": True}, {"k": "true"}, {"k": None}, {}, {"a": [1]}, {"a": ["1", {"c": [4]}]}, {"a": {"b": {}}}, {"a": {"b": {"c": 1.5}}}, {"a b": {"x.y": 1}}, {"a": []}, [[3]], [1], {"k": -2}, {"k": 1e300}, 7, "7"]
    rows = spark.createDataFrame([(i, json.dumps(h)) for i, h in enumerate(held)] + [(90, None), (91, "no json {")], "i int, j string")
    got = rows.select("i", *(relational.contains_json(F.col("j"), w).alias(f"w{n}") for n, w in enumerate(wanted))).collect()
    for r in got:
        for n, w in enumerate(wanted):
            assert r[f"w{n}"] == (r["i"] < 90 and plain_contains(held[r["i"]], w)), (held[r["i"]] if r["i"] < 90 else None, w)


def test_reranked_lists_come_from_the_store(spark):
    rng = np.random.default_rng(3)
    vectors = {i: rng.normal(size=4).tolist() for i in range(30)}
    rows = [(q, f"query {q % 3}", d, vectors[q % 3], vectors[d]) for q in range(6) for d in range(10 + q % 3, 20)]
    schema = "query_id long, query string, doc_id long, q array<double>, v array<double>"
    cache = keyed_store.KeyedStore.create(spark, stored.new_path(spark, "cache"), models.RERANKED, "cache_key", "used", buckets=4)
    want = {(r["query_id"], r["rank"]): r["doc_id"] for r in models.rerank(spark.createDataFrame(rows, schema), 4).collect()}
    first = models.rerank_cached(spark.createDataFrame(rows[:20], schema), cache, 4, 1).collect()
    assert not any(r["cached"] for r in first) and all(want[r["query_id"], r["rank"]] == r["doc_id"] for r in first if r["query_id"] == 0)
    own = [r for r in rows if r[0] in (0, 4, 5)]
    second = models.rerank_cached(spark.createDataFrame(own, schema), cache, 4, 2).collect()
    assert {r["query_id"] for r in second if r["cached"]} == {0, 4} and {(r["query_id"], r["rank"]): r["doc_id"] for r in second} == {k: v for k, v in want.items() if k[0] in (0, 4, 5)}
    shuffled = models.rerank_cached(spark.createDataFrame(own[::-1], schema), cache, 4, 3).collect()
    assert all(r["cached"] for r in shuffled) and len(shuffled) == 12


def test_cache_key_ignores_the_order_of_candidates(spark):
    rows = spark.createDataFrame([(list(p),) for p in itertools.permutations([3, 1, 20])] + [([3, 1],)], "ids array<long>")
    assert rows.select(models.cache_key(F.lit("q"), F.col("ids"))).distinct().count() == 2


@pytest.mark.parametrize("bad", [None, "no json"])
def test_nothing_is_in_no_json(spark, bad):
    assert spark.createDataFrame([(bad,)], "j string").select(relational.contains_json(F.col("j"), {}).alias("c")).first()["c"] is False
