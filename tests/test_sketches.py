"""Stored sketches within their bounds, and percentiles that are exact."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import monitoring, sketches


def values(kind, n=6000):
    r = random.Random(kind)
    return {"even": [r.random() for _ in range(n)], "one": [7.0] * n, "few": [float(r.choice([1, 2, 2, 2, 9])) for _ in range(n)], "tail": [r.paretovariate(0.6) for _ in range(n)], "signed": [r.gauss(0, 1e9) for _ in range(n)]}[kind]


@pytest.mark.parametrize("kind", ["even", "one", "few", "tail", "signed"])
def test_exact_percentiles(spark, kind):
    xs = values(kind)
    frame = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "v double")
    shares = {"lo": 0.0, "p37": 0.37, "p95": 0.95, "hi": 1.0}
    row = sketches.exact_percentiles(frame, "v", shares, limit=40).first()
    assert [row[k] for k in shares] == pytest.approx([float(np.percentile(xs, 100 * p)) for p in shares.values()], rel=1e-12)


def test_exact_percentiles_by_groups(spark):
    groups = {None: values("even", 900), "hot": values("tail", 5000), "one": [3.0], "none": []}
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("none", None)]
    got = {r["g"]: (r["a"], r["b"]) for r in sketches.exact_percentiles(spark.createDataFrame(rows, "g string, v double"), "v", {"a": 0.25, "b": 0.99}, "g", limit=60).collect()}
    assert got.pop("none") == (None, None)
    assert {g: pytest.approx(v) for g, v in got.items()} == {g: (float(np.percentile(xs, 25)), float(np.percentile(xs, 99))) for g, xs in groups.items() if xs}


def test_empty_percentiles(spark):
    none = spark.createDataFrame([], "latency_ms double, failed boolean, c string")
    assert sketches.exact_percentiles(none, "latency_ms", {"p": 0.5}).first()["p"] is None
    assert sketches.exact_percentiles(none, "latency_ms", {"p": 0.5}, "c").count() == 0
    assert monitoring.trace_stats(none).first()["p95_ms"] is None


def test_merged_hours_keep_their_bounds(spark):
    """Two thousand rows in each of forty hours; ranges of hours against all rows."""
    r = random.Random(5)
    rows = spark.range(80_000).select((F.timestamp_seconds(F.col("id") * 1800 / 1000)).alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(20_000))).alias("user_id"), F.pow(F.rand(3), F.lit(-0.7)).alias("latency_ms"), (F.col("id") % 11 == 0).alias("failed"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), (F.col("id") % 7000).cast("string"))).alias("item"))
    rows = spark.createDataFrame(rows.toPandas())
    hours = sketches.hourly(rows).cache()
    assert hours.count() == 40
    for a, b in [(0, 40), (3, 11), (r.randint(0, 20), 33)]:
        part = rows.where(F.hour("ts") + 24 * (F.dayofmonth("ts") - 1) >= a).where(F.hour("ts") + 24 * (F.dayofmonth("ts") - 1) < b).toPandas()
        m = sketches.merged(hours.where(F.hour("hour") + 24 * (F.dayofmonth("hour") - 1) >= a).where(F.hour("hour") + 24 * (F.dayofmonth("hour") - 1) < b)).first()
        assert m["n"] == len(part) and m["failures"] == part["failed"].sum() and m["mean_ms"] == pytest.approx(part["latency_ms"].mean())
        for column, p in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99)):
            assert abs((part["latency_ms"] <= m[column]).mean() - p) <= sketches.RANK_ERROR
        users = part["user_id"].nunique()
        assert abs(m["users"] - users) <= sketches.DISTINCT_ERROR * users
        items = {i["item"]: i["count"] for i in m["items"]}
        assert items["hot"] == pytest.approx((part["item"] == "hot").sum(), abs=len(part) / sketches.TRACKED + 1)
