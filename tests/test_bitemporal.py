"""Facts with two times against plain loops."""

from __future__ import annotations

import random

import pytest

from textloom.operators import bitemporal

VERSIONS, ASKED = "key string, valid_from long, known_from long, value string", "query_id long, key string, valid_at long, known_at long"


def plain(versions, asked):
    out = {}
    for q, key, valid, known in asked:
        fits = [(v, k, x) for c, v, k, x in versions if None not in (c, v, k, key, valid, known) and c == key and v <= valid and k <= known]
        out[q] = max(fits)[::-1] if fits else (None, None, None)
    return {q: (x, v, k) for q, (x, k, v) in out.items()}


@pytest.mark.parametrize(("seed", "per_block"), [(1, 7), (2, 25), (3, 10_000)])
def test_as_of(spark, seed, per_block):
    """A third of the versions have one key; blocks are so small that keys span many of them."""
    r = random.Random(seed)
    key = lambda: r.choice(["hot", "hot", "a", "b", "c", None])
    versions = [(key(), r.choice([None, *range(30)]), r.choice([None, *range(30)]), str(i)) for i in range(200)] + [("a", 5, 5, "x"), ("a", 5, 5, "y")]
    asked = [(i, key(), r.choice([None, *range(-2, 33)]), r.choice([None, *range(-2, 33)])) for i in range(150)] + [(900, "unknown", 9, 9), (901, "hot", 40, 1)]
    got = bitemporal.as_of(spark.createDataFrame(versions, VERSIONS), spark.createDataFrame(asked, ASKED), per_block=per_block)
    rows = got.collect()
    assert len(rows) == len(asked) and {x["query_id"]: (x["value"], x["valid_from"], x["known_from"]) for x in rows} == plain(versions, asked)


def test_intervals(spark):
    versions = [("a", 1, 10, "first"), ("a", 1, 20, "corrected"), ("a", 5, 15, "next"), ("b", 1, 1, "other"), ("a", 9, 30, "last")]
    got = {r["value"]: (r["valid_to"], r["known_to"]) for r in bitemporal.intervals(spark.createDataFrame(versions, VERSIONS), "key").collect()}
    assert got == {"first": (None, 20), "corrected": (5, None), "next": (9, None), "last": (None, None), "other": (None, None)}


def test_empty(spark):
    none, asked = spark.createDataFrame([], VERSIONS), spark.createDataFrame([(1, "a", 1, 1)], ASKED)
    assert [tuple(r) for r in bitemporal.as_of(none, asked).collect()] == [(1, None, None, None)]
    assert bitemporal.as_of(none, asked.limit(0)).count() == 0
