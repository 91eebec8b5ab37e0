"""Stored indexes and stores against plain versions."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from textloom.operators import keyed_store, late_interaction, postings, trigrams, vector_index
from textloom.operators import vectors as O
from textloom.plans import index_queries
from textloom.sources import stored

# --- vectors in lists -----------------------------------------------------------------


@pytest.fixture(scope="module")
def index(spark):
    return vector_index.IvfIndex.build(spark.read.parquet(f"{SMALL}/embeddings.parquet"), stored.new_path(spark, "ivf"), payload=("label",), lists=12)


def asks(spark):
    return spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))


def pairs(rows):
    return {(r["query_id"], r["id"]) for r in rows}


def test_every_vector_is_in_one_list(spark, index):
    rows = index.lists().collect()
    assert sorted(r["id"] for r in rows) == sorted(r["vec_id"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect())
    numbers, unit = index.centroids()
    for r in rows:
        assert numbers[np.argmax(unit @ np.array(r["v"]))] == r["list"]


def test_probing_fewer_lists_keeps_the_recall_it_was_set_to(spark, index):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    exact = pairs(O.batch_top_k(asks(spark), vectors, 10).collect())
    assert pairs(index.search(asks(spark), 10).collect()) == exact
    probes = index.probes_for(0.95)
    assert 1 <= probes <= 12
    assert len(exact & pairs(index.search(asks(spark), 10, probes=probes).collect())) / len(exact) >= 0.9
    one = index.search(asks(spark), 10, probes=1)
    assert len(pairs(one.collect()) & exact) < len(exact)


def test_only_probed_lists_are_read(spark, index):
    one = asks(spark).limit(1)
    plan = index._scored(stored.stored(index.probed(one, 1), "probed"), 5, F.col("label") == 3, False, 4096)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(list#\d+L?\), \(?list#\d+L? = \d+", plan) or re.search(r"PartitionFilters: \[.*list#\d+ (IN|=)", plan), plan
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan


def test_a_filter_that_few_rows_pass_finds_them_all(spark, index):
    near = index.search(asks(spark), 60, probes=1, where=F.col("label") == 1).groupBy("query_id").count().collect()
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    ones = sum(x == 1 for x in labels.values())
    assert {r["count"] for r in near} <= {min(60, ones), min(60, ones - 1)}


def test_added_vectors_are_found_and_unusable_ones_skipped(spark):
    rows = [(i, [float(i % 3 == j) + 0.01 * i for j in range(3)], i % 2) for i in range(30)] + [(90, None, 0), (91, [0.0, 0.0, 0.0], 0), (92, [1.0, None, 1.0], 0), (93, [1.0, float("nan"), 1.0], 0)]
    schema = "vec_id long, embedding array<float>, label int"
    small = vector_index.IvfIndex.build(spark.createDataFrame(rows, schema), stored.new_path(spark, "ivf"), payload=("label",), lists=3)
    assert small.lists().count() == 30
    small.add(spark.createDataFrame([(500, [9.0, 0.0, 0.0], 7)], schema))
    asked = spark.createDataFrame([(1000, [1.0, 0.0, 0.0]), (1001, None)], "query_id long, q array<float>")
    assert sorted((r["query_id"], r["id"], r["score"]) for r in small.search(asked, 2).collect()) == [(1000, 0, 1.0), (1000, 500, 1.0)]
    assert small.search(asked, 5, where=F.col("label") == 7).count() == 1
    none = vector_index.IvfIndex.build(spark.createDataFrame([], schema), stored.new_path(spark, "ivf"))
    assert none.search(asked, 3).count() == 0


def test_a_hot_list_is_searched_in_blocks(spark):
    rows = [(i, [1.0, 0.001 * i]) for i in range(400)] + [(1000 + i, [-1.0, 0.01 * i]) for i in range(10)]
    index = vector_index.IvfIndex.build(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), stored.new_path(spark, "ivf"), lists=2)
    asked = spark.createDataFrame([(i, [1.0, 0.001 * i]) for i in range(0, 400, 7)], "query_id long, q array<double>")
    assert pairs(index.search(asked, 4, block=50).collect()) == pairs(index.search(asked, 4).collect())


# --- postings -------------------------------------------------------------------------


def plain_covers(places):
    """All stretches with every term that hold no shorter one."""
    marks = sorted({p for ps in places for p in ps})
    whole = [(a, b) for a, b in itertools.product(marks, marks) if a <= b and all(any(a <= p <= b for p in ps) for ps in places)]
    minimal = [(a, b) for a, b in whole if not any((c, d) != (a, b) and a <= c and d <= b for c, d in whole)]
    return sum(0.1 / (1 + (b - a) - (sum(a <= p <= b for ps in places for p in ps) - 1)) for a, b in minimal)


@settings(max_examples=300, deadline=None)
@given(st.data())
def test_cover_weights(data):
    marks = data.draw(st.lists(st.integers(0, 25), min_size=1, max_size=14, unique=True))
    kinds = data.draw(st.integers(1, min(4, len(marks))))
    places = [sorted(m for i, m in enumerate(marks) if i % kinds == k) for k in range(kinds)]
    assert postings.cover_weights(places) == pytest.approx(plain_covers(places))


def test_postings_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "beam load beam"), (2, None), (3, ""), (None, "beam"), (4, "load a a a beam"), (5, "word " * 30_000 + "beam load")], "doc_id long, text string")
    index = postings.Postings.write(docs, stored.new_path(spark, "postings"), buckets=4)
    assert index.stats().first()["n"] == 5
    asked = spark.createDataFrame([(1, "load beam"), (2, "beam missing"), (3, ""), (4, None)], "query_id long, query string")
    got = [(r["query_id"], r["doc_id"], r["score"]) for r in index.cover_density(asked).orderBy("rank").collect()]
    assert got == [(1, 1, 0.2), (1, 5, 0.1), (1, 4, 0.025)]
    assert index.cover_density(asked, k=1, normalised=True).first()["score"] == pytest.approx(0.2 / 1.2)
    assert {r["doc_id"] for r in index.bm25(asked, None).collect()} == {1, 4, 5}


# --- trigrams -------------------------------------------------------------------------


def gram_set(word, n=3):
    padded = " " * (n - 1) + word.lower() + " "
    return {padded[i : i + n] for i in range(len(padded) - n + 1)} if word else set()


@pytest.mark.parametrize(("least", "most"), [(0.3, 10**5), (0.5, 10**5), (0.8, 10**5), (1.0, 10**5), (0.3, 5), (0.8, 5)])
def test_similar_words(spark, least, most, monkeypatch):
    monkeypatch.setattr(trigrams, "MOST_GRAMS", most)
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)] + ["É", "éa", "Abc", "a" * 3000]
    left, right = words[:60] + [None, ""], words[50:] + ["abc", None, ""]
    got = trigrams.similar(spark.createDataFrame([(w,) for w in left], "a string"), spark.createDataFrame([(w,) for w in right], "b string"), least).collect()
    want = {}
    for a, b in itertools.product({w for w in left if w}, {w for w in right if w}):
        x, y = gram_set(a), gram_set(b)
        if len(x & y) / len(x | y) >= least - 1e-12:
            want[a, b] = round(len(x & y) / len(x | y), 9)
    assert {(r["a"], r["b"]): r["similarity"] for r in got} == want and len(got) == len(want)


# --- a store with a key ---------------------------------------------------------------

SCHEMA = "id long, v long, text string"


@pytest.fixture
def store(spark):
    return keyed_store.KeyedStore.create(spark, stored.new_path(spark, "store"), SCHEMA, "id", "v", buckets=8)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def held(store, version=None):
    return {r["id"]: (r["v"], r["text"]) for r in store.read(version).collect()}


def test_store_against_a_dictionary(spark, store):
    rng, want, gone = random.Random(9), {}, {}
    for turn in range(4):
        rows = [(rng.randint(0, 40), rng.randint(0, 30), f"{turn}-{i}") for i in range(25)]
        if turn % 2:
            newest = {}
            for i, v, _ in rows:
                newest[i] = max(v, newest.get(i, -1))
            store.delete(frame(spark, [(i, v, None) for i, v in newest.items()]))
            for i, v in newest.items():
                if v >= max(want.get(i, (-1,))[0], gone.get(i, -1)):
                    want.pop(i, None)
                    gone[i] = v
        else:
            rows = [r for k, r in enumerate(rows) if r[:2] not in [x[:2] for x in rows[:k]]]  # equally new rows of a key: see below
            store.upsert(frame(spark, rows))
            for i, v, text in rows:
                if v >= max(want.get(i, (-1,))[0], gone.get(i, -1)):
                    want[i] = (v, text)
                    gone.pop(i, None)
        assert held(store) == want
    assert store.version() == 4 and len(held(store, 1)) > 0 and store.vacuum() >= 0 and held(store) == want


def test_untouched_buckets_keep_their_files(spark, store):
    store.upsert(frame(spark, [(i, 1, "a") for i in range(100)]))
    before = store.manifest()
    done = store.upsert(frame(spark, [(5, 2, "b"), (None, 1, "no key")]))
    after = store.manifest()
    assert done["upserted"] == 1 and done["skipped"] == 1 and len(done["buckets"]) == 1
    assert {b for b in before if before[b] != after[b]} == set(done["buckets"]) and held(store)[5] == (2, "b") and held(store, 1)[5] == (1, "a")
    info = {r["bucket"]: r["rows"] for r in store.info().collect()}
    assert sum(info.values()) == 100 and set(info) == set(after)


def test_an_older_row_does_not_undo_a_delete(spark, store):
    store.upsert(frame(spark, [(1, 5, "a"), (2, 5, "b")]))
    store.delete(frame(spark, [(1, 6, None), (2, 4, None), (3, 9, None)]))
    store.upsert(frame(spark, [(1, 5, "late"), (3, 8, "late"), (3, 9, "same age")]))
    assert held(store) == {2: (5, "b"), 3: (9, "same age")}
    assert store.upsert(frame(spark, [])) == {"version": 3, "upserted": 0, "deleted": 0, "skipped": 0, "buckets": []}


def test_lookup_and_pages(spark, store):
    store.upsert(frame(spark, [(i, 1, str(i)) for i in range(0, 60, 2)]))
    found = store.get(spark.createDataFrame([(4,), (4,), (5,), (None,)], "id long"))
    assert [r["id"] for r in found.collect()] == [4]
    seen, after = [], None
    while True:
        page, after = store.scroll(after, 7)
        seen += [r["id"] for r in page.orderBy("id").collect()]
        if after is None:
            break
    assert seen == list(range(0, 60, 2))


def test_failed_batches_and_conflicts_are_reported(spark, store, monkeypatch):
    broken = frame(spark, [(1, 1, "x")]).withColumn("text", F.raise_error(F.lit("broken batch")).cast("string"))
    report = {r["batch"]: r for r in store.apply([("good", frame(spark, [(1, 1, "x")])), ("bad", broken), ("last", frame(spark, [(2, 1, "y")]))], attempts=2).collect()}
    assert report["good"]["error"] is None and report["bad"]["attempts"] == 2 and "broken batch" in report["bad"]["error"] and report["last"]["version"] == 2
    assert held(store) == {1: (1, "x"), 2: (1, "y")}
    monkeypatch.setattr(keyed_store.KeyedStore, "version", lambda self: 1)  # as if the second version had come meanwhile
    with pytest.raises(keyed_store.Conflict):
        store.upsert(frame(spark, [(9, 1, "z")]))
    monkeypatch.undo()
    assert held(store) == {1: (1, "x"), 2: (1, "y")}
    with pytest.raises(FileExistsError):
        keyed_store.KeyedStore.create(spark, store.path, SCHEMA, "id", "v")
    assert keyed_store.KeyedStore.exists(spark, store.path) and not keyed_store.KeyedStore.exists(spark, store.path + "x")


def test_probed_query(spark):
    exact, near = (pairs(index_queries.QUERIES[q](spark, SMALL).collect()) for q in ("ivf_all_lists", "ivf_probed"))
    assert len(exact & near) / len(exact) >= 0.9


# --- late interaction -----------------------------------------------------------------


def test_late_interaction_below_full_probing(spark):
    exact, near = (index_queries.QUERIES[q](spark, SMALL).select("query_id", F.col("doc_id").alias("id")).collect() for q in ("late_interaction", "late_interaction_probed"))
    exact, near = pairs(exact), pairs(near)
    assert len(exact & near) / len(exact) >= 0.9


def test_late_interaction_of_long_and_odd_documents(spark):
    rng = np.random.default_rng(8)
    texts = {1: rng.normal(size=(300, 5)), 2: rng.normal(size=(1, 5)), 3: rng.normal(size=(140, 5)), 4: np.repeat(rng.normal(size=(1, 5)), 3, axis=0)}
    rows = [(d, i, v.tolist()) for d, m in texts.items() for i, v in enumerate(m)] + [(5, 0, None), (6, 0, [0.0] * 5), (3, 900, None)]
    index = late_interaction.TokenIndex.build(spark.createDataFrame(rows, "doc_id long, place long, v array<double>"), stored.new_path(spark, "tokens"), lists=4)
    asked = {10: rng.normal(size=(3, 5)), 11: rng.normal(size=(1, 5))}
    queries = spark.createDataFrame([(q, i, v.tolist()) for q, m in asked.items() for i, v in enumerate(m)] + [(11, 5, [0.0] * 5), (12, 0, None)], "query_id long, place long, q array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = {(q, d): round(float((unit(m) @ unit(t).T).max(axis=1).sum()), 6) for q, m in asked.items() for d, t in texts.items()}
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in index.search(queries, 10).collect()}
    assert got == {k: pytest.approx(v, abs=2e-6) for k, v in want.items()}
    assert index.search(queries, 1, probes=2, nearest=20, depth=2).count() == 2
