"""Very long texts, hot ids and clashing names where the operators' own tests don't have them."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from textloom.llm import exact_dedup, near_dedup, sharding, storage, tokens, wavelet

PATH = tokens.tokenizer_path(tokens.WORD_BPE)
LONG = "A very Long text, " * 250_000


def test_long_texts_are_stored_and_hashed_whole(spark):
    rows = [(1, LONG), (2, LONG.lower()), (3, "short"), (4, LONG[:-1]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("clash"))
    store = sharding.ShardStore(spark, storage.new_path(spark, "shards"), target_bytes=1 << 20)
    store.append(docs)
    store.append(docs)
    store.compact()
    got = store.read().select("doc_id", F.md5("text").alias("m"), F.col("row")).collect()
    assert sorted((str(r["doc_id"]), r["m"], r["row"]) for r in got) == sorted((str(i), t and hashlib.md5(t.encode()).hexdigest(), "clash") for i, t in rows * 2)
    groups = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert groups == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True), 4: (4, 1, True), None: (None, 1, True)}


def test_near_copies_of_long_texts_beside_clashing_names(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(60_000)]
    long = " ".join(words)
    rows = [(1, long), (2, long + " tail"), (3, " ".join(words[::-1])), (4, ""), (5, None), (6, "one two three four five six seven"), (7, "one two three four five six seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "node": F.lit(1), "band": F.lit(2.0), "class_id": F.lit("x"), "digest": F.lit(b"d")})
    found = near_dedup.near_duplicates(docs)
    classes = {}
    for r in found.collect():
        classes.setdefault(r[found.columns[1]] if found.columns[0] == "doc_id" else r[0], set()).add(r["doc_id"])
    together = {frozenset(c) for c in classes.values()}
    assert any({1, 2} <= c for c in together) and any({6, 7} <= c for c in together) and not any({1, 3} <= c for c in together)
    kept = near_dedup.without_near_copies(docs)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert len(ids & {1, 2}) == 1 and len(ids & {6, 7}) == 1 and 3 in ids


@pytest.mark.parametrize("part_bytes", [150, 400])
def test_hot_ids_fill_several_ranges(spark, part_bytes):
    """A third of the rows have one id and a third none; every row is read back, in order of id, and no range holds all of either."""
    from tokenizers import Tokenizer

    rows = [(7, f"hot text {i}") for i in range(120)] + [(None, f"lost {i} words") for i in range(120)] + [(i * 3 % 50, f"text of {i}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    path = wavelet.write_shards(docs, PATH, end_id=1, part_bytes=part_bytes, shard_tokens=64)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.read_documents(spark, path).collect())
    library = Tokenizer.from_file(PATH)
    ids = [library.encode(t, add_special_tokens=False).ids + [1] for _, t in rows]
    want = sorted((str(d), len(x), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))) for (d, _), x in zip(rows, ids))
    assert sorted((str(d), n, c) for _, d, n, c in got) == want
    order = [d for _, d, _, _ in got]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    parts = spark.read.schema(wavelet.SHARD).parquet(path).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    assert len(parts) > 4 and max(r["n"] for r in parts) < 100
