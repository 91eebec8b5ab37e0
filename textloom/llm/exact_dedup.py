"""Exact deduplication through a minimal perfect hash over historical digests (operator 7).

The index of the history is a table of blocks, one per range of digests. A
block numbers its n distinct digests 0..n-1 without gaps by a cascade of
collision-free bitmaps and keeps, in the slot of that number, the full digest,
the locator of the winner and the number of rows. A digest that isn't in the
history also lands in some slot; comparing all 32 bytes there tells it apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sift
from .storage import staged

INDEX = "block int, levels array<binary>, digests binary, winners binary, sizes binary"
#: Spreads the digest's first word differently at each level of the cascade.
_LEVEL = np.uint64(0x9E3779B97F4A7C15)


def text_digests(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the text in UTF-8 after lower-casing A-Z only; null counts as empty."""

    def digests(batches):
        for batch in batches:
            raw = batch["_text"].to_pylist()
            found = [hashlib.sha256((t or b"").lower()).digest() for t in raw]  # bytes.lower() changes A-Z only
            yield pa.record_batch([batch["doc_id"], pa.array(found, pa.binary())], ["doc_id", "digest"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).cast("binary").alias("_text")).mapInArrow(digests, "doc_id long, digest binary")


# --- the hash -------------------------------------------------------------------------


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = digests.view("<u8").reshape(-1, 4)
    return words[:, 1].copy(), words[:, 2] | np.uint64(1)


def _places(a: np.ndarray, b: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (a + b * np.uint64(level + 1)) * _LEVEL
    mixed ^= mixed >> np.uint64(32)
    return (mixed % np.uint64(bits)).astype(np.int64)


def build_hash(digests: np.ndarray, gamma: float = 2.0) -> list[bytes]:
    """Bitmaps of the cascade for distinct 32-byte digests (n x 32 uint8).

    At each level a key whose place nobody else wants sets that bit; keys that
    collide go on to the next level. The number of a key is the rank of its bit
    over all levels, so the n keys get exactly the numbers 0..n-1.
    """
    a, b = _words(digests)
    levels = []
    while len(a):
        bits = 8 * max(1, int(np.ceil(gamma * len(a) / 8)))
        at = _places(a, b, len(levels), bits)
        alone = np.bincount(at, minlength=bits) == 1
        levels.append(np.packbits(alone).tobytes())
        again = ~alone[at]
        a, b = a[again], b[again]
    return levels


def look_up(levels: list[bytes], digests: np.ndarray) -> np.ndarray:
    """The number of each digest; one that isn't in the set gets any number, or -1."""
    a, b = _words(digests)
    slot = np.full(len(a), -1, np.int64)
    todo, base = np.arange(len(a)), 0
    for level, raw in enumerate(levels):
        bitmap = np.unpackbits(np.frombuffer(raw, np.uint8))
        rank = np.cumsum(bitmap, dtype=np.int64)
        at = _places(a[todo], b[todo], level, len(bitmap))
        hit = bitmap[at] == 1
        slot[todo[hit]] = base + rank[at[hit]] - 1
        todo, base = todo[~hit], base + int(rank[-1])
    return slot


def _matrix(values) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, 32)


def _block(digest: str, blocks: int):
    """Digests are uniform, so blocks of them are even however often each occurs."""
    return F.pmod(F.conv(F.hex(F.substring(digest, 1, 6)), 16, 10).cast("long"), F.lit(blocks)).cast("int").alias("block")


def build_index(history: DataFrame, blocks: int) -> DataFrame:
    """The index table from distinct `digest, winner, size` rows."""

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        digests = _matrix(pdf["digest"])
        levels = build_hash(digests)
        order = np.argsort(look_up(levels, digests))
        known = pdf["winner"].notna().to_numpy()[order]
        winners = pdf["winner"].fillna(0).to_numpy(np.int64)[order]
        winners = np.stack([winners, known.astype(np.int64)], 1)
        return pd.DataFrame([{"block": key[0], "levels": levels, "digests": digests[order].tobytes(), "winners": winners.tobytes(), "sizes": pdf["size"].to_numpy(np.int64)[order].tobytes()}])

    keyed = history.select(_block("digest", blocks), "digest", "winner", "size")
    return staged(keyed.groupBy("block").applyInPandas(one, INDEX), "digest-index")


def merge(index: DataFrame, arrivals: DataFrame, blocks: int) -> DataFrame:
    """Look distinct arrivals up and merge them into the slots they belong to.

    Returns `digest, keep_id, group_size, known` with a row for each digest of
    either side: a slot's winner is the larger of its own and the arrivals';
    digests that no slot holds are groups of their own.
    """

    def one(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        new = _matrix(right["digest"])
        winner, size = right["winner"].astype("Int64").array, right["size"].to_numpy(np.int64)
        parts = []
        fresh = np.ones(len(new), bool)
        if len(left):
            row = left.iloc[0]
            digests = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
            both = np.frombuffer(row["winners"], np.int64).reshape(-1, 2)
            best = pd.Series(both[:, 0]).astype("Int64").where(both[:, 1] == 1)
            sizes = np.frombuffer(row["sizes"], np.int64).copy()
            if len(new):
                slot = look_up(list(row["levels"]), new)
                fresh = (slot < 0) | (digests[slot] != new).any(axis=1)
                hit = ~fresh
                np.add.at(sizes, slot[hit], size[hit])
                mine = pd.Series(winner[hit])
                best.iloc[slot[hit]] = pd.concat([best.iloc[slot[hit]].reset_index(drop=True), mine], axis=1).max(axis=1).astype("Int64").array
            parts.append(pd.DataFrame({"digest": [d.tobytes() for d in digests], "keep_id": best, "group_size": sizes, "known": True}))
        if fresh.any():
            parts.append(pd.DataFrame({"digest": [d.tobytes() for d in new[fresh]], "keep_id": pd.Series(winner[fresh]), "group_size": size[fresh], "known": False}))
        return pd.concat(parts, ignore_index=True)

    keyed = arrivals.select(_block("digest", blocks), "digest", "winner", "size")
    return index.groupBy("block").cogroup(keyed.groupBy("block")).applyInPandas(one, "digest binary, keep_id long, group_size long, known boolean")


def exact_duplicates(docs: DataFrame, is_history=None, text: str = "text", per_block: int = 32768) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, known.

    `is_history` is a condition on doc_id that tells the rows already indexed
    from the arrivals; by default the lower half of the id range. The result
    doesn't depend on it, but for `known`: whether the history has the text.

    Texts are equal when identical after lower-casing A-Z; null is empty. Of
    equal texts the largest doc_id stays; if all are null, keep_id is null and
    one of them stays. Of rows that repeat both id and text one is kept. Rows
    are counted per (digest, doc_id) and per digest before any shuffle, so
    copies, however many, travel as one row per task. Texts of any length are
    hashed whole; other columns, whatever their names, aren't read; an empty
    table has no rows.
    """
    keys = staged(text_digests(docs, text).groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")
    if is_history is None:
        ends = keys.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
        is_history = F.col("doc_id") < F.lit(((ends["a"] or 0) + (ends["b"] or 0)) // 2)
    old = F.coalesce(is_history, F.lit(False))

    def groups(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.sum("n").alias("size"))

    history = groups(keys.where(old))
    blocks = max(1, -(-keys.where(old).count() // per_block))
    found = staged(merge(build_index(history, blocks), groups(keys.where(~old)), blocks), "groups")
    rows = _with_groups(keys, found)
    copy = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy")
    return rows.select("doc_id", "keep_id", "group_size", "digest", "known", copy).select(
        "doc_id", "keep_id", "group_size", ((F.col("copy") == 1) & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"), "known"
    )


def _with_groups(keys: DataFrame, found: DataFrame, large: int = 4096, salts: int = 64) -> DataFrame:
    """Rows of keys with those of their digest; the rows of a large group are dealt to `salts` places.

    A sieve tells which digests may be large on either side alike.
    """
    often = found.where(F.col("group_size") > large).select(F.xxhash64("digest").alias("_key"))
    left, right = (sift.sifted(df.withColumn("_key", F.xxhash64("digest")), often, "_key").drop("_key") for df in (keys, found))
    few = left.where("NOT _may").drop("_may").join(right.where("NOT _may").drop("_may"), "digest")
    salted = left.where("_may").drop("_may").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    copies = right.where("_may").drop("_may").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return few.unionByName(salted.join(copies, ["digest", "_salt"]).drop("_salt"))


def without_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their columns as they were, whatever their names.

    Null and empty texts are equal. Repeated rows of the same id and text leave
    one, the first by a hash of all columns. Texts of rows that go,
    or that repeat an id and a text, travel; others don't.
    """
    found = exact_duplicates(docs, text=text)
    one = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
    names = [f"c{i}" for i in range(len(docs.columns))]
    given = dict(zip(docs.columns, names, strict=True))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sha = F.sha2(F.translate(F.coalesce(F.col(given[text]), F.lit("")), letters, letters.lower()), 256)
    touched = staged(one.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), "kept", sift.row_key("doc_id", "text_sha256").alias("row_key")), "copies")
    rows = docs.toDF(*names).withColumn("_doc", F.col(given["doc_id"]).cast("long")).withColumn("_sha256", sha)
    rows = sift.sifted(rows.withColumn("row_key", sift.row_key("_doc", "_sha256")), touched, "row_key")
    same = (F.col("_sha256") == F.col("_sha")) & F.col("_doc").eqNullSafe(F.col("_id"))
    judged = rows.where("_may").join(touched.drop("row_key"), same, "left").where("kept IS NULL OR kept")
    order = Window.partitionBy("_doc", "_sha256").orderBy(F.xxhash64(*names))
    judged = judged.withColumn("_copy", F.row_number().over(order)).where("_copy = 1")
    return rows.where("NOT _may").select(*names).unionByName(judged.select(*names)).toDF(*docs.columns)
