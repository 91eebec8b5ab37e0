"""A small sieve in front of joins of whole texts with few keys.

A join of texts with the keys of a few of them would shuffle every text. The
sieve is a table of at most WORDS rows, whatever the number of keys, so it can
be broadcast; only rows it lets through need the join. It lets every wanted
row through and some others, all of them where the keys fill it, so results
don't depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the table at most; each has the bits of 64 of its 2**25 places.
WORDS = 1 << 19


def row_key(*columns):
    """A 64-bit key of some columns; nulls count."""
    return F.xxhash64(*columns)


def sifted(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """`rows` with a boolean column `_may`: false where `key`, a long, isn't among those of `keys`."""
    place = F.pmod(F.xxhash64(F.col(key), F.lit(17)), F.lit(WORDS * 64))
    word, bit = F.shiftright(place, 6), F.expr("shiftleft(1L, cast(_place & 63 as int))")
    bits = keys.select(place.alias("_place")).select(F.shiftright("_place", 6).alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    out = rows.withColumn("_place", place).withColumn("_word", word).join(F.broadcast(bits), "_word", "left")
    return out.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("_word", "_place", "_bits")


def without(docs: DataFrame, gone: DataFrame, text: str) -> DataFrame:
    """The rows of `docs`, columns as they were, whose id and text aren't among `gone` (row_key, _id).

    Columns of `docs` may have any names. Only rows that the sieve can't tell
    apart from those of `gone` are shuffled.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*names)
    given = dict(zip(docs.columns, names, strict=True))
    rows = rows.withColumn("row_key", row_key(F.col(given["doc_id"]).cast("long"), F.col(given[text])))
    rows = sifted(rows, gone, "row_key")
    same = (F.col("row_key") == F.col("_key")) & F.col(given["doc_id"]).cast("long").eqNullSafe(F.col("_id"))
    judged = rows.where("_may").join(gone.select(F.col("row_key").alias("_key"), "_id"), same, "left_anti")
    return rows.where("NOT _may").unionByName(judged).select(*names).toDF(*docs.columns)
