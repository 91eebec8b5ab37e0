"""Facts with two times: since when something holds, and since when it is known.

A version says that from `valid_from` on a key has a value, and is known from
`known_from` on. A later version with the same valid_from corrects it; one with
a later valid_from follows it. What was known at a time about a time is the
version with the greatest valid_from up to the one, of these the last that was
known at the other.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import stored as S

#: Rows of a block, versions and questions together; a block, not a key, is what one task holds.
PER_BLOCK = 20_000

_ROW = "query_id long, key string, at long, known long, value string, block int"


def intervals(versions: DataFrame, *keys: str) -> DataFrame:
    """Versions with known_to, when the correction of the same valid_from came (null if none did), and valid_to, when the next one that is known today begins; corrected versions have no valid_to."""
    same = Window.partitionBy(*keys, "valid_from").orderBy("known_from")
    out = versions.withColumn("known_to", F.lead("known_from").over(same))
    live = out.where("known_to IS NULL").withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy(*keys).orderBy("valid_from")))
    return live.unionByName(out.where("known_to IS NOT NULL").withColumn("valid_to", F.lit(None).cast(out.schema["valid_from"].dataType)))


def _answers(group: pa.Table) -> pa.Table:
    """Each question of a block with the last version before it that was known, if there is one here."""
    rows = group.sort_by([("key", "ascending"), ("at", "ascending"), ("known", "ascending")]).to_pylist()
    facts: dict[str, tuple[list[int], list[dict]]] = {}
    for r in rows:
        if r["query_id"] is None:
            times, held = facts.setdefault(r["key"], ([], []))
            times.append(r["at"])
            held.append(r)
    out = []
    for r in rows:
        if r["query_id"] is not None:
            times, held = facts.get(r["key"], ([], []))
            i = bisect_right(times, r["at"]) - 1
            while i >= 0 and held[i]["known"] > r["known"]:
                i -= 1
            hit = held[i] if i >= 0 else {}
            out.append((r["query_id"], r["key"], r["at"], r["known"], hit.get("value"), hit.get("at"), hit.get("known"), r["block"]))
    names = ["query_id", "key", "at", "known_at", "value", "valid_from", "known_from", "block"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
    return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)


_ANSWER = "query_id long, key string, at long, known_at long, value string, valid_from long, known_from long, block int"


def as_of(versions: DataFrame, asked: DataFrame, per_block: int = PER_BLOCK) -> DataFrame:
    """query_id, value, valid_from, known_from of what was known at `known_at` about `valid_at`; nulls where nothing was.

    `versions` are (key string, valid_from, known_from: longs, say
    microseconds, value), `asked` (query_id, key, valid_at, known_at). Both are
    put in one order of (key, time) and cut into blocks; a block answers its
    questions from the versions in it. The few that it can't, since their
    versions are in blocks before or weren't known yet, go to the last block of
    their key before it that has a version known in time, so no version is
    paired with a question outside of two blocks. Versions with a null key or
    time take no part; of versions equal in all of these the greatest value counts.
    """
    facts = versions.where("key IS NOT NULL AND valid_from IS NOT NULL AND known_from IS NOT NULL").groupBy("key", "valid_from", "known_from").agg(F.max("value").alias("value"))
    questions = asked.select(F.col("query_id").cast("long").alias("query_id"), "key", F.col("valid_at").cast("long").alias("at"), F.col("known_at").cast("long").alias("known"), F.lit(None).cast("string").alias("value"), F.lit(1).alias("kind"))
    rows = facts.select(F.lit(None).cast("long").alias("query_id"), "key", F.col("valid_from").cast("long").alias("at"), F.col("known_from").cast("long").alias("known"), "value", F.lit(0).alias("kind"))
    good = questions.where("key IS NOT NULL AND at IS NOT NULL AND known IS NOT NULL")
    rows = S.stored(rows.unionByName(good), "timeline")
    blocks = max(1, -(-rows.count() // per_block))
    dealt = rows.repartitionByRange(blocks, "key", "at", "kind", "known", F.xxhash64("query_id")).withColumn("block", F.spark_partition_id())
    dealt = S.stored(dealt.select(*(c.split()[0] for c in _ROW.split(", "))), "timeline-blocks")
    first = S.stored(dealt.groupBy("block").applyInArrow(_answers, _ANSWER), "answers")
    known = dealt.where("query_id IS NULL").groupBy("key", F.col("block").alias("_block")).agg(F.min("known").alias("_known"))
    left = first.where("valid_from IS NULL")
    again = left.join(known, "key").where("_block < block AND _known <= known_at").groupBy("query_id", "key", "at", "known_at").agg(F.max("_block").alias("block"))
    again = S.stored(again, "asked-again")
    out = first.where("valid_from IS NOT NULL").select("query_id", "value", "valid_from", "known_from")
    if not again.isEmpty():
        more = again.select("query_id", "key", "at", F.col("known_at").alias("known"), F.lit(None).cast("string").alias("value"), "block")
        held = dealt.where("query_id IS NULL").join(again.select("block", "key").distinct(), ["block", "key"], "left_semi").select(*more.columns)
        out = out.unionByName(held.unionByName(more).groupBy("block").applyInArrow(_answers, _ANSWER).select("query_id", "value", "valid_from", "known_from"))
    return asked.select(F.col("query_id").cast("long").alias("query_id")).join(out, "query_id", "left")
