"""Places of rows within ordered groups, with no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch

#: Rows of a range; a range, not a group, is what one task sorts.
PER_RANGE = 50_000


def positions(rows: DataFrame, group: str, order: list, scratch: Scratch, position: str = "position", size: str = "n", per_range: int = PER_RANGE) -> DataFrame:
    """Add each row's place from 0 in the order of its group, and the group's number of rows.

    `group` isn't null. Rows are dealt by ranges of (group, order); a last key
    that differs for every row splits rows of equal order too, so neither a
    hot group nor a hot place in it fills a range. Equal rows take different
    places. `rows` should be stored already: it is read twice.
    """
    ranges = max(1, -(-rows.count() // per_range))
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(ranges, group, *order, "_tie")
    dealt = scratch.staged(dealt.withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range", group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(Window.partitionBy(group)).alias(size))
    within = Window.partitionBy("_range", group).orderBy(*order, "_tie")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(starts, ["_range", group])
    return ranked.withColumn(position, F.col("_first") + F.col("_rank")).drop("_range", "_tie", "_first", "_rank")
