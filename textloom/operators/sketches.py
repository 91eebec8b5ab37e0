"""Sketches that are stored by hour and merged for any range, and exact percentiles found by narrowing.

A row of the table is an hour of a component: counts and sums, a quantile
sketch of its latencies, a distinct sketch of its users, and the frequent
event names. Ranges and groups of hours are answered from those rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import stored
from .parallel import MOST_BROADCAST

#: Size of the quantile sketch, and how far a rank from it may be off (99 % of the time), as a share of all rows.
KLL_K, RANK_ERROR = 400, 0.0070
#: Ranks at which a narrowing pass asks a sketch for values.
GRID = 512
#: Size of the distinct sketch (2**12 registers), and three of its standard errors.
HLL_LG_K, DISTINCT_ERROR = 12, 0.05
#: Items that the frequent-item sketch tracks; an item of more than 1/TRACKED of all rows is among them.
TRACKED = 1000


def hourly(traces: DataFrame, *by: str, ts: str = "ts", value: str = "latency_ms", user: str = "user_id", item: str = "item") -> DataFrame:
    """A row per hour and group: n, failures, total, squares and three sketches. Null values, users and items aren't in the sketches."""
    v = F.col(value).cast("double")
    return traces.groupBy(F.date_trunc("hour", F.col(ts)).alias("hour"), *by).agg(
        F.count("*").alias("n"), F.count(v).alias("n_values"), F.count_if("failed").alias("failures"), F.sum(v).alias("total"), F.sum(v * v).alias("squares"),
        F.kll_sketch_agg_double(v, F.lit(KLL_K)).alias("quantiles"), F.hll_sketch_agg(user, F.lit(HLL_LG_K)).alias("users"), F.expr(f"approx_top_k_accumulate(cast({item} as string), {TRACKED})").alias("items"),
    )


def merged(hours: DataFrame, *by, top: int = 5) -> DataFrame:
    """Statistics of groups of stored hours: n, failures, mean, deviation, p50_ms, p95_ms, p99_ms, users, and the `top` items with their counts."""
    mean = F.try_divide(F.sum("total"), F.sum("n_values"))
    sums = hours.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("failures").alias("failures"), mean.alias("mean_ms"), F.sqrt(F.greatest(F.try_divide(F.sum("squares"), F.sum("n_values")) - mean * mean, F.lit(0.0))).alias("std_ms"),
        F.kll_merge_agg_double("quantiles").alias("_q"), F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"), F.expr(f"approx_top_k_estimate(approx_top_k_combine(items, {TRACKED}), {top})").alias("items"),
    )
    quantile = lambda p: F.kll_sketch_get_quantile_double("_q", F.lit(p))
    return sums.withColumns({"p50_ms": quantile(0.5), "p95_ms": quantile(0.95), "p99_ms": quantile(0.99)}).withColumn("sketch", F.col("_q")).drop("_q")


def rank_of(sketch: Column, value: Column) -> Column:
    """The share of rows that are at most `value`, by a quantile sketch."""
    return F.kll_sketch_get_rank_double(sketch, value)


# --- exact percentiles ----------------------------------------------------------------


def exact_percentiles(rows: DataFrame, value: str, shares: dict[str, float], *by: str, limit: int = 100_000) -> DataFrame:
    """Exact percentiles of each group, interpolated between ranks: by..., and a column for each of `shares`.

    No group is gathered. A pass over the rows makes a quantile sketch of each
    group and so a narrow stretch of values that should hold the ranks wanted;
    the next pass counts what lies below and within it, which proves it or
    not, and sketches what is within. When a stretch has at most `limit` rows,
    or one value, its values are counted and the ranks read off. Nulls and NaN
    don't count; a group without values has nulls.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    names = [*keys, "name"]
    every = rows.select(*(F.col(c).alias(k) for c, k in zip(by, keys, strict=True)), F.col(value).cast("double").alias("v"))
    base = every.where("v IS NOT NULL AND NOT isnan(v)")
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.lit(p).alias("p")) for name, p in shares.items())))
    ends = base.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).where("n > 0")
    state = ends.select(*keys, "n", "lo", "hi", wanted.alias("w")).select(*keys, "w.name", (F.col("w.p") * (F.col("n") - 1)).alias("at"), "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside"), F.lit(2 * RANK_ERROR).alias("error"))
    state = stored(state.withColumn("first", F.floor("at")).withColumn("last", F.ceil("at")), "percentiles")
    large = (F.col("inside") > limit) & (F.col("lo") < F.col("hi"))

    def met(stretches: DataFrame) -> DataFrame:
        """Every row with the stretches that hold it."""
        small = F.broadcast if not keys or stretches.count() <= MOST_BROADCAST else lambda df: df  # without keys a row for each share
        return paired(base, small(stretches), keys).where("v BETWEEN lo AND hi")

    while not state.where(large).isEmpty():
        wide, done = state.where(large), state.where(~large)
        sketched = met(wide).groupBy(*names).agg(F.kll_sketch_agg_double("v", F.lit(KLL_K)).alias("_s"))
        # a sketch is asked for the values at fixed ranks; the stretch lies between the two around the rank wanted
        at = lambda r, error, end: F.greatest(F.lit(0), F.least(F.lit(GRID), end(((F.col(r) - F.col("below") + 0.5) / F.col("inside") + error) * GRID))).cast("int")
        to = paired(wide, sketched, names).withColumn("_s", F.kll_sketch_get_quantile_double("_s", F.array(*(F.lit(i / GRID) for i in range(GRID + 1)))))
        to = to.withColumns({"to_lo": F.get("_s", at("first", -F.col("error"), F.floor)), "to_hi": F.get("_s", at("last", F.col("error"), F.ceil))}).drop("_s")
        to = stored(to, "stretches")
        counts = met(to).groupBy(*names).agg(F.count_if(F.col("v") < F.col("to_lo")).alias("_under"), F.count_if(F.col("v").between(F.col("to_lo"), F.col("to_hi"))).alias("_in"))
        both = paired(to, counts, names)
        proved = (F.col("below") + F.col("_under") <= F.col("first")) & (F.col("below") + F.col("_under") + F.col("_in") > F.col("last"))
        # a stretch that wasn't proved stays as it was and is tried with twice the error
        after = {"lo": F.col("to_lo"), "hi": F.col("to_hi"), "below": F.col("below") + F.col("_under"), "inside": F.col("_in")}
        narrowed = both.select(*(F.when(proved, after[c]).otherwise(F.col(c)).alias(c) if c in after else F.when(proved, F.col(c)).otherwise(2 * F.col(c)).alias(c) if c == "error" else F.col(c) for c in state.columns))
        state = stored(done.unionByName(narrowed), "percentiles")
    each = met(state).groupBy(*names, "at", "first", "last", "below", "v").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*names).orderBy("v"))
    placed = each.withColumn("_end", F.col("below") + upto).withColumn("_start", F.col("_end") - F.col("c"))
    pick = lambda r: F.max(F.when((F.col("_start") <= F.col(r)) & (F.col(r) < F.col("_end")), F.col("v")))
    found = placed.groupBy(*names).agg(pick("first").alias("a"), pick("last").alias("b"), F.first(F.col("at") - F.col("first")).alias("part"))
    found = found.withColumn("x", F.col("a") + F.col("part") * (F.col("b") - F.col("a")))
    out = found.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares))
    return out if not by else paired(every.select(*keys).distinct(), out, keys, "left").select(*keys, *shares).toDF(*by, *shares)


def paired(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by equal keys of which null is one; every row with every row without keys."""
    if not keys:
        return left.crossJoin(right)
    other = right.withColumnsRenamed({k: f"_r{k}" for k in keys})
    return left.join(other, [F.col(k).eqNullSafe(F.col(f"_r{k}")) for k in keys], how).drop(*(f"_r{k}" for k in keys))
