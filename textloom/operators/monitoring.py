"""Operational statistics, alerts, cache behaviour and evaluation metrics."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import relational, sketches


def trace_stats(traces: DataFrame, *by: str) -> DataFrame:
    """Count, failures, mean, exact p50/p95/p99, population deviation and throughput of `latency_ms`, `failed` rows.

    Percentiles are exact and no group's values are gathered (see `sketches`).
    """
    stats = traces.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("failed").alias("failures"),
        F.round(F.try_divide(F.count_if("failed") * 100.0, F.count("*")), 6).alias("error_pct"),
        F.round(F.avg("latency_ms"), 6).alias("mean_ms"),
        F.round(F.stddev_pop("latency_ms"), 6).alias("std_ms"),
        F.round(F.try_divide(F.lit(1000.0), F.avg("latency_ms")), 6).alias("per_second"),
    )
    shares = {"p50_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    ranks = sketches.exact_percentiles(traces, "latency_ms", shares, *by)
    joined = stats.join(F.broadcast(ranks)) if not by else sketches.paired(stats, ranks, list(by))  # a row each without groups
    return joined.select(*by, "n", "failures", "error_pct", "mean_ms", *(F.round(p, 6).alias(p) for p in shares), "std_ms", "per_second")


def monitoring_stats(traces: DataFrame, last_n: int | None = None) -> DataFrame:
    """`trace_stats` of all traces or of the last ones, with their tokens, cost and cache hits (percent).

    Traces also have `tokens`, `cost_usd` and `cache_hit`, null where the cache
    wasn't asked. The last ones, in the order of (ts, event_id), come from a
    distributed top-n.
    """
    rows = traces if last_n is None else traces.orderBy(F.desc("ts"), F.desc("event_id")).limit(last_n)
    asked, hits = F.count("cache_hit"), F.count_if("cache_hit")
    more = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("total_tokens"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("total_cost_usd"), F.round(F.coalesce(F.try_divide(hits * 100.0, asked), F.lit(0.0)), 6).alias("cache_hit_pct"))
    return trace_stats(rows).join(F.broadcast(more))  # a row each


def quality_means(scores: DataFrame) -> DataFrame:
    """metric, n, mean over recorded quality scores; null scores don't count."""
    return scores.where("score IS NOT NULL").groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


def spans(traces: DataFrame) -> DataFrame:
    """event_id, component, latency_ms, failed, place: a row per span of traces with an array `spans` of (component, latency_ms, error)."""
    one = traces.select("event_id", F.posexplode("spans").alias("place", "s"))
    return one.select("event_id", "s.component", "s.latency_ms", F.col("s.error").isNotNull().alias("failed"), F.col("place").cast("long").alias("place"))


def traced(spans: DataFrame) -> DataFrame:
    """A trace per event_id from span rows: total latency, the first component that failed, and a map of latencies by component."""
    failed = F.min_by("component", F.when(F.col("failed"), F.col("place")))
    return spans.groupBy("event_id").agg(F.sum("latency_ms").alias("latency_ms"), F.count("*").alias("spans"), failed.alias("failed_in"))


def costed(usage: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Add cost_usd: tokens in and out by the model's prices for a thousand of each; an unknown model costs nothing."""
    price = F.create_map(*(F.lit(x) for model, (a, b) in prices.items() for x in (model, f"{a},{b}")))
    both = F.transform(F.split(F.try_element_at(price, F.col("model")), ","), lambda x: x.cast("double"))
    cost = (F.col("tokens_in") * F.get(both, F.lit(0)) + F.col("tokens_out") * F.get(both, F.lit(1))) / 1000
    return usage.withColumn("cost_usd", F.round(F.coalesce(cost, F.lit(0.0)), 9))


def with_cache_misses(health: DataFrame, cache_hit: str = "cache_hit") -> DataFrame:
    """Add miss_pct: the share of all cache lookups so far that missed, 100 before the first; `health` has `position`."""
    hit = F.col(cache_hit)
    sums = relational.running(health, {"_hits": F.when(hit, 1).otherwise(0), "_asked": F.when(hit.isNotNull(), 1).otherwise(0)})
    return sums.withColumn("miss_pct", 100.0 - F.coalesce(F.try_divide(F.col("_hits") * 100.0, F.col("_asked")), F.lit(0.0))).drop("_hits", "_asked")


def rolling_health(traces: DataFrame, n: int = 100) -> DataFrame:
    """p95 latency and error share over the last n traces at each trace, in the order of (ts, event_id)."""
    columns = {"p95_ms": F.percentile("latency_ms", 0.95), "error_pct": F.avg(F.when(F.col("failed"), 100.0).otherwise(0.0))}
    return relational.rolling(relational.positioned(traces, "ts", "event_id"), n, columns)


def alerts(health: DataFrame, p95_ms: float = 5000.0, error_pct: float = 5.0, miss_pct: float = 70.0) -> DataFrame:
    """A row for each threshold that a trace's window exceeds: event_id, position, level, metric, value.

    Cache misses are looked at where `health` has a column of their share.
    """
    rules = [("WARNING", "latency_p95", "p95_ms", p95_ms), ("ERROR", "error_rate", "error_pct", error_pct), ("INFO", "cache_miss_rate", "miss_pct", miss_pct)]
    found = F.array(*(F.when(F.col(c) > limit, F.struct(F.lit(level).alias("level"), F.lit(metric).alias("metric"), F.round(c, 6).alias("value"))) for level, metric, c, limit in rules if c in health.columns))
    return health.select("event_id", "position", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("a")).select("event_id", "position", "a.level", "a.metric", "a.value")


def recent_alerts(found: DataFrame, level: str | None = None, last_n: int | None = None) -> DataFrame:
    """Alerts of a level, or the last ones of them, by position."""
    rows = found if level is None else found.where(F.col("level") == level)
    return rows if last_n is None else rows.orderBy(F.desc("position"), "metric").limit(last_n)


def ttl_hits(ops: DataFrame, ttl_seconds: float) -> DataFrame:
    """Each `get` of (key, ts, op) is a hit if the last `set` of its key is at most `ttl_seconds` old; hits don't extend it."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    last = F.last(F.when(F.col("op") == "set", F.col("ts").cast("timestamp").cast("double")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    age = F.col("ts").cast("timestamp").cast("double") - F.col("_set")
    return ops.withColumn("_set", last).where("op = 'get'").withColumn("hit", F.coalesce(age <= ttl_seconds, F.lit(False))).drop("_set")


def renewed_hits(lookups: DataFrame, ttl_seconds: float) -> DataFrame:
    """Each lookup of (key, ts, event_id) is a hit if the lookup of its key before it is at most `ttl_seconds` old; a miss stores the key, a hit renews it."""
    order = Window.partitionBy("key").orderBy("ts", "event_id")
    seconds = F.col("ts").cast("timestamp").cast("double")
    return lookups.withColumn("hit", F.coalesce(seconds - F.lag(seconds).over(order) <= ttl_seconds, F.lit(False)))


def cache_stats(lookups: DataFrame, *by) -> DataFrame:
    """Lookups with `hit`: how many, hits, misses and the hit rate in percent."""
    n, hits = F.count("*"), F.count_if("hit")
    return lookups.groupBy(*by).agg(n.alias("lookups"), hits.alias("hits"), (n - hits).alias("misses"), F.round(F.coalesce(F.try_divide(hits * 100.0, n), F.lit(0.0)), 6).alias("hit_rate"))


def lru_hits(accesses: DataFrame, capacity: int) -> DataFrame:
    """cache, event_id, hit: accesses of each cache in order, with the least recently used key evicted.

    A cache is sequential by nature; its accesses stream through a task in
    order and only `capacity` keys are held, however long it runs.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, held = None, OrderedDict()
        for pdf in frames:
            hits = []
            for cache, key in zip(pdf["cache"], pdf["key"], strict=True):
                if cache != name:
                    name, held = cache, OrderedDict()
                hits.append(key in held)
                held[key] = True
                held.move_to_end(key)
                if len(held) > capacity:
                    held.popitem(last=False)
            yield pd.DataFrame({"cache": pdf["cache"], "event_id": pdf["event_id"], "hit": hits})

    ordered = accesses.select("cache", "key", "ts", "event_id").repartition("cache").sortWithinPartitions("cache", "ts", "event_id")
    return ordered.mapInPandas(run, "cache string, event_id long, hit boolean")


# --- evaluation -----------------------------------------------------------------------


def retrieval_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Per query with any relevant document: precision, recall, reciprocal rank and nDCG at k.

    `ranked` is (query_id, doc_id, rank), `relevant` (query_id, doc_id).
    """
    hits = ranked.where(F.col("rank") <= k).join(relevant.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    wanted = relevant.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = wanted.join(found, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("query_id", zero(F.col("hits") / k).alias("precision"), zero(F.col("hits") / F.col("n_relevant")).alias("recall"), zero(1 / F.col("first")).alias("reciprocal_rank"), zero(F.col("dcg") / ideal).alias("ndcg"))


def degraded(scores: DataFrame, baselines: DataFrame, allowed: float = 0.05) -> DataFrame:
    """metric, score, baseline, passed: a score more than `allowed` below its baseline fails."""
    return scores.join(baselines, "metric").withColumn("passed", F.round(F.col("score") - (F.col("baseline") - allowed), 9) >= 0)
