"""Queries over stored sketches, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sketches as K
from ..sources.stored import stored
from .common import table


def _traces(s, d):
    e = table(s, d, "events")
    return e.select("ts", "user_id", F.col("value").alias("latency_ms"), (F.col("event_type") == "error").alias("failed"), F.col("event_type").alias("item"))


def _hours(s, d):
    return stored(K.hourly(_traces(s, d)), "hours")


def sketched_days(s, d):
    """Days from stored hours: what sketches say, beside the exact values, and whether it is within their bounds."""
    traces = _traces(s, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    about = K.merged(_hours(s, d), F.date_format("hour", "yyyy-MM-dd").alias("day")).select("day", "n", "failures", F.round("mean_ms", 6).alias("mean_ms"), F.round("std_ms", 6).alias("std_ms"), F.col("users").alias("_users"), F.col("p95_ms").alias("_p95"))
    exact = K.exact_percentiles(traces, "latency_ms", {"p95_ms": 0.95}, "day")
    users = traces.groupBy("day").agg(F.countDistinct("user_id").alias("users"))
    rank = traces.join(about.select("day", "_p95"), "day").groupBy("day").agg(F.avg((F.col("latency_ms") < F.col("_p95")).cast("double")).alias("_under"), F.avg((F.col("latency_ms") <= F.col("_p95")).cast("double")).alias("_upto"))
    rows = about.join(exact, "day").join(users, "day").join(rank, "day")
    near = (F.col("_under") - K.RANK_ERROR <= 0.95) & (F.col("_upto") + K.RANK_ERROR >= 0.95)
    return rows.select("day", "n", "failures", "mean_ms", "std_ms", "users", F.round("p95_ms", 6).alias("p95_ms"), near.alias("p95_near"), (F.abs(F.col("_users") - F.col("users")) <= K.DISTINCT_ERROR * F.col("users") + 1).alias("users_near"))


def sketched_items(s, d):
    """How often each event type occurs in a week, from the stored hours' frequent items."""
    week = F.date_format(F.date_trunc("week", "hour"), "yyyy-MM-dd").alias("week")
    return K.merged(_hours(s, d), week, top=10).select("week", F.inline("items")).select("week", "item", F.col("count").alias("n"))


def exact_percentiles(s, d):
    """Percentiles of order prices by priority, narrowed to stretches of fifty rows."""
    shares = {"p10": 0.1, "p50": 0.5, "p999": 0.999}
    found = K.exact_percentiles(table(s, d, "orders"), "o_totalprice", shares, "o_orderpriority", limit=50)
    return found.select("o_orderpriority", *(F.round(c, 4).alias(c) for c in shares))


QUERIES = {f.__name__: f for f in (sketched_days, sketched_items, exact_percentiles)}

ORACLES = {
    "sketched_days": """SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures, round(avg(value), 6) AS mean_ms, round(stddev_pop(value), 6) AS std_ms, count(DISTINCT user_id) AS users,
        round(quantile_cont(value, 0.95), 6) AS p95_ms, true AS p95_near, true AS users_near FROM events GROUP BY 1""",
    "sketched_items": "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, event_type AS item, count(*) AS n FROM events GROUP BY 1, 2",
    "exact_percentiles": "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 4) AS p10, round(quantile_cont(o_totalprice, 0.5), 4) AS p50, round(quantile_cont(o_totalprice, 0.999), 4) AS p999 FROM orders GROUP BY 1",
}
