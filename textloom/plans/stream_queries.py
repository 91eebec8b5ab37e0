"""Queries that run streams to their end, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitoring as M
from ..sources import stored as S
from ..streaming import jobs as J
from ..streaming import stateful as Z
from .common import table


def _events(s, d):
    """The events as a folder that streams read, with a row far ahead that lets the watermark pass all others; that row is late for nothing and has no component."""
    events = table(s, d, "events")
    after = events.agg((F.max("ts") + F.expr("INTERVAL 90 DAYS")).alias("ts")).select(F.lit(-1).cast("long").alias("event_id"), "ts", F.lit(-1).cast("long").alias("user_id"), F.lit("end of stream").alias("event_type"), F.lit(0.0).alias("value"), F.lit("{}").alias("props"))
    folder = S.new_path(s, "events")
    events.unionByName(after).write.parquet(folder)
    return s.readStream.schema(events.schema).parquet(folder)


def _finished(frame):
    spark = frame.sparkSession
    target = S.new_path(spark, "stream")
    Z.started(frame, f"{target}/rows", f"{target}/checkpoint").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{target}/rows")


def _health(s, d):
    traces = _events(s, d).select("ts", "event_id", F.col("event_type").alias("component"), F.col("value").alias("latency_ms"), (F.col("user_id") % 7 == 0).alias("failed"))
    return _finished(Z.rolling_health(traces)).where("component <> 'end of stream'")


def stream_rolling_health(s, d):
    """At each event, the p95 and the failures of the last hundred of its kind, by keyed state."""
    return _health(s, d).select("component", "event_id", "n", F.round("p95_ms", 6).alias("p95_ms"), F.round("error_pct", 6).alias("error_pct"))


def stream_alerts(s, d):
    """Alerts of the stream: events at which the last hundred of the kind were slow or failed too often."""
    found = M.alerts(_health(s, d).withColumn("position", F.col("n")), p95_ms=480.0, error_pct=20.0)
    return found.select("event_id", "level", "metric", "value")


def stream_renewed_lookups(s, d):
    """Lookups of each user's entry that lives six hours after its last use."""
    rows = _finished(Z.renewed_lookups(_events(s, d), 6 * 3600, key="user_id")).where("event_id >= 0")
    return rows.groupBy("key").agg(F.count("*").alias("lookups"), F.count_if("hit").alias("hits"))


def stream_ingest(s, d):
    """Documents sent as two overlapping sets of files, each once in the target."""
    docs = table(s, d, "documents")
    base = S.new_path(s, "ingest")
    for part in (docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 2 = 0")):
        part.write.mode("append").parquet(f"{base}/in")
        J.ingest(s, f"{base}/in", docs.schema, f"{base}/out", f"{base}/checkpoint", "doc_id").awaitTermination()
    return s.read.parquet(f"{base}/out").select("doc_id", F.md5("text").alias("digest"))


QUERIES = {f.__name__: f for f in (stream_rolling_health, stream_alerts, stream_renewed_lookups, stream_ingest)}

_HEALTH = """h AS (
    SELECT event_type AS component, event_id, count(*) OVER w AS n, quantile_cont(value, 0.95) OVER w AS p95_ms, avg(CASE WHEN user_id % 7 = 0 THEN 100.0 ELSE 0.0 END) OVER w AS error_pct
    FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING))"""

ORACLES = {
    "stream_rolling_health": f"WITH {_HEALTH} SELECT component, event_id, n, round(p95_ms, 6) AS p95_ms, round(error_pct, 6) AS error_pct FROM h",
    "stream_alerts": f"WITH {_HEALTH} SELECT event_id, 'WARNING' AS level, 'latency_p95' AS metric, round(p95_ms, 6) AS value FROM h WHERE p95_ms > 480 UNION ALL SELECT event_id, 'ERROR', 'error_rate', round(error_pct, 6) FROM h WHERE error_pct > 20",
    "stream_renewed_lookups": """
        WITH l AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS age FROM events)
        SELECT user_id::VARCHAR AS key, count(*) AS lookups, count(*) FILTER (age <= 21600000000) AS hits FROM l GROUP BY user_id""",
    "stream_ingest": "SELECT doc_id, md5(text) AS digest FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 2 = 0",
}
