"""Structured Streaming: incremental ingestion, rolling health, sessions, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

#: How late a trace may be.
LATENESS = "10 minutes"


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str) -> StreamingQuery:
    """Append new files of `source` to the Parquet table `target`, each key once; restarts go on from the checkpoint.

    The keys seen are the stream's state, held by the tasks that own them, so a
    batch looks only its own keys up and nothing that was written is read. A
    batch that runs again after a failure overwrites its own folder, so no row
    is written twice. Rows without a key are left out.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    rows = spark.readStream.schema(schema).parquet(source).where(F.col(key).isNotNull()).dropDuplicates([key])
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def timed(traces: DataFrame) -> DataFrame:
    return traces.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATENESS)


def windowed_health(traces: DataFrame, length: str = "1 hour") -> DataFrame:
    """Count, failures, mean and exact p95 per window and component; late rows beyond the watermark are left out."""
    grouped = timed(traces).groupBy(F.window("ts", length), F.col("event_type").alias("component"))
    out = grouped.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.avg("value").alias("mean_ms"), F.percentile("value", 0.95).alias("p95_ms"))
    return out.select(F.col("window.start").alias("start"), "component", "n", "failures", F.round("mean_ms", 6).alias("mean_ms"), F.round("p95_ms", 6).alias("p95_ms"))


def sessions(events: DataFrame, gap: str = "60 minutes") -> DataFrame:
    """user_id, start, end, n of sessions that end after `gap` without an event."""
    grouped = timed(events).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows sent again within the watermark go."""
    return timed(events).dropDuplicatesWithinWatermark([key])


def finish(frame: DataFrame, target: str, checkpoint: str) -> None:
    """Run a stream over what is there, in append mode to Parquet."""
    frame.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
