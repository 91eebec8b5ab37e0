"""Batches written to a table, counted as they are written and again from what was written.

A batch is a folder of the table. It is written by one job whose plan observes
the rows that pass; the files are then read back and counted. A batch that
fails, or of which the counts differ, is tried again over its own folder and
reported if it can't be written. A batch that an earlier run has written and
reported whole is left alone, so a run that was cut off goes on where it ended.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..sources import stored as S

REPORT = "batch string, rows long, rejected long, chars long, written long, attempts int, error string"


def _log(path: str, batch: str) -> str:
    return f"{path}/_reports/{batch}.json"


def ingest_batches(spark: SparkSession, batches: list[tuple[str, DataFrame]], path: str, content: str = "content", valid: Column | None = None, attempts: int = 3) -> DataFrame:
    """Write each named batch to `path`/rows; a report row per batch: rows and chars observed in the write, rows rejected by `valid`, rows counted afterwards, attempts, error.

    `rows` and `written` are equal where `error` is null.
    """
    out = []
    for name, rows in batches:
        done = _report(spark, path, name)
        tries = 0
        while done is None and tries < attempts:
            tries += 1
            seen = Observation()
            keep = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
            counters = {"rows": F.count_if("_keep"), "rejected": F.count_if(~F.col("_keep")), "chars": F.coalesce(F.sum(F.when(F.col("_keep"), F.char_length(content))), F.lit(0))}
            observed = rows.withColumn("_keep", keep).observe(seen, *(c.cast("long").alias(k) for k, c in counters.items()))
            target = f"{path}/rows/batch={name}"
            try:
                observed.where("_keep").drop("_keep").write.mode("overwrite").parquet(target)
                found = seen.get
                written = spark.read.schema(rows.schema).parquet(target).count()
                if written != found["rows"]:
                    raise RuntimeError(f"{found['rows']} rows were to be written, {written} are there")
                done = {"batch": name, **{k: found[k] for k in counters}, "written": written, "attempts": tries, "error": None}
                S.remove(spark, _log(path, name))
                S.commit_text(spark, _log(path, name), json.dumps(done))
            except Exception as failure:  # a batch may fail for any reason; the report has it, and the next ones run
                error = f"{type(failure).__name__}: {str(failure).splitlines()[0]}"
                if tries == attempts:
                    S.remove(spark, target)
                    done = {"batch": name, "rows": 0, "rejected": 0, "chars": 0, "written": 0, "attempts": tries, "error": error}
        out.append(tuple(done[c.split()[0]] for c in REPORT.split(", ")))
    return spark.createDataFrame(out, REPORT)


def _report(spark: SparkSession, path: str, batch: str) -> dict | None:
    """The report of a batch that an earlier run has written whole, if its rows are still there."""
    if not S.exists(spark, _log(path, batch)) or not S.exists(spark, f"{path}/rows/batch={batch}"):
        return None
    return json.loads(S.read_text(spark, _log(path, batch)))


def summary(report: DataFrame) -> DataFrame:
    """One row: batches, failed_batches, rows, written, success_rate (of rows that weren't rejected) and batch_failure_rate in percent, verified."""
    n, failed = F.count("*"), F.count_if(F.col("error").isNotNull())
    rate = F.coalesce(F.try_divide(F.sum("written") * 100.0, F.sum(F.col("rows") + F.col("rejected"))), F.lit(0.0))
    return report.agg(n.alias("batches"), failed.alias("failed_batches"), F.sum("rows").alias("rows"), F.sum("written").alias("written"), F.round(rate, 6).alias("success_rate"), F.round(F.coalesce(F.try_divide(failed * 100.0, n), F.lit(0.0)), 6).alias("batch_failure_rate"), (F.sum("rows") == F.sum("written")).alias("verified"))
