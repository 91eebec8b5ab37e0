"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_fallback: dict[str, str] = {}


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_dir(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names; without it, a folder of the warehouse, or on a local master a temporary one.

    A warehouse on a machine's own disk is of no use to other executors, so a
    cluster that has neither raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        return _local_fallback.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="textloom-"))
    folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    if file_system(spark, folder)[0].getScheme() == "file":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to a new Parquet table of the shared folder and read back: worked out once, and no executor has to survive for it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = file_system(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds, none if there is no such folder."""
    fs, target = file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def commit_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that appears whole or not at all; false if another writer was there first."""
    fs, target = file_system(spark, path)
    _, draft = file_system(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    context = spark.sparkContext
    options = context._gateway.new_array(getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # without overwriting
    files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), context._jsc.hadoopConfiguration())
    try:
        files.rename(draft, target, options)
    except Exception:
        fs.delete(draft, False)
        if not fs.exists(target):
            raise
        return False
    return True


def remove(spark: SparkSession, path: str) -> None:
    fs, target = file_system(spark, path)
    fs.delete(target, True)
