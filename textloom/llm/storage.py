"""Shared-folder tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_fallback: dict[str, str] = {}


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor shares, from `spark.checkpoint.dir`.

    Where the setting is missing, a local master gets a temporary folder, and a
    cluster a folder in the warehouse unless that is on a machine's own disk,
    which other executors can't read: then this raises.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
        if _file_system(spark, folder)[0].getScheme() == "file":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        return folder
    app = spark.sparkContext.applicationId
    if app not in _local_fallback:
        _local_fallback[app] = "file://" + tempfile.mkdtemp(prefix="textloom-")
    return _local_fallback[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _write(df: DataFrame, path: str, codec: str) -> DataFrame:
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write `df` to a new Parquet table in the shared folder and read it back.

    Everything downstream starts from files that outlive executors, and
    Python work above is done exactly once.
    """
    return _write(df, new_path(df.sparkSession, name), codec)


class Scratch:
    """Staged tables of one computation; they are deleted when the `with` block ends.

    What the block returns must not read them lazily.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def staged(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        self.paths.append(new_path(self.spark, name))
        return _write(df, self.paths[-1], codec)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            fs, target = _file_system(self.spark, path)
            fs.delete(target, True)


def free_name(name: str, taken) -> str:
    """`name`, with as many underscores before it as it takes to differ from those taken."""
    while name.lower() in {t.lower() for t in taken}:
        name = "_" + name
    return name
