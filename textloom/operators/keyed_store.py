"""A stored collection with a key: upserts, deletes, lookups and pages over versions of bucketed files.

A key belongs to a bucket. A batch rewrites the buckets that its keys touch and
no others; a manifest tells for each bucket which write holds it, and a new
manifest, committed by a rename that doesn't overwrite, makes the batch visible
at once or not at all. A deleted key leaves a tombstone, so an older row that
arrives late doesn't bring it back.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources import stored as S


class Conflict(RuntimeError):
    """Another writer committed a version between a batch's start and its end."""


@dataclass(frozen=True)
class KeyedStore:
    """The store at `path`; rows have `key`, `order` (the version of a row, a number or time) and other columns of `schema`."""

    spark: SparkSession
    path: str

    @staticmethod
    def create(spark: SparkSession, path: str, schema: str, key: str, order: str, buckets: int = 64) -> KeyedStore:
        """A new store without rows; raises if the path has one."""
        about = {"schema": json.loads(spark.createDataFrame([], schema).schema.json()), "key": key, "order": order, "buckets": buckets}
        if not S.commit_text(spark, f"{path}/store.json", json.dumps(about)):
            raise FileExistsError(path)
        return KeyedStore(spark, path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        return S.exists(spark, f"{path}/store.json")

    def about(self) -> dict:
        return json.loads(S.read_text(self.spark, f"{self.path}/store.json"))

    def version(self) -> int:
        """The last committed version, 0 before the first batch."""
        found = [int(n[1:-5]) for n in S.names(self.spark, f"{self.path}/versions") if n.endswith(".json")]
        return max(found, default=0)

    def manifest(self, version: int | None = None) -> dict[int, str]:
        """The folder that holds each bucket; buckets that never had a row are missing."""
        version = self.version() if version is None else version
        return {int(b): f for b, f in json.loads(S.read_text(self.spark, f"{self.path}/versions/v{version}.json")).items()} if version else {}

    # --- reading ---

    def _rows(self, held: dict[int, str], tombstones: bool) -> DataFrame:
        about = self.about()
        schema = StructType.fromJson(about["schema"]).add("_deleted", "boolean").add("_bucket", "integer")
        folders = [f"{self.path}/data/{f}/_bucket={b}" for b, f in sorted(held.items())]
        rows = self.spark.read.schema(StructType(schema.fields[:-1])).parquet(*folders) if folders else self.spark.createDataFrame([], StructType(schema.fields[:-1]))
        return rows if tombstones else rows.where("NOT _deleted").drop("_deleted")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the last one by default."""
        return self._rows(self.manifest(version), False)

    def get(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys (a column named as the store's key); only their buckets are read."""
        about = self.about()
        wanted = keys.select(about["key"]).distinct()
        touched = {r["b"] for r in wanted.select(self._bucket(about).alias("b")).distinct().collect()}  # as many as there are buckets
        return self._rows({b: f for b, f in self.manifest().items() if b in touched}, False).join(wanted, about["key"], "left_semi")

    def scroll(self, after=None, n: int = 100, where: Column | None = None) -> tuple[DataFrame, object]:
        """The next n rows by key after `after`, and the key to go on from (null at the end)."""
        key = self.about()["key"]
        rows = self.read() if after is None else self.read().where(F.col(key) > F.lit(after))
        page = (rows if where is None else rows.where(where)).orderBy(key).limit(n + 1)
        keys = [r[0] for r in page.select(key).collect()]  # n + 1 keys
        return page.limit(n), keys[n - 1] if len(keys) > n else None

    def info(self) -> DataFrame:
        """A row per bucket: bucket, folder (of the write that holds it), rows and tombstones."""
        about = self.about()
        held = self.manifest()
        folders = self.spark.createDataFrame(sorted(held.items()), "bucket int, folder string")
        counts = self._rows(held, True).groupBy(self._bucket(about).alias("bucket")).agg(F.count_if(~F.col("_deleted")).alias("rows"), F.count_if("_deleted").alias("tombstones"))
        return folders.join(counts, "bucket", "left").na.fill(0, ["rows", "tombstones"])

    # --- writing ---

    def _bucket(self, about: dict) -> Column:
        return F.pmod(F.xxhash64(F.col(about["key"])), F.lit(about["buckets"])).cast("int")

    def upsert(self, rows: DataFrame, where: Column | None = None) -> dict:
        """Insert rows or replace those of equal keys and not newer order; of several rows of a key the newest counts, of equally new ones the first by all columns.

        Rows without a key, and those `where` isn't true for, are skipped.
        Returns version, upserted, deleted, skipped and the buckets rewritten.
        """
        return self._merge(rows, F.lit(False), where)

    def delete(self, keys: DataFrame) -> dict:
        """Delete keys (columns key and order); a newer row of the key stays."""
        return self._merge(keys, F.lit(True), None)

    def _merge(self, rows: DataFrame, deleted: Column, where: Column | None) -> dict:
        about = self.about()
        key, order = about["key"], about["order"]
        fields = StructType.fromJson(about["schema"])
        given = set(rows.columns)
        typed = [(F.col(f.name) if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
        valid = F.coalesce(F.col(key).isNotNull() & (F.lit(True) if where is None else where), F.lit(False))
        seen = Observation()
        flagged = rows.withColumn("_ok", valid).observe(seen, F.count_if("_ok").alias("taken"), F.count_if(~F.col("_ok")).alias("skipped"))
        batch = flagged.where("_ok").select(*typed).withColumn("_deleted", deleted).withColumn("_bucket", self._bucket(about))
        batch = S.stored(batch, "batch")
        base = self.version()
        held = self.manifest(base)
        touched = {r["_bucket"] for r in batch.select("_bucket").distinct().collect()}  # as many as there are buckets
        if not touched:
            return {"version": base, "upserted": 0, "deleted": 0, "skipped": seen.get["skipped"], "buckets": []}
        old = self._rows({b: f for b, f in held.items() if b in touched}, True).withColumn("_bucket", self._bucket(about)).withColumn("_new", F.lit(False))
        every = [f.name for f in fields]
        newest = Window.partitionBy("_bucket", key).orderBy(F.desc_nulls_last(order), F.desc("_new"), F.xxhash64(*every))
        merged = old.unionByName(batch.withColumn("_new", F.lit(True))).withColumn("_i", F.row_number().over(newest)).where("_i = 1").drop("_i", "_new")
        folder = uuid.uuid4().hex
        merged.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        after = {**held, **dict.fromkeys(sorted(touched), folder)}
        if not S.commit_text(self.spark, f"{self.path}/versions/v{base + 1}.json", json.dumps(after)):
            S.remove(self.spark, f"{self.path}/data/{folder}")
            raise Conflict(f"version {base + 1} of {self.path} is another writer's")
        gone = batch.select(F.count_if("_deleted").alias("d"), F.count_if(~F.col("_deleted")).alias("u")).first()
        return {"version": base + 1, "upserted": gone["u"], "deleted": gone["d"], "skipped": seen.get["skipped"], "buckets": sorted(touched)}

    def apply(self, batches: list[tuple[str, DataFrame]], attempts: int = 3) -> DataFrame:
        """Run named batches of upserts one after another; a row per batch: batch, version, upserted, skipped, attempts, error.

        A batch that another writer's commit got before, or that fails, is
        tried again; one that fails for good is reported, and the next ones run.
        """
        out = []
        for name, rows in batches:
            done, error, tries = {}, None, 0
            while not done and tries < attempts:
                tries += 1
                try:
                    done, error = self.upsert(rows), None
                except Exception as failure:  # a batch may fail for any reason; the report has it
                    error = f"{type(failure).__name__}: {str(failure).splitlines()[0]}"
            out.append((name, done.get("version"), done.get("upserted", 0), done.get("skipped", 0), tries, error))
        return self.spark.createDataFrame(out, "batch string, version int, upserted long, skipped long, attempts int, error string")

    def vacuum(self) -> int:
        """Delete folders that the last version doesn't use; returns how many. No reader of older versions may be left."""
        used = set(self.manifest().values())
        unused = [f for f in S.names(self.spark, f"{self.path}/data") if f not in used]
        for folder in unused:
            S.remove(self.spark, f"{self.path}/data/{folder}")
        return len(unused)
