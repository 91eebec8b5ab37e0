"""Size-tiered compaction of immutable shards under a versioned manifest (operator 1).

A store is a folder with data files, manifest tables and versions:

    data/run=<run>/shard=<n>/...   Parquet files, never changed; deleted by `vacuum` only
    manifest/<attempt>/...         Parquet table: one row per live shard
    versions/<version>             names a manifest table and the columns of the rows

A version exists once its file does. The file is written whole under another
name and then renamed without overwriting, so of two writers that prepared the
same version one fails and has to start again from the newer version; readers
see all of a version or nothing of it, and keep reading an old one while a new
one is written. A writer that dies leaves nothing that a reader looks at.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .storage import free_name

MANIFEST = "run string, number int, tier int, n_rows long, n_bytes long"
#: Shards of a manifest that is broadcast to the scan at most; a longer one is joined by a shuffle.
MOST_BROADCAST = 1_000_000


class ConcurrentCommit(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    """Rows in size-tiered shards; `column` is the text whose bytes make up a shard's size.

    Rows keep all their columns under any names, nulls and repeats included; a
    null or empty text has no bytes. Later arrivals may bring new columns, which
    older rows then have as nulls. An empty arrival makes a version without new
    shards, and an empty store reads as no rows.

    A text larger than the target size is never split; its row fills a shard.
    """

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, fan_in: int = 4, column: str = "text"):
        if target_bytes < 1 or fan_in < 2:
            raise ValueError("target_bytes must be positive and fan_in at least 2")
        self.spark, self.path, self.target, self.fan_in, self.column = spark, path.rstrip("/"), target_bytes, fan_in, column

    # --- versions ---------------------------------------------------------------------

    def _fs(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def version(self) -> int:
        """The newest committed version, 0 for an empty store."""
        fs, folder = self._fs("versions")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def _details(self, version: int) -> dict:
        fs, file = self._fs(f"versions/{version}")
        stream = fs.open(file)
        found = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        return found

    def schema(self, version: int | None = None) -> StructType:
        """The columns of the rows of a version."""
        version = self.version() if version is None else version
        return StructType.fromJson(self._details(version)["schema"]) if version else StructType()

    def commit(self, manifest: DataFrame, version: int, schema: StructType) -> None:
        """Write a manifest table and make it version `version` in one step."""
        attempt = f"{version}-{uuid.uuid4().hex[:8]}"
        manifest.select(*(c.split()[0] for c in MANIFEST.split(", "))).write.parquet(f"{self.path}/manifest/{attempt}")
        fs, ready = self._fs(f"versions/.{attempt}")
        out = fs.create(ready, False)
        out.write(bytearray(json.dumps({"manifest": attempt, "schema": schema.jsonValue()}).encode()))
        out.close()
        context = self.spark.sparkContext
        rename = getattr(context._jvm.org.apache.hadoop.fs, "Options$Rename")
        files = context._jvm.org.apache.hadoop.fs.FileContext.getFileContext(ready.toUri(), context._jsc.hadoopConfiguration())
        try:
            files.rename(ready, self._fs(f"versions/{version}")[1], context._gateway.new_array(rename, 0))
        except Exception as error:
            fs.delete(ready, False)
            raise ConcurrentCommit(f"version {version} exists already") from error

    def manifest(self, version: int | None = None) -> DataFrame:
        """The live shards of a version: run, number, tier, n_rows, n_bytes."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/{self._details(version)['manifest']}")

    # --- shards -----------------------------------------------------------------------

    def _write(self, rows: DataFrame, number: str) -> DataFrame:
        """Write `rows` of a struct column `row`, a shard for each value of `number`, and describe the shards."""
        run = uuid.uuid4().hex[:12]
        rows.select("row", F.col(number).alias("shard")).write.partitionBy("shard").option("compression", "zstd").parquet(f"{self.path}/data/run={run}")
        size = F.coalesce(F.octet_length(f"row.`{self.column}`"), F.lit(0)).cast("long")
        back = self._scan([run], rows.schema["row"].dataType)
        shards = back.groupBy("number").agg(F.count("*").alias("n_rows"), F.sum(size).alias("n_bytes"))
        return shards.select(F.lit(run).alias("run"), "number", self.tier(F.col("n_bytes")).alias("tier"), "n_rows", "n_bytes")

    def _scan(self, runs: list[str], schema: StructType) -> DataFrame:
        """row, run, number of all files of some runs, in one scan."""
        stored = StructType([StructField("row", schema)])
        paths = [f"{self.path}/data/run={r}" for r in runs]
        found = self.spark.read.schema(StructType([*stored, *StructType.fromDDL("run string, shard int")])).option("basePath", f"{self.path}/data").parquet(*paths)
        return found.select("row", "run", F.col("shard").alias("number"))

    def _live(self, shards: DataFrame, schema: StructType) -> DataFrame:
        """The rows of some shards, with the columns of their manifest rows but for counts.

        Only metadata reaches the driver: the names of runs, and the shards for
        a broadcast if they are few enough.
        """
        wanted = shards.drop("n_rows", "n_bytes")
        runs = sorted(r["run"] for r in wanted.select("run").distinct().collect())
        if not runs:
            return self.spark.createDataFrame([], StructType([StructField("row", schema), *wanted.schema]))
        side = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
        return self._scan(runs, schema).join(side, ["run", "number"])

    def tier(self, n_bytes):
        """0 for shards of half the target size or more; each tier above holds shards `fan_in` times smaller."""
        return F.greatest(F.lit(0), F.ceil(F.log(F.lit(self.target / 2) / F.greatest(n_bytes, F.lit(1))) / F.log(F.lit(float(self.fan_in))))).cast("int")

    def append(self, arrivals: DataFrame) -> int:
        """Write arrivals as small immutable shards, one for each task that has rows, and commit them with what is there.

        Nothing is shuffled; how the source is split decides how many shards
        there are. Returns the new version.
        """
        version = self.version()
        columns = [F.col(f"`{c}`") for c in arrivals.columns]
        new = self._write(arrivals.select(F.struct(*columns).alias("row"), F.spark_partition_id().alias("_number")), "_number")
        known = self.schema(version)
        names = {f.name for f in known}
        schema = StructType([*known, *(StructField(f.name, f.dataType, True) for f in arrivals.schema if f.name not in names)])
        self.commit(self.manifest(version).unionByName(new), version + 1, schema)
        return version + 1

    def _due(self, live: DataFrame) -> DataFrame:
        """run, number, group of the shards that a round merges.

        Within each tier but 0 that has `fan_in` shards or more, they are put in
        order of size and cut into groups of up to `target_bytes`. A group of
        `fan_in` shards, or of half the target size, becomes a shard of a lower
        tier; smaller groups wait.
        """
        by_size = Window.partitionBy("tier").orderBy("n_bytes", "run", "number")
        small = live.where("tier > 0").withColumn("_sum", F.sum("n_bytes").over(by_size)).withColumn("_n", F.count("*").over(Window.partitionBy("tier")))
        cut = small.where(F.col("_n") >= self.fan_in).withColumn("_part", F.floor((F.col("_sum") - 1) / F.lit(self.target)))
        groups = cut.groupBy("tier", "_part").agg(F.count("*").alias("_n"), F.sum("n_bytes").alias("_bytes"))
        groups = groups.where((F.col("_n") >= self.fan_in) | ((F.col("_n") > 1) & (F.col("_bytes") >= self.target / 2)))
        numbered = groups.select("tier", "_part", (F.row_number().over(Window.orderBy("tier", "_part")) - 1).alias("group"))  # a row for each merged shard
        return cut.join(numbered, ["tier", "_part"]).select("run", "number", "group")

    def due(self) -> int:
        """How many shards of the newest version `compact` would merge next."""
        return self._due(self.manifest()).count()

    def compact(self) -> int:
        """Merge similarly sized shards until no tier is due; returns the newest version.

        Each merge takes its rows to a lower tier, so a row is written at most
        once for each tier: the bytes written grow with the logarithm of target
        size over shard size. Every round is a version of its own. A task
        writes one merged shard of at most the target size.
        """
        while True:
            version = self.version()
            live = self.manifest(version)
            due = self._due(live)
            groups = due.agg(F.max("group")).first()[0]
            if groups is None:
                return version
            rows = self._live(due, self.schema(version))
            new = self._write(rows.repartitionByRange(groups + 1, "group"), "group")
            kept = live.join(due.select("run", "number"), ["run", "number"], "left_anti")
            self.commit(kept.unionByName(new), version + 1, self.schema(version))

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version with the shard they are in, its tier, and the version.

        These three columns are called shard, tier and version, with
        underscores before the name where a column of the rows has it.
        """
        version = self.version() if version is None else version
        schema = self.schema(version)
        rows = self._live(self.manifest(version), schema)
        more = {"shard": F.concat_ws("/", "run", "number"), "tier": F.col("tier"), "version": F.lit(version)}
        return rows.select(*(F.col(f"row.`{c}`") for c in schema.names), *(v.alias(free_name(k, schema.names)) for k, v in more.items()))

    def vacuum(self) -> None:
        """Delete the runs that the newest version doesn't use. Readers of older versions fail from then on."""
        used = {r["run"] for r in self.manifest().select("run").distinct().collect()}
        fs, data = self._fs("data")
        for status in fs.listStatus(data) if fs.exists(data) else []:
            if status.getPath().getName().removeprefix("run=") not in used:
                fs.delete(status.getPath(), True)
