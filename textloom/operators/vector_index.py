"""An inverted-file index: vectors in lists around centroids, stored, and searched list by list.

Centroids are fitted on a bounded sample, every vector is put into the list of
its nearest centroid, and the lists are the partitions of a Parquet table. A
search reads the lists whose centroids are nearest to a query, with its filter
pushed into their scan, and scores what it reads exactly.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import vectors as V
from ..sources import stored as S
from .vectors import tile_top_k

#: Lists at most; their centroids are held by every task.
MOST_LISTS = 4096
#: About as many vectors, chosen by hashed id, are what the centroids are fitted on.
SAMPLE = 65_536


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return rows.reshape(len(column), -1) if len(column) else rows.reshape(0, 0)


def _usable(v: Column) -> Column:
    """Vectors that have a direction."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


@dataclass(frozen=True)
class IvfIndex:
    """A stored index: `path`/lists has id, v, payload columns and list; `path`/centroids list, n, centroid."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(vectors: DataFrame, path: str, payload: tuple[str, ...] = (), lists: int | None = None, sample: int = SAMPLE, iterations: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> IvfIndex:
        """Fit centroids, by default as many as the root of the number of vectors, and write the lists.

        Vectors that are null, zero or hold a null or NaN take no part.
        """
        spark = vectors.sparkSession
        rows = vectors.where(_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *payload)
        n = rows.count()
        lists = max(1, min(MOST_LISTS, n, lists or round(n**0.5)))
        chosen = rows.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n))) < sample).select(array_to_vector(V.normalize(F.col("v"))).alias("features"))
        centers = KMeans(k=lists, maxIter=iterations, seed=7, initMode="random", distanceMeasure="cosine").fit(chosen).clusterCenters() if n else []
        index = IvfIndex(spark, path)
        assigned = index._assigned(rows, np.array(centers).reshape(len(centers), -1) if n else np.empty((0, 0)))
        S.commit_text(spark, f"{path}/schema.json", assigned.schema.json())
        assigned.hint("rebalance", "list").write.partitionBy("list").parquet(f"{path}/lists")
        sizes = index.lists().groupBy("list").agg(F.count("*").alias("n"))
        table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centers)], "list int, centroid array<double>")
        table.join(sizes, "list", "left").na.fill(0, ["n"]).coalesce(1).write.parquet(f"{path}/centroids")
        return index

    def add(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> None:
        """Append vectors to the lists; the centroids stay. Columns of the payload are taken by name."""
        payload = [c for c in self.lists().columns if c not in ("id", "v", "list")]
        rows = vectors.where(_usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), *payload)
        self._assigned(rows, self.centroids()[1]).hint("rebalance", "list").write.mode("append").partitionBy("list").parquet(f"{self.path}/lists")

    def lists(self) -> DataFrame:
        schema = StructType.fromJson(json.loads(S.read_text(self.spark, f"{self.path}/schema.json")))
        return self.spark.read.schema(schema).parquet(f"{self.path}/lists")

    def centroids(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and unit centroids of the lists, MOST_LISTS at most."""
        rows = sorted(self.spark.read.parquet(f"{self.path}/centroids").collect(), key=lambda r: r["list"])
        centers = np.array([r["centroid"] for r in rows]).reshape(len(rows), -1) if rows else np.empty((0, 0))
        return np.array([r["list"] for r in rows]), centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)

    def _assigned(self, rows: DataFrame, centers: np.ndarray) -> DataFrame:
        names = rows.columns
        unit = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-300)
        held = self.spark.sparkContext.broadcast(unit)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch["v"])
                best = (m @ held.value.T).argmax(axis=1) if len(m) else np.empty(0, np.int64)
                yield pa.record_batch([*batch.columns, pa.array(best.astype(np.int32))], [*names, "list"])

        return rows.mapInArrow(nearest, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", list int")

    def probed(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """(query_id, q, list, nearness): each query's nearest lists, from 1; all of them without `probes`."""
        numbers, unit = self.centroids()
        if not len(numbers):
            return self.spark.createDataFrame([], "query_id long, q array<double>, list int, nearness int")
        held = self.spark.sparkContext.broadcast((numbers, unit))
        most = len(numbers) if probes is None else min(probes, len(numbers))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, unit = held.value
            for batch in batches:
                m = _matrix(batch["q"])
                order = np.argsort(-(m @ unit.T), axis=1, kind="stable")[:, :most] if len(m) else np.empty((0, most), np.int64)
                row = np.repeat(np.arange(len(m)), most)
                yield pa.record_batch([batch["query_id"].take(pa.array(row)), batch["q"].take(pa.array(row)), pa.array(numbers[order].ravel().astype(np.int32)), pa.array(np.tile(np.arange(1, most + 1, dtype=np.int32), len(m)))], ["query_id", "q", "list", "nearness"])

        asked = queries.where(_usable(F.col("q"))).select(F.col("query_id").cast("long").alias("query_id"), F.col("q").cast("array<double>").alias("q"))
        return asked.mapInArrow(nearest, "query_id long, q array<double>, list int, nearness int")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None, own: bool = False, block: int = 4096) -> DataFrame:
        """query_id, id, score, rank: the k rows of largest cosine in each query's `probes` nearest lists, all lists without it.

        `where` is a condition on the payload. A query that finds fewer than k
        rows in its lists is asked again of all, so a filter that lets few rows
        through loses none of them. Lists meet their queries in blocks of about
        `block` on either side, so a list that holds a third of the vectors is
        many tasks. The query's own id is left out unless `own`.
        """
        probed = S.stored(self.probed(queries, probes), "probed")
        found = self._scored(probed, k, where, own, block)
        total = self.spark.read.parquet(f"{self.path}/centroids").count()
        if probes is not None and probes < total:
            found = S.stored(found, "found")
            enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
            asked = queries.join(enough, "query_id", "left_anti")
            again = S.stored(self.probed(asked, None), "probed-again")
            if not again.isEmpty():
                found = found.join(enough, "query_id", "left_semi").unionByName(self._scored(again, k, where, own, block))
        return found

    def _scored(self, probed: DataFrame, k: int, where: Column | None, own: bool, block: int) -> DataFrame:
        rows = self.lists() if where is None else self.lists().where(where)
        sizes = self.spark.read.parquet(f"{self.path}/centroids").select("list", "n")
        plan = probed.groupBy("list").agg(F.count("*").alias("asked")).join(sizes, "list")
        plan = plan.select("list", F.ceil(F.col("asked") / block).alias("qs"), F.greatest(F.ceil(F.col("n") / block), F.lit(1)).alias("vs"))
        plan = plan.collect()  # a row for each list at most
        if len(plan) < sizes.count():
            rows = rows.where(F.col("list").isin([r["list"] for r in plan]))
        plan = F.broadcast(self.spark.createDataFrame(plan, "list int, qs long, vs long"))
        split = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
        left = probed.join(plan, "list").select("list", F.pmod(F.xxhash64("query_id"), F.col("qs")).alias("qb"), F.explode(split(F.col("vs"))).alias("vb"), "query_id", "q")
        right = rows.select("list", "id", "v").join(plan, "list").select("list", F.explode(split(F.col("qs"))).alias("qb"), F.pmod(F.xxhash64("id"), F.col("vs")).alias("vb"), "id", "v")
        tiles = left.groupBy("list", "qb", "vb").cogroup(right.groupBy("list", "qb", "vb")).applyInPandas(tile_top_k(k, 6, own), "query_id long, id long, score double")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    def probes_for(self, target: float, k: int = 10, queries: int = 256) -> int:
        """How many lists must be probed so that of the exact k nearest of some sampled vectors the share `target` is found.

        The exact neighbours of about `queries` vectors, chosen by hashed id,
        are found in all lists; each lies in a list of some nearness to its query.
        """
        rows = self.lists().select("id", "v", "list")
        n = max(1, rows.count())
        asked = rows.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)) < queries).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        exact = self.search(asked, k).join(rows.select("id", "list"), "id")
        ranks = self.probed(asked, None).select("query_id", "list", "nearness")
        needed = exact.join(ranks, ["query_id", "list"]).agg(F.percentile("nearness", target)).first()[0]
        return max(1, int(np.ceil(needed or 1)))
