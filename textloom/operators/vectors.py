"""Vector search and quantisation over tables of vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def top_k(vectors: DataFrame, query: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", where: Column | None = None, least: float | None = None) -> DataFrame:
    """The k rows of largest cosine for a single query vector (`query` has one row, column `q`).

    The filter goes before the search and so reaches the scan; the result is
    a distributed top-k, not a sort.
    """
    rows = vectors if where is None else vectors.where(where)
    one = query.select("q").limit(1)
    scored = rows.join(F.broadcast(one)).select(id_col, F.round(V.cosine(F.col(vector_col), F.col("q")), 6).alias("score"))
    scored = scored if least is None else scored.where(F.col("score") >= least)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


#: Tells for groups of queries and of vectors which pairs count: a boolean matrix.
Keep = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]


def tile_top_k(k: int, digits: int, own: bool, keep: Keep | None = None):
    """Function of two groups, queries (query_id, q) and vectors (id, v): each query's k vectors of largest cosine among those that `keep` has for it."""

    def tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids = b["id"].to_numpy(np.int64)
            cand = _unit(np.array(b["v"].tolist(), np.float64))
            asks, names = _unit(np.array(a["q"].tolist(), np.float64)), a["query_id"].to_numpy(np.int64)
            for i in range(0, len(asks), 256):
                score = np.round(asks[i : i + 256] @ cand.T, digits)
                if keep is not None:
                    score[~keep(a.iloc[i : i + 256], b)] = -np.inf
                if not own:
                    score[names[i : i + 256, None] == ids[None, :]] = -np.inf
                for r, row in enumerate(score):
                    top = np.lexsort((ids, -row))[:k] if len(row) <= 4 * k else (lambda c: c[np.lexsort((ids[c], -row[c]))][:k])(np.flatnonzero(row >= np.partition(row, -k)[-k]))
                    top = top[row[top] > -np.inf]
                    out.append(pd.DataFrame({"query_id": names[i + r], "id": ids[top], "score": row[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.empty(0, np.int64), "id": np.empty(0, np.int64), "score": np.empty(0)})

    return tile


def batch_top_k(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096, digits: int = 6, own: bool = False, keep: Keep | None = None) -> DataFrame:
    """query_id, id, score, rank: the k rows of largest cosine for each of many queries, but for the query's own id unless `own`.

    `queries` is (query_id, q) and `vectors` (id, v). Both are dealt to blocks
    by hashed id and each pair of blocks is one matrix product in a task, so
    neither side is broadcast or gathered; tiles return k rows per query. Rows
    with a null vector are skipped; ties go to the smaller id. Either side may
    have more columns, which `keep` can tell from which pairs count.
    """
    queries, vectors = queries.where("q IS NOT NULL"), vectors.where("v IS NOT NULL")
    n_q, n_v = queries.count(), vectors.count()
    q_blocks, v_blocks = max(1, -(-n_q // block)), max(1, -(-n_v // block))
    left = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(v_blocks - 1).cast("long"))).alias("vb"), *queries.columns)
    right = vectors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("id"), F.lit(v_blocks)).alias("vb"), *vectors.columns)
    tiles = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInPandas(tile_top_k(k, digits, own, keep), "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return tiles.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def int8_range(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """One row: low, high and scale over all components; a constant table has scale 1."""
    ends = vectors.select(F.array_min(V.as_double(F.col(vector_col))).alias("a"), F.array_max(V.as_double(F.col(vector_col))).alias("b")).agg(F.min("a").alias("low"), F.max("b").alias("high"))
    return ends.withColumn("scale", F.when(F.col("high") > F.col("low"), (F.col("high") - F.col("low")) / 255).otherwise(1.0))


def int8_quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, code, low, scale with one range for the whole table."""
    ranged = vectors.join(F.broadcast(int8_range(vectors, vector_col)))
    return ranged.select(id_col, V.int8_code(F.col(vector_col), F.col("low"), F.col("scale")).alias("code"), "low", "scale")


def quantisation_metrics(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """A row per kind of code: n, original and quantised size in MB, and how many times smaller it is."""
    size = F.sum(F.size(vector_col).cast("long"))
    sums = vectors.where(F.col(vector_col).isNotNull()).agg(F.count("*").alias("n"), (size * 4).alias("original"), F.sum(F.ceil(F.size(vector_col) / 8)).alias("binary"), size.alias("int8"))
    rows = sums.select("n", "original", F.explode(F.create_map(F.lit("binary"), F.col("binary"), F.lit("int8"), F.col("int8"))).alias("kind", "bytes"))
    mb = lambda c: F.round(F.col(c) / 1048576.0, 6)
    return rows.select("kind", "n", mb("original").alias("original_mb"), mb("bytes").alias("quantized_mb"), F.round(F.try_divide("original", "bytes"), 6).alias("ratio"))


def hamming_rescored(vectors: DataFrame, query: DataFrame, k: int, oversample: float = 3.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Candidates by Hamming distance of binary codes (k times `oversample`), ranked by exact cosine."""
    one = query.select("q", V.binary_code(F.col("q")).alias("qc")).limit(1)
    near = vectors.join(F.broadcast(one)).withColumn("distance", V.hamming(V.binary_code(F.col(vector_col)), F.col("qc"))).orderBy("distance", id_col).limit(int(k * oversample))
    return near.select(id_col, F.col("distance").cast("long"), F.round(V.cosine(F.col(vector_col), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def retention(exact: DataFrame, approximate: DataFrame, k: int) -> DataFrame:
    """Share (percent) of exact top-k results that the approximate ones keep."""
    queries = exact.select("query_id").distinct().agg(F.count("*").alias("n"))
    both = exact.select("query_id", "id").join(approximate.select("query_id", "id"), ["query_id", "id"]).agg(F.count("*").alias("hits"))
    return both.join(F.broadcast(queries)).select(F.round(F.try_divide(F.col("hits") * 100.0, F.col("n") * k), 6).alias("retention"), "n")


def label_similarity(vectors: DataFrame, label: str = "label", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Average cosine of distinct pairs within and across labels, from sums of unit vectors.

    The sum over all pairs of a set is the squared length of its vector sum,
    so no pair is made: one aggregation per label and dimension.
    """
    unit = vectors.select(label, F.posexplode(V.normalize(F.col(vector_col))).alias("i", "x"))
    sums = unit.groupBy(label, "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("own"), F.count("*").alias("n"))
    per = sums.groupBy(label).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("own").alias("own"), F.max("n").alias("n"))
    all_ = sums.groupBy("i").agg(F.sum("s").alias("s"), F.sum("own").alias("own"), F.sum("n").alias("n")).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("own").alias("own"), F.max("n").alias("n"))
    intra = per.agg(F.sum(F.col("ss") - F.col("own")).alias("within"), F.sum(F.col("n") * (F.col("n") - 1)).alias("pairs_within"))
    both = intra.join(F.broadcast(all_))
    return both.select(F.round(F.try_divide("within", F.col("pairs_within")), 6).alias("intra"), F.round(F.try_divide(F.col("ss") - F.col("own") - F.col("within"), F.col("n") * (F.col("n") - 1) - F.col("pairs_within")), 6).alias("inter"))
