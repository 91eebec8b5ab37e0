"""Exact nearest neighbours by a block matrix join with int8 tiles (operator 5).

Queries and candidates are quantised to int8 and packed into blocks; each pair
of blocks is a tile. A tile multiplies int8 matrices and bounds the error that
quantisation makes in each product. Pairs whose upper bound reaches the k-th
best lower bound of their query survive; only for them are the original
vectors fetched and multiplied in double precision. Heaps of k per query are
merged within tasks before the shuffle and again after it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch, staged

#: Of an int8 vector: its scale, the lengths of the original and of the quantised vector, and that of their difference.
STATS = ("scale", "norm", "norm8", "error")
CODES = "id long, dim int, code binary, " + ", ".join(f"{s} double" for s in STATS)
BLOCK = "dim int, block int, ids binary, codes binary, " + ", ".join(f"{s} binary" for s in STATS)
FOUND = "query_id long, vec_id long, score double"
#: Dimensions whose int8 products float32 adds up exactly: 127 * 127 * 1024 < 2**24.
EXACT_DIMS = 1024


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v): finite vectors that aren't zero, one per id.

    Rows with a null id, or a vector that is null, empty, zero or holds a null
    or non-finite component take no part. Rows that repeat an id count once,
    with the smallest vector in array order. Other columns aren't read.
    """
    v = F.col(vector_col)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & fine)
    return kept.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def quantise(v: np.ndarray) -> tuple[np.ndarray, ...]:
    """int8 rows of a matrix and their STATS."""
    scale = np.abs(v).max(axis=1) / 127
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(scale[:, None] > 0, np.rint(v / scale[:, None]), 0)
    back = whole * scale[:, None]
    return whole.astype(np.int8), scale, np.linalg.norm(v, axis=1), np.linalg.norm(back, axis=1), np.linalg.norm(v - back, axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows of any width, in double precision."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, d : d + EXACT_DIMS].astype(np.float32) @ b[:, d : d + EXACT_DIMS].astype(np.float32).T
    return out


def tile(query_ids: np.ndarray, queries: tuple, ids: np.ndarray, vectors: tuple, k: int, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(query, vector, lower bound, upper bound) of the tile's pairs that can be among the k best of their query; a query isn't paired with itself."""
    q8, q_scale, q_norm, _, q_error = queries
    v8, v_scale, v_norm, v_norm8, v_error = vectors
    for a in range(0, len(q8), rows):
        s = slice(a, min(a + rows, len(q8)))
        about = products(q8[s], v8) * np.outer(q_scale[s], v_scale)
        # |<q,v> - <q',v'>| <= |q| |v - v'| + |q - q'| |v'|, with room for rounding in double precision
        error = np.outer(q_norm[s], v_error + 1e-12 * v_norm) + np.outer(q_error[s], v_norm8)
        about[query_ids[s, None] == ids[None, :]] = -np.inf
        low = about - error
        floor = np.partition(low, -k, axis=1)[:, -k] if len(ids) > k else np.full(len(low), -np.inf)
        i, j = np.nonzero((about + error >= floor[:, None]) & (about > -np.inf))
        yield query_ids[s][i], ids[j], low[i, j], (about + error)[i, j]


def coded(clean: DataFrame) -> DataFrame:
    """Quantised rows, before any shuffle."""

    def code(batches):
        for batch in batches:
            dims, at = batch["dim"].to_numpy(), batch["v"].offsets.to_numpy()
            flat = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            at = at - at[0]
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                for part in np.array_split(mine, -(-len(mine) * int(dim) // (1 << 21))):
                    whole, *stats = quantise(flat[at[part][:, None] + np.arange(dim)])
                    raw = memoryview(whole.tobytes())
                    codes = [raw[i * dim : (i + 1) * dim].tobytes() for i in range(len(part))]
                    yield pa.record_batch([batch["id"].take(pa.array(part)), pa.array(np.full(len(part), dim, np.int32)), pa.array(codes, pa.binary()), *map(pa.array, stats)], ["id", "dim", "code", *STATS])

    return clean.select("id", F.size("v").alias("dim"), "v").mapInArrow(code, CODES)


def packed(codes: DataFrame, blocks: int, salt: int) -> DataFrame:
    """Rows dealt evenly to blocks by hashed id; a block is one row of ids, an int8 matrix and its stats."""

    def one(key, table):
        row = {"dim": key[0].as_py(), "block": key[1].as_py(), "ids": table["id"].to_numpy().tobytes(), "codes": b"".join(table["code"].to_pylist())}
        row |= {s: table[s].to_numpy().tobytes() for s in STATS}
        return pa.Table.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("block", pa.int32()), *((n, pa.binary()) for n in ("ids", "codes", *STATS))]))

    block = F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(blocks)).cast("int").alias("block")
    return codes.select("*", block).groupBy("dim", "block").applyInArrow(one, BLOCK)


def _side(table: pa.Table) -> tuple[np.ndarray, tuple]:
    ids = np.frombuffer(table["ids"][0].as_py(), np.int64)
    codes = np.frombuffer(table["codes"][0].as_py(), np.int8).reshape(len(ids), -1)
    return ids, (codes, *(np.frombuffer(table[s][0].as_py(), np.float64) for s in STATS))


def _likely(k: int):
    """Rows whose upper bound reaches the k-th best lower bound that the task has seen of their query."""

    def likely(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[float]] = {}
        for pdf in frames:
            for q, low in zip(pdf["query_id"].tolist(), pdf["low"].tolist(), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, low)
                elif low > heap[0]:
                    heapq.heapreplace(heap, low)
            floor = np.array([heap[0] if len(heap := heaps[q]) == k else -np.inf for q in pdf["query_id"].tolist()])
            yield pdf[pdf["high"].to_numpy() >= floor]

    return likely


def _merge(k: int, ranked: bool):
    """Keep a heap of k per query over all rows of a task."""

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for pdf in frames:
            for q, v, s in zip(pdf["query_id"].tolist(), pdf["vec_id"].tolist(), pdf["score"].tolist(), strict=True):
                heap = heaps.setdefault(q, [])
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                elif (s, -v) > heap[0]:
                    heapq.heapreplace(heap, (s, -v))
        rows = [(q, i + 1, -v, s) for q, heap in heaps.items() for i, (s, v) in enumerate(sorted(heap, reverse=True))]
        pdf = pd.DataFrame(rows, columns=["query_id", "rank", "vec_id", "score"])
        yield pdf.astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "float64"}) if ranked else pdf.drop(columns="rank").astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return merge


def _scores(batches):
    """Inner products of the original vectors in double precision, summed from the first component to the last."""
    for batch in batches:
        dims = pc.list_value_length(batch["q"]).to_numpy()
        sides = [(batch[c].flatten().to_numpy(zero_copy_only=False).astype(np.float64), batch[c].offsets.to_numpy() - batch[c].offsets[0].as_py()) for c in ("q", "v")]
        sums = np.zeros(batch.num_rows)
        for dim in np.unique(dims):
            mine = np.flatnonzero(dims == dim)
            (q, q_at), (v, v_at) = ((flat, at[:-1][mine]) for flat, at in sides)
            for d in range(int(dim)):
                sums[mine] += q[q_at + d] * v[v_at + d]
        yield pa.record_batch([batch["query_id"], batch["vec_id"], pa.array(sums)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, is_query, k: int = 20, query_block: int = 4096, vector_block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k candidates of largest inner product for each query: query_id, rank, vec_id, score.

    `is_query` is a condition on `id`. Every usable vector but the query's own
    is a candidate; vectors of different length take no part with each other.
    Fewer candidates than k give them all; ties go to the smaller id, also where
    they are in different tiles. Vectors may be of any width. An empty table
    gives an empty result.
    """
    with Scratch(vectors.sparkSession) as scratch:
        clean = scratch.staged(usable(vectors, id_col, vector_col), "vectors")
        sizes = clean.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q")).first()
        query_blocks, vector_blocks = max(1, -(-sizes["q"] // query_block)), max(1, -(-sizes["n"] // vector_block))
        codes = scratch.staged(coded(clean), "codes")
        left = packed(codes.where(is_query), query_blocks, 1).select("*", F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))).alias("other"))
        right = packed(codes, vector_blocks, 2).select("*", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("other"))

        def one(q, v):
            names, kinds = ["query_id", "vec_id", "low", "high"], [pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            found = list(tile(*_side(q), *_side(v), k)) if len(q) and len(v) else []
            columns = [np.concatenate(c) for c in zip(*found, strict=True)] or [[]] * 4
            return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

        bounds = "query_id long, vec_id long, low double, high double"
        tiles = left.groupBy("dim", F.col("block").alias("qb"), F.col("other").alias("vb")).cogroup(right.groupBy("dim", F.col("other").alias("qb"), F.col("block").alias("vb"))).applyInArrow(one, bounds)
        best = Window.partitionBy("query_id").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        pairs = tiles.mapInPandas(_likely(k), bounds).withColumn("floor", F.nth_value("low", k).over(best)).where("floor IS NULL OR high >= floor")
        pairs = pairs.select("query_id", "vec_id").join(clean.select(F.col("id").alias("vec_id"), "v"), "vec_id").join(clean.where(is_query).select(F.col("id").alias("query_id"), F.col("v").alias("q")), "query_id")
        scored = pairs.select("query_id", "vec_id", "q", "v").mapInArrow(_scores, FOUND)
        return staged(scored.mapInPandas(_merge(k, False), FOUND).repartition("query_id").mapInPandas(_merge(k, True), "query_id long, rank int, vec_id long, score double"), "nearest")
