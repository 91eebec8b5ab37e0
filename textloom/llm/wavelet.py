"""Token-id shards as wavelet matrices (operator 9).

A shard holds the ids of consecutive documents as one bit-plane per bit of an
id, most significant first; after each plane the ids are reordered, those with
a 0 bit before those with a 1 bit, both in their old order. A plane is cut
into blocks that are deflated one by one; the file also has where each block
ends and how many ones come before it. So access, counting and occurrence
lookup inflate only the blocks they touch. A shard is one Parquet file of a
single row in the shared folder.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .storage import new_path

SHARD = "part int, seq int, n_docs int, n_tokens long, ids_of binary, ends binary, planes array<binary>, block_ends array<binary>, block_ranks array<binary>, zeros array<long>"
#: Ranges of doc_id at most, whose ends every task knows; beyond it ranges have more than `part_bytes` of text.
MOST_PARTS = 10_000
#: Bits of a block of a plane.
BLOCK = 1 << 15


def build(values: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes (packed, first element in the highest bit) and the zeros of each."""
    planes, zeros = [], []
    for b in range(bits - 1, -1, -1):
        one = (values >> b & 1).astype(bool)
        planes.append(np.packbits(one))
        zero = values[~one]
        zeros.append(len(zero))
        values = np.concatenate((zero, values[one]))
    return planes, zeros


class Plane:
    """A bit-plane in blocks: deflated bytes, the end of each block in them, and the ones before each block and in all."""

    def __init__(self, n: int, data: bytes, ends: np.ndarray, ranks: np.ndarray, keep: int = 64):
        self.n, self.data, self.ends, self.ranks, self.keep, self.open = n, data, ends, ranks, keep, {}

    @staticmethod
    def of(packed: np.ndarray, n: int) -> Plane:
        step = BLOCK // 8
        blocks = [packed[i : i + step] for i in range(0, len(packed), step)]
        deflated = [zlib.compress(b.tobytes(), 1) for b in blocks]
        ones = [int(np.bitwise_count(b).sum(dtype=np.int64)) for b in blocks]
        return Plane(n, b"".join(deflated), np.cumsum([len(d) for d in deflated], dtype=np.int64), np.concatenate(([0], np.cumsum(ones, dtype=np.int64))))

    def raw(self, block: int) -> bytes:
        return zlib.decompress(self.data[int(self.ends[block - 1]) if block else 0 : int(self.ends[block])])

    def _words(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        """The 64-bit words of a block and the ones before each; the blocks opened last stay open."""
        if block not in self.open:
            while len(self.open) >= self.keep:
                self.open.pop(next(iter(self.open)))
            words = np.zeros(BLOCK // 8 + 8, np.uint8)
            found = np.frombuffer(self.raw(block), np.uint8)
            words[: len(found)] = found
            words = words.view(">u8").astype(np.uint64)
            self.open[block] = words, np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
        return self.open[block]

    def rank1(self, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits."""
        block = np.minimum(at // BLOCK, max(len(self.ends) - 1, 0))
        out = self.ranks[block].copy()
        for b in np.unique(block) if len(self.ends) else ():
            mine = np.flatnonzero(block == b)
            inside = at[mine] - b * BLOCK
            words, before = self._words(int(b))
            word, bit = inside >> 6, (inside & 63).astype(np.uint64)
            top = np.where(bit == 0, np.uint64(0), words[word] >> (np.uint64(64) - np.maximum(bit, np.uint64(1))))
            out[mine] += before[word] + np.bitwise_count(top)
        return out

    def bits(self) -> np.ndarray:
        packed = np.frombuffer(b"".join(self.raw(b) for b in range(len(self.ends))), np.uint8)
        return np.unpackbits(packed, count=self.n).astype(bool)


@dataclass
class WaveletMatrix:
    """A shard: `n` ids under `planes`, and the zeros of each plane."""

    n: int
    planes: list[Plane]
    zeros: list[int]

    @staticmethod
    def of(values: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros = build(values, bits)
        return WaveletMatrix(len(values), [Plane.of(p, len(values)) for p in planes], zeros)

    @staticmethod
    def load(row) -> WaveletMatrix:
        n = row["n_tokens"]
        planes = [Plane(n, p, np.frombuffer(e, "<i8"), np.frombuffer(r, "<i8")) for p, e, r in zip(row["planes"], row["block_ends"], row["block_ranks"], strict=True)]
        return WaveletMatrix(n, planes, list(row["zeros"]))

    def rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones among the first `at` bits of a plane."""
        return self.planes[level].rank1(at)

    def select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """Positions of the nth (from 0) ones or zeros of a plane."""
        low, high = np.zeros(len(nth), np.int64), np.full(len(nth), self.n, np.int64)
        while (low < high).any():
            middle = (low + high) >> 1
            ones = self.rank1(level, middle + 1)
            enough = (ones if bit else middle + 1 - ones) > nth
            low, high = np.where(enough | (low >= high), low, middle + 1), np.where(enough & (low < high), middle, high)
        return low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some positions."""
        at = np.asarray(at, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level, zeros in enumerate(self.zeros):
            ones = self.rank1(level, at)
            bit = self.rank1(level, at + 1) - ones
            out = out << np.uint32(1) | bit.astype(np.uint32)
            at = np.where(bit == 1, zeros + ones, at - ones)
        return out

    def _range(self, value: int, start: int, stop: int) -> tuple[int, int]:
        ends = np.array([start, stop], np.int64)
        for level, zeros in enumerate(self.zeros):
            ones = self.rank1(level, ends)
            ends = zeros + ones if value >> (len(self.zeros) - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, value: int, start: int = 0, stop: int | None = None) -> int:
        """How often an id occurs among the positions start..stop-1."""
        if value >> len(self.zeros):
            return 0
        a, b = self._range(value, start, self.n if stop is None else stop)
        return b - a

    def occurrences(self, value: int) -> np.ndarray:
        """All positions of an id, ascending."""
        if value >> len(self.zeros):
            return np.empty(0, np.int64)
        a, b = self._range(value, 0, self.n)
        at = np.arange(a, b)
        for level in range(len(self.zeros) - 1, -1, -1):
            bit = value >> (len(self.zeros) - 1 - level) & 1
            at = self.select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def all(self) -> np.ndarray:
        """Every id in order: the planes are undone from the last to the first."""
        values = np.zeros(self.n, np.uint32)
        for level in range(len(self.zeros) - 1, -1, -1):
            one = self.planes[level].bits()
            back = np.empty_like(values)
            back[~one] = values[: self.zeros[level]]
            back[one] = values[self.zeros[level] :] | np.uint32(1 << (len(self.zeros) - 1 - level))
            values = back
        return values


def _packed(ids: np.ndarray, doc_ids: pa.Array, ends: np.ndarray, part: int, seq: int, bits: int) -> pa.RecordBatch:
    matrix = WaveletMatrix.of(ids, bits)
    known = np.asarray(doc_ids.is_valid())
    table = np.stack([doc_ids.fill_null(0).to_numpy(), known.astype(np.int64)], 1)
    row = {
        "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(doc_ids)], pa.int32()), "n_tokens": pa.array([len(ids)], pa.int64()),
        "ids_of": pa.array([zlib.compress(table.tobytes(), 1)], pa.binary()), "ends": pa.array([zlib.compress(ends.astype("<i8").tobytes(), 1)], pa.binary()),
        "planes": pa.array([[p.data for p in matrix.planes]], pa.list_(pa.binary())),
        "block_ends": pa.array([[p.ends.astype("<i8").tobytes() for p in matrix.planes]], pa.list_(pa.binary())),
        "block_ranks": pa.array([[p.ranks.astype("<i8").tobytes() for p in matrix.planes]], pa.list_(pa.binary())),
        "zeros": pa.array([matrix.zeros], pa.list_(pa.int64())),
    }
    return pa.RecordBatch.from_pydict(row)


def encoded(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[int], text: str = "text", null_parts: int = 1) -> DataFrame:
    """part, doc_id, ids (little-endian, 2 or 4 bytes each) of whole texts; part tells between which bounds the doc_id lies, nulls in the first `null_parts`.

    A doc_id that is several bounds in a row has as many parts more, and its
    rows are dealt to these in turn, as those without id are to theirs.
    """

    def encode(batches):
        encoder = tokens.word_bpe(tokenizer)
        kind = np.dtype("<u2" if id_bits(encoder, end_id) <= 16 else "<u4")
        end = np.array([end_id], kind).tobytes()
        dealt = 0
        for batch in batches:
            for piece in tokens.slices(batch, "_text", tokens.ENCODER_SLICE):
                found, starts = encoder.encode(piece["_text"])
                raw = memoryview(found.astype(kind).tobytes())
                ids = [raw[a * kind.itemsize : b * kind.itemsize].tobytes() + end for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                known = np.asarray(piece["doc_id"].is_valid())
                own = piece["doc_id"].fill_null(0).to_numpy()
                low, high = (np.where(known, np.searchsorted(bounds, own, side) + null_parts, end_part) for side, end_part in (("left", 0), ("right", null_parts - 1)))
                part = low + np.arange(dealt, dealt + len(own)) % (high - low + 1)
                dealt += len(own)
                yield pa.record_batch([pa.array(part.astype(np.int32)), piece["doc_id"], pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")).mapInArrow(encode, "part int, doc_id long, ids binary")


def id_bits(encoder: tokens.WordBpe, end_id: int) -> int:
    return max(1, int(max(encoder.tokenizer.get_vocab_size() - 1, end_id)).bit_length())


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, text: str = "text", shard_tokens: int = 1 << 20, path: str | None = None, part_bytes: int = 1 << 25) -> str:
    """Encode whole texts and write shards in ascending doc_id order; returns their folder.

    Documents are dealt by ranges of doc_id (nulls first) of about `part_bytes`
    of text and sorted within each range, so the order of (part, seq) is the
    order of doc_id; ids travel, not texts. Rows of a repeated id stay next to
    each other, in any order; an id, or rows without one, that fill more than a
    range are dealt to several. A null or empty text has the end id only, very
    long texts are encoded whole, an empty table makes an empty folder. A shard
    closes at `shard_tokens` ids or where its range ends; a document is never
    split, so a longer one makes a longer shard. Other columns aren't read.
    """
    spark = docs.sparkSession
    path = path or new_path(spark, "token-shards")
    sums = docs.agg(F.sum(F.octet_length(text).cast("long")), F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    n_bytes, n_rows, n_null = (x or 0 for x in sums)
    parts = min(MOST_PARTS, max(1, -(-n_bytes // part_bytes)))
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)] or [1.0], 100 * parts)).first()[0] or []
    bounds = sorted(int(c) for c in cuts) if parts > 1 else []
    null_parts = max(1, parts * n_null // max(1, n_rows))

    def shards(batches):
        encoder = tokens.word_bpe(tokenizer)
        bits = id_bits(encoder, end_id)
        kind = np.dtype("<u2" if bits <= 16 else "<u4")
        held: list[pa.RecordBatch] = []
        n, part, seq = 0, None, 0

        def closed():
            raw = b"".join(b"".join(x["ids"].to_pylist()) for x in held)
            sizes = np.concatenate([pc.binary_length(x["ids"]).to_numpy() for x in held])
            return _packed(np.frombuffer(raw, kind), pa.concat_arrays([x["doc_id"] for x in held]), np.cumsum(sizes) // kind.itemsize, part, seq, bits)

        for batch in batches:
            which = batch["part"].to_numpy()
            ends = np.cumsum(pc.binary_length(batch["ids"]).to_numpy().astype(np.int64)) // kind.itemsize
            a = 0
            while a < batch.num_rows:
                if which[a] != part:
                    if held:
                        yield closed()
                    held, n, part, seq = [], 0, int(which[a]), 0
                last = int(np.searchsorted(which, part, "right"))
                base = int(ends[a - 1]) if a else 0
                b = min(last, max(a + 1, int(np.searchsorted(ends, base + shard_tokens - n, "right"))))
                held.append(batch.slice(a, b - a))
                n += int(ends[b - 1]) - base
                if n >= shard_tokens or b < last:
                    yield closed()
                    held, n, seq = [], 0, seq + 1
                a = b
        if held:
            yield closed()

    ids = encoded(docs, tokenizer, end_id, bounds, text, null_parts)
    ordered = ids.repartition("part").sortWithinPartitions("part", "doc_id")
    ordered.mapInArrow(shards, SHARD).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)
    return path


def open_shard(row) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """Documents (id, known), the end of each, and the matrix, from a shard's row as a dict."""
    docs = np.frombuffer(zlib.decompress(row["ids_of"]), np.int64).reshape(-1, 2)
    return docs, np.frombuffer(zlib.decompress(row["ends"]), "<i8"), WaveletMatrix.load(row)


def shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard: (part, seq, first). Sums run per part, then over parts."""
    rows = spark.read.schema(SHARD).parquet(path).select("part", "seq", "n_tokens")
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_t"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part, not for each document
    sums = sums.select("part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_in", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(sums, "part").select("part", "seq", (F.col("_base") + F.col("_in")).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the shard files."""

    def documents(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("planes", "block_ends", "block_ranks", "ids_of", "ends", "n_tokens", "zeros", "part", "seq")}
                docs, ends, matrix = open_shard(row)
                raw = memoryview(matrix.all().astype("<u4").tobytes())
                starts = np.concatenate(([0], ends[:-1]))
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                n = len(docs)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(docs[:, 0], mask=docs[:, 1] == 0), "part": pa.array(np.full(n, row["part"], np.int32)), "seq": pa.array(np.full(n, row["seq"], np.int32)),
                    "at": pa.array(starts.astype(np.int64)), "n_tokens": pa.array((ends - starts).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64()),
                })

    shards = spark.read.schema(SHARD).parquet(path)
    rows = shards.mapInArrow(documents, "doc_id long, part int, seq int, at long, n_tokens long, ids_crc32 long")
    return rows.join(shard_starts(spark, path), ["part", "seq"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def count_token(spark: SparkSession, path: str, token: int) -> DataFrame:
    """(part, seq, n): occurrences of an id in each shard; two blocks of each plane are inflated."""

    def counted(batches):
        for batch in batches:
            rows = [{c: batch[c][i].as_py() for c in batch.schema.names} for i in range(batch.num_rows)]
            n = [WaveletMatrix.load(r).count(token) for r in rows]
            yield pa.record_batch([batch["part"], batch["seq"], pa.array(n, pa.int64())], ["part", "seq", "n"])

    return spark.read.schema(SHARD).parquet(path).select("part", "seq", "n_tokens", "planes", "block_ends", "block_ranks", "zeros").mapInArrow(counted, "part int, seq int, n long")
