"""Late interaction over a corpus: a text is many token vectors, and a query meets it token by token.

Tokens are kept in lists around centroids, with the documents of each list
apart. A query's tokens look for their nearest tokens in the nearest lists; the
documents of these are ranked by them, and the best are scored exactly: for
every query token its best cosine with a token of the document, summed.

No row is made for a query token and a token that is near it, of which there
are as many as the product of both sides. Samples tell about where the score of
a token's last near one lies, and then the gain of a query's last chosen
document; one pass over all each counts what is above and keeps what is close,
which gives them exactly, and few documents of a query leave a tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import vectors as V
from ..sources import stored as S
from .vector_index import IvfIndex, _usable

#: Tokens of a document in a row of the table that exact scores are worked out from.
TOKENS_A_ROW = 128
#: Tokens of queries and of documents that meet in a task, about.
QUERY_TILE, DOC_TILE = 4096, 8192
#: Documents of more tokens than this are scored row by row.
LONG = 1 << 17
#: Tokens of documents whose scores a task counts for a tile of queries, about; keys that a task picks from, about.
COUNT_TILE, COUNTS = 1 << 15, 1 << 22
#: Tokens up to which there is no sample; tokens and documents of a sample, about; standard deviations (and keys) to either side of what it tells.
DIRECT, SAMPLE, SAMPLE_DOCS, SPREAD = 1 << 14, 1 << 16, 1 << 13, 5
#: Query tokens and tokens that are multiplied at once, about; tokens of a document that isn't met by a loop; tokens that are worth a tile of their own.
ASKS, CHUNK, SHORT, MANY = 64, 2048, 32, 1024
#: Scores are compared as whole millionths.
UNITS = 1_000_000


def _unit(rows: list) -> np.ndarray:
    m = np.array(rows, np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _usable_tokens(queries: DataFrame) -> DataFrame:
    usable = queries.where(_usable(F.col("q")))
    return usable.select(F.col("query_id").cast("long").alias("query_id"), F.col("place").cast("long").alias("place"), F.col("q").cast("array<double>").alias("q"))


@F.arrow_udf(ArrayType(DoubleType()))
def _best_cosines(queries: pa.Array, tokens: pa.Array) -> pa.Array:
    """Of each row's query tokens, the best cosine with one of the row's document tokens."""
    out, last, ready = [], None, None
    for q, t in zip(queries, tokens, strict=True):
        asked = q.as_py()
        if asked != last:  # rows of one query follow each other
            last, ready = asked, _unit(asked)
        out.append((ready @ _unit(t.as_py()).T).max(axis=1).tolist())
    return pa.array(out, pa.list_(pa.float64()))


def _tokens_of(rows: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of all tokens, and of each the number of its row."""
    rows = rows.combine_chunks()
    tokens = rows.flatten()
    m = tokens.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(tokens), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n), np.repeat(np.arange(len(rows)), np.diff(rows.offsets.to_numpy()))


def _tile(k: int, chosen: bool):
    """Function of queries (query_id, qs, docs) and rows of documents (doc_id, vs): each query's k best documents, of those in `docs` if they are chosen."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if len(left) and len(right):
            right = right.sort_by("doc_id")
            ids, names = right["doc_id"].to_numpy(), left["query_id"].to_numpy()
            tokens, row = _tokens_of(right["vs"])
            owner = ids[row]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            ids = owner[first]
            asks, query = _tokens_of(left["qs"])
            score = np.zeros((len(names), len(ids)))
            for i in range(0, len(asks), 256):
                best = np.maximum.reduceat(asks[i : i + 256] @ tokens.T, first, axis=1)
                own = query[i : i + 256]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                score[own[starts]] += np.add.reduceat(best, starts, axis=0)
            score = np.round(score, 6)
            if chosen:
                wanted = left["docs"].combine_chunks()
                allowed = np.zeros(score.shape, bool)
                docs = wanted.flatten().to_numpy()
                at = np.minimum(np.searchsorted(ids, docs), len(ids) - 1)
                of = np.repeat(np.arange(len(names)), np.diff(wanted.offsets.to_numpy()))
                allowed[of[ids[at] == docs], at[ids[at] == docs]] = True
                score[~allowed] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :k]  # documents ascend
            best = np.take_along_axis(score, top, 1)
            found = np.repeat(names, top.shape[1]), ids[top.ravel()], best.ravel()
            found = tuple(c[found[2] > -np.inf] for c in found)
        return pa.table(list(map(pa.array, found)), ["query_id", "doc_id", "score"])

    return tile


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    """Unit vectors of a column of arrays."""
    column = column.combine_chunks()
    m = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def _met(held, probes: int, nearest: int):
    """Function of batches (..., q): a bit for each list that a query token meets, its nearest ones, or all if these have fewer than `nearest` tokens, and how many tokens these lists have."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sizes = held.value
        for batch in batches:
            asks = _vectors(pa.chunked_array([batch["q"]])) if len(batch) else np.empty((0, unit.shape[1]))
            order = np.argsort(-(asks @ unit.T), axis=1, kind="stable")[:, :probes]
            met = np.zeros((len(asks), len(unit)), bool)
            np.put_along_axis(met, order, True, 1)
            met[sizes[order].sum(axis=1) < nearest] = True
            bits = pa.array([row.tobytes() for row in np.packbits(met, axis=1)], pa.binary())
            yield pa.record_batch([*batch.columns, bits, pa.array(met @ sizes, pa.int64())], [*batch.schema.names, "met", "among"])

    return add


def _unmet(bits: pa.ChunkedArray, lists: int) -> np.ndarray:
    """A row for each list and a column for each query token: what to add to a score, so that none counts where the two don't meet."""
    packed = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1)
    return np.where(np.unpackbits(packed, axis=1, count=lists).T, 0.0, -4.0)


def _millionths(scores: np.ndarray) -> np.ndarray:
    return np.rint(scores * UNITS).astype(np.int64)


def _lists_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], kind))


def _bracket(keys: np.ndarray, n: int, among: int, bottom: int, top: int, spread: float) -> tuple[int, int]:
    """Of a sample, largest first, two keys between which the n-th largest of all `among` keys lies, but for what `spread` standard deviations leave."""
    if n > among:
        return bottom, bottom
    share = n / among
    around = spread * (len(keys) * share * (1 - share)) ** 0.5 + spread
    first, last = math.floor(len(keys) * share - around), math.ceil(len(keys) * share + around)
    low = max(bottom, int(keys[last - 1])) if last <= len(keys) else bottom
    return low, max(low, int(keys[first - 1])) if first >= 1 else top


def _nth(keys: np.ndarray, above: int, n: int, low: int, bottom: int, top: int) -> int | None:
    """The n-th largest of `above` keys and these, which are all from `low` to where the others begin; `bottom` if there are fewer, `top` for none; None if it isn't among these."""
    need = n - above
    if 1 <= need <= len(keys):
        return int(np.partition(keys, len(keys) - need)[len(keys) - need])
    return top if n < 1 else bottom if need >= 1 and low <= bottom else None


def _items(rows: pa.Table) -> Iterator[tuple[int, Callable[[str], np.ndarray]]]:
    """Of rows with an item: each item, and a function that gives a column of its rows, joined if these are lists."""
    rows = rows.sort_by("item")
    names = rows["item"].to_numpy()
    ends = np.flatnonzero(np.concatenate((names[1:] != names[:-1], [True]))) + 1 if len(names) else []
    columns = {}
    for c in rows.column_names:
        x = rows[c].combine_chunks()
        nested = pa.types.is_list(x.type)
        columns[c] = (x.flatten() if nested else x).to_numpy(), np.concatenate(([0], np.cumsum(x.value_lengths().to_numpy()))) if nested else np.arange(len(x) + 1)
    for a, b in zip([0, *ends], ends):
        yield int(names[a]), lambda c, a=a, b=b: columns[c][0][columns[c][1][a] : columns[c][1][b]]


def _sampled_floors(lists: int, nearest: int):
    """Function of query tokens (item, q, met, among) and sampled tokens (list, v): between which keys the one of the last near token lies."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        items, ranges = left["item"].to_numpy(), []
        if len(left) and len(right):
            asks, tokens, at, among = _vectors(left["q"]), _vectors(right["v"]), right["list"].to_numpy(), left["among"].to_numpy()
            for i in range(0, len(asks), ASKS):
                unmet = _unmet(left["met"].slice(i, ASKS), lists)
                keys = asks[i : i + ASKS] @ tokens.T
                keys += unmet.T[:, at]
                keys.sort(axis=1)
                for row, n in zip(keys, among[i : i + ASKS]):
                    seen = row[np.searchsorted(row, -2.0) :][::-1]
                    ranges.append(_bracket(np.rint(seen * UNITS), nearest, int(n), -UNITS, UNITS, SPREAD))
        else:
            ranges = [(-UNITS, UNITS)] * len(items)
        low, high = zip(*ranges) if ranges else ((), ())
        return pa.table([pa.array(items, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["item", "low", "high"])

    return tile


def _keys_between(lists: int):
    """Function of query tokens (item, q, met, low, high) and tokens (list, v): how many met tokens have keys above `high`, and the keys between those ends."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        items, low, high = (left[c].to_numpy() for c in ("item", "low", "high"))
        counts, found = [], []
        if len(left) and len(right):
            right = right.sort_by("list")
            asks, tokens, at = _vectors(left["q"]), _vectors(right["v"]), right["list"].to_numpy()
            for i in range(0, len(asks), ASKS):
                some = slice(i, i + ASKS)
                each, unmet = np.ascontiguousarray(asks[some].T), _unmet(left["met"].slice(i, ASKS), lists)
                least, most, n = (low[some] - 0.75) / UNITS, (high[some] + 0.75) / UNITS, each.shape[1]
                above, owners, keys = np.zeros(n, np.int64), [], []
                for j in range(0, len(tokens), CHUNK):
                    scores = tokens[j : j + CHUNK] @ each
                    scores += unmet[at[j : j + CHUNK]]
                    over = scores > most
                    inside = scores >= least
                    inside ^= over
                    above += over.sum(axis=0)
                    here = np.flatnonzero(inside)
                    owners.append((here % n).astype(np.int16))
                    keys.append(scores.ravel()[here])
                owner, key = np.concatenate(owners), _millionths(np.concatenate(keys))
                above += np.bincount(owner[key > high[some][owner]], minlength=n)
                kept = (key >= low[some][owner]) & (key <= high[some][owner])
                owner, key = owner[kept], key[kept].astype(np.int32)
                counts.append(above)
                found += np.split(key[np.argsort(owner, kind="stable")], np.cumsum(np.bincount(owner, minlength=n))[:-1])
        else:
            items, low = items[:0], low[:0]
        return pa.table([pa.array(items, pa.int64()), pa.array(low, pa.int64()), pa.array(np.concatenate(counts) if counts else [], pa.int64()), _lists_of(found, pa.int32())], ["item", "low", "above", "keys"])

    return tile


def _floors(nearest: int):
    """Function of rows (item, low, above, keys): the key of each item's last near token, null if it isn't between the ends."""

    def settle(rows: pa.Table) -> pa.Table:
        found = [(item, _nth(of("keys"), int(of("above").sum()), nearest, int(of("low")[0]), -UNITS, UNITS)) for item, of in _items(rows)]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["item", "floor"])

    return settle


class _Documents:
    """Tokens of a tile's documents, laid out in chunks in which each document's largest value is found without a loop over documents, unless they are long."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by("doc_id")
        owner = rows["doc_id"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        lengths = np.diff(np.concatenate((starts, [len(owner)])))
        self.ids, self.at = owner[starts], rows["at"].to_numpy()[starts]
        tokens, lists = _vectors(rows["v"]), rows["list"].to_numpy()
        self.chunks, order, i = [], np.argsort(-lengths, kind="stable"), 0
        while i < len(order):
            most = int(lengths[order[i]])
            docs = order[i : i + max(1, CHUNK // most)]
            i += len(docs)
            if most <= SHORT:  # first tokens of all, then second ones, and so on
                parts = [starts[docs[: np.count_nonzero(lengths[docs] > j)]] + j for j in range(most)]
            else:
                parts = [np.arange(starts[d], starts[d] + lengths[d]) for d in docs]
            places = np.concatenate(parts)
            self.chunks.append((docs, tokens[places], lists[places], list(map(len, parts)), most <= SHORT))

    @staticmethod
    def best(values: np.ndarray, parts: list[int], short: bool) -> np.ndarray:
        """A row for each document of a chunk: the largest of its rows."""
        if not short:
            return np.stack([x.max(axis=0) for x in np.split(values, np.cumsum(parts)[:-1])])
        out, done = values[: parts[0]].copy(), parts[0]
        for n in parts[1:]:
            np.maximum(out[:n], values[done : done + n], out=out[:n])
            done += n
        return out


def _gains(lists: int, docs: int, left: pa.Table, held: _Documents):
    """For some queries (item, qs, mets, floors) at a time, where they begin and, a row for each document and a column for each query, the exact score and a key that orders candidates: by gain, then by smaller id; -1 for one that isn't found."""
    asks, query = _tokens_of(left["qs"])
    mets, floors = left["mets"].combine_chunks().flatten(), left["floors"].combine_chunks().flatten().to_numpy()
    ends = np.searchsorted(query, np.arange(len(left) + 1))
    begin = 0
    while begin < len(left):
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + ASKS, side="right")) - 1)
        score, gain = (np.zeros((len(held.ids), end - begin)) for _ in range(2))
        found = np.zeros((len(held.ids), end - begin), bool)
        for i in range(ends[begin], ends[end], ASKS):
            some = slice(i, min(i + ASKS, ends[end]))
            each, unmet, floor = np.ascontiguousarray(asks[some].T), _unmet(mets[some], lists), floors[some]
            own = query[some]
            starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            columns = own[starts] - begin
            for chunk, tokens, at, parts, short in held.chunks:
                values = tokens @ each
                cell = chunk[:, None], columns
                score[cell] += np.add.reduceat(held.best(values, parts, short), starts, axis=1)
                values += unmet[at]
                over = np.rint(held.best(values, parts, short) * UNITS) - floor
                found[cell] |= np.maximum.reduceat(over, starts, axis=1) >= 0
                gain[cell] += np.add.reduceat(np.maximum(over, 0), starts, axis=1)
        yield begin, np.round(score, 6), np.where(found, gain.astype(np.int64) * docs + (docs - 1 - held.at)[:, None], -1)
        begin = end


def _sampled_keys(lists: int, docs: int, depth: int, among: int, most: int):
    """Function of queries (item, qs, mets, floors) and sampled documents' tokens (doc_id, at, list, v): between which keys the one of a query's last chosen document lies."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        ranges = [(0, most)] * len(left)
        if len(left) and len(right):
            for begin, _, key in _gains(lists, docs, left, _Documents(right)):
                for i, column in enumerate(np.sort(key, axis=0)[::-1].T):
                    ranges[begin + i] = _bracket(column, depth, among, 0, most, SPREAD)
        low, high = zip(*ranges) if ranges else ((), ())
        return pa.table([pa.array(left["item"].to_numpy(), pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["item", "low", "high"])

    return tile


#: What `_chosen` makes of a query and a tile of documents.
CHOSEN = "item long, low long, above long, keys array<long>, docs array<long>, scores array<double>, of array<long>"


def _chosen(lists: int, docs: int, k: int | None):
    """Function of queries (item, qs, mets, floors, low, high) and tokens (doc_id, at, list, v): how many candidates have keys above `high`, the keys between those ends, and the documents that may be among the k best, all without k."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        items, low, high = (left[c].to_numpy() for c in ("item", "low", "high"))
        counts, lists_of = [], {c: [] for c in ("keys", "docs", "scores", "of")}
        if len(left) and len(right):
            held = _Documents(right)
            for begin, scores, keys in _gains(lists, docs, left, held):
                for i, (score, key) in enumerate(zip(scores.T, keys.T), begin):
                    sure, open_ = np.flatnonzero(key > max(high[i], -1)), np.flatnonzero((key >= max(low[i], 0)) & (key <= high[i]))
                    counts.append(len(sure))
                    if k is not None and len(sure) >= k:
                        last = np.partition(score[sure], len(sure) - k)[len(sure) - k]
                        sure = sure[score[sure] >= last]
                        sure = sure[np.argsort(-score[sure], kind="stable")[:k]]  # documents ascend
                        maybe = np.concatenate((sure, open_[score[open_] >= last]))
                    else:
                        maybe = np.concatenate((sure, open_))
                    for c, x in (("keys", key[open_]), ("docs", held.ids[maybe]), ("scores", score[maybe]), ("of", key[maybe])):
                        lists_of[c].append(x)
        else:
            items, low = items[:0], low[:0]
        columns = [_lists_of(x, pa.float64() if c == "scores" else pa.int64()) for c, x in lists_of.items()]
        return pa.table([pa.array(items, pa.int64()), pa.array(low, pa.int64()), pa.array(counts, pa.int64()), *columns], ["item", "low", "above", *lists_of])

    return tile


def _best_chosen(depth: int | None, k: int | None, most: int):
    """Function of rows of `_chosen`: each query's k best documents among its chosen ones, all of them without k; one without a number if it isn't told who is chosen."""

    def settle(rows: pa.Table) -> pa.Table:
        out = [np.empty(0, np.int64)], [pa.array([], pa.int64())], [pa.array([], pa.float64())]
        for item, of in _items(rows):
            least = 0 if depth is None else _nth(of("keys"), int(of("above").sum()), depth, int(of("low")[0]), 0, most)
            docs, scores = pa.array([None], pa.int64()), pa.array([None], pa.float64())
            if least is not None:
                chosen = of("of") >= least
                docs, scores = of("docs")[chosen], of("scores")[chosen]
                top = np.lexsort((docs, -scores))[:k]
                docs, scores = pa.array(docs[top]), pa.array(scores[top])
            for column, values in zip(out, (np.full(len(docs), item), docs, scores)):
                column.append(values)
        return pa.table([pa.array(np.concatenate(out[0])), pa.chunked_array(out[1]), pa.chunked_array(out[2])], ["item", "doc_id", "score"])

    return settle


@dataclass(frozen=True)
class TokenIndex:
    """`path`/index: the lists of tokens; `path`/members: list, doc_id; `path`/rows: doc_id, row, vs."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(tokens: DataFrame, path: str, lists: int | None = None) -> TokenIndex:
        """From tokens (doc_id, place, v), by default with as many lists as the root of their number; tokens without direction take no part."""
        spark = tokens.sparkSession
        rows = tokens.where(_usable(F.col("v"))).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("place").cast("long").alias("place"), F.col("v").cast("array<double>").alias("v"))
        index = IvfIndex.build(rows.withColumn("token", F.xxhash64("doc_id", "place")), f"{path}/index", payload=("doc_id",), lists=lists, id_col="token", vector_col="v")
        index.lists().select("list", "doc_id").distinct().write.parquet(f"{path}/members")
        parts = rows.groupBy("doc_id", F.expr(f"place div {TOKENS_A_ROW}").alias("row")).agg(F.collect_list("v").alias("vs"))
        parts.write.parquet(f"{path}/rows")
        return TokenIndex(spark, path)

    def _read(self, name: str) -> DataFrame:
        kinds = {"members": "list int, doc_id long", "rows": "doc_id long, row long, vs array<array<double>>"}
        return self.spark.read.schema(kinds[name]).parquet(f"{self.path}/{name}")

    def candidates(self, queries: DataFrame, probes: int | None, nearest: int | None, depth: int | None) -> DataFrame:
        """(query_id, doc_id): the documents of the `nearest` tokens of each query token in its `probes` nearest lists; of these the `depth` best by what those tokens score.

        Tokens that score as much as the last of the nearest are near, too. A
        query token whose lists have fewer than `nearest` meets all lists. A
        document that isn't among a token's nearest counts as the last that
        is. Without `nearest`, all documents with a token in such a list, all of
        them if every list is probed; without `depth`, all that are found.
        Documents longer than LONG are candidates of every query.
        """
        if nearest is not None:
            sizes = self._sizes()
            usable = S.stored(_usable_tokens(queries), "usable-query-tokens")
            found = self._near(usable, sizes, None, probes, nearest, depth).select("query_id", "doc_id")
            return found.unionByName(usable.select("query_id").distinct().crossJoin(sizes.where(F.col("tokens") > LONG).select("doc_id")))
        index = IvfIndex(self.spark, f"{self.path}/index")
        asked = S.stored(queries.select("query_id", F.monotonically_increasing_id().alias("token"), "q"), "query-tokens")
        own = asked.select(F.col("token").alias("query_id"), "q")
        lists = index.probed(own, probes).select(F.col("query_id").alias("token"), "list").join(asked.select("token", "query_id"), "token").select("query_id", "list").distinct()
        return lists.join(self._read("members"), "list").select("query_id", "doc_id").distinct()

    def _sizes(self) -> DataFrame:
        """doc_id, tokens, at: the documents, numbered from 0 in the order of their ids."""
        each = self._read("rows").groupBy("doc_id").agg(F.sum(F.size("vs")).alias("tokens")).orderBy("doc_id").withColumn("_m", F.monotonically_increasing_id())
        each = S.stored(each.withColumn("_part", F.shiftright("_m", 33)), "token-counts")
        before, starts = 0, []
        for part, n in sorted(each.groupBy("_part").count().collect()):  # a row for each partition of the sort
            starts.append((part, before))
            before += n
        starts = F.broadcast(self.spark.createDataFrame(starts, "_part long, _before long"))
        return each.join(starts, "_part").select("doc_id", "tokens", (F.col("_m") - F.shiftleft("_part", 33) + F.col("_before")).alias("at"))

    def _near(self, usable: DataFrame, sizes: DataFrame, k: int | None, probes: int | None, nearest: int, depth: int | None) -> DataFrame:
        """query_id, doc_id, score: the k best by exact score, or all, of each query's candidates among the documents that aren't long.

        Samples tell within which range of keys a token's last near one and a
        query's last chosen document lie; a pass over all then counts the keys
        above it and keeps those within, of which the right one is picked. What
        isn't found within is looked for among all keys.
        """
        index = IvfIndex(self.spark, f"{self.path}/index")
        _, unit = index.centroids()
        every = index.lists()
        counts = dict(every.groupBy("list").count().collect())  # MOST_LISTS at most
        lists, in_lists = len(unit), np.array([counts.get(i, 0) for i in range(len(unit))], np.int64)
        if not lists:
            return self.spark.createDataFrame([], "query_id long, doc_id long, score double")
        held = self.spark.sparkContext.broadcast((unit, in_lists))
        n_queries, n_tokens, docs, cores = usable.count(), int(in_lists.sum()), max(1, sizes.count()), self.spark.sparkContext.defaultParallelism
        short = sizes.where(F.col("tokens") <= LONG)
        n_short = short.count()
        tile = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        split = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        met = lambda left, right: left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))
        fewer = lambda n, tile: max(1, -(-n // tile), min(cores, n // ASKS))
        q_tiles, s_tiles = max(1, -(-n_queries // (4 * QUERY_TILE))), fewer(n_queries, QUERY_TILE // 2)
        v_tiles = max(-(-n_tokens // COUNT_TILE), min(-(-2 * cores // q_tiles), n_tokens // MANY), 1)
        zero = F.lit(0).cast("long")
        wide = lambda low, high: (F.lit(low).cast("long").alias("low"), F.lit(high).cast("long").alias("high"))

        def settled(ranges: DataFrame, items: int, others: int, sample: int, ends: tuple[int, int], passed, settle, kinds: str) -> DataFrame:
            """What `settle` makes of each item's rows of `passed`; items for which it finds nothing go through it again with all keys."""
            found, done = kinds.split()[2], []
            for share in (SPREAD * (sample**0.5 + 2) / sample if sample else 1, 1):
                parts = max(1, -(-int(items * others * min(1, share)) // COUNTS))
                done.append(S.stored(passed(ranges).groupBy(F.pmod(F.xxhash64("item"), F.lit(parts))).applyInArrow(settle, kinds), found))
                missed = done[-1].where(F.col(found).isNull()).select("item")
                items = missed.count()
                if not items:
                    break
                ranges = missed.select("item", *wide(*ends))
            return reduce(DataFrame.unionByName, done).where(F.col(found).isNotNull())

        asked = usable.withColumn("item", F.monotonically_increasing_id())
        asked = S.stored(asked.mapInArrow(_met(held, lists if probes is None else min(probes, lists), nearest), "query_id long, place long, q array<double>, item long, met binary, among long"), "query-tokens")
        sample = min(SAMPLE, n_tokens // 4) if n_tokens > DIRECT else 0
        if sample:
            some = every.where(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(n_tokens)) < sample).select(split(s_tiles).alias("i"), zero.alias("j"), "list", "v")
            ranges = met(asked.select(tile("item", s_tiles).alias("i"), zero.alias("j"), "item", "q", "met", "among"), some).applyInArrow(_sampled_floors(lists, nearest), "item long, low long, high long")
            ranges = S.stored(ranges, "ranges")
        else:
            ranges = asked.select("item", *wide(-UNITS, UNITS))
        tokens = every.select(split(q_tiles).alias("i"), tile("id", v_tiles).alias("j"), "list", "v")
        scores = lambda ranges: met(asked.select("item", "q", "met").join(ranges, "item").select(tile("item", q_tiles).alias("i"), split(v_tiles).alias("j"), "item", "q", "met", "low", "high"), tokens).applyInArrow(_keys_between(lists), "item long, low long, above long, keys array<int>")
        floors = settled(ranges, n_queries, n_tokens, sample, (-UNITS, UNITS), scores, _floors(nearest), "item long, floor long")

        both = F.array_sort(F.collect_list(F.struct("place", "q", "floor", "met")))
        queries = asked.join(floors, "item").groupBy(F.col("query_id").alias("item")).agg(both.alias("t"), F.count("*").alias("n"))
        queries = S.stored(queries.select("item", F.transform("t", lambda x: x["q"]).alias("qs"), F.transform("t", lambda x: x["met"]).alias("mets"), F.transform("t", lambda x: x["floor"]).alias("floors"), "n"), "queries")
        asking, longest = queries.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
        most = (2 * UNITS * longest + 1) * docs - 1
        rows = every.select("doc_id", "list", "v").join(short.select("doc_id", "at"), "doc_id")
        sample = min(SAMPLE_DOCS, n_short // 4) if depth is not None and n_short > DIRECT // 8 else 0
        if sample:
            some = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(n_short)) < sample).select(split(s_tiles).alias("i"), zero.alias("j"), "doc_id", "at", "list", "v")
            ranges = met(queries.select(tile("item", s_tiles).alias("i"), zero.alias("j"), "item", "qs", "mets", "floors"), some).applyInArrow(_sampled_keys(lists, docs, depth, n_short, most), "item long, low long, high long")
            ranges = S.stored(ranges, "ranges")
        else:
            ranges = queries.select("item", *(wide(0, -1) if depth is None else wide(0, most)))
        tokens = rows.select(split(q_tiles).alias("i"), tile("doc_id", v_tiles).alias("j"), "doc_id", "at", "list", "v")
        chosen = lambda ranges: met(queries.join(ranges, "item").select(tile("item", q_tiles).alias("i"), split(v_tiles).alias("j"), "item", "qs", "mets", "floors", "low", "high"), tokens).applyInArrow(_chosen(lists, docs, k), CHOSEN)
        return settled(ranges, asking, n_short, sample, (0, most), chosen, _best_chosen(depth, k, most), "item long, doc_id long, score double").withColumnRenamed("item", "query_id")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, nearest: int | None = None, depth: int | None = None) -> DataFrame:
        """query_id, doc_id, score, rank: the k best documents of each query (query_id, place, q), ties to the smaller doc_id.

        Scores are exact; without the other arguments (see `candidates`) so is
        the choice. Queries and documents meet in tiles of bounded size, each
        a matrix product that hands on k documents of a query. The tokens of a
        document longer than LONG are scored in rows of TOKENS_A_ROW, so that
        none has to fit a task.
        """
        usable = S.stored(_usable_tokens(queries), "usable-query-tokens")
        asked = usable.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "q"))), lambda x: x["q"]).alias("qs"))
        rows = self._read("rows")
        sizes = S.stored(rows.groupBy("doc_id").agg(F.sum(F.size("vs")).alias("tokens")), "token-counts") if nearest is None else self._sizes()
        long = sizes.where(F.col("tokens") > LONG).select("doc_id")
        every = probes is None and nearest is None
        pairs = S.stored(self.candidates(usable, probes, nearest, depth), "candidates") if nearest is None and not every else None

        q_tiles, v_tiles = max(1, -(-usable.count() // QUERY_TILE)), max(1, -(-(sizes.where(F.col("tokens") <= LONG).agg(F.sum("tokens")).first()[0] or 0) // DOC_TILE))
        tile = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
        split = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        left = None
        if every:
            left = asked.select(tile("query_id", q_tiles).alias("i"), split(v_tiles).alias("j"), "query_id", "qs", F.array().cast("array<long>").alias("docs"))
        elif nearest is None:
            left = pairs.groupBy("query_id", tile("doc_id", v_tiles).alias("j")).agg(F.collect_list("doc_id").alias("docs")).join(asked, "query_id").select(tile("query_id", q_tiles).alias("i"), "j", "query_id", "qs", "docs")
        right = rows.join(long, "doc_id", "left_anti").select(split(q_tiles).alias("i"), tile("doc_id", v_tiles).alias("j"), "doc_id", "vs")
        if left is None:
            scored = self._near(usable, sizes, k, probes, nearest, depth)
        else:
            scored = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(_tile(k, not every), "query_id long, doc_id long, score double")

        if not long.isEmpty():
            met = rows.join(long, "doc_id")
            met = met.join(asked) if pairs is None else met.join(pairs, "doc_id").join(asked, "query_id")
            each = met.select("query_id", "doc_id", F.posexplode(_best_cosines("qs", "vs")).alias("token", "best"))
            scored = scored.unionByName(each.groupBy("query_id", "doc_id", "token").agg(F.max("best").alias("best")).groupBy("query_id", "doc_id").agg(F.round(F.sum("best"), 6).alias("score")))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
