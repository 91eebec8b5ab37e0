"""Quality classifier: ordinal cumulative-link regression on hashed text (operator 6).

Ratings are grades 0..K-1. One set of weights over hashed text features gives
a score s, and ordered thresholds t1 < ... < t(K-1) give P(grade >= k) =
sigmoid(s - tk), from which come the expected grade and the tail probability
that selects documents. The weights are fitted on a bounded sample of labelled
rows; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens

SHAPES = ("letters", "capital first", "all capitals", "digits", "marks", "mixed", "loud")
#: Shares of a document are told apart at these edges.
EDGES = np.array([1e-9, 0.01, 0.03, 0.1, 0.25, 0.5])


def _describe(piece: str) -> int:
    """The hash of a piece's word, 60 bits of it, and in the lowest three bits its shape."""
    word = piece.strip(".,;:!?\"'()[]")
    if piece.isalpha() or word.isalpha():
        if piece.endswith("!"):
            shape = 6
        else:
            shape = 2 if len(word) > 1 and word.isupper() else 1 if word[:1].isupper() else 0
    else:
        shape = 3 if word.isdigit() else 4 if not any(map(str.isalnum, piece)) else 5
    return xxhash.xxh3_64_intdigest(word.lower().encode()) >> 4 << 3 | shape


_pieces = tokens.Memo(lambda pieces: list(map(_describe, pieces)), 400_000, 24 << 20)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(feature hashes, where each text begins): the distinct features of each whole text.

    They are its words, and for each shape of word, for words that repeat the
    one before and for words seen before in the text, a feature that names the
    range of their share; also the order of magnitude of its length.
    """
    texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), "\n", " ")
    lists = pc.split_pattern(texts, " ")
    offsets = lists.offsets.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    n_docs = len(offsets) - 1
    coded = lists.flatten().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    known = np.array(_pieces.all(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), np.int64)
    word, shape = known >> 3, (known & 7).astype(np.int8)
    index = coded.indices.to_numpy(zero_copy_only=False)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), n)
    unique, number = np.unique(word, return_inverse=True)
    pair = np.unique(doc.astype(np.int64) << 32 | number[index])
    of, word_hash = pair >> 32, unique[pair & 0xFFFFFFFF]
    repeat = np.zeros(len(index), bool)
    repeat[1:] = (index[1:] == index[:-1]) & (doc[1:] == doc[:-1])

    def share(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)

    shapes = shape[index]
    shares = [share(shapes == s) for s in range(len(SHAPES))] + [share(repeat), 1 - np.bincount(of, minlength=n_docs) / np.maximum(n, 1)]
    extra = [np.searchsorted(EDGES, s, "right") + 16 * (i + 1) for i, s in enumerate(shares)]
    extra.append(np.log2(np.maximum(n, 1)).astype(np.int64) + 16 * 16)
    docs = np.concatenate([of, *([np.arange(n_docs)] * len(extra))])
    features = np.concatenate([word_hash, *(-1 - e.astype(np.int64) for e in extra)])
    order = np.argsort(docs, kind="stable")
    return features[order], np.searchsorted(docs[order], np.arange(n_docs + 1))


@dataclass(frozen=True)
class OrdinalModel:
    """Weights of sorted feature hashes, and ascending thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, features: np.ndarray, starts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.features, features), max(len(self.features) - 1, 0))
        own = np.where(self.features[at] == features, self.weights[at], 0.0) if len(self.features) else np.zeros(len(features))
        sums = np.concatenate(([0.0], np.cumsum(own)))
        return sums[starts[1:]] - sums[starts[:-1]]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1..K-1, a column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))


def fit_ordinal(features: np.ndarray, starts: np.ndarray, grades: np.ndarray, n_grades: int, least_docs: int = 6, penalty: float = 1.5e-4, steps: int = 250) -> OrdinalModel:
    """Penalised maximum likelihood by Adam over the whole sample.

    Features in fewer than `least_docs` documents are left out. Thresholds are
    the first one plus positive gaps, so they stay ordered.
    """
    names, column, count = np.unique(features, return_inverse=True, return_counts=True)
    common = count >= least_docs
    keep = common[column]
    column = (np.cumsum(common) - 1).astype(np.int32)[column[keep]]
    row = np.repeat(np.arange(len(grades), dtype=np.int32), np.diff(starts))[keep]
    names = names[common]
    w, gaps = np.zeros(len(names)), np.zeros(n_grades - 1)
    share = np.array([(grades < k).mean() for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    gaps[0], gaps[1:] = t[0], np.log(np.maximum(np.diff(t), 1e-2))
    m, v = np.zeros(len(w) + len(gaps)), np.zeros(len(w) + len(gaps))
    for step in range(1, steps + 1):
        s = np.bincount(row, w[column], len(grades))
        theta = gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:]))))
        tail = np.concatenate((np.ones((len(s), 1)), 1 / (1 + np.exp(-np.clip(s[:, None] - theta, -60, 60))), np.zeros((len(s), 1))), axis=1)
        slope = tail * (1 - tail)
        i = np.arange(len(s))
        p = np.maximum(tail[i, grades] - tail[i, grades + 1], 1e-12)
        # log p changes with the score through both neighbours' slopes, with a threshold through its own.
        d_score = (slope[i, grades] - slope[i, grades + 1]) / p / len(s)
        d_theta = np.array([(np.where(grades == k - 1, slope[:, k], 0) / p).sum() - (np.where(grades == k, slope[:, k], 0) / p).sum() for k in range(1, n_grades)]) / len(s)
        d_gaps = np.array([d_theta.sum(), *(np.exp(gaps[j]) * d_theta[j:].sum() for j in range(1, len(gaps)))])
        g = np.concatenate((np.bincount(column, d_score[row], len(w)) - penalty * w, d_gaps))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, gaps = w + move[: len(w)], gaps + move[len(w) :]
    return OrdinalModel(names, w, gaps[0] + np.concatenate(([0.0], np.cumsum(np.exp(gaps[1:])))))


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, sample_rows: int = 16_384, text: str = "text") -> OrdinalModel:
    """Fit on at most `sample_rows` rated documents, those of smallest hashed id.

    `ratings` has doc_id and grade; null or out-of-range grades and ids that
    `docs` lacks are left out. The bound keeps the sample within one task and
    the join's small side within a broadcast; it also holds where rows of
    `docs` or `ratings` repeat an id, each of which is a row of the sample. Null
    and empty texts count as texts without words. Only doc_id and the text are
    read, so other columns may have any names. Without any rating the model is
    empty and gives every grade the same chance.
    """
    grade = F.col("grade").cast("int")
    wanted = ratings.where(F.col("doc_id").isNotNull() & grade.between(0, n_grades - 1)).select(F.col("doc_id").cast("long").alias("_id"), grade.alias("grade"))
    wanted = wanted.orderBy(F.xxhash64("_id"), "_id", "grade").limit(sample_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.col(text).alias("_text")).join(F.broadcast(wanted), F.col("doc_id") == F.col("_id"))

    def extract(batches):
        for batch in batches:
            for part in tokens.slices(batch, "_text"):
                features, starts = text_features(part["_text"])
                lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(features))
                with np.errstate(over="ignore"):
                    total = np.add.reduceat(np.append(features, 0), starts[:-1])
                yield pa.record_batch([part["doc_id"], part["grade"], pa.array(np.diff(starts).astype(np.int32)), pa.array(total), lists], ["doc_id", "grade", "size", "total", "features"])

    def train(table):
        table = table.sort_by([("doc_id", "ascending"), ("grade", "ascending"), ("size", "ascending"), ("total", "ascending")]).combine_chunks()
        lists = table["features"].combine_chunks()
        starts = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        model = fit_ordinal(lists.flatten().to_numpy(), starts, table["grade"].to_numpy().astype(np.int64), n_grades)
        kind = np.repeat([0, 1], [len(model.features), len(model.thresholds)]).astype(np.int32)
        name = np.concatenate((model.features, np.arange(len(model.thresholds))))
        tokens.release()
        return pa.table({"kind": kind, "name": name, "value": np.concatenate((model.weights, model.thresholds))})

    sample = rows.select("doc_id", "_text", "grade").mapInArrow(extract, "doc_id long, grade int, size int, total long, features array<long>")
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "size", "total").limit(sample_rows)  # rows of a repeated id count too
    fitted = sample.groupBy().applyInArrow(train, "kind int, name long, value double").toPandas()
    weights, thresholds = fitted[fitted["kind"] == 0].sort_values("name"), fitted[fitted["kind"] == 1].sort_values("name")["value"].to_numpy()
    if not len(thresholds):
        thresholds = np.log(np.arange(1, n_grades) / np.arange(n_grades - 1, 0, -1))
    return OrdinalModel(weights["name"].to_numpy(np.int64), weights["value"].to_numpy(np.float64), thresholds)


def score(docs: DataFrame, model: OrdinalModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns of every row with expected_grade and tail (P of the highest grade).

    A null text is scored as an empty one; repeated rows are scored alike; very
    long texts are hashed whole; an empty table has no scores. If the text is among the columns kept it passes through the same Arrow batch,
    not a second copy. A kept column may not be called expected_grade or tail.
    """
    if {"expected_grade", "tail"} & {*keep}:
        raise ValueError("a column that is kept has the name of a result")
    rated, kept = _rated(docs, model, text, keep, None)
    return rated.select(*kept, F.col("_expected").alias("expected_grade"), F.col("_tail").alias("tail"))


def select(docs: DataFrame, model: OrdinalModel, least_tail: float, text: str = "text") -> DataFrame:
    """The rows of `docs`, with all their columns, whose chance of the highest grade is `least_tail` or more.

    Columns may have any names; nulls, empty and very long texts, repeated rows
    and empty tables are as in `score`.
    """
    rated, kept = _rated(docs, model, text, tuple(docs.columns), least_tail)
    return rated.select(*kept)


def _rated(docs: DataFrame, model: OrdinalModel, text: str, keep: tuple[str, ...], least_tail: float | None):
    """Rows under names of our own with `_expected` and `_tail`, and the columns that give `keep` back their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" if c != text else "_text" for i, c in enumerate(keep)]

    def rate(batches):
        for batch in batches:
            for part in tokens.slices(batch, "_text"):
                tails = shared.value.tails(shared.value.scores(*text_features(part["_text"])))
                out = pa.record_batch([*(part[c] for c in names), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], [*names, "_expected", "_tail"])
                yield out if least_tail is None else out.filter(pa.array(tails[:, -1] >= least_tail))

    given = [F.col(f"`{c}`").alias(a) for c, a in zip(keep, names, strict=True)]
    rows = docs.select(*given, *([] if text in keep else [F.col(text).alias("_text")]))
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*names).schema)
    return rows.mapInArrow(rate, f"{out}, _expected double, _tail double"), [F.col(a).alias(c) for a, c in zip(names, keep, strict=True)]


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from flags: 0 toxic, 1 of low quality, 2 neither; null flags give no rating."""
    bad: Column = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", bad.alias("grade")).where("grade IS NOT NULL")
