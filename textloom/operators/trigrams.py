"""Similarity of words by their trigrams: a set-similarity join over an inverted table of grams.

Two sets of n and m grams whose Jaccard similarity is at least t differ in size
by a factor of t at most, and share one of the first n - ceil(t n) + 1 grams of
either, if grams stand in a common order. In the order of ascending frequency
those prefixes are the rarest grams, so candidates are few and no pair is made
that shares none of them.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..sources.stored import stored

#: Grams of the left words that every task may hold, and left words themselves.
MOST_GRAMS, MOST_WORDS = 200_000, 100_000
#: Words met by their grams, and half the pairs there may be, that a task counts at a time.
MET = 1 << 21


def grams(word: Column, n: int = 3) -> Column:
    """The distinct n-grams of a lower-cased word with n - 1 spaces before it and one after; empty for an empty or null word."""
    padded = F.concat(F.lit(" " * (n - 1)), F.lower(word), F.lit(" "))
    each = F.transform(F.sequence(F.lit(1), F.char_length(padded) - (n - 1)), lambda i: F.substring(padded, i, F.lit(n)))
    return F.when(F.char_length(word) > 0, F.array_distinct(each)).otherwise(F.array().cast("array<string>"))


def similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct grams, 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def prefix_size(size: Column, least: float) -> Column:
    """How many of a word's rarest grams must hold one of every word as similar as `least`."""
    return (size - F.ceil(F.lit(least) * size - 1e-9) + 1).cast("int")


def _known_prefixes(words: DataFrame, frequency: dict[str, int], least: float, n: int) -> DataFrame:
    """word, grams and the grams of its prefix that `frequency` has, for words that may be similar to one of those it was counted on.

    Grams that don't occur there are the rarest of all and match nothing.
    """
    order = {g: i for i, (g, _) in enumerate(sorted(frequency.items(), key=lambda x: (x[1], x[0])))}
    held = words.sparkSession.sparkContext.broadcast(order)

    def prefixes(lists: pa.Array) -> pa.Array:
        order, out = held.value, []
        for grams in lists.to_pylist():
            need = math.ceil(least * len(grams) - 1e-9)
            known = sorted((g for g in grams if g in order), key=order.__getitem__)
            out.append(known[: max(0, len(known) - need + 1)] if len(known) >= need else [])
        return pa.array(out, pa.list_(pa.string()))

    rows = words.withColumn("grams", grams(F.col("word"), n))
    return rows.withColumn("prefix", F.arrow_udf(prefixes, ArrayType(StringType()))("grams")).where(F.size("prefix") > 0)


def _held(left: pa.Table) -> tuple:
    """The words of a table (word, grams), how many grams each has, the words of each gram one after another, and for each gram where these begin and how many they are."""
    grams = left["grams"].combine_chunks()
    sizes = pc.list_value_length(grams).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = grams.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    owners = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[np.argsort(codes, kind="stable")]
    ends = np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))
    places = dict(zip(coded.dictionary.to_pylist(), itertools.pairwise([0, *ends.tolist()]), strict=True))
    return left["word"].combine_chunks(), sizes, owners, places


def _pairs(held, least: float, n: int):
    """Function of batches (word, low): pairs with the words held, counted over the words of each gram that both have."""

    def met(lists: list[list[tuple[int, int]]], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of a row and of a word held, and their similarity, where it is at least `least`."""
        _, sizes, owners, _ = held.value
        spans = np.fromiter(itertools.chain.from_iterable(lists), np.dtype((np.int64, 2)))
        times = spans[:, 1] - spans[:, 0]
        ends = np.cumsum(times)
        at = np.repeat(spans[:, 1] - ends, times) + np.arange(ends[-1] if len(ends) else 0)
        row = np.repeat(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), times)
        both = np.bincount(row * len(sizes) + owners[at])
        pair = np.flatnonzero(both)
        row, word, both = pair // len(sizes), pair % len(sizes), both[pair]
        similar = both / (own[row] + sizes[word] - both)
        near = similar >= least - 1e-12
        return row[near], word[near], similar[near]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, _, _, places = held.value
        most = max(1, 2 * MET // max(1, len(words)))
        for batch in batches:
            low, a = batch["low"].to_pylist(), 0
            while a < len(low):
                lists, own, work = [], [], 0
                while a + len(own) < len(low) and len(own) < most and work < MET:
                    padded = " " * (n - 1) + low[a + len(own)] + " "
                    each = {padded[i : i + n] for i in range(len(padded) - n + 1)}
                    lists.append([places[g] for g in each if g in places])
                    own.append(len(each))
                    work += sum(stop - start for start, stop in lists[-1])
                row, word, similar = met(lists, np.array(own))
                yield pa.record_batch([words.take(pa.array(word)), batch["word"].take(pa.array(row + a)), pa.array(similar)], ["a", "b", "similarity"])
                a += len(own)

    return pairs


def similar(left: DataFrame, right: DataFrame, least: float = 0.5, a: str = "a", b: str = "b", n: int = 3) -> DataFrame:
    """All pairs (a, b, similarity) of distinct words of `left.a` and `right.b` whose similarity is at least `least` (over 0).

    Up to MOST_WORDS words of `left` with MOST_GRAMS grams are held by every
    task with the words of each gram, and the shared grams of a word and its
    partners are counted there; nothing travels but the words of `right`, once.
    Else grams are ordered by how many words of `left` have them. While these
    are MOST_GRAMS at most, every task knows them, and of the other words only
    those travel that may have a partner, with the few grams that decide it.
    With more of them the same prefixes are found by joins. Words that are null
    or empty have no grams and no partners.
    """
    words = {name: rows.select(F.col(name).alias("word")).where("word <> ''").distinct() for name, rows in ((a, left), (b, right))}
    mine = stored(words[a].withColumn("grams", grams(F.col("word"), n)), "words")
    frequency = mine.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    known = frequency.limit(MOST_GRAMS + 1).collect()
    if len(known) <= MOST_GRAMS and (few := mine.limit(MOST_WORDS + 1).toArrow()).num_rows <= MOST_WORDS:
        held = left.sparkSession.sparkContext.broadcast(_held(few))
        rows = words[b].select("word", F.lower("word").alias("low")).repartition(left.sparkSession.sparkContext.defaultParallelism)
        met = rows.mapInArrow(_pairs(held, least, n), "a string, b string, similarity double")
        return met.select(F.col("a").alias(a), F.col("b").alias(b), F.round("similarity", 9).alias("similarity"))
    if len(known) <= MOST_GRAMS:
        found = {name: _known_prefixes(words[name], {r["gram"]: r["df"] for r in known}, least, n) for name in (a, b)}
    else:
        found = {}
        for name in (a, b):
            each = words[name].withColumn("grams", grams(F.col("word"), n)).select("word", "grams", F.explode("grams").alias("gram")).join(frequency, "gram", "left")
            ordered = each.groupBy("word").agg(F.first("grams").alias("grams"), F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram"))).alias("o"))
            found[name] = ordered.withColumn("prefix", F.slice("o.gram", F.lit(1), prefix_size(F.size("grams"), least)))
    x, y = (found[s].select(F.col("word").alias(s), F.size("grams").alias(f"n_{s}"), F.col("grams").alias(f"g_{s}"), F.col("prefix").alias(f"p_{s}"), F.explode("prefix").alias("gram")) for s in (a, b))
    fits = (F.col(f"n_{a}") >= F.lit(least) * F.col(f"n_{b}") - 1e-9) & (F.col(f"n_{b}") >= F.lit(least) * F.col(f"n_{a}") - 1e-9)
    met = x.join(y, "gram").where(fits)
    met = met.where(F.get(F.array_intersect(f"p_{a}", f"p_{b}"), F.lit(0)) == F.col("gram"))  # a pair that shares several is kept where it meets first
    return met.withColumn("similarity", similarity(F.col(f"g_{a}"), F.col(f"g_{b}"))).where(F.col("similarity") >= least - 1e-12).select(a, b, F.round("similarity", 9).alias("similarity"))
