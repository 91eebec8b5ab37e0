"""Token counts from an exact histogram of encoded lengths (operator 3)."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens


def encoded_lengths(docs: DataFrame, tokenizer: str, text: str = "text", by: str | None = None) -> DataFrame:
    """One row per document: n_tokens, and `grp` if a grouping column is named."""

    def lengths(batches):
        encoder = tokens.word_bpe(tokenizer)
        for batch in batches:
            for part in tokens.slices(batch, "_text", tokens.ENCODER_SLICE):
                _, starts = encoder.encode(part["_text"])
                n = pa.array(np.diff(starts), pa.int64())
                yield pa.record_batch([n, *([part["grp"]] if by else [])], ["n_tokens", *(["grp"] if by else [])])

    cols = [F.col(text).alias("_text"), *([F.col(by).cast("string").alias("grp")] if by else [])]
    return docs.select(*cols).mapInArrow(lengths, "n_tokens long" + (", grp string" if by else ""))


def length_histogram(docs: DataFrame, tokenizer: str, text: str = "text", by: str | None = None) -> DataFrame:
    """Documents per encoded length; partial counts are combined before the shuffle.

    A null text counts as empty and so has length 0; repeated rows count each;
    very long texts are encoded whole; other columns, whatever their names,
    aren't read; an empty table has no lengths.
    """
    keys = ["grp", "n_tokens"] if by else ["n_tokens"]
    return encoded_lengths(docs, tokenizer, text, by).groupBy(*keys).agg(F.count("*").alias("n_docs"))


def context_table(histogram: DataFrame, block: int = 1024) -> DataFrame:
    """Answers for every context limit that occurs as a length.

    For each length L (and each `grp`, if present): documents and tokens of
    exactly L, documents and tokens of at least L (suffix sums), the tokens
    kept if every document is cut at L, the tokens this loses, and the share
    of documents of at most L. A limit between two lengths M < L keeps
    `kept_tokens(M) + (limit - M) * docs_ge(L)` tokens, so the table answers
    any limit. Suffix sums run within blocks of lengths and then over blocks,
    so no window holds more than `block` lengths or the number of blocks.
    An empty histogram gives an empty table.
    """
    grp = ["grp"] if "grp" in histogram.columns else []
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("_block", F.floor(F.col("n_tokens") / block))
    after = Window.partitionBy(*grp, "_kind").orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = h.groupBy(*grp, "_block").agg(F.sum("n_docs").alias("_d"), F.sum("tokens").alias("_t")).withColumn("_kind", F.lit(0))
    blocks = blocks.select(*grp, "_block", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c + "_after") for c in ("_d", "_t")))
    totals = h.groupBy(*grp).agg(F.sum("n_docs").alias("all_docs"), F.sum("tokens").alias("all_tokens"))
    down = Window.partitionBy(*grp, "_block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    same = functools.reduce(lambda a, b: a & b, (F.col(f"h.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*grp, "_block"]))
    out = h.alias("h").join(blocks.alias("b"), same).select("h.*", "_d_after", "_t_after").withColumn("docs_ge", F.col("_d_after") + F.sum("n_docs").over(down)).withColumn("tokens_ge", F.col("_t_after") + F.sum("tokens").over(down))
    if grp:
        out = out.alias("o").join(totals.alias("t"), F.col("o.grp").eqNullSafe(F.col("t.grp"))).select("o.*", "all_docs", "all_tokens")
    else:
        out = out.join(F.broadcast(totals))  # one row
    kept = F.col("all_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")
    return out.select(
        *grp,
        F.col("n_tokens").alias("context_limit"),
        "n_docs",
        "docs_ge",
        "tokens_ge",
        kept.alias("kept_tokens"),
        (F.col("all_tokens") - kept).alias("cut_tokens"),
        ((F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("all_docs")).alias("share_le"),
    )


def length_quantiles(table: DataFrame, probabilities: list[float]) -> DataFrame:
    """The smallest length that at least a share p of the documents doesn't exceed."""
    grp = ["grp"] if "grp" in table.columns else []
    p = F.explode(F.array(*(F.lit(float(x)) for x in probabilities))).alias("p")
    return table.select("*", p).where(F.col("share_le") >= F.col("p")).groupBy(*grp, "p").agg(F.min("context_limit").alias("n_tokens"))
