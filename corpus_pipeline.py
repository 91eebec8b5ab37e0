"""Corpus preparation in stages: quality, exact copies, near copies, packing.

Each stage reads what its predecessor kept; `run` writes every stage's rows to
the shared folder and reads them back, so a lost executor costs at most the
stage it was in. All stages but the last keep the columns of `documents`,
whatever they are called. A null text counts as empty, an empty one is rated
like any other; rows without an id are judged by their text; repeated rows
leave one at the exact stage; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import exact_dedup, near_dedup, packing, quality, storage, tokens

#: Documents whose chance of the highest grade is below this go.
LEAST_TAIL = 0.5
#: Pieces whose ids a Python worker keeps while it packs; the stages before have left their mark on its executor's memory.
REMEMBERED = 400_000


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the ordinal classifier rates toxic or of low quality."""
    model = quality.fit(docs, quality.grades(spark.read.parquet(f"{sf_dir}/labels.parquet")), n_grades=3)
    return quality.select(docs, model, LEAST_TAIL)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the row of the largest doc_id stays."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document of the smallest doc_id stays."""
    return near_dedup.without_near_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    pieces = packing.token_pieces(docs, tokens.tokenizer_path(tokens.WORD_BPE), end_id=0, capacity=2048, remembered=REMEMBERED, slice_bytes=tokens.SLICE)
    return packing.pack(pieces, capacity=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("best_fit_packing", packed),
]

#: SQL can't express the classifier; each stage is tested against a plain version instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = storage.staged(stage(spark, docs, sf_dir), name)
    return docs
