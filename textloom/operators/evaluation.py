"""Scores of answers against questions, contexts and truths, and sets of test cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The least mean of each metric, and the target number of cases of each category.
THRESHOLDS = {"context_precision": 0.8, "context_recall": 0.8, "faithfulness": 0.9, "answer_relevancy": 0.8}
#: A context counts as relevant if it has this share of the truth's words.
RELEVANT = 0.5


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """The share of keywords that an answer has in any case; 1 if there are none."""
    found = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) == 0, 1.0).otherwise(found / F.size(keywords))


def _share(of: Column, within: Column) -> Column:
    """The share of distinct words of a text that another has; 0 for a text without words."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(of, within)).cast("double"), F.size(F.array_distinct(of))), F.lit(0.0))


def lexical_scores(cases: DataFrame) -> DataFrame:
    """The four metrics by shared words, a stand-in for judgement by a model; cases have id, question, answer, contexts and ground_truth.

    faithfulness: words of the answer that the contexts have; answer_relevancy:
    words of the question that the answer has; context_recall: words of the
    truth that the contexts have, 0 without a truth; context_precision: the
    mean precision at the place of each relevant context, or of contexts by the
    question's words without a truth.
    """
    words = {c: T.tokens(F.coalesce(F.col(c), F.lit(""))) for c in ("question", "answer", "ground_truth")}
    rows = cases.select("id", *(w.alias(c) for c, w in words.items()), F.transform(F.coalesce("contexts", F.array().cast("array<string>")), lambda c: T.tokens(F.coalesce(c, F.lit("")))).alias("contexts"))
    rows = rows.withColumn("seen", F.flatten("contexts")).withColumn("wanted", F.when(F.size("ground_truth") > 0, F.col("ground_truth")).otherwise(F.col("question")))
    rows = rows.withColumn("good", F.transform("contexts", lambda c: (F.coalesce(F.try_divide(F.size(F.array_intersect(F.col("wanted"), c)).cast("double"), F.size(F.array_distinct("wanted"))), F.lit(0.0)) >= RELEVANT).cast("int")))
    at = F.transform("good", lambda g, i: F.when(g == 1, F.aggregate(F.slice("good", F.lit(1), i + 1), F.lit(0), lambda s, x: s + x) / (i + 1)).otherwise(0.0))
    total = F.aggregate("good", F.lit(0), lambda s, x: s + x)
    precision = F.coalesce(F.try_divide(F.aggregate(at, F.lit(0.0), lambda s, x: s + x), total), F.lit(0.0))
    scores = {"context_precision": precision, "context_recall": _share(F.col("ground_truth"), F.col("seen")), "faithfulness": _share(F.col("answer"), F.col("seen")), "answer_relevancy": _share(F.col("question"), F.col("answer"))}
    return rows.select("id", *(F.round(v, 6).alias(k) for k, v in scores.items()))


def metric_means(scores: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """One row: the mean of each metric, n, and whether all reach their thresholds; a metric whose mean is zero counts as not measured."""
    limits = THRESHOLDS if thresholds is None else thresholds
    means = scores.agg(F.count("*").alias("n"), *(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in limits))
    passed = F.lit(True)
    for metric, least in limits.items():
        passed = passed & ((F.col(metric) == 0) | (F.col(metric) >= least))
    return means.withColumn("passed", passed)


def templates(cases: DataFrame, targets: DataFrame) -> DataFrame:
    """id, category, difficulty, question, ground_truth, notes of the cases that categories (category, target) lack, to be filled in."""
    have = cases.groupBy("category").agg(F.count("*").alias("_n"))
    need = targets.join(have, "category", "left").withColumn("_need", (F.col("target") - F.coalesce("_n", F.lit(0))).cast("int")).where("_need > 0")
    rows = need.select("category", F.explode(F.sequence(F.lit(1), F.col("_need"))).alias("i"))
    c, i = F.col("category"), F.col("i")
    return rows.select(
        F.concat(F.substring(c, 1, 4), F.lit("-"), F.lpad(i.cast("string"), 3, "0")).alias("id"), c.alias("category"), F.lit("medium").alias("difficulty"),
        F.format_string("[TODO: Add %s question %d]", c, i).alias("question"), F.lit("[TODO: Add ground truth answer]").alias("ground_truth"), F.format_string("Template for %s case %d", c, i).alias("notes"),
    )


def synthetic_cases(passages: DataFrame, shares: dict[str, float], n: int, key: str = "doc_id") -> DataFrame:
    """key, complexity: which n passages questions are made from, and of what kind, the same on every run.

    Passages are put in an order that depends on the key alone; kinds get their
    shares of that order. A model that writes the questions takes it from there.
    """
    place = F.pmod(F.col(key).cast("long") * 2654435761, F.lit(4294967296))
    chosen = passages.select(key, place.alias("_p")).orderBy("_p", key).limit(n)
    kind, upto = None, 0.0
    share = F.pmod(F.col(key).cast("long") * 40503, F.lit(65536)) / 65536
    for name, part in shares.items():
        upto += part
        kind = F.when(share < upto, name) if kind is None else kind.when(share < upto, name)
    return chosen.select(key, kind.otherwise(list(shares)[-1]).alias("complexity"))


def summary_by(cases: DataFrame, column: str, known: list[str]) -> DataFrame:
    """column, n for every known value, those without cases too."""
    counts = cases.groupBy(column).agg(F.count("*").alias("n"))
    names = cases.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return names.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))
