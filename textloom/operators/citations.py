"""Citations, prompts and the chunks behind an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: the closing line of the question-answering prompt.
CLOSING = "Please answer the question based on the provided context. Be precise and technical."


def tracked(uses: DataFrame, least_relevance: float = 0.5, least_confidence: float = 0.5) -> DataFrame:
    """Chunks used by each answer: first relevance and confidence, number of uses, place by relevance then use; scores outside [0, 1] fail."""
    fine = F.col("relevance").between(0, 1) & F.col("confidence").between(0, 1)
    checked = uses.withColumn("relevance", F.when(fine, F.col("relevance")).otherwise(F.raise_error(F.lit("scores must be between 0 and 1")).cast("double")))
    one = checked.groupBy("answer_id", "chunk_id").agg(F.min_by("relevance", "use").alias("relevance"), F.min_by("confidence", "use").alias("confidence"), F.count("*").alias("usage_count"))
    kept = one.where((F.col("relevance") >= least_relevance) & (F.col("confidence") >= least_confidence))
    order = Window.partitionBy("answer_id").orderBy(F.desc("relevance"), F.desc("usage_count"), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(order).cast("long"))


def confidence(cited: DataFrame) -> DataFrame:
    """Per answer: mean relevance and confidence, their 60/40 blend, and counts of high and low confidence."""
    mean = lambda c: F.round(F.avg(c), 6)
    blend = F.round(F.avg("relevance") * 0.6 + F.avg("confidence") * 0.4, 6)
    return cited.groupBy("answer_id").agg(blend.alias("overall"), mean("relevance").alias("avg_relevance"), mean("confidence").alias("avg_confidence"), F.count("*").alias("sources"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if(F.col("confidence") < 0.5).alias("low"))


def source_info(meta: Column, chunk_id: Column) -> Column:
    """Document, section else chapter, page, figure else table; the chunk's id if none is known."""

    def part(form: str, *keys: str) -> Column:
        return F.coalesce(*(F.concat(F.lit(form.format(k.capitalize())), F.try_element_at(meta, F.lit(k))) for k in keys))

    joined = F.concat_ws(", ", F.try_element_at(meta, F.lit("document")), part("{} ", "section", "chapter"), part("p. ", "page"), part("{} ", "figure", "table"))
    return F.when(joined == "", F.concat(F.lit("Source "), chunk_id)).otherwise(joined)


def source_link(meta: Column) -> Column:
    path, page = F.try_element_at(meta, F.lit("document_path")), F.try_element_at(meta, F.lit("page"))
    return F.coalesce(F.try_element_at(meta, F.lit("url")), F.concat(F.lit("file://"), path, F.lit("#page="), page))


def citation_text(style: str, rank: Column, info: Column) -> Column:
    """`ieee` [n], `numeric` [Source n], `inline` (info), else (Source n)."""
    n = rank.cast("string")
    forms = {"ieee": F.concat(F.lit("["), n, F.lit("]")), "numeric": F.concat(F.lit("[Source "), n, F.lit("]")), "inline": F.concat(F.lit("("), info, F.lit(")"))}
    return forms.get(style, F.concat(F.lit("(Source "), n, F.lit(")")))


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\\\\"), F.lit("\\"))


def linked_equations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, equation, chunk_id: each equation of an answer with the first of the answer's chunks (by `use`) that has it."""
    found = answers.select("answer_id", F.posexplode(F.regexp_extract_all("answer", F.lit(r"(?s)\$\$?(.*?)\$\$?"), F.lit(1))).alias("i", "e")).select("answer_id", "i", F.trim("e").alias("equation"))
    both = found.join(chunks, "answer_id").where(F.contains(_plain(F.col("content")), _plain(F.col("equation"))))
    return both.groupBy("answer_id", "i", "equation").agg(F.min_by("chunk_id", "use").alias("chunk_id"))


def context_block(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c, i: F.concat(F.lit("[Context "), (i + 1).cast("string"), F.lit("]\n"), c)), "\n\n")


def qa_prompt(question: Column, chunks: Column) -> Column:
    """The question with numbered context; the question alone without any."""
    full = F.concat(F.lit("Context:\n"), context_block(chunks), F.lit("\n\nQuestion:\n"), question, F.lit("\n\n" + CLOSING))
    return F.when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, question).otherwise(full)
