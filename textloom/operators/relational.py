"""Stores, sessions, graphs and their queries as relational operators."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filters(document_id: str | None = None, chunk_type: str | None = None, has_equations: bool | None = None, pages: tuple[int, int] | None = None, section: str | None = None, columns: list[str] | None = None) -> Column | None:
    """AND of the conditions given, or None; a condition on a column that doesn't exist is an error."""
    tests = {
        "document_id": None if document_id is None else F.col("document_id") == document_id,
        "chunk_type": None if chunk_type is None else F.col("chunk_type") == chunk_type,
        "has_equations": None if has_equations is None else F.col("has_equations") == has_equations,
        "page_number": None if pages is None else F.col("page_number").between(*pages),
        "section_path": None if section is None else F.array_contains("section_path", section),
    }
    used = {k: v for k, v in tests.items() if v is not None}
    if columns is not None and (unknown := set(used) - set(columns)):
        raise ValueError(f"no such column to filter: {sorted(unknown)}")
    return reduce(lambda a, b: a & b, used.values()) if used else None


def dict_filters(wanted: dict[str, object], columns: list[str] | None = None) -> Column | None:
    """AND of conditions from a dictionary: {"gte": a, "lte": b} (also gt, lt) is a range, anything else equality; None if empty."""
    ranges = {"gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v}
    if columns is not None and (unknown := set(wanted) - set(columns)):
        raise ValueError(f"no such column to filter: {sorted(unknown)}")
    tests = []
    for name, value in wanted.items():
        if isinstance(value, dict):
            if bad := set(value) - set(ranges):
                raise ValueError(f"unknown bounds: {sorted(bad)}")
            tests += [ranges[k](F.col(name), v) for k, v in value.items()]
        else:
            tests.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, tests) if tests else None


def contains_all_parts(text: Column, query: str) -> Column:
    """Whether a text has every part of a query between white space, anywhere; an empty query matches all."""
    return reduce(lambda a, b: a & b, (F.contains(text, F.lit(p)) for p in query.split()), F.lit(True))


def contains_all_terms(tokens: Column, terms: Column) -> Column:
    """Whether all terms are among the tokens; without terms nothing matches."""
    return (F.size(terms) > 0) & (F.size(F.array_except(terms, tokens)) == 0)


def contains_json(document: Column, wanted: object) -> Column:
    """Whether a JSON text contains `wanted`: an object some of its fields, an array some of its elements in any place, a scalar its equal.

    Types count: "7" isn't 7, and true isn't "true"; 7 and 7.0 are equal. A text
    that is null or no JSON contains nothing.
    """
    return F.coalesce(contains_variant(F.try_parse_json(document), wanted), F.lit(False))


def _held_in(wanted: object):
    return lambda x: F.coalesce(contains_variant(x, wanted), F.lit(False))


def contains_variant(value: Column, wanted: object) -> Column:
    """The same for a VARIANT, which is parsed once whatever it is compared with."""
    kind = F.schema_of_variant(value)
    if isinstance(wanted, dict):
        fields = (contains_variant(F.try_variant_get(value, "$[" + json.dumps(k) + "]", "variant"), v) for k, v in wanted.items())
        return reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), fields, F.coalesce(F.startswith(kind, F.lit("OBJECT")), F.lit(False)))
    if isinstance(wanted, (list, tuple)):
        held = F.try_variant_get(value, "$", "array<variant>")
        each = (F.coalesce(F.exists(held, _held_in(w)), F.lit(False)) for w in wanted)
        return reduce(lambda a, b: a & b, each, F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False)))
    if wanted is None:
        return F.is_variant_null(value)
    if isinstance(wanted, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        return F.regexp_like(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")) & (F.try_variant_get(value, "$", "double") == float(wanted))
    return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == str(wanted))


def unexpired(expires_at: Column, now: Column) -> Column:
    """Whether something with an expiry is still valid; without one it always is."""
    return expires_at.isNull() | (expires_at > now)


def checked_limit(limit: int, most: int = 50) -> int:
    """A result limit from 1 to `most`; larger ones count as `most`, smaller ones are an error."""
    if limit < 1:
        raise ValueError("a limit must be at least 1")
    return min(limit, most)


def clamped(score: Column) -> Column:
    """A score within [0, 1]; a null stays one."""
    return F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def upsert(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """Last write wins: of each key the row of highest version, the new table's on ties; rows of null key are left out."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).where(F.col(key).isNotNull())
    order = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_new"))
    return both.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i", "_new")


def scroll(rows: DataFrame, key: str, after: int | None, limit: int) -> DataFrame:
    """A page of `limit` rows in key order from `after` on; the last row of limit + 1 tells where the next begins."""
    page = rows if after is None else rows.where(F.col(key) >= after)
    return page.orderBy(key).limit(limit + 1)


def reach(edges: DataFrame, depth: int, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(src, dst, depth): the shortest walks of up to `depth` edges; each round extends only what is new.

    `keep` cuts the plan after a round, so that a round doesn't repeat the ones
    before it; by default a checkpoint in the folder the session names, if it
    names one.
    """
    spark = edges.sparkSession
    if keep is None:
        folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if folder and not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        keep = (lambda df: df.checkpoint()) if folder else (lambda df: df)
    frontier = found = keep(edges.select("src", "dst").where("src <> dst").distinct().withColumn("depth", F.lit(1).cast("long")))
    steps = edges.select(F.col("src").alias("_via"), "dst")
    for d in range(2, depth + 1):
        step = frontier.select("src", F.col("dst").alias("_via")).join(steps, "_via").select("src", "dst").where("src <> dst").distinct()
        frontier = keep(step.join(found, ["src", "dst"], "left_anti").withColumn("depth", F.lit(d).cast("long")))
        found = found.unionByName(frontier)
    return found


def recent_messages(messages: DataFrame, n: int, session: str = "conv_id", order: str = "turn") -> DataFrame:
    """The newest n messages of each session, returned oldest first by `position`."""
    new = Window.partitionBy(session).orderBy(F.desc(order))
    old = Window.partitionBy(session).orderBy(order)
    return messages.withColumn("_i", F.row_number().over(new)).where(F.col("_i") <= n).drop("_i").withColumn("position", F.row_number().over(old).cast("long"))


# --- global order without a single task -----------------------------------------------


def positioned(rows: DataFrame, ts: str, tie: str) -> DataFrame:
    """Add `position`, the 1-based place in the order of (ts, tie).

    Rows are numbered within minutes; what goes before a minute comes from a
    running sum over minutes, of which there are some half a million a year.
    """
    counted = rows.withColumn("_hour", F.date_trunc("minute", F.col(ts)))
    hours = counted.groupBy("_hour").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("_hour", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_hour").orderBy(ts, tie)
    return counted.join(hours, "_hour").withColumn("position", F.col("_before") + F.row_number().over(within)).drop("_hour", "_before")


def rolling(rows: DataFrame, n: int, columns: dict[str, Column], block: int = 10_000) -> DataFrame:
    """Aggregates over each row and the n - 1 before it, by `position`.

    Blocks of positions are windows of their own; the last n - 1 rows of a
    block are copied to the next, so blocks are computed in parallel.
    """
    own = F.floor((F.col("position") - 1) / block)
    last = (F.col("position") - 1) % block >= block - (n - 1)
    copies = rows.withColumn("_block", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("_block").orderBy("position").rowsBetween(-(n - 1), 0)
    return copies.select("*", *(c.over(w).alias(k) for k, c in columns.items())).where(F.col("_block") == own).drop("_block")


def running(rows: DataFrame, columns: dict[str, Column], block: int = 10_000) -> DataFrame:
    """Sums over each row and all before it, by `position`: within blocks of positions, plus what the blocks before add up to."""
    marked = rows.select("*", F.floor((F.col("position") - 1) / block).alias("_block"))
    sums = marked.groupBy("_block").agg(*(F.sum(c).alias(f"_{k}") for k, c in columns.items()))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    sums = sums.select("_block", *(F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in columns))
    within = Window.partitionBy("_block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    both = marked.select("*", *(F.sum(c).over(within).alias(f"_own_{k}") for k, c in columns.items())).join(sums, "_block")
    return both.select(*rows.columns, *((F.col(f"_{k}") + F.col(f"_own_{k}")).alias(k) for k in columns))


# --- stores ---------------------------------------------------------------------------


def append_documents(documents: DataFrame, chunks: DataFrame, folder: str, batch: str) -> None:
    """Append a batch of documents with their chunks: chunks first, so `stored_chunks` never shows those of documents that aren't there yet.

    A batch that runs again overwrites its own folders.
    """
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch}")
    documents.write.mode("overwrite").parquet(f"{folder}/documents/batch={batch}")


def stored_chunks(documents: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks of the batches whose documents are stored."""
    return chunks.join(documents.select("batch", key).distinct(), ["batch", key], "left_semi")


def emptied(table: DataFrame, path: str) -> None:
    """Overwrite a Parquet table with no rows of the same columns."""
    table.limit(0).write.mode("overwrite").parquet(path)


def points(chunks: DataFrame, key: str, vector: str, required: list[str], optional: list[str]) -> DataFrame:
    """id, vector, payload: JSON with the required fields, and of the optional ones those that aren't null."""
    payload = F.to_json(F.struct(*required, *optional))  # leaves out fields that are null
    return chunks.select(F.col(key).alias("id"), F.col(vector).alias("vector"), payload.alias("payload"))


def comprehensive(**results: DataFrame) -> DataFrame:
    """Results of several searches (query_id, id, score) under their source's name, with each query's total; a source that is None failed and is left out."""
    parts = [df.select("query_id", F.col("id").cast("string").alias("id"), F.col("score").cast("double").alias("score"), F.lit(name).alias("source")) for name, df in results.items() if df is not None]
    if not parts:
        raise ValueError("no source gave results")
    return reduce(DataFrame.unionByName, parts).withColumn("total_results", F.count("*").over(Window.partitionBy("query_id")))


def remaining(**tables: DataFrame) -> DataFrame:
    """status, n: how many rows each table has, as one table."""
    return reduce(DataFrame.unionByName, (df.agg(F.count("*").alias("n")).select(F.lit(f"{name} remaining:").alias("status"), "n") for name, df in tables.items()))


def captured(rows: DataFrame, key: str, value: Column, problem: Column, continue_on_error: bool = True) -> DataFrame:
    """key, value, error of a step that can fail: a row with a problem has no value; without `continue_on_error` the first one stops the job."""
    error = problem if continue_on_error else F.when(problem.isNotNull(), F.raise_error(problem).cast("string"))
    return rows.select(key, error.alias("error"), value.alias("value")).select(key, F.when(F.col("error").isNull(), F.col("value")).alias("value"), "error")


def equations_of(hits: DataFrame, equations: DataFrame, hit: str = "id", parent: str = "context_chunk_id") -> DataFrame:
    """Hits with `equations`, an array of the structs of all equations of their chunk, in the order of their columns; empty for those that have none."""
    nested = equations.groupBy(F.col(parent).alias(hit)).agg(F.array_sort(F.collect_list(F.struct(*(c for c in equations.columns if c != parent)))).alias("equations"))
    return hits.join(nested, hit, "left").withColumn("equations", F.coalesce("equations", F.array().cast(nested.schema["equations"].dataType)))


def parents_of(equations: DataFrame, chunks: DataFrame, chunk: str = "id", parent: str = "context_chunk_id") -> DataFrame:
    """The chunk that each equation stands in; equations without one, or whose chunk isn't there, have no row."""
    return equations.join(chunks.withColumnRenamed(chunk, parent), parent)
