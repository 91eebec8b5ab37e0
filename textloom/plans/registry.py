"""Named queries over the standard tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation_queries, file_queries, index_queries, model_queries, ops_queries, search_queries, sketch_queries, sql_queries, stream_queries, structure_queries, text_queries

_MODULES = (text_queries, search_queries, ops_queries, model_queries, structure_queries, evaluation_queries, index_queries, stream_queries, sketch_queries, sql_queries, file_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every registered query: (spark, folder of tables) -> DataFrame."""
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
