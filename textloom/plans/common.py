"""Helpers of the query modules: tables, literal rows in both dialects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values_sql(rows: list[tuple], columns: str) -> str:
    """A derived table of literal rows for the SQL side."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows) + f") AS v({columns})"


def rows_df(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


_TYPES = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}


class Derived:
    """Literal rows united with rows made from tables, by expressions that both engines read.

    `schema` is like "id int, text string"; `made` has for a table an expression
    per column, and may have a condition as its last one.
    """

    def __init__(self, rows: list[tuple], schema: str, *made: tuple):
        self.rows, self.schema, self.made = rows, schema, made
        self.fields = [f.split() for f in schema.split(", ")]

    def df(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = rows_df(spark, self.rows, self.schema)
        for name, *found in self.made:
            frame = table(spark, sf_dir, name)
            if len(found) > len(self.fields):
                frame = frame.where(found[-1])
            out = out.unionByName(frame.selectExpr(*(f"CAST({e} AS {'bigint' if t == 'long' else t}) AS `{c}`" for (c, t), e in zip(self.fields, found))))
        return out

    def sql(self) -> str:
        names = ", ".join(f'"{c}"' for c, _ in self.fields)
        parts = ["SELECT " + ", ".join(f'CAST("{c}" AS {_TYPES[t]}) AS "{c}"' for c, t in self.fields) + f" FROM {values_sql(self.rows, names)}"]
        for name, *found in self.made:
            where = f" WHERE {found[-1]}" if len(found) > len(self.fields) else ""
            parts.append("SELECT " + ", ".join(f'CAST({e} AS {_TYPES[t]}) AS "{c}"' for (c, t), e in zip(self.fields, found)) + f" FROM {name}{where}")
        return "(" + " UNION ALL ".join(parts) + ")"
