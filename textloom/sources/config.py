"""Settings in nested dictionaries, read from JSON files of any file system that Spark reads."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


class Config:
    """`get("a.b.c", default)` walks nested dictionaries; a missing step gives the default."""

    def __init__(self, values: dict[str, Any]):
        self.values = values

    @staticmethod
    def load(spark: SparkSession, path: str) -> Config:
        return Config(json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())))

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for step in name.split("."):
            if not isinstance(at, dict) or step not in at:
                return default
            at = at[step]
        return at

    def merged(self, other: dict[str, Any]) -> Config:
        """These settings with others over them, level by level."""

        def over(a: Any, b: Any) -> Any:
            return {k: over(a.get(k), b[k]) if k in b else a[k] for k in {**a, **b}} if isinstance(a, dict) and isinstance(b, dict) else b

        return Config(over(self.values, other))

    def apply(self, spark: SparkSession, section: str = "spark") -> None:
        """Set the session's runtime settings from a section, whose keys are joined by dots."""

        def walk(prefix: str, value: Any) -> None:
            if isinstance(value, dict):
                for k, v in value.items():
                    walk(f"{prefix}.{k}", v)
            else:
                spark.conf.set(prefix, str(value).lower() if isinstance(value, bool) else str(value))

        walk(section, self.get(section, {}))
