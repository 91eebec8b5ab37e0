"""Session helpers: sensible defaults, and the package on every executor."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "textloom", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; keyword names use `__` for dots."""
    builder = SparkSession.builder.appName(app)
    defaults = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for key, value in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors unless their Python path already has it."""
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if app in _shipped or str(root) in (os.path.realpath(p) for p in known if p):
        return
    target = Path(tempfile.mkdtemp()) / "textloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for file in sorted((root / "textloom").rglob("*.py")):
            z.write(file, file.relative_to(root))
    path = list(sys.path)
    spark.sparkContext.addPyFile(str(target))
    sys.path[:] = path
    _shipped.add(app)
