"""Parallelism of scans."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

#: Rows of a side that is broadcast at most; a larger one is joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Rows of a batch that a Python function makes objects of at a time.
SLICE = 256


def spread(rows: DataFrame) -> DataFrame:
    """Deal rows out anew if their scan has fewer splits than the session has cores, as a small file of one row group has.

    Large tables have more splits than cores and stay as they are. `rows` should
    be a scan with filters and projections; the number of splits of such a plan
    is known without running it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def sliced(make: Callable[[pa.Array], pa.Array], rows: int = SLICE) -> Callable[[pa.Array], pa.Array]:
    """The same function of a column, which sees `rows` of its rows at a time; what it made is kept as Arrow, not as objects."""

    def run(column: pa.Array) -> pa.Array:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return pa.concat_arrays([make(column.slice(i, rows)) for i in range(0, max(1, len(column)), rows)])

    return run
