"""Using all cores when the input comes in fewer pieces than there are cores."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Redistribute rows for CPU-heavy work, only if there are fewer partitions than task slots.

    A table of one file with one row group is read by one task. A large table
    has far more pieces than slots and is returned as it is, without a shuffle.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= slots else df.repartition(slots)


def spread_rows(df: DataFrame, most: int = 25_000) -> DataFrame:
    """As :func:`spread`, in pieces of at most about ``most`` rows however large the table is.

    For many cheap-to-store rows that cost much each: by their bytes, files of them make few and ever longer tasks. Counts
    the rows first, which for a Parquet table reads no column.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    pieces = max(slots, math.ceil(df.count() / most))
    return df if df.rdd.getNumPartitions() >= pieces else df.repartition(pieces)
