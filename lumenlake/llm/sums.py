"""Sums of arrays over tasks: every task adds up its rows, then slices of the arrays are added by a tree."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN_IN = 64
SCHEMA = "slice int, part int, sums binary"


def slices(values: np.ndarray, part: int, width: int, first: int = 0) -> pa.RecordBatch:
    """Rows (slice, part, sums) of one task's array, cut into runs of ``width`` values and numbered from ``first``."""
    flat = values.ravel()
    cut = [flat[a : a + width].tobytes() for a in range(0, len(flat), width)]
    columns = [pa.array(range(first, first + len(cut)), pa.int32()), pa.array([part] * len(cut), pa.int32()), pa.array(cut, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["slice", "part", "sums"])


def tree_sum(rows: DataFrame, kind: str, length: int) -> np.ndarray:
    """The sum of all tasks' arrays of ``length`` values, on the driver: as long as the model asks for, whatever the input.

    No task adds more than ``FAN_IN`` slices at once: parts are joined level by level.
    """

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, kind) for x in table.column("sums").to_pylist())
        one = table.slice(0, 1)
        return pa.table({"slice": one.column("slice"), "part": one.column("up"), "sums": pa.array([total.tobytes()], pa.binary())})

    levels = max(1, math.ceil(math.log(max(2, rows.rdd.getNumPartitions()), FAN_IN)))
    for _ in range(levels):
        up = rows.withColumn("up", F.floor(F.col("part") / FAN_IN).cast("int"))
        rows = up.groupBy("slice", "up").applyInArrow(lambda t: add(t), SCHEMA)
    found: dict[int, np.ndarray] = {}
    for row in rows.select("slice", "sums").collect():  # a plan may run in more tasks than it was planned for
        sums = np.frombuffer(row.sums, kind)
        found[row.slice] = found[row.slice] + sums if row.slice in found else sums
    return np.concatenate([found[k] for k in sorted(found)]) if found else np.zeros(length, kind)
