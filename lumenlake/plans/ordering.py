"""Positions and running totals over a total order, without a one-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.session import cut_lineage


def _join_slices(rows: DataFrame, slices: DataFrame, group: Sequence[str]) -> DataFrame:
    """Join rows to their (slice, group) row; a null group is a group too.

    Without groups there is one row per partition, which always fits a broadcast.
    """
    named = slices.withColumnsRenamed({c: f"_of_{c}" for c in ("_slice", *group)})
    same = F.col("_slice") == F.col("_of__slice")
    for column in group:
        same = same & F.col(column).eqNullSafe(F.col(f"_of_{column}"))
    return rows.join(named if group else F.broadcast(named), same)


def ordered_totals(
    df: DataFrame,
    order: Sequence[Column],
    totals: dict[str, Column],
    group: Sequence[str] = (),
) -> DataFrame:
    """Add inclusive running sums of ``totals`` along ``order``, within ``group``.

    Rows are range-partitioned on (group, order), so one huge group is cut into
    many tasks. Each slice sums its own rows; the sums of the slices before it
    (one row per slice and group) are added afterwards. The ranged rows are
    checkpointed, because both reads must see the same slices.
    """
    keys = [F.col(name) for name in group]
    values = {f"_{name}": expr for name, expr in totals.items()}
    ranged = cut_lineage(
        df.withColumns(values)
        .repartitionByRange(*[k.asc() for k in keys], *order)
        .withColumn("_slice", F.spark_partition_id())
    )
    within = Window.partitionBy("_slice", *keys).orderBy(*order)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slices = ranged.groupBy("_slice", *keys).agg(*[F.sum(v).alias(f"{v}_slice") for v in values])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        "_slice",
        *keys,
        *[F.coalesce(F.sum(f"{v}_slice").over(before), F.lit(0)).alias(f"{v}_before") for v in values],
    )
    summed = ranged.select("*", *[F.sum(v).over(running).alias(f"{v}_run") for v in values])
    joined = _join_slices(summed, offsets, group)
    return joined.select(
        *df.columns, *[(F.col(f"_{n}_run") + F.col(f"_{n}_before")).alias(n) for n in totals]
    )


# monotonically_increasing_id holds the partition above bit 33 and the row within it below.
ROW_BITS = 33


def row_numbers(
    df: DataFrame, order: Sequence[Column], name: str = "position", group: Sequence[str] = ()
) -> DataFrame:
    """Add the 1-based position of every row in the order (within its group).

    Each range-partitioned, sorted slice numbers its own rows; how many rows of
    the group came in earlier slices, and where the group starts in this one,
    is added from one small row per slice and group. Without groups nothing is
    shuffled after the range partitioning.
    """
    keys = [F.col(column) for column in group]
    sorting = [*[key.asc() for key in keys], *order]
    ranged = cut_lineage(
        df.repartitionByRange(*sorting)
        .sortWithinPartitions(*sorting)
        .withColumn("_row", F.monotonically_increasing_id())
    ).withColumns(
        {
            "_slice": F.shiftright("_row", ROW_BITS),
            "_index": F.col("_row").bitwiseAND(F.lit((1 << ROW_BITS) - 1)),
        }
    )
    slices = ranged.groupBy("_slice", *keys).agg(
        F.count(F.lit(1)).alias("_count"), F.min("_index").alias("_first")
    )
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        "_slice", *keys, "_first", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before")
    )
    joined = _join_slices(ranged, starts, group)
    position = F.col("_before") + F.col("_index") - F.col("_first") + 1
    return joined.select(*df.columns, position.alias(name))


def rows_between(df: DataFrame, order: Sequence[Column], after: int, upto: int, name: str = "position") -> DataFrame:
    """The rows whose 1-based position in a total order is above ``after`` and not above ``upto``, with it.

    Rows are range-partitioned once and counted by slice; the counts, one for each partition, tell which slices hold the
    wanted positions. Only these are sorted, so a deep page costs a pass over the rows and the sort of a slice or two.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    touched, before = [], 0
    for row in ranged.groupBy("_slice").count().orderBy("_slice").collect():
        if before < upto and before + row["count"] > after:
            touched.append((row["_slice"], before))
        before += row["count"]
    if not touched:
        return ranged.where(F.lit(False)).drop("_slice").withColumn(name, F.lit(0).cast("bigint"))
    starts = F.create_map(*[F.lit(x) for pair in touched for x in pair])
    mine = ranged.where(F.col("_slice").isin([s for s, _ in touched]))
    within = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    placed = mine.withColumn(name, (F.element_at(starts, F.col("_slice")) + within).cast("bigint"))
    return placed.where((F.col(name) > after) & (F.col(name) <= upto)).drop("_slice")


def prefix_totals(df: DataFrame, order: Sequence[Column], name: str, value: Column, bound: int) -> DataFrame:
    """Rows of a total order with their running sum, up to the slice in which it reaches ``bound``; values are not negative.

    Slices behind that one are summed but not sorted.
    """
    ranged = cut_lineage(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()))
    touched, before = [], 0
    for row in ranged.groupBy("_slice").agg(F.sum("_value").alias("s")).orderBy("_slice").collect():
        if before < bound:
            touched.append((row["_slice"], before))
        before += row["s"] or 0
    if not touched:
        return ranged.where(F.lit(False)).select(*df.columns, F.lit(0).cast("bigint").alias(name))
    starts = F.create_map(*[F.lit(x) for pair in touched for x in pair])
    mine = ranged.where(F.col("_slice").isin([s for s, _ in touched]))
    running = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = (F.element_at(starts, F.col("_slice")) + F.sum("_value").over(running)).cast("bigint")
    return mine.withColumn(name, summed).select(*df.columns, name)
