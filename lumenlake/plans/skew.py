"""Joining rows to a one-row-per-key lookup when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
# Rows without a key have no weight in a lookup.
NULL_SALTS = 1024


def by_key(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the table: it is sorted and merged with the other one, never broadcast.

    Spark sizes rows by the file they come from: behind an explode, a step in Python or a compressed file there are many
    times more, and a table of 9 MB on disk becomes a broadcast of 500 MB that the driver has to hold.
    """
    return side.hint("merge")


def join_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    key: str,
    weight: Column,
    spread_by: str,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Join ``rows`` to ``lookup`` (unique on ``key``) without a hot task.

    ``weight`` is the number of rows per key, known from the lookup. Keys above
    ``hot_rows`` are at most rows / hot_rows many, so their list is small enough
    to broadcast whatever the table size. Rows of such a key are spread over one
    reducer for each ``hot_rows`` of its rows; only the few hot lookup rows are
    repeated, as often. Rows without a key match nothing and are spread too. ``sizes`` gives key and
    weight from a cheaper table than the lookup, if there is one.
    """
    salts = F.ceil(weight / hot_rows).cast("int")
    hot_keys = (lookup if sizes is None else sizes).where(weight > hot_rows).select(key, salts.alias("_salts"))
    spread = F.when(F.col(key).isNull(), F.lit(NULL_SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))
    salted_rows = rows.join(F.broadcast(hot_keys), key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), spread).cast("int")
    )
    copies = F.when(weight > hot_rows, salts - 1).otherwise(F.lit(0))
    salted_lookup = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), copies)))
    return salted_rows.drop("_salts").join(salted_lookup, [key, "_salt"], how).drop("_salt")
