"""Streaming views: pending work per batch, latest state per key, running counts."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from lumenlake.operators.merges import latest_by_key
from lumenlake.operators.staleness import needs_work
from lumenlake.sources.tables import (
    _filesystem,
    drop_batches,
    drop_old_snapshots,
    read_snapshot,
    snapshot_versions,
    write_batch,
    write_snapshot,
)

# fixed values: running counts and clusters are refreshed at most this often
INSIGHT_INTERVAL = "1 second"
CLUSTER_SECONDS = 5.0
KEPT_VERSIONS = 3


def stream_pending(stream: DataFrame, work: DataFrame, stage: str) -> DataFrame:
    """Of the arriving assets only those that need work: a stream joined with a static table.

    ``work`` is the stored output of ``completed_work``, one narrow row per
    asset. Every batch reads it, so it must not be an aggregation of its own;
    bucketed by id it is not shuffled either.
    """
    return stream.join(work, "id", "left").where(needs_work(stage)).select(*stream.columns)


def stream_latest(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest row per key of an update stream, for update or complete output mode.

    State is one row per key; on a cluster use the RocksDB state store, which
    keeps it on disk and restores it from the checkpoint.
    """
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_row")).select(key, "_row.*")


def stream_totals(stream: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Running totals over everything seen so far; state is a single row."""
    return stream.agg(*[expr.alias(name) for name, expr in totals.items()])


class AtMostEvery:
    """A commit callback that runs ``action`` (a cluster rebuild, say) no more often than given.

    A batch inside the interval is remembered; ``finish`` runs the action for it. See :func:`finish_stream`.
    """

    def __init__(self, action: Callable[[SparkSession, int], None], seconds: float = CLUSTER_SECONDS):
        self.action, self.seconds = action, seconds
        self.last, self.missed = float("-inf"), None

    def __call__(self, spark: SparkSession, batch_id: int) -> None:
        self.missed = batch_id
        if time.monotonic() - self.last >= self.seconds:
            self.finish(spark)

    def finish(self, spark: SparkSession) -> None:
        """Run the action for the last batch, if it hasn't been."""
        if self.missed is not None:
            batch_id, self.missed = self.missed, None
            self.action(spark, batch_id)
            self.last = time.monotonic()


def at_most_every(action: Callable[[SparkSession, int], None], seconds: float = CLUSTER_SECONDS) -> AtMostEvery:
    return AtMostEvery(action, seconds)


def finish_stream(query: StreamingQuery, refresh: AtMostEvery, spark: SparkSession) -> None:
    """Wait for a stream to end, however it ends, and refresh once more for its last batches."""
    try:
        query.awaitTermination()
    finally:
        refresh.finish(spark)


def append_to(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append output, one replaceable directory per batch."""
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def updates_to(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Changed keys of every batch; the reader keeps the row with the largest ``batch_id`` per key."""
    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, batch_id: write_batch(batch, path, batch_id))
    return writer.trigger(**(trigger or {"availableNow": True})).start()


FOLD_EVERY = 10


def latest_to(
    df: DataFrame, path: str, checkpoint: str, key: str, trigger: dict | None = None, fold_every: int = FOLD_EVERY
) -> StreamingQuery:
    """Changed keys of every batch (output of :func:`stream_latest`), folded into one row for each key as it goes.

    Every ``fold_every`` batches the deltas since the last fold become a new snapshot and are deleted once it is
    complete; two snapshots stay, for readers that hold one. So the number of folders does not grow with the batches,
    and a run that breaks off anywhere has either the deltas or the snapshot they are in. Read with :func:`read_latest`.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        write_batch(batch, f"{path}/updates", batch_id)
        if (batch_id + 1) % fold_every == 0:
            write_snapshot(read_latest(spark, path, key, batch.schema), f"{path}/folded", batch_id)
            drop_batches(spark, f"{path}/updates", batch_id)
            drop_old_snapshots(spark, f"{path}/folded", 2)

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(commit)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def read_latest(spark: SparkSession, path: str, key: str, schema: StructType) -> DataFrame:
    """One row for each key, as of the last batch that :func:`latest_to` has stored."""
    versions = snapshot_versions(spark, f"{path}/folded")
    done = versions[-1] if versions else -1
    files, folder = _filesystem(spark, f"{path}/updates/batch_id=*")
    rows = read_snapshot(spark, f"{path}/folded", done).select(*schema.names).withColumn("batch_id", F.lit(done).cast("bigint")) if versions else None
    if files.globStatus(folder):
        held = StructType([*schema.fields, StructField("batch_id", LongType())])
        updates = spark.read.schema(held).option("basePath", f"{path}/updates").parquet(f"{path}/updates").where(F.col("batch_id") > done)
        rows = updates if rows is None else rows.unionByName(updates)
    if rows is None:
        return spark.createDataFrame([], schema)
    return latest_by_key(rows, key, "batch_id").drop("batch_id")


def totals_to(df: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Replace a one-row table with every refresh; the default trigger limits the rate.

    Of the older versions the last few stay, for readers that hold one.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        write_snapshot(batch, path, batch_id)
        drop_old_snapshots(batch.sparkSession, path, KEPT_VERSIONS)

    writer = df.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(replace)
    return writer.trigger(**(trigger or {"processingTime": INSIGHT_INTERVAL})).start()
