"""Streaming ingest: every batch is committed as one directory, state is merged when read.

A batch costs what it holds, not what the table holds. The directory is named
by the batch id, so a batch replayed after a failure replaces itself. The
checkpoint moves on only after the directory is complete. ``compact`` folds
batches into a fresh folder of all tables and then publishes it: one pointer,
whose version is the last batch id it contains, switches every table at once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenlake import schemas as S
from lumenlake.operators import merges
from lumenlake.sources.tables import (
    drop_batches,
    drop_old_snapshots,
    read_snapshot,
    snapshot_versions,
    write_batch,
    write_snapshot,
)

ASSET_COLUMNS = S.columns(S.ASSETS)
# One wide row per event: the asset, and its analysis where there is one.
CHANGES = f"{S.ASSETS}, seq bigint, analysis struct<{S.ANALYSES.removeprefix('id string, ')}>"
TABLES = ("assets", "quality", "content", "hashes", "texts", "capabilities")


def start_ingest(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    after_commit: Callable[[SparkSession, int], None] | None = None,
) -> StreamingQuery:
    """Start committing a stream of change rows (schema ``CHANGES``) to ``path``.

    ``after_commit`` runs once per batch after its rows are safe. Stopping the
    query and starting it again with the same checkpoint resumes exactly.
    """

    def commit(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, f"{path}/changes", batch_id)
        if after_commit:
            after_commit(batch.sparkSession, batch_id)

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def _published(spark: SparkSession, path: str) -> tuple[int, str | None]:
    """(last batch, folder) of the newest published snapshot; (-1, None) before the first."""
    versions = snapshot_versions(spark, f"{path}/published")
    if not versions:
        return -1, None
    return versions[-1], read_snapshot(spark, f"{path}/published", versions[-1]).first().folder


def current_tables(spark: SparkSession, path: str, upto: int | None = None) -> dict[str, DataFrame]:
    """Signal tables as of the last committed batch (or batch ``upto``): published snapshot plus later batches."""
    done, folder = _published(spark, path)
    changes = spark.read.schema(f"{CHANGES}, batch_id bigint").parquet(f"{path}/changes")
    changes = changes.where(F.col("batch_id") > done)
    if upto is not None:
        changes = changes.where(F.col("batch_id") <= upto)
    changes = changes.withColumn("seq", F.struct("batch_id", "seq"))
    analyses = changes.where(F.col("analysis").isNotNull()).select("id", "seq", "analysis.*")

    def base(name: str, schema: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{folder}/{name}") if folder else _empty(spark, schema)

    return {
        "assets": merges.upsert_latest(
            base("assets", S.ASSETS), changes.select(*ASSET_COLUMNS, "seq"), "id", "seq"
        ),
        "quality": merges.merge_quality(base("quality", S.QUALITY), analyses),
        "content": merges.merge_content(base("content", S.CONTENT), analyses),
        "hashes": merges.merge_hashes(base("hashes", S.HASHES), analyses),
        "texts": merges.merge_text(base("texts", S.TEXTS), analyses),
        "capabilities": merges.upsert_capability_status(base("capabilities", S.CAPABILITIES), analyses),
    }


def compact(spark: SparkSession, path: str) -> int:
    """Fold all committed batches into a new snapshot, publish it, and return its last batch.

    Without a new batch nothing is written. The tables go to a folder of their own, so what is being read is never
    overwritten; a run that breaks off leaves a folder nobody reads, and the next one starts afresh. A batch that
    is committed meanwhile stays a batch.
    """
    done, _ = _published(spark, path)
    last = spark.read.schema("batch_id bigint").parquet(f"{path}/changes").agg(F.max("batch_id")).first()[0]
    if last is None or last <= done:
        return done
    folder = f"state/{int(last)}-{uuid.uuid4().hex}"
    for name, rows in current_tables(spark, path, int(last)).items():
        rows.write.parquet(f"{path}/{folder}/{name}")
    pointer = spark.createDataFrame([(folder,)], "folder string").coalesce(1)
    write_snapshot(pointer, f"{path}/published", int(last))
    return int(last)


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete pointers but the newest ``keep`` and the batches that the oldest kept one contains.

    Call it when readers of older state are done. Returns the ids of the deleted batches. Their folders below
    ``state`` go with the pointers.
    """
    versions = snapshot_versions(spark, f"{path}/published")
    for version in versions[:-keep]:
        folder = read_snapshot(spark, f"{path}/published", version).first().folder
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{folder}")
        root.getFileSystem(spark._jsc.hadoopConfiguration()).delete(root, True)
    drop_old_snapshots(spark, f"{path}/published", keep)
    kept = versions[-keep:]
    return drop_batches(spark, f"{path}/changes", kept[0]) if kept else []
