"""Durable tables as plain Parquet: whole snapshots and per-batch deltas.

A snapshot version is complete once its ``_SUCCESS`` marker exists, so readers
never see half a write. A batch is a directory named by its batch id and is
overwritten as a whole, so replaying a batch after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _filesystem(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def snapshot_versions(spark: SparkSession, path: str) -> list[int]:
    """Complete versions of the table at ``path``, oldest first (one listing of the markers)."""
    fs, marks = _filesystem(spark, f"{path}/version=*/_SUCCESS")
    found = fs.globStatus(marks) or []
    return sorted(int(mark.getPath().getParent().getName().removeprefix("version=")) for mark in found)


def write_snapshot(df: DataFrame, path: str, version: int) -> str:
    """Write a whole new version next to the old ones; readers switch when it is complete.

    A complete version is never written again, as it may be what ``df`` or another reader reads.
    """
    target = f"{path}/version={version}"
    fs, mark = _filesystem(df.sparkSession, f"{target}/_SUCCESS")
    if not fs.exists(mark):
        df.write.mode("overwrite").parquet(target)
    return target


def drop_old_snapshots(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` complete versions; returns what went. Readers of those need to be done."""
    old = snapshot_versions(spark, path)[:-keep]
    for version in old:
        fs, folder = _filesystem(spark, f"{path}/version={version}")
        fs.delete(folder, True)
    return old


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Read one version, the newest complete one by default."""
    if version is None:
        versions = snapshot_versions(spark, path)
        if not versions:
            raise FileNotFoundError(f"no complete snapshot under {path}")
        version = versions[-1]
    return spark.read.parquet(f"{path}/version={version}")


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Replace the delta of one batch. The cost follows the batch, not the table."""
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def drop_batches(spark: SparkSession, path: str, upto: int) -> list[int]:
    """Delete the deltas of all batches up to one; returns their ids."""
    fs, folders = _filesystem(spark, f"{path}/batch_id=*")
    gone = []
    for status in fs.globStatus(folders) or []:
        batch_id = int(status.getPath().getName().removeprefix("batch_id="))
        if batch_id <= upto:
            fs.delete(status.getPath(), True)
            gone.append(batch_id)
    return sorted(gone)


def partition_for_reading(df: DataFrame, buckets: int) -> DataFrame:
    """Catalog layout: media type and creation month as directories, sorted by creation time.

    Filters on type and time then prune directories and row groups. Rows of one
    month are spread over ``buckets`` tasks, so a busy month is no single task.
    """
    month = F.date_format(F.timestamp_millis("created_at"), "yyyy-MM")
    return (
        df.withColumn("created_month", month)
        .repartition("media_type", "created_month", F.pmod(F.xxhash64("id"), F.lit(buckets)))
        .sortWithinPartitions("media_type", "created_month", "created_at")
    )


def save_bucketed(df: DataFrame, table: str, buckets: int, key: str = "id") -> None:
    """Save as a catalog table bucketed and sorted by the asset id.

    Asset and signal tables with the same number of buckets join without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
