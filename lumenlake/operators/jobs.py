"""Scan jobs: an append-only log, the latest state per job, and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.merges import latest_by_key


def percent(processed: Column, total: Column) -> Column:
    """Whole percent, 0 while the total is unknown."""
    done = F.least(total, F.greatest(F.lit(0), processed))
    return F.when(total > 0, F.round(done * 100.0 / total)).otherwise(0).cast("int")


def job_progress(log: DataFrame) -> DataFrame:
    """Latest state and percent per job from the job log (job_id, processed, total, status, updated_at)."""
    latest = latest_by_key(log, "job_id", "updated_at")
    return latest.withColumn("percent", percent(F.col("processed"), F.col("total")))


def may_reconcile(log: DataFrame, job_id: str) -> DataFrame:
    """One row: whether the job completed. Only then may unseen assets be dropped."""
    mine = log.where(F.col("job_id") == job_id)
    return mine.agg(
        F.coalesce(F.max_by("status", "updated_at") == "completed", F.lit(False)).alias("completed")
    )
