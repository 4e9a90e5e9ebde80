"""Library reports and per-key aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import BLURRY_FROM, LARGE_VIDEO_FROM
from lumenlake.operators.staleness import completed_work, needs_work
from lumenlake.plans.ordering import row_numbers


def known_sum(column: Column | str) -> Column:
    """Sum of the known values, zero if there are none."""
    return F.coalesce(F.sum(column), F.lit(0).cast("bigint"))


def enrich(assets: DataFrame, quality: DataFrame, content: DataFrame) -> DataFrame:
    """Assets with their quality signals and content flags (left joins, one row per asset)."""
    signals = quality.select("id", "blur_score", "quality_score", "brightness_score", "face_count")
    flags = content.select("id", "is_screenshot")
    return assets.join(signals, "id", "left").join(flags, "id", "left")


def library_summary(assets: DataFrame) -> DataFrame:
    """One row: photos, videos and known bytes."""
    return assets.agg(
        F.count_if(F.col("media_type") == "photo").alias("photos"),
        F.count_if(F.col("media_type") == "video").alias("videos"),
        known_sum("file_size").alias("known_bytes"),
    )


def library_insights(
    assets: DataFrame, quality: DataFrame, content: DataFrame, capabilities: DataFrame
) -> DataFrame:
    """One row of library figures from one pass over the joined tables."""
    large = (F.col("media_type") == "video") & (F.col("file_size") >= LARGE_VIDEO_FROM)
    joined = enrich(assets, quality, content).join(completed_work(capabilities), "id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total"),
        known_sum("file_size").alias("known_bytes"),
        F.count_if(F.col("file_size").isNull()).alias("unknown_sizes"),
        F.count_if(needs_work("deep")).alias("pending"),
        F.count_if(needs_work("fast")).alias("fast_pending"),
        F.count_if(F.col("is_screenshot")).alias("screenshots"),
        F.count_if(F.col("blur_score") >= BLURRY_FROM).alias("blurry"),
        F.count_if(large).alias("large_videos"),
        known_sum(F.when(large, F.col("file_size"))).alias("large_video_bytes"),
    )


def duplicate_savings(fresh: DataFrame) -> DataFrame:
    """One row: excess exact copies and their bytes.

    Every favorite is kept; a group without favorites keeps its smallest id.
    Needs only sums per content hash, combined before the shuffle, so a huge
    group of copies costs no more than a small one.
    """
    other = ~F.col("favorite")
    groups = (
        fresh.where(F.col("content_hash").isNotNull())
        .groupBy("content_hash")
        .agg(
            F.count_if(other).alias("others"),
            F.bool_or("favorite").alias("has_favorite"),
            known_sum(F.when(other, F.col("file_size"))).alias("bytes"),
            F.min_by("file_size", F.when(other, F.col("id"))).alias("keeper_size"),
        )
    )
    spared = F.when(F.col("has_favorite"), F.lit(0)).otherwise(F.lit(1))
    spared_bytes = F.when(F.col("has_favorite"), F.lit(0)).otherwise(F.coalesce("keeper_size", F.lit(0)))
    return groups.agg(
        F.coalesce(F.sum(F.col("others") - spared), F.lit(0)).alias("duplicate_copies"),
        F.coalesce(F.sum(F.col("bytes") - spared_bytes), F.lit(0)).alias("duplicate_bytes"),
    )


def similar_photo_count(assets: DataFrame, memberships: DataFrame) -> DataFrame:
    """One row: photos in any cluster of at least two assets (videos count as members only)."""
    photos = assets.where(F.col("media_type") == "photo").select("id")
    return photos.join(memberships.where("in_similar"), "id", "left_semi").agg(
        F.count(F.lit(1)).alias("similar_photos")
    )


def keeper_rank(df: DataFrame, group: str | Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Add ``position`` within the group (the keeper is 1); large groups are cut into slices."""
    groups = [group] if isinstance(group, str) else list(group)
    return row_numbers(df, order, "position", groups)


def stage_profile(
    df: DataFrame, stage: str = "stage", metric: str = "metric", millis: str = "millis", at: str = "at"
) -> DataFrame:
    """Per stage and metric: summed time, number of measurements, and wall time from first to last."""
    return df.groupBy(stage, metric).agg(
        F.sum(millis).alias("total_ms"),
        F.count(F.lit(1)).alias("measurements"),
        (F.max(at) - F.min(at)).alias("wall_ms"),
    )


def capability_health(capabilities: DataFrame) -> DataFrame:
    """Completed and failed results per capability and model version."""
    return capabilities.groupBy("capability_id", "model_version").agg(
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
    )


def cleanup_summary(df: DataFrame, run: str | Sequence[str], size: str = "file_size") -> DataFrame:
    """Per cleanup run (and outcome): number of assets and recovered bytes; unknown sizes add nothing."""
    keys = [run] if isinstance(run, str) else list(run)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("asset_count"), known_sum(size).alias("recovered_bytes")
    )
