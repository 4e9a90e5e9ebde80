"""Reading asset listings and turning raw device rows into the asset schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake import schemas
from lumenlake.constants import CATEGORIES

# fixed value: the latest accepted creation-date bound, in epoch milliseconds
MAX_DATE_MS = 8_640_000_000_000_000


def in_category(
    category: str,
    media_type: Column | None = None,
    favorite: Column | None = None,
    screenshot: Column | None = None,
) -> Column:
    """Predicate of one listing category; categories outside the set are refused."""
    if category not in CATEGORIES:
        raise ValueError(f"unknown category {category!r}")
    media_type = F.col("media_type") if media_type is None else media_type
    if category == "photos":
        return media_type == "photo"
    if category == "videos":
        return media_type == "video"
    if category == "favorites":
        return F.col("favorite") if favorite is None else favorite
    if category == "screenshots":
        flag = F.col("is_screenshot") if screenshot is None else screenshot
        return (media_type == "photo") & flag
    return F.lit(True)


def select_category(
    df: DataFrame, category: str = "all", before: int | None = None, screenshot: Column | None = None
) -> DataFrame:
    """Rows of a category created strictly before a bound; plain filters, so they reach the scan."""
    if before is not None and not 1 <= before <= MAX_DATE_MS:
        raise ValueError("before is out of range")
    picked = df.where(in_category(category, screenshot=screenshot))
    return picked if before is None else picked.where(F.col("created_at") < F.lit(before))


def read_assets(
    spark: SparkSession, path: str, category: str = "all", before: int | None = None
) -> DataFrame:
    """Asset table at ``path`` restricted to a category and a creation bound."""
    return select_category(spark.read.parquet(path), category, before)


def normalize_listing(df: DataFrame) -> DataFrame:
    """Raw device columns to asset columns.

    Taken time wins when positive, else the added time in seconds; missing
    numbers count as zero; only videos carry a duration.
    """

    def number(name: str) -> Column:
        return F.coalesce(F.col(name).cast("bigint"), F.lit(0).cast("bigint"))

    video = number("media_type") == 3
    return df.select(
        F.concat_ws(
            ":", F.lit("android"), number("_id").cast("string"), F.when(video, "v").otherwise("p")
        ).alias("id"),
        F.when(video, "video").otherwise("photo").alias("media_type"),
        F.when(number("datetaken") > 0, number("datetaken"))
        .otherwise(number("date_added") * 1000)
        .alias("created_at"),
        (number("date_modified") * 1000).alias("modified_at"),
        number("width").alias("width"),
        number("height").alias("height"),
        number("_size").alias("file_size"),
        F.when(video, number("duration") / F.lit(1000.0)).alias("duration"),
        (number("is_favorite") == 1).alias("favorite"),
    )


def live_assets(df: DataFrame) -> DataFrame:
    """Images (1) and videos (3) that are neither in the trash nor still being written."""
    return df.where(
        F.col("media_type").isin(1, 3) & (F.col("is_trashed") == 0) & (F.col("is_pending") == 0)
    )


def count_assets(df: DataFrame) -> DataFrame:
    """One row: the number of live assets."""
    return live_assets(df).agg(F.count(F.lit(1)).alias("total"))


def row_projection(df: DataFrame) -> DataFrame:
    """Stored rows as asset records: declared columns in order, 0/1 flags as booleans, missing columns null."""
    types = schemas.column_types(schemas.ASSETS)
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in types.items()
        ]
    )


def screenshot_listing_rule(name: Column, path: Column) -> Column:
    """Listing rule: the folder must be named; ``_`` matches any character."""
    name, path = F.lower(name), F.lower(path)
    return path.like("%screenshots/%") | name.like("screenshot%") | name.like("screen_shot%")


def screenshot_analysis_rule(name: Column, path: Column) -> Column:
    """Analysis rule: any mention in the path, or a name prefix; missing values count as empty."""
    name, path = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(path, F.lit("")))
    return path.contains("screenshot") | name.startswith("screenshot") | name.startswith("screen_shot")
