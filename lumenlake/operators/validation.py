"""Row rules that split a table into good rows and rejects with reasons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import CAPABILITY_PATTERN, MAX_BATCH, MAX_RESULTS_PER_ANALYSIS, MEDIA_TYPES

REASONS = "reject_reasons"


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add the names of all broken rules, in rule order. A rule is the *bad* condition."""
    broken = [F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]
    return df.withColumn(REASONS, F.array_compact(F.array(*broken)))


def split_rejects(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with reasons)."""
    checked = with_reasons(df, rules)
    good = checked.where(F.size(REASONS) == 0).drop(REASONS)
    return good, checked.where(F.size(REASONS) > 0)


def _bad_number(name: str, required: bool) -> Column:
    bad = (F.col(name) < 0) | F.isnan(F.col(name).cast("double"))
    bad = bad | (F.abs(F.col(name).cast("double")) == F.lit(float("inf")))
    return F.col(name).isNull() | bad if required else bad


def asset_rules() -> dict[str, Column]:
    rules = {
        "id": F.col("id").isNull() | (F.col("id") == ""),
        "media_type": F.col("media_type").isNull() | ~F.col("media_type").isin(*MEDIA_TYPES),
    }
    for name in ("created_at", "width", "height"):
        rules[name] = _bad_number(name, required=True)
    for name in ("modified_at", "duration", "file_size"):
        rules[name] = _bad_number(name, required=False)
    return rules


def analysis_rules() -> dict[str, Column]:
    def outside(name: str) -> Column:
        return ~F.col(name).between(0, 1) | F.isnan(name)

    rules = {
        "id": F.col("id").isNull() | (F.col("id") == ""),
        "analysis_version": F.col("analysis_version").isNull() | (F.col("analysis_version") <= 0),
        "model_version": F.col("model_version") == "",
        "analyzed_at": F.col("analyzed_at").isNull() | (F.col("analyzed_at") < 0),
    }
    for name in ("blur_score", "quality_score", "brightness_score"):
        rules[name] = outside(name)
    rules["face_count"] = F.col("face_count") < 0
    for name in ("perceptual_hash", "content_hash"):
        rules[name] = F.col(name) == ""
    results = F.col("capability_results")
    rules["result_count"] = F.size(results) > MAX_RESULTS_PER_ANALYSIS
    rules["result_content"] = F.exists(
        results,
        lambda r: r["capability_id"].isNull()
        | ~r["capability_id"].rlike(CAPABILITY_PATTERN)
        | r["status"].isNull()
        | ~r["status"].isin("completed", "failed")
        | F.coalesce(r["error"] == "", F.lit(False)),
    )
    return rules


def batch_rules() -> dict[str, Column]:
    """Rules for one scan batch, given its sizes and counters."""
    return {
        "job_id": F.col("job_id").isNull() | (F.col("job_id") == ""),
        "assets": F.col("asset_count") > MAX_BATCH,
        "analyses": F.col("analysis_count") > MAX_BATCH,
        "processed": F.col("processed").isNull() | (F.col("processed") < 0),
        "total": F.col("total").isNull() | (F.col("total") < 0),
        "progress": ~F.col("progress").between(0, 1) | F.isnan("progress"),
        "cursor": F.col("cursor") == "",
    }


def validate_assets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_rejects(df, asset_rules())


def validate_analyses(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_rejects(df, analysis_rules())


def validate_batches(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split_rejects(df, batch_rules())


def find_duplicate_keys(df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences")).where("occurrences > 1")
