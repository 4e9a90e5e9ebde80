"""Which assets need (re)analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import (
    ANALYSIS_VERSION,
    CACHE_TTL_MS,
    DEEP_MODEL,
    FAST_MODEL,
    IOS_PATTERN,
    STAGES,
)


def freshness_gate(analyzed_at: Column | str, modified_at: Column | str) -> Column:
    """Analysed at or after the last modification; an unknown modification counts as zero."""
    analyzed = F.col(analyzed_at) if isinstance(analyzed_at, str) else analyzed_at
    modified = F.col(modified_at) if isinstance(modified_at, str) else modified_at
    return analyzed >= F.coalesce(modified, F.lit(0))


def is_ios(id_col: Column) -> Column:
    return F.lower(id_col).like(IOS_PATTERN)


def accepted_model(id_col: Column, model: Column, stage: str) -> Column:
    """The model generation counts for the stage on the asset's platform."""

    def models(platform: str) -> list[str]:
        return [DEEP_MODEL[platform]] + ([FAST_MODEL[platform]] if stage == "fast" else [])

    return F.when(is_ios(id_col), model.isin(models("ios"))).otherwise(model.isin(models("android")))


def completed_work(capabilities: DataFrame, stages: tuple[str, ...] = ("fast", "deep")) -> DataFrame:
    """Per asset and stage: accepted completed capabilities and the oldest of their times.

    (asset, capability) is unique, so "all required ones are fresh" is the same
    as "all are there and the oldest is fresh" and needs no join before the sum.
    """
    done = (F.col("status") == "completed") & (F.col("analysis_version") == ANALYSIS_VERSION)
    wanted = F.col("capability_id").isin(*{c for s in stages for c in STAGES[s]})
    counted = []
    for stage in stages:
        ok = F.col("capability_id").isin(*STAGES[stage]) & accepted_model(
            F.col("id"), F.col("model_version"), stage
        )
        counted += [
            F.count_if(ok).alias(f"{stage}_done"),
            F.min(F.when(ok, F.col("analyzed_at"))).alias(f"{stage}_oldest"),
        ]
    return capabilities.where(done & wanted).groupBy("id").agg(*counted)


def needs_work(stage: str) -> Column:
    """Pending test over an asset joined with :func:`completed_work`."""
    complete = (F.col(f"{stage}_done") >= len(STAGES[stage])) & freshness_gate(
        f"{stage}_oldest", "modified_at"
    )
    return ~F.coalesce(complete, F.lit(False))


def pending_assets(assets: DataFrame, capabilities: DataFrame, stage: str) -> DataFrame:
    """Assets whose required capabilities are not all completed, accepted and fresh."""
    work = completed_work(capabilities, (stage,))
    return assets.join(work, "id", "left").where(needs_work(stage)).select(*assets.columns)


def cache_valid(
    completed_at: Column, stored_scope: Column, scope: Column, now: Column, ttl_ms: int = CACHE_TTL_MS
) -> Column:
    """Cached listing is usable: full access then and now, not from the future, younger than the TTL."""
    same = (stored_scope == scope) & (scope == "authorized")
    age = now - completed_at
    return F.coalesce(same & (age >= 0) & (age < ttl_ms), F.lit(False))
