"""Cleanup candidates with reasons, and what the reasons add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.specs import Catalog, Spec, compile_spec, field_value, leaves, wide_catalog
from lumenlake.registry import Registry

# fixed values: base confidence, gain per reason, ceiling
BASE, GAIN, CEILING = 0.5, 0.1, 0.99
REASON_FIELDS = ("screenshot", "duplicate", "similar", "minBlur", "minFileSize", "before")


def reasons(spec: Spec) -> Column:
    """Reasons of a row, from the leaves of the spec.

    The last leaf of a field counts and NOT is not looked at. Duplicate and
    similar are stated by the spec itself; duplicate hides similar.
    """
    asked = {name: value for name, value in map(field_value, leaves(spec)) if name in REASON_FIELDS}
    rules: list[Column] = []
    if asked.get("screenshot") is True:
        rules.append(F.when(F.col("is_screenshot"), "screenshot"))
    if asked.get("duplicate") is True or asked.get("similar") is True:
        rules.append(F.lit("duplicate" if asked.get("duplicate") is True else "similar"))
    if "minBlur" in asked:
        rules.append(F.when(F.coalesce("blur_score", F.lit(0.0)) >= F.lit(asked["minBlur"]), "blurry"))
    if "minFileSize" in asked:
        size = F.coalesce("file_size", F.lit(0))
        rules.append(F.when(size >= F.lit(asked["minFileSize"]), "large-media"))
    if "before" in asked:
        rules.append(F.when(F.col("created_at") < F.lit(asked["before"]), "old-media"))
    return F.array_compact(F.array(*rules)) if rules else F.array().cast("array<string>")


def cleanup_candidates(catalog: Catalog, spec: Spec, registry: Registry | None = None) -> DataFrame:
    """Every matching asset with its reasons, confidence and recoverable bytes."""
    wide = wide_catalog(catalog, [spec], extra=("quality", "content"))
    matching = wide.where(compile_spec(spec, registry)).withColumn("reasons", reasons(spec))
    confidence = F.least(F.lit(CEILING), F.lit(BASE) + F.size("reasons") * F.lit(GAIN))
    return matching.select(
        "id", confidence.alias("confidence"), "reasons", F.col("file_size").alias("recoverable_bytes")
    )


def reason_totals(candidates: DataFrame) -> DataFrame:
    """Per reason: candidates and their known bytes."""
    return (
        candidates.select(F.explode("reasons").alias("reason"), "recoverable_bytes")
        .groupBy("reason")
        .agg(
            F.count(F.lit(1)).alias("candidates"),
            F.coalesce(F.sum("recoverable_bytes"), F.lit(0).cast("bigint")).alias("bytes"),
        )
    )
