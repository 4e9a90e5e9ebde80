"""Keyed upserts, sparse merges, change detection and cascading deletes.

All merges aggregate the updates per key first (partial aggregation happens
before the shuffle, so a key with very many updates is no single hot task) and
touch the base once. Among updates of one key the largest ``seq`` is the latest;
``seq`` must be unique within a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.schemas import (
    CONTENT_SIGNALS,
    HASH_SIGNALS,
    QUALITY_SIGNALS,
    VERSION_COLUMNS,
)

Keys = str | Sequence[str]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def latest_by_key(df: DataFrame, key: Keys, seq: str | Sequence[str]) -> DataFrame:
    """The row with the largest ``seq`` for every key."""
    keys = _keys(key)
    order = F.struct(*_keys(seq))
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def upsert_latest(base: DataFrame, updates: DataFrame, key: Keys, seq: str) -> DataFrame:
    """Whole-row upsert; the latest update wins and its nulls overwrite.

    Base rows without an update only pass an anti join on the update keys, which
    Spark turns into a broadcast when the statistics say the batch is small.
    """
    keys = _keys(key)
    latest = latest_by_key(updates, keys, seq).select(*base.columns)
    return base.join(latest.select(*keys), keys, "left_anti").unionByName(latest)


def merge_coalesce(
    base: DataFrame,
    updates: DataFrame,
    key: Keys,
    seq: str,
    coalesce_cols: Sequence[str],
    overwrite_cols: Sequence[str] = VERSION_COLUMNS,
) -> DataFrame:
    """Sparse upsert: signals keep the old value where the new one is null, versions overwrite.

    Equals applying the updates one by one. Updates without any signal are ignored.
    """
    keys = _keys(key)
    touched = updates.where(F.coalesce(*[F.col(c).cast("string") for c in coalesce_cols]).isNotNull())
    merged = touched.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_{c}") for c in coalesce_cols],
        F.max_by(F.struct(*overwrite_cols), F.col(seq)).alias("_last"),
    )
    joined = base.join(merged, keys, "full_outer")
    return joined.select(
        *keys,
        *[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) for c in coalesce_cols],
        *[
            F.when(F.col("_last").isNotNull(), F.col(f"_last.{c}")).otherwise(F.col(c)).alias(c)
            for c in overwrite_cols
        ],
    ).select(*base.columns)


def merge_quality(base: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    return merge_coalesce(base, updates, "id", seq, QUALITY_SIGNALS)


def merge_content(base: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    return merge_coalesce(base, updates, "id", seq, CONTENT_SIGNALS)


def merge_hashes(base: DataFrame, updates: DataFrame, seq: str = "seq") -> DataFrame:
    return merge_coalesce(base, updates, "id", seq, HASH_SIGNALS)


def completed(results: Column, capability_id: str) -> Column:
    """Whether a result list reports the capability as completed."""
    return F.coalesce(
        F.exists(
            results, lambda r: (r["capability_id"] == capability_id) & (r["status"] == "completed")
        ),
        F.lit(False),
    )


def merge_text(base: DataFrame, analyses: DataFrame, seq: str = "seq") -> DataFrame:
    """Text is replaced when the text stage completed or text is present; missing text is empty."""
    present = completed(F.col("capability_results"), "text.ocr") | F.col("ocr_text").isNotNull()
    updates = analyses.where(present).select(
        "id", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), *VERSION_COLUMNS, seq
    )
    return upsert_latest(base, updates, "id", seq)


def explode_results(analyses: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per analysed asset and capability."""
    return analyses.select(
        "id", *VERSION_COLUMNS, seq, F.explode("capability_results").alias("_r")
    ).select(
        "id",
        F.col("_r.capability_id").alias("capability_id"),
        F.col("_r.status").alias("status"),
        *VERSION_COLUMNS,
        F.col("_r.error").alias("error"),
        seq,
    )


def upsert_capability_status(base: DataFrame, analyses: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest status per asset and capability; a later failure replaces an earlier success."""
    return upsert_latest(base, explode_results(analyses, seq), ["id", "capability_id"], seq)


def split_wide_signals(df: DataFrame) -> dict[str, DataFrame]:
    """Wide analyses to narrow tables; each keeps rows with at least one of its signals."""

    def narrow(signals: Sequence[str]) -> DataFrame:
        some = F.coalesce(*[F.col(c).cast("string") for c in signals]).isNotNull()
        return df.where(some).select("id", *signals, *VERSION_COLUMNS)

    return {
        "quality": narrow(("blur_score", "quality_score", "brightness_score")),
        "content": narrow(CONTENT_SIGNALS),
        "hashes": narrow(HASH_SIGNALS),
        "texts": narrow(("ocr_text",)),
    }


def reconcile_snapshot(df: DataFrame, indexed_at: int | Column) -> DataFrame:
    """Keep assets the latest *completed* enumeration has seen."""
    bound = indexed_at if isinstance(indexed_at, Column) else F.lit(indexed_at)
    return df.where(F.col("indexed_at") >= bound)


def classify_changes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Per key: new, deleted, changed or unchanged, by modification time."""
    before = old.select(key, F.col("modified_at").alias("_old"), F.lit(True).alias("_in_old"))
    after = new.select(key, F.col("modified_at").alias("_new"), F.lit(True).alias("_in_new"))
    change = (
        F.when(F.col("_in_old").isNull(), "new")
        .when(F.col("_in_new").isNull(), "deleted")
        .when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged")
        .otherwise("changed")
    )
    return before.join(after, key, "full_outer").select(key, change.alias("change"))


def delete_cascade(
    ids: DataFrame,
    tables: dict[str, DataFrame],
    set_null: dict[str, str] | None = None,
    key: str = "id",
) -> dict[str, DataFrame]:
    """Remove assets and all dependants; in ``set_null`` tables only the reference is cleared.

    Feedback tables are facts about past decisions: leave them out of ``tables``.
    """
    gone = ids.select(key).distinct()
    kept = {name: df.join(gone, key, "left_anti") for name, df in tables.items() if name not in (set_null or {})}
    for name, column in (set_null or {}).items():
        table = tables[name]
        # Rows without a reference match nothing; a key of their own keeps them from one task.
        own = F.concat(F.lit("\0"), F.xxhash64(*table.columns).cast("string"))
        keyed = table.withColumn("_ref", F.coalesce(F.col(column), own))
        marked = keyed.join(gone.select(F.col(key).alias("_ref"), F.lit(True).alias("_gone")), "_ref", "left")
        cleared = F.when(F.col("_gone").isNull(), F.col(column)).alias(column)
        kept[name] = marked.select(*[cleared if c == column else c for c in table.columns])
    return kept


def append_if_exists(facts: DataFrame, assets: DataFrame, key: str = "id") -> DataFrame:
    """Facts about assets that exist."""
    return facts.join(assets.select(key), key, "left_semi")
