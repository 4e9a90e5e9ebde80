"""Typed predicates and rankings over the wide catalog row, and the default registry.

Unknown sizes and scores stay unknown: they match neither a predicate nor its
negation. Only existence tests and the screenshot flag count unknown as false.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import MEDIA_TYPES
from lumenlake.registry import Registry


def before(column: str, bound: int) -> Column:
    return F.col(column) < F.lit(bound)


def after(column: str, bound: int) -> Column:
    return F.col(column) > F.lit(bound)


def media_in(column: str, values: Sequence[str]) -> Column:
    return F.col(column).isin(list(values))


def flag_eq(column: str, value: bool) -> Column:
    return F.col(column) == F.lit(value)


def flag_eq_default(column: str, value: bool) -> Column:
    """Equality where a missing flag counts as false."""
    return F.coalesce(F.col(column), F.lit(False)) == F.lit(value)


def at_least(column: str, bound: float) -> Column:
    return F.col(column) >= F.lit(bound)


def at_most(column: str, bound: float) -> Column:
    return F.col(column) <= F.lit(bound)


def exists_in(df: DataFrame, other: DataFrame, present: bool = True, key: str = "id") -> DataFrame:
    """Rows with (or without) a partner in another table: a semi or anti join."""
    return df.join(other.select(key), key, "left_semi" if present else "left_anti")


def ids_in(df: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Rows of an id set, newest first; repeated and empty ids do not matter."""
    wanted = ids.where(F.col(key) != "")
    return df.join(wanted, key, "left_semi").orderBy(F.col("created_at").desc(), F.col(key).desc())


def text_flag(terms: Sequence[str]) -> str:
    """Name of the wide-row column holding the match of a term list."""
    return "_text_" + hashlib.sha256(json.dumps(list(terms)).encode()).hexdigest()[:16]


def _number(value: object) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


def _date(field: str | None, value: object) -> Column | None:
    if not _number(value) or field not in ("before", "after"):
        return None
    return before("created_at", value) if field == "before" else after("created_at", value)


def _metadata(field: str | None, value: object) -> Column | None:
    if field == "mediaTypes" and isinstance(value, list) and all(v in MEDIA_TYPES for v in value):
        return media_in("media_type", value)
    if field in ("favorite", "favorites") and isinstance(value, bool):
        return flag_eq("favorite", value)
    if field == "minFileSize" and _number(value):
        return at_least("file_size", value)
    return None


def _quality(field: str | None, value: object) -> Column | None:
    if not _number(value):
        return None
    if field == "maxQuality":
        return at_most("quality_score", value)
    return at_least("blur_score", value) if field == "minBlur" else None


def _boolean(column: str):
    def build(field: str | None, value: object) -> Column | None:
        return flag_eq_default(column, value) if isinstance(value, bool) else None

    return build


def _text(field: str | None, value: object) -> Column | None:
    if field != "ocrTerms" or not isinstance(value, list) or not value:
        return None
    if not all(isinstance(v, str) for v in value):
        return None
    return F.coalesce(F.col(text_flag(value)), F.lit(False))


def importance(favorite: str = "favorite") -> Column:
    """Higher means more worth keeping: favorites, then faces, then quality, then recency."""
    # fixed values: weights and the quality of assets without a score
    return (
        F.col(favorite).cast("int") * 1_000_000
        + F.coalesce("face_count", F.lit(0)) * 10_000
        + F.coalesce("quality_score", F.lit(2.0)) * 1_000
        + F.col("created_at") / F.lit(1e12)
    )


def default_registry() -> Registry:
    registry = Registry()
    for capability, builder in (
        ("query.date", _date),
        ("metadata.core", _metadata),
        ("quality.visual", _quality),
        ("text.ocr", _text),
        ("content.screenshot", _boolean("is_screenshot")),
        ("content.document", _boolean("has_text")),
        ("duplicate.exact", _boolean("in_duplicate")),
        ("similarity.perceptual", _boolean("in_similar")),
    ):
        registry.register_predicate(capability, builder)
    registry.register_ranking("newest", F.col("created_at"), descending=True)
    registry.register_ranking("largest", F.coalesce("file_size", F.lit(-1)), descending=True)
    registry.register_ranking("worst-quality", F.coalesce("quality_score", F.lit(2.0)), descending=False)
    registry.register_ranking("most-redundant", F.coalesce("memberships", F.lit(0)), descending=True)
    registry.register_ranking("least-important", importance(), descending=False)
    return registry
