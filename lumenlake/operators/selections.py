"""Saved selections: a header table and a member table (one row per selection and asset)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed value: longest selection name
LONGEST_NAME = 120


def _named() -> Column:
    return F.coalesce(F.length(F.trim("name")).between(1, LONGEST_NAME), F.lit(False))


def selection_rejects(requests: DataFrame) -> DataFrame:
    """(selection_id, reason) of the requests that ``save_selections`` refuses.

    A selection whose names are all empty or too long has an invalid name; one without any id under a valid name is
    empty.
    """
    judged = requests.groupBy("selection_id").agg(
        F.bool_or(_named()).alias("_named"),
        F.bool_or(_named() & F.coalesce(F.col("id") != "", F.lit(False))).alias("_filled"),
    )
    reason = F.when(~F.col("_named"), "INVALID_NAME").otherwise("EMPTY_SELECTION")
    return judged.where(~F.col("_filled")).select("selection_id", reason.alias("reason"))


def save_selections(
    requests: DataFrame, assets: DataFrame, now: int
) -> tuple[DataFrame, DataFrame]:
    """(headers, members) from rows (selection_id, name, spec, id[, context]).

    Names are trimmed and must have 1 to 120 characters, a selection needs at
    least one non-empty id, repeated ids count once and only existing assets
    become members. What is refused is in :func:`selection_rejects`. The context
    of the request is stored with the header where there is one.
    """
    named = requests.withColumn("name", F.trim("name")).where(_named() & (F.col("id") != ""))
    texts = ["name", "spec", *(["context"] if "context" in requests.columns else [])]
    headers = (
        named.groupBy("selection_id")
        .agg(*[F.min(c).alias(c) for c in texts])
        .withColumns({"created_at": F.lit(now), "updated_at": F.lit(now)})
    )
    members = (
        named.select("selection_id", "id")
        .dropDuplicates(["selection_id", "id"])
        .join(assets.select("id"), "id", "left_semi")
        .select("selection_id", "id")
    )
    return headers, members


def list_selections(headers: DataFrame, members: DataFrame) -> DataFrame:
    """Headers with their number of members, last updated first; unreadable specs become null.

    Members stay rows (see :func:`selection_members`): a selection may hold any number of assets.
    """
    counts = members.groupBy("selection_id").agg(
        F.count(F.lit(1)).alias("member_count"), F.min("id").alias("first_id"), F.max("id").alias("last_id")
    )
    readable = F.when(F.try_parse_json("spec").isNotNull(), F.col("spec"))
    return (
        headers.withColumn("spec", readable)
        .join(counts, "selection_id", "left")
        .withColumn("member_count", F.coalesce("member_count", F.lit(0)))
        .orderBy(F.col("updated_at").desc())
    )


def selection_members(members: DataFrame, assets: DataFrame, selection_id: str) -> DataFrame:
    """Assets of one selection."""
    chosen = members.where(F.col("selection_id") == selection_id).select("id")
    return assets.join(chosen, "id")


def delete_selections(
    headers: DataFrame, members: DataFrame, ids: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(headers, members, report): both tables without the given selections, and which existed."""
    gone = ids.select("selection_id").distinct()
    known = headers.select("selection_id", F.lit(True).alias("_known"))
    report = gone.join(known, "selection_id", "left").select(
        "selection_id", F.coalesce("_known", F.lit(False)).alias("existed")
    )
    return (
        headers.join(gone, "selection_id", "left_anti"),
        members.join(gone, "selection_id", "left_anti"),
        report,
    )
