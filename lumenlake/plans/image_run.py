"""Pending assets to images to signals to tables, as one job that can be stopped and resumed.

A run works in rounds. Each round reads its share of the pending files and appends their analyses as one delta; what
is pending follows from the stored tables and the deltas alone, so a run that was stopped after any round, or broke
off within one, goes on with the rest. ``folded`` merges the deltas into the tables once.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake import schemas
from lumenlake.operators.analysis import analyze_assets
from lumenlake.operators.merges import merge_content, merge_hashes, merge_quality, merge_text, upsert_capability_status
from lumenlake.operators.staleness import pending_assets
from lumenlake.session import scratch_path
from lumenlake.sources.pending_images import SLICE_ROWS, read_pending
from lumenlake.sources.tables import write_batch

ROUND_ROWS = 1_000_000
_DELTA = f"{schemas.ANALYSES}, batch_id long"


def deltas(spark: SparkSession, folder: str) -> DataFrame:
    """All analyses stored so far, with ``seq``: the round they came in."""
    from lumenlake.sources.tables import _filesystem

    files, path = _filesystem(spark, folder)
    if not files.exists(path):
        return spark.createDataFrame([], _DELTA).withColumnRenamed("batch_id", "seq")
    return spark.read.schema(_DELTA).option("basePath", folder).parquet(folder).withColumnRenamed("batch_id", "seq")


def analyze_stage(
    assets: DataFrame,
    capabilities: DataFrame,
    folder: str,
    stage: str,
    analyzed_at: Column,
    texts: DataFrame | None = None,
    round_rows: int = ROUND_ROWS,
    slice_rows: int = SLICE_ROWS,
    stop: Callable[[int], bool] | None = None,
) -> int:
    """Analyse what is pending for a stage, round by round; returns the number of rounds stored.

    ``assets`` have path, name and folder beside the catalog columns. ``texts`` (id, ocr_text, text_done) is extracted
    text for a deep stage. ``stop(rounds stored)`` is asked before each round. Missing and broken files are analysed
    too, as failed, and stay pending.
    """
    spark = assets.sparkSession
    seen = deltas(spark, folder)
    last = seen.agg(F.max("seq")).first()[0]
    first = 0 if last is None else last + 1
    status = upsert_capability_status(capabilities, seen)
    waiting = scratch_path(spark, "waiting")
    pending_assets(assets, status, stage).write.parquet(waiting)
    pending = spark.read.schema(assets.schema).parquet(waiting)
    rounds = math.ceil(pending.count() / round_rows)
    for number in range(rounds):
        if stop and stop(number):
            return number
        mine = pending.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == number)
        rows = read_pending(mine, stage, slice_rows)
        if stage == "deep":
            extracted = texts if texts is not None else spark.createDataFrame([], "id string, ocr_text string, text_done boolean")
            rows = rows.join(extracted.select("id", "ocr_text", "text_done"), "id", "left")
        write_batch(analyze_assets(rows, stage, analyzed_at), folder, first + number)
    return rounds


def folded(spark: SparkSession, tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """The signal tables (quality, content, hashes, texts, capabilities) with all deltas of a run merged in."""
    new = deltas(spark, folder)
    return {
        "quality": merge_quality(tables["quality"], new),
        "content": merge_content(tables["content"], new),
        "hashes": merge_hashes(tables["hashes"], new),
        "texts": merge_text(tables["texts"], new),
        "capabilities": upsert_capability_status(tables["capabilities"], new),
    }
