"""Fast pass over everything that needs it, then the deep pass; both can be resumed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.operators.merges import upsert_capability_status
from lumenlake.operators.staleness import pending_assets

Analyze = Callable[[DataFrame, str], DataFrame]


def run_stage(
    assets: DataFrame, capabilities: DataFrame, stage: str, analyze: Analyze
) -> tuple[DataFrame, DataFrame]:
    """(analyses, capabilities after them) of one stage over the assets still pending for it.

    What is pending follows from the stored results alone, so a stage that was
    stopped goes on with the rest when it is run again.
    """
    analyses = analyze(pending_assets(assets, capabilities, stage), stage)
    sequenced = analyses.withColumn("seq", F.col("analyzed_at"))
    return analyses, upsert_capability_status(capabilities, sequenced)


def two_stage_run(
    assets: DataFrame,
    capabilities: DataFrame,
    analyze: Analyze,
    keep: Callable[[DataFrame, str], DataFrame],
) -> dict[str, DataFrame]:
    """Run both stages; ``keep(df, name)`` writes a table and returns it read back.

    Writing between the stages keeps the cheap results safe before the
    expensive stage starts, and the deep stage reads them instead of recomputing.
    """
    fast, after_fast = run_stage(assets, capabilities, "fast", analyze)
    fast = keep(fast, "fast_analyses")
    after_fast = keep(after_fast, "capabilities_after_fast")
    deep, after_deep = run_stage(assets, after_fast, "deep", analyze)
    deep = keep(deep, "deep_analyses")
    return {"fast": fast, "deep": deep, "capabilities": keep(after_deep, "capabilities_after_deep")}
