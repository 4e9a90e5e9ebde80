"""Specs stored as JSON text, as tables: leaves, limits, coverage, refinement logs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.constants import (
    MEDIA_TYPES,
    SPEC_MAX_CHILDREN,
    SPEC_MAX_DEPTH,
    SPEC_MAX_NODES,
    UNSUPPORTED_ENTITIES,
    UNSUPPORTED_EXCLUSIONS,
)
from lumenlake.operators.capabilities import Resolver, default_resolver

WALK = (
    "struct<nodes:int,depth:int,widest:int,leaves:array<struct<position:int,depth:int,negated:boolean,"
    "capability:string,operator:string,field:string,value:string,kind:string>>>"
)


def _kind(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int | float):
        return "number"
    if isinstance(value, list) and value and all(isinstance(v, str) for v in value):
        return "media" if all(v in MEDIA_TYPES for v in value) else "strings"
    return "other"


def _walk(text: str | None) -> dict | None:
    """Node count, depth, widest child list and leaves of one spec; None for unreadable JSON."""
    try:
        todo = [(json.loads(text), 0, False)]
    except (TypeError, ValueError):
        return None
    seen = {"nodes": 0, "depth": 0, "widest": 0, "leaves": []}
    while todo:
        node, depth, negated = todo.pop()
        seen["nodes"] += 1
        seen["depth"] = max(seen["depth"], depth)
        if not isinstance(node, dict):
            continue
        if node.get("type") == "predicate":
            held = node.get("value")
            inner = held if isinstance(held, dict) else {"value": held}
            seen["leaves"].append(
                {
                    "position": len(seen["leaves"]),
                    "depth": depth,
                    "negated": negated,
                    "capability": node.get("capability"),
                    "operator": node.get("operator"),
                    "field": inner.get("field"),
                    "value": json.dumps(inner.get("value"), separators=(",", ":")),
                    "kind": _kind(inner.get("value")),
                }
            )
        children = node.get("children") if isinstance(node.get("children"), list) else []
        seen["widest"] = max(seen["widest"], len(children))
        todo += [(child, depth + 1, negated) for child in reversed(children)]
        if "child" in node:
            todo.append((node["child"], depth + 1, not negated))
    return seen


def _walk_all(texts: pd.Series) -> pd.DataFrame:
    empty = {"nodes": None, "depth": None, "widest": None, "leaves": None}
    return pd.DataFrame([_walk(text) or empty for text in texts], columns=list(empty))


def walk_spec(spec: Column) -> Column:
    """Trees of any depth need a loop; one small tree per row, in Arrow batches."""
    return F.pandas_udf(_walk_all, WALK)(spec)


def explode_predicates(specs: DataFrame, key: str = "spec_id", spec: str = "spec") -> DataFrame:
    """All leaf predicates of stored specs, in tree order."""
    walked = specs.select(key, walk_spec(F.col(spec)).alias("_w"))
    return walked.select(key, F.explode("_w.leaves").alias("_l")).select(key, "_l.*")


def spec_limits(specs: DataFrame, key: str = "spec_id", spec: str = "spec") -> DataFrame:
    """Size of every stored spec and whether it is too complex to run."""
    walked = specs.select(key, walk_spec(F.col(spec)).alias("_w")).select(key, "_w.nodes", "_w.depth", "_w.widest")
    too_big = (
        (F.col("nodes") > SPEC_MAX_NODES)
        | (F.col("depth") > SPEC_MAX_DEPTH)
        | (F.col("widest") > SPEC_MAX_CHILDREN)
    )
    return walked.withColumn("too_complex", too_big)


def leaf_status(leaf: Column, statuses: dict[str, str]) -> Column:
    """available, degraded or unavailable for one leaf (a struct of ``WALK``), by ``Resolver.statuses``."""
    held = F.create_map(*[F.lit(x) for pair in statuses.items() for x in pair])
    refused = F.coalesce(leaf["field"].isin(*UNSUPPORTED_EXCLUSIONS, *UNSUPPORTED_ENTITIES), F.lit(False))
    named = F.concat_ws("|", leaf["capability"], F.coalesce(leaf["field"], F.lit("")), leaf["kind"])
    wild = F.concat_ws("|", leaf["capability"], F.lit("*"), leaf["kind"])
    found = F.coalesce(F.try_element_at(held, named), F.try_element_at(held, wild), F.lit("unavailable"))
    return F.when(refused, "unavailable").otherwise(found)


def spec_coverage(specs: DataFrame, key: str = "spec_id", spec: str = "spec", resolver: Resolver | None = None) -> DataFrame:
    """Per stored spec: leaves that run, run degraded or cannot run, and the status of the whole.

    The resolver that runs specs is asked (the catalog's own by default). One leaf that cannot run makes the whole spec
    unavailable; a spec without leaves is complete, and one that can't be read is unreadable. Every spec has its row:
    leaves are counted in their array, without exploding or a shuffle.
    """
    statuses = (resolver or default_resolver()).statuses()
    walked = specs.select(key, walk_spec(F.col(spec)).alias("_w"))
    states = F.transform("_w.leaves", lambda leaf: leaf_status(leaf, statuses))
    counted = walked.select(key, states.alias("_states"))

    def count(name: str) -> Column:
        return F.greatest(F.lit(0), F.size(F.filter("_states", lambda s: s == name))).cast("bigint")

    counted = counted.withColumns({name: count(name) for name in ("available", "degraded", "unavailable")})
    status = (
        F.when(F.col("_states").isNull(), "unreadable")
        .when(F.col("unavailable") > 0, "unavailable")
        .when(F.col("degraded") > 0, "degraded")
        .otherwise("complete")
    )
    return counted.withColumn("status", status).drop("_states")


def refinement_log(
    operations: DataFrame,
    key: str = "selection_id",
    seq: str = "seq",
    operation: str = "operation",
    last: int | None = None,
) -> DataFrame:
    """The operations per selection, oldest first, as one array; the ``last`` ones if given.

    ``row_number`` up to a constant is cut per input partition before the
    shuffle, so a selection with very many operations then stays small.
    """
    recent = operations
    if last is not None:
        newest = Window.partitionBy(key).orderBy(F.col(seq).desc())
        recent = operations.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    ordered = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.col(operation).alias("o"))))
    return recent.groupBy(key).agg(F.transform(ordered, lambda e: e["o"]).alias("operations"))
