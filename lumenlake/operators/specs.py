"""Filter specs: AND/OR/NOT trees of predicates as plain dicts, turned into one Column."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import (
    SPEC_MAX_CHILDREN,
    SPEC_MAX_DEPTH,
    SPEC_MAX_NODES,
    UNSUPPORTED_ENTITIES,
    UNSUPPORTED_EXCLUSIONS,
)
from lumenlake.functions.text import has_text, text_matches
from lumenlake.operators.predicates import default_registry, text_flag
from lumenlake.registry import Ranking, Registry, UnsupportedQuery

Spec = dict

# fixed values: which capability answers a filter field, and the field's operator
FIELD_CAPABILITY = {
    "before": "query.date",
    "after": "query.date",
    "ocrTerms": "text.ocr",
    "screenshot": "content.screenshot",
    "document": "content.document",
    "duplicate": "duplicate.exact",
    "similar": "similarity.perceptual",
    "hasFaces": "people.face",
    "maxQuality": "quality.visual",
    "minBlur": "quality.visual",
}
FIELD_OPERATOR = {
    "before": "before",
    "after": "after",
    "mediaTypes": "in",
    "labels": "containsAny",
    "ocrTerms": "containsAny",
    "people": "containsAny",
    "places": "containsAny",
    "sceneLabels": "containsAny",
}
EXCLUSION_CAPABILITY = {"screenshots": "content.screenshot", "labels": "visual.labels"}
DEFAULT_CAPABILITY = "metadata.core"


def predicate(capability: str, operator: str, value: object) -> Spec:
    return {"type": "predicate", "capability": capability, "operator": operator, "value": value}


def all_specs(*children: Spec) -> Spec:
    """AND of specs; nested ANDs are flattened and a single child stands for itself."""
    flat = [g for c in children for g in (c["children"] if c["type"] == "and" else [c])]
    return flat[0] if len(flat) == 1 else {"type": "and", "children": flat}


def any_spec(*children: Spec) -> Spec:
    return {"type": "or", "children": list(children)}


def not_spec(child: Spec) -> Spec:
    return {"type": "not", "child": child}


def _children(spec: Spec) -> list[Spec]:
    return [spec["child"]] if spec["type"] == "not" else list(spec.get("children", []))


def leaves(spec: Spec) -> Iterator[Spec]:
    """Predicates in tree order."""
    if spec["type"] == "predicate":
        yield spec
    for child in _children(spec):
        yield from leaves(child)


def check_limits(spec: Spec) -> None:
    """Refuse trees with too many nodes, levels or children."""
    todo, nodes = [(spec, 0)], 0
    while todo:
        node, depth = todo.pop()
        nodes += 1
        children = _children(node)
        if nodes > SPEC_MAX_NODES or depth > SPEC_MAX_DEPTH or len(children) > SPEC_MAX_CHILDREN:
            raise ValueError("spec is too complex")
        todo += [(child, depth + 1) for child in children]


def field_value(leaf: Spec) -> tuple[str | None, object]:
    value = leaf["value"]
    if isinstance(value, dict):
        name = value.get("field")
        return (name if isinstance(name, str) else None), value.get("value")
    return None, value


def filters_to_spec(filters: dict | None = None, exclusions: dict | None = None) -> Spec:
    """Flat filters and exclusions to a tree. Without exclusions favorites are excluded."""
    parts = [
        predicate(
            FIELD_CAPABILITY.get(name, DEFAULT_CAPABILITY),
            FIELD_OPERATOR.get(name, "eq"),
            {"field": name, "value": value},
        )
        for name, value in (filters or {}).items()
        if value is not None
    ]
    for name, value in ({"favorites": True} if exclusions is None else exclusions).items():
        if value is True or (isinstance(value, list) and value):
            capability = EXCLUSION_CAPABILITY.get(name, DEFAULT_CAPABILITY)
            operator = "containsAny" if name == "labels" else "eq"
            parts.append(not_spec(predicate(capability, operator, {"field": name, "value": value})))
    return all_specs(*parts)


def _drop_leaves(spec: Spec, keys: set[tuple[str, str]]) -> Spec | None:
    if spec["type"] == "predicate":
        return None if (spec["capability"], spec["operator"]) in keys else spec
    kept = [k for k in (_drop_leaves(c, keys) for c in _children(spec)) if k]
    if not kept:
        return None
    return not_spec(kept[0]) if spec["type"] == "not" else {"type": spec["type"], "children": kept}


EVERYTHING: Spec = {"type": "and", "children": []}


def refine(current: Spec | None, incoming: Spec, operation: str) -> Spec:
    """Cumulative selection: combine the current spec with the next request."""
    current = current or EVERYTHING
    if operation == "new":
        return incoming
    if operation in ("add", "restrict"):
        return all_specs(current, incoming)
    if operation == "exclude":
        return all_specs(current, not_spec(incoming))
    if operation == "broaden":
        return any_spec(current, incoming)
    if operation in ("remove", "replace"):
        keys = {(leaf["capability"], leaf["operator"]) for leaf in leaves(incoming)}
        rest = _drop_leaves(current, keys) or EVERYTHING
        return rest if operation == "remove" else all_specs(rest, incoming)
    raise ValueError(f"unknown operation {operation!r}")


def refine_request(context: dict | None, request: dict, operation: str, last: int | None = None) -> dict:
    """Refine a whole request; ranking and target carry over, as do the operations (the ``last`` ones if given)."""
    held = (context or {}).get("request", {})
    merged = dict(request)
    merged["expression"] = refine(held.get("expression"), request.get("expression", EVERYTHING), operation)
    if operation != "new":
        for name in ("ranking", "target"):
            if merged.get(name) is None and held.get(name) is not None:
                merged[name] = held[name]
    past = [] if operation == "new" else (context or {}).get("operations", [])
    operations = [*past, operation]
    return {"request": merged, "operations": operations if last is None else operations[-last:]}


def compile_spec(spec: Spec, registry: Registry | None = None) -> Column:
    """The tree as one boolean Column. Anything unsupported refuses the whole spec."""
    registry = registry or default_registry()
    check_limits(spec)
    fields = {field_value(leaf)[0] for leaf in leaves(spec)}
    if fields & set(UNSUPPORTED_EXCLUSIONS):
        raise UnsupportedQuery("UNSUPPORTED_EXCLUSION")
    if fields & set(UNSUPPORTED_ENTITIES):
        raise UnsupportedQuery("UNSUPPORTED_ENTITY_FILTER")

    def build(node: Spec) -> Column:
        if node["type"] == "predicate":
            return registry.predicate(node["capability"], *field_value(node))
        parts = [build(child) for child in _children(node)]
        if node["type"] == "not":
            return ~parts[0]
        if node["type"] == "and":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    return build(spec)


@dataclass(frozen=True)
class Catalog:
    """The tables of a catalog. ``memberships`` is the output of ``asset_memberships``."""

    assets: DataFrame
    quality: DataFrame | None = None
    content: DataFrame | None = None
    texts: DataFrame | None = None
    memberships: DataFrame | None = None

    def with_(self, **tables: DataFrame) -> Catalog:
        return replace(self, **tables)


# fixed values: the tables behind a capability or a ranking
NEEDED_TABLES = {
    "quality.visual": "quality",
    "content.screenshot": "content",
    "content.document": "texts",
    "text.ocr": "texts",
    "duplicate.exact": "memberships",
    "similarity.perceptual": "memberships",
    "worst-quality": "quality",
    "least-important": "quality",
    "most-redundant": "memberships",
}


def wide_catalog(
    catalog: Catalog, specs: list[Spec], rankings: tuple[str, ...] = (), extra: tuple[str, ...] = ()
) -> DataFrame:
    """Assets left-joined with just the tables the specs and rankings need.

    Texts are reduced to booleans before the join, so text never moves.
    """
    found = [leaf for spec in specs for leaf in leaves(spec)]
    names = {leaf["capability"] for leaf in found} | set(rankings)
    tables = {NEEDED_TABLES[n] for n in names if n in NEEDED_TABLES} | set(extra)
    wide = catalog.assets
    if "quality" in tables:
        wide = wide.join(
            catalog.quality.select("id", "blur_score", "quality_score", "face_count"), "id", "left"
        )
    if "content" in tables:
        wide = wide.join(catalog.content.select("id", "is_screenshot"), "id", "left")
    if "texts" in tables:
        term_lists = [v for leaf in found if leaf["capability"] == "text.ocr" for v in [field_value(leaf)[1]]]
        matches = {
            text_flag(terms): text_matches(F.col("ocr_text"), terms)
            for terms in term_lists
            if isinstance(terms, list) and terms
        }
        flags = catalog.texts.select(
            "id",
            has_text(F.col("ocr_text")).alias("has_text"),
            *[match.alias(name) for name, match in matches.items()],
        )
        wide = wide.join(flags, "id", "left")
    if "memberships" in tables:
        wide = wide.join(catalog.memberships, "id", "left")
    return wide


def apply_spec(catalog: Catalog, spec: Spec, registry: Registry | None = None) -> DataFrame:
    """Assets matching the spec, lazily."""
    condition = compile_spec(spec, registry)
    return wide_catalog(catalog, [spec]).where(condition).select(*catalog.assets.columns)


def bulk_match(catalog: Catalog, specs: dict[str, Spec], registry: Registry | None = None) -> DataFrame:
    """(spec_id, id) for many stored specs in one pass over the catalog."""
    wide = wide_catalog(catalog, list(specs.values()))
    hits = [F.when(compile_spec(spec, registry), F.lit(name)) for name, spec in specs.items()]
    return wide.select(F.explode(F.array_compact(F.array(*hits))).alias("spec_id"), "id")


def fingerprint(request: dict) -> str:
    """Identity of a request, bound into its cursors."""
    return hashlib.sha256(json.dumps(request, sort_keys=True).encode()).hexdigest()


def ranking_of(request: dict, registry: Registry | None = None) -> Ranking:
    strategy = (request.get("ranking") or {}).get("strategy", "newest")
    return (registry or default_registry()).ranking(strategy)
