"""Which provider answers a predicate: priorities, degraded providers, dependencies, fallbacks, and tables of their own."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import CAPABILITY_CATALOG, UNSUPPORTED_ENTITIES, UNSUPPORTED_EXCLUSIONS
from lumenlake.operators.specs import Spec, check_limits, field_value, leaves
from lumenlake.registry import UnsupportedQuery

#: Fields and kinds of value: (field, or "*" for any; kind as ``spec_tables`` names it).
Accepts = tuple[tuple[str, str], ...]
Build = Callable[[str | None, object], Column | None]


@dataclass(frozen=True)
class Provider:
    """Answers predicates of a capability from ``columns`` of its own table, one row for each ``key``.

    ``build`` makes a Column of these column names. A provider without a table uses the columns of the assets.
    """

    name: str
    accepts: Accepts
    build: Build | None = None
    table: DataFrame | None = None
    key: str = "id"
    columns: tuple[str, ...] = ()
    priority: int = 0
    degraded: bool = False
    missing: str | None = None  # the reason why it can't run here


@dataclass
class Capability:
    name: str
    dependencies: tuple[str, ...] = ()
    fallbacks: tuple[str, ...] = ()
    providers: list[Provider] = field(default_factory=list)


@dataclass(frozen=True)
class Resolution:
    """available, degraded or unavailable, why, and the provider that answers."""

    status: str
    reason: str | None = None
    provider: Provider | None = None


class Resolver:
    """Capabilities by name; the same answer for running a spec and for saying whether it can run."""

    def __init__(self, capabilities: Iterable[Capability] = ()):
        self.capabilities: dict[str, Capability] = {}
        for capability in capabilities:
            self.register(capability)

    def register(self, capability: Capability) -> None:
        if capability.name in self.capabilities:
            raise ValueError(f"duplicate capability {capability.name!r}")
        self.capabilities[capability.name] = capability

    def add_provider(self, capability: str, provider: Provider) -> None:
        held = self.capabilities[capability].providers
        if any(p.name == provider.name for p in held):
            raise ValueError(f"duplicate provider {provider.name!r} of {capability}")
        held.append(provider)

    def resolve(self, name: str, accepts: Callable[[Provider], bool] = lambda p: True, path: tuple[str, ...] = ()) -> Resolution:
        """The best provider of a capability that accepts the predicate.

        An unavailable dependency makes a capability unavailable, a degraded one degrades it. Providers that are not
        degraded come first, then those of higher priority. Without one, the first fallback capability that can answer
        does so, degraded. A capability that needs itself is unavailable.
        """
        if name in path:
            return Resolution("unavailable", "DEPENDENCY_CYCLE")
        capability = self.capabilities.get(name)
        if capability is None:
            return Resolution("unavailable", "NOT_REGISTERED")
        below = [self.resolve(d, path=(*path, name)) for d in capability.dependencies]
        reason = "DEPENDENCY_UNAVAILABLE" if any(b.status == "unavailable" for b in below) else None
        able = []
        if reason is None:
            wanted = [p for p in capability.providers if accepts(p)]
            able = sorted((p for p in wanted if p.missing is None), key=lambda p: (p.degraded, -p.priority))
            reason = next((p.missing for p in reversed(wanted) if p.missing), None)
        if able:
            weak = able[0].degraded or any(b.status == "degraded" for b in below)
            why = None if not weak else "DEGRADED_PROVIDER" if able[0].degraded else "DEPENDENCY_DEGRADED"
            return Resolution("degraded" if weak else "available", why, able[0])
        for fallback in capability.fallbacks:
            found = self.resolve(fallback, accepts, (*path, name))
            if found.status != "unavailable":
                return Resolution("degraded", reason or "FALLBACK_PROVIDER", found.provider)
        return Resolution("unavailable", reason or "NO_PROVIDER")

    def answer(self, capability: str, field_name: str | None, kind: str) -> Resolution:
        """Resolve one predicate by its field and kind of value."""
        if field_name in UNSUPPORTED_EXCLUSIONS or field_name in UNSUPPORTED_ENTITIES:
            return Resolution("unavailable", "UNSUPPORTED_FIELD")
        pairs = {(field_name or "", kind), ("*", kind)}
        return self.resolve(capability, lambda p: bool(pairs & set(p.accepts)))

    def statuses(self) -> dict[str, str]:
        """``capability|field|kind`` of everything that any provider accepts, with its status; the field may be *.

        Fallbacks answer for other capabilities, so every accepted pair is asked of every capability.
        """
        pairs = sorted({pair for c in self.capabilities.values() for p in c.providers for pair in p.accepts})
        named = {(f"{c}|{f}|{k}", c, f, k) for c in self.capabilities for f, k in pairs}
        return {text: self.answer(c, f, k).status for text, c, f, k in sorted(named)}


# fixed values: which field and kind of value a capability can execute; * takes any field
EXECUTABLE: dict[str, Accepts] = {
    "query.date": (("before", "number"), ("after", "number")),
    "metadata.core": (("mediaTypes", "media"), ("favorite", "boolean"), ("favorites", "boolean"), ("minFileSize", "number")),
    "quality.visual": (("maxQuality", "number"), ("minBlur", "number")),
    "text.ocr": (("ocrTerms", "strings"), ("ocrTerms", "media")),
    "content.screenshot": (("*", "boolean"),),
    "content.document": (("*", "boolean"),),
    "duplicate.exact": (("*", "boolean"),),
    "similarity.perceptual": (("*", "boolean"),),
}


def default_resolver() -> Resolver:
    """The known capabilities, each with the provider the catalog tables have for it."""
    found = Resolver()
    for name, _, status in CAPABILITY_CATALOG:
        found.register(Capability(name))
        if name in EXECUTABLE and status != "unavailable":
            found.add_provider(name, Provider("catalog", EXECUTABLE[name], degraded=status == "degraded"))
    return found


def _kind(value: object) -> str:
    from lumenlake.operators.spec_tables import _kind as kind

    return kind(value)


def apply_resolved(assets: DataFrame, spec: Spec, resolver: Resolver) -> DataFrame:
    """Assets that match a spec whose predicates are answered by providers with tables of their own.

    Each provider that is needed is joined once, by its key, with just its columns. Anything that no provider answers
    refuses the whole spec, with the reason.
    """
    check_limits(spec)
    chosen: dict[int, Provider] = {}
    for leaf in leaves(spec):
        name, value = field_value(leaf)
        found = resolver.answer(leaf["capability"], name, _kind(value))
        if found.provider is None or found.provider.build is None:
            raise UnsupportedQuery(f"{leaf['capability']}:{name}: {found.reason or 'NO_BUILDER'}")
        chosen[id(leaf)] = found.provider

    def condition(node: Spec) -> Column:
        if node["type"] == "predicate":
            provider = chosen[id(node)]
            built = provider.build(*field_value(node))  # type: ignore[misc]
            if built is None:
                raise UnsupportedQuery(f"{provider.name} refuses {node['value']!r}")
            return built
        parts = [condition(c) for c in ([node["child"]] if node["type"] == "not" else node["children"])]
        if node["type"] == "not":
            return ~parts[0]
        if node["type"] == "and":
            return reduce(lambda a, b: a & b, parts, F.lit(True))
        return reduce(lambda a, b: a | b, parts, F.lit(False))

    wide = assets
    clashes = set(assets.columns)
    for provider in {p.name: p for p in chosen.values() if p.table is not None}.values():
        if clashes & set(provider.columns):
            raise ValueError(f"columns of {provider.name!r} are there already: {sorted(clashes & set(provider.columns))}")
        clashes |= set(provider.columns)
        wide = wide.join(provider.table.select(F.col(provider.key).alias("id"), *provider.columns), "id", "left")
    return wide.where(condition(spec)).select(*assets.columns)
