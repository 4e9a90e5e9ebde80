"""Extension points: predicates, rankings and signals plugged in by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lumenlake.constants import CAPABILITY_CATALOG
from lumenlake.schemas import CAPABILITY_RESULT

PredicateBuilder = Callable[[str | None, object], Column | None]


class UnsupportedQuery(ValueError):
    """A spec asks for something no provider can answer; it is refused as a whole."""


@dataclass(frozen=True)
class Ranking:
    """A sort value; ids break ties in the same direction."""

    value: Column
    descending: bool

    def order(self, key: str = "id") -> list[Column]:
        by_id = F.col(key)
        return [self.value.desc(), by_id.desc()] if self.descending else [self.value.asc(), by_id.asc()]


@dataclass
class Registry:
    predicates: dict[str, list[tuple[int, str, PredicateBuilder]]] = field(default_factory=dict)
    rankings: dict[str, Ranking] = field(default_factory=dict)

    def register_predicate(
        self, capability: str, builder: PredicateBuilder, name: str = "default", priority: int = 0
    ) -> None:
        """Add a provider. ``builder(field, value)`` returns a Column, or None if it cannot."""
        providers = self.predicates.setdefault(capability, [])
        if any(existing == name for _, existing, _ in providers):
            raise ValueError(f"duplicate provider {name!r} for {capability}")
        providers.append((priority, name, builder))
        providers.sort(key=lambda p: -p[0])

    def register_ranking(self, name: str, value: Column, descending: bool) -> None:
        if name in self.rankings:
            raise ValueError(f"duplicate ranking {name!r}")
        self.rankings[name] = Ranking(value, descending)

    def predicate(self, capability: str, field_name: str | None, value: object) -> Column:
        for _, _, builder in self.predicates.get(capability, []):
            built = builder(field_name, value)
            if built is not None:
                return built
        raise UnsupportedQuery(f"{capability}:{field_name}")

    def ranking(self, name: str) -> Ranking:
        if name not in self.rankings:
            raise UnsupportedQuery(f"ranking {name}")
        return self.rankings[name]

    def copy(self) -> Registry:
        return Registry({k: list(v) for k, v in self.predicates.items()}, dict(self.rankings))


@dataclass(frozen=True)
class Signal:
    """An analyser: columns computed from other columns of the same row.

    ``columns`` maps output names to Columns (a pandas UDF is fine; it must
    return null where it fails). ``done`` tells whether the row's result counts
    as completed.
    """

    name: str
    columns: dict[str, Column]
    done: Column
    dependencies: tuple[str, ...] = ()
    cost: str = "medium"


# fixed values: cost classes in running order
COSTS = ("cheap", "medium", "expensive")


def _in_order(names: Sequence[str], known: dict[str, tuple[str, Sequence[str]]], path: tuple[str, ...] = ()) -> list[str]:
    """The names and what they depend on, each after its dependencies, else cheap ones first."""
    ordered: list[str] = []
    by_cost = lambda n: COSTS.index(known[n][0]) if n in known else len(COSTS)
    for name in sorted(names, key=by_cost):
        if name in path:
            raise ValueError(f"dependency cycle at {name!r}")
        if name in known:
            inner = _in_order(known[name][1], known, (*path, name))
            ordered += [n for n in inner if n not in ordered]
        if name not in ordered:
            ordered.append(name)
    return ordered


class SignalRegistry:
    def __init__(self) -> None:
        self.signals: dict[str, Signal] = {}

    def register_signal(self, signal: Signal) -> None:
        if signal.name in self.signals:
            raise ValueError(f"duplicate signal {signal.name!r}")
        if signal.cost not in COSTS:
            raise ValueError(f"unknown cost {signal.cost!r}")
        self.signals[signal.name] = signal

    def _ordered(self, names: Sequence[str]) -> list[str]:
        return _in_order(names, {n: (s.cost, s.dependencies) for n, s in self.signals.items()})

    def run(self, df: DataFrame, names: Sequence[str], results: str = "capability_results") -> DataFrame:
        """Add the signals' columns and one result per signal and row.

        A signal that fails on a row makes its dependants unavailable on that
        row only; other signals and other rows go on. Cheap signals come first.
        """
        ok: dict[str, Column] = {}
        entries = []
        for name in self._ordered(names):
            signal = self.signals.get(name)
            blocked = F.lit(signal is None)
            for dependency in signal.dependencies if signal else ():
                blocked = blocked | ~ok[dependency]
            done = F.lit(False)
            if signal:
                df = df.withColumns({c: F.when(~blocked, v) for c, v in signal.columns.items()})
                done = F.coalesce(signal.done, F.lit(False))
            flag = f"_ok_{len(ok)}"
            df = df.withColumn(flag, done & ~blocked).withColumn(f"{flag}_blocked", blocked)
            ok[name] = F.col(flag)
            error = F.when(F.col(f"{flag}_blocked"), "UNAVAILABLE").when(~F.col(flag), "FAILED")
            entries.append(
                F.struct(
                    F.lit(name).alias("capability_id"),
                    F.when(F.col(flag), "completed").otherwise("failed").alias("status"),
                    error.alias("error"),
                )
            )
        listed = F.array(*entries).cast(f"array<{CAPABILITY_RESULT}>")
        kept = [c for c in df.columns if not c.startswith("_ok_")]
        return df.withColumn(results, listed).select(*kept, results)


def catalog_status() -> dict[str, str]:
    """Execution status per known capability."""
    return {name: status for name, _, status in CAPABILITY_CATALOG}


@dataclass(frozen=True)
class Analyser:
    """A signal computed by Python for a batch of rows.

    ``function`` takes a pandas frame of the ``inputs`` of up to ``batch_size`` rows and returns one of the ``outputs``
    (name to type), a row for each. A row it raises on is a failed row; so is one whose first output is null.
    """

    name: str
    inputs: tuple[str, ...]
    outputs: dict[str, str]
    function: Callable[[pd.DataFrame], pd.DataFrame]
    batch_size: int = 32
    dependencies: tuple[str, ...] = ()
    cost: str = "medium"


#: Fixed value: the largest batch an analyser gets.
LARGEST_BATCH = 200


class AnalyserRegistry:
    """Analysers in batches, cheap ones first and each after those it depends on."""

    def __init__(self) -> None:
        self.analysers: dict[str, Analyser] = {}

    def register(self, analyser: Analyser) -> None:
        if analyser.name in self.analysers:
            raise ValueError(f"duplicate analyser {analyser.name!r}")
        if analyser.cost not in COSTS:
            raise ValueError(f"unknown cost {analyser.cost!r}")
        self.analysers[analyser.name] = analyser

    def run(self, df: DataFrame, names: Sequence[str], results: str = "capability_results") -> DataFrame:
        """Add the analysers' columns and one result for each analyser and row.

        A batch that raises is halved until the rows that fail are alone: these are FAILED, all others have their
        values. Rows on which a dependency failed, or all rows if it isn't registered, are UNAVAILABLE and not handed
        to the analyser. Inputs may be outputs of analysers that run before. Nothing ends the job but what ends Python.
        """
        ordered = _in_order(names, {n: (a.cost, a.dependencies) for n, a in self.analysers.items()})
        known = [self.analysers.get(n) for n in ordered]
        added = {c: t for a in known if a for c, t in a.outputs.items()}
        fields = [*df.schema.fields, *[T.StructField(c, T._parse_datatype_string(t)) for c, t in added.items()]]
        fields.append(T.StructField(results, T._parse_datatype_string(f"array<{CAPABILITY_RESULT}>")))
        schema = T.StructType(fields)
        return df.mapInArrow(_Analyse(list(zip(ordered, known)), schema, results), schema)


class _Analyse:
    def __init__(self, analysers: list[tuple[str, Analyser | None]], schema: T.StructType, results: str):
        self.analysers, self.schema, self.results = analysers, schema, results

    def _some(self, analyser: Analyser, rows: pd.DataFrame) -> list[dict | None]:
        """The outputs of each row, None where it fails."""
        try:
            found = analyser.function(rows.reset_index(drop=True))
            if len(found) != len(rows):
                raise ValueError(f"{analyser.name}: {len(found)} rows for {len(rows)}")
            return found[list(analyser.outputs)].astype(object).to_dict("records")
        except Exception:  # noqa: BLE001 - a failure is a result of its row
            if len(rows) == 1:
                return [None]
            half = len(rows) // 2
            return self._some(analyser, rows.iloc[:half]) + self._some(analyser, rows.iloc[half:])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(self.schema)
        for batch in batches:
            columns: dict[str, list] = {}
            entries: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            done: dict[str, list[bool]] = {}
            for name, analyser in self.analysers:
                blocked = [analyser is None or not all(done[d][k] for d in analyser.dependencies) for k in range(batch.num_rows)]
                found: list[dict | None] = [None] * batch.num_rows
                if analyser is not None:
                    open_rows = [k for k in range(batch.num_rows) if not blocked[k]]
                    size = max(1, min(LARGEST_BATCH, analyser.batch_size))
                    for a in range(0, len(open_rows), size):
                        mine = open_rows[a : a + size]
                        inputs = {
                            c: [columns[c][k] for k in mine] if c in columns else batch.column(c).take(pa.array(mine)).to_pylist()
                            for c in analyser.inputs
                        }
                        for k, values in zip(mine, self._some(analyser, pd.DataFrame(inputs, dtype=object))):
                            found[k] = values
                    for c in analyser.outputs:
                        values = [f[c] if f else None for f in found]
                        columns[c] = [None if v is None or v is pd.NA or v != v else v for v in values]
                first = next(iter(analyser.outputs)) if analyser and analyser.outputs else None
                done[name] = [not b and f is not None and (first is None or columns[first][k] is not None) for k, (b, f) in enumerate(zip(blocked, found))]
                for k, row in enumerate(entries):
                    error = "UNAVAILABLE" if blocked[k] else None if done[name][k] else "FAILED"
                    row.append({"capability_id": name, "status": "failed" if error else "completed", "error": error})
            added = [pa.array(columns[f.name], f.type) for f in list(target)[batch.num_columns : -1]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added, pa.array(entries, target.field(self.results).type)], target.names)
