"""Resolving providers, and analysers in batches."""

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import spec_tables
from lumenlake.operators.capabilities import Capability, Provider, Resolver, apply_resolved, default_resolver
from lumenlake.operators.specs import all_specs, any_spec, not_spec, predicate
from lumenlake.registry import Analyser, AnalyserRegistry, UnsupportedQuery

ANY = (("*", "number"),)


def test_priorities_dependencies_fallbacks_and_cycles():
    found = Resolver([Capability("a"), Capability("b", ("a",)), Capability("c", ("d",)), Capability("d", ("c",)), Capability("e", (), ("c", "f"))])
    found.register(Capability("f"))
    found.add_provider("a", Provider("low", ANY))
    found.add_provider("a", Provider("weak", ANY, priority=9, degraded=True))
    found.add_provider("a", Provider("high", ANY, priority=5))
    found.add_provider("b", Provider("b", ANY))
    found.add_provider("c", Provider("c", ANY))
    assert found.resolve("a").provider.name == "high"
    assert (found.resolve("b").status, found.resolve("b").reason) == ("available", None)
    found.capabilities["a"].providers[:] = [Provider("weak", ANY, degraded=True)]
    assert (found.resolve("b").status, found.resolve("b").reason) == ("degraded", "DEPENDENCY_DEGRADED")
    assert (found.resolve("c").status, found.resolve("c").reason) == ("unavailable", "DEPENDENCY_UNAVAILABLE")
    assert found.resolve("e").reason == "NO_PROVIDER" and found.resolve("none").reason == "NOT_REGISTERED"
    found.add_provider("f", Provider("f", ANY))
    assert (found.resolve("e").status, found.resolve("e").provider.name) == ("degraded", "f")
    found.add_provider("e", Provider("gone", ANY, missing="MISSING_MODEL"))
    assert (found.resolve("e").reason, found.answer("e", "x", "number").status) == ("MISSING_MODEL", "degraded")
    assert found.answer("f", "people", "number").status == "unavailable" and found.answer("f", "x", "boolean").status == "unavailable"
    for again in (lambda: found.register(Capability("a")), lambda: found.add_provider("f", Provider("f", ANY))):
        with pytest.raises(ValueError):
            again()


def test_specs_run_on_tables_of_providers(spark):
    assets = spark.createDataFrame([(f"x{k}", k) for k in range(6)], "id string, n int")
    marks = spark.createDataFrame([("x1", 1), ("x2", 0), ("x3", None)], "asset string, mark int")
    found = default_resolver()
    found.register(Capability("my.mark"))
    build = lambda field, value: F.col("mark") == value
    found.add_provider("my.mark", Provider("marks", ANY, build, marks, "asset", ("mark",)))
    one = predicate("my.mark", "eq", {"field": "m", "value": 1})
    ids = lambda spec: sorted(r.id for r in apply_resolved(assets, spec, found).collect())
    assert ids(one) == ["x1"] and ids(not_spec(one)) == ["x2"] and len(ids(all_specs())) == 6 and ids(any_spec()) == []
    with pytest.raises(UnsupportedQuery):
        ids(all_specs(one, predicate("my.mark", "eq", {"field": "m", "value": "text"})))
    with pytest.raises(ValueError, match="there already"):
        apply_resolved(assets.withColumn("mark", F.lit(1)), one, found)


def test_coverage_asks_the_resolver(spark):
    text = '{"type":"predicate","capability":"my.mark","operator":"eq","value":{"field":"m","value":1}}'
    stored = spark.createDataFrame([(1, text)], "spec_id long, spec string")
    status = lambda resolver: spec_tables.spec_coverage(stored, resolver=resolver).first().status
    found = default_resolver()
    assert status(None) == "unavailable"
    found.register(Capability("my.mark"))
    found.add_provider("my.mark", Provider("marks", ANY, degraded=True))
    assert status(found) == "degraded"
    found.add_provider("my.mark", Provider("better", ANY))
    assert status(found) == "complete"


def test_failures_stay_with_their_rows(spark):
    def risky(rows):
        if (rows["k"] % 10 == 3).any():
            raise RuntimeError("no")
        return rows.assign(double=[None if k % 10 == 5 else 2 * k for k in rows["k"]])

    def after(rows):
        assert all(v is not None for v in rows["double"])
        return rows.assign(text=[f"{k}:{int(d)}" for k, d in zip(rows["k"], rows["double"])])

    def short(rows):
        return rows.assign(n=1).iloc[:-1]

    registry = AnalyserRegistry()
    registry.register(Analyser("after", ("k", "double"), {"text": "string"}, after, 7, ("risky",), "cheap"))
    registry.register(Analyser("risky", ("k",), {"double": "bigint"}, risky, 1000))
    registry.register(Analyser("short", ("k",), {"n": "int"}, short, 4, (), "expensive"))
    done = registry.run(spark.range(100).withColumnRenamed("id", "k").repartition(3), ["after", "short", "gone"]).collect()
    assert len(done) == 100
    for r in done:
        status = {e.capability_id: e.error for e in r.capability_results}
        bad = r.k % 10 in (3, 5)
        assert status == {"risky": "FAILED" if bad else None, "after": "UNAVAILABLE" if bad else None, "short": "FAILED", "gone": "UNAVAILABLE"}
        assert (r.double, r.text, r.n) == ((None, None, None) if bad else (2 * r.k, f"{r.k}:{2 * r.k}", None))
    assert registry.run(spark.range(0).withColumnRenamed("id", "k"), ["after"]).count() == 0


def test_analyser_cycles_and_duplicates(spark):
    registry = AnalyserRegistry()
    make = lambda name, *needs: Analyser(name, ("id",), {name: "int"}, lambda rows: rows, dependencies=needs)
    registry.register(make("a", "b"))
    registry.register(make("b", "a"))
    with pytest.raises(ValueError, match="cycle"):
        registry.run(spark.range(1), ["a"])
    with pytest.raises(ValueError, match="duplicate"):
        registry.register(make("a"))
