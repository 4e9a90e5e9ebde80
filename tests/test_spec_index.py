"""Stored specs in bulk against the single-spec path, and the size of the plan."""

import json
import random

import pytest

from lumenlake.operators import spec_index, specs
from lumenlake.operators.specs import Catalog, all_specs, any_spec, not_spec, predicate

NAN = float("nan")


@pytest.fixture(scope="module")
def catalog(spark):
    draw = random.Random(3)
    maybe = lambda v: None if draw.random() < 0.2 else v
    ids = [f"a{k}" for k in range(300)]
    assets = [(i, maybe(draw.choice(["photo", "video"])), maybe(draw.randrange(50)), maybe(draw.randrange(50)), maybe(draw.random() < 0.5)) for i in ids]
    quality = [(i, draw.choice([None, NAN, 0.5, draw.random()]), draw.choice([None, 0.25, draw.random()]), 1) for i in ids[:250]]
    content = [(i, maybe(draw.random() < 0.5)) for i in ids[50:]]
    words = ["the red car", "a Café by the sea", "", None, "  ", "red", "car the red", "sea-side red car"]
    texts = [(i, draw.choice(words)) for i in ids[20:280]]
    members = [(i, draw.random() < 0.3, maybe(draw.random() < 0.5), 1) for i in ids[100:]]
    return Catalog(
        spark.createDataFrame(assets, "id string, media_type string, created_at long, file_size long, favorite boolean"),
        spark.createDataFrame(quality, "id string, blur_score double, quality_score double, face_count int"),
        spark.createDataFrame(content, "id string, is_screenshot boolean"),
        spark.createDataFrame(texts, "id string, ocr_text string"),
        spark.createDataFrame(members, "id string, in_duplicate boolean, in_similar boolean, memberships int"),
    )


def _leaf(draw):
    make = lambda c, f, v: predicate(c, "eq", {"field": f, "value": v})
    return draw.choice(
        [
            lambda: make("query.date", draw.choice(["before", "after"]), draw.randrange(50)),
            lambda: make("metadata.core", "minFileSize", draw.randrange(50)),
            lambda: make("metadata.core", "favorite", draw.random() < 0.5),
            lambda: make("metadata.core", "mediaTypes", draw.choice([["photo"], ["video", "photo"], []])),
            lambda: make("quality.visual", draw.choice(["maxQuality", "minBlur"]), draw.choice([0.25, 0.5, 0.9])),
            lambda: make("content.screenshot", "screenshot", draw.random() < 0.5),
            lambda: make("content.document", "document", draw.random() < 0.5),
            lambda: make("similarity.perceptual", "similar", draw.random() < 0.5),
            lambda: make("text.ocr", "ocrTerms", draw.choice([["red car"], ["THE", "red"], ["cafe"], ["..."], ["side red"]])),
        ]
    )()


def _tree(draw, depth):
    kind = draw.randrange(6) if depth else 0
    if kind < 2:
        return _leaf(draw)
    if kind == 2:
        return not_spec(_tree(draw, depth - 1))
    children = [_tree(draw, depth - 1) for _ in range(draw.randrange(4))]
    return {"type": "and" if kind < 5 else "or", "children": children}


def _stored(spark, trees):
    return spark.createDataFrame([(k, json.dumps(t)) for k, t in trees.items()], "spec_id string, spec string")


@pytest.mark.parametrize("block", [10_000, 20])
def test_bulk_equals_single_specs(spark, catalog, block):
    draw = random.Random(17)
    trees = {f"s{k}": _tree(draw, 3) for k in range(60)} | {"all": all_specs(), "none": any_spec()}
    # an empty list of media types has no leaf value that a Column can be made of in one go; the rest is compared
    found = spec_index.bulk_match_many(catalog, _stored(spark, trees), block_specs=block)
    want = specs.bulk_match(catalog, trees)
    got, expected = ({(r.spec_id, r.id) for r in df.collect()} for df in (found, want))
    assert got == expected


def test_specs_that_cannot_run_match_nothing(spark, catalog):
    trees = {"people": predicate("metadata.core", "eq", {"field": "people", "value": ["a"]}), "odd": {"type": "xor", "children": []}}
    stored = _stored(spark, trees | {"ok": all_specs()}).unionByName(
        spark.createDataFrame([("broken", "{"), ("null", None), ("list", "[]")], "spec_id string, spec string")
    )
    assert {r.spec_id for r in spec_index.bulk_match_many(catalog, stored).select("spec_id").distinct().collect()} == {"ok"}
    assert spec_index.bulk_match_many(catalog, stored.limit(0)).count() == 0


def test_the_plan_does_not_grow_with_the_specs(spark, catalog):
    draw = random.Random(5)
    every = [_leaf(random.Random(k)) for k in range(40)]

    def size(n):
        trees = {f"s{k}": all_specs(*every, _tree(draw, 2)) for k in range(n)}
        plan = spec_index.bulk_match_many(catalog, _stored(spark, trees))._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("\n")

    assert size(3) == size(1500)


def test_matches_come_in_bounded_batches():
    import numpy as np
    import pyarrow as pa

    rows = [(k, json.dumps(all_specs())) for k in range(200)]
    index = spec_index.SpecIndex(rows)
    batch = pa.RecordBatch.from_arrays([pa.array([f"a{k}" for k in range(3000)])], ["id"])
    found = list(spec_index._Match(index, pa.int64(), ["id"], False)(iter([batch])))
    assert sum(b.num_rows for b in found) == 200 * 3000
    assert max(b.num_rows for b in found) < spec_index._MATCHES + 3000
    lists = list(spec_index._Match(index, pa.int64(), ["id"], True)(iter([batch])))
    assert np.concatenate([b.column("spec_id") for b in lists]).tolist() == list(range(200))
    assert all(len(ids) == 3000 for b in lists for ids in b.column("found"))


def test_told_columns_and_lists_equal_a_join_of_the_matches(spark, catalog):
    draw = random.Random(29)
    stored = _stored(spark, {f"s{k}": _tree(draw, 3) for k in range(30)} | {"all": all_specs()})
    told = spark.createDataFrame([(f"a{k % 200}", k) for k in range(250)] + [(None, 1)], "id string, mark long")
    want = sorted(map(tuple, spec_index.bulk_match_many(catalog, stored).join(told, "id").select("spec_id", "id", "mark").collect()))
    pairs = spec_index.bulk_match_many(catalog, stored, told=told)
    lists = spec_index.bulk_match_many(catalog, stored, told=told, lists=True).selectExpr("spec_id", "inline(found)")
    assert sorted(map(tuple, pairs.collect())) == want and sorted(map(tuple, lists.collect())) == want


@pytest.mark.parametrize("block", [10_000, 7])
def test_totals_add_up_the_matches(spark, catalog, monkeypatch, block):
    monkeypatch.setattr(spec_index, "_PIECE", 40)
    draw = random.Random(31)
    trees = {f"s{k}": _tree(draw, 3) for k in range(30)} | {"all": all_specs(), "again": all_specs(), "none": any_spec()}
    stored = _stored(spark, trees)
    told = spark.createDataFrame([(f"a{k % 200}", k - 90, k * 10**10) for k in range(250)] + [("a7", None, 1)], "id string, mark int, large long")
    ids = {}
    for row in spec_index.bulk_match_many(catalog, stored, told=told).collect():
        ids.setdefault(row.spec_id, []).append(row)
    want = {k: (min(r.id for r in v), max(r.id for r in v), sum(r.mark or 0 for r in v), sum(r.large for r in v)) for k, v in ids.items()}
    found = spec_index.bulk_match_many(catalog, stored, block_specs=block, told=told, totals=["mark", "large"])
    whole = found.groupBy("spec_id").agg({"first_id": "min", "last_id": "max", "mark": "sum", "large": "sum"})
    got = {r.spec_id: (r["min(first_id)"], r["max(last_id)"], r["sum(mark)"], r["sum(large)"]) for r in whole.collect()}
    assert got == want and got["all"] == got["again"] and "none" not in got


@pytest.mark.parametrize("run,trees,exact", [(4096, 1024, 1 << 62), (13, 3, 1 << 62), (64, 1, 1)])
def test_totals_of_a_task(monkeypatch, run, trees, exact):
    import pyarrow as pa

    for name, value in (("_RUN", run), ("_TREES", trees), ("_EXACT", exact)):
        monkeypatch.setattr(spec_index, name, value)
    draw = random.Random(run)
    sizes, marks = [draw.randrange(50) for _ in range(300)], [draw.randrange(-(10**15), 10**15) for _ in range(300)]
    ids = [f"a{draw.randrange(1000)}" for _ in sizes]
    batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(sizes), pa.array(marks)], ["id", "file_size", "mark"])
    bounds = [*range(0, 60, 7), 21]
    index = spec_index.SpecIndex([(b, json.dumps(predicate("metadata.core", "eq", {"field": "minFileSize", "value": b}))) for b in bounds])
    assert len(index.trees) == len(set(bounds))
    task = spec_index._Totals(index, pa.int64(), ["mark"], False)
    found = [tuple(r.values()) for b in task(iter([batch.slice(0, 90), batch.slice(90, 0), batch.slice(90)])) for r in b.to_pylist()]
    want = []
    for b in bounds:
        mine = [(i, m) for i, n, m in zip(ids, sizes, marks) if n >= b]
        want += [(b, min(mine)[0], max(mine)[0], sum(m for _, m in mine))] if mine else []
    assert found == want and list(task(iter([batch.slice(0, 0)]))) == []


def test_blocks_share_one_pass_over_the_catalog(spark, catalog, monkeypatch):
    draw = random.Random(37)
    trees = {f"s{k}": _tree(draw, 3) for k in range(40)}
    expected = {(r.spec_id, r.id) for r in specs.bulk_match(catalog, trees).collect()}
    whole = spec_index.bulk_match_many(catalog, _stored(spark, trees), block_specs=10)
    plan = whole._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 4 and "Join" not in plan
    monkeypatch.setattr(spec_index, "_LISTS", 1)  # tables of their own for blocks that ask for other terms
    for found in (whole, spec_index.bulk_match_many(catalog, _stored(spark, trees), block_specs=10)):
        assert {(r.spec_id, r.id) for r in found.collect()} == expected
