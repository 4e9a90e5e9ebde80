"""Deep pages by slices, folded stream state, and clusters that are kept batch by batch."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lumenlake.operators import clusters
from lumenlake.operators.paging import deep_page, max_results, offset_page, recoverable_target
from lumenlake.plans import ordering
from lumenlake.registry import Ranking
from lumenlake.streaming import cluster_stream, views


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    listed = [(f"i{k}", draw.choice([None, draw.randrange(300)]), draw.choice([None, 0, draw.randrange(50)])) for k in range(900)]
    return spark.createDataFrame(listed, "id string, v int, file_size long").repartition(5)


def order():
    return [F.asc("v"), F.asc("id")]


@pytest.mark.parametrize("offset,limit", [(0, 10), (450, 60), (895, 50), (2000, 5), (0, 900)])
def test_deep_pages(rows, offset, limit):
    want = rows.orderBy(*order()).offset(offset).limit(limit).collect()
    got = deep_page(rows, order(), offset, limit).collect()
    assert [r[:3] for r in got] == [tuple(r) for r in want]
    assert [r.position for r in got] == list(range(offset + 1, offset + 1 + len(want)))


def test_only_touched_slices_are_sorted(rows):
    page = ordering.rows_between(rows, order(), 450, 460)
    assert page.count() == 10
    plan = page._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan and "Filter" in plan  # the slices are chosen before the window that sorts them
    assert plan.index("Window") < plan.rindex("Filter")


def test_large_counts_and_offsets_by_slices(rows, monkeypatch):
    from lumenlake.operators import paging

    ranking = Ranking(F.coalesce("v", F.lit(-1)), descending=True)
    small = {r.id for r in max_results(rows, ranking, 400).collect()}
    page = [r.id for r in offset_page(rows, order(), 300, 50).collect()]
    monkeypatch.setattr(paging, "SHALLOW", 10)
    assert {r.id for r in max_results(rows, ranking, 400).collect()} == small
    assert [r.id for r in offset_page(rows, order(), 300, 50).collect()] == page


@pytest.mark.parametrize("target", [0, 1, 500, 10**9])
def test_prefix_up_to_a_target(rows, target):
    listed = sorted(rows.collect(), key=lambda r: (r.v is not None, r.v or 0, r.id))
    total, want = 0, []
    for r in listed:
        if total < target:
            total += r.file_size or 0
            want.append((r.id, total))
    assert sorted(want) == sorted((r.id, r.running_bytes) for r in recoverable_target(rows, order(), target).collect())


def test_folded_state_has_few_folders(spark, tmp_path):
    events = spark.createDataFrame([(k % 7, k) for k in range(150)], "user long, seq long")
    source = str(tmp_path / "source")
    for k in range(50):
        events.where(F.col("seq") % 50 == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    latest = views.stream_latest(stream, "user", "seq")
    path = str(tmp_path / "latest")
    views.latest_to(latest, path, str(tmp_path / "checkpoint"), "user", fold_every=8).awaitTermination()
    found = {r.user: r.seq for r in views.read_latest(spark, path, "user", latest.schema).collect()}
    assert found == {u: max(k for k in range(150) if k % 7 == u) for u in range(7)}
    held = [n for n in os.listdir(f"{path}/updates") if n.startswith("batch_id")]
    assert len(held) < 8 and len([n for n in os.listdir(f"{path}/folded") if n.startswith("version")]) <= 2


def _hash(draw):
    base = draw.choice([0x0123456789ABCDEF, 0x0123FFFF0000ABCD, 0x0123456789ABC000])
    for _ in range(draw.randrange(9)):
        base ^= 1 << draw.randrange(48)
    return f"{base:016x}"


def test_clusters_kept_by_batches_equal_a_rebuild(spark, tmp_path):
    draw, path = random.Random(9), str(tmp_path / "clusters")
    now: dict[str, tuple] = {}
    for batch in range(4):
        rows = []
        for k in draw.sample(range(120), 45):
            gone = draw.random() < 0.25
            row = (f"a{k}", None if gone else f"c{draw.randrange(20)}", None if gone or draw.random() < 0.1 else _hash(draw), gone, 1)
            rows.append(row)
            now.pop(row[0], None)
            if not gone:
                now[row[0]] = row[:3]
        frame = spark.createDataFrame(rows, cluster_stream.CHANGES)
        for _ in range(1 + (batch == 2)):  # a batch that is replayed changes nothing
            cluster_stream.commit_batch(frame, path, batch)
        fresh = spark.createDataFrame(list(now.values()), "id string, content_hash string, visual_hash string")
        want = sorted(map(tuple, clusters.rebuild_clusters(fresh, 4).collect()))
        assert sorted(map(tuple, cluster_stream.current_clusters(spark, path).collect())) == want
    assert any(c[1] == "similar" for c in want)
