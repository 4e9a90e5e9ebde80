"""What a Python worker of the pipeline holds: no table of all features, sums a slice at a time, small batches."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lumenlake.llm import decontamination as d

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def weights():
    chance = np.random.default_rng(3)
    return chance.random(d.FEATURES, np.float32), (0.01 * chance.standard_normal((d.FEATURES, d.LATENT))).astype(np.float32)


def words(seed: int = 4) -> pa.RecordBatch:
    hashes = np.random.default_rng(seed).integers(1, 1 << 32, (40, 200), np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([h.tobytes() for h in hashes], pa.binary())], ["id", "words"])


def peak(run) -> tuple[list, float]:
    tracemalloc.start()
    found = run()
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return found, most


def test_rows_of_features(weights):
    weight, latent = weights
    space, features = d.Space(*weights), np.unique(np.random.default_rng(6).integers(0, d.FEATURES, 3000))
    signs, half = np.concatenate([d._signs(a, b) for a, b in d._parts()]), latent.astype(np.float16).astype(np.float64)
    rest = (signs - half @ (half.T @ signs)) / np.sqrt(d.LENGTH - d.LATENT)
    expected = np.concatenate([half, rest], axis=1) * weight[:, None]
    assert np.allclose(space.rows(features, space.packed()), expected[features], atol=1e-4)


def test_search_holds_no_table_of_all_features(weights):
    batch, space = words(), d.Space(*weights)
    item = np.frombuffer(batch.column("words")[7].as_py(), np.uint32)[50:90].copy()
    found, most = peak(lambda: list(d._Search(space, [(1, item)])(iter([batch]))))
    assert [(r["doc_id"], r["common_words"]) for b in found for r in b.to_pylist()] == [(7, 40)]
    assert most < 100


def test_sample_gives_its_sums_a_slice_at_a_time(weights, monkeypatch):
    monkeypatch.setattr(d, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 5)))
    flags = np.packbits(np.ones(1 << d._FLAGS, bool))
    numbers, most = peak(lambda: [b.column("slice").to_pylist() for b in d._Sample(weights[0], flags)(iter([words()]))])
    assert numbers == [[k] for k in range(d.FEATURES // d._SLICE)]
    assert most < 160


def test_stages_bound_their_batches(spark):
    before = spark.conf.get(BATCH)
    try:
        for own, expected in (("10000", 1000), ("0", 1000), ("200", 200)):
            spark.conf.set(BATCH, own)
            corpus_pipeline.stage(lambda spark, docs, sf_dir: docs)(spark, None, "")
            assert int(spark.conf.get(BATCH)) == expected
    finally:
        spark.conf.set(BATCH, before)
