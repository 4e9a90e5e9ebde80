import random

from pyspark.sql import functions as F

from lumenlake import schemas
from lumenlake.operators import merges, staleness, validation

QUALITY = schemas.columns(schemas.QUALITY)


def as_set(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_upsert_overwrites_with_nulls_and_is_idempotent(spark):
    base = spark.createDataFrame([("a", 1, 10), ("b", 2, 20)], "id string, x int, y int")
    updates = spark.createDataFrame(
        [("a", None, 11, 1), ("a", 5, None, 2), ("c", 7, 70, 1)], "id string, x int, y int, seq bigint"
    )
    once = merges.upsert_latest(base, updates, "id", "seq")
    assert as_set(once, "id", "x", "y") == {("a", 5, None), ("b", 2, 20), ("c", 7, 70)}
    assert as_set(merges.upsert_latest(once, updates, "id", "seq"), "id", "x", "y") == as_set(once, "id", "x", "y")


def test_sparse_merge_equals_one_update_at_a_time(spark):
    rng = random.Random(11)
    maybe = lambda v: v if rng.random() < 0.5 else None
    base = [(k, maybe(0.1), maybe(0.2), None, None, 1, "m0", 0) for k in "abcd"]
    updates = [
        (rng.choice("abcdef"), maybe(rng.random()), maybe(rng.random()), None, maybe(seq), 1, maybe(f"m{seq}"), seq, seq)
        for seq in range(1, 40)
    ]
    state = {row[0]: list(row) for row in base}
    for row in updates:
        if all(v is None for v in row[1:5]):
            continue
        held = state.setdefault(row[0], [row[0], *[None] * 7])
        for i in range(1, 5):
            held[i] = held[i] if row[i] is None else row[i]
        held[5:8] = row[5:8]
    merged = merges.merge_quality(
        spark.createDataFrame(base, schemas.QUALITY),
        spark.createDataFrame(updates, schemas.QUALITY + ", seq bigint"),
    )
    assert as_set(merged, *QUALITY) == {tuple(v) for v in state.values()}


def test_later_failure_replaces_success_and_text_defaults_to_empty(spark):
    schema = schemas.ANALYSES.replace("id string", "id string, seq bigint")
    columns = schemas.columns(schema)

    def analysis(key, seq, status, text=None):
        row = dict.fromkeys(columns)
        row.update(id=key, seq=seq, analysis_version=1, analyzed_at=seq, ocr_text=text)
        row["capability_results"] = [("text.ocr", status, None)]
        return tuple(row[c] for c in columns)

    rows = spark.createDataFrame(
        [analysis("a", 1, "completed", "x"), analysis("a", 2, "failed"), analysis("b", 1, "completed")], schema
    )
    status = merges.upsert_capability_status(spark.createDataFrame([], schemas.CAPABILITIES), rows)
    assert as_set(status, "id", "status") == {("a", "failed"), ("b", "completed")}
    texts = merges.merge_text(spark.createDataFrame([], schemas.TEXTS), rows)
    assert as_set(texts, "id", "ocr_text") == {("a", "x"), ("b", "")}


def test_fast_and_deep_validity(spark):
    assets = spark.createDataFrame(
        [(k, m) for k, m in (("android:1:p", 100), ("android:2:p", 100), ("IOS:3", None), ("android:4:p", 300), ("android:5:p", 1))],
        "id string, modified_at bigint",
    )
    from lumenlake.constants import DEEP_CAPABILITIES, FAST_CAPABILITIES

    rows = []
    for key, model, names in (
        ("android:1:p", "android-heuristic-2", DEEP_CAPABILITIES),
        ("android:2:p", "android-fast-2", FAST_CAPABILITIES),
        ("IOS:3", "ios-vision-1", DEEP_CAPABILITIES),
        ("android:4:p", "android-heuristic-2", DEEP_CAPABILITIES),
    ):
        rows += [(key, n, "completed", 1, model, 200, None) for n in names]
    rows += [("android:5:p", n, "completed", 1, "android-heuristic-2", 200, None) for n in DEEP_CAPABILITIES[:4]]
    rows += [("android:5:p", DEEP_CAPABILITIES[4], "failed", 1, "android-heuristic-2", 200, "E")]
    capabilities = spark.createDataFrame(rows, schemas.CAPABILITIES)
    pending = {s: {r.id for r in staleness.pending_assets(assets, capabilities, s).collect()} for s in ("fast", "deep")}
    assert pending["fast"] == {"android:4:p"}
    assert pending["deep"] == {"android:2:p", "android:4:p", "android:5:p"}


def test_cascade_clears_references_and_spares_feedback(spark):
    assets = spark.createDataFrame([("a",), ("b",)], "id string")
    quality = spark.createDataFrame([("a", 0.1), ("b", 0.2)], "id string, blur_score double")
    clusters = spark.createDataFrame([("c1", "a"), ("c2", "b"), ("c3", None)], "cluster_id string, representative_id string")
    gone = spark.createDataFrame([("a",), ("a",)], "id string")
    kept = merges.delete_cascade(
        gone, {"assets": assets, "quality": quality, "clusters": clusters}, {"clusters": "representative_id"}
    )
    assert as_set(kept["assets"], "id") == {("b",)}
    assert as_set(kept["quality"], "id") == {("b",)}
    assert as_set(kept["clusters"], "cluster_id", "representative_id") == {("c1", None), ("c2", "b"), ("c3", None)}


def test_cache_needs_full_access_age_and_no_clock_skew(spark):
    rows = [
        ("authorized", "authorized", 0, True),
        ("authorized", "authorized", 21599999, True),
        ("authorized", "authorized", 21600000, False),
        ("authorized", "authorized", -1, False),
        ("limited", "limited", 0, False),
        ("limited", "authorized", 0, False),
        (None, "authorized", 0, False),
    ]
    df = spark.createDataFrame(rows, "stored string, scope string, age bigint, expected boolean")
    now = F.lit(10**12)
    valid = staleness.cache_valid(now - F.col("age"), F.col("stored"), F.col("scope"), now)
    assert df.where(valid != F.col("expected")).count() == 0


def test_oversized_batches_and_bad_results_are_rejected(spark):
    batches = spark.createDataFrame(
        [("j", 201, 0, 1, 2, 0.5, "c"), ("j", 1, 1, 0, 0, 1.0, None), ("j", 1, 1, -1, 0, 1.5, "")],
        "job_id string, asset_count bigint, analysis_count bigint, processed bigint, total bigint, progress double, cursor string",
    )
    good, bad = validation.validate_batches(batches)
    assert good.count() == 1
    assert {tuple(r.reject_reasons) for r in bad.collect()} == {("assets",), ("processed", "progress", "cursor")}
