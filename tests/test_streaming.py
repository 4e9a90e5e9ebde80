import pytest
from pyspark.sql import functions as F

from lumenlake.operators.jobs import job_progress, may_reconcile
from lumenlake.operators.merges import reconcile_snapshot
from lumenlake.sources import tables
from lumenlake.streaming import ingest, views


def change(key, seq, size, blur=None, status=None):
    analysis = None
    if status:
        analysis = dict.fromkeys(["model_version", "quality_score", "brightness_score", "face_count", "ocr_text",
                                  "is_screenshot", "is_document", "is_meme", "perceptual_hash", "content_hash"])
        analysis.update(analysis_version=1, analyzed_at=seq, blur_score=blur,
                        capability_results=[("quality.visual", status, None)])
    return (key, "photo", 1, None, 1, 1, None, size, False, None, None, seq, seq, analysis)


def state(spark, path):
    now = ingest.current_tables(spark, path)
    assets = {tuple(r) for r in now["assets"].select("id", "file_size").collect()}
    quality = {tuple(r) for r in now["quality"].select("id", "blur_score").collect()}
    status = {tuple(r) for r in now["capabilities"].select("id", "status").collect()}
    return assets, quality, status


def test_stop_resume_replay_and_compaction(spark, tmp_path):
    source, path, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")

    def arrive(rows, name):
        spark.createDataFrame(rows, ingest.CHANGES).coalesce(1).write.parquet(f"{source}/{name}")

    def run():
        stream = spark.readStream.schema(ingest.CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        query = ingest.start_ingest(stream, path, checkpoint, after_commit=lambda s, b: commits.append(b))
        query.awaitTermination()

    commits = []
    arrive([change("a", 1, 10, 0.5, "completed"), change("b", 1, 20)], "one")
    run()
    assert state(spark, path) == ({("a", 10), ("b", 20)}, {("a", 0.5)}, {("a", "completed")})
    arrive([change("a", 1, None, None, "failed"), change("c", 1, 30, 0.1, "completed")], "two")
    run()
    expected = ({("a", None), ("b", 20), ("c", 30)}, {("a", 0.5), ("c", 0.1)}, {("a", "failed"), ("c", "completed")})
    assert commits == [0, 1]
    assert state(spark, path) == expected
    # A batch written again after a failure changes nothing.
    again = spark.read.schema(ingest.CHANGES).parquet(f"{path}/changes/batch_id=1")
    rows = spark.createDataFrame(again.collect(), again.schema)
    tables.write_batch(rows, f"{path}/changes", 1)
    assert state(spark, path) == expected
    assert ingest.compact(spark, path) == 1
    assert state(spark, path) == expected
    # Compacting again without a new batch writes nothing.
    assert ingest.compact(spark, path) == 1
    assert state(spark, path) == expected
    arrive([change("c", 1, 31)], "three")
    run()
    later = {("a", None), ("b", 20), ("c", 31)}
    assert state(spark, path)[0] == later

    # A compaction that breaks off between two tables leaves everything as it was.
    good = ingest.write_snapshot
    ingest.write_snapshot = lambda *_: (_ for _ in ()).throw(OSError("lost"))
    try:
        with pytest.raises(OSError):
            ingest.compact(spark, path)
    finally:
        ingest.write_snapshot = good
    assert state(spark, path)[0] == later
    assert ingest.compact(spark, path) == 2
    assert ingest.expire(spark, path, keep=1) == [0, 1, 2]
    assert state(spark, path)[0] == later
    assert ingest.compact(spark, path) == 2
    arrive([change("d", 1, 40)], "four")
    run()
    assert ingest.compact(spark, path) == 3
    assert state(spark, path)[0] == later | {("d", 40)}


def test_unseen_assets_are_dropped_only_after_completion(spark):
    schema = "job_id string, processed bigint, total bigint, status string, updated_at bigint"
    paused = spark.createDataFrame([("j", 5, 10, "running", 1), ("j", 7, 10, "paused", 2), ("k", 1, 0, "running", 1)], schema)
    done = paused.unionByName(spark.createDataFrame([("j", 12, 10, "completed", 3)], schema))
    assert not may_reconcile(paused, "j").first().completed
    assert may_reconcile(done, "j").first().completed
    assert not may_reconcile(done, "unknown").first().completed
    progress = {r.job_id: r.percent for r in job_progress(done).collect()}
    assert progress == {"j": 100, "k": 0}
    assets = spark.createDataFrame([("a", 5), ("b", 9)], "id string, indexed_at bigint")
    assert [r.id for r in reconcile_snapshot(assets, 9).collect()] == ["b"]


def test_snapshots_switch_only_when_complete(spark, tmp_path):
    path = str(tmp_path / "t")
    assert tables.snapshot_versions(spark, path) == []
    tables.write_snapshot(spark.range(3), path, 1)
    tables.write_snapshot(spark.range(5), path, 2)
    assert tables.read_snapshot(spark, path).count() == 5
    (tmp_path / "t" / "version=2" / "_SUCCESS").unlink()
    assert tables.snapshot_versions(spark, path) == [1]
    assert tables.read_snapshot(spark, path).count() == 3


def test_running_totals_and_layout(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(100).withColumn("created_at", F.col("id") * 86400000).withColumn("media_type", F.lit("photo")).write.parquet(source)
    stream = spark.readStream.schema("id bigint, created_at bigint, media_type string").parquet(source)
    totals = views.stream_totals(stream, {"n": F.count(F.lit(1)), "s": F.sum("id")})
    query = views.totals_to(totals, str(tmp_path / "out"), str(tmp_path / "cp"), {"availableNow": True})
    query.awaitTermination()
    assert tables.read_snapshot(spark, str(tmp_path / "out")).first().asDict() == {"n": 100, "s": 4950}
    laid = tables.partition_for_reading(spark.read.parquet(source), 2)
    laid.write.partitionBy("media_type", "created_month").parquet(str(tmp_path / "laid"))
    back = spark.read.parquet(str(tmp_path / "laid")).where("created_month = '1970-02'")
    assert back.count() == 28


def test_refreshes_are_throttled(spark):
    ran = []
    refresh = views.at_most_every(lambda s, b: ran.append(b), seconds=60)
    for batch in range(3):
        refresh(spark, batch)
    assert ran == [0]
    refresh.finish(spark)
    refresh.finish(spark)
    assert ran == [0, 2]
    ran.clear()
    always = views.at_most_every(lambda s, b: ran.append(b), seconds=0)
    always(spark, 5)
    always(spark, 6)
    always.finish(spark)
    assert ran == [5, 6]


def test_stored_rows_become_asset_records(spark):
    from lumenlake.sources.listing import row_projection

    stored = spark.createDataFrame([("a", "photo", 5, 1), ("b", "video", 6, 0)], "id string, media_type string, created_at bigint, favorite int")
    rows = row_projection(stored)
    assert rows.columns[0] == "id" and len(rows.columns) == 12
    assert [(r.favorite, r.file_size) for r in rows.collect()] == [(True, None), (False, None)]
