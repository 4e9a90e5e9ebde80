"""Streams driven to completion over the given tables, and the two-stage run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import model as M
from checks.model import NOW, asset_id, with_tables
from checks.q_tables import SIGNAL_UPDATES, UPDATE_VERSIONS, UPDATES_SQL, _updates, pending_sql
from checks.register import query
from lumenlake import schemas
from lumenlake.operators.insights import known_sum
from lumenlake.operators.merges import latest_by_key
from lumenlake.operators.staleness import completed_work
from lumenlake.plans.two_stage import two_stage_run
from lumenlake.session import scratch_path
from lumenlake.sources.tables import read_snapshot
from lumenlake.streaming import cluster_stream, ingest, views

PARTS = 4


def as_stream(spark, df: DataFrame, name: str, key: str) -> DataFrame:
    """``df`` as a file stream of several batches; all rows of a key are in one file."""
    path = scratch_path(spark, name)
    df.repartition(PARTS, key).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def finish(query) -> None:
    query.awaitTermination()


CHANGE = [
    f"{asset_id('doc_id')} AS id",
    "'photo' AS media_type",
    "n_chars AS created_at",
    "case when seq = 2 then null else n_chars * seq end AS modified_at",
    "cast(10 as int) AS width",
    "cast(10 as int) AS height",
    "cast(null as double) AS duration",
    "case when seq = 3 and lang = 'en' then null else n_chars + seq end AS file_size",
    "lang = 'de' AS favorite",
    "cast(null as double) AS latitude",
    "cast(null as double) AS longitude",
    f"{NOW} + seq AS indexed_at",
    "cast(seq as bigint) AS seq",
]
ANALYSIS = [
    *UPDATE_VERSIONS,
    *SIGNAL_UPDATES["quality"],
    "case when seq = 3 then text end AS ocr_text",
    *SIGNAL_UPDATES["content"],
    *SIGNAL_UPDATES["hashes"],
]


def _changes(spark, sf) -> DataFrame:
    fields = ", ".join(f"'{e.rsplit(' AS ', 1)[1]}', {e.rsplit(' AS ', 1)[0]}" for e in ANALYSIS)
    results = (
        "array(named_struct('capability_id', 'text.ocr', 'status', case when seq = 2 then 'failed' else 'completed' end,"
        " 'error', case when seq = 2 then 'OCR_FAILED' end))"
    )
    analysis = f"case when lang = 'fr' and seq = 2 then null else named_struct({fields}, 'capability_results', {results}) end"
    rows = _updates(spark, sf).selectExpr(*CHANGE, f"{analysis} AS analysis")
    # The order of struct fields follows the declared schema.
    ordered = ", ".join(f"analysis.{c}" for c in schemas.columns(schemas.ANALYSES) if c != "id")
    return rows.withColumn("analysis", F.expr(f"case when analysis is not null then struct({ordered}) end"))


def _last(column: str) -> str:
    return f"arg_max({column}, seq) filter (where analysed and {column} is not null)"


INGESTED_SQL = (
    f"with u as (select {', '.join(CHANGE)}, {', '.join(ANALYSIS)}, not (lang = 'fr' and seq = 2) as analysed"
    f" from ({UPDATES_SQL})), l as (select * from u qualify row_number() over (partition by id order by seq desc) = 1),"
    " s as (select id, "
    + ", ".join(f"{_last(c)} as {c}" for c in ("blur_score", "quality_score", "is_document", "content_hash"))
    + ", arg_max(seq, seq) filter (where analysed) as last_seq,"
    " arg_max(coalesce(length(ocr_text), 0), seq) filter (where analysed and (ocr_text is not null or seq <> 2)) as text_length"
    " from u group by id) select l.id, l.file_size, l.modified_at, s.blur_score, s.quality_score, s.is_document, s.content_hash,"
    " s.text_length, case when last_seq = 2 then 'failed' else 'completed' end as text_status from l join s on s.id = l.id"
)


def _ingested(spark, sf, after_commit=None):
    stream = as_stream(spark, _changes(spark, sf), "changes", "id")
    path = scratch_path(spark, "ingest")
    commit = (lambda s, batch_id: after_commit(s, path, batch_id)) if after_commit else None
    finish(ingest.start_ingest(stream, path, scratch_path(spark, "ingest-checkpoint"), after_commit=commit))
    return path


def _state(spark, path):
    now = ingest.current_tables(spark, path)
    return (
        now["assets"].select("id", "file_size", "modified_at")
        .join(now["quality"].select("id", "blur_score", "quality_score"), "id", "left")
        .join(now["content"].select("id", "is_document"), "id", "left")
        .join(now["hashes"].select("id", "content_hash"), "id", "left")
        .join(now["texts"].select("id", F.length("ocr_text").cast("bigint").alias("text_length")), "id", "left")
        .join(now["capabilities"].select("id", F.col("status").alias("text_status")), "id", "left")
    )


@query("stream_ingest", INGESTED_SQL)
def stream_ingest(spark, sf):
    return _state(spark, _ingested(spark, sf))


@query("stream_compact", INGESTED_SQL)
def stream_compact(spark, sf):
    """Compacted twice after the second batch and once at the end, folded batches deleted: the same state."""

    def fold(session, path, batch_id):
        if batch_id == 1:
            assert ingest.compact(session, path) == ingest.compact(session, path) == 1

    path = _ingested(spark, sf, fold)
    ingest.compact(spark, path)
    ingest.expire(spark, path, keep=1)
    return _state(spark, path)


@query(
    "stream_pending",
    with_tables(["assets", "capabilities"], f"select a.id from assets a where {pending_sql('deep')}"),
)
def stream_pending(spark, sf):
    stream = as_stream(spark, M.assets(spark, sf), "arriving", "id")
    path = scratch_path(spark, "pending")
    work = M.stored(spark, sf, "work", lambda s, d: completed_work(M.capabilities(s, d)))
    pending = views.stream_pending(stream, work, "deep")
    finish(views.append_to(pending, path, scratch_path(spark, "pending-checkpoint")))
    return spark.read.parquet(path).select("id")


@query(
    "stream_latest",
    "select user_id, event_id, event_type, value from events"
    " qualify row_number() over (partition by user_id order by event_id desc) = 1",
)
def stream_latest(spark, sf):
    events = M.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    path = scratch_path(spark, "latest")
    latest = views.stream_latest(as_stream(spark, events, "updates", "event_id"), "user_id", "event_id")
    finish(views.updates_to(latest, path, scratch_path(spark, "latest-checkpoint")))
    return latest_by_key(spark.read.parquet(path), "user_id", "batch_id").drop("batch_id")


@query(
    "stream_latest_folded",
    "select user_id, event_id, event_type, value from events"
    " qualify row_number() over (partition by user_id order by event_id desc) = 1",
)
def stream_latest_folded(spark, sf):
    """The same with the deltas folded every second batch: one snapshot and the last deltas are read."""
    events = M.table(spark, sf, "events").select("user_id", "event_id", "event_type", "value")
    path = scratch_path(spark, "latest")
    latest = views.stream_latest(as_stream(spark, events, "updates", "event_id"), "user_id", "event_id")
    finish(views.latest_to(latest, path, scratch_path(spark, "latest-checkpoint"), "user_id", fold_every=2))
    return views.read_latest(spark, path, "user_id", latest.schema).select(*events.columns)


KEPT = (
    "k as (select * from fresh where doc_id % 29 <> 0),"
    " ke as (select content_hash, min(id) as representative_id, count(*) as n from k where content_hash is not null group by 1),"
    " kv as (select visual_hash, min(id) as representative_id, count(*) as n from k where visual_hash is not null group by 1),"
    " kb as (select *, ('0x' || visual_hash)::ubigint as h from kv)"
)


@query(
    "stream_clusters",
    with_tables(
        ["fresh"],
        f"+ {KEPT} select 'cluster-exact:' || content_hash as cluster_id, 'exact' as kind, representative_id, n as member_count"
        " from ke where n > 1 union all select 'cluster-visual:android-v2:' || visual_hash, 'visual', representative_id, n"
        " from kv where n > 1 union all select 'cluster-similar:' || a.visual_hash || ':' || b.visual_hash, 'similar',"
        " least(a.representative_id, b.representative_id), a.n + b.n from kb a join kb b"
        " on substr(a.visual_hash, 1, 4) = substr(b.visual_hash, 1, 4) and a.visual_hash < b.visual_hash"
        " where bit_count(xor(a.h, b.h)) <= 8",
    ),
)
def stream_clusters(spark, sf):
    """Clusters kept over several batches, after which some assets are deleted and some come again unchanged."""
    fresh = M.fresh(spark, sf)
    doc_id = F.split("id", ":")[1].cast("bigint") - 1
    rows = fresh.select("id", "content_hash", "visual_hash", F.lit(False).alias("gone"), F.lit(1).cast("bigint").alias("seq"), doc_id.alias("n"))
    path, columns = scratch_path(spark, "clusters"), ["id", "content_hash", "visual_hash", "gone", "seq"]
    finish(cluster_stream.start_clusters(as_stream(spark, rows.select(*columns), "hashes", "id"), path, scratch_path(spark, "clusters-checkpoint")))
    nothing = F.lit(None).cast("string")
    gone = rows.where("n % 29 = 0").withColumns({"content_hash": nothing, "visual_hash": nothing, "gone": F.lit(True)})
    again = rows.where("n % 29 <> 0 and n % 31 = 0")
    last = spark.read.parquet(f"{path}/changes").agg(F.max("batch_id")).first()[0]
    cluster_stream.commit_batch(gone.unionByName(again).select(*columns), path, int(last) + 1)
    return cluster_stream.current_clusters(spark, path)


@query(
    "stream_insights",
    "select count(*) as seen, count_if(event_type = 'error') as failed,"
    " cast(sum(cast(floor(value * 100) as bigint)) as bigint) as total from events",
)
def stream_insights(spark, sf):
    events = M.table(spark, sf, "events").select("event_id", "event_type", "value")
    totals = {
        "seen": F.count(F.lit(1)),
        "failed": F.count_if(F.col("event_type") == "error"),
        "total": known_sum(F.floor(F.col("value") * 100)),
    }
    path = scratch_path(spark, "insights")
    running = views.stream_totals(as_stream(spark, events, "seen", "event_id"), totals)
    checkpoint = scratch_path(spark, "insights-checkpoint")
    finish(views.totals_to(running, path, checkpoint, {"availableNow": True}))
    return read_snapshot(spark, path)


def _analyze(pending: DataFrame, stage: str) -> DataFrame:
    """Results of a stage in which everything succeeds, for assets of both platforms."""
    models = ("'ios-fast-1'", "'android-fast-2'") if stage == "fast" else ("'ios-vision-1'", "'android-heuristic-2'")
    names = M.CAPABILITY_NAMES[:3] if stage == "fast" else M.CAPABILITY_NAMES
    listed = ", ".join(
        f"named_struct('capability_id', '{n}', 'status', 'completed', 'error', cast(null as string))" for n in names
    )
    return pending.selectExpr(
        "id",
        "cast(1 as int) AS analysis_version",
        f"case when id like 'ios:%' then {models[0]} else {models[1]} end AS model_version",
        f"cast({NOW} as bigint) AS analyzed_at",
        f"array({listed}) AS capability_results",
    )


@query(
    "two_stage_run",
    with_tables(
        ["assets", "capabilities"],
        f"+ f as (select a.id from assets a where {pending_sql('fast')}),"
        f" d as (select a.id from assets a where {pending_sql('deep')})"
        " select 'fast' as stage, id from f union all select 'deep', id from (select id from d union select id from f)",
    ),
)
def two_stage(spark, sf):
    def keep(df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(spark, name)
        df.write.parquet(path)
        return spark.read.parquet(path)

    done = two_stage_run(M.assets(spark, sf), M.capabilities(spark, sf), _analyze, keep)
    fast = done["fast"].select(F.lit("fast").alias("stage"), "id")
    return fast.unionByName(done["deep"].select(F.lit("deep").alias("stage"), "id"))
