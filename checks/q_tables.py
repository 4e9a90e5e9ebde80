"""Sources, validation, merges, staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import model as M
from checks.model import NOW, START, asset_id, with_tables
from checks.register import query
from lumenlake import schemas
from lumenlake.operators import insights, jobs, merges, staleness, validation
from lumenlake.sources import listing

ID = asset_id("doc_id")

# --- sources -------------------------------------------------------------------------------


@query(
    "scan_category",
    with_tables(
        ["assets", "content"],
        "select a.id, a.created_at, a.file_size from assets a join content c on c.id = a.id"
        f" where a.media_type = 'photo' and c.is_screenshot and a.created_at < {START + 200 * M.DAY}",
    ),
)
def scan_category(spark, sf):
    flagged = M.assets(spark, sf).join(M.content(spark, sf).select("id", "is_screenshot"), "id")
    picked = listing.select_category(flagged, "screenshots", before=START + 200 * M.DAY)
    return picked.select("id", "created_at", "file_size")


RAW = [
    "event_id AS _id",
    "cast(case when event_type = 'view' then 3 else 1 end as int) AS media_type",
    "case when event_type = 'error' then 0 else {ms} end AS datetaken",
    "{sec} AS date_added",
    "{sec} + user_id AS date_modified",
    "cast(user_id * 10 as bigint) AS width",
    "cast(case when event_type = 'click' then null else user_id * 5 end as bigint) AS height",
    "cast(floor(value * 1000) as bigint) AS duration",
    "cast(floor(value * 100000) as bigint) AS _size",
    "cast(case when user_id < 20 then 1 else 0 end as int) AS is_favorite",
    "cast(case when event_type = 'purchase' and user_id < 50 then 1 else 0 end as int) AS is_trashed",
    "cast(case when event_type = 'signup' and user_id >= 140 then 1 else 0 end as int) AS is_pending",
]
RAW_SPARK = [r.format(ms="unix_millis(ts)", sec="unix_seconds(ts)") for r in RAW]
RAW_SQL = "select " + ", ".join(
    r.format(ms="(epoch_us(ts) // 1000)", sec="(epoch_us(ts) // 1000000)") for r in RAW
) + " from events"


def _raw(spark, sf):
    return M.table(spark, sf, "events").selectExpr(*RAW_SPARK)


@query(
    "normalize_listing",
    f"with raw as ({RAW_SQL}) select 'android:' || _id || case when media_type = 3 then ':v' else ':p' end as id,"
    " case when media_type = 3 then 'video' else 'photo' end as media_type,"
    " case when datetaken > 0 then datetaken else date_added * 1000 end as created_at,"
    " date_modified * 1000 as modified_at, width, coalesce(height, 0) as height, _size as file_size,"
    " case when media_type = 3 then duration / 1000.0::double end as duration, is_favorite = 1 as favorite from raw",
)
def normalize_listing(spark, sf):
    return listing.normalize_listing(_raw(spark, sf))


@query(
    "row_projection",
    "select 'd' || cast(doc_id as string) as id, 'photo' as media_type, n_chars as created_at, cast(null as bigint) as modified_at,"
    " cast(n_chars % 4000 as int) as width, cast(null as int) as height, cast(null as double) as duration,"
    " n_chars * 10 as file_size, lang = 'de' as favorite, cast(null as double) as latitude, cast(null as double) as longitude,"
    " cast(null as bigint) as indexed_at from documents",
)
def row_projection(spark, sf):
    """Stored rows with flags as numbers and without half of the columns."""
    stored = M.table(spark, sf, "documents").selectExpr(
        "n_chars * 10 AS file_size",
        "'d' || cast(doc_id as string) AS id",
        "'photo' AS media_type",
        "cast(n_chars as int) AS created_at",
        "n_chars % 4000 AS width",
        "case when lang = 'de' then 1 else 0 end AS favorite",
        "source AS extra",
    )
    return listing.row_projection(stored)


@query(
    "count_assets",
    f"with raw as ({RAW_SQL}) select count(*) as total from raw"
    " where media_type in (1, 3) and is_trashed = 0 and is_pending = 0",
)
def count_assets(spark, sf):
    return listing.count_assets(_raw(spark, sf))


NAME = (
    "case page_id % 4 when 0 then 'Screenshot_' when 1 then 'screen_shot-' when 2 then 'ScreenXshot-' else 'IMG_' end"
    " || cast(page_id as string)"
)
FOLDER = (
    "case page_id % 5 when 0 then 'Pictures/Screenshots/' when 1 then 'DCIM/MyScreenshot/' else '' end || url"
)


@query(
    "screenshot_by_path",
    f"with p as (select page_id, lower({NAME}) as n, lower({FOLDER}) as f from pages)"
    " select page_id, f like '%screenshots/%' or n like 'screenshot%' or n like 'screen_shot%' as listed,"
    " contains(f, 'screenshot') or starts_with(n, 'screenshot') or starts_with(n, 'screen_shot') as analysed from p",
)
def screenshot_by_path(spark, sf):
    named = M.table(spark, sf, "pages").selectExpr("page_id", f"{NAME} AS name", f"{FOLDER} AS folder")
    name, folder = F.col("name"), F.col("folder")
    return named.select(
        "page_id",
        listing.screenshot_listing_rule(name, folder).alias("listed"),
        listing.screenshot_analysis_rule(name, folder).alias("analysed"),
    )


# --- validation ----------------------------------------------------------------------------

BAD_ASSETS = [
    f"case when lang = 'fr' then '' else {ID} end AS id",
    "case when lang = 'de' then 'audio' when lang = 'es' then 'video' else 'photo' end AS media_type",
    "case when n_chars > 5000 then -1 else n_chars end AS created_at",
    "case when n_chars < 100 then -5 when n_chars < 500 then null else n_chars end AS modified_at",
    "cast(case when n_chars < 1000 then null else 10 end as int) AS width",
    "cast(10 as int) AS height",
    "case when n_chars % 2 = 0 then cast(-0.5 as double) end AS duration",
    "case when source = 'src3' then -1 else n_chars end AS file_size",
]


@query(
    "validate_assets",
    "with a as (select doc_id, " + ", ".join(BAD_ASSETS) + " from documents) select doc_id, concat_ws(',',"
    " case when id = '' then 'id' end, case when media_type not in ('photo', 'video') then 'media_type' end,"
    " case when created_at < 0 then 'created_at' end, case when width is null then 'width' end,"
    " case when modified_at < 0 then 'modified_at' end, case when duration < 0 then 'duration' end,"
    " case when file_size < 0 then 'file_size' end) as reasons from a",
)
def validate_assets(spark, sf):
    rows = M.table(spark, sf, "documents").selectExpr("doc_id", *BAD_ASSETS)
    good, rejects = validation.validate_assets(rows)
    listed = rejects.select("doc_id", F.concat_ws(",", validation.REASONS).alias("reasons"))
    return good.select("doc_id", F.lit("").alias("reasons")).unionByName(listed)


BAD_ANALYSES = [
    f"{asset_id('d.doc_id')} AS id",
    "cast(l.quality as int) AS analysis_version",
    "case when d.source = 'src1' then '' else 'android-fast-2' end AS model_version",
    "d.n_chars - 200 AS analyzed_at",
    "cast(d.n_chars as double) / 4000 AS blur_score",
    "cast(null as double) AS quality_score",
    "cast(d.n_chars - 500 as double) / 40000 AS brightness_score",
    "cast(case when l.toxic = 1 then -1 else 2 end as int) AS face_count",
    "case when d.lang = 'fr' then '' else 'aa' end AS perceptual_hash",
    "case when d.lang = 'es' then '' end AS content_hash",
]


@query(
    "validate_analyses",
    "with a as (select d.doc_id, d.lang, " + ", ".join(BAD_ANALYSES) + " from documents d join labels l"
    " on l.doc_id = d.doc_id) select doc_id, concat_ws(',', case when analysis_version <= 0 then 'analysis_version' end,"
    " case when model_version = '' then 'model_version' end, case when analyzed_at < 0 then 'analyzed_at' end,"
    " case when blur_score not between 0 and 1 then 'blur_score' end,"
    " case when brightness_score not between 0 and 1 then 'brightness_score' end,"
    " case when face_count < 0 then 'face_count' end, case when perceptual_hash = '' then 'perceptual_hash' end,"
    " case when content_hash = '' then 'content_hash' end, case when lang = 'de' then 'result_count' end,"
    " case when lang = 'fr' then 'result_content' end) as reasons from a",
)
def validate_analyses(spark, sf):
    results = (
        "transform(sequence(1, case when d.lang = 'de' then 16 else 5 end), i -> named_struct("
        "'capability_id', case when d.lang = 'fr' then 'Bad Name' else 'text.ocr' end,"
        " 'status', 'completed', 'error', cast(null as string))) AS capability_results"
    )
    documents = M.table(spark, sf, "documents").alias("d")
    labels = M.table(spark, sf, "labels").alias("l")
    joined = documents.join(labels, F.col("d.doc_id") == F.col("l.doc_id"))
    rows = joined.selectExpr("d.doc_id", *BAD_ANALYSES, results)
    return validation.with_reasons(rows, validation.analysis_rules()).select(
        "doc_id", F.concat_ws(",", validation.REASONS).alias("reasons")
    )


@query(
    "duplicate_keys",
    "select user_id, event_type, count(*) as occurrences from events group by all having count(*) > 1",
)
def duplicate_keys(spark, sf):
    return validation.find_duplicate_keys(M.table(spark, sf, "events"), ["user_id", "event_type"])


BATCH = {
    "asset_count": "count(*)",
    "analysis_count": "count_if(event_type = 'purchase')",
    "processed": "min(k) - 1",
    "total": "max(k)",
    "progress": "sum(value) / 5000",
    "cursor": "min(case when user_id % 2 = 0 then '' else event_type end)",
}
BATCH_SQL = ", ".join(f"{v} as {k}" for k, v in BATCH.items())


@query(
    "validate_batches",
    "with e as (select *, json_extract_string(props, '$.k')::bigint as k from events),"
    f" b as (select 'job-' || user_id as job_id, {BATCH_SQL} from e group by user_id)"
    " select job_id, concat_ws(',', case when asset_count > 200 then 'assets' end,"
    " case when analysis_count > 200 then 'analyses' end, case when processed < 0 then 'processed' end,"
    " case when total < 0 then 'total' end, case when progress not between 0 and 1 then 'progress' end,"
    " case when cursor = '' then 'cursor' end) as reasons from b",
)
def validate_batches(spark, sf):
    events = M.table(spark, sf, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    batches = events.groupBy("user_id").agg(*[F.expr(v).alias(k) for k, v in BATCH.items()])
    named = batches.withColumn("job_id", F.concat(F.lit("job-"), F.col("user_id").cast("string")))
    return validation.with_reasons(named, validation.batch_rules()).select(
        "job_id", F.concat_ws(",", validation.REASONS).alias("reasons")
    )


# --- merges --------------------------------------------------------------------------------

# Updates of a document: one without a label, three with one; later ones clear values.
UPDATE_ROWS = (
    "select d.*, s.seq from {documents} d left join {labels} l on l.doc_id = d.doc_id, {numbers}"
    " where s.seq <= case when l.doc_id is null then 1 else 3 end"
)
UPDATES_SQL = UPDATE_ROWS.format(
    documents="documents", labels="labels", numbers="(values (1), (2), (3)) s(seq)"
)
NEW_ASSET = [
    f"{ID} AS id",
    "'photo' AS media_type",
    "n_chars + seq AS created_at",
    "case when seq = 2 then null else n_chars * seq end AS modified_at",
    "case when seq = 3 and lang = 'en' then null else n_chars + seq end AS file_size",
    "lang = 'de' AS favorite",
    "cast(seq as bigint) AS seq",
]
MERGED_ASSET = ["id", "media_type", "created_at", "modified_at", "file_size", "favorite"]


def _updates(spark, sf):
    documents = M.table(spark, sf, "documents")
    labels = M.table(spark, sf, "labels").select("doc_id", F.lit(3).alias("n"))
    copies = F.sequence(F.lit(1), F.coalesce("n", F.lit(1)))
    return documents.join(labels, "doc_id", "left").withColumn("seq", F.explode(copies)).drop("n")


@query(
    "upsert_assets",
    with_tables(
        ["assets", "page_assets"],
        f"+ u as (select {', '.join(NEW_ASSET)} from ({UPDATES_SQL})),"
        " last as (select * from u qualify row_number() over (partition by id order by seq desc) = 1)"
        f" select {', '.join(MERGED_ASSET)} from last union all select {', '.join(MERGED_ASSET)} from page_assets",
    ),
)
def upsert_assets(spark, sf):
    base = M.assets(spark, sf).unionByName(M.page_assets(spark, sf)).select(*MERGED_ASSET)
    return merges.upsert_latest(base, _updates(spark, sf).selectExpr(*NEW_ASSET), "id", "seq")


SIGNAL_UPDATES = {
    "quality": [
        "case when seq = 2 then null else cast(n_chars % 100 as double) / 100 end AS blur_score",
        "case when seq = 3 then cast(n_chars % 90 as double) / 100 end AS quality_score",
        "case when seq = 1 and lang = 'en' then cast(0.5 as double) end AS brightness_score",
        "cast(null as int) AS face_count",
    ],
    "content": [
        "case when seq = 1 then lang = 'en' end AS is_screenshot",
        "case when seq = 2 then lang = 'fr' end AS is_document",
        "case when seq = 3 and lang = 'de' then true end AS is_meme",
    ],
    "hashes": [
        "case when seq = 1 then cast(n_chars as string) end AS perceptual_hash",
        "case when seq = 3 then source end AS content_hash",
    ],
}
UPDATE_VERSIONS = [
    "cast(seq as int) AS analysis_version",
    "case when seq = 2 then null else 'm' || cast(seq as string) end AS model_version",
    f"{NOW} + seq AS analyzed_at",
]


def _merge_sql(name: str, signals: list[str], rank_by: str = "seq") -> str:
    updates = ", ".join([f"{ID} AS id", *SIGNAL_UPDATES[name], *UPDATE_VERSIONS])
    some = " or ".join(f"{s} is not null" for s in signals)
    kept = ", ".join(
        f"coalesce((select arg_max(u.{s}, u.{rank_by}) from u where u.id = k.id and u.{s} is not null), b.{s}) as {s}"
        for s in signals
    )
    versions = ", ".join(
        f"case when l.id is null then b.{v} else l.{v} end as {v}"
        for v in ("analysis_version", "model_version", "analyzed_at")
    )
    body = (
        f"+ u as (select cast(seq as bigint) as seq, {updates} from ({UPDATES_SQL})),"
        f" t as (select * from u where {some}),"
        " l as (select * from t qualify row_number() over (partition by id order by seq desc) = 1),"
        f" k as (select id from {name} union select id from t)"
        f" select k.id, {kept}, {versions} from k left join {name} b on b.id = k.id left join l on l.id = k.id"
    )
    return with_tables([name], body)


def _signal_updates(spark, sf, name):
    exprs = [f"{ID} AS id", "cast(seq as bigint) AS seq", *SIGNAL_UPDATES[name], *UPDATE_VERSIONS]
    return _updates(spark, sf).selectExpr(*exprs)


QUALITY = ["blur_score", "quality_score", "brightness_score", "face_count"]


@query("merge_quality", _merge_sql("quality", QUALITY))
def merge_quality(spark, sf):
    return merges.merge_quality(M.quality(spark, sf), _signal_updates(spark, sf, "quality"))


@query("merge_content", _merge_sql("content", ["is_screenshot", "is_document", "is_meme"]))
def merge_content(spark, sf):
    return merges.merge_content(M.content(spark, sf), _signal_updates(spark, sf, "content"))


@query("merge_hashes", _merge_sql("hashes", ["perceptual_hash", "content_hash"]))
def merge_hashes(spark, sf):
    return merges.merge_hashes(M.hashes(spark, sf), _signal_updates(spark, sf, "hashes"))


@query(
    "merge_text",
    with_tables(
        ["texts"],
        f"+ u as (select {ID} AS id, seq, case when seq = 3 and lang <> 'en' then text || ' again' end as t,"
        f" seq = 2 and lang = 'fr' as done from ({UPDATES_SQL})),"
        " l as (select * from u where t is not null or done qualify row_number() over (partition by id order by seq desc) = 1)"
        " select b.id, case when l.id is null then b.ocr_text else coalesce(l.t, '') end as ocr_text,"
        " case when l.id is null then b.analyzed_at else 7 end as analyzed_at"
        " from texts b left join l on l.id = b.id",
    ),
)
def merge_text(spark, sf):
    results = (
        "array(named_struct('capability_id', 'text.ocr', 'status',"
        " case when seq = 2 and lang = 'fr' then 'completed' else 'failed' end, 'error', cast(null as string)))"
    )
    analyses = _updates(spark, sf).selectExpr(
        f"{ID} AS id",
        "cast(seq as bigint) AS seq",
        "case when seq = 3 and lang <> 'en' then text || ' again' end AS ocr_text",
        "cast(1 as int) AS analysis_version",
        "'m' AS model_version",
        "7L AS analyzed_at",
        f"{results} AS capability_results",
    )
    return merges.merge_text(M.texts(spark, sf), analyses).select("id", "ocr_text", "analyzed_at")


@query(
    "capability_status",
    "select 'user-' || user_id as id, 'stage.' || event_type as capability_id,"
    " case when value < 20 then 'failed' else 'completed' end as status, cast(1 as int) as analysis_version,"
    " 'm' as model_version, event_id as analyzed_at, case when value < 20 then 'LOW' end as error from events"
    " qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1",
)
def capability_status(spark, sf):
    analyses = M.table(spark, sf, "events").selectExpr(
        "'user-' || user_id AS id",
        "cast(1 as int) AS analysis_version",
        "'m' AS model_version",
        "event_id AS analyzed_at",
        "event_id AS seq",
        "array(named_struct('capability_id', 'stage.' || event_type,"
        " 'status', case when value < 20 then 'failed' else 'completed' end,"
        " 'error', case when value < 20 then 'LOW' end)) AS capability_results",
    )
    base = spark.createDataFrame([], schemas.CAPABILITIES)
    return merges.upsert_capability_status(base, analyses)


WIDE_SIGNALS = [
    *M.VERSIONS,
    "case when lang = 'en' then cast(n_chars % 100 as double) / 100 end AS blur_score",
    "case when lang = 'fr' then cast(0.25 as double) end AS quality_score",
    "cast(null as double) AS brightness_score",
    "case when lang = 'de' then text end AS ocr_text",
    "cast(null as boolean) AS is_screenshot",
    "cast(null as boolean) AS is_document",
    "cast(null as boolean) AS is_meme",
    "cast(null as string) AS perceptual_hash",
    "cast(null as string) AS content_hash",
]


def _split(spark, sf):
    return merges.split_wide_signals(M.table(spark, sf, "documents").selectExpr(M.ID, *WIDE_SIGNALS))


@query(
    "split_quality",
    f"with w as (select {M.ID}, {', '.join(WIDE_SIGNALS)} from documents) select id, blur_score, quality_score,"
    " brightness_score, analyzed_at from w where blur_score is not null or quality_score is not null"
    " or brightness_score is not null",
)
def split_quality(spark, sf):
    return _split(spark, sf)["quality"].drop("analysis_version", "model_version")


@query(
    "split_text",
    f"with w as (select {M.ID}, {', '.join(WIDE_SIGNALS)} from documents)"
    " select id, ocr_text from w where ocr_text is not null",
)
def split_text(spark, sf):
    return _split(spark, sf)["texts"].select("id", "ocr_text")


@query(
    "reconcile_snapshot",
    with_tables(["assets"], f"select id, indexed_at from assets where indexed_at >= {NOW + 1000}"),
)
def reconcile_snapshot(spark, sf):
    return merges.reconcile_snapshot(M.assets(spark, sf), NOW + 1000).select("id", "indexed_at")


@query(
    "classify_changes",
    with_tables(
        ["assets", "page_assets", "benchmark_assets"],
        "+ o as (select id, modified_at from assets union all select id, modified_at from benchmark_assets),"
        " n as (select id, case when file_size > 100000000 then coalesce(modified_at, 0) + 1 else modified_at end"
        " as modified_at from assets union all select id, modified_at from page_assets)"
        " select coalesce(o.id, n.id) as id, case when o.id is null then 'new' when n.id is null then 'deleted'"
        " when o.modified_at is not distinct from n.modified_at then 'unchanged' else 'changed' end as change"
        " from o full join n on n.id = o.id",
    ),
)
def classify_changes(spark, sf):
    assets = M.assets(spark, sf)
    bumped = F.when(F.col("file_size") > 100000000, F.coalesce("modified_at", F.lit(0)) + 1)
    new = assets.withColumn("modified_at", bumped.otherwise(F.col("modified_at")))
    return merges.classify_changes(
        assets.unionByName(M.benchmark_assets(spark, sf)), new.unionByName(M.page_assets(spark, sf))
    )


@query(
    "delete_cascade",
    with_tables(
        ["assets", "quality", "content", "texts"],
        "+ gone as (select id from content where is_document)"
        " select 'assets' as tbl, id, cast(null as string) as ref from assets where id not in (select id from gone)"
        " union all select 'quality', id, null from quality where id not in (select id from gone)"
        " union all select 'content', id, null from content where id not in (select id from gone)"
        " union all select 'clusters', 'c-' || id, case when id in (select id from gone) then null else id end from assets",
    ),
)
def delete_cascade(spark, sf):
    assets = M.assets(spark, sf)
    content = M.content(spark, sf)
    clusters = assets.select(F.concat(F.lit("c-"), "id").alias("cluster_id"), F.col("id").alias("representative_id"))
    kept = merges.delete_cascade(
        content.where("is_document"),
        {"assets": assets, "quality": M.quality(spark, sf), "content": content, "clusters": clusters},
        set_null={"clusters": "representative_id"},
    )
    nothing = F.lit(None).cast("string")
    parts = [
        kept[name].select(F.lit(name).alias("tbl"), "id", nothing.alias("ref"))
        for name in ("assets", "quality", "content")
    ]
    cleared = kept["clusters"].select(
        F.lit("clusters").alias("tbl"), F.col("cluster_id").alias("id"), F.col("representative_id").alias("ref")
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(cleared)


# --- staleness -----------------------------------------------------------------------------


def pending_sql(stage: str) -> str:
    names = M.CAPABILITY_NAMES[:3] if stage == "fast" else M.CAPABILITY_NAMES
    listed = ", ".join(f"'{n}'" for n in names)
    ios = "'ios-vision-1', 'ios-fast-1'" if stage == "fast" else "'ios-vision-1'"
    android = "'android-heuristic-2', 'android-fast-2'" if stage == "fast" else "'android-heuristic-2'"
    return (
        f"(select count(*) from capabilities c where c.id = a.id and c.capability_id in ({listed})"
        " and c.status = 'completed' and c.analysis_version = 1"
        f" and case when lower(a.id) like 'ios:%' then c.model_version in ({ios}) else c.model_version in ({android}) end"
        f" and c.analyzed_at >= coalesce(a.modified_at, 0)) < {len(names)}"
    )


@query(
    "pending_fast",
    with_tables(["assets", "capabilities"], f"select a.id from assets a where {pending_sql('fast')}"),
)
def pending_fast(spark, sf):
    return staleness.pending_assets(M.assets(spark, sf), M.capabilities(spark, sf), "fast").select("id")


@query(
    "pending_deep",
    with_tables(["assets", "capabilities"], f"select a.id from assets a where {pending_sql('deep')}"),
)
def pending_deep(spark, sf):
    return staleness.pending_assets(M.assets(spark, sf), M.capabilities(spark, sf), "deep").select("id")


CACHE = [
    "event_id",
    "case when event_type in ('click', 'view') then 'limited' else 'authorized' end AS stored",
    "case when event_type = 'click' then 'limited' else 'authorized' end AS scope",
]


@query(
    "cache_valid",
    f"with e as (select {', '.join(CACHE)}, epoch_us(ts) // 1000 as done, {START} + 10 * {M.DAY} as now from events)"
    " select event_id, stored = 'authorized' and scope = 'authorized' and now >= done and now - done < 21600000"
    " as valid from e",
)
def cache_valid(spark, sf):
    events = M.table(spark, sf, "events").selectExpr(*CACHE, "unix_millis(ts) AS done")
    valid = staleness.cache_valid(
        F.col("done"), F.col("stored"), F.col("scope"), F.lit(START + 10 * M.DAY)
    )
    return events.select("event_id", valid.alias("valid"))


@query(
    "latest_by_key",
    "select user_id, event_id, event_type, value from events"
    " qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
)
def latest_by_key(spark, sf):
    events = M.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return merges.latest_by_key(events, "user_id", ["ts", "event_id"]).drop("ts")


@query(
    "feedback_existing",
    "select 'f' || e.event_id as fact, e.event_id from events e where exists"
    " (select 1 from labels l where l.doc_id = e.event_id)",
)
def feedback_existing(spark, sf):
    facts = M.table(spark, sf, "events").selectExpr("'f' || event_id AS fact", "event_id")
    known = M.table(spark, sf, "labels").select(F.col("doc_id").alias("event_id"))
    return merges.append_if_exists(facts, known, "event_id")


@query(
    "cleanup_summary",
    "select o_custkey as run_id, case o_orderstatus when 'F' then 'trashed' when 'O' then 'cancelled' else 'failed' end"
    " as outcome, count(*) as asset_count, cast(coalesce(sum(case when o_orderpriority = '5-LOW' then null else"
    " cast(floor(o_totalprice) as bigint) end), 0) as bigint) as recovered_bytes from orders group by all",
)
def cleanup_summary(spark, sf):
    removed = M.table(spark, sf, "orders").selectExpr(
        "o_custkey AS run_id",
        "case o_orderstatus when 'F' then 'trashed' when 'O' then 'cancelled' else 'failed' end AS outcome",
        "case when o_orderpriority = '5-LOW' then null else cast(floor(o_totalprice) as bigint) end AS file_size",
    )
    return insights.cleanup_summary(removed, ["run_id", "outcome"])


JOB = [
    "'job-' || user_id AS job_id",
    "cast(floor(value) as bigint) AS processed",
    "cast(case when event_type = 'error' then 0 else user_id end as bigint) AS total",
    "event_type AS status",
    "event_id AS updated_at",
]


@query(
    "job_progress",
    f"with j as (select {', '.join(JOB)} from events),"
    " l as (select * from j qualify row_number() over (partition by job_id order by updated_at desc) = 1)"
    " select job_id, processed, total, status, updated_at, cast(case when total > 0 then"
    " round(least(total, greatest(0, processed)) * 100.0 / total) else 0 end as int) as percent from l",
)
def job_progress(spark, sf):
    return jobs.job_progress(M.table(spark, sf, "events").selectExpr(*JOB))
