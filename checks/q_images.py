"""Images from files to signal tables: the files are written from the vectors of ``embeddings``."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import model as M
from checks.q_clusters import GRID, GRID_SPARK, _average_sql
from checks.register import query
from lumenlake import schemas
from lumenlake.plans.image_run import analyze_stage, folded
from lumenlake.session import scratch_path
from lumenlake.sources.images import read_images
from lumenlake.sources.pending_images import store

HEADER = b"P5\n32 32\n255\n"
BROKEN, MISSING, VIDEO, SHOT = "vec_id % 13 = 0", "vec_id % 17 = 0", "vec_id % 10 = 3", "vec_id % 7 = 0"
# every pixel of the 8x8 grid is a block of four by four
BIG = "list_transform(range(1024), lambda i: g[(i // 128) * 8 + (i % 32) // 4 + 1])"
EDGE = (
    "list_sum(list_transform(list_filter(range(1024), lambda i: i // 32 between 1 and 30 and i % 32 between 1 and 30),"
    " lambda i: abs(4 * b[i + 1] - b[i] - b[i + 2] - b[i - 31] - b[i + 33])))"
)
BYTES = f"unhex('{HEADER.hex()}' || list_aggregate(list_transform(b, lambda p: printf('%02x', p)), 'string_agg', ''))"
SIGNALS = (
    f"g as (select vec_id, {GRID} as g from embeddings), big as (select vec_id, g, {BIG} as b from g),"
    f" raw as (select *, {BYTES} as bytes, list_sum(g)::double / 64 as m, g as v, {BROKEN} as broken, {MISSING} as missing,"
    f" {VIDEO} as video from big),"
    " s as (select vec_id, broken, missing, video, not (broken or missing) as pixels,"
    f" case when pixels then round(1 - least(1.0::double, {EDGE}::double / 900 / 80), 6) end as blur_score,"
    " case when pixels then round(1 - least(1.0::double, abs(m / 255 - 0.5) * 2), 6) end as brightness_score,"
    f" case when pixels then {_average_sql()} end as perceptual_hash, {SHOT} as is_screenshot,"
    " case when not missing and not video then sha256(case when broken then unhex(left(hex(bytes), 200)) else bytes end)"
    " end as content_hash from raw)"
)
SHOWN = "vec_id, blur_score, brightness_score, perceptual_hash, is_screenshot"
ASSETS = [
    "'android:' || cast(vec_id as string) || ':p' AS id",
    f"case when {VIDEO} then 'video' else 'photo' end AS media_type",
    "cast(1000 + vec_id as bigint) AS created_at",
    "cast(null as bigint) AS modified_at",
    f"case when {SHOT} then 'Screenshot_1.pgm' else 'IMG_1.pgm' end AS name",
    "'DCIM/Camera' AS folder",
    "vec_id",
]


class _WriteFiles:
    """Write the picture of each vector; some are cut short, some are not written."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = store(self.folder)
        files.create_dir(folder)
        for batch in batches:
            for vec_id, grid in zip(batch.column("vec_id").to_pylist(), batch.column("g").to_pylist()):
                pixels = np.array(grid, np.uint8).reshape(8, 8).repeat(4, axis=0).repeat(4, axis=1)
                content = HEADER + pixels.tobytes()
                if vec_id % 17:
                    with files.open_output_stream(f"{folder}/{vec_id}.pgm") as stream:
                        stream.write(content if vec_id % 13 else content[:100])
            yield batch.select(["vec_id"])


def _files(spark, sf) -> str:
    """A folder with the files, written once a session."""

    def build(s, d) -> DataFrame:
        vectors = M.table(s, d, "embeddings").selectExpr("vec_id", f"{GRID_SPARK} AS g")
        folder = scratch_path(s, "images")
        return vectors.mapInArrow(_WriteFiles(folder), "vec_id long").select("vec_id", F.lit(folder).alias("folder"))

    found = M.stored(spark, sf, "image_files", build).select("folder").first()
    return found[0] if found else scratch_path(spark, "images")


def _assets(spark, sf) -> DataFrame:
    path = F.concat(F.lit(_files(spark, sf) + "/"), F.col("vec_id").cast("string"), F.lit(".pgm"))
    return M.table(spark, sf, "embeddings").selectExpr(*ASSETS).withColumn("path", path)


def _tables(spark) -> dict[str, DataFrame]:
    kinds = {
        "quality": schemas.QUALITY, "content": schemas.CONTENT, "hashes": schemas.HASHES,
        "texts": schemas.TEXTS, "capabilities": schemas.CAPABILITIES,
    }
    return {name: spark.createDataFrame([], kind) for name, kind in kinds.items()}


def _texts(spark, sf) -> DataFrame:
    """Extracted text: every third asset has none, as if the recogniser had failed."""
    rows = M.table(spark, sf, "embeddings").where("vec_id % 3 <> 0")
    return rows.selectExpr(ASSETS[0], "'label ' || cast(label as string) AS ocr_text", "true AS text_done")


def _shown(assets: DataFrame, state: dict[str, DataFrame]) -> DataFrame:
    joined = (
        assets.select("id", "vec_id")
        .join(state["quality"].select("id", "blur_score", "brightness_score"), "id", "left")
        .join(state["hashes"].select("id", "perceptual_hash", "content_hash"), "id", "left")
        .join(state["content"].select("id", "is_screenshot"), "id", "left")
        .join(state["texts"].select("id", "ocr_text"), "id", "left")
    )
    status = state["capabilities"].groupBy("id").pivot("capability_id", list(M.CAPABILITY_NAMES))
    listed = status.agg(F.first(F.concat_ws(" ", "status", "error"))).withColumnsRenamed(
        {n: n.replace(".", "_") for n in M.CAPABILITY_NAMES}
    )
    rounded = {c: F.round(c, 6) for c in ("blur_score", "brightness_score")}
    return joined.join(listed, "id", "left").drop("id").withColumns(rounded)


FAST_STATUS = (
    "'completed' as content_screenshot, case when pixels then 'completed' else 'failed THUMBNAIL_UNAVAILABLE' end as quality_visual,"
    " case when pixels then 'completed' else 'failed THUMBNAIL_UNAVAILABLE' end as similarity_perceptual"
)


@query(
    "analyze_stage",
    f"with {SIGNALS} select {SHOWN}, {FAST_STATUS} from s",
)
def analyze(spark, sf):
    """The fast stage over all files: broken and missing ones fail by themselves."""
    assets, folder = _assets(spark, sf), scratch_path(spark, "analyses")
    analyze_stage(assets, _tables(spark)["capabilities"], folder, "fast", F.lit(M.NOW).cast("bigint"), slice_rows=64)
    state = folded(spark, _tables(spark), folder)
    return _shown(assets, state).drop("content_hash", "ocr_text", "duplicate_exact", "text_ocr")


@query(
    "two_stage_resume",
    f"with {SIGNALS} select {SHOWN}, content_hash, {FAST_STATUS},"
    " case when video or not missing then 'completed' else 'failed CONTENT_HASH_FAILED' end as duplicate_exact,"
    " case when not pixels then 'failed NOT_PROCESSED' when video or vec_id % 3 <> 0 then 'completed'"
    " else 'failed OCR_FAILED' end as text_ocr,"
    " case when not pixels or (vec_id % 3 = 0 and not video) then null when video or vec_id % 3 = 0 then ''"
    " else 'label ' || label::varchar end as ocr_text from s join embeddings using (vec_id)",
)
def two_stage_resume(spark, sf):
    """Both stages, each stopped after its first round and run again: what is left is done, what is done stays."""
    assets, folder = _assets(spark, sf), scratch_path(spark, "analyses")
    none = _tables(spark)["capabilities"]
    rows = max(1, assets.count() // 3)
    for stage in ("fast", "deep"):
        for stop in (lambda done: done == 1, None):
            analyze_stage(assets, none, folder, stage, F.lit(M.NOW).cast("bigint"), _texts(spark, sf), rows, 64, stop)
    return _shown(assets, folded(spark, _tables(spark), folder))


@query(
    "image_hashes",
    f"with {SIGNALS} select vec_id, broken, sha256(case when broken then unhex(left(hex(bytes), 200)) else bytes end)"
    " as content_hash from raw where not missing",
)
def image_hashes(spark, sf):
    """Every file as Spark's own sources read it; portable maps are not decoded by these, bytes are."""
    found = read_images(spark, _files(spark, sf), "*.pgm")
    vec_id = F.regexp_extract("path", r"(\d+)\.pgm$", 1).cast("long").alias("vec_id")
    return found.select(vec_id, (F.col("length") == 100).alias("broken"), "content_hash")
