"""The signals of one analysis stage and their per-capability results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import ANALYSIS_VERSION, DEEP_MODEL, FAST_MODEL, STAGES
from lumenlake.functions.hashing import average_hash
from lumenlake.functions.signals import blur_score, brightness_score, quality_score
from lumenlake.schemas import CAPABILITY_RESULT
from lumenlake.sources.images import FINE
from lumenlake.sources.listing import screenshot_analysis_rule

# fixed values: error codes per failed capability
NO_PIXELS = "THUMBNAIL_UNAVAILABLE"
ERRORS = {
    "quality.visual": "QUALITY_FAILED",
    "similarity.perceptual": "VISUAL_HASH_FAILED",
    "content.screenshot": "SCREENSHOT_FAILED",
    "duplicate.exact": "CONTENT_HASH_FAILED",
    "text.ocr": "OCR_FAILED",
}
NOT_PROCESSED = "NOT_PROCESSED"


def capability_results(
    stage: str,
    video: Column,
    has_pixels: Column,
    blur: Column,
    visual_hash: Column,
    screenshot: Column,
    content_hash: Column,
    text_done: Column,
) -> Column:
    """Result list of a stage, in stage order; one failure never touches the others.

    A video has no text and no content hash but counts as done; text needs pixels.
    """
    failure = {
        "quality.visual": F.when(~has_pixels, NO_PIXELS).when(blur.isNull(), ERRORS["quality.visual"]),
        "similarity.perceptual": F.when(~has_pixels, NO_PIXELS).when(
            visual_hash.isNull(), ERRORS["similarity.perceptual"]
        ),
        "content.screenshot": F.when(screenshot.isNull(), ERRORS["content.screenshot"]),
        "duplicate.exact": F.when(~video & content_hash.isNull(), ERRORS["duplicate.exact"]),
        "text.ocr": F.when(~has_pixels, NOT_PROCESSED).when(
            ~video & ~F.coalesce(text_done, F.lit(False)), ERRORS["text.ocr"]
        ),
    }
    entries = [
        F.struct(
            F.lit(name).alias("capability_id"),
            F.when(failure[name].isNull(), "completed").otherwise("failed").alias("status"),
            failure[name].alias("error"),
        )
        for name in STAGES[stage]
    ]
    return F.array(*entries).cast(f"array<{CAPABILITY_RESULT}>")


def analyze_assets(
    df: DataFrame, stage: str, analyzed_at: Column, platform: str = "android", max_chars: int | None = None
) -> DataFrame:
    """Analyses of a stage from (id, media_type, name, folder, grids[, content_hash, ocr_text, text_done]).

    ``grids`` comes from ``luma_grids``; extracted text is an input, kept whole
    unless ``max_chars`` says where to cut it. Everything
    after the grids is built-in expressions in one pass without a shuffle.
    """
    deep = stage == "deep"
    video = F.col("media_type") == "video"
    pixels = F.col("grids.fine").isNotNull()
    nothing = F.lit(None)
    measured = df.withColumns(
        {
            "blur_score": blur_score(F.col("grids.fine"), FINE),
            "brightness_score": F.when(pixels, brightness_score(F.col("grids.fine"))),
            "perceptual_hash": average_hash(F.col("grids.coarse")),
            "is_screenshot": screenshot_analysis_rule(F.col("name"), F.col("folder")),
            "content_hash": F.when(~video, F.col("content_hash")) if deep else nothing.cast("string"),
        }
    )
    text = nothing
    if deep:
        text = F.col("ocr_text") if max_chars is None else F.substring("ocr_text", 1, max_chars)
    readable = ~video & pixels & (F.length(F.trim(text)) > 0) if deep else F.lit(False)
    results = capability_results(
        stage,
        video,
        pixels,
        F.col("blur_score"),
        F.col("perceptual_hash"),
        F.col("is_screenshot"),
        F.col("content_hash"),
        F.col("text_done") if deep else F.lit(True),
    )
    model = (DEEP_MODEL if deep else FAST_MODEL)[platform]
    return measured.select(
        "id",
        F.lit(ANALYSIS_VERSION).alias("analysis_version"),
        F.lit(model).alias("model_version"),
        analyzed_at.alias("analyzed_at"),
        "blur_score",
        quality_score(F.col("blur_score")).alias("quality_score"),
        "brightness_score",
        nothing.cast("int").alias("face_count"),
        F.when(readable, text).cast("string").alias("ocr_text"),
        "is_screenshot",
        nothing.cast("boolean").alias("is_document"),
        nothing.cast("boolean").alias("is_meme"),
        "perceptual_hash",
        "content_hash",
        results.alias("capability_results"),
    )
