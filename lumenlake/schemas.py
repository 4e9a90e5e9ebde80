"""Table schemas of the catalog, as DDL text (what ``read.schema`` and ``createDataFrame`` take)."""

ASSETS = (
    "id string, media_type string, created_at bigint, modified_at bigint, width int, height int,"
    " duration double, file_size bigint, favorite boolean, latitude double, longitude double,"
    " indexed_at bigint"
)
CAPABILITY_RESULT = "struct<capability_id:string,status:string,error:string>"
ANALYSES = (
    "id string, analysis_version int, model_version string, analyzed_at bigint, blur_score double,"
    " quality_score double, brightness_score double, face_count int, ocr_text string,"
    " is_screenshot boolean, is_document boolean, is_meme boolean, perceptual_hash string,"
    f" content_hash string, capability_results array<{CAPABILITY_RESULT}>"
)
CAPABILITIES = (
    "id string, capability_id string, status string, analysis_version int, model_version string,"
    " analyzed_at bigint, error string"
)
_VERSION = "analysis_version int, model_version string, analyzed_at bigint"
QUALITY = (
    "id string, blur_score double, quality_score double, brightness_score double, face_count int, "
    + _VERSION
)
CONTENT = ("id string, is_screenshot boolean, is_document boolean, is_meme boolean, " + _VERSION)
HASHES = ("id string, perceptual_hash string, content_hash string, " + _VERSION)
TEXTS = ("id string, ocr_text string, " + _VERSION)
SELECTIONS = (
    "selection_id string, name string, spec string, created_at bigint, updated_at bigint, context string"
)

# fixed values: the columns each signal table merges
QUALITY_SIGNALS = ("blur_score", "quality_score", "brightness_score", "face_count")
CONTENT_SIGNALS = ("is_screenshot", "is_document", "is_meme")
HASH_SIGNALS = ("perceptual_hash", "content_hash")
VERSION_COLUMNS = ("analysis_version", "model_version", "analyzed_at")


def column_types(schema: str) -> dict[str, str]:
    """Column names and types of a DDL schema."""
    found, depth, start = {}, 0, 0
    for i, char in enumerate(schema + ","):
        depth += (char in "<(") - (char in ">)")
        if char == "," and depth == 0:
            name, kind = schema[start:i].split(maxsplit=1)
            found[name] = kind
            start = i + 1
    return found


def columns(schema: str) -> list[str]:
    return list(column_types(schema))
