"""Names, thresholds and limits that results depend on."""

# fixed values: capability names per analysis stage
FAST_CAPABILITIES = ("content.screenshot", "quality.visual", "similarity.perceptual")
DEEP_CAPABILITIES = FAST_CAPABILITIES + ("duplicate.exact", "text.ocr")
STAGES = {"fast": FAST_CAPABILITIES, "deep": DEEP_CAPABILITIES}

# fixed values: accepted model generations. A deep model also satisfies the fast stage.
IOS_PATTERN = "ios:%"
DEEP_MODEL = {"ios": "ios-vision-1", "android": "android-heuristic-2"}
FAST_MODEL = {"ios": "ios-fast-1", "android": "android-fast-2"}
ANALYSIS_VERSION = 1
VISUAL_MODELS = ("android-fast-2", "android-heuristic-2")
VISUAL_GENERATION = "android-v2:"

# fixed values: thresholds
BLURRY_FROM = 0.55
LARGE_VIDEO_FROM = 524288000
NEAR_DISTANCE = 8
HASH_BITS = 64
BUCKET_DIGITS = 4
CACHE_TTL_MS = 6 * 60 * 60 * 1000
MAX_PAGE = 200
MAX_BATCH = 200
MAX_RESULTS_PER_ANALYSIS = 15
MAX_TEXT_CHARS = 10000
SPEC_MAX_NODES, SPEC_MAX_DEPTH, SPEC_MAX_CHILDREN = 256, 24, 64
LOG_LENGTH = 32
CAPABILITY_PATTERN = r"^[a-z][a-z0-9]*(\.[a-z][a-z0-9-]*)+$"
MEDIA_TYPES = ("photo", "video")
CATEGORIES = ("all", "photos", "videos", "screenshots", "favorites")

# fixed values: capability catalog, (id, cost, execution status in search)
CAPABILITY_CATALOG = (
    ("metadata.core", "cheap", "available"),
    ("query.date", "cheap", "available"),
    ("language.identification", "medium", "unavailable"),
    ("language.translation", "medium", "unavailable"),
    ("text.ocr", "medium", "available"),
    ("people.face", "medium", "unavailable"),
    ("place.geo", "cheap", "unavailable"),
    ("visual.labels", "medium", "unavailable"),
    ("semantic.visual", "expensive", "unavailable"),
    ("visual.background", "medium", "unavailable"),
    ("duplicate.exact", "cheap", "available"),
    ("similarity.perceptual", "cheap", "available"),
    ("quality.visual", "cheap", "available"),
    ("content.screenshot", "cheap", "available"),
    ("content.document", "medium", "degraded"),
)

# fixed values: fields that refuse a whole spec
UNSUPPORTED_EXCLUSIONS = ("albums", "importantPeople")
UNSUPPORTED_ENTITIES = ("people", "places", "sceneLabels", "source")
