from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lumenlake.functions import rules as R
from lumenlake.functions import tagging, text
from lumenlake.functions.calendar import calendar_range

NOW = datetime(2026, 9, 9, 12, 0)


def ms(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000)


def test_fold_drops_accents_and_case_only(spark):
    rows = spark.createDataFrame([("Ação ÉÈ ñ Ü",), ("straße",), ("é",), ("й Ω",), ("İ",), ("plain ASCII",)], "t string")
    assert [r[0] for r in rows.select(text.fold(F.col("t"))).collect()] == [
        "acao ee n u", "straße", "e", "и ω", "i", "plain ascii"]


def test_clean_text_uses_the_compatibility_form(spark):
    rows = spark.createDataFrame([(" ﬁnd  ＡＢ　x\n\ty ",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.clean_text(F.col("t"))).collect()] == ["find AB x y", None]


def test_token_index_follows_updates_and_deletes(spark):
    texts = spark.createDataFrame([("a", "One two"), ("b", "two two")], "id string, ocr_text string")
    index = text.build_token_index(texts)
    assert {tuple(r) for r in index.collect()} == {("a", "one"), ("a", "two"), ("b", "two")}
    changed = spark.createDataFrame([("a", "three"), ("b", None)], "id string, ocr_text string")
    assert {tuple(r) for r in text.update_token_index(index, changed).collect()} == {("a", "three")}
    laid = text.lay_out_token_index(index, 4)
    assert laid.count() == 3 and "token_bucket" in laid.columns


def test_laid_out_index_reads_only_the_wanted_buckets(spark, tmp_path):
    texts = spark.range(200).selectExpr("cast(id as string) id", "concat('word', id % 50, ' common') ocr_text")
    laid = text.lay_out_token_index(text.build_token_index(texts), 16)
    laid.write.partitionBy("token_bucket").parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    found = text.indexed_matches(index, ["Word7 common"], buckets=16)
    assert {r.id for r in found.collect()} == {"7", "57", "107", "157"}
    scanned = found._jdf.queryExecution().executedPlan().toString()
    assert "token_bucket" in scanned.split("PartitionFilters: [")[1].split("]")[0]


PHRASES = {
    "today": (ms(2026, 9, 9) - 1, ms(2026, 9, 10)),
    "yesterday": (ms(2026, 9, 8) - 1, ms(2026, 9, 9)),
    "last week": (ms(2026, 8, 31) - 1, ms(2026, 9, 7)),
    "semana passada": (ms(2026, 8, 31) - 1, ms(2026, 9, 7)),
    "last month": (ms(2026, 8, 1) - 1, ms(2026, 9, 1)),
    "ano passado": (ms(2025, 1, 1) - 1, ms(2026, 1, 1)),
    "este ano": (ms(2026, 1, 1) - 1, ms(2026, 9, 9, 12) + 1),
    "before 2024": (None, ms(2024, 1, 1)),
    "depois de 2023": (ms(2024, 1, 1) - 1, None),
    "last 3 days": (ms(2026, 9, 6) - 1, ms(2026, 9, 9, 12) + 1),
    "ultimos dois meses": (ms(2026, 7, 9) - 1, ms(2026, 9, 9, 12) + 1),
    "hace tres semanas": (ms(2026, 8, 19) - 1, ms(2026, 8, 20)),
    "before yesterday": (None, ms(2026, 9, 8)),
    "after today": (ms(2026, 9, 10) - 1, None),
    "between yesterday and today": (ms(2026, 9, 8) - 1, ms(2026, 9, 10)),
    "fotos antigas": (None, ms(2025, 9, 9, 12)),
    "nothing": (None, None),
}


def test_calendar_phrases(spark):
    rows = spark.createDataFrame([(p, NOW) for p in PHRASES], "t string, now timestamp")
    got = {r.t: (r.after_ms, r.before_ms) for r in calendar_range(rows, "t", "now").collect()}
    assert got == PHRASES


def test_leap_day_and_open_dates(spark):
    rows = spark.createDataFrame(
        [("old", datetime(2024, 2, 29, 5)), ("last", NOW), ("today yesterday today", NOW)], "t string, now timestamp"
    )
    got = {r.t: r for r in calendar_range(rows, "t", "now").collect()}
    assert got["old"].before_ms == ms(2023, 3, 1, 5)
    assert got["last"].date_ambiguous and got["today yesterday today"].date_ambiguous
    assert not got["old"].date_ambiguous


PROMPTS = {
    "find blurry photos": dict(action="find", min_blur=0.55, media_types=["photo"], confidence=0.96),
    "show screenshots from yesterday": dict(screenshot=True, after_ms=ms(2026, 9, 8) - 1, unresolved=False),
    "delete blurry photos": dict(action="delete", cleanup=True, exclude_favorites=True, destructive=True),
    "Vídeos grandes": dict(media_types=["video"], min_file_size=524288000),
    "videos 2,5 GB": dict(min_file_size=2684354560, target_bytes=None),
    "free up space 2 gb": dict(target_bytes=2147483648, min_file_size=None, free_space=True, cleanup=True),
    "fotos e videos": dict(media_types=["video", "photo"]),
    'photos "tax 2020"': dict(terms=["tax 2020"], media_types=["photo"]),
    "vacation": dict(terms=["vacation"], confidence=0.85),
    "vacation sunset": dict(terms=None, unresolved=True, confidence=0.35),
    "screenshots without favorites": dict(exclude_favorites=True, ambiguous=False, screenshot=True),
    "not blurry": dict(ambiguous=True, unresolved=True),
    "recibos": dict(concepts=["receipt"], unresolved=False),
    "bank receipts": dict(concepts=["bank_receipt"]),
    "also include screenshots": dict(operation="broaden"),
    "remove videos from selection": dict(operation="remove", action="delete"),
    "largest videos": dict(largest=True, media_types=["video"]),
    "beach work": dict(label="work"),
}


@pytest.fixture(scope="module")
def intents(spark):
    rows = spark.createDataFrame([(p, NOW) for p in PROMPTS], "prompt string, now timestamp")
    classified = tagging.plan_status(tagging.classify_prompts(rows, "prompt", "now"), "prompt")
    return {r.prompt: r for r in classified.collect()}


@pytest.mark.parametrize("prompt", PROMPTS)
def test_prompts(intents, prompt):
    row = intents[prompt].asDict()
    assert {k: row[k] for k in PROMPTS[prompt]} == PROMPTS[prompt]


def test_plan_status(intents):
    assert (intents["find blurry photos"].status, intents["find blurry photos"].notices) == ("ready", [])
    assert intents["recibos"].status == "unsupported"
    assert intents["not blurry"].status == "clarification"
    assert intents["free up space 2 gb"].status == "clarification"
    assert intents["delete blurry photos"].notices == ["cleanupRankingUnavailable"]


def test_rules_are_arguments(spark):
    rows = spark.createDataFrame([("o gato wasserfall", NOW)], "prompt string, now timestamp")
    mine = tagging.classify_prompts(
        rows, "prompt", "now", normalize=False, aliases=(("video", r"\b(wasserfall)\b"),),
        concepts=(("cat", r"\b(gato)\b"),), ambiguity=r"\b(not)\b", fillers=r"\b(o)\b",
    ).first()
    assert (mine.media_types, mine.concepts, mine.ambiguous, mine.residual) == (["video"], ["cat"], False, "")


def test_evidence_in_order_of_priority(intents):
    assert intents["find blurry photos"].evidence == ["media-type:media type", "quality:blur"]


def test_words_end_at_ascii_letters():
    assert R.words(r"\b(a|b)\b") == r"(?<![0-9A-Za-z_])(a|b)(?![0-9A-Za-z_])"


def test_semantic_match_rejects_and_merges(spark):
    prototypes = spark.createDataFrame(
        [("blurry", [1.0, 0.0, 0.0]), ("duplicate", [0.98, 0.2, 0.0]), ("out_of_domain", [0.0, 0.0, 1.0]), ("otp", [0.0, 1.0, 0.0])],
        "concept string, v array<double>",
    )
    rows = [
        ("near", [1.0, 0.05, 0.0]),
        ("rejected", [0.1, 0.0, 1.0]),
        ("code", [0.0, 1.0, 0.1]),
        ("zero", [0.0, 0.0, 0.0]),
        ("short", [1.0]),
        ("nan", [float("nan"), 1.0, 0.0]),
    ]
    vectors = spark.createDataFrame(rows, "key string, v array<double>")
    matched = tagging.semantic_match(vectors, prototypes, "v")
    got = {r.key: [m.concept for m in r.matches] if r.matches else [] for r in matched.collect()}
    assert got == {"near": ["blurry", "duplicate"], "rejected": [], "code": ["otp"], "zero": [], "short": [], "nan": []}
    prompts = matched.withColumns({"prompt": F.lit("sharp enough pictures"), "now": F.lit(NOW)})
    intents = tagging.classify_prompts(prompts, "prompt", "now")
    merged = {r.key: r for r in tagging.merge_semantic(intents).collect()}
    assert merged["near"].duplicate and merged["near"].min_blur == 0.55 and merged["near"].confidence > 0.9
    assert merged["near"].action == "find" and merged["code"].concepts == ["otp"]
    assert not merged["rejected"].matched and merged["rejected"].confidence == 0.35


def test_calendar_phrases_beyond_reach_are_ambiguous(spark):
    from lumenlake.functions.calendar import calendar_range

    texts = ["last 900000000 weeks", "300000000 years ago", "9999999 days ago", "123456789012345 days ago", "before 90000 days ago"]
    rows = spark.createDataFrame([(t,) for t in [*texts, "2 days ago"]], "t string")
    rows = rows.withColumn("now", F.lit("2024-06-15 10:00:00").cast("timestamp"))
    found = {r.t: r for r in calendar_range(rows, "t", "now").collect()}
    for text in texts:
        assert found[text].after_ms is None and found[text].date_ambiguous
    assert found["2 days ago"].after_ms is not None and not found["2 days ago"].date_ambiguous


def test_more_than_five_phrases_are_kept(spark):
    from lumenlake.functions import tagging

    rows = spark.createDataFrame([(" ".join(f'"p{k}"' for k in range(8)),)], "t string")
    assert rows.select(tagging.extract_quoted(F.col("t"))).first()[0] == [f"p{k}" for k in range(8)]
    assert rows.select(tagging.extract_quoted(F.col("t"), 5)).first()[0] == [f"p{k}" for k in range(5)]


def test_costly_rows_are_cut_into_pieces_by_their_number(spark):
    from lumenlake.plans.parallel import spread_rows

    rows = spark.range(1000).repartition(8)
    assert spread_rows(rows, 50).rdd.getNumPartitions() == 20
    assert spread_rows(rows, 500).rdd.getNumPartitions() == 8
    assert spread_rows(spark.range(1000).coalesce(1), 500).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.id for r in spread_rows(rows, 50).collect()) == list(range(1000))


def test_prompts_come_in_small_pieces(spark, tmp_path):
    """The prompt queries take about 0.2 ms a row: the rows of a task stay bounded, however large the table."""
    from checks import model as M

    pieces = 2 * spark.sparkContext.defaultParallelism
    events = spark.range(25_000 * pieces).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts").coalesce(1)
    events.write.parquet(f"{tmp_path}/events.parquet")
    sizes = M.prompts(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == pieces
    assert max(r["count"] for r in sizes) <= 25_100
