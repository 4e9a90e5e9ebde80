"""Batch tagging of short search texts: rules in, typed columns out, no Python per row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import BLURRY_FROM, LARGE_VIDEO_FROM
from lumenlake.functions import rules as R
from lumenlake.functions.calendar import calendar_range
from lumenlake.functions.text import clean_text, fold
from lumenlake.functions.vectors import concept_scores

Rules = Sequence[tuple[str, str]]


def _strip(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, R.words(pattern), "")


def _first(items: Column, most: int | None) -> Column:
    return items if most is None else F.slice(items, 1, most)


def extract_quoted(text: Column, most: int | None = None) -> Column:
    """Quoted phrases in order; the first ``most`` of them if given."""
    return _first(F.regexp_extract_all(text, F.lit(R.QUOTED), 1), most)


def exclusion_flag(text: Column) -> Column:
    return text.rlike(R.words(R.EXCLUDE_FAVORITES))


def ambiguity_flag(text: Column, pattern: str = R.AMBIGUITY) -> Column:
    """Any other negation or "or" needs a question back; the favorites phrase does not count."""
    return _strip(text, R.EXCLUDE_FAVORITES).rlike(R.words(pattern))


def tag_operation(text: Column) -> Column:
    """How the text refines the current selection; the first rule whose words all occur."""
    tag = F.lit("new")
    for name, patterns in reversed(R.OPERATIONS):
        tag = F.when(reduce(lambda a, b: a & b, [text.rlike(R.words(p)) for p in patterns]), name).otherwise(tag)
    return tag


def tag_action(text: Column, rules: Rules = R.ACTIONS) -> Column:
    """First matching action, find by default."""
    first = F.coalesce(*[F.when(text.rlike(R.words(p)), name) for name, p in rules])
    return F.when(text.rlike(R.words(R.any_of(rules))), first).otherwise(R.DEFAULT_ACTION)


def strip_action(text: Column, action: Column, rules: Rules = R.ACTIONS) -> Column:
    stripped = text
    for name, pattern in rules:
        stripped = F.when(action == name, _strip(text, pattern)).otherwise(stripped)
    return stripped


def match_in_order(df: DataFrame, text: str, rules: Rules, prefix: str) -> DataFrame:
    """One boolean per rule; the matched text is removed before the next rule looks.

    Most texts match no rule, and then nothing is ever removed: one test with
    all patterns spares them the single ones.
    """
    stages = [text, *[f"_s{i}" for i in range(1, len(rules) + 1)]]
    df = df.withColumn("_some", F.col(text).rlike(R.words(R.any_of(rules))))
    for (_, pattern), before, after in zip(rules, stages, stages[1:]):
        left = F.when(F.col("_some"), _strip(F.col(before), pattern)).otherwise(F.col(before))
        df = df.withColumn(after, left)
    # A rule matched where it removed something.
    flags = {
        f"{prefix}{name}": F.col(before) != F.col(after)
        for (name, _), before, after in zip(rules, stages, stages[1:])
    }
    kept = [c for c in df.columns if c not in (*stages, "_some")]
    return df.select(*kept, *[v.alias(k) for k, v in flags.items()], F.col(stages[-1]).alias(text))


def tag_concepts(df: DataFrame, text: str, rules: Rules = R.CONCEPTS) -> DataFrame:
    """Add ``concepts``, the names of matching rules in order, and strip the matches from ``text``."""
    df = match_in_order(df, text, rules, "_c_")
    found = F.array_compact(F.array(*[F.when(F.col(f"_c_{n}"), F.lit(n)) for n, _ in rules]))
    return df.withColumn("concepts", found).drop(*[f"_c_{n}" for n, _ in rules])


def tag_aliases(df: DataFrame, text: str, rules: Rules = R.ALIASES) -> DataFrame:
    """Add filter columns and strip the matches from ``text``.

    Media types add up. A size found in the text before (column ``min_file_size``,
    if present) wins over the word "large". Of two label words the later rule wins.
    """
    df = match_in_order(df, text, rules, "_a_")
    on = {name: F.lit(False) for name, _ in R.ALIASES} | {name: F.col(f"_a_{name}") for name, _ in rules}
    explicit = F.col("min_file_size") if "min_file_size" in df.columns else F.lit(None).cast("bigint")
    media = F.array_compact(F.array(F.when(on["video"], "video"), F.when(on["photo"], "photo")))
    true = F.lit(True)
    df = df.withColumns(
        {
            "screenshot": F.when(on["screenshot"], true),
            "favorite": F.when(on["favorite"], true),
            "duplicate": F.when(on["duplicate"], true),
            "similar": F.when(on["similar"], true),
            "min_blur": F.when(on["blurry"], F.lit(BLURRY_FROM)),
            "min_file_size": F.coalesce(explicit, F.when(on["large"], F.lit(LARGE_VIDEO_FROM))).cast("bigint"),
            "media_types": F.when(F.size(media) > 0, media),
            "label": F.when(on["work"], "work").when(on["beach"], "beach"),
        }
    )
    return df.drop(*[f"_a_{n}" for n, _ in rules])


def size_bytes(text: Column) -> Column:
    """Last size in the text in bytes, or null."""
    amount = F.try_element_at(F.regexp_extract_all(text, F.lit(R.words(R.SIZE)), 1), F.lit(-1))
    unit = F.try_element_at(F.regexp_extract_all(text, F.lit(R.words(R.SIZE)), 2), F.lit(-1))
    scale = F.when(unit.startswith("g"), F.lit(1024.0**3)).otherwise(F.lit(1024.0**2))
    return F.floor(F.regexp_replace(amount, ",", ".").cast("double") * scale + 0.5).cast("bigint")


def wants_space(text: Column) -> Column:
    """A size next to a "free" word is a target, else a minimum size."""
    return text.rlike(R.words(R.FREE_WORD))


def residual_terms(text: Column, fillers: str = R.FILLERS) -> Column:
    """What is left without filler words and punctuation."""
    return F.trim(F.regexp_replace(_strip(text, fillers), R.NOT_WORD, " "))


def word_count(residual: Column) -> Column:
    return F.when(residual == "", 0).otherwise(F.size(F.split(residual, r"\s+")))


def score_confidence(unresolved: Column, single_term: Column) -> Column:
    return F.when(unresolved, R.UNRESOLVED).when(single_term, R.SINGLE_TERM).otherwise(R.RESOLVED)


def evidence(text: Column, matchers: Rules = R.MATCHERS) -> Column:
    """Matchers that fired, in order of priority."""
    return F.array_compact(F.array(*[F.when(text.rlike(R.words(p)), F.lit(name)) for name, p in matchers]))


def protect_favorites(excluded: Column, cleanup: Column, destructive: Column) -> Column:
    """Cleanup and destructive requests never touch favorites."""
    return excluded | cleanup | destructive


FILTERS = (
    "after_ms",
    "before_ms",
    "media_types",
    "screenshot",
    "favorite",
    "duplicate",
    "similar",
    "min_blur",
    "min_file_size",
    "label",
    "terms",
)


def has_filters() -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in FILTERS])


def classify_prompts(
    df: DataFrame,
    text: str,
    now: str,
    normalize: bool = True,
    actions: Rules = R.ACTIONS,
    concepts: Rules = R.CONCEPTS,
    aliases: Rules = R.ALIASES,
    matchers: Rules = R.MATCHERS,
    ambiguity: str = R.AMBIGUITY,
    fillers: str = R.FILLERS,
    most_terms: int | None = None,
) -> DataFrame:
    """One typed row per text: action, operation, filters, concepts, flags, confidence.

    ``terms`` has all quoted phrases and the one left-over word, or the first ``most_terms`` of them.

    ``normalize=False`` skips the compatibility form for texts known to be clean;
    the plan is then free of Python.
    """
    original = clean_text(F.col(text)) if normalize else F.col(text)
    kept = df.columns
    t = F.col("_t")
    df = df.withColumn("_folded", fold(original)).withColumn("_t", F.col("_folded"))
    df = df.withColumns({"evidence": evidence(t, matchers), "_quoted": F.regexp_extract_all(t, F.lit(R.QUOTED), 1)})
    df = df.withColumn("_t", _strip(t, R.QUOTED))
    df = df.withColumn("exclude_favorites", exclusion_flag(t)).withColumn("_t", _strip(t, R.EXCLUDE_FAVORITES))
    df = df.withColumns(
        {"ambiguous": t.rlike(R.words(ambiguity)), "operation": tag_operation(t), "action": tag_action(t, actions)}
    )
    df = df.withColumn("_t", strip_action(t, F.col("action"), actions))
    df = df.withColumn("cleanup", t.rlike(R.words(R.CLEANUP)) | (F.col("action") == "delete"))
    df = df.withColumn("_t", _strip(t, R.CLEANUP))
    df = df.withColumn("_free", t.rlike(R.words(R.FREE_SPACE))).withColumn("_t", _strip(t, R.FREE_SPACE))
    df = df.withColumn("_bytes", size_bytes(t)).withColumn("_t", _strip(t, R.SIZE))
    wanted = F.when(wants_space(F.col("_folded")), F.col("_bytes"))
    df = df.withColumn("target_bytes", wanted)
    df = df.withColumn("min_file_size", F.when(F.col("target_bytes").isNull(), F.col("_bytes")))
    df = df.withColumns(
        {
            "cleanup": F.col("cleanup") | F.col("_free") | F.col("target_bytes").isNotNull(),
            "free_space": F.col("_free") | F.col("target_bytes").isNotNull(),
            "destructive": F.col("action") == "delete",
        }
    )
    df = calendar_range(df, "_t", now).withColumn("_t", F.col("date_rest")).drop("date_rest")
    df = tag_aliases(tag_concepts(df, "_t", concepts), "_t", aliases)
    df = df.withColumn("largest", t.rlike(R.words(R.LARGEST))).withColumn("_t", _strip(t, R.LARGEST))
    df = df.withColumn("residual", residual_terms(t, fillers))
    words = word_count(F.col("residual"))
    single = (words == 1) & ~F.col("ambiguous") & ~F.col("date_ambiguous")
    df = df.withColumn("_single", single)
    single_term = F.when(F.col("_single"), F.array("residual")).otherwise(F.array().cast("array<string>"))
    listed = _first(F.concat("_quoted", single_term), most_terms)
    df = df.withColumn("terms", F.when(F.size(listed) > 0, listed))
    recognized = has_filters() | F.col("cleanup") | (F.size("concepts") > 0)
    unresolved = F.col("ambiguous") | F.col("date_ambiguous") | (words > 1) | ~recognized
    df = df.withColumn("unresolved", unresolved)
    df = df.withColumns(
        {
            "confidence": score_confidence(F.col("unresolved"), F.col("_single")),
            "exclude_favorites": protect_favorites(
                F.col("exclude_favorites"), F.col("cleanup"), F.col("destructive")
            ),
            "best_shot": F.lit(False),
        }
    )
    working = ("_folded", "_t", "_quoted", "_free", "_bytes", "_single")
    return df.select(*kept, *[c for c in df.columns if c not in kept and c not in working])


def semantic_match(
    vectors: DataFrame,
    prototypes: DataFrame,
    vector: str,
    threshold: float = R.SIMILARITY_FROM,
    margin: float = R.SIMILARITY_MARGIN,
    rejection: str = R.REJECTION,
    most: int | None = R.MOST_CONCEPTS,
) -> DataFrame:
    """Add ``matches``: up to ``most`` concepts near the best one and clear of the rejection class."""
    scored = concept_scores(vectors, prototypes, vector)
    best = F.array_max(F.transform("scores", lambda s: s["similarity"]))
    rejected = F.filter("scores", lambda s: s["concept"] == rejection)
    scored = scored.withColumns(
        {"_best": best, "_rejected": F.coalesce(F.get(rejected, F.lit(0))["similarity"], F.lit(-1.0))}
    )
    kept = F.filter(
        "scores",
        lambda s: (s["concept"] != rejection)
        & (s["similarity"] >= threshold)
        & (s["similarity"] >= F.col("_best") - margin)
        & (s["similarity"] > F.col("_rejected") + margin),
    )
    ranked = F.array_sort(
        F.transform(kept, lambda s: F.struct((-s["similarity"]).alias("o"), s["concept"].alias("concept")))
    )
    top = F.transform(
        _first(ranked, most),
        lambda s: F.struct(s["concept"].alias("concept"), (-s["o"]).alias("similarity")),
    )
    return scored.withColumn("matches", top).drop("_best", "_rejected", "scores")


def merge_semantic(df: DataFrame, from_similarity: float = R.SIMILARITY_FROM) -> DataFrame:
    """Enrich intents (columns of :func:`classify_prompts`) with their ``matches``.

    Only where the rules were unsure. Filters override, concepts and flags add
    up, confidence takes the larger value; the action never changes.
    """
    unsure = (F.col("confidence") < 0.9) | F.col("unresolved")
    usable = F.filter("matches", lambda m: m["similarity"].between(from_similarity, 1))
    usable = F.when(unsure & F.col("matches").isNotNull(), usable)
    df = df.withColumn("_m", F.coalesce(usable, F.array().cast(df.schema["matches"].dataType)))

    def any_of(names: Sequence[str]) -> Column:
        return F.exists("_m", lambda m: m["concept"].isin(*names))

    hit = {flag: any_of(names) for flag, names in R.SEMANTIC_FLAGS.items()}
    categories = F.transform(
        F.filter("_m", lambda m: m["concept"].isin(*R.SEMANTIC_CATEGORIES)), lambda m: m["concept"]
    )

    def patched(name: str, flag: str, value: Column) -> Column:
        return F.when(hit[flag], value).otherwise(F.col(name)).alias(name)

    true = F.lit(True)
    changes = {
        "duplicate": patched("duplicate", "duplicate", true),
        "similar": patched("similar", "similar", true),
        "screenshot": patched("screenshot", "screenshot", true),
        "min_blur": patched("min_blur", "blurry", F.lit(BLURRY_FROM)),
        "min_file_size": patched("min_file_size", "large_video", F.lit(LARGE_VIDEO_FROM).cast("bigint")),
        "media_types": patched("media_types", "large_video", F.array(F.lit("video"))),
        "concepts": F.array_distinct(F.concat("concepts", categories)),
        "cleanup": F.col("cleanup") | hit["cleanup"],
        "free_space": F.col("free_space") | hit["free_space"],
        "best_shot": F.col("best_shot") | hit["best_shot"],
        "matched": F.size("_m") > 0,
        "confidence": F.greatest(
            "confidence", F.coalesce(F.array_max(F.transform("_m", lambda m: m["similarity"])), F.lit(0.0))
        ),
    }
    df = df.withColumns(changes)
    protected = protect_favorites(F.col("exclude_favorites"), F.col("cleanup"), F.col("destructive"))
    return df.withColumn("exclude_favorites", protected).drop("_m")


def plan_status(df: DataFrame, text: str) -> DataFrame:
    """Add ``status`` (ready, clarification, unsupported), ``notices`` and the planned action to intents.

    A column ``ranking``, if there is one, names the order the request asks for; one that no search runs makes the plan
    unsupported. ``planned_action`` is what a ready plan would do, and ``requires_confirmation`` says that it changes
    assets; a search alone has no action.
    """
    matched = F.col("matched") if "matched" in df.columns else F.lit(False)
    raw = F.trim(F.col(text))
    unclear = (raw.rlike(R.words(R.RAW_NEGATION)) & ~raw.rlike(R.words(R.RAW_FAVORITES))) | (F.col("unresolved") & ~matched)
    blocking = F.array_compact(
        F.array(
            F.when(F.col("best_shot"), "bestShotUnavailable"),
            F.when(F.col("action").isin(*R.UNAVAILABLE_ACTIONS), "actionUnavailable"),
        )
    )
    advisory = F.array_compact(
        F.array(
            F.when(F.col("cleanup"), "cleanupRankingUnavailable"),
            F.when(F.col("free_space") | F.col("target_bytes").isNotNull(), "spaceTargetUnavailable"),
        )
    )
    df = df.withColumn("_blocking", blocking)
    blocked = (F.size("concepts") > 0) | (F.size("_blocking") > 0)
    asked = F.col("ranking") if "ranking" in df.columns else F.lit(None).cast("string")
    unranked = F.coalesce(asked.isin(*R.UNAVAILABLE_RANKINGS), F.lit(False))
    open_ended = ~has_filters() & (F.col("cleanup") | F.col("free_space"))
    status = (
        F.when(unclear, "clarification")
        .when(blocked, "unsupported")
        .when(open_ended, "clarification")
        .when(unranked, "unsupported")
        .otherwise("ready")
    )
    notices = (
        F.when(unclear, F.array().cast("array<string>")).when(blocked, F.col("_blocking")).otherwise(advisory)
    )
    df = df.withColumns({"status": status, "notices": notices}).drop("_blocking")
    known = [F.when(F.col("action") == name, F.lit(planned)) for name, planned in R.PLANNED_ACTIONS]
    action = F.when(F.col("status") == "ready", F.coalesce(*known))
    df = df.withColumn("planned_action", action)
    return df.withColumn("requires_confirmation", F.col("planned_action").isNotNull())
