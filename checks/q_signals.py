"""Grids, vectors, semantic matching, stage results."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import model as M
from checks.q_clusters import GRID, GRID_SPARK
from checks.q_text import INTENT_COLUMNS, _flat, intent_ctes, listed, status_sql
from checks.register import query
from lumenlake.functions import rules as R
from lumenlake.functions import signals, tagging, vectors
from lumenlake.operators.analysis import capability_results
from lumenlake.plans.parallel import spread, spread_rows
from lumenlake.registry import Analyser, AnalyserRegistry

GRID_CTE = f"g as (select vec_id, {GRID} as g from embeddings)"
INNER = [y * 8 + x for y in range(1, 7) for x in range(1, 7)]
EDGES = " + ".join(f"abs(4 * g[{i + 1}] - g[{i}] - g[{i + 2}] - g[{i - 7}] - g[{i + 9}])" for i in INNER)


def _grids(spark, sf):
    return M.table(spark, sf, "embeddings").selectExpr("vec_id", "label", f"{GRID_SPARK} AS g")


@query(
    "blur_score",
    f"with {GRID_CTE}, b as (select vec_id, 1 - least(1.0::double, ({EDGES})::double / 36 / 80) as blur from g)"
    " select vec_id, round(blur, 6) as blur, round(1 - blur, 6) as quality from b",
)
def blur_score(spark, sf):
    blur = signals.blur_score(F.col("g"), 8)
    return _grids(spark, sf).select(
        "vec_id", F.round(blur, 6).alias("blur"), F.round(signals.quality_score(blur), 6).alias("quality")
    )


@query(
    "brightness_score",
    f"with {GRID_CTE} select vec_id, round(1 - least(1.0::double, abs(list_sum(g)::double / 64 / 255 - 0.5) * 2), 6)"
    " as brightness from g",
)
def brightness_score(spark, sf):
    return _grids(spark, sf).select(
        "vec_id", F.round(signals.brightness_score(F.col("g")), 6).alias("brightness")
    )


# --- vectors -------------------------------------------------------------------------------

VECTORS = "v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings)"


def _vectors(spark, sf):
    return M.table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("v")
    )


@query(
    "mean_pool",
    f"with {VECTORS}, c as (select label, unnest(v) as x, unnest(range(64)) as dim from v),"
    " m as (select label, dim, avg(x) as x from c group by 1, 2)"
    " select label, cast(dim as int) as dim, round(x / sqrt(sum(x * x) over (partition by label)), 6) as x from m",
)
def mean_pool(spark, sf):
    pooled = vectors.mean_pool_normalize(_vectors(spark, sf), "label", "v")
    return pooled.select("label", F.posexplode("v").alias("dim", "x")).withColumn("x", F.round("x", 6))


@query(
    "cosine",
    f"with {VECTORS} select a.vec_id, round(list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v)"
    " * list_inner_product(b.v, b.v)), 6) as similarity from v a join v b on b.vec_id = a.vec_id + 1",
)
def cosine(spark, sf):
    rows = _vectors(spark, sf).select("vec_id", "v")
    following = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    similarity = vectors.cosine_similarity(F.col("v"), F.col("w"))
    return rows.join(following, "vec_id").select("vec_id", F.round(similarity, 6).alias("similarity"))


# Three prototypes per concept: pooled thirds of a label. Label 9 is the rejection class.
CONCEPTS = (
    "free_space",
    "cleanup_candidate",
    "duplicate",
    "similar",
    "best_shot",
    "screenshot",
    "blurry",
    "otp",
    "large_video",
    "out_of_domain",
)
CONCEPT = "split_part('" + "|".join(CONCEPTS) + "', '|', cast(label + 1 as int))"
PROTOTYPES = (
    f"{VECTORS}, pc as (select label, vec_id % 3 as part, unnest(v) as x, unnest(range(64)) as dim from v),"
    " pm as (select label, part, dim, avg(x) as x from pc group by 1, 2, 3),"
    f" proto as (select {CONCEPT} as concept, part, list(x order by dim) as w from pm group by label, part),"
    " scored as (select vec_id, concept, max(list_inner_product(v, w) / sqrt(list_inner_product(v, v)"
    " * list_inner_product(w, w))) as similarity from v, proto group by 1, 2)"
)
THRESHOLD = 0.3
MATCHED = (
    "best as (select vec_id, max(similarity) as b, max(case when concept = 'out_of_domain' then similarity end) as r"
    " from scored group by 1),"
    f" matches as (select s.vec_id, concept, similarity from scored s join best using (vec_id) where concept <> 'out_of_domain'"
    f" and similarity >= {THRESHOLD} and similarity >= b - 0.08 and similarity > r + 0.08"
    " qualify row_number() over (partition by s.vec_id order by similarity desc, concept) <= 4)"
)


def _prototypes(spark, sf):
    keyed = _vectors(spark, sf).selectExpr("label * 3 + vec_id % 3 AS part", "v")
    pooled = vectors.mean_pool_normalize(keyed, "part", "v")
    return pooled.selectExpr(f"{CONCEPT.replace('label', '(part div 3)')} AS concept", "v")


@query(
    "concept_scores",
    f"with {PROTOTYPES} select vec_id, concept, round(similarity, 6) as similarity from scored",
)
def concept_scores(spark, sf):
    scored = vectors.concept_scores(_vectors(spark, sf), _prototypes(spark, sf), "v")
    return scored.select("vec_id", F.explode("scores").alias("s")).select(
        "vec_id", F.col("s.concept").alias("concept"), F.round("s.similarity", 6).alias("similarity")
    )


@query(
    "semantic_match",
    f"with {PROTOTYPES}, {MATCHED} select vec_id, concept, round(similarity, 6) as similarity from matches",
)
def semantic_match(spark, sf):
    matched = tagging.semantic_match(_vectors(spark, sf), _prototypes(spark, sf), "v", THRESHOLD)
    return matched.select("vec_id", F.explode("matches").alias("m")).select(
        "vec_id", F.col("m.concept").alias("concept"), F.round("m.similarity", 6).alias("similarity")
    )


NOW = "timestamp '2024-05-17 10:30:00'"
PROMPTED = (
    f"f as (select vec_id, {M.clean_prompt_sql('vec_id')} as prompt, {NOW} as now,"
    f" lower(strip_accents({M.clean_prompt_sql('vec_id')})) as t from embeddings)"
)


def _hit(*names: str) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"exists (select 1 from m where m.vec_id = i.vec_id and m.concept in ({listed}))"


_LATE = {
    "duplicate": f"case when {_hit('duplicate')} then true else i.duplicate end",
    'similar': f'case when {_hit("similar", "best_shot")} then true else i."similar" end',
    "screenshot": f"case when {_hit('screenshot')} then true else i.screenshot end",
    "min_blur": f"case when {_hit('blurry')} then 0.55::double else i.min_blur end",
    "min_file_size": f"case when {_hit('large_video')} then 524288000::bigint else i.min_file_size end",
    "media_types": f"case when {_hit('large_video')} then 'video' else i.media_types end",
    "concepts": f"concat_ws(',', nullif(i.concepts, ''), case when {_hit('otp')} and not contains(i.concepts, 'otp')"
    " then 'otp' end)",
    "cleanup": f"i.cleanup or {_hit('free_space', 'cleanup_candidate', 'best_shot')}",
    "free_space": f"i.free_space or {_hit('free_space')}",
    "best_shot": _hit("best_shot"),
    "matched": "exists (select 1 from m where m.vec_id = i.vec_id)",
    "confidence": "greatest(i.confidence, coalesce((select max(similarity) from m where m.vec_id = i.vec_id), 0))",
}
MERGED = (
    f"m as (select x.* from matches x join intent i on i.vec_id = x.vec_id where (i.confidence < 0.9 or i.unresolved)"
    f" and x.similarity between {THRESHOLD} and 1),"
    " merged0 as (select i.* exclude (" + listed(c for c in _LATE if c not in ("best_shot", "matched")) + "), "
    + ", ".join(f'{v} as "{k}"' for k, v in _LATE.items())
    + " from intent i), merged as (select * exclude (constrained, exclude_favorites),"
    " exclude_favorites or cleanup or destructive as exclude_favorites,"
    " after_ms is not null or before_ms is not null or media_types is not null or screenshot is not null"
    " or favorite is not null or duplicate is not null or \"similar\" is not null or min_blur is not null"
    " or min_file_size is not null or label is not null or terms is not null as constrained from merged0)"
)
MERGED_COLUMNS = [c for c in INTENT_COLUMNS if c != "confidence"]


@query(
    "merge_semantic",
    f"with {PROTOTYPES}, {MATCHED}, {intent_ctes(PROMPTED)}, {MERGED}, {status_sql('matched')}"
    f" select vec_id, {listed(MERGED_COLUMNS)}, best_shot, matched, round(confidence, 6) as confidence, status,"
    " notices from planned",
)
def merge_semantic(spark, sf):
    keys = spread_rows(M.table(spark, sf, "embeddings").select("vec_id"))
    prompts = keys.selectExpr("vec_id", f"{M.prompt('vec_id')} AS prompt", f"{NOW} AS now")
    intents = tagging.classify_prompts(prompts, "prompt", "now", most_terms=R.MAX_TERMS)
    matches = tagging.semantic_match(_vectors(spark, sf), _prototypes(spark, sf), "v", THRESHOLD)
    merged = tagging.merge_semantic(intents.join(matches.select("vec_id", "matches"), "vec_id"), THRESHOLD)
    planned = tagging.plan_status(merged, "prompt").withColumn("notices", F.concat_ws(",", "notices"))
    return _flat(planned).select(
        "vec_id",
        *MERGED_COLUMNS,
        "best_shot",
        "matched",
        F.round("confidence", 6).alias("confidence"),
        "status",
        "notices",
    )


# --- stage results -------------------------------------------------------------------------

SIGNALS = "g as (select vec_id, 1 as has_pixels, case when label = 3 then null else 0.5 end as blur from embeddings)"
RESULTS = (
    "r as (select d.doc_id, v.name, case v.name"
    " when 'content.screenshot' then case when l.toxic is null then 'SCREENSHOT_FAILED' end"
    " when 'quality.visual' then case when g.vec_id is null then 'THUMBNAIL_UNAVAILABLE' when g.blur is null"
    " then 'QUALITY_FAILED' end"
    " when 'similarity.perceptual' then case when g.vec_id is null then 'THUMBNAIL_UNAVAILABLE' when d.lang = 'es'"
    " then 'VISUAL_HASH_FAILED' end"
    " when 'duplicate.exact' then case when not (d.doc_id % 5 = 0) and d.lang = 'fr' then 'CONTENT_HASH_FAILED' end"
    " else case when g.vec_id is null then 'NOT_PROCESSED' when not (d.doc_id % 5 = 0) and d.lang = 'de'"
    " then 'OCR_FAILED' end end as error from documents d left join g on g.vec_id = d.doc_id"
    " left join labels l on l.doc_id = d.doc_id, (values "
    + ", ".join(f"('{n}')" for n in M.CAPABILITY_NAMES)
    + ") v(name))"
)


@query(
    "capability_results",
    f"with {SIGNALS}, {RESULTS} select doc_id, name as capability_id, case when error is null then 'completed' else 'failed' end"
    " as status, error from r",
)
def stage_results(spark, sf):
    grids = M.table(spark, sf, "embeddings").selectExpr(
        "vec_id AS doc_id", "true AS has_pixels", "case when label = 3 then null else 0.5D end AS blur"
    )
    labels = M.table(spark, sf, "labels").select("doc_id", "toxic")
    rows = (
        M.table(spark, sf, "documents").select("doc_id", "lang")
        .join(grids, "doc_id", "left")
        .join(labels, "doc_id", "left")
    )
    lang = F.col("lang")
    results = capability_results(
        "deep",
        video=F.col("doc_id") % 5 == 0,
        has_pixels=F.col("has_pixels").isNotNull(),
        blur=F.col("blur"),
        visual_hash=F.when(lang != "es", "aa"),
        screenshot=F.col("toxic") == 1,
        content_hash=F.when(lang != "fr", "bb"),
        text_done=lang != "de",
    )
    return rows.select("doc_id", F.explode(results).alias("r")).select("doc_id", "r.*")


# --- plugged-in analysers ------------------------------------------------------------------


def _words(rows):
    if any(k % 37 == 0 for k in rows["doc_id"]):
        raise RuntimeError("some rows can't be analysed")
    return rows.assign(n_words=[len((t or "").encode().split()) for t in rows["text"]])


def _density(rows):
    return rows.assign(density=[None if n == 0 else n / max(1, w) for n, w in zip(rows["n_chars"], rows["n_words"])])


@query(
    "plugin_signal",
    "with w as (select doc_id, n_chars, doc_id % 37 = 0 as bad,"
    " len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as n_words from documents)"
    " select doc_id, case when not bad then n_words end as n_words,"
    " case when not bad and n_chars <> 0 then n_chars::double / greatest(1, n_words) end as density,"
    " case when bad then 'text.words failed FAILED,text.density failed UNAVAILABLE,text.none failed UNAVAILABLE'"
    " when n_chars = 0 then 'text.words completed,text.density failed FAILED,text.none failed UNAVAILABLE'"
    " else 'text.words completed,text.density completed,text.none failed UNAVAILABLE' end as results from w",
)
def plugin_signal(spark, sf):
    """Analysers in batches: one raises on some rows, one depends on it, one isn't there."""
    registry = AnalyserRegistry()
    registry.register(Analyser("text.density", ("n_chars", "n_words"), {"density": "double"}, _density, 64, ("text.words",), "cheap"))
    registry.register(Analyser("text.words", ("doc_id", "text"), {"n_words": "bigint"}, _words, 500))
    documents = spread(M.table(spark, sf, "documents").select("doc_id", "text", "n_chars"))
    done = registry.run(documents, ["text.density", "text.words", "text.none"])
    listed = F.transform("capability_results", lambda r: F.concat_ws(" ", r["capability_id"], r["status"], r["error"]))
    return done.select("doc_id", "n_words", "density", F.concat_ws(",", listed).alias("results"))
