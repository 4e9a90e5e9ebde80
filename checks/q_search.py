"""Predicates, specs, set algebra, rankings, pages, candidates, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import model as M
from checks.model import DAY, NOW, START, with_tables
from checks.register import query
from lumenlake.constants import LOG_LENGTH
from lumenlake.functions.text import has_text, text_matches
from lumenlake.operators import candidates, insights, paging, predicates, selections, spec_index, spec_tables, specs
from lumenlake.operators.capabilities import Capability, Provider, Resolver, apply_resolved, default_resolver
from lumenlake.plans.presets import preset

MIDDLE = START + 150 * DAY
ORDER_DAY = "timestamp '1997-06-15 00:00:00'"

# --- single predicates ---------------------------------------------------------------------


def _orders(spark, sf):
    return M.table(spark, sf, "orders").selectExpr("o_orderkey", "unix_millis(o_orderdate) AS created_at")


ORDERS_MS = 866332800000  # 1997-06-15


@query(
    "f_before",
    f"select o_orderkey, epoch_ms(o_orderdate) as created_at from orders where epoch_ms(o_orderdate) < {ORDERS_MS}",
)
def f_before(spark, sf):
    return _orders(spark, sf).where(predicates.before("created_at", ORDERS_MS))


@query(
    "f_after",
    f"select o_orderkey, epoch_ms(o_orderdate) as created_at from orders where epoch_ms(o_orderdate) > {ORDERS_MS}",
)
def f_after(spark, sf):
    return _orders(spark, sf).where(predicates.after("created_at", ORDERS_MS))


def _plain(name: str, condition: str):
    return with_tables(["plain"], f"select id from plain where {condition}")


def _wide(condition: str):
    return with_tables(["wide"], f"select id from wide where {condition}")


@query("f_media_in", with_tables(["assets"], "select id from assets where media_type in ('video')"))
def f_media_in(spark, sf):
    return M.assets(spark, sf).where(predicates.media_in("media_type", ["video"])).select("id")


@query("f_favorite", with_tables(["assets"], "select id from assets where favorite"))
def f_favorite(spark, sf):
    return M.assets(spark, sf).where(predicates.flag_eq("favorite", True)).select("id")


@query("f_min_size", with_tables(["assets"], "select id from assets where file_size >= 200000000"))
def f_min_size(spark, sf):
    return M.assets(spark, sf).where(predicates.at_least("file_size", 200000000)).select("id")


@query("f_screenshot", _plain("f", "coalesce(is_screenshot, false) = false"))
def f_screenshot(spark, sf):
    joined = M.assets(spark, sf).join(M.content(spark, sf).select("id", "is_screenshot"), "id", "left")
    return joined.where(predicates.flag_eq_default("is_screenshot", False)).select("id")


@query("f_has_text", _plain("f", "length(trim(ocr_text)) > 0"))
def f_has_text(spark, sf):
    written = M.texts(spark, sf).where(has_text(F.col("ocr_text")))
    return predicates.exists_in(M.assets(spark, sf), written).select("id")


@query("f_no_text", _plain("f", "not coalesce(length(trim(ocr_text)) > 0, false)"))
def f_no_text(spark, sf):
    written = M.texts(spark, sf).where(has_text(F.col("ocr_text")))
    return predicates.exists_in(M.assets(spark, sf), written, present=False).select("id")


@query("f_max_quality", _plain("f", "quality_score <= 0.3"))
def f_max_quality(spark, sf):
    joined = insights.enrich(M.assets(spark, sf), M.quality(spark, sf), M.content(spark, sf))
    return joined.where(predicates.at_most("quality_score", 0.3)).select("id")


@query("f_min_blur", _plain("f", "blur_score >= 0.55"))
def f_min_blur(spark, sf):
    joined = insights.enrich(M.assets(spark, sf), M.quality(spark, sf), M.content(spark, sf))
    return joined.where(predicates.at_least("blur_score", 0.55)).select("id")


def phrase_sql(column: str, term: str) -> str:
    padded = f"' ' || trim(regexp_replace(lower(strip_accents({column})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
    return f"contains({padded}, ' {term} ')"


TERMS = ["and the", "OF", "thé"]
TERMS_SQL = " and ".join(phrase_sql("ocr_text", t) for t in ("and the", "of", "the"))


@query("f_text_all", with_tables(["texts"], f"select id from texts where {TERMS_SQL}"))
def f_text_all(spark, sf):
    return M.texts(spark, sf).where(text_matches(F.col("ocr_text"), TERMS)).select("id")


@query("f_duplicate", _wide("in_duplicate"))
def f_duplicate(spark, sf):
    return predicates.exists_in(M.assets(spark, sf), M.memberships(spark, sf).where("in_duplicate")).select("id")


@query("f_similar", _wide("in_similar"))
def f_similar(spark, sf):
    return predicates.exists_in(M.assets(spark, sf), M.memberships(spark, sf).where("in_similar")).select("id")


@query("f_not_similar", _wide("not in_similar"))
def f_not_similar(spark, sf):
    similar = M.memberships(spark, sf).where("in_similar")
    return predicates.exists_in(M.assets(spark, sf), similar, present=False).select("id")


@query(
    "ids_in",
    with_tables(
        ["assets"],
        "select id, created_at from assets where id in"
        f" (select {M.asset_id('item_id')} from benchmark union all select {M.asset_id('item_id')} from benchmark)",
    ),
)
def ids_in(spark, sf):
    ids = M.table(spark, sf, "benchmark").selectExpr(f"{M.asset_id('item_id')} AS id")
    return predicates.ids_in(M.assets(spark, sf), ids.unionByName(ids)).select("id", "created_at")


# --- specs ---------------------------------------------------------------------------------

leaf = specs.predicate
VIDEO = leaf("metadata.core", "in", {"field": "mediaTypes", "value": ["video"]})
PHOTO = leaf("metadata.core", "in", {"field": "mediaTypes", "value": ["photo"]})
BIG = leaf("metadata.core", "eq", {"field": "minFileSize", "value": 200000000})
FAVORITE = leaf("metadata.core", "eq", {"field": "favorite", "value": True})
SHOT = leaf("content.screenshot", "eq", {"field": "screenshot", "value": True})
BLURRY = leaf("quality.visual", "eq", {"field": "minBlur", "value": 0.55})
POOR = leaf("quality.visual", "eq", {"field": "maxQuality", "value": 0.3})
OLD = leaf("query.date", "before", {"field": "before", "value": MIDDLE})
NEW = leaf("query.date", "after", {"field": "after", "value": MIDDLE})
DOCUMENT = leaf("content.document", "eq", {"field": "document", "value": True})
TEXT = leaf("text.ocr", "containsAny", {"field": "ocrTerms", "value": ["and the", "of"]})
DUPLICATE = leaf("duplicate.exact", "eq", {"field": "duplicate", "value": True})
SIMILAR = leaf("similarity.perceptual", "eq", {"field": "similar", "value": True})
TEXT_SQL = "coalesce(" + " and ".join(phrase_sql("ocr_text", t) for t in ("and the", "of")) + ", false)"

AND = specs.all_specs(PHOTO, OLD, BLURRY, specs.not_spec(FAVORITE))
OR = specs.any_spec(DUPLICATE, SHOT, specs.all_specs(VIDEO, BIG))
NOT = specs.not_spec(BIG)
NESTED = specs.all_specs(
    specs.any_spec(specs.all_specs(SIMILAR, specs.not_spec(DOCUMENT)), TEXT, specs.not_spec(POOR)),
    specs.not_spec(specs.any_spec(FAVORITE, specs.any_spec())),
    specs.EVERYTHING,
)
AND_SQL = f"media_type = 'photo' and created_at < {MIDDLE} and blur_score >= 0.55 and not favorite"
OR_SQL = "in_duplicate or coalesce(is_screenshot, false) or (media_type = 'video' and file_size >= 200000000)"
NESTED_SQL = (
    f"((in_similar and not has_text) or {TEXT_SQL} or not (quality_score <= 0.3)) and not favorite"
)


def _spec(spark, sf, spec):
    names = {item["capability"] for item in specs.leaves(spec)}
    clusters = bool(names & {"duplicate.exact", "similarity.perceptual"})
    return specs.apply_spec(M.catalog(spark, sf, clusters), spec).select("id")


@query("spec_and", _plain("s", AND_SQL))
def spec_and(spark, sf):
    return _spec(spark, sf, AND)


@query("spec_or", _wide(OR_SQL))
def spec_or(spark, sf):
    return _spec(spark, sf, OR)


@query("spec_not", with_tables(["assets"], "select id from assets where not (file_size >= 200000000)"))
def spec_not(spark, sf):
    return _spec(spark, sf, NOT)


@query("spec_nested", _wide(NESTED_SQL))
def spec_nested(spark, sf):
    return _spec(spark, sf, NESTED)


@query(
    "preset_large_video",
    with_tables(["assets"], "select id from assets where media_type = 'video' and file_size >= 524288000"),
)
def preset_large_video(spark, sf):
    return _spec(spark, sf, preset("large-videos"))


@query(
    "preset_blurry",
    _plain("p", f"media_type = 'photo' and blur_score >= 0.55 and created_at < {MIDDLE}"),
)
def preset_blurry(spark, sf):
    return _spec(spark, sf, preset("blurry-photos", before=MIDDLE))


@query(
    "spec_from_filters",
    _plain("f", f"created_at > {MIDDLE} and {TEXT_SQL} and not favorite and not coalesce(is_screenshot, false)"),
)
def spec_from_filters(spark, sf):
    spec = specs.filters_to_spec(
        {"after": MIDDLE, "ocrTerms": ["and the", "of"], "minBlur": None},
        {"favorites": True, "screenshots": True, "labels": []},
    )
    return _spec(spark, sf, spec)


@query("set_intersect", _plain("s", f"({AND_SQL}) and quality_score <= 0.3"))
def set_intersect(spark, sf):
    return paging.intersect_sets(_spec(spark, sf, AND), _spec(spark, sf, POOR))


@query("set_union", _plain("s", f"({AND_SQL}) or quality_score <= 0.3"))
def set_union(spark, sf):
    return paging.union_sets(_spec(spark, sf, AND), _spec(spark, sf, POOR))


@query("set_subtract", _plain("s", f"({AND_SQL}) and (quality_score <= 0.3) is not true"))
def set_subtract(spark, sf):
    return paging.subtract_sets(_spec(spark, sf, AND), _spec(spark, sf, POOR))


@query("refine_restrict", _plain("r", f"({AND_SQL}) and file_size >= 200000000"))
def refine_restrict(spark, sf):
    return _spec(spark, sf, specs.refine(AND, BIG, "restrict"))


@query("refine_exclude", _plain("r", f"({AND_SQL}) and not (file_size >= 200000000)"))
def refine_exclude(spark, sf):
    return _spec(spark, sf, specs.refine(AND, BIG, "exclude"))


@query("refine_broaden", _plain("r", f"({AND_SQL}) or file_size >= 200000000"))
def refine_broaden(spark, sf):
    return _spec(spark, sf, specs.refine(AND, BIG, "broaden"))


@query("refine_replace", _plain("r", "media_type = 'photo' and not favorite and blur_score >= 0.55 and created_at < 1710000000000"))
def refine_replace(spark, sf):
    earlier = leaf("query.date", "before", {"field": "before", "value": 1710000000000})
    return _spec(spark, sf, specs.refine(AND, earlier, "replace"))


BULK = {
    "old-blurry": (AND, AND_SQL),
    "videos": (VIDEO, "media_type = 'video'"),
    "not-big": (NOT, "not (file_size >= 200000000)"),
    "recent": (NEW, f"created_at > {MIDDLE}"),
    "poor": (POOR, "quality_score <= 0.3"),
    "shots": (SHOT, "coalesce(is_screenshot, false)"),
    "written": (TEXT, TEXT_SQL),
    "nothing": (specs.any_spec(), "false"),
}


@query(
    "bulk_match",
    with_tables(
        ["plain"],
        " union all ".join(f"select '{n}' as spec_id, id from plain where {c}" for n, (_, c) in BULK.items()),
    ),
)
def bulk_match(spark, sf):
    return specs.bulk_match(M.catalog(spark, sf), {name: spec for name, (spec, _) in BULK.items()})


# Stored specs, one per document: an AND of a NOT, an OR and, by language, one odd leaf.
def _json(capability: str, operator: str, field: str, value: str) -> str:
    return (
        f'{{"type":"predicate","capability":"{capability}","operator":"{operator}",'
        f'"value":{{"field":"{field}","value":{value}}}}}'
    )


ODD = (
    f"case lang when 'en' then '{_json('content.document', 'eq', 'document', 'true')}'"
    f" when 'fr' then '{_json('metadata.core', 'containsAny', 'people', '["a"]')}'"
    f" when 'de' then '{_json('visual.labels', 'containsAny', 'labels', '["beach"]')}'"
    f" else '{_json('quality.visual', 'eq', 'maxQuality', 'false')}' end"
)
SIZE_LEAF = _json("metadata.core", "eq", "minFileSize", "@").split("@")
STORED = (
    '\'{"type":"and","children":[{"type":"not","child":' + SIZE_LEAF[0] + "' || cast(n_chars as string) || '"
    + SIZE_LEAF[1] + '},{"type":"or","children":[' + _json("content.screenshot", "eq", "screenshot", "true")
    + ",' || " + ODD + " || ']},' || repeat('{\"type\":\"and\",\"children\":[', cast(doc_id % 30 as int))"
    + " || '" + _json("query.date", "before", "before", "5") + "' || repeat(']}', cast(doc_id % 30 as int)) || ']}'"
)


def _stored_specs(spark, sf):
    return M.table(spark, sf, "documents").selectExpr("doc_id AS spec_id", f"{STORED} AS spec")


LEAVES = (
    "select doc_id as spec_id, 0 as position, 2 as depth, true as negated, 'metadata.core' as capability,"
    " 'eq' as operator, 'minFileSize' as field, cast(n_chars as string) as value, 'number' as kind from documents"
    " union all select doc_id, 1, 2, false, 'content.screenshot', 'eq', 'screenshot', 'true', 'boolean' from documents"
    " union all select doc_id, 2, 2, false,"
    " case lang when 'en' then 'content.document' when 'fr' then 'metadata.core' when 'de' then 'visual.labels'"
    " else 'quality.visual' end, case when lang in ('fr', 'de') then 'containsAny' else 'eq' end,"
    " case lang when 'en' then 'document' when 'fr' then 'people' when 'de' then 'labels' else 'maxQuality' end,"
    " case lang when 'en' then 'true' when 'fr' then '[\"a\"]' when 'de' then '[\"beach\"]' else 'false' end,"
    " case when lang in ('fr', 'de') then 'strings' else 'boolean' end from documents"
    " union all select doc_id, 3, 1 + doc_id % 30, false, 'query.date', 'before', 'before', '5', 'number' from documents"
)


@query("spec_leaves", f"select spec_id, position, cast(depth as int) as depth, negated, capability, operator, field, value, kind from ({LEAVES})")
def spec_leaves(spark, sf):
    return spec_tables.explode_predicates(_stored_specs(spark, sf))


# Every tenth item of the benchmark stands for an odd spec: without leaves, unreadable, or with an empty list.
ODD_SPECS = (
    "case item_id % 3 when 0 then '{\"type\":\"and\",\"children\":[]}' when 1 then '{{broken'"
    f" else '{_json('text.ocr', 'containsAll', 'ocrTerms', '[]')}' end"
)


def _odd_specs(spark, sf):
    odd = M.table(spark, sf, "benchmark").selectExpr("-1 - item_id AS spec_id", f"{ODD_SPECS} AS spec")
    return _stored_specs(spark, sf).unionByName(odd)


@query(
    "spec_coverage",
    f"with l as ({LEAVES}), s as (select *, case when position < 2 or position = 3 then 'available'"
    " when capability = 'content.document' then 'degraded' else 'unavailable' end as st from l)"
    " select spec_id, count_if(st = 'available') as available, count_if(st = 'degraded') as degraded,"
    " count_if(st = 'unavailable') as unavailable, case when count_if(st = 'unavailable') > 0 then 'unavailable'"
    " when count_if(st = 'degraded') > 0 then 'degraded' else 'complete' end as status from s group by spec_id"
    " union all select -1 - item_id, 0, 0, case item_id % 3 when 2 then 1 else 0 end,"
    " case item_id % 3 when 0 then 'complete' when 1 then 'unreadable' else 'unavailable' end from benchmark",
)
def spec_coverage(spark, sf):
    return spec_tables.spec_coverage(_odd_specs(spark, sf))


@query(
    "spec_limits",
    "select doc_id as spec_id, cast(7 + doc_id % 30 as int) as nodes, cast(greatest(2, 1 + doc_id % 30) as int) as depth,"
    " 3 as widest, greatest(2, 1 + doc_id % 30) > 24 as too_complex from documents",
)
def spec_limits(spark, sf):
    return spec_tables.spec_limits(_stored_specs(spark, sf))


@query(
    "refinement_log",
    "with r as (select *, row_number() over (partition by user_id order by event_id desc) as n from events)"
    " select user_id as selection_id, string_agg(event_type, ',' order by event_id) as operations"
    " from r where n <= 32 group by user_id",
)
def refinement_log(spark, sf):
    log = M.table(spark, sf, "events").selectExpr(
        "user_id AS selection_id", "event_id AS seq", "event_type AS operation"
    )
    return spec_tables.refinement_log(log, last=LOG_LENGTH).withColumn("operations", F.concat_ws(",", "operations"))


@query(
    "refinement_log_all",
    "select user_id as selection_id, string_agg(event_type, ',' order by event_id) as operations from events group by user_id",
)
def refinement_log_all(spark, sf):
    log = M.table(spark, sf, "events").selectExpr(
        "user_id AS selection_id", "event_id AS seq", "event_type AS operation"
    )
    return spec_tables.refinement_log(log).withColumn("operations", F.concat_ws(",", "operations"))


# --- rankings and pages --------------------------------------------------------------------

REGISTRY = predicates.default_registry
IMPORTANCE = (
    "favorite::int * 1000000 + coalesce(face_count, 0) * 10000 + coalesce(quality_score, 2) * 1000"
    " + created_at / 1000000000000.0::double"
)


@query(
    "rank_newest",
    "select o_orderkey, epoch_ms(o_orderdate) as created_at from orders order by 2 desc, 1 desc limit 60",
)
def rank_newest(spark, sf):
    ranking = REGISTRY().ranking("newest")
    return _orders(spark, sf).orderBy(*ranking.order("o_orderkey")).limit(60)


@query(
    "rank_largest",
    with_tables(["assets"], "select id, file_size from assets order by coalesce(file_size, -1) desc, id desc limit 60"),
)
def rank_largest(spark, sf):
    return paging.max_results(M.assets(spark, sf), REGISTRY().ranking("largest"), 60).select("id", "file_size")


@query(
    "rank_worst_quality",
    with_tables(["plain"], "select id, quality_score from plain order by coalesce(quality_score, 2), id limit 60"),
)
def rank_worst_quality(spark, sf):
    wide = specs.wide_catalog(M.catalog(spark, sf), [], ("worst-quality",))
    return paging.max_results(wide, REGISTRY().ranking("worst-quality"), 60).select("id", "quality_score")


@query(
    "rank_most_redundant",
    with_tables(["wide"], "select id, memberships from wide order by memberships desc, id desc limit 60"),
)
def rank_most_redundant(spark, sf):
    wide = specs.wide_catalog(M.catalog(spark, sf, clusters=True), [], ("most-redundant",))
    top = paging.max_results(wide, REGISTRY().ranking("most-redundant"), 60)
    return top.select("id", F.coalesce("memberships", F.lit(0)).alias("memberships"))


@query(
    "rank_least_important",
    with_tables(["plain"], f"select id, round({IMPORTANCE}, 6) as score from plain order by {IMPORTANCE}, id limit 60"),
)
def rank_least_important(spark, sf):
    wide = specs.wide_catalog(M.catalog(spark, sf), [], ("least-important",))
    ranking = REGISTRY().ranking("least-important")
    return paging.max_results(wide, ranking, 60).select("id", F.round(ranking.value, 6).alias("score"))


PAGE = "select id, created_at as sort_value from assets {where} order by created_at desc, id desc limit 61"


@query("keyset_page_1", with_tables(["assets"], PAGE.format(where="")))
def keyset_page_1(spark, sf):
    page = paging.keyset_page(M.assets(spark, sf), REGISTRY().ranking("newest"), 60)
    return page.select("id", "sort_value")


@query(
    "keyset_page_2",
    with_tables(
        ["assets"],
        "+ last as (select created_at as v, id as i from (select * from assets order by created_at desc, id desc limit 60)"
        " order by created_at, id limit 1) "
        + PAGE.format(where=", last where created_at < v or (created_at = v and id < i)"),
    ),
)
def keyset_page_2(spark, sf):
    assets, ranking = M.assets(spark, sf), REGISTRY().ranking("newest")
    last = paging.keyset_page(assets, ranking, 60).take(60)[-1]
    return paging.keyset_page(assets, ranking, 60, (last.sort_value, last.id)).select("id", "sort_value")


@query(
    "max_results",
    with_tables(["plain"], f"select id from plain where {AND_SQL} order by created_at desc, id desc limit 75"),
)
def max_results(spark, sf):
    wide = specs.wide_catalog(M.catalog(spark, sf), [AND]).where(specs.compile_spec(AND))
    return paging.max_results(wide, REGISTRY().ranking("newest"), 75).select("id")


@query(
    "offset_page",
    with_tables(["assets"], "select id, created_at from assets order by created_at desc, id desc limit 60 offset 120"),
)
def offset_page(spark, sf):
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return paging.offset_page(M.assets(spark, sf), order, 120, 60).select("id", "created_at")


@query(
    "export_pages",
    "select o_orderkey, row_number() over (order by o_orderdate desc, o_orderkey desc) as position,"
    " cast(ceil(row_number() over (order by o_orderdate desc, o_orderkey desc) / 60) as bigint) as page from orders",
)
def export_pages(spark, sf):
    orders = M.table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    order = [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
    return paging.export_pages(orders, order, 60).select("o_orderkey", "position", "page")


@query(
    "recoverable_target",
    with_tables(
        ["assets"],
        "+ r as (select id, coalesce(file_size, 0) as s, cast(sum(coalesce(file_size, 0)) over"
        " (order by coalesce(file_size, -1) desc, id desc rows unbounded preceding) as bigint) as running_bytes from assets)"
        " select id, running_bytes from r where running_bytes - s < 50000000000",
    ),
)
def recoverable_target(spark, sf):
    order = REGISTRY().ranking("largest").order()
    return paging.recoverable_target(M.assets(spark, sf), order, 50000000000).select("id", "running_bytes")


# --- joins ---------------------------------------------------------------------------------


@query(
    "enrich_assets",
    with_tables(
        ["assets", "quality", "content"],
        "select a.id, q.blur_score, q.quality_score, q.brightness_score, q.face_count, c.is_screenshot"
        " from assets a left join quality q on q.id = a.id left join content c on c.id = a.id",
    ),
)
def enrich_assets(spark, sf):
    joined = insights.enrich(M.assets(spark, sf), M.quality(spark, sf), M.content(spark, sf))
    return joined.select("id", "blur_score", "quality_score", "brightness_score", "face_count", "is_screenshot")


MEMBERS = f"{M.asset_id('event_id')} AS id"


@query(
    "selection_page",
    with_tables(
        ["assets"],
        f"+ m as (select distinct user_id, {MEMBERS} from events)"
        " select a.id, a.created_at from m join assets a on a.id = m.id where m.user_id = 7"
        " order by a.created_at desc, a.id desc limit 5 offset 1",
    ),
)
def selection_page(spark, sf):
    members = M.table(spark, sf, "events").selectExpr("cast(user_id as string) AS selection_id", MEMBERS)
    chosen = selections.selection_members(members, M.assets(spark, sf), "7")
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return paging.offset_page(chosen, order, 1, 5).select("id", "created_at")


# --- candidates and selections -------------------------------------------------------------

CANDIDATE = specs.all_specs(specs.any_spec(BLURRY, BIG, SHOT), specs.not_spec(FAVORITE), OLD)
CANDIDATE_SQL = (
    "+ c as (select id, file_size, coalesce(is_screenshot, false) as r1, coalesce(blur_score, 0) >= 0.55 as r2,"
    f" coalesce(file_size, 0) >= 200000000 as r3, created_at < {MIDDLE} as r4 from plain where"
    f" (blur_score >= 0.55 or file_size >= 200000000 or coalesce(is_screenshot, false)) and not favorite and created_at < {MIDDLE})"
)


@query(
    "cleanup_candidates",
    with_tables(
        ["plain"],
        CANDIDATE_SQL
        + " select id, file_size as recoverable_bytes, concat_ws(',', case when r1 then 'screenshot' end,"
        " case when r2 then 'blurry' end, case when r3 then 'large-media' end, case when r4 then 'old-media' end) as reasons,"
        " round(least(0.99::double, 0.5::double + (r1::int + r2::int + r3::int + r4::int) * 0.1::double), 6) as confidence from c",
    ),
)
def cleanup_candidates(spark, sf):
    found = candidates.cleanup_candidates(M.catalog(spark, sf), CANDIDATE)
    return found.withColumns({"reasons": F.concat_ws(",", "reasons"), "confidence": F.round("confidence", 6)})


@query(
    "reason_totals",
    with_tables(
        ["plain"],
        CANDIDATE_SQL
        + ", x as (select 'screenshot' as reason, file_size from c where r1 union all select 'blurry', file_size from c"
        " where r2 union all select 'large-media', file_size from c where r3 union all select 'old-media', file_size from c where r4)"
        " select reason, count(*) as candidates, cast(coalesce(sum(file_size), 0) as bigint) as bytes from x group by reason",
    ),
)
def reason_totals(spark, sf):
    return candidates.reason_totals(candidates.cleanup_candidates(M.catalog(spark, sf), CANDIDATE))


REQUEST = [
    "'s' || cast(user_id as string) AS selection_id",
    "case when user_id % 10 = 0 then '  ' else '  trip ' || cast(user_id as string) || ' ' end AS name",
    "case when user_id % 3 = 0 then '{{broken' else '{\"type\":\"and\",\"children\":[]}' end AS spec",
    f"case when event_type = 'error' then '' else {M.asset_id('event_id')} end AS id",
]
REQUESTS_SQL = f"r as (select {', '.join(REQUEST)} from events), ok as (select * from r where id <> '' and trim(name) <> '')"


def _saved(spark, sf):
    requests = M.table(spark, sf, "events").selectExpr(*REQUEST)
    return selections.save_selections(requests, M.assets(spark, sf), NOW)


@query(
    "save_selection",
    with_tables(
        ["assets"],
        f"+ {REQUESTS_SQL} select distinct selection_id, id, trim(name) as name from ok where id in (select id from assets)",
    ),
)
def save_selection(spark, sf):
    headers, members = _saved(spark, sf)
    return members.join(headers.select("selection_id", "name"), "selection_id").select("selection_id", "id", "name")


@query(
    "save_selection_rejects",
    f"with r as (select {', '.join(REQUEST)} from events), j as (select selection_id, bool_or(trim(name) <> '') as named,"
    " bool_or(trim(name) <> '' and id <> '') as filled from r group by selection_id) select selection_id,"
    " case when named then 'EMPTY_SELECTION' else 'INVALID_NAME' end as reason from j where not filled",
)
def save_selection_rejects(spark, sf):
    return selections.selection_rejects(M.table(spark, sf, "events").selectExpr(*REQUEST))


LISTED_SQL = (
    f"+ {REQUESTS_SQL}, h as (select distinct selection_id, trim(name) as name, case when spec like '{{{{broken' then null"
    " else spec end as spec from ok), m as (select distinct selection_id, id from ok where id in (select id from assets)),"
    " n as (select selection_id, count(*) as member_count, min(id) as first_id, max(id) as last_id from m group by 1)"
)


@query(
    "list_selections",
    with_tables(
        ["assets"],
        LISTED_SQL + " select h.selection_id, h.name, h.spec, coalesce(n.member_count, 0) as member_count, n.first_id,"
        " n.last_id from h left join n on n.selection_id = h.selection_id",
    ),
)
def list_selections(spark, sf):
    return selections.list_selections(*_saved(spark, sf)).drop("created_at", "updated_at")


@query(
    "delete_selection",
    with_tables(
        ["assets"],
        LISTED_SQL
        + ", g as (select 's' || cast(l_suppkey as string) as selection_id from lineitem group by 1)"
        " select 'header' as part, selection_id, count(*) as n from h where selection_id not in (select selection_id from g) group by 2"
        " union all select 'member', selection_id, count(*) from m where selection_id not in (select selection_id from g) group by 2"
        " union all select case when selection_id in (select selection_id from h) then 'existed' else 'unknown' end,"
        " selection_id, 1 from g",
    ),
)
def delete_selection(spark, sf):
    ids = M.table(spark, sf, "lineitem").selectExpr("'s' || cast(l_suppkey as string) AS selection_id")
    headers, members, report = selections.delete_selections(*_saved(spark, sf), ids)
    count = F.count(F.lit(1)).alias("n")
    existed = F.when(F.col("existed"), "existed").otherwise("unknown").alias("part")
    return (
        headers.groupBy("selection_id").agg(count).select(F.lit("header").alias("part"), "selection_id", "n")
        .unionByName(
            members.groupBy("selection_id").agg(count).select(F.lit("member").alias("part"), "selection_id", "n")
        )
        .unionByName(report.select(existed, "selection_id", F.lit(1).cast("bigint").alias("n")))
    )


# Thousands of stored specs, one for each customer, in seven forms: NOT, OR, empty trees and unknown values included.
_VALUE = "cast(c_custkey * 7919 % 300 * 86400000 + 1704067200000 as string)"
_SIZE = "cast(c_custkey * 104729 % 2000 * 100000 as string)"
_SCORE = "cast(cast(c_custkey % 101 as double) / 100 as string)"


def _and(*children: str) -> str:
    return f"'{{\"type\":\"and\",\"children\":[' || {" || ',' || ".join(children)} || ']}}'"


def _or(*children: str) -> str:
    return _and(*children).replace('"and"', '"or"')


def _not(child: str) -> str:
    return f"'{{\"type\":\"not\",\"child\":' || {child} || '}}'"


def _leaf(capability: str, field: str, value: str) -> str:
    text = _json(capability, "eq", field, "@")
    before, after = text.split("@")
    return f"'{before}' || {value} || '{after}'"


_DATE, _BIG = _leaf("query.date", "before", _VALUE), _leaf("metadata.core", "minFileSize", _SIZE)
_POOR, _SHOT = _leaf("quality.visual", "maxQuality", _SCORE), _leaf("content.screenshot", "screenshot", "'true'")
_BLUR, _FAVORITE = _leaf("quality.visual", "minBlur", _SCORE), _leaf("metadata.core", "favorite", "'true'")
_PHOTO, _WRITTEN = _leaf("metadata.core", "mediaTypes", "'[\"photo\"]'"), _leaf("content.document", "document", "'true'")
_WORDS = _leaf("text.ocr", "ocrTerms", "case when c_custkey % 2 = 0 then '[\"and the\",\"of\"]' else '[\"THÉ\"]' end")
FORMS = [
    (_and(_BIG, _not(_FAVORITE)), "file_size >= size and not favorite"),
    (_or(_DATE, _SHOT), "created_at < value or coalesce(is_screenshot, false)"),
    (_not(_or(_BLUR, _BIG)), "not (blur_score >= score or file_size >= size)"),
    ("'{\"type\":\"and\",\"children\":[]}'", "true"),
    (_and(_PHOTO, _or(_POOR, _not(_WRITTEN))), "media_type = 'photo' and (quality_score <= score or not has_text)"),
    (_and(_WORDS, _not(_BLUR)), "case when c_custkey % 2 = 0 then w1 else w2 end and not (blur_score >= score)"),
    ("'{\"type\":\"or\",\"children\":[]}'", "false"),
]
CUSTOMER_SPECS = "case c_custkey % 7 " + " ".join(f"when {k} then {form}" for k, (form, _) in enumerate(FORMS)) + " end"


@query(
    "bulk_match_many",
    with_tables(
        ["plain"],
        f"+ s as (select c_custkey, {_VALUE}::bigint as value, {_SIZE}::bigint as size, {_SCORE}::double as score from customer),"
        f" p as materialized (select *, coalesce({phrase_sql('ocr_text', 'and the')} and {phrase_sql('ocr_text', 'of')}, false) as w1,"
        f" coalesce({phrase_sql('ocr_text', 'the')}, false) as w2 from plain)"
        " select c_custkey as spec_id, count(*) as n, min(id) as first_id, max(id) as last_id,"
        " cast(sum(created_at // 86400000) as bigint) as days from s, p where case c_custkey % 7 "
        + " ".join(f"when {k} then ({condition})" for k, (_, condition) in enumerate(FORMS))
        + " end group by 1",
    ),
)
def bulk_match_many(spark, sf):
    """What each of thousands of stored specs finds; the plan is the same for any number of them."""
    stored = M.table(spark, sf, "customer").selectExpr("c_custkey AS spec_id", f"{CUSTOMER_SPECS} AS spec")
    catalog = M.catalog(spark, sf)
    days = F.floor(F.col("created_at") / 86400000)
    told = catalog.assets.groupBy("id").agg(F.count(F.lit(1)).alias("copies"), F.coalesce(F.sum(days), F.lit(0)).alias("days"))
    # Added up where they are found: matches are specs times assets by nature, and no row or element is made for one.
    found = spec_index.bulk_match_many(catalog, stored, told=told, totals=["copies", "days"])
    counted = found.withColumnRenamed("copies", "n")
    return counted.repartition("spec_id").groupBy("spec_id").agg(
        F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("days").alias("days")
    )


# Providers that bring a table of their own: labels answer the fields quality and toxic of a capability of theirs.
def _number_equals(field, value):
    return F.col({"quality": "quality", "toxic": "toxic"}[field]) == value if field in ("quality", "toxic") else None


def _plugged(spark, sf) -> Resolver:
    marks = M.table(spark, sf, "labels").selectExpr(f"{M.ID.replace(' AS id', ' AS asset')}", "quality", "toxic")
    both = (("quality", "number"), ("toxic", "number"))
    found = default_resolver()
    found.register(Capability("label.review", dependencies=("metadata.core",)))
    found.add_provider("label.review", Provider("better", both, priority=9, missing="MISSING_MODEL"))
    found.add_provider("label.review", Provider("labels", both, _number_equals, marks, "asset", ("quality", "toxic")))
    found.register(Capability("label.other", fallbacks=("label.none", "label.review")))
    found.add_provider("visual.labels", Provider("guess", (("labels", "strings"),), degraded=True))
    return found


REVIEWED = specs.all_specs(
    leaf("label.review", "eq", {"field": "quality", "value": 1}),
    specs.not_spec(leaf("label.other", "eq", {"field": "toxic", "value": 1})),
)


@query(
    "plugin_predicate",
    with_tables(["assets"], "select a.id from assets a join labels l using (doc_id) where l.quality = 1 and not l.toxic = 1"),
)
def plugin_predicate(spark, sf):
    """A spec over a plugged-in table: one leaf by its provider, one by a fallback to it."""
    return apply_resolved(M.assets(spark, sf), REVIEWED, _plugged(spark, sf)).select("id")


PLUGGED = (
    "case doc_id % 3 when 0 then '"
    + _json("label.review", "eq", "quality", "1")
    + "' when 1 then '"
    + _json("label.other", "eq", "toxic", "0")
    + "' else '"
    + _json("visual.labels", "containsAny", "labels", '["beach"]')
    + "' end"
)


@query(
    "plugin_coverage",
    "select doc_id as spec_id, case when doc_id % 3 = 0 then 1::bigint else 0 end as available,"
    " case when doc_id % 3 = 0 then 0::bigint else 1 end as degraded, 0::bigint as unavailable,"
    " case when doc_id % 3 = 0 then 'complete' else 'degraded' end as status from documents"
    " union all select -1 - doc_id, 0, 0, 1, 'unavailable' from documents",
)
def plugin_coverage(spark, sf):
    """The resolver that runs plugged-in predicates also says which stored specs can run."""
    documents = M.table(spark, sf, "documents")
    stored = documents.selectExpr("doc_id AS spec_id", f"{PLUGGED} AS spec")
    odd = _json("label.review", "eq", "people", '["a"]')
    refused = documents.selectExpr("-1 - doc_id AS spec_id", f"'{odd}' AS spec")
    return spec_tables.spec_coverage(stored.unionByName(refused), resolver=_plugged(spark, sf))


@query(
    "deep_page",
    with_tables(
        ["assets"],
        "select id, position from (select id, row_number() over (order by created_at desc, id desc) as position, count(*) over () as n"
        " from assets) where position > n // 2 and position <= n // 2 + 150",
    ),
)
def deep_page(spark, sf):
    """A page from the middle of all assets: only the slices that hold it are sorted."""
    assets = M.assets(spark, sf)
    return paging.deep_page(assets, [F.desc("created_at"), F.desc("id")], assets.count() // 2, 150).select("id", "position")
