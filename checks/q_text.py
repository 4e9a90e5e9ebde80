"""Text folding, tokens, prompt tagging, calendar phrases."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import model as M
from checks.register import query
from lumenlake.functions import rules as R
from lumenlake.functions import tagging, text
from lumenlake.functions.calendar import calendar_range
from lumenlake.operators import phrase_index
from lumenlake.plans.parallel import spread_rows
from lumenlake.session import scratch_path

STRIPPED = "trim(regexp_replace(lower(strip_accents({c})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query("fold_text", "select doc_id, lower(strip_accents(text)) as folded from documents")
def fold_text(spark, sf):
    return M.written(spark, sf).select("doc_id", text.fold(F.col("text")).alias("folded"))


@query(
    "clean_text",
    "select conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) as cleaned,"
    " length(trim(text)) between 1 and 500 as valid from conversations",
)
def clean_text(spark, sf):
    return M.table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        text.clean_text(F.col("text")).alias("cleaned"),
        text.valid_prompt(F.col("text")).alias("valid"),
    )


@query(
    "token_index",
    "select distinct doc_id, unnest(string_split(" + STRIPPED.format(c="text") + ", ' ')) as token from documents",
)
def token_index(spark, sf):
    return text.build_token_index(M.written(spark, sf), "doc_id", "text")


@query(
    "indexed_matches",
    "with t as (select distinct doc_id, unnest(string_split(" + STRIPPED.format(c="text") + ", ' ')) as token from documents)"
    " select doc_id from t where token in ('and', 'the', 'of') group by doc_id having count(*) = 3",
)
def indexed_matches(spark, sf):
    index = text.build_token_index(M.written(spark, sf), "doc_id", "text")
    return text.indexed_matches(index, ["and the", "OF"], "doc_id")


# --- one rule at a time, over the prompt log -------------------------------------------------

FOLDED = (
    f"f as (select event_id, {M.clean_prompt_sql('event_id')} as prompt, ts as now,"
    f" lower(strip_accents({M.clean_prompt_sql('event_id')})) as t from events)"
)


def _folded(spark, sf):
    cleaned = M.prompts(spark, sf).withColumn("prompt", text.clean_text(F.col("prompt")))
    return cleaned.withColumn("t", text.fold(F.col("prompt")))


def has(pattern: str, column: str = "t") -> str:
    return f"regexp_matches({column}, '{pattern}')"


def without(pattern: str, column: str = "t") -> str:
    return f"regexp_replace({column}, '{pattern}', '', 'g')"


def in_order(source: str, rules, prefix: str) -> tuple[str, str]:
    """CTEs that apply rules one after the other on column t; returns (ctes, last name)."""
    ctes, last = [], source
    for i, (name, pattern) in enumerate(rules):
        step = f"{prefix}{i}"
        ctes.append(
            f"{step} as (select * exclude (t), {has(pattern)} as {prefix}_{name}, {without(pattern)} as t from {last})"
        )
        last = step
    return ", ".join(ctes), last


ALIAS_CTES, ALIAS_LAST = in_order("f", R.ALIASES, "al")
ALIAS_COLUMNS = {
    "screenshot": "case when al_screenshot then true end",
    "favorite": "case when al_favorite then true end",
    "duplicate": "case when al_duplicate then true end",
    "similar": "case when al_similar then true end",
    "min_blur": "case when al_blurry then 0.55::double end",
    "media_types": "nullif(concat_ws(',', case when al_video then 'video' end, case when al_photo then 'photo' end), '')",
    "label": "case when al_work then 'work' when al_beach then 'beach' end",
}
ALIAS_SQL = ", ".join(f"{v} as {k}" for k, v in ALIAS_COLUMNS.items())


def _joined(df, *columns):
    for name in columns:
        df = df.withColumn(name, F.when(F.size(name) > 0, F.concat_ws(",", name)))
    return df


@query(
    "tag_aliases",
    f"with {FOLDED}, {ALIAS_CTES} select event_id, {ALIAS_SQL},"
    f" case when al_large then 524288000::bigint end as min_file_size, t from {ALIAS_LAST}",
)
def tag_aliases(spark, sf):
    tagged = tagging.tag_aliases(_folded(spark, sf).drop("prompt", "now"), "t")
    return _joined(tagged, "media_types")


CONCEPT_CTES, CONCEPT_LAST = in_order("f", R.CONCEPTS, "co")
CONCEPT_LIST = "concat_ws(',', " + ", ".join(f"case when co_{n} then '{n}' end" for n, _ in R.CONCEPTS) + ")"


@query(
    "tag_concepts",
    f"with {FOLDED}, {CONCEPT_CTES} select event_id, nullif({CONCEPT_LIST}, '') as concepts, t from {CONCEPT_LAST}",
)
def tag_concepts(spark, sf):
    tagged = tagging.tag_concepts(_folded(spark, sf).drop("prompt", "now"), "t")
    return _joined(tagged, "concepts")


ACTION_SQL = "case " + " ".join(f"when {has(p)} then '{n}'" for n, p in R.ACTIONS) + " else 'find' end"
OPERATION_SQL = (
    "case "
    + " ".join(f"when {' and '.join(has(p) for p in ps)} then '{n}'" for n, ps in R.OPERATIONS)
    + " else 'new' end"
)


@query("tag_action", f"with {FOLDED} select event_id, {ACTION_SQL} as action from f")
def tag_action(spark, sf):
    return _folded(spark, sf).select("event_id", tagging.tag_action(F.col("t")).alias("action"))


@query("tag_operation", f"with {FOLDED} select event_id, {OPERATION_SQL} as operation from f")
def tag_operation(spark, sf):
    return _folded(spark, sf).select("event_id", tagging.tag_operation(F.col("t")).alias("operation"))


@query(
    "extract_quoted",
    "select event_id, array_to_string(regexp_extract_all(props, '[\"“]([^\"”]+)[\"”]', 1)[1:5], ',') as terms from events",
)
def extract_quoted(spark, sf):
    events = M.table(spark, sf, "events")
    return events.select("event_id", F.concat_ws(",", tagging.extract_quoted(F.col("props"), R.MAX_TERMS)).alias("terms"))


@query(
    "extract_quoted_all",
    "select event_id, array_to_string(regexp_extract_all(props, '[\"“]([^\"”]+)[\"”]', 1), ',') as terms from events",
)
def extract_quoted_all(spark, sf):
    events = M.table(spark, sf, "events")
    return events.select("event_id", F.concat_ws(",", tagging.extract_quoted(F.col("props"))).alias("terms"))


BYTES_SQL = (
    f"cast(floor(cast(replace(regexp_extract_all(t, '{R.SIZE}', 1)[-1], ',', '.') as double)"
    f" * case when starts_with(regexp_extract_all(t, '{R.SIZE}', 2)[-1], 'g') then 1073741824.0::double"
    " else 1048576.0::double end + 0.5) as bigint)"
)
SIZED = "case user_id % 3 when 0 then 'free ' else '' end || cast(value as string) || case when user_id % 2 = 0 then 'GB' else ' mib' end"


@query(
    "extract_size",
    f"with e as (select event_id, lower({SIZED}) as t from events)"
    f" select event_id, {BYTES_SQL} as bytes, {has(R.FREE_WORD)} as target from e",
)
def extract_size(spark, sf):
    sized = M.table(spark, sf, "events").selectExpr("event_id", f"lower({SIZED}) AS t")
    return sized.select(
        "event_id",
        tagging.size_bytes(F.col("t")).alias("bytes"),
        tagging.wants_space(F.col("t")).alias("target"),
    )


@query(
    "ambiguity_flag",
    "with d as (select doc_id, lower(strip_accents(text)) as t from documents)"
    f" select doc_id, {has(R.AMBIGUITY, without(R.EXCLUDE_FAVORITES))} as ambiguous, {has(R.EXCLUDE_FAVORITES)}"
    " as excludes_favorites from d",
)
def ambiguity_flag(spark, sf):
    folded = text.fold(F.col("text"))
    documents = M.written(spark, sf).select("doc_id", folded.alias("t"))
    return documents.select(
        "doc_id",
        tagging.ambiguity_flag(F.col("t")).alias("ambiguous"),
        tagging.exclusion_flag(F.col("t")).alias("excludes_favorites"),
    )


RESIDUAL_SQL = f"trim(regexp_replace({without(R.FILLERS)}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
WORDS_SQL = "case when residual = '' then 0 else len(string_split(residual, ' ')) end"


@query(
    "residual_terms",
    f"with {FOLDED}, r as (select event_id, {RESIDUAL_SQL} as residual from f)"
    f" select event_id, residual, cast({WORDS_SQL} as int) as words from r",
)
def residual_terms(spark, sf):
    left = _folded(spark, sf).select("event_id", tagging.residual_terms(F.col("t")).alias("residual"))
    return left.withColumn("words", tagging.word_count(F.col("residual")).cast("int"))


EVIDENCE_SQL = "concat_ws(',', " + ", ".join(f"case when {has(p)} then '{n}' end" for n, p in R.MATCHERS) + ")"


@query("evidence", f"with {FOLDED} select event_id, {EVIDENCE_SQL} as evidence from f")
def evidence(spark, sf):
    fired = tagging.evidence(F.col("t"))
    return _folded(spark, sf).select("event_id", F.concat_ws(",", fired).alias("evidence"))


# --- calendar ------------------------------------------------------------------------------


def _english_sql(column: str) -> str:
    for pattern, words in R.CALENDAR_WORDS:
        replacement = words.replace("{", "\\").replace("}", "")
        column = f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"
    return column


def _day_sql(phrase: str) -> str:
    pattern = f"{R.AMOUNT}\\s+{R.UNIT}\\s+ago"
    word = f"regexp_extract({phrase}, '{pattern}', 1)"
    numbers = " ".join(f"when '{w}' then {n}" for w, n in R.NUMBER_WORDS.items())
    amount = f"(case {word} {numbers} else try_cast({word} as int) end)"
    unit = f"regexp_extract({phrase}, '{pattern}', 2)"
    named = f"regexp_extract({phrase}, '({'|'.join(R.MONTHS)})', 1)"
    number = f"coalesce(nullif(regexp_extract({phrase}, '\\b(\\d{{1,2}})\\b', 1), ''), '1')"
    listed = ", ".join(f"'{m}'" for m in R.MONTHS)
    month = f"lpad(list_position([{listed}], {named})::varchar, 2, '0')"
    return (
        f"case when {phrase} = 'today' then today when {phrase} = 'yesterday' then today - 1"
        f" when regexp_full_match({phrase}, '{R.ISO_DAY}') then try_cast({phrase} as date)"
        f" when {named} <> '' then try_cast(regexp_extract({phrase}, '(\\d{{4}})$', 1) || '-' || {month} || '-' || lpad({number}, 2, '0') as date)"
        f" when starts_with({unit}, 'day') then today - {amount} when starts_with({unit}, 'week') then today - 7 * {amount}"
        f" when starts_with({unit}, 'month') then cast(today - to_months({amount}) as date)"
        f" when starts_with({unit}, 'year') then cast(today - to_years({amount}) as date) end"
    )


def _ms(day: str) -> str:
    return f"epoch_ms(cast({day} as timestamp))"


def calendar_ctes(source: str) -> str:
    """CTEs from a table with columns t and now to ``dated`` with bounds, flag and remaining text in t."""
    once = lambda pattern, column="t": f"regexp_replace({column}, '{pattern}', '')"
    return (
        f"e1 as (select * exclude (t), {_english_sql('t')} as t, cast(now as date) as today from {source}),"
        f" e2 as (select *, regexp_extract(t, '{R.YEAR_BOUND}', 2) as yr, regexp_extract(t, '{R.YEAR_BOUND}', 1) as side,"
        f" regexp_extract(t, '{R.PERIOD}', 1) as period, {has(R.ROLLING)} as rolling,"
        f" regexp_replace(t, '{R.ROLLING}', '\\1 \\2 ago') as d from e1),"
        f" e3 as (select *, regexp_extract_all(d, '{R.DAY_PHRASE}', 1) as ph,"
        f" regexp_extract(regexp_extract(d, '(?s)^(.*?){R.DAY_PHRASE}', 1), '\\b(before|after)\\s*$', 1) as pre from e2),"
        f" e4 as (select *, {_day_sql('ph[1]')} as d1, {_day_sql('ph[2]')} as d2,"
        " case when yr <> '' then side || ' year' when period <> '' then period when len(ph) > 0 and pre <> '' then pre || ' day'"
        " when len(ph) > 0 and rolling then 'rolling' when len(ph) > 2 then 'many' when len(ph) > 0 then 'days'"
        f" when {has(R.OLD)} then 'old' else 'none' end as kind, make_date(cast(nullif(yr, '') as int), 1, 1) as jan,"
        f" {without(R.DAY_PHRASE, 'd')} as nodays from e3),"
        " dated as (select * exclude (t, today, yr, side, period, rolling, d, ph, pre, d1, d2, kind, jan, nodays),"
        f" case kind when 'after year' then {_ms('jan + interval 1 year')} - 1"
        f" when 'last week' then {_ms("date_trunc('week', today) - interval 7 day")} - 1"
        f" when 'last month' then {_ms("date_trunc('month', today) - interval 1 month")} - 1"
        f" when 'last year' then {_ms("date_trunc('year', today) - interval 1 year")} - 1"
        f" when 'this year' then {_ms("date_trunc('year', today)")} - 1 when 'after day' then {_ms('d1 + 1')} - 1"
        f" when 'rolling' then {_ms('d1')} - 1 when 'days' then case when len(ph) = 1 or d2 is not null then {_ms('d1')} - 1 end end as after_ms,"
        f" case kind when 'before year' then {_ms('jan')} when 'last week' then {_ms("date_trunc('week', today)")}"
        f" when 'last month' then {_ms("date_trunc('month', today)")} when 'last year' then {_ms("date_trunc('year', today)")}"
        f" when 'this year' then epoch_us(now) // 1000 + 1 when 'rolling' then case when d1 is not null then epoch_us(now) // 1000 + 1 end"
        f" when 'before day' then {_ms('d1')} when 'days' then case when len(ph) = 1 or d2 is not null then {_ms('coalesce(d2, d1) + 1')} end"
        f" when 'old' then {_ms('make_date(year(today) - 1, month(today), 1) + cast(day(today) - 1 as int)')}"
        f" + epoch_us(now) // 1000 - {_ms('today')} end as before_ms,"
        f" kind = 'many' or (kind in ('before day', 'after day', 'rolling', 'days') and (d1 is null or (kind = 'days' and len(ph) > 1 and d2 is null)))"
        f" or (kind = 'none' and {has(R.OPEN_DATE, 'd')}) as date_ambiguous,"
        f" case when kind like '% year' and yr <> '' then {once(R.YEAR_BOUND)} when period <> '' and yr = '' then {once(R.PERIOD)}"
        f" when kind = 'before day' then {once('\\bbefore\\b', 'nodays')} when kind = 'after day' then {once('\\bafter\\b', 'nodays')}"
        f" when kind = 'days' then {without(R.RANGE_WORDS, 'nodays')} when kind in ('rolling', 'many') then nodays"
        f" when kind = 'old' then {once(R.OLD)} else d end as t from e4)"
    )


PHRASE = M.pick(M.DATES, "o_orderkey", 1)
PHRASE_SQL = f"o as (select o_orderkey, lower(strip_accents({PHRASE})) as t, o_orderdate as now from orders)"


@query(
    "calendar_range",
    f"with {PHRASE_SQL}, {calendar_ctes('o')} select o_orderkey, after_ms, before_ms, date_ambiguous, t as date_rest from dated",
)
def calendar_ranges(spark, sf):
    orders = spread_rows(M.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))
    phrases = orders.selectExpr("o_orderkey", f"{PHRASE} AS phrase", "o_orderdate AS now")
    folded = phrases.withColumn("t", text.fold(F.col("phrase")))
    return calendar_range(folded, "t", "now").select(
        "o_orderkey", "after_ms", "before_ms", "date_ambiguous", "date_rest"
    )


NAMED_DAYS = (
    "photos from march 2024|2024-05-01|before january 2023|after 2 february 2022|between 5 may 2023 and june 7, 2023"
    "|fotos de marco 2024|31 february 2024|2023-13-40|videos before 7 dezembro 2021|july 4 1999|may I see"
    "|between 2023-01-01 and yesterday|2 enero 2020 e 3 marzo 2021|between 1 may 2023 and 31 june 2023"
)
NAMED = M.pick(NAMED_DAYS, "o_orderkey", 1)


@query(
    "calendar_months",
    f"with o as (select o_orderkey, lower(strip_accents({NAMED})) as t, o_orderdate as now from orders),"
    f" {calendar_ctes('o')} select o_orderkey, after_ms, before_ms, date_ambiguous, t as date_rest from dated",
)
def calendar_months(spark, sf):
    """Named months and absolute days, possible and impossible ones."""
    orders = spread_rows(M.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))
    phrases = orders.selectExpr("o_orderkey", f"{NAMED} AS phrase", "o_orderdate AS now")
    folded = phrases.withColumn("t", text.fold(F.col("phrase")))
    return calendar_range(folded, "t", "now").select("o_orderkey", "after_ms", "before_ms", "date_ambiguous", "date_rest")


# --- the whole row -------------------------------------------------------------------------


def intent_ctes(first: str) -> str:
    """CTEs from ``first`` (a CTE named f with prompt, now, t) to ``intent``."""
    action_strip = "case action " + " ".join(f"when '{n}' then {without(p)}" for n, p in R.ACTIONS) + " else t end"
    concept_ctes, concept_last = in_order("dated", R.CONCEPTS, "co")
    alias_ctes, alias_last = in_order(concept_last, R.ALIASES, "al")
    return (
        f"{first}, i1 as (select *, t as folded, {EVIDENCE_SQL} as evidence,"
        f" regexp_extract_all(t, '{R.QUOTED}', 1) as quoted from f),"
        f" i2 as (select * exclude (t), {without(R.QUOTED)} as t from i1),"
        f" i3 as (select * exclude (t), {has(R.EXCLUDE_FAVORITES)} as noted, {without(R.EXCLUDE_FAVORITES)} as t from i2),"
        f" i4 as (select *, {has(R.AMBIGUITY)} as ambiguous, {OPERATION_SQL} as operation, {ACTION_SQL} as action from i3),"
        f" i5 as (select * exclude (t), {action_strip} as t from i4),"
        f" i6 as (select * exclude (t), {has(R.CLEANUP)} or action = 'delete' as clean1, {without(R.CLEANUP)} as t from i5),"
        f" i7 as (select * exclude (t), {has(R.FREE_SPACE)} as free1, {without(R.FREE_SPACE)} as t from i6),"
        f" i8 as (select * exclude (t), {BYTES_SQL} as bytes, {without(R.SIZE)} as t from i7),"
        f" i9 as (select *, case when {has(R.FREE_WORD, 'folded')} then bytes end as target_bytes,"
        f" case when {has(R.FREE_WORD, 'folded')} then null else bytes end as explicit_size from i8),"
        f" {calendar_ctes('i9')}, {concept_ctes}, {alias_ctes},"
        f" k1 as (select *, {ALIAS_SQL}, {CONCEPT_LIST} as concepts, {has(R.LARGEST)} as largest,"
        " coalesce(explicit_size, case when al_large then 524288000::bigint end) as min_file_size,"
        " clean1 or free1 or target_bytes is not null as cleanup, free1 or target_bytes is not null as free_space,"
        f" action = 'delete' as destructive from {alias_last}),"
        f" k2 as (select * exclude (t), {without(R.LARGEST)} as t from k1),"
        f" k3 as (select *, {RESIDUAL_SQL} as residual from k2), k4 as (select *, {WORDS_SQL} as words from k3),"
        " k5 as (select *, words = 1 and not ambiguous and not date_ambiguous as single from k4),"
        " k6 as (select *, nullif(array_to_string(case when single then list_append(quoted, residual) else quoted end[1:5], ','), '')"
        " as terms from k5),"
        " k7 as (select *, after_ms is not null or before_ms is not null or media_types is not null or screenshot is not null"
        " or favorite is not null or duplicate is not null or \"similar\" is not null or min_blur is not null"
        " or min_file_size is not null or label is not null or terms is not null as constrained from k6),"
        " k8 as (select *, ambiguous or date_ambiguous or words > 1 or not (constrained or cleanup or concepts <> '')"
        " as unresolved from k7),"
        " intent as (select *, case when unresolved then 0.35::double when single then 0.85::double else 0.96::double end"
        " as confidence, noted or cleanup as exclude_favorites from k8)"
    ).replace("else quoted end[1:5]", "else quoted end)[1:5]").replace("array_to_string(case when single", "array_to_string((case when single")


INTENT = intent_ctes(FOLDED)
INTENT_COLUMNS = (
    "action operation ambiguous exclude_favorites after_ms before_ms date_ambiguous media_types screenshot favorite"
    " duplicate similar min_blur min_file_size label terms concepts cleanup free_space target_bytes largest residual"
    " unresolved confidence destructive evidence"
).split()


def listed(columns) -> str:
    """Column list for the SQL; "similar" is a reserved word there."""
    return ", ".join(f'"{c}"' for c in columns)


def _intents(spark, sf):
    return tagging.classify_prompts(M.prompts(spark, sf), "prompt", "now", most_terms=R.MAX_TERMS)


def _flat(df):
    return df.withColumns(
        {
            "concepts": F.concat_ws(",", "concepts"),
            "evidence": F.concat_ws(",", "evidence"),
            "media_types": F.when(F.col("media_types").isNotNull(), F.concat_ws(",", "media_types")),
            "terms": F.when(F.col("terms").isNotNull(), F.concat_ws(",", "terms")),
        }
    )


@query("classify_prompts", f"with {INTENT} select event_id, {listed(INTENT_COLUMNS)} from intent")
def classify_prompts(spark, sf):
    return _flat(_intents(spark, sf)).select("event_id", *INTENT_COLUMNS)


@query(
    "score_confidence",
    f"with {INTENT} select confidence, unresolved, count(*) as prompts from intent group by 1, 2",
)
def score_confidence(spark, sf):
    return (
        _intents(spark, sf).groupBy("confidence", "unresolved").agg(F.count(F.lit(1)).alias("prompts"))
    )


def status_sql(matched: str = "false") -> str:
    return (
        f"p1 as (select *, (regexp_matches(trim(prompt), '{R.RAW_NEGATION}') and not regexp_matches(trim(prompt),"
        f" '{R.RAW_FAVORITES}')) or (unresolved and not {matched}) as unclear, concat_ws(',',"
        " case when best_shot then 'bestShotUnavailable' end,"
        " case when action in ('organize', 'compare', 'keep') then 'actionUnavailable' end) as blocking, concat_ws(',',"
        " case when cleanup then 'cleanupRankingUnavailable' end,"
        " case when free_space or target_bytes is not null then 'spaceTargetUnavailable' end) as advisory from merged),"
        " p2 as (select *, concepts <> '' or blocking <> '' as blocked from p1),"
        " planned as (select *, case when unclear then 'clarification' when blocked then 'unsupported'"
        " when not constrained and (cleanup or free_space) then 'clarification' else 'ready' end as status,"
        " case when unclear then '' when blocked then blocking else advisory end as notices from p2)"
    )


@query(
    "plan_status",
    f"with {INTENT}, merged as (select *, false as best_shot from intent), {status_sql()}"
    " select event_id, status, notices from planned",
)
def plan_status(spark, sf):
    intents = tagging.classify_prompts(M.prompts(spark, sf), "prompt", "now", most_terms=R.MAX_TERMS)
    cleaned = intents.withColumn("prompt", F.trim("prompt"))
    planned = tagging.plan_status(cleaned, "prompt")
    return planned.select("event_id", "status", F.concat_ws(",", "notices").alias("notices"))


RANKINGS = "newest|largest|least-important|most-redundant||worst-quality"


@query(
    "planned_action",
    f"with {INTENT}, merged as (select *, false as best_shot, nullif({M.pick(RANKINGS, 'event_id', 1)}, '') as ranking from intent),"
    f" {status_sql()}, r as (select *, case when status = 'ready' and ranking in ('least-important', 'most-redundant')"
    " then 'unsupported' else status end as decided from planned)"
    " select event_id, decided as status, notices, case when decided = 'ready' then case when action = 'delete' then 'trash'"
    " when action in ('favorite', 'unfavorite', 'share') then action end end as planned_action,"
    " coalesce(decided = 'ready' and action in ('delete', 'favorite', 'unfavorite', 'share'), false) as requires_confirmation from r",
)
def planned_action(spark, sf):
    """What a ready plan does, after a confirmation; rankings that can't run make it unsupported."""
    intents = tagging.classify_prompts(M.prompts(spark, sf), "prompt", "now", most_terms=R.MAX_TERMS)
    ranked = intents.withColumn("ranking", F.expr(f"nullif({M.pick(RANKINGS, 'event_id', 1)}, '')"))
    planned = tagging.plan_status(ranked.withColumn("prompt", F.trim("prompt")), "prompt")
    notices = F.concat_ws(",", "notices").alias("notices")
    return planned.select("event_id", "status", notices, "planned_action", "requires_confirmation")


INDEXED_TERMS = ["and the", "OF", "thé"]


@query(
    "indexed_phrases",
    "with t as (select doc_id, ' ' || " + STRIPPED.format(c="text") + " || ' ' as padded from documents)"
    " select doc_id from t where contains(padded, ' and the ') and contains(padded, ' of ') and contains(padded, ' the ')",
)
def indexed_phrases(spark, sf):
    return phrase_index.phrase_matches(_phrase_index(spark, sf), INDEXED_TERMS, "doc_id")


@query(
    "phrase_postings",
    "with w as (select doc_id, string_split(" + STRIPPED.format(c="text") + ", ' ') as t from documents where text is not null),"
    " p as (select doc_id, unnest(t) as token, unnest(range(len(t))) as place from w)"
    " select token, count(distinct doc_id) as texts, count(*) as occurrences, sum(place)::bigint as places"
    " from p where token <> '' group by token",
)
def phrase_postings(spark, sf):
    index = _phrase_index(spark, sf)
    sizes = F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, e: a + F.size(e["positions"]))
    summed = F.aggregate(
        "entries", F.lit(0).cast("bigint"), lambda a, e: F.aggregate(e["positions"], a, lambda b, p: b + p)
    )
    return index.groupBy("token").agg(
        F.sum(F.size("entries")).alias("texts"), F.sum(sizes).alias("occurrences"), F.sum(summed).alias("places")
    )


def _phrase_index(spark, sf):
    """The index of all documents, written and read back: the plan of a search reads no text."""
    path, texts = scratch_path(spark, "phrase_index"), M.written(spark, sf)
    chunks = phrase_index.chunks_for(M.table(spark, sf, "documents"), "text")
    phrase_index.write_phrase_index(phrase_index.build_phrase_index(texts, chunks, "doc_id", "text"), path, chunks)
    return spark.read.parquet(path)
