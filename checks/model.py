"""The catalog model derived from the given tables.

The expressions are plain arithmetic on keys and run unchanged in Spark SQL and
in the checking engine. ``SQL`` holds the derived tables as CTEs for the checks;
the functions below build the same tables as DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.constants import BUCKET_DIGITS
from lumenlake.operators.clusters import asset_memberships, with_hashes
from lumenlake.operators.specs import Catalog
from lumenlake.plans.parallel import spread, spread_rows
from lumenlake.session import scratch_path

DAY = 86400000
START = 1704067200000
NOW = 1735689600000


def asset_id(key: str) -> str:
    return (
        f"(case when {key} % 10 = 9 then 'ios:' else 'android:' end) || cast({key} + 1 as string)"
        f" || (case when {key} % 5 = 0 then ':v' else ':p' end)"
    )


CREATED = f"({START} + (doc_id % 300) * {DAY})"
ANALYZED = f"({CREATED} + case when doc_id % 17 = 0 then 1800000 else 7200000 end)"
MODEL = (
    "case doc_id % 4 when 0 then 'android-fast-2' when 1 then 'android-heuristic-2'"
    " when 2 then 'ios-vision-1' else 'android-heuristic-1' end"
)
BLUR = "cast((doc_id * 37) % 101 as double) / 100"
ID = f"{asset_id('doc_id')} AS id"
VERSIONS = [
    "cast(1 as int) AS analysis_version",
    f"{MODEL} AS model_version",
    f"{ANALYZED} AS analyzed_at",
]
ASSETS = [
    ID,
    "case when doc_id % 5 = 0 then 'video' else 'photo' end AS media_type",
    f"{CREATED} AS created_at",
    f"case when doc_id % 7 = 0 then null else {CREATED} + 3600000 end AS modified_at",
    "cast(100 + doc_id % 50 * 10 as int) AS width",
    "cast(100 + doc_id % 30 * 10 as int) AS height",
    "case when doc_id % 5 = 0 then cast(doc_id % 600 as double) end AS duration",
    "case when doc_id % 13 = 0 then null else n_chars * 100000 end AS file_size",
    "doc_id % 11 = 0 AS favorite",
    "cast(null as double) AS latitude",
    "cast(null as double) AS longitude",
    f"{NOW} + (doc_id % 3) * 1000 AS indexed_at",
]


def other_assets(key: str, offset: int) -> list[str]:
    """Assets from a second table, so that upserts and change detection meet unknown keys."""
    return [
        f"'android:' || cast({key} + {offset} as string) || ':p' AS id",
        "'photo' AS media_type",
        f"{START} + {key} * {DAY} AS created_at",
        f"{START} + {key} * {DAY} + 1 AS modified_at",
        "cast(64 as int) AS width",
        "cast(64 as int) AS height",
        "cast(null as double) AS duration",
        "cast(4096 as bigint) AS file_size",
        "false AS favorite",
        "cast(null as double) AS latitude",
        "cast(null as double) AS longitude",
        f"cast({NOW} + 5000 as bigint) AS indexed_at",
    ]


PAGE_ASSETS = other_assets("page_id", 1000000000)
BENCHMARK_ASSETS = other_assets("item_id", 2000000000)
QUALITY = [
    ID,
    f"{BLUR} AS blur_score",
    f"case when doc_id % 23 = 0 then null else 1 - {BLUR} end AS quality_score",
    "case when doc_id % 9 = 0 then null else cast((doc_id * 7) % 100 as double) / 100 end AS brightness_score",
    "cast(case when doc_id % 4 = 0 then null else doc_id % 4 - 1 end as int) AS face_count",
    *VERSIONS,
]
CONTENT = [
    ID,
    "toxic = 1 AS is_screenshot",
    "case when doc_id % 6 = 0 then null else quality = 1 end AS is_document",
    "cast(null as boolean) AS is_meme",
    *VERSIONS,
]
TEXTS = [ID, "case when doc_id % 8 = 0 then '   ' else text end AS ocr_text", *VERSIONS]
CAPABILITY_NAMES = (
    "content.screenshot",
    "quality.visual",
    "similarity.perceptual",
    "duplicate.exact",
    "text.ocr",
)
CAPABILITIES = [
    ID,
    "name AS capability_id",
    "case when (doc_id + idx) % 19 = 0 then 'failed' else 'completed' end AS status",
    "cast(1 as int) AS analysis_version",
    "case when doc_id % 10 = 9 then (case when doc_id % 4 = 1 then 'ios-fast-1' else 'ios-vision-1' end)"
    " when doc_id % 6 = 0 then 'android-fast-2' when doc_id % 6 = 1 then 'android-heuristic-1'"
    " else 'android-heuristic-2' end AS model_version",
    f"{ANALYZED} AS analyzed_at",
    "case when (doc_id + idx) % 19 = 0 then 'FAILED' end AS error",
]
CAPABILITY_COUNT = "case when n_chars > 300 then 5 else 3 end"

# Prompts: one per event, built from phrase lists picked by coprime moduli.
VERBS = (
    "find|show me|delete|apague|select|review|keep|free up space|organize|compare|unfavorite|share"
    "|clean up|refine|also include|remove from|quero ver|mostre|limpar|"
)
NOUNS = (
    "blurry photos|screenshots|videos|fotos duplicadas|similar images|large videos|recibos|invoices"
    "|documentos|prints borrados|favoritas|beach photos|capturas de pantalla|\"tax 2020\" photos"
    "|qr codes|café|trabalho|vacation sunset|fotos parecidas|largest videos|Conversações|"
)
QUALIFIERS = (
    "|without favorites|sem favoritas|not blurry|2,5 GB|10 mb|1.5 gib|or videos|except work"
    "|free 700 MB|liberar espaço|o gato|from the gallery"
)
DATES = (
    "|today|yesterday|last week|mês passado|last 3 days|before 2020|últimos 7 dias|antigas|este ano"
    "|after 2023|hace 2 semanas|last|before yesterday|last year|two months ago|after today"
    "|between yesterday and today|last thirty days|3 anos atrás|ontem|last two years|1 week ago"
)


def pick(phrases: str, key: str, step: int) -> str:
    count = phrases.count("|") + 1
    return f"split_part('{phrases}', '|', cast(({key} * {step}) % {count} + 1 as int))"


def prompt(key: str) -> str:
    parts = [pick(VERBS, key, 3), pick(NOUNS, key, 5), pick(QUALIFIERS, key, 7), pick(DATES, key, 2)]
    return f"concat_ws(' ', {', '.join(parts)})"


def clean_prompt_sql(key: str) -> str:
    return f"trim(regexp_replace({prompt(key)}, '\\s+', ' ', 'g'))"


# 64-bit word vote over the whole text: majority per bit of the first 64 bits of md5(word).
_WORDS = (
    "select doc_id, unnest(string_split(lower(text), ' ')) as word from documents"
)
_VOTE = ", ".join(f"sum(cast((h >> {63 - i}) & 1 as bigint)) as b{i}" for i in range(64))


def _half(first: int) -> str:
    bits = " + ".join(
        f"(case when b{first + i} * 2 >= n then {1 << (31 - i)}::bigint else 0 end)" for i in range(32)
    )
    return f"lpad(lower(to_hex({bits})), 8, '0')"


SQL = {
    "assets": f"select doc_id, {', '.join(ASSETS)} from documents",
    "page_assets": f"select {', '.join(PAGE_ASSETS)} from pages",
    "benchmark_assets": f"select {', '.join(BENCHMARK_ASSETS)} from benchmark",
    "quality": f"select {', '.join(QUALITY)} from documents",
    "content": f"select {', '.join(CONTENT)} from labels",
    "texts": f"select {', '.join(TEXTS)} from documents",
    "capabilities": f"select {', '.join(CAPABILITIES)} from documents, (values "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(CAPABILITY_NAMES))
    + f") v(idx, name) where idx < {CAPABILITY_COUNT}",
    "words": _WORDS,
    "votes": "select doc_id, count(*) as n, "
    + _VOTE
    + " from (select doc_id, ('0x' || substr(md5(word), 1, 16))::ubigint as h from words where word <> '')"
    " group by doc_id",
    "hashes": f"select {asset_id('d.doc_id')} AS id, {_half(0)} || {_half(32)} AS perceptual_hash,"
    " sha256(d.text) AS content_hash, "
    + ", ".join(v.replace("doc_id", "d.doc_id") for v in VERSIONS)
    + " from documents d left join votes v on v.doc_id = d.doc_id",
    "fresh": "select a.*, nullif(h.content_hash, '') as content_hash,"
    " case when h.model_version in ('android-fast-2', 'android-heuristic-2')"
    " then nullif(h.perceptual_hash, '') end as visual_hash"
    " from assets a join hashes h on h.id = a.id where h.analyzed_at >= coalesce(a.modified_at, 0)",
    "exact": "select content_hash, 'cluster-exact:' || content_hash as cluster_id, min(id) as representative_id,"
    " count(*) as member_count from fresh where content_hash is not null group by content_hash having count(*) > 1",
    "groups": "select visual_hash, min(id) as representative_id, count(*) as member_count"
    " from fresh where visual_hash is not null group by visual_hash",
    "visual": "select visual_hash, 'cluster-visual:android-v2:' || visual_hash as cluster_id, representative_id,"
    " member_count from groups where member_count > 1",
    "bits": "select *, ('0x' || visual_hash)::ubigint as h from groups",
    "pairs": "select a.visual_hash as hash_a, b.visual_hash as hash_b, cast(bit_count(xor(a.h, b.h)) as int) as distance,"
    " a.member_count as members_a, b.member_count as members_b,"
    " least(a.representative_id, b.representative_id) as representative_id"
    " from bits a join bits b on substr(a.visual_hash, 1, 4) = substr(b.visual_hash, 1, 4)"
    " and a.visual_hash < b.visual_hash where bit_count(xor(a.h, b.h)) <= 8",
    # Independent of the library: memberships counted over the asset pairs themselves.
    "near_counts": "select a.id, count(*) as near from fresh a join fresh b"
    " on substr(a.visual_hash, 1, 4) = substr(b.visual_hash, 1, 4) and a.id <> b.id"
    " where bit_count(xor(('0x' || a.visual_hash)::ubigint, ('0x' || b.visual_hash)::ubigint)) <= 8"
    " group by a.id",
    "memberships": "select f.id, (e.cluster_id is not null or v.cluster_id is not null) as in_duplicate,"
    " (e.cluster_id is not null or v.cluster_id is not null or coalesce(n.near, 0) > 0) as in_similar,"
    " cast((e.cluster_id is not null)::int + (v.cluster_id is not null)::int + coalesce(n.near, 0) as bigint)"
    " as memberships from fresh f left join exact e on e.content_hash = f.content_hash"
    " left join visual v on v.visual_hash = f.visual_hash left join near_counts n on n.id = f.id",
    "wide": "select a.*, q.blur_score, q.quality_score, q.face_count, c.is_screenshot,"
    " coalesce(length(trim(t.ocr_text)) > 0, false) as has_text, t.ocr_text,"
    " coalesce(m.in_duplicate, false) as in_duplicate, coalesce(m.in_similar, false) as in_similar,"
    " coalesce(m.memberships, 0) as memberships"
    " from assets a left join quality q on q.id = a.id left join content c on c.id = a.id"
    " left join texts t on t.id = a.id left join memberships m on m.id = a.id",
    "plain": "select a.*, q.blur_score, q.quality_score, q.face_count, c.is_screenshot,"
    " coalesce(length(trim(t.ocr_text)) > 0, false) as has_text, t.ocr_text"
    " from assets a left join quality q on q.id = a.id left join content c on c.id = a.id"
    " left join texts t on t.id = a.id",
}
NEEDS = {
    "votes": ["words"],
    "hashes": ["votes"],
    "fresh": ["assets", "hashes"],
    "exact": ["fresh"],
    "groups": ["fresh"],
    "visual": ["groups"],
    "bits": ["groups"],
    "pairs": ["bits"],
    "near_counts": ["fresh"],
    "memberships": ["exact", "visual", "near_counts"],
    "wide": ["assets", "quality", "content", "texts", "memberships"],
    "plain": ["assets", "quality", "content", "texts"],
}


def with_tables(names: list[str], body: str) -> str:
    """``body`` (a SELECT, or further CTEs and a SELECT) after the CTEs it needs."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    ctes = ", ".join(f"{n} as materialized ({SQL[n]})" for n in ordered)
    joiner = ", " if body.lstrip().startswith("+") else " "
    return f"with {ctes}{joiner}{body.lstrip().removeprefix('+')}"


# --- the same tables as DataFrames ---------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for field in df.schema.fields:
        if field.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(field.name, F.col(field.name).cast("timestamp"))
    return df


def written(spark, sf_dir) -> DataFrame:
    """Documents for work on whole texts."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def assets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*ASSETS)


def page_assets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").selectExpr(*PAGE_ASSETS)


def benchmark_assets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").selectExpr(*BENCHMARK_ASSETS)


def quality(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*QUALITY)


def content(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr(*CONTENT)


def texts(spark, sf_dir) -> DataFrame:
    return written(spark, sf_dir).selectExpr(*TEXTS)


def capabilities(spark, sf_dir) -> DataFrame:
    names = ", ".join(f"'{n}'" for n in CAPABILITY_NAMES)
    listed = f"posexplode(slice(array({names}), 1, {CAPABILITY_COUNT})) AS (idx, name)"
    return table(spark, sf_dir, "documents").selectExpr("doc_id", listed).selectExpr(*CAPABILITIES)


def word_vote_hashes(documents: DataFrame) -> DataFrame:
    """(doc_id, perceptual_hash): one sum per pair of bits, combined before the shuffle."""
    word = F.explode(F.split(F.lower("text"), " "))
    words = documents.select("doc_id", word.alias("w"))
    digest = words.where(F.col("w") != "").select("doc_id", F.md5("w").alias("d"))
    halves = digest.select(
        "doc_id",
        F.conv(F.substring("d", 1, 8), 16, 10).cast("bigint").alias("hi"),
        F.conv(F.substring("d", 9, 8), 16, 10).cast("bigint").alias("lo"),
    )
    # Bit i of both halves in one sum: the low half counts in the upper 32 bits.
    sums = [
        F.expr(f"sum(((hi >> {31 - i}) & 1L) + (((lo >> {31 - i}) & 1L) << 32)) AS s{i}") for i in range(32)
    ]
    votes = halves.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), *sums)

    def word_of(count: str) -> str:
        terms = " + ".join(
            f"IF({count.format(i)} * 2 >= n, {1 << (31 - i)}L, 0L)" for i in range(32)
        )
        return f"lower(lpad(hex({terms}), 8, '0'))"

    high, low = word_of("(s{0} & 4294967295L)"), word_of("(s{0} >> 32)")
    return votes.select("doc_id", F.expr(f"{high} || {low}").alias("perceptual_hash"))


_written: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A model table written once per session to the shared folder, as a catalog would hold it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch_path(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def _build_hashes(spark, sf_dir) -> DataFrame:
    documents = written(spark, sf_dir)
    hashed = documents.select(
        "doc_id", *[F.expr(e) for e in (ID, *VERSIONS)], F.sha2("text", 256).alias("content_hash")
    )
    return hashed.join(word_vote_hashes(documents), "doc_id", "left").select(
        "id", "perceptual_hash", "content_hash", "analysis_version", "model_version", "analyzed_at"
    )


def hashes(spark, sf_dir) -> DataFrame:
    return stored(spark, sf_dir, "hashes", _build_hashes)


def content_hashes(spark, sf_dir) -> DataFrame:
    """Hashes without the visual one."""
    return table(spark, sf_dir, "documents").selectExpr(
        ID, "cast(null as string) AS perceptual_hash", "sha2(text, 256) AS content_hash", *VERSIONS
    )


def fresh(spark, sf_dir) -> DataFrame:
    return with_hashes(assets(spark, sf_dir), hashes(spark, sf_dir))


def memberships(spark, sf_dir) -> DataFrame:
    return asset_memberships(fresh(spark, sf_dir), BUCKET_DIGITS)


def catalog(spark, sf_dir, clusters: bool = False) -> Catalog:
    """The catalog tables; cluster memberships are a stored table, added where a query needs them."""
    return Catalog(
        assets(spark, sf_dir),
        quality(spark, sf_dir),
        content(spark, sf_dir),
        texts(spark, sf_dir),
        stored(spark, sf_dir, "memberships", memberships) if clusters else None,
    )


def prompts(spark, sf_dir) -> DataFrame:
    """(event_id, prompt, now): a search log derived from the events."""
    log = spread_rows(table(spark, sf_dir, "events").select("event_id", "ts"))
    return log.selectExpr("event_id", f"{prompt('event_id')} AS prompt", "ts AS now")
