"""Hashes, clusters, library reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import model as M
from checks.model import with_tables
from checks.q_tables import pending_sql
from checks.register import query
from lumenlake.constants import BUCKET_DIGITS
from lumenlake.functions import hashing
from lumenlake.operators import clusters, insights


@query("content_hash", "select doc_id, sha256(text) as content_hash from documents")
def content_hash(spark, sf):
    return M.table(spark, sf, "documents").select(
        "doc_id", hashing.content_hash(F.col("text")).alias("content_hash")
    )


GRID = "list_transform(embedding, lambda x: cast(floor((x::double + 1) * 127.5) as int))"
GRID_SPARK = "transform(embedding, x -> cast(floor((cast(x as double) + 1) * 127.5D) as int))"


def _average_sql() -> str:
    def half(first: int) -> str:
        bits = " + ".join(
            f"(case when v[{first + i + 1}] >= m then {1 << (31 - i)}::bigint else 0 end)" for i in range(32)
        )
        return f"lpad(lower(to_hex({bits})), 8, '0')"

    return f"{half(0)} || {half(32)}"


AVERAGE = (
    "e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings),"
    " a as (select vec_id, v, list_reduce(v, lambda p, q: p + q) / 64 as m from e),"
    f" h as (select vec_id, {_average_sql()} as hash from a)"
)


def _average(spark, sf):
    vectors = M.table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    return vectors.select("vec_id", "label", hashing.average_hash(F.col("v")).alias("hash"))


@query("average_hash", f"with {AVERAGE} select vec_id, hash from h")
def average_hash(spark, sf):
    return _average(spark, sf).select("vec_id", "hash")


@query(
    "hamming",
    f"with {AVERAGE} select a.vec_id, cast(bit_count(xor(('0x' || a.hash)::ubigint, ('0x' || b.hash)::ubigint)) as int) as distance"
    " from h a join h b on b.vec_id = a.vec_id + 1",
)
def hamming(spark, sf):
    hashes = _average(spark, sf).select("vec_id", "hash")
    following = hashes.select((F.col("vec_id") - 1).alias("vec_id"), F.col("hash").alias("next"))
    return hashes.join(following, "vec_id").select(
        "vec_id", hashing.hamming(F.col("hash"), F.col("next")).alias("distance")
    )


@query(
    "with_hashes",
    with_tables(["fresh"], "select id, content_hash, visual_hash from fresh"),
)
def with_hashes(spark, sf):
    return M.fresh(spark, sf).select("id", "content_hash", "visual_hash")


@query(
    "exact_clusters",
    with_tables(["exact"], "select cluster_id, 'exact' as kind, representative_id, member_count from exact"),
)
def exact_clusters(spark, sf):
    return clusters.exact_clusters(M.fresh(spark, sf)).drop("content_hash")


@query(
    "visual_clusters",
    with_tables(["visual"], "select cluster_id, 'visual' as kind, representative_id, member_count from visual"),
)
def visual_clusters(spark, sf):
    return clusters.visual_clusters(M.fresh(spark, sf)).drop("visual_hash")


@query(
    "near_pairs",
    with_tables(["pairs"], "select * from pairs"),
)
def near_pairs(spark, sf):
    return clusters.near_pairs(clusters.hash_groups(M.fresh(spark, sf), "visual_hash"), BUCKET_DIGITS)


ALL_PAIRS = (
    "select a.visual_hash as hash_a, b.visual_hash as hash_b, cast(bit_count(xor(a.h, b.h)) as int) as distance,"
    " a.member_count as members_a, b.member_count as members_b,"
    " least(a.representative_id, b.representative_id) as representative_id"
    " from bits a join bits b on a.visual_hash < b.visual_hash and bit_count(xor(a.h, b.h)) <= 8"
)


@query("near_pairs_all", with_tables(["bits"], ALL_PAIRS))
def near_pairs_all(spark, sf):
    """No prefix: every pair of hashes within the distance, from a bucket that is cut into chunks."""
    groups = clusters.hash_groups(M.fresh(spark, sf), "visual_hash")
    return clusters.near_pairs(groups, None, hot_bucket=64)


@query(
    "similar_members",
    with_tables(
        ["pairs", "fresh"],
        "select distinct 'cluster-similar:' || hash_a || ':' || hash_b as cluster_id, 'similar' as kind, f.id from pairs p"
        " join fresh f on f.visual_hash = p.hash_a or f.visual_hash = p.hash_b",
    ),
)
def similar_members(spark, sf):
    fresh = M.fresh(spark, sf)
    found = clusters.similar_clusters(clusters.near_pairs(clusters.hash_groups(fresh, "visual_hash"), BUCKET_DIGITS))
    return clusters.similar_members(found, fresh)


SIMILAR = (
    "select 'cluster-similar:' || hash_a || ':' || hash_b as cluster_id, 'similar' as kind, representative_id,"
    " members_a + members_b as member_count from pairs"
)


@query(
    "rebuild_clusters",
    with_tables(
        ["exact", "visual", "pairs"],
        "select cluster_id, 'exact' as kind, representative_id, member_count from exact union all"
        f" select cluster_id, 'visual', representative_id, member_count from visual union all {SIMILAR}",
    ),
)
def rebuild_clusters(spark, sf):
    return clusters.rebuild_clusters(M.fresh(spark, sf), BUCKET_DIGITS)


MEMBERS = (
    "select e.cluster_id, 'exact' as kind, f.id from fresh f join exact e on e.content_hash = f.content_hash union all"
    " select v.cluster_id, 'visual', f.id from fresh f join visual v on v.visual_hash = f.visual_hash"
)


@query("cluster_members", with_tables(["exact", "visual"], MEMBERS))
def cluster_members(spark, sf):
    return clusters.cluster_members(M.fresh(spark, sf))


@query(
    "cluster_summary",
    with_tables(
        ["exact", "visual"],
        f"+ m as ({MEMBERS}) select cluster_id, kind, min(id) as representative_id, count(*) as member_count"
        " from m group by 1, 2",
    ),
)
def cluster_summary(spark, sf):
    return clusters.cluster_summary(clusters.cluster_members(M.fresh(spark, sf)))


@query(
    "redundancy",
    with_tables(["memberships"], "select id, in_duplicate, in_similar, memberships from memberships"),
)
def redundancy(spark, sf):
    return M.memberships(spark, sf)


@query(
    "similar_partners",
    with_tables(
        ["fresh"],
        "select a.id, b.id as partner_id, cast(bit_count(xor(('0x' || a.visual_hash)::ubigint,"
        " ('0x' || b.visual_hash)::ubigint)) as int) as distance from fresh a join fresh b"
        " on substr(a.visual_hash, 1, 4) = substr(b.visual_hash, 1, 4) and a.id <> b.id"
        f" where a.id in (select {M.asset_id('item_id')} from benchmark) and"
        " bit_count(xor(('0x' || a.visual_hash)::ubigint, ('0x' || b.visual_hash)::ubigint)) <= 8",
    ),
)
def similar_partners(spark, sf):
    fresh = M.fresh(spark, sf)
    pairs = clusters.near_pairs(clusters.hash_groups(fresh, "visual_hash"), BUCKET_DIGITS)
    ids = M.table(spark, sf, "benchmark").selectExpr(f"{M.asset_id('item_id')} AS id")
    return clusters.similar_partners(ids, fresh, pairs)


# --- reports -------------------------------------------------------------------------------


@query(
    "library_summary",
    with_tables(
        ["assets"],
        "select count_if(media_type = 'photo') as photos, count_if(media_type = 'video') as videos,"
        " cast(coalesce(sum(file_size), 0) as bigint) as known_bytes from assets",
    ),
)
def library_summary(spark, sf):
    return insights.library_summary(M.assets(spark, sf))


@query(
    "library_insights",
    with_tables(
        ["assets", "quality", "content", "capabilities"],
        "select count(*) as total, cast(coalesce(sum(a.file_size), 0) as bigint) as known_bytes,"
        " count_if(a.file_size is null) as unknown_sizes,"
        f" count_if({pending_sql('deep')}) as pending, count_if({pending_sql('fast')}) as fast_pending,"
        " count_if(k.is_screenshot) as screenshots, count_if(q.blur_score >= 0.55) as blurry,"
        " count_if(a.media_type = 'video' and a.file_size >= 524288000) as large_videos,"
        " cast(coalesce(sum(case when a.media_type = 'video' and a.file_size >= 524288000 then a.file_size end), 0)"
        " as bigint) as large_video_bytes from assets a left join quality q on q.id = a.id left join content k on k.id = a.id",
    ),
)
def library_insights(spark, sf):
    return insights.library_insights(
        M.assets(spark, sf), M.quality(spark, sf), M.content(spark, sf), M.capabilities(spark, sf)
    )


@query(
    "duplicate_savings",
    "with h as (select " + ", ".join([*M.ASSETS, f"{M.ANALYZED} as analyzed_at", "sha256(text) as content_hash"])
    + " from documents), r as (select *, row_number() over (partition by content_hash order by favorite::int desc, id)"
    " as position from h where analyzed_at >= coalesce(modified_at, 0)) select count(*) as duplicate_copies,"
    " cast(coalesce(sum(file_size), 0) as bigint) as duplicate_bytes from r where position > 1 and not favorite",
)
def duplicate_savings(spark, sf):
    fresh = clusters.with_hashes(M.assets(spark, sf), M.content_hashes(spark, sf))
    return insights.duplicate_savings(fresh)


@query(
    "similar_photo_count",
    with_tables(["wide"], "select count(*) as similar_photos from wide where in_similar and media_type = 'photo'"),
)
def similar_photo_count(spark, sf):
    return insights.similar_photo_count(M.assets(spark, sf), M.memberships(spark, sf))


@query(
    "keeper_rank",
    "select l_partkey, l_orderkey, l_linenumber, row_number() over (partition by l_partkey order by"
    " (l_returnflag = 'R')::int desc, l_orderkey, l_linenumber, l_suppkey, l_extendedprice) as position from lineitem",
)
def keeper_rank(spark, sf):
    lines = M.table(spark, sf, "lineitem").select(
        "l_partkey", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag"
    )
    order = [
        (F.col("l_returnflag") == "R").desc(),
        *[F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")],
    ]
    ranked = insights.keeper_rank(lines, "l_partkey", order)
    return ranked.select("l_partkey", "l_orderkey", "l_linenumber", "position")


@query(
    "stage_profile",
    "select event_type as stage, 'm' || (user_id % 4) as metric, cast(sum(cast(floor(value) as bigint)) as bigint)"
    " as total_ms, count(*) as measurements, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) as wall_ms"
    " from events group by 1, 2",
)
def stage_profile(spark, sf):
    log = M.table(spark, sf, "events").selectExpr(
        "event_type AS stage",
        "'m' || (user_id % 4) AS metric",
        "cast(floor(value) as bigint) AS millis",
        "unix_millis(ts) AS at",
    )
    return insights.stage_profile(log)


@query(
    "capability_health",
    "select event_type as capability_id, 'v' || (user_id % 3) as model_version, count_if(value >= 20) as completed,"
    " count_if(value < 20) as failed from events group by 1, 2",
)
def capability_health(spark, sf):
    rows = M.table(spark, sf, "events").selectExpr(
        "event_type AS capability_id",
        "'v' || (user_id % 3) AS model_version",
        "case when value < 20 then 'failed' else 'completed' end AS status",
    )
    return insights.capability_health(rows)
