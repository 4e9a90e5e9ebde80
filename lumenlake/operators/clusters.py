"""Exact, visual and near-duplicate groups.

Copies share one hash value, so everything about them is kept per distinct hash
together with the number of its assets: n copies cost n rows, never n squared
pairs. A near pair links two *hashes*; the asset pairs it stands for are its
two member lists (see :func:`similar_partners` for the partners of given assets).
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import (
    HASH_BITS,
    NEAR_DISTANCE,
    VISUAL_GENERATION,
    VISUAL_MODELS,
)
from lumenlake.functions.hashing import all_of, bit_distance, bits_hash, hash_bits
from lumenlake.operators.staleness import freshness_gate
from lumenlake.plans.skew import join_lookup
from lumenlake.session import cut_lineage

HOT_BUCKET = 32_768
# Up to this many leading digits the list of buckets itself is small (16 ** 5 rows).
LISTED_DIGITS = 5
CHUNK_BITS = 12
# Hashes that are compared with as many others in one task.
LARGEST_KEY = 4_096
# Crowded keys that are broadcast; a longer list is joined by key.
LISTED_KEYS = 65_536
# Pairs of hashes that are compared in one task, about.
PIECE_PAIRS = 1 << 22


def with_hashes(assets: DataFrame, hashes: DataFrame) -> DataFrame:
    """Assets with their hashes, fresh ones only.

    ``visual_hash`` is the perceptual hash where it exists and its model
    generation is current; empty hashes become null.
    """
    current = F.col("model_version").isin(*VISUAL_MODELS)
    named = hashes.select(
        "id",
        F.when(F.col("content_hash") != "", F.col("content_hash")).alias("content_hash"),
        F.when(current & (F.col("perceptual_hash") != ""), F.col("perceptual_hash")).alias("visual_hash"),
        F.col("analyzed_at").alias("_at"),
    )
    joined = assets.join(named, "id").where(freshness_gate("_at", "modified_at"))
    return joined.select(*assets.columns, "content_hash", "visual_hash")


def hash_groups(fresh: DataFrame, column: str) -> DataFrame:
    """Per distinct hash: smallest asset id and number of assets."""
    return (
        fresh.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.min("id").alias("representative_id"), F.count(F.lit(1)).alias("member_count"))
    )


def _clusters(fresh: DataFrame, kind: str, column: str, prefix: str) -> DataFrame:
    return (
        hash_groups(fresh, column)
        .where("member_count > 1")
        .select(
            column,
            F.concat(F.lit(f"cluster-{kind}:{prefix}"), F.col(column)).alias("cluster_id"),
            F.lit(kind).alias("kind"),
            "representative_id",
            "member_count",
        )
    )


def exact_clusters(fresh: DataFrame) -> DataFrame:
    """Groups of at least two assets with the same content hash."""
    return _clusters(fresh, "exact", "content_hash", "")


def visual_clusters(fresh: DataFrame) -> DataFrame:
    """Groups of at least two assets with the same visual hash of the current generation."""
    return _clusters(fresh, "visual", "visual_hash", VISUAL_GENERATION)


def _probe_plan(bits: int, max_distance: int, chunk_bits: int = CHUNK_BITS) -> list[tuple[int, int, int]]:
    """(shift, width, radius) of chunks of at least ``chunk_bits`` covering the low ``bits``.

    Two values within ``max_distance`` differ by at most ``radius`` in some
    chunk: otherwise the differences would add up to more than ``max_distance``.
    """
    count = max(1, bits // chunk_bits)
    edges = [bits * i // count for i in range(count + 1)]
    spare = max(0, max_distance - count + 1)
    return [
        (low, high - low, spare // count + (1 if i < spare % count else 0))
        for i, (low, high) in enumerate(zip(edges, edges[1:]))
    ]


def chunk_widths(bits: int, max_distance: int) -> list[int]:
    """Chunk widths to choose from, ascending: the default and wider ones whose chunks need at most two flips."""
    widths = [CHUNK_BITS]
    for count in range(bits // CHUNK_BITS - 1, 0, -1):
        width = bits // count
        if width > widths[-1] and all(r <= 2 for _, _, r in _probe_plan(bits, max_distance, width)):
            widths.append(width)
    return widths


def _masks(width: int, radius: int) -> list[int]:
    return [
        sum(1 << bit for bit in picked)
        for size in range(radius + 1)
        for picked in combinations(range(width), size)
    ]


def _meeting_keys(width: int, radius: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(tag, mask) lists for both sides of a chunk join.

    Two chunk values within ``radius`` get exactly one key in common, others
    none. Tag 0 meets at the second value itself. Values two bits apart meet
    halfway: the first side flips the lower bit, the second side the higher one,
    and the tag says where the two bit numbers first differ, so that no other
    combination of flips can meet.
    """
    if radius != 2:
        return [(0, mask) for mask in _masks(width, radius)], [(0, 0)]
    levels = range((width - 1).bit_length())
    flips = [(bit, level, 1 + level * width + (bit >> (level + 1))) for bit in range(width) for level in levels]
    low = [(tag, 1 << bit) for bit, level, tag in flips if not bit >> level & 1]
    high = [(tag, 1 << bit) for bit, level, tag in flips if bit >> level & 1]
    return [(0, mask) for mask in _masks(width, 1)] + low, [(0, 0)] + high


class ChunkKeys:
    """Keys on which hashes of a bucket meet that are near enough in some chunk of their bits.

    Every hash offers ``first`` keys to the ``second`` keys of the others. Two hashes meet exactly once for each chunk in
    which they are near enough, and ``counted`` is true for the first of these, so no distinct is needed.
    """

    def __init__(self, digits: int, max_distance: int = NEAR_DISTANCE, chunk_bits: int = CHUNK_BITS):
        self.chunks = _probe_plan(HASH_BITS - 4 * digits, max_distance, chunk_bits)
        self.marks = [(i, s, w, *_meeting_keys(w, r)) for i, (s, w, r) in enumerate(self.chunks)]

    @staticmethod
    def _chunk(bits: Column, shift: int, width: int) -> Column:
        return F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    @staticmethod
    def _offered(own: Column, i: int, marks: list[tuple[int, int]]) -> Column:
        listed = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).cast("bigint").alias("m")) for t, m in marks])
        return F.transform(
            listed,
            lambda k: F.struct(F.lit(i).alias("chunk"), k["t"].alias("tag"), own.bitwiseXOR(k["m"]).alias("value")),
        )

    def first(self, bits: Column) -> Column:
        return F.concat(*[self._offered(self._chunk(bits, s, w), i, marks) for i, s, w, marks, _ in self.marks])

    def second(self, bits: Column) -> Column:
        return F.concat(*[self._offered(self._chunk(bits, s, w), i, marks) for i, s, w, _, marks in self.marks])

    def crowded(self, hashes: DataFrame, largest: int) -> DataFrame:
        """(bucket, chunk, tag, value, n_a, n_b): every key with more than ``largest`` hashes on a side, and a bound of its sides.

        Counted from the distinct chunk values, of which only the busy ones are kept: values that are not busy add at most
        half of ``largest`` to a key, so a key that no busy value reaches, or for which they add up to less than half, is small.
        """
        own = F.array(*[
            F.struct(F.lit(i).alias("chunk"), self._chunk(F.col("bits"), s, w).alias("value")) for i, s, w, _, _ in self.marks
        ])
        values = hashes.select("bucket", F.explode(own).alias("_v")).groupBy("bucket", "_v.chunk", "_v.value")
        least = F.array(*[F.lit(largest / (2 * max(len(first), len(second)))) for _, _, _, first, second in self.marks])
        busy = values.agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > F.get(least, F.col("chunk")))

        def reached(first: bool) -> DataFrame:
            keys = F.lit(None)
            for i, _, _, *sides in self.marks:
                keys = F.when(F.col("chunk") == i, self._offered(F.col("value"), i, sides[0 if first else 1])).otherwise(keys)
            n, none = F.col("n"), F.lit(0).cast("bigint")
            rows = busy.select("bucket", F.explode(keys).alias("_k"), (n if first else none).alias("a"), (none if first else n).alias("b"))
            return rows.select("bucket", "_k.chunk", "_k.tag", "_k.value", "a", "b")

        summed = reached(True).unionByName(reached(False)).groupBy("bucket", "chunk", "tag", "value")
        totals = summed.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
        return totals.where(F.greatest("n_a", "n_b") > largest / 2)

    def counted(self, differing: Column, chunk: Column) -> Column:
        answer = F.lit(True)
        for i in range(1, len(self.chunks)):
            missed = [F.bit_count(self._chunk(differing, s, w)) > r for s, w, r in self.chunks[:i]]
            answer = F.when(chunk == i, all_of(missed)).otherwise(answer)
        return answer


_KEY = ["bucket", "chunk", "tag", "value"]


def near_pairs(
    groups: DataFrame,
    bucket_digits: int | None,
    max_distance: int = NEAR_DISTANCE,
    hot_bucket: int = HOT_BUCKET,
    column: str = "visual_hash",
    largest_key: int = LARGEST_KEY,
    widths: list[int] | None = None,
) -> DataFrame:
    """Pairs of distinct hashes within ``max_distance``, as (hash_a < hash_b).

    ``groups`` is :func:`hash_groups`. Only hashes with the same leading
    ``bucket_digits`` are compared; None compares all and misses no pair. A bucket of up to
    ``hot_bucket`` hashes is compared directly. A larger one is joined on
    chunks of its bits instead: near hashes agree up to a small radius in some chunk,
    and each side offers keys such that two hashes meet once per chunk in which
    they are near enough, and otherwise never. Only the first such chunk counts,
    hence no distinct is needed. Chunks are as wide as the bucket's size asks for (``widths`` to choose from,
    :func:`chunk_widths` by default), so that a key holds about ``largest_key`` hashes of evenly spread ones.
    Keys with more, and whole buckets, are cut into slices of that size, and each pair of slices is compared on its own.

    Every hash goes to many keys, so its digits stay behind: they follow from its bits, and only a hash of other digits or
    another length goes along as text.

    The distinct hashes are read several times, so they are checkpointed first (this runs their aggregation); the few
    crowded keys are counted and stored, too.
    """
    digits = bucket_digits or 0
    widths = widths or chunk_widths(HASH_BITS - 4 * digits, max_distance)
    plans = {w: ChunkKeys(digits, max_distance, w) for w in widths}
    bits = hash_bits(F.col(column))
    base = cut_lineage(
        groups.select(
            F.when(F.col(column) != bits_hash(bits), F.col(column)).alias("odd"),
            F.col("member_count").alias("n"),
            F.col("representative_id").alias("first"),
            bits.alias("bits"),
            F.substring(F.col(column), 1, digits).alias("bucket"),
        )
    )
    sizes = base.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"))
    width = F.lit(widths[-1])
    for w in reversed(widths[:-1]):
        width = F.when(F.col("_size") <= largest_key << w, w).otherwise(width)
    hot = sizes.where(F.col("_size") > hot_bucket).select("bucket", width.alias("_width"))
    # At most 16 ** digits rows (65536 by default), whatever the table size.
    marked = base.join(F.broadcast(hot) if digits <= LISTED_DIGITS else hot, "bucket", "left")

    whole = F.array(
        F.struct(F.lit(-1).alias("chunk"), F.lit(0).alias("tag"), F.lit(0).cast("bigint").alias("value"))
    )
    large = sizes.where(F.col("_size").between(largest_key + 1, hot_bucket))
    crowded = large.select("bucket", F.inline(whole), (F.col("_size") / 2).alias("n_a"), (F.col("_size") / 2).alias("n_b"))
    for w, plan in plans.items():
        crowded = crowded.unionByName(plan.crowded(marked.where(F.col("_width") == w), largest_key))
    # A slice holds half of a key's share of busy values, which leaves room for the values not counted.
    slices = [
        F.greatest(F.lit(1), F.ceil(F.col(f"n_{side}") * 2 / largest_key).cast("int")).alias(f"slices_{side}") for side in "ab"
    ]
    # A bucket holds at most 2 ** 64 hashes; as doubles, their squares add up without overflow.
    met = F.col("_size").cast("double") * F.least(F.col("_size"), F.lit(hot_bucket)) / 2
    busiest, compared = sizes.agg(F.max("_size"), F.sum(met)).first()
    busiest, compared = busiest or 0, compared or 0.0
    # Dealt by what is compared, not by the few bytes of the hashes: pairs grow with the square of a bucket.
    pieces = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(compared / PIECE_PAIRS))
    few = 0
    if busiest > min(hot_bucket, largest_key):
        crowded = cut_lineage(crowded.select(*_KEY, *slices))
        few = crowded.limit(LISTED_KEYS + 1).count()

    def side(name: str, other: str) -> DataFrame:
        keys = whole
        for w, plan in plans.items():
            offered = (plan.first if name == "a" else plan.second)(F.col("bits"))
            keys = F.when(F.col("_width") == w, offered).otherwise(keys)
        opened = marked.withColumn("_k", F.explode(keys)).select(
            "bucket",
            *[F.col(f"_k.{c}").alias(c) for c in ("chunk", "tag", "value")],
            *[F.col(c).alias(f"{c}_{name}") for c in ("odd", "bits", "n", "first")],
            *(["_width"] if name == "a" else []),
        )
        if not few:
            return opened
        listed = opened.join(F.broadcast(crowded) if few <= LISTED_KEYS else crowded, _KEY, "left")
        own = F.pmod(F.xxhash64(f"bits_{name}", f"odd_{name}"), F.coalesce(f"slices_{name}", F.lit(1))).cast("int").alias(f"_slice_{name}")
        met = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(f"slices_{other}"), F.lit(1)) - 1))
        return listed.select(*opened.columns, own, met.alias(f"_slice_{other}"))

    differing = F.col("bits_a").bitwiseXOR(F.col("bits_b"))
    counted = F.lit(True)
    for w, plan in plans.items():
        counted = F.when(F.col("_width") == w, plan.counted(differing, F.col("chunk"))).otherwise(counted)
    distance = bit_distance(F.col("bits_a"), F.col("bits_b"))
    hash_a, hash_b = (F.coalesce(f"odd_{name}", bits_hash(F.col(f"bits_{name}"))) for name in "ab")
    # As unsigned numbers, the bits of plain hashes are in the order of their digits.
    first = [F.col(f"bits_{name}").bitwiseXOR(F.lit(-(1 << 63))) for name in "ab"]
    plain = F.col("odd_a").isNull() & F.col("odd_b").isNull()
    ordered = F.when(plain, first[0] < first[1]).otherwise(hash_a < hash_b)
    keys = [*_KEY, *(["_slice_a", "_slice_b"] if few else [])]
    return (
        side("a", "b")
        .repartition(pieces, *keys)
        .join(side("b", "a").repartition(pieces, *keys), keys)
        .where((distance <= max_distance) & ordered & counted)
        .select(
            hash_a.alias("hash_a"),
            hash_b.alias("hash_b"),
            distance.alias("distance"),
            F.col("n_a").alias("members_a"),
            F.col("n_b").alias("members_b"),
            F.least("first_a", "first_b").alias("representative_id"),
        )
    )


def similar_clusters(pairs: DataFrame) -> DataFrame:
    """One cluster per near pair of hashes, holding the assets of both."""
    return pairs.select(
        F.concat_ws(":", F.lit("cluster-similar"), "hash_a", "hash_b").alias("cluster_id"),
        F.lit("similar").alias("kind"),
        "representative_id",
        (F.col("members_a") + F.col("members_b")).alias("member_count"),
    )


def similar_degrees(groups: DataFrame, pairs: DataFrame, column: str = "visual_hash") -> DataFrame:
    """Per hash: how many other assets each of its assets is near to (its own copies included)."""
    ends = F.array(
        F.struct(F.col("hash_a").alias("hash"), F.col("members_b").alias("n")),
        F.struct(F.col("hash_b").alias("hash"), F.col("members_a").alias("n")),
    )
    others = (
        pairs.select(F.explode(ends).alias("_e"))
        .groupBy(F.col("_e.hash").alias(column))
        .agg(F.sum("_e.n").alias("_others"))
    )
    degree = F.col("member_count") - 1 + F.coalesce("_others", F.lit(0))
    return groups.join(others, column, "left").select(column, "member_count", degree.alias("degree"))


def asset_memberships(fresh: DataFrame, bucket_digits: int | None) -> DataFrame:
    """Per asset: sizes of its exact and visual groups, near assets, and total memberships.

    ``memberships`` counts one exact group, one visual group and one per near
    asset, which is the number of clusters the asset belongs to. The three hash
    columns are checkpointed once (an action), as every part below reads them.
    """
    rows = cut_lineage(fresh.select("id", "content_hash", "visual_hash"))
    exact = exact_clusters(rows).select("content_hash", F.col("member_count").alias("exact_size"))
    groups = hash_groups(rows, "visual_hash")
    sizes = groups.select("visual_hash", "member_count")
    visual = similar_degrees(groups, near_pairs(groups, bucket_digits)).where("degree > 0")
    rows = join_lookup(rows, exact, "content_hash", F.col("exact_size"), "id")
    rows = join_lookup(rows, visual, "visual_hash", F.col("member_count"), "id", sizes=sizes)
    in_exact = F.coalesce(F.col("exact_size") > 1, F.lit(False))
    in_visual = F.coalesce(F.col("member_count") > 1, F.lit(False))
    near = F.coalesce("degree", F.lit(0))
    return rows.select(
        "id",
        (in_exact | in_visual).alias("in_duplicate"),
        (in_exact | in_visual | (near > 0)).alias("in_similar"),
        (in_exact.cast("bigint") + in_visual.cast("bigint") + near).alias("memberships"),
    )


def cluster_members(fresh: DataFrame) -> DataFrame:
    """(cluster_id, kind, id) of all exact and visual groups; checkpoints the hash columns once."""
    parts = []
    fresh = cut_lineage(fresh.select("id", "content_hash", "visual_hash"))
    for clusters, column in ((exact_clusters(fresh), "content_hash"), (visual_clusters(fresh), "visual_hash")):
        rows = fresh.where(F.col(column).isNotNull()).select("id", column)
        lookup = clusters.select(column, "cluster_id", "kind", "member_count")
        joined = join_lookup(rows, lookup, column, F.col("member_count"), "id", how="inner")
        parts.append(joined.select("cluster_id", "kind", "id"))
    return parts[0].unionByName(parts[1])


def similar_members(cluster_ids: DataFrame, fresh: DataFrame) -> DataFrame:
    """(cluster_id, kind, id) of given similar clusters: the assets of both hashes, which the id of the cluster names.

    For given clusters only; the pairs of all clusters are never expanded. Ids are dealt by their hashes to as many
    pieces as they come in, at least, so that a task's set of them stays as small as it was there.
    """
    named = cluster_ids.where(F.col("cluster_id").startswith("cluster-similar:")).select("cluster_id")
    least = int(fresh.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = max(least, named.rdd.getNumPartitions())
    ends = named.select("cluster_id", F.posexplode(F.slice(F.split("cluster_id", ":"), 2, 2)).alias("_end", "visual_hash"))
    hashes = ends.repartition(pieces, "visual_hash").distinct()
    found = fresh.select("id", "visual_hash").join(hashes, "visual_hash")
    return found.select("cluster_id", F.lit("similar").alias("kind"), "id")


def rebuild_clusters(fresh: DataFrame, bucket_digits: int | None) -> DataFrame:
    """All clusters of the three independent kinds, as one new snapshot (checkpoints the hashes once)."""
    fresh = cut_lineage(fresh.select("id", "content_hash", "visual_hash"))
    columns = ["cluster_id", "kind", "representative_id", "member_count"]
    similar = similar_clusters(near_pairs(hash_groups(fresh, "visual_hash"), bucket_digits))
    return (
        exact_clusters(fresh)
        .select(*columns)
        .unionByName(visual_clusters(fresh).select(*columns))
        .unionByName(similar)
    )


def cluster_summary(members: DataFrame) -> DataFrame:
    """Kind, representative and size of every cluster in a member table."""
    return members.groupBy("cluster_id", "kind").agg(
        F.min("id").alias("representative_id"), F.count(F.lit(1)).alias("member_count")
    )


def similar_partners(ids: DataFrame, fresh: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, partner_id, distance) for the given assets: their copies and their near assets."""
    mine = ids.select("id").join(fresh.select("id", F.col("visual_hash").alias("hash")), "id")
    links = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("hash_a").alias("hash"), F.col("hash_b").alias("visual_hash"), "distance"),
                F.struct(F.col("hash_b").alias("hash"), F.col("hash_a").alias("visual_hash"), "distance"),
            )
        ).alias("_l")
    ).select("_l.*")
    own = mine.select("id", F.col("hash").alias("visual_hash"), F.lit(0).alias("distance"))
    reach = own.unionByName(mine.join(links, "hash").select("id", "visual_hash", "distance"))
    partners = fresh.select(F.col("id").alias("partner_id"), "visual_hash")
    return (
        reach.join(partners, "visual_hash")
        .where(F.col("id") != F.col("partner_id"))
        .select("id", "partner_id", "distance")
    )
