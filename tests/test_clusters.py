import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from lumenlake.functions.hashing import average_hash, hamming
from lumenlake.operators import clusters, insights
from lumenlake.plans.skew import join_lookup


def distance(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


def clustered_hashes(count: int, seed: int) -> list[str]:
    """Hashes around few centres, so that many pairs are near and buckets are crowded."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0xABCD << 48 | rng.getrandbits(48) for _ in range(3)]
    hashes = []
    for _ in range(count):
        value = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            value ^= 1 << rng.randrange(64)
        hashes.append(f"{value:016x}")
    return hashes


def fresh_table(spark, hashes):
    rows = [(f"a{i:04d}", h, h[:6]) for i, h in enumerate(hashes)]
    return spark.createDataFrame(rows, "id string, visual_hash string, content_hash string")


def near_ids(hashes, digits):
    return {
        (f"a{i:04d}", f"a{j:04d}")
        for i, j in combinations(range(len(hashes)), 2)
        if hashes[i][:digits] == hashes[j][:digits] and distance(hashes[i], hashes[j]) <= 8
    }


@pytest.mark.parametrize("digits,hot", [(4, 1024), (4, 3), (2, 1), (None, 1)])
def test_near_pairs_expand_to_brute_force(spark, digits, hot):
    hashes = clustered_hashes(160, seed=7)
    fresh = fresh_table(spark, hashes)
    groups = clusters.hash_groups(fresh, "visual_hash")
    pairs = clusters.near_pairs(groups, digits, hot_bucket=hot).collect()
    assert len({(p.hash_a, p.hash_b) for p in pairs}) == len(pairs)
    by_hash = {}
    for i, h in enumerate(hashes):
        by_hash.setdefault(h, []).append(f"a{i:04d}")
    expanded = {tuple(sorted((x, y))) for ids in by_hash.values() for x, y in combinations(ids, 2)}
    for p in pairs:
        assert p.distance == distance(p.hash_a, p.hash_b)
        assert (p.members_a, p.members_b) == (len(by_hash[p.hash_a]), len(by_hash[p.hash_b]))
        expanded |= {tuple(sorted((x, y))) for x in by_hash[p.hash_a] for y in by_hash[p.hash_b]}
    assert expanded == near_ids(hashes, digits or 0)


@pytest.mark.parametrize("listed", [0, 65_536])
@pytest.mark.parametrize("digits,hot,largest,widths", [
    (4, 1024, 5, None), (4, 3, 4, [12]), (4, 3, 4, [16]), (2, 1, 3, None), (None, 1, 6, [12]), (None, 1, 6, [16]), (None, 1, 6, [21]),
])
def test_wider_chunks_and_slices_of_crowded_keys_lose_no_pair(spark, monkeypatch, digits, hot, largest, widths, listed):
    monkeypatch.setattr(clusters, "LISTED_KEYS", listed)
    hashes = sorted(set(clustered_hashes(140, seed=11)))
    groups = clusters.hash_groups(fresh_table(spark, hashes), "visual_hash")
    pairs = clusters.near_pairs(groups, digits, hot_bucket=hot, largest_key=largest, widths=widths).collect()
    found = [(p.hash_a, p.hash_b) for p in pairs]
    expected = {
        (a, b) for a, b in combinations(hashes, 2) if a[: digits or 0] == b[: digits or 0] and distance(a, b) <= 8
    }
    assert len(found) == len(set(found)) and set(found) == expected


def test_chunks_get_wider_while_two_flips_are_enough():
    assert clusters.chunk_widths(64, 8) == [12, 16, 21]
    assert clusters.chunk_widths(48, 8) == [12, 16]
    for bits, width in ((64, 16), (64, 21), (48, 16)):
        plan = clusters._probe_plan(bits, 8, width)
        assert sum(w for _, w, _ in plan) == bits and sum(r + 1 for _, _, r in plan) > 8


def test_no_key_is_larger_than_its_slices_allow(spark):
    """Hashes that agree in most chunks: every key that more than the limit meet on is listed, with enough slices."""
    rng, largest = random.Random(5), 24
    hashes = [f"{(0xABCD << 48) | rng.getrandbits(9) << rng.choice([0, 20]) | rng.getrandbits(3) << 40:016x}" for _ in range(600)]
    rows = spark.createDataFrame([(h, h[:4]) for h in sorted(set(hashes))], "hash string, bucket string")
    rows = rows.withColumn("bits", clusters.hash_bits(F.col("hash")))
    plan = clusters.ChunkKeys(4)
    listed = {(r.chunk, r.tag, r.value): r for r in plan.crowded(rows, largest).collect()}
    crowded = 0
    for name, keys in (("n_a", plan.first(F.col("bits"))), ("n_b", plan.second(F.col("bits")))):
        counts = rows.select(F.explode(keys).alias("k")).groupBy("k.chunk", "k.tag", "k.value").count().collect()
        for r in counts:
            if r["count"] > largest:
                crowded += 1
            counted = listed.get((r.chunk, r.tag, r.value))
            slices = max(1, -(-2 * counted[name] // largest)) if counted else 1
            assert r["count"] <= slices * largest
    assert crowded > 10


def test_memberships_count_the_clusters_of_every_asset(spark):
    hashes = clustered_hashes(120, seed=3)
    fresh = fresh_table(spark, hashes)
    near = near_ids(hashes, 4)
    result = {r.id: r for r in clusters.asset_memberships(fresh, 4).collect()}
    for i, h in enumerate(hashes):
        key = f"a{i:04d}"
        exact = sum(o[:6] == h[:6] for o in hashes) > 1
        visual = hashes.count(h) > 1
        pairs = sum(key in pair for pair in near)
        assert result[key].memberships == exact + visual + pairs
        assert result[key].in_duplicate == (exact or visual)
        assert result[key].in_similar == (exact or visual or pairs > 0)


def test_partners_of_given_assets(spark):
    hashes = clustered_hashes(80, seed=5)
    fresh = fresh_table(spark, hashes)
    pairs = clusters.near_pairs(clusters.hash_groups(fresh, "visual_hash"), 4)
    ids = spark.createDataFrame([("a0003",), ("a0010",)], "id string")
    found = {(r.id, r.partner_id) for r in clusters.similar_partners(ids, fresh, pairs).collect()}
    near = near_ids(hashes, 4)
    assert found == {(a, b) for x, y in near for a, b in ((x, y), (y, x)) if a in ("a0003", "a0010")}


def test_hot_keys_join_like_cold_ones(spark):
    rows = spark.createDataFrame(
        [(f"r{i}", "hot" if i % 3 else f"k{i}") for i in range(300)] + [("n1", None), ("n2", None)],
        "id string, key string",
    )
    lookup = rows.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    plain = {tuple(r) for r in rows.join(lookup, "key", "left").select("id", "key", "n").collect()}
    salted = join_lookup(rows, lookup, "key", F.col("n"), "id", hot_rows=10)
    assert sorted(map(str, map(tuple, salted.select("id", "key", "n").collect()))) == sorted(map(str, plain))


def test_known_hash_of_a_half_bright_grid(spark):
    grid = [0] * 32 + [255] * 32
    shifted = [i * 2 for i in range(64)]
    brighter = [i * 2 + 30 for i in range(64)]
    rows = spark.createDataFrame([(grid,), (shifted,), (brighter,), ([1, 2],)], "g array<int>")
    got = [r[0] for r in rows.select(average_hash(F.col("g"))).collect()]
    assert got[0] == "00000000ffffffff"
    assert got[1] == got[2]
    assert got[3] is None


def test_hamming_counts_bad_digits_as_zero(spark):
    rows = spark.createDataFrame(
        [("0123456789abcdef", "0123456789abcdee"), ("f" * 16, "0" * 16), ("zz", "00"), ("f", "0" * 16), ("F" * 16, "0" * 16)],
        "a string, b string",
    )
    assert [r[0] for r in rows.select(hamming(F.col("a"), F.col("b"))).collect()] == [1, 64, 0, 4, 0]


SIX = [
    ("a", "same", False, 1000),
    ("b", "same", False, 1000),
    ("c", "protected", True, 1000),
    ("d", "protected", True, 1000),
    ("e", "protected", False, 1000),
    ("f", "unique", False, 1000),
]


def test_savings_protect_favorites_and_count_unknown_sizes_as_nothing(spark):
    schema = "id string, content_hash string, favorite boolean, file_size bigint"
    row = insights.duplicate_savings(spark.createDataFrame(SIX, schema)).first()
    assert (row.duplicate_copies, row.duplicate_bytes) == (2, 2000)
    unknown = [*SIX, ("g", "same", False, None), ("h", None, False, 5), ("i", None, False, 5)]
    row = insights.duplicate_savings(spark.createDataFrame(unknown, schema)).first()
    assert (row.duplicate_copies, row.duplicate_bytes) == (3, 2000)
    row = insights.duplicate_savings(spark.createDataFrame([], schema)).first()
    assert (row.duplicate_copies, row.duplicate_bytes) == (0, 0)


def test_stale_and_outdated_hashes_are_left_out(spark):
    assets = spark.createDataFrame(
        [("a", None), ("b", 100), ("c", 300), ("d", 100), ("e", 100)], "id string, modified_at bigint"
    )
    hashes = spark.createDataFrame(
        [
            ("a", "p", "c", "android-fast-2", 0),
            ("b", "p", "", "android-heuristic-2", 100),
            ("c", "p", "c", "android-fast-2", 200),
            ("d", "p", "c", "ios-vision-1", 200),
            ("x", "p", "c", "android-fast-2", 200),
        ],
        "id string, perceptual_hash string, content_hash string, model_version string, analyzed_at bigint",
    )
    fresh = {r.id: (r.content_hash, r.visual_hash) for r in clusters.with_hashes(assets, hashes).collect()}
    assert fresh == {"a": ("c", "p"), "b": (None, "p"), "d": ("c", None)}


def test_pairs_are_dealt_by_what_is_compared(spark, monkeypatch):
    rows = [(f"a{k}", f"{k:016x}") for k in range(64)]
    fresh = spark.createDataFrame(rows, "id string, visual_hash string")
    groups = clusters.hash_groups(fresh, "visual_hash")
    monkeypatch.setattr(clusters, "PIECE_PAIRS", 100)
    pairs = clusters.near_pairs(groups, 4, max_distance=1)
    assert pairs.rdd.getNumPartitions() == 21  # 64 * 64 / 2 pairs
    assert pairs.count() == 64 * 6 // 2
    ids = clusters.similar_clusters(pairs)
    members = clusters.similar_members(ids.unionByName(ids), fresh).select("cluster_id", "id").collect()
    assert len(members) == len(set(members)) == 64 * 6


@pytest.mark.parametrize("digits,hot,largest", [(1, 1024, 4096), (None, 1, 3)])
def test_digits_of_hashes_stay_behind_and_odd_hashes_are_kept(spark, digits, hot, largest):
    hashes = ["0" * 16, "0" * 15 + "1", "f" * 16, "f" * 15 + "e", "7" + "f" * 15, "8" + "0" * 15, "8" + "0" * 14 + "1"]
    hashes += ["", "0", "00", "zz", "F" * 16, "0" * 17, "f" * 15, "0:0"]
    groups = clusters.hash_groups(fresh_table(spark, hashes), "visual_hash")
    pairs = clusters.near_pairs(groups, digits, hot_bucket=hot, largest_key=largest)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "hash_a" not in plan[plan.index("Join") :]
    values = {h: int("".join(c if c in "0123456789abcdef" else "0" for c in h[:16]).ljust(16, "0"), 16) for h in hashes}
    near = {(a, b): (values[a] ^ values[b]).bit_count() for a in hashes for b in hashes if a < b and a[: digits or 0] == b[: digits or 0]}
    found = [(p.hash_a, p.hash_b, p.distance, p.representative_id) for p in pairs.collect()]
    ids = {h: f"a{k:04d}" for k, h in enumerate(hashes)}
    assert sorted(found) == sorted((a, b, d, min(ids[a], ids[b])) for (a, b), d in near.items() if d <= 8)
