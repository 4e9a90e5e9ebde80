"""The training-data operators against brute-force versions on small input."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenlake.llm import (
    decontamination,
    language_id,
    language_model,
    licences,
    mixing,
    neighbours,
    quality,
    simhash,
    substrings,
    toxicity,
)
from lumenlake.llm.components import components
from lumenlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def _docs(spark, texts, sources=None):
    rows = [(k, t, sources[k] if sources else "s") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def _near_texts(seed, count=60):
    draw = random.Random(seed)
    texts = []
    while len(texts) < count:
        words = [f"w{draw.randrange(400)}" for _ in range(draw.randrange(1, 60))]
        texts.append(" ".join(words))
        for _ in range(draw.randrange(3)):
            changed = list(words)
            changed[draw.randrange(len(words))] = f"w{draw.randrange(400)}"
            texts.append(" ".join(changed))
    return texts


def _least_reachable(n, linked):
    least = list(range(n))
    for _ in range(n):
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    return least


def _print(text):
    words = text.encode().lower().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("slice_rows", [2, 4096])
def test_groups_equal_all_pairs(spark, slice_rows):
    texts = [*_near_texts(1), "", "A b", "a B", "a  b"]
    prints = [_print(t) for t in texts]
    linked = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    least = _least_reachable(len(texts), linked)
    found = simhash.groups(_docs(spark, texts), slice_rows=slice_rows).select("doc_id", simhash.hex_print().alias("f"), "component_id")
    assert sorted(map(tuple, found.collect())) == [(k, f"{prints[k]:016x}", least[k]) for k in range(len(texts))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_close_fingerprints_share_a_key(value, flips):
    other = value
    for f in flips:
        other ^= 1 << f
    bits = np.unpackbits(np.array([value, other], ">u8").view(np.uint8).reshape(2, 8), axis=1)
    keys = simhash.block_keys(bits, 6, 3)
    assert (keys[0] == keys[1]).any()


def test_near_copies_keep_one(spark):
    words = [f"w{k}" for k in range(300)]
    near = [w if k != 150 else "changed" for k, w in enumerate(words)]
    docs = _docs(spark, [" ".join(words), " ".join(near), " ".join(words), " ".join(reversed(words))])
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {0, 3}


def _jaccard_texts(seed):
    """Pairs of texts at similarities from 0.7 to 0.95, a large group, and a group of copies."""
    draw = random.Random(seed)
    texts = []
    for k in range(150):
        words = [f"w{draw.randrange(50_000)}" for _ in range(160)]
        changed = list(words)
        for at in draw.sample(range(4, 156, 6), 1 + k % 6):
            changed[at] = f"v{draw.randrange(50_000)}"
        texts += [" ".join(words), " ".join(changed)]
    words = [f"u{draw.randrange(50_000)}" for _ in range(160)]
    for _ in range(40):
        changed = list(words)
        for at in draw.sample(range(4, 156, 6), 2):
            changed[at] = f"v{draw.randrange(50_000)}"
        texts.append(" ".join(changed))
    return texts + [texts[0]] * 3


@pytest.mark.parametrize("paired,slice_rows", [(16, 4096), (2, 8), (1000, 4096)])
def test_near_duplicates_equal_brute_force(spark, paired, slice_rows):
    texts = _jaccard_texts(5)
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    shares = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(range(len(texts)), 2)}
    assert any(0.7 < x < 0.8 for x in shares.values()) and sum(0.8 <= x < 0.86 for x in shares.values()) > 20
    want = _least_reachable(len(texts), [p for p, x in shares.items() if x >= 0.8])
    found = simhash.near_duplicates(_docs(spark, texts), paired=paired, slice_rows=slice_rows).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(want))


def test_components_equal_union_find(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(200), draw.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    least = _least_reachable(341, edges)
    assert found == {n: least[n] for e in edges for n in e if e[0] != e[1]}


def _brute_removed(texts, size):
    words = [t.encode().split() for t in texts]
    first = {}
    for k, w in enumerate(words):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), k)
    gone = [set() for _ in texts]
    for k, w in enumerate(words):
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone[k] |= set(range(i, i + size))
    return words, gone


@pytest.mark.parametrize("chunk_bytes", [200, 1 << 20])
def test_repeats_equal_brute_force(spark, chunk_bytes):
    draw = random.Random(5)
    passages = [" ".join(f"p{draw.randrange(50)}" for _ in range(draw.randrange(5, 40))) for _ in range(12)]
    texts = ["\n ".join(draw.choice(passages) if draw.random() < 0.7 else f"only {k} here" for _ in range(4)) for k in range(40)]
    words, gone = _brute_removed(texts, 13)
    kept = [[w for i, w in enumerate(ws) if i not in g] for ws, g in zip(words, gone)]
    found = substrings.remove_repeats(_docs(spark, texts), chunk_bytes=chunk_bytes).collect()
    want = [(k, len(words[k]), len(gone[k]), hashlib.sha256(b" ".join(kept[k])).hexdigest()) for k in range(len(texts))]
    assert sorted(map(tuple, found)) == want
    left = {r.doc_id: r.text for r in substrings.without_repeats(_docs(spark, texts), chunk_bytes=chunk_bytes).collect()}
    assert {k: t.encode().split() for k, t in left.items()} == {k: w for k, w in enumerate(kept) if w}
    assert all(left[k] == texts[k] for k in range(len(texts)) if not gone[k])


def test_mixing_equals_brute_force(spark):
    draw = random.Random(7)
    sources = [draw.choice(["a", "b", "c", "d", None, "big", "big", "big"]) for _ in range(200)]
    texts = ["w " * draw.randrange(30) for _ in sources]
    sizes = [len(t.split()) for t in texts]
    names = [*sorted({s for s in sources if s}), None]
    total = {n: sum(z for z, s in zip(sizes, sources) if s == n) for n in names}
    weight = {n: 1 + k % 3 for k, n in enumerate(names)}
    target, left = {}, set(names)
    while left:
        budget, share = sum(total.values()) - sum(target.values()), sum(weight[n] for n in left)
        above = {n for n in left if budget * weight[n] / share > 3 * total[n]}
        for n in above or left:
            target[n] = 3 * total[n] if above else budget * weight[n] / share
        left -= above or left
    rows = mixing.mix(_docs(spark, texts, sources)).collect()
    for r in rows:
        assert r.size == sizes[r.doc_id] and r.taken <= 3 * r.size
        assert r.target == pytest.approx(target[sources[r.doc_id]])
    over = [sum(r.taken for r in rows if sources[r.doc_id] == n) - math.floor(target[n] + 1e-9) for n in names]
    assert all(0 <= x < len(names) for x in over)  # what rounding down leaves of the budget goes to the next packets
    assert sum(r.taken for r in rows) == sum(sizes)
    served = mixing.stream(_docs(spark, texts, sources)).collect()
    assert sum(r.taken for r in served) == sum(r.taken for r in rows)
    times = [r.virtual_finish for r in served]
    assert times == sorted(times)


def test_marginals_equal_enumeration():
    chain = quality.Chain(3)
    draw = np.random.default_rng(1)
    chain.weights, chain.pairs = draw.standard_normal(3), draw.standard_normal((2, 2))
    counts = np.array([3, 1, 5])
    features = draw.standard_normal((9, 3))
    good, pairs = chain.marginals(features, counts)
    at, want_pairs = 0, np.zeros((2, 2))
    for n in counts:
        x = features[at : at + n] @ chain.weights
        odds = {y: math.exp(sum(x[k] * y[k] for k in range(n)) + sum(chain.pairs[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=int(n))}
        all_odds = sum(odds.values())
        for k in range(n):
            assert good[at + k] == pytest.approx(sum(o for y, o in odds.items() if y[k]) / all_odds)
        for y, o in odds.items():
            for a, b in zip(y, y[1:]):
                want_pairs[a, b] += o / all_odds
        at += n
    assert pairs == pytest.approx(want_pairs)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 1)), min_size=1, max_size=30))
def test_isotonic_curve_rises(points):
    x, y = np.array(points, float).T
    knots, values = quality.pool_adjacent(x, y)
    assert (np.diff(values) >= -1e-12).all() and values.min() >= 0 and values.max() <= 1
    assert np.interp(x, knots, values).mean() == pytest.approx(y.mean(), abs=0.5)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12))
def test_common_subsequence(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert decontamination.common_subsequence(a, b) == table[-1][-1]


def test_leaks_with_changed_words(spark):
    draw = random.Random(11)
    fresh = lambda n: [f"x{draw.randrange(5000)}" for _ in range(n)]
    items = [fresh(n) for n in (15, 40, 120)]
    near = [w if k % 6 else "other" for k, w in enumerate(items[1])]
    docs = [fresh(200), fresh(31) + items[0] + fresh(50), fresh(7) + near + fresh(90), fresh(100) + items[2], fresh(300)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    for words in (2_000_000, 60):  # the whole benchmark at once, and in several passes
        found = decontamination.find_leaks(_docs(spark, [" ".join(d) for d in docs]), bench, bench_words=words)
        assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (2, 1), (3, 2)}


def _prose(draw, n):
    """Words of a vocabulary in which a few are very common."""
    return [f"w{min(draw.randrange(1, 3000), draw.randrange(1, 3000), draw.randrange(1, 3000))}" for _ in range(n)]


def test_no_item_that_is_there_word_for_word_is_missed(spark):
    draw = random.Random(5)
    docs = [_prose(draw, 400) for _ in range(120)]
    items, want = [], set()
    for n in range(3, 31):
        for kind in range(4):
            item = _prose(draw, n) if kind % 2 else [f"w{draw.randrange(1, 40)}" for _ in range(n)]
            at, doc = draw.randrange(300), draw.randrange(120)
            docs[doc][at:at] = item
            items.append(item)
    texts = [f" {' '.join(d)} " for d in docs]
    for k, item in enumerate(items):
        want |= {(d, k) for d, text in enumerate(texts) if f" {' '.join(item)} " in text}
    assert len(want) > 100
    bench = spark.createDataFrame([(k, " ".join(w).title()) for k, w in enumerate(items)], "item_id long, text string")
    for words in (2_000_000, 500):
        found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(_docs(spark, texts), bench, bench_words=words).collect()}
        assert want <= found


def _brute_leaks(texts, items):
    """(doc, item) where 60 % of the item's words follow in order within a window as long as one and a half items, and half of its answer."""
    found = set()
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            if len(set(item) & set(text)) < 0.6 * len(set(item)):
                continue
            answer = set(item[-max(3, len(item) // 4) :])
            reach = len(item) * 3 // 2
            for at in range(0, max(1, len(text) - len(item) + 1), 4):
                span = text[at : at + reach]
                if len(answer & set(span)) >= 0.5 * len(answer) and decontamination.common_subsequence(item, span) >= 0.6 * len(item):
                    found.add((d, k))
                    break
    return found


def test_most_paraphrases_are_found(spark):
    draw = random.Random(8)
    docs = [_prose(draw, 300) for _ in range(80)]
    items = [_prose(draw, draw.randrange(15, 60)) for _ in range(60)]
    for item in items:
        changed = set(draw.sample(range(len(item)), int(0.37 * len(item))))
        doc, at = draw.choice(docs), draw.randrange(250)
        doc[at:at] = [f"v{draw.randrange(10**6)}" if k in changed else w for k, w in enumerate(item)]
    want = _brute_leaks(docs, items)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    rows = decontamination.find_leaks(_docs(spark, [" ".join(d) for d in docs]), bench).collect()
    found, by_cosine = {(r.doc_id, r.item_id) for r in rows}, {(r.doc_id, r.item_id) for r in rows if r.by_cosine}
    print("paraphrases", len(want), len(want & found), len(want & by_cosine), len(found - want))
    assert len(want) >= 45 and len(want & found) >= 0.9 * len(want)
    assert len(want & by_cosine) >= 0.7 * len(want)


def test_character_models_are_distributions():
    texts = ["the cat sat on the mat", "a dog and a cat"], ["der hund und die katze", "das haus am see"]
    counts = [np.unique(language_id.ngrams(t)[0], return_counts=True) for t in texts]
    models = language_id.Models(counts)
    alphabet = np.unique(np.concatenate([k for k, _ in counts]) & np.uint64(0xFFFF))
    for context in ("he ", "zzz", "  d"):
        start = sum((0 if c == " " else ord(c)) << 16 * (3 - k) for k, c in enumerate(context))
        sums = models.of(4, np.uint64(start) | alphabet).sum(axis=0)
        assert ((sums > 0.8) & (sums <= 1 + 1e-9)).all()  # the rest is for letters no language has seen


def test_languages_held_out(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in QUERIES["op5_language_id"](spark, SF).collect() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in held)
    assert sum(docs[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_base_scores_and_distributions(spark):
    texts = ["The cat the dog", "a cat", "", "the bird sings a song", "Dog cat dog"] * 4
    train = language_model.F.col("doc_id") % 5 != 4
    rows = {r.doc_id: r for r in language_model.score_texts(_docs(spark, texts), train, units=3).collect()}
    tokens = [[*t.lower().split(), None] for t in texts]
    seen = [w for k, t in enumerate(tokens) if k % 5 != 4 for w in t]
    count = {w: seen.count(w) for w in seen}
    for k, words in enumerate(tokens):
        base = sum(math.log10((count.get(w, 0) + 0.1) / (len(seen) + 0.1 * (len(count) + 1))) for w in words)
        assert rows[k].base_score == pytest.approx(base)
        assert (rows[k].n_tokens, rows[k].n_known, rows[k].train_tokens) == (len(words), sum(w in count for w in words), len(seen))
        assert rows[k].score < 0 and rows[k].held_out == (k % 5 == 4)


def test_exchange_raises_the_likelihood():
    draw = np.random.default_rng(2)
    kind = np.arange(41) % 4
    pairs = np.where((kind[:, None] + 1) % 4 == kind[None, :], draw.integers(5, 20, (41, 41)), draw.integers(0, 2, (41, 41)))

    def likelihood(of):
        member = np.eye(5)[of]
        both = member.T @ pairs @ member
        return (both * np.log(np.maximum(both, 1) / np.maximum(np.outer(both.sum(1), both.sum(0)), 1))).sum()

    start = np.append(np.arange(40) % 4 * 0, 4)
    of = language_model.exchange(pairs, classes=5, rounds=10)
    assert likelihood(of) > likelihood(start)
    together = sum(of[a] == of[b] for a in range(40) for b in range(a) if kind[a] == kind[b])
    apart = sum(of[a] == of[b] for a in range(40) for b in range(a) if kind[a] != kind[b])
    assert together > 0.8 * sum(kind[a] == kind[b] for a in range(40) for b in range(a)) and apart < 40


def test_model_emissions_sum_to_one():
    both = np.zeros((language_model.CLASSES,) * 2, np.int64)
    both[0, 1], both[1, 2], both[2, 63], both[63, 0], both[2, 2] = 7, 4, 4, 4, 9
    distinct = np.zeros(language_model.CLASSES, np.int64)
    distinct[[0, 1, 2, 63]] = 2, 3, 1, 1
    model = language_model.Model(both, distinct)
    assert (10**model.transition).sum(axis=1) == pytest.approx(1)
    for c in np.flatnonzero(model.counts):
        seen = model.counts[c] - language_model.DISCOUNT * model.distinct[c]
        assert 10 ** model.emission(np.array([0.0]), np.array([c]))[0] + seen / model.counts[c] == pytest.approx(1)


def test_neighbours_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = np.array([r.embedding for r in rows], float)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in QUERIES["op4_neighbours"](spark, SF).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    hits = 0
    for q in np.flatnonzero(ids % 20 == 0):
        scores = (vectors * vectors[q]).sum(axis=1)
        scores[q] = -np.inf
        best = ids[np.lexsort((ids, -scores))[:20]]
        assert sorted(found[ids[q]]) == list(range(1, 21))
        hits += len(set(best.tolist()) & set(found[ids[q]].values()))
    assert hits >= 0.9 * 20 * len(found)


def test_copies_of_a_vector_are_exact(spark):
    draw = np.random.default_rng(4)
    base = draw.standard_normal((40, 8)).tolist()
    rows = [(k, base[0] if k % 2 else base[k % 40]) for k in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, neighbours.F.col("vec_id") % 100 == 1, 20).collect()
    for query in (1, 101, 201, 301):
        got = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == query]
        scores = [(-(np.array(v) * np.array(rows[query][1])).sum(), k) for k, v in rows if k != query]
        assert got == [k for _, k in sorted(scores)[:20]]


def test_probing_is_exact():
    draw = np.random.default_rng(6)
    codes = draw.integers(0, 65536, (500, 16), np.uint16)
    queries = codes[:20] ^ (draw.random((20, 16)) < 0.3).astype(np.uint16)
    distances = np.bitwise_count(queries[:, None] ^ codes[None]).sum(axis=2, dtype=int)
    index = neighbours.Index(codes)
    for radius in (0, 20, 45, 100):
        for query, row in zip(queries, distances):
            assert index.probe(query, radius).tolist() == np.flatnonzero(row <= radius).tolist()
            more = index.probe(query, radius, 30)  # the radius grows until there are enough
            assert len(more) >= 30 and row[more].max() < np.delete(row, more).min(initial=1000)
    assert (distances <= 100).any()


def test_a_clustered_set_is_hardly_touched():
    draw = np.random.default_rng(2)
    centres = draw.standard_normal((300, 32))
    rows = (centres[:, None] + 0.08 * draw.standard_normal((300, 40, 32))).reshape(-1, 32)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    codes = neighbours.Codes(rows[draw.choice(len(rows), 3000, replace=False)], float(np.linalg.norm(rows, axis=1).max()))
    codes.learn_radius(rows[:3000], 20)
    index, hits, queries = neighbours.Index(codes.of(rows)), 0, range(0, len(rows), 97)
    for q, code in zip(queries, codes.of(rows[::97], query=True)):
        found = index.probe(code, codes.radius, 21)
        best = np.argsort(-(rows @ rows[q]))[:21]
        hits += len(set(best.tolist()) & set(found.tolist()))
    print("touched", index.touched / len(queries) / len(rows), "recall", hits / 21 / len(queries), "radius", codes.radius)
    assert hits >= 0.9 * 21 * len(queries)
    assert index.touched < 0.1 * len(queries) * len(rows)


def test_bad_lines_behind_many_good_ones_count():
    good = [f"A plain sentence of ordinary words number {k} stands here, as many do." for k in range(3000)]
    bad = [f"|| $$ {k} !!! BUY|NOW ## %% {k * 7} !!" for k in range(3000)]
    assert quality.spread_runs(400) == [(0, 400)]
    runs = quality.spread_runs(6000)
    assert runs[0] == (0, 50) and runs[-1] == (5950, 6000) and len(runs) == 8
    batch = quality.pa.record_batch({"doc_id": [1], "label": [0], "text": ["\n".join(good + bad)]})
    [out] = quality._sampled_lines(iter([batch]))
    features = np.frombuffer(out.column("features")[0].as_py(), np.float32).reshape(-1, quality.WIDTH)
    whole, _, _ = quality.line_features(["\n".join(good + bad).encode()])
    assert out.column("runs")[0].as_py() == [50] * 8
    assert np.allclose(features, np.concatenate([whole[a:b] for a, b in runs]), atol=1e-5)


def test_quality_is_learnt_from_lines_behind_the_400th(spark):
    draw = random.Random(3)
    plain = lambda: " ".join(draw.choice(["a", "calm", "river", "runs", "by", "town"]) for _ in range(6)) + "."
    junk = lambda: "|| $$ !!! BUY|NOW ## %% " + str(draw.randrange(10**6))
    texts = []
    for k in range(60):
        lines = [plain() for _ in range(900)]
        if k % 2:
            lines[450:] = [junk() for _ in range(450)]
        texts.append("\n".join(lines))
    labels = spark.createDataFrame([(k, (k + 1) % 2) for k in range(60)], "doc_id long, quality int")
    rows = quality.score_documents(_docs(spark, texts), labels).collect()
    assert all(r.predicted == (r.doc_id + 1) % 2 for r in rows)


def test_a_rare_language_keeps_its_model(spark):
    """A language of ten documents among twenty large ones, and letters above U+FFFF."""
    draw = random.Random(12)
    alphabets = ["".join(chr(0x3041 + 7 * n + k) for k in range(9)) for n in range(20)]
    word = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randrange(2, 6)))
    texts, langs = [], []
    for n, letters in enumerate(alphabets):
        for _ in range(60):
            texts.append(" ".join(word(letters) for _ in range(40)))
            langs.append(f"l{n:02}")
    rare = [" ".join(word("".join(chr(0x1E900 + k) for k in range(12))) for _ in range(40)) for _ in range(10)]
    texts, langs = texts + rare, langs + ["adlam"] * 10
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(zip(texts, langs))], "doc_id long, text string, lang string")
    rows = language_id.identify(docs).collect()
    right = [r.lang_pred == langs[r.doc_id] for r in rows]
    assert sum(right) >= 0.97 * len(rows)
    assert all(r.lang_pred == "adlam" for r in rows if langs[r.doc_id] == "adlam")


def test_letters_above_the_first_plane_do_not_meet_others():
    folded = language_id._folded()
    first = {int(folded[c]) for c in range(0x10000)}
    adlam = [int(folded[c]) for c in range(0x1E922, 0x1E944)]
    assert len(set(adlam)) == len(adlam) and not set(adlam) & first and 0 not in adlam

def test_toxic_words_are_learnt(spark):
    draw = random.Random(13)
    plain = lambda: [f"word{draw.randrange(200)}" for _ in range(40)]
    texts, toxic = [], []
    for k in range(240):
        words = plain()
        if k % 4 == 0:
            words[draw.randrange(40)] = f"zorb{draw.choice(['a', 'en', 'lich'])}"
        texts.append(" ".join(words))
        toxic.append(int(k % 4 == 0))
    labels = spark.createDataFrame([(k, 1, t) for k, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(_docs(spark, texts), labels).collect()
    held = [r for r in rows if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == toxic[r.doc_id] for r in held) >= 0.95 * len(held)
    clean = {r.doc_id for r in toxicity.keep_clean(_docs(spark, texts), labels).collect()}
    assert clean == {r.doc_id for r in rows if not r.predicted}


def test_quality_held_out(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op8_quality"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.9 * len(rows)


def test_licence_families(spark):
    lines = {
        0: ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        1: ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        2: ("SPDX-License-Identifier: BSD-3-Clause", "BSD"),
        3: ("Released under the MIT License.", "MIT"),
        4: ("All rights reserved.", "unknown"),
        5: ("Mit.", None),
        6: ("The weather in the mountains was fine and they walked home.", None),
    }
    texts = [f"An ordinary line of text number {k}.\n{line}\nAnd another one." for k, (line, _) in lines.items()]
    found = {(r.doc_id, r.licence) for r in licences.scan_licences(_docs(spark, texts)).collect()}
    assert found == {(k, f) for k, (_, f) in lines.items() if f}


def test_licence_names_are_never_ordinary(spark):
    lines = [("Released under GPLv3.", "GPL-3.0"), ("Available under AGPL-3.0.", "AGPL-3.0"), ("Released under the MPL 2.0.", "MPL-2.0")]
    lines += [("Distributed under the CC BY 4.0.", "CC-BY-4.0"), ("Released under ISC.", "ISC")]
    texts = [f"An ordinary line of text number {k}.\n{lines[k % 5][0]}\nAnd another one." for k in range(50)]
    found = {(r.doc_id, r.licence) for r in licences.scan_licences(_docs(spark, texts)).collect()}
    assert found == {(k, lines[k % 5][1]) for k in range(50)}


def test_licence_texts_lines_and_other_languages(spark):
    lines = [
        ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO', "MIT"),
        ("1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "BSD"),
        ("The GNU General Public License is a free, copyleft license for software and other kinds of works.", "GPL-3.0"),
        ("Unter der MIT-Lizenz.", "MIT"),
        ("License: WTFPL", "unknown"),
        ("Licensed under the Frobnicate License.", "unknown"),
        ("Foo is a small tool for cutting trees into planks, released under the MIT License by its authors in 2019.", "MIT"),
        ("Sheds, a planner, is free software under the GNU Affero General Public License, version 3, since the spring.", "AGPL-3.0"),
        ("Sie gingen mit dem Hund und mit den Kindern in den Wald.", None),
        ("The museum asked for permission to move the old mill.", None),
    ]
    german = "Das Haus am See steht seit Jahren leer und wartet mit offenen Fenstern auf Regen, Nummer {}."
    texts = [f"{german.format(k)}\n{line}\nThe river ran past mill number {k} and on to the sea." for k, (line, _) in enumerate(lines)]
    found = {(r.doc_id, r.licence) for r in licences.scan_licences(_docs(spark, texts)).collect()}
    assert found == {(k, f) for k, (_, f) in enumerate(lines) if f}


def test_licence_families_left_out_of_the_fit_are_unknown_or_missed_but_not_taken_for_others(spark, monkeypatch):
    lines = [f"The river ran past mill number {k} and on to the sea, said the old man on day {k * 7}." for k in range(60)]
    left_out = ["MPL-2.0", "Apache-2.0"]
    probes = [phrase.format(name) for f in left_out for name in licences.NAMES[f] for phrase in licences.PHRASES if phrase != "{}"]
    for f in left_out:
        monkeypatch.delitem(licences.NAMES, f)
        monkeypatch.delitem(licences.TEXTS, f)
    found = licences.scan_licences(_docs(spark, [*lines, *probes])).collect()
    wrong = {r.doc_id for r in found if r.licence != licences.UNKNOWN}
    unknown = {r.doc_id for r in found if r.licence == licences.UNKNOWN}
    assert len(wrong) <= 0.05 * len(probes) and len(unknown) >= 0.8 * len(probes)
    assert min(unknown | wrong) >= len(lines)


def test_licence_lines_are_cut_and_weighed_once(spark):
    lines = [("MIT", "Released under the MIT License."), ("none", "The river ran on to the sea."), ("none", "Two geese flew over the old mill.")]
    rows = spark.createDataFrame(lines, "family string, line string").select("family", licences.words(F.col("line")).alias("words"))
    scanner = licences.Scanner.__new__(licences.Scanner)
    scanner.features = licences.HashingTF(inputCol="grams", outputCol="vector", numFeatures=licences.FEATURES, binary=True)
    scanner.limit, scanner.about, scanner.texts, scanner.names = 0.5, 0.5, {"MIT": [["mit license"]]}, {"MIT": [" mit license "]}
    scanner._fit(scanner._vectors(rows.withColumn("pairs", licences._pairs("words"))), 5)
    found = scanner.scan(_docs(spark, ["The river ran on to the sea.\n\n ...\nReleased under the MIT License.\nSea", "", None]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(") == 1
    steps = [line for line in plan.splitlines() if "UDF(" in line]
    assert steps and not any("Filter " in line for line in steps)
    assert sum(line.count("UDF(") for line in steps) == 4  # vector, raw, shares, array
    assert [(r.doc_id, r.family, r.shared) for r in found.collect()] == [(0, "MIT", 1.0)]


def test_leaks_among_many_rare_words_are_found(spark):
    """Items that carry less than a fifth of their passage's weight, with a word changed so that no five words follow."""
    items = [[f"item{n}x{k}" for k in range(7)] for n in range(60)]
    told = [[w if k != 3 else f"changed{n}" for k, w in enumerate(item)] for n, item in enumerate(items)]
    texts = [" ".join([f"a{n}x{k}" for k in range(40)] + words + [f"b{n}x{k}" for k in range(40)]) for n, words in enumerate(told)]
    bench = spark.createDataFrame([(n, " ".join(item)) for n, item in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_leaks(_docs(spark, texts), bench).collect()}
    assert len(found) > 30 and all(d == i for d, i in found)


def test_near_fingerprints_are_one_group(spark):
    """Texts whose distinct five-word shingles are little alike, but whose fingerprints are the same."""
    often = ["a b c d e"] * 200
    texts = [" ".join([*often, *[f"{name}{k}" for k in range(40)]]) for name in "xy"] + [" ".join(f"z{k}" for k in range(300))]
    prints = [int(simhash.fingerprint(t.encode(), 3)[0]) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3 < (prints[0] ^ prints[2]).bit_count()
    assert not simhash.alike(*(simhash.shingle_set(t.encode(), 5) for t in texts[:2]))
    assert {r.doc_id for r in simhash.keep_one(_docs(spark, texts)).collect()} == {0, 2}
