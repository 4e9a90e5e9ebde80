"""The class model over the whole vocabulary, against brute force in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from lumenlake.llm import language_model as M
from pyspark.sql import functions as F


def _texts(count=2500):
    """Texts of a grammar: kinds of words follow each other in turn, and words are many and mostly rare."""
    draw = random.Random(5)
    words = [[f"{'aeio'[k]}w{n}{draw.choice('bcdfg')}" for n in range(400)] for k in range(4)]
    texts = []
    for _ in range(count):
        kind = draw.randrange(4)
        length = draw.randrange(5, 30)
        texts.append(" ".join(words[(kind + k) % 4][min(int(draw.expovariate(0.01)), 399)] for k in range(length)))
    return texts


def _class_of(clusters, vocabulary):
    """Class of every word as its chunks hold it; all chunks must agree."""
    names = {np.frombuffer(xxhash.xxh3_128_digest(w.encode()), "<u8")[0]: w for w in vocabulary}
    of = {}
    rows = clusters.coded.select("chunk", "keys").join(clusters.classes, "chunk").collect()
    for row in rows:
        for key, c in zip(np.frombuffer(row["keys"], "<u8"), row["classes"]):
            assert of.setdefault(names[key], c) == c
    return of, len(rows)


@pytest.fixture(scope="module")
def found(spark):
    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    train = F.col("doc_id") % 5 != 0
    tokens = [[*t.split(), " "] for t in texts]
    clusters = M.cluster_words(docs, train, units=20, chunk_bytes=15_000)
    of, chunks = _class_of(clusters, {w for t in tokens for w in t})
    return docs, train, tokens, clusters, of, chunks


def test_every_round_raises_the_likelihood_of_all_words(found):
    _, _, tokens, clusters, of, chunks = found
    assert chunks > 8
    steps = clusters.steps
    assert len(steps) > 2 and all(a < b for a, b in zip(steps, steps[1:]))
    both, heads = Counter(), Counter()
    for k, text in enumerate(tokens):
        if k % 5:
            both.update(zip([63, *[of[w] for w in text]], [of[w] for w in text]))
    for (a, _), n in both.items():
        heads[a] += n
    assert {(a, b): clusters.both[a, b] for a, b in zip(*np.nonzero(clusters.both))} == both
    brute = sum(n * math.log(n) for n in both.values()) - 2 * sum(n * math.log(n) for n in heads.values())
    assert steps[-1] == pytest.approx(brute)


def test_rare_words_leave_their_endings(found):
    """Words beyond the single ones come to classes of their own kind, whatever their ending."""
    docs, train, tokens, once, _, _ = found
    clusters = M.cluster_words(docs, train, units=20, chunk_bytes=15_000, sweeps=3)
    of, _ = _class_of(clusters, {w for t in tokens for w in t})
    assert clusters.steps[-1] > once.steps[-1]
    count = Counter(w for k, t in enumerate(tokens) if k % 5 for w in t)
    plain = [w for w, n in count.items() if n >= 4 and w != " "]
    single = {w for w, _ in count.most_common(21)}
    kinds = {}
    for w in plain:
        if w not in single:
            kinds.setdefault(of[w], []).append(w[0])
    pure = sum(Counter(k).most_common(1)[0][1] for k in kinds.values())
    assert pure >= 0.9 * sum(map(len, kinds.values()))
    assert of[" "] == 63 and 63 not in {c for w, c in of.items() if w != " "}


def test_scores_equal_brute_force(found):
    docs, train, tokens, clusters, of, _ = found
    rows = {r.doc_id: r for r in M.score_texts(docs, train, units=20, chunk_bytes=15_000).collect()}
    seen = [w for k, t in enumerate(tokens) if k % 5 for w in t]
    count = Counter(seen)
    size, distinct, both = Counter(of[w] for w in seen), Counter(of[w] for w in count), clusters.both
    share = {c: (size[c] + 1) / (len(seen) + 64) for c in range(64)}
    for k, text in enumerate(tokens):
        score, last = 0.0, 63
        for w in text:
            c = of[w]
            score += math.log10((both[last, c] + M.SMOOTH * share[c]) / (both[last].sum() + M.SMOOTH))
            n = count[w] - M.DISCOUNT if count[w] else max(M.DISCOUNT * distinct[c], M.BASE)
            score += math.log10(n / (size[c] if size[c] else M.BASE))
            last = c
        assert rows[k].score == pytest.approx(score) and rows[k].n_known == sum(w in count for w in text)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_best_class_of_a_word_against_brute_force():
    """Neighbours in other classes only, so that nothing is left out of account."""
    draw = np.random.default_rng(4)
    for _ in range(20):
        both = draw.integers(40, 90, (M.CLASSES, M.CLASSES))
        now = int(draw.integers(0, 20))
        code = np.sort(draw.choice(np.r_[20:60, 20 + M.CLASSES : 60 + M.CLASSES], 6, replace=False))
        times = draw.integers(1, 40, 6)
        change = {}
        for b in range(M.CLASSES - 1):
            n = both.copy()
            for c, t in zip(code, times):
                if c < M.CLASSES:
                    n[now, c] -= t
                    n[b, c] += t
                else:
                    n[c - M.CLASSES, now] -= t
                    n[c - M.CLASSES, b] += t
            change[b] = M.likelihood(n) - M.likelihood(both)
        outside = [b for b in change if b < 20 or b >= 60]
        best = M.best_classes(np.zeros(6, np.int64), code, times, np.array([now], np.uint8), both)[0]
        if best in outside:
            assert change[best] >= max(change[b] for b in outside) - 1e-6 and change[best] >= 0
