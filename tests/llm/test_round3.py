"""Conversation trie, filter audit and byte-level BPE against brute force, and on odd input."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenlake.llm import byte_pairs, conversations, filter_audit

CONV = "conv_id long, turn long, role string, text string, shard int, ids string, depth string"
PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


def brute_trie(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            key = f"{len(role or '')}:{role or ''}{text or ''}"
            rank = hashlib.md5(key.encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0), rank, (role or "", text or "")))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        tree = [n for n in members if n[: len(node)] == node]
        kids = [n for n in tree if len(n) == len(node) + 1]
        leaves = sum(not any(m[:-1] == n for m in members if len(m) == len(n) + 1) for n in tree)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode().split()) for n in tree if n)
        ends = ",".join(str(c) for c in sorted(convs) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conv_rows(seed, n, width, words):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(4 * n), n):
        for t in range(pick.randint(1, width)):
            rows.append((c, t, pick.choice(["user", "assistant", None]), pick.choice(words), 1, "x", "y"))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("shard_rows", [1000, 7, 1])
def test_trie_equals_brute_force(spark, shard_rows):
    rows = conv_rows(3, 60, 5, ["a b", "a b c", "", None, " d\té "])
    rows += [(c, t, "user", "same words again", 1, "x", "y") for c in range(300, 330) for t in range(3)]
    rows += [(-5, 0, "user", "below zero", 1, "x", "y"), (None, 0, "user", "nobody", 1, "x", "y"), (401, None, "user", "first", 1, "x", "y")]
    rows += [(401, 0, "user", "tie", 1, "x", "y"), (401, 0, "user", "tie", 1, "x", "y"), (401, 0, None, "tie", 1, "x", "y")]
    found = conversations.trie(spark.createDataFrame(rows, CONV).repartition(3), shard_rows=shard_rows)
    assert sorted(map(tuple, found.collect()), key=str) == brute_trie(rows)


@pytest.mark.parametrize("shard_rows", [1000, 3])
def test_trie_of_long_conversations(spark, shard_rows):
    """Deeper than one block of columns, beside short ones; copies of a long one reach over shards."""
    rows = [(c, t, "user", f"turn {t}", 1, "x", "y") for c in range(1, 12) for t in range(70)]
    rows += [(c, t, "user", f"turn {t if t < 40 else -c}", 1, "x", "y") for c in range(20, 24) for t in range(75)]
    rows += [(c, 0, "user", "turn 0", 1, "x", "y") for c in range(40, 50)] + [(61, t, "user", f"turn {t}", 1, "x", "y") for t in range(32)]
    found = conversations.trie(spark.createDataFrame(rows, CONV), shard_rows=shard_rows)
    assert sorted(map(tuple, found.collect()), key=str) == brute_trie(rows)


def test_trie_of_conversations_without_turns(spark):
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)
    rows = [(lone, 0, "user", "gone", 1, "x", "y")]
    [root] = conversations.trie(spark.createDataFrame(rows, CONV)).collect()
    ends = hashlib.sha256(str(lone).encode()).hexdigest()
    assert tuple(root) == (lone, 0, None, 1, 0, 1, 0, ends)
    assert conversations.trie(spark.createDataFrame([], CONV)).count() == 0
    assert conversations.trie(spark.createDataFrame([(None, 1, "a", "b", 1, "x", "y")], CONV)).count() == 0


def test_swaps_walk_through_all_orders():
    for n in range(1, 7):
        order, seen = list(range(n)), {tuple(range(n))}
        for k in filter_audit.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.add(tuple(order))
        assert len(seen) == len(list(itertools.permutations(range(n))))
        assert len(list(filter_audit.adjacent_swaps(n))) == len(seen) - 1


def brute_steps(rows, names):
    """Rows (mask, good, toxic), one a document."""
    out = set()
    total = Counter()
    for order in itertools.permutations(range(len(names))):
        left = list(rows)
        for f in order:
            total[f] += sum(m >> f & 1 for m, _, _ in left)
            left = [r for r in left if not r[0] >> f & 1]
    for order in itertools.permutations(range(len(names))):
        left = list(rows)
        for step, f in enumerate(order, 1):
            gone = [r for r in left if r[0] >> f & 1]
            left = [r for r in left if not r[0] >> f & 1]
            failing = sum(m >> f & 1 for m, _, _ in rows)
            alone = sum(m == 1 << f for m, _, _ in rows)
            lost = sum(g for _, g, _ in gone), sum(t for _, _, t in gone)
            out.add(("".join(names[v] for v in order), step, len(left), len(gone), failing - len(gone), alone, *lost, total[f]))
    return out


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 31), st.integers(0, 1), st.integers(0, 1)), max_size=40))
def test_diagram_steps(rows):
    counts = {}
    for mask, good, toxic in rows:
        a, b, c = counts.get(mask, (0, 0, 0))
        counts[mask] = a + 1, b + good, c + toxic
    found = list(filter_audit.steps_of(counts, "ABCDE"))
    assert len(found) == 600 and set(found) == brute_steps(rows, "ABCDE")


def test_audit_of_odd_documents(spark):
    long_text = " ".join(f"w{k}" for k in range(60_000))
    rows = [
        (1, "one two two", "en"), (2, "one two two", "de"), (2, "one two two", "de"), (None, "one two two", "en"), (3, None, None),
        (4, "", "en"), (None, None, None), (5, long_text, "en"), (6, long_text + " $", "en"), (7, "ABC é", "en"), (8, long_text, ""),
    ]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, digest string, n string")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, None), (5, 1, 0), (None, 1, 1), (9, 1, 1)], "doc_id long, quality int, toxic int")
    ids = [(r[0], r[1] or "") for r in rows]
    expected = {}
    for doc, text, lang in rows:
        text = text or ""
        words = text.split()
        tests = [
            len(words) < 200,
            2 * len(set(words)) < len(words),
            100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text),
            any(c in "#$%&*|" for c in text),
            doc is not None and any(i is not None and i < doc and t == text for i, t in ids),
        ]
        mask = sum(t << k for k, t in enumerate(tests))
        expected.setdefault(lang or "", []).append((mask, int(doc in (1, 5)), int(doc == 1)))
    found = {}
    for r in filter_audit.audit_documents(docs, labels).collect():
        found.setdefault(r[0], set()).add(tuple(r)[1:])
    assert found == {part: brute_steps(masks, "ABCDE") for part, masks in expected.items()}
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    assert filter_audit.audit_documents(docs, labels.limit(0)).count() == 600 * 3


@pytest.fixture(scope="module")
def known():
    with open(PATH, "rb") as file:
        return byte_pairs.vocabulary(file.read())


@pytest.fixture(scope="module")
def other(known):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known.ranks, special_tokens={})


def test_queue_finds_the_least_rank():
    queue, pick = byte_pairs.RankQueue(300_000), random.Random(1)
    ranks = [pick.randrange(300_000) for _ in range(500)]
    for place, rank in enumerate(ranks):
        queue.push(rank, place)
    seen = []
    while (rank := queue.least()) >= 0:
        seen += [rank] * len(queue.buckets[rank])
        queue.close(rank)
    assert seen == sorted(ranks) and not any(map(any, queue.levels))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_pieces_equal_the_public_library(known, other, texts):
    pieces = [t.encode() for t in texts if t]
    expected = [other.encode_single_piece(p) if hasattr(other, "encode_single_piece") else other._encode_single_piece(p) for p in pieces]
    ids = [byte_pairs.np.frombuffer(x, "<u4").tolist() for x in known.encode_pieces(pieces)]
    assert ids == expected


def test_long_pieces(known, other):
    pick = random.Random(7)
    pieces = ["a" * 50_000, "ab" * 20_000, "".join(pick.choice("aeinrst") for _ in range(30_000)), "é" * 9_999, " " * 30_001]
    pieces += ["".join(chr(pick.randrange(33, 0x2FFF)) for _ in range(5_000))]
    for piece in pieces:
        [ids] = known.encode_pieces([piece.encode()])
        assert byte_pairs.np.frombuffer(ids, "<u4").tolist() == other._encode_single_piece(piece.encode())


def test_a_rank_below_the_one_being_merged_comes_first():
    """The merge of x and y makes a pair of a lower rank, which takes a byte that another such merge wanted."""
    ranks = {bytes([k]): k for k in range(256)} | {b"xyx": 256, b"xy": 300, b"yx": 301}
    lines = b"\n".join(base64.b64encode(t) + b" " + str(r).encode() for t, r in ranks.items())
    own = byte_pairs.Vocabulary(lines)
    like = tiktoken.Encoding("x", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})
    for text in ("xyxy", "xyxyx", "xxyxyxyxx", "yxyxyx", "xyxyxyxyxyxy"):
        [ids] = own.encode_pieces([text.encode()])
        assert byte_pairs.np.frombuffer(ids, "<u4").tolist() == like.encode_ordinary(text)


def test_texts_round_trip(spark, other, monkeypatch):
    monkeypatch.setattr(byte_pairs, "_RUN_CHARS", 1 << 20)
    prose = " ".join(f"word{k % 977} of{k % 13}" for k in range(30_000))
    texts = ["", None, " \t\n", "plain text", prose, prose, "<|endoftext|> it's 12345 ünï çödé ﷽ 😀\r\n\r\n  x", "a" * 70_000, prose * 6]
    docs = spark.createDataFrame([(k if k else None, t, "x", "y") for k, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens string")
    rows = byte_pairs.encode(docs, PATH, public_tokenizers.PATTERN, decoded=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        text = texts[r.doc_id or 0] or ""
        ids = byte_pairs.np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert ids == other.encode_ordinary(text) and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
    again = byte_pairs.decode(byte_pairs.encode(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert Counter(bytes(r.decoded) for r in again) == Counter((t or "").encode() for t in texts)
    assert byte_pairs.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_query_13_equals_the_public_library(spark, other):
    from lumenlake.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    found = {r.doc_id: tuple(r)[1:] for r in QUERIES["op13_byte_bpe"](spark, sf).collect()}
    for doc in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = doc.text or ""
        ids = byte_pairs.np.array(other.encode_ordinary(text), "<u4")
        assert found[doc.doc_id] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
