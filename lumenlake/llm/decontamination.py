"""Benchmark decontamination: latent semantic search for passages, then common subsequence and answer checks.

Words of all documents are hashed to features and weighted by inverse frequency over all of them; the very common ones
weigh nothing. One pass over the passages in which words of the benchmark carry a part of the weight gives a single-pass
randomised SVD of their TF-IDF matrix (Nystroem: from the sample A'A O of a random O). Every passage is searched, whatever
that part. A passage's vector is its latent part, and a random projection of what the leading directions leave out: without that part passages of rare
words, which benchmark passages are, would all look like their language. The cosine of two vectors then estimates the
cosine of the TF-IDF passages. Runs of words that a document shares with an item are candidates too, so that an item
that is there word for word is never missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import numbered, parts, pieces, saved, words_of
from lumenlake.llm.sums import SCHEMA, slices, tree_sum
from lumenlake.plans.parallel import spread

FEATURE_BITS = 18
FEATURES = 1 << FEATURE_BITS
#: Latent directions kept, directions sampled, and the length of a passage's vector.
LATENT, SAMPLED, LENGTH = 20, 24, 128
#: A feature weighs nothing if it is more than one word in ``COMMON`` and occurs more than ``COMMON_LEAST`` times.
COMMON, COMMON_LEAST = 3000, 100
#: Part of a passage's weight that words of the benchmark must carry for the latent directions to be fitted to it.
LEAST_SHARE = 0.2
#: A passage is two blocks of so many words.
BLOCK = 16
LEAST_COSINE = 0.38
LEAST_COMMON = 0.6
LEAST_ANSWER = 0.5
#: Benchmark words searched for at once; a larger benchmark is searched for in several passes.
BENCH_WORDS = 2_000_000
#: Items of fewer words are words, not passages.
SHORTEST = 3
#: A run of so many words that a document shares with an item makes it a candidate; a shorter item is one run.
RUN = 5
_FLAGS = 24
_EDGES = "\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~!¿¡«»„“”‚‘’…–—"
_SLICE = 4096
#: Words worked on at once; more for the SVD, where every run adds to whole rows of features.
_RUN, _SAMPLE_RUN = 100_000, 500_000
_PART = 1 << 13
#: Rows of features made at once.
_ROWS = 1 << 10


def _plain_hashes(words: list[bytes]) -> np.ndarray:
    """32-bit hashes of words in lower case, without the marks around them; 0 for nothing else than marks."""
    if not words:
        return np.zeros(0, np.uint32)
    plain = [w.strip(_EDGES).encode() for w in b"\n".join(words).decode().lower().split("\n")]
    hashes = np.fromiter(map(xxhash.xxh32_intdigest, plain), np.uint32, len(plain))
    hashes[hashes == 0] = 1
    hashes[np.fromiter(map(len, plain), np.int64, len(plain)) == 0] = 0
    return hashes


def _words_hashed(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The hashes of the words of each text of a batch; each distinct word is hashed once."""
    numbers, distinct, sizes = words_of(batch)
    hashes = _plain_hashes(distinct)[numbers]
    return [h[h > 0] for h in np.split(hashes, np.cumsum(sizes)[:-1])] if len(sizes) else []


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches):
        words = [h.tobytes() for h in _words_hashed(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["id", "words"])


def hashed_words(rows: DataFrame, id_column: str) -> DataFrame:
    """(id, words): the word hashes of every whole text, four bytes each."""
    slim = spread(rows.select(F.col(id_column).cast("long").alias("id"), "text"))
    return saved(slim.mapInArrow(_hashed, "id long, words binary"), "words")


def _words(batches: Iterator[pa.RecordBatch], run: int = _RUN) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(ids, word hashes of all rows, number of words of each row) of runs of about ``run`` words."""
    for batch in batches:
        raw, ids = batch.column("words").to_pylist(), batch.column("id").to_pylist()
        for a, b in pieces([len(w) // 4 for w in raw], run):
            yield ids[a:b], np.frombuffer(b"".join(raw[a:b]), np.uint32), np.array([len(w) // 4 for w in raw[a:b]], np.int64)


def _blocks(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of each block, first word of each block), counting words through the batch; empty rows have none."""
    counts = -(-sizes // BLOCK)
    row = np.repeat(np.arange(len(sizes)), counts)
    within = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, np.repeat(np.cumsum(sizes) - sizes, counts) + within * BLOCK


def _pairs(row: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Passages: the sum of each block and the next one of its row."""
    out = sums.copy()
    same = row[1:] == row[:-1]
    out[:-1][same] += sums[1:][same]
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(FEATURES, np.int64)
    for _, hashes, _ in _words(batches):
        counts += np.bincount(hashes & np.uint32(FEATURES - 1), minlength=FEATURES)
    yield slices(counts, TaskContext.get().partitionId(), _SLICE)


def inverse_frequency(words: DataFrame) -> np.ndarray:
    """Weight of every feature from its occurrences in all texts; 0 for very common ones."""
    counts = tree_sum(words.mapInArrow(_count, SCHEMA), "int64", FEATURES)
    total = max(1, int(counts.sum()))
    weight = np.log((total + 1) / (counts + 1.0)).astype(np.float32)
    weight[(counts > total / COMMON) & (counts > COMMON_LEAST)] = 0
    return weight


def _random() -> np.ndarray:
    return np.random.default_rng(1).standard_normal((FEATURES, SAMPLED), np.float32)


class _Passages:
    """The passages of a run of texts with a weighing word, and the weighing words of their blocks, in a row.

    With ``flags``, only those in which words of the benchmark carry ``LEAST_SHARE`` of the weight.
    """

    def __init__(self, weight: np.ndarray, flags: np.ndarray | None, hashes: np.ndarray, sizes: np.ndarray):
        self.row, self.first = _blocks(sizes)
        feature = (hashes & np.uint32(FEATURES - 1)).astype(np.int64)
        energy = weight[feature] ** 2
        total = _pairs(self.row, np.add.reduceat(energy, self.first))
        keep = total > 0
        if flags is not None:
            known = np.where(flags[hashes & np.uint32((1 << _FLAGS) - 1)], energy, 0)
            mine = _pairs(self.row, np.add.reduceat(known, self.first))
            keep = (mine > 0) & (mine >= LEAST_SHARE * total)
        need = keep.copy()
        need[1:] |= keep[:-1] & (self.row[1:] == self.row[:-1])
        #: kept passages, the blocks they are made of, and the place of each passage's blocks in these (-1: none)
        self.kept, blocks = np.flatnonzero(keep), np.flatnonzero(need)
        place = np.full(len(keep) + 1, -1)
        place[blocks] = np.arange(len(blocks))
        follows = np.append(self.row[1:] == self.row[:-1], False)[self.kept]
        self.one, self.two = place[self.kept], np.where(follows, place[np.minimum(self.kept + 1, len(keep))], -1)
        lengths = np.diff(np.append(self.first, len(feature)))
        inside = np.repeat(need, lengths) & (energy > 0)
        self.feature = feature[inside]
        self.block = np.repeat(place[:-1], lengths)[inside]
        self.blocks = len(blocks)

    def add_up(self, table: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """Sums of table rows over the words of each kept passage: of a number of blocks the first words, then the second ones."""
        sums = np.zeros((self.blocks + 1, table.shape[1]), np.float32)  # the last row stands for no block
        starts = np.flatnonzero(np.diff(self.block, prepend=-1))
        counts = np.diff(np.append(starts, len(self.block)))
        step = -(-step // table.shape[1])
        for a in range(0, len(starts), step):
            longest = a + np.argsort(-counts[a : a + step], kind="stable")
            first, count = starts[longest], counts[longest]
            added = table[self.feature[first]]
            for k in range(1, int(count[0])):
                more = np.count_nonzero(count > k)
                added[:more] += table[self.feature[first[:more] + k]]
            sums[self.block[first]] = added
        return sums[self.one] + sums[self.two]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Sums of the values of the kept passages that each block is in."""
        out = np.zeros((self.blocks + 1, values.shape[1]), values.dtype)
        out[self.one] += values
        out[self.two] += np.where(self.two[:, None] >= 0, values, 0)
        return out


class _Sample:
    """Partial sums of A'A O over the passages of a task that go on."""

    def __init__(self, weight: np.ndarray, flags: np.ndarray):
        self.weight, self.flags = weight, flags

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _random() * self.weight[:, None]
        square = (self.weight**2)[:, None]
        flags = np.unpackbits(self.flags).view(bool)
        out = np.zeros((SAMPLED, FEATURES))
        for _, hashes, sizes in _words(batches, _SAMPLE_RUN):
            if not len(hashes):
                continue
            found = _Passages(self.weight, flags, hashes, sizes)
            y = found.add_up(table) / np.maximum(found.add_up(square), 1e-9)
            back = found.spread(y)
            for k in range(SAMPLED):
                out[k] += np.bincount(found.feature, back[found.block, k], FEATURES)
        for a in range(0, FEATURES, _SLICE):  # a slice at a time: the sums are never there twice
            part = (out[:, a : a + _SLICE] * self.weight[a : a + _SLICE]).T.astype(np.float32)
            yield slices(part, TaskContext.get().partitionId(), _SLICE * SAMPLED, a // _SLICE)


def latent_directions(words: DataFrame, weight: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The leading right singular vectors of the passages that go on (features x latent), by a randomised SVD in one pass."""
    sample = tree_sum(words.mapInArrow(_Sample(weight, flags), SCHEMA), "float32", FEATURES * SAMPLED).reshape(FEATURES, SAMPLED)
    core = _products(_random(), sample)
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > 1e-6 * max(values.max(initial=0), 1e-30)
    found = np.zeros((FEATURES, LATENT), np.float32)
    if not good.any():
        return found
    # the left singular vectors of B = sample x root come from the small matrix B'B
    root = vectors[:, good] / np.sqrt(values[good])
    squares, turns = np.linalg.eigh(root.T @ _products(sample, sample) @ root)
    best = np.argsort(-squares)[:LATENT]
    best = best[squares[best] > 1e-6 * max(squares.max(), 1e-30)]
    turn = (root @ (turns[:, best] / np.sqrt(squares[best]))).astype(np.float32)
    for a, b in _parts():
        found[a:b, : len(best)] = sample[a:b] @ turn
    return found


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """x'y in double precision, a part of the features at a time."""
    return sum(x[a:b].T.astype(np.float64) @ y[a:b].astype(np.float64) for a, b in _parts())


def _parts() -> list[tuple[int, int]]:
    return [(a, a + _PART) for a in range(0, FEATURES, _PART)]


def _signs(first: int, end: int) -> np.ndarray:
    """Random signs for a part of the features: a projection as good as a Gaussian one."""
    count = (end - first) * (LENGTH - LATENT)
    octets = np.random.default_rng([2, first]).integers(0, 256, count // 8, np.uint8)
    return (np.unpackbits(octets).astype(np.float32) * 2 - 1).reshape(end - first, LENGTH - LATENT)


class Space:
    """Vectors of passages, from random signs and the latent directions; a task makes the rows of the features it meets."""

    def __init__(self, weight: np.ndarray, latent: np.ndarray):
        self.weight, self.latent = weight, latent.astype(np.float16)  # half the bytes to send
        self.mixed = sum(self.latent[a:b].astype(np.float32).T @ _signs(a, b) for a, b in _parts())

    def packed(self) -> np.ndarray:
        """The signs of each feature as bits: drawn part by part, so that a task holds a byte for eight of them."""
        return np.concatenate([np.packbits(_signs(a, b) > 0, axis=1) for a, b in _parts()])

    def rows(self, features: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """The row of each of the features."""
        table = np.empty((len(features), LENGTH), np.float32)
        for a in range(0, len(features), _ROWS):
            mine, out = features[a : a + _ROWS], table[a : a + _ROWS]
            latent, weight = self.latent[mine].astype(np.float32), self.weight[mine, None]
            rest = np.unpackbits(packed[mine], axis=1, count=LENGTH - LATENT).astype(np.float32)
            rest *= 2
            rest -= 1
            rest -= latent @ self.mixed
            rest /= np.sqrt(LENGTH - LATENT)
            out[:, :LATENT], out[:, LATENT:] = latent * weight, rest * weight
        return table


def _numbered_features(features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct features in order, the place of each one among them)."""
    seen = np.zeros(FEATURES, bool)
    seen[features] = True
    distinct = np.flatnonzero(seen)
    place = np.empty(FEATURES, np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[features]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows over the words of ``a``."""
    places: dict[int, int] = {}
    for k, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        match = row & places.get(word, 0)
        row = (row + match | row - match) & full
    return len(a) - row.bit_count()


def _runs_of(hashes: np.ndarray, length: int) -> np.ndarray:
    """A number for the run of ``length`` words that starts at each word, up to the last whole one."""
    out = np.zeros(max(0, len(hashes) - length + 1), np.uint64)
    for k in range(length):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += hashes[k : len(hashes) - length + 1 + k].astype(np.uint64) + np.uint64(length)
        out ^= out >> np.uint64(29)
    return out


class _Shared:
    """The runs of all items, by length; finds where a text shares one."""

    BITS = 22

    def __init__(self, items: list[np.ndarray]):
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, words in enumerate(items):
            length = min(RUN, len(words))
            by_length.setdefault(length, []).append((_runs_of(words, length), k))
        self.tables = []
        for length, runs in sorted(by_length.items()):
            numbers = np.concatenate([r for r, _ in runs])
            of = np.concatenate([np.full(len(r), k) for r, k in runs])
            at = np.concatenate([np.arange(len(r)) for r, _ in runs])
            order = np.argsort(numbers, kind="stable")
            seen = np.zeros(1 << self.BITS, bool)
            seen[numbers >> np.uint64(64 - self.BITS)] = True
            self.tables.append((length, numbers[order], of[order], at[order], seen))

    def __call__(self, hashes: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, item, word of the run of texts at which the item would begin), each once."""
        ends = np.cumsum(sizes)
        for length, numbers, of, at, seen in self.tables:
            runs = _runs_of(hashes, length)
            places = np.flatnonzero(seen[runs >> np.uint64(64 - self.BITS)])
            low, high = (np.searchsorted(numbers, runs[places], side) for side in ("left", "right"))
            hit = high > low
            places, low, counts = places[hit], low[hit], (high - low)[hit]
            row = np.searchsorted(ends, places, "right")
            inside = places + length <= ends[np.minimum(row, len(ends) - 1)]
            places, low, counts, row = places[inside], low[inside], counts[inside], row[inside]
            entry = np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
            found = np.stack([np.repeat(row, counts), of[entry], np.repeat(places, counts) - at[entry]], axis=1)
            yield from map(tuple, np.unique(found, axis=0).tolist())


class _Search:
    """Rows (id, item, cosine, common, words, answer, route) of the documents of a task that hold a benchmark item."""

    def __init__(self, space: Space, items: list[tuple[int, np.ndarray]]):
        self.space, self.items = space, items

    def _item_vectors(self, packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spans, of = [], []
        for k, (_, words) in enumerate(self.items):
            starts = {*range(0, max(1, len(words) - 2 * BLOCK + 1), 2 * BLOCK), max(0, len(words) - 2 * BLOCK)}
            spans += [words[a : a + 2 * BLOCK] for a in sorted(starts)]
            of += [k] * len(starts)
        distinct, places = _numbered_features((np.concatenate(spans) & np.uint32(FEATURES - 1)).astype(np.int64))
        table, ends = self.space.rows(distinct, packed), np.cumsum([len(s) for s in spans])
        sums = np.stack([table[p].sum(axis=0, dtype=np.float32) for p in np.split(places, ends[:-1])])
        return sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9), np.array(of)

    def _answers(self) -> list[set[int]]:
        """The last quarter of an item's words, three at least: questions come first, answers last."""
        return [set(words[-max(3, len(words) // 4) :].tolist()) for _, words in self.items]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = self.space.packed()
        vectors, of = self._item_vectors(packed)
        shared = _Shared([words for _, words in self.items])
        answers, lists = self._answers(), [words.tolist() for _, words in self.items]
        for ids, hashes, sizes in _words(batches):
            best: dict[tuple[int, int], tuple] = {}
            if len(hashes):
                ends = np.cumsum(sizes)

                def check(doc: int, k: int, a: int, b: int, cosine: float | None) -> None:
                    """Look for item k in the words from a to b of a document."""
                    low, high = int(ends[doc] - sizes[doc]), int(ends[doc])
                    span = hashes[max(low, a) : min(high, b)].tolist()
                    common = common_subsequence(lists[k], span)
                    if common < LEAST_COMMON * len(lists[k]):
                        return
                    answer = len(answers[k].intersection(span)) / len(answers[k])
                    if answer >= LEAST_ANSWER:
                        before = best.get((doc, k), (0, 0.0, None, None))
                        seen = [c for c in (cosine, before[2]) if c is not None]
                        words = "words" if cosine is None or before[3] == "words" else None
                        best[doc, k] = (*max(before[:2], (common, answer)), max(seen, default=None), words)

                found = _Passages(self.space.weight, None, hashes, sizes)
                distinct, found.feature = _numbered_features(found.feature)
                passages = found.add_up(self.space.rows(distinct, packed))
                passages /= np.maximum(np.linalg.norm(passages, axis=1, keepdims=True), 1e-9)
                for a in range(0, len(passages), 2048):
                    cosines = passages[a : a + 2048] @ vectors.T
                    near = np.flatnonzero(cosines >= LEAST_COSINE)
                    for p, v in zip(*np.divmod(near, len(vectors))):
                        k, block = int(of[v]), found.kept[a + p]
                        at, n = int(found.first[block]), len(lists[k])
                        check(int(found.row[block]), k, at - n, at + 2 * BLOCK + n, float(cosines[p, v]))
                for doc, k, at in shared(hashes, sizes):
                    margin = BLOCK if len(lists[k]) > RUN else 0
                    check(doc, k, at - margin, at + len(lists[k]) + margin, None)
            rows = [(ids[d], self.items[k][0], c, n, len(lists[k]), s, c is not None, w is not None) for (d, k), (n, s, c, w) in best.items()]
            columns = list(zip(*rows)) or [[]] * 8
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_())
            names = ["doc_id", "item_id", "cosine", "common_words", "item_words", "answer_share", "by_cosine", "by_words"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


_FOUND = (
    "doc_id long, item_id long, cosine double, common_words long, item_words long, answer_share double,"
    " by_cosine boolean, by_words boolean"
)


def _flags(blocks: Iterator[list[tuple[int, np.ndarray]]]) -> np.ndarray:
    """A bit for the low bits of every benchmark word's hash, packed."""
    flags = np.zeros(1 << _FLAGS, bool)
    for items in blocks:
        for _, words in items:
            flags[words & np.uint32((1 << _FLAGS) - 1)] = True
    return np.packbits(flags)


def find_leaks(docs: DataFrame, benchmark: DataFrame, bench_words: int = BENCH_WORDS) -> DataFrame:
    """One row for each document that holds a benchmark item: cosine, common words in order, and answer words found.

    Candidates are all passages (every 16 words, 32 long, of whole texts) whose vector has a cosine of ``LEAST_COSINE``
    or more with one of the item's (``by_cosine``; else the cosine is null), and places that share ``RUN`` words in a row with the item, or all of a
    shorter one (``by_words``). A candidate counts if ``LEAST_COMMON`` of the item's words follow in its order around
    the place, and ``LEAST_ANSWER`` of its answer, the last quarter of its words, is there. So an item that a document
    holds word for word is always found.

    The benchmark is a query set searched against all rows. It is sent to the tasks in blocks of at most about
    ``bench_words`` words, each a pass of its own; the driver holds one block at a time, and the result of each of
    several passes is written. Items under ``SHORTEST`` words are not searched for. Words are compared in lower case
    without the marks around them. Null and empty texts hold nothing; a null doc_id or item_id is reported as null;
    rows that repeat an id are searched each; items that repeat are reported each. Without documents or items there
    are no rows.
    """
    spark = docs.sparkSession
    items = hashed_words(benchmark, "item_id").where(f"octet_length(words) >= {4 * SHORTEST}")
    n_words = items.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    passes = -(-n_words // (4 * bench_words))
    none = spark.createDataFrame([], _FOUND)
    if not passes:
        return none

    def block(number: int) -> list[tuple[int, np.ndarray]]:
        rows = items.where(F.pmod(F.xxhash64("words"), F.lit(passes)) == number).collect()
        return [(r.id, np.frombuffer(r.words, np.uint32)) for r in rows]

    flags = _flags(map(block, range(passes)))
    words = hashed_words(docs, "doc_id")
    weight = inverse_frequency(words)
    space = Space(weight, latent_directions(words, weight, flags))
    found = []
    for number in range(passes):
        mine = block(number)
        if mine:
            rows = words.mapInArrow(_Search(space, mine), _FOUND)
            found.append(rows if passes == 1 else saved(rows, "leaks"))
    return reduce(DataFrame.unionByName, found, none) if len(found) != 1 else found[0]


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark item.

    Every row is judged by its own text, also rows without a doc_id and rows that repeat one.
    """
    rows, row = numbered(docs)
    leaks = find_leaks(rows.select(F.col(row).alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(row)).distinct()
    return rows.join(leaks, row, "left_anti").drop(row)
