"""Brown class-based bigram model: exchange clustering of words, class transitions and word emissions.

Texts are cut into words once: a chunk of documents is one row that holds the numbers of its words in packed arrays. All
counts of all training texts are exact: chunks send the hashes and counts of their distinct words to ranges of hashes,
and get the totals back. Then every word of the vocabulary gets a class by exchange:

1. The commonest words one by one, and all others in groups by their ending, are the units of an exact exchange over
   the counts of unit pairs.
2. Each round takes one part of the other words. Chunks send, for every word of the part, how often each class stands
   before and after it; ranges add that up and move each word to the class with the largest likelihood of all bigrams,
   the class counts of the last round held fixed. A round that does not raise the likelihood is taken back.

Only words seen once keep the class of their ending: one bigram on either side says little about them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import NO_ID, bucketed, ids_of, parts, per_text, remainder, saved, texts_of
from lumenlake.llm.sums import SCHEMA, slices, tree_sum
from lumenlake.plans.parallel import spread

#: The end of a text as a token; no word holds a blank.
END = b" "
#: Words clustered one by one, and the number of ending units for all others at first.
UNITS, ENDINGS = 1000, 64
CLASSES = 64
ROUNDS = 5
#: Parts of the vocabulary, one moved in each round, and the least count of a word that moves.
PARTS, LEAST = 4, 2
#: How often every part has its round.
SWEEPS = 1
#: Part of a count that a class gives to words it has not seen, and the weight of class frequencies in transitions.
DISCOUNT, SMOOTH = 0.5, 20.0
BASE = 0.1
_CHUNK = 6 << 20
_SLICE = 1 << 15
#: Words of chunks that one range of hashes holds, about.
_RANGE = 1 << 19
#: Counts of neighbours that a range weighs between two updates of its class counts, at most, and a range's least blocks.
_BLOCK, _BLOCKS = 1 << 14, 32
_END_KEY, _END_MORE = np.frombuffer(xxhash.xxh3_128_digest(END), "<u8").tolist()

_CODED = (
    "chunk long, ids binary, train binary, sizes binary, codes binary, keys binary, more binary, counts binary,"
    " endings binary, words long"
)
_COUNTED = "range long, chunk long, keys binary, more binary, counts binary"
_TOTALS = "chunk long, range long, totals binary, first binary, numbers binary, keys binary, more binary"
_STATE = "chunk long, totals binary, first binary, numbers binary, ranges binary, lengths binary"
_CLASSES = "chunk long, classes binary, single binary"
_ENTRIES = "range long, chunk long, numbers binary, classes binary, entries binary, times binary"
_MOVED = "chunk long, range long, moved binary"
_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(v, _KINDS[k]) for v, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _each(batches: Iterator[pa.RecordBatch], **kinds: type) -> Iterator[tuple]:
    """(chunk, array, array, ...) of every row, the arrays of the named columns; null is empty."""
    for batch in batches:
        for k in range(batch.num_rows):
            arrays = (np.frombuffer(batch.column(c)[k].as_buffer() or b"", kind) for c, kind in kinds.items())
            yield batch.column("chunk")[k].as_py(), *arrays


def ending(word: str) -> int:
    """Unit of a word by its last two letters."""
    return zlib.crc32(word[-2:].encode()) % ENDINGS


class _Numbers(dict):
    """Numbers of words in the order in which they are first met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class _Code:
    """Documents of a partition as chunks of word numbers, the distinct words of a chunk sorted by their hash."""

    def __init__(self, chunk_bytes: int):
        self.chunk_bytes = chunk_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        learn: list[bool] = []
        texts: list[bytes] = []
        size = 0
        for batch in parts(batches, self.chunk_bytes // 4):
            found = texts_of(batch)
            texts += found
            ids += ids_of(batch).tolist()
            learn += batch.column("train").to_pylist()
            size += sum(map(len, found))
            if size >= self.chunk_bytes:
                yield self.coded(number, ids, learn, texts)
                number, ids, learn, texts, size = number + 1, [], [], [], 0
        if texts:
            yield self.coded(number, ids, learn, texts)

    def coded(self, chunk: int, ids: list[int], learn: list[bool], texts: list[bytes]) -> pa.RecordBatch:
        of = _Numbers()
        end = of[END]
        numbers: list[int] = []
        sizes = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = text.lower().split()
            sizes[k] = len(words) + 1
            numbers += map(of.__getitem__, words)
            numbers.append(end)
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, of)), "<u8").reshape(-1, 2)
        more = (hashes[:, 1] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((more, hashes[:, 0]))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        codes = rank[np.array(numbers, np.int64)]
        train = np.array(learn, bool)
        counts = np.bincount(codes[np.repeat(train, sizes)], minlength=len(order))
        endings = np.array([ending(w.decode()) for w in of], np.uint8)[order]
        arrays = (np.array(ids, np.int64), train, sizes, codes, hashes[order, 0], more[order], counts, endings)
        return _batch(_CODED, [(chunk, *[a.tobytes() for a in arrays], len(order))])


def _runs(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of sorted hashes."""
    of = (keys >> np.uint64(64 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)]).tolist()
    return [(int(of[a]), a, b) for a, b in zip(at, [*at[1:], len(of)])]


def _send_counts(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches):
        for chunk, keys, more, counts in _each(batches, keys=np.uint64, more=np.uint32, counts=np.int64):
            rows = [(r, chunk, *(x[a:b].tobytes() for x in (keys, more, counts))) for r, a, b in _runs(keys, bits)]
            yield _batch(_COUNTED, rows)

    return send


def _joined(table: pa.Table, column: str, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all values of a binary column, where each row's values end)."""
    arrays = [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]
    return np.concatenate(arrays), np.cumsum([len(x) for x in arrays])


def _merge_counts(units: int) -> Callable[[pa.Table], pa.Table]:
    """Totals of a range's words for each chunk, in a row without a chunk the commonest words of the range."""

    def merge(sent: pa.Table) -> pa.Table:
        (key, ends), (more, _), (count, _) = (_joined(sent, c, k) for c, k in (("keys", np.uint64), ("more", np.uint32), ("counts", np.int64)))
        order = np.lexsort((more, key))
        sorted_key, sorted_more = key[order], more[order]
        new = np.r_[True, (sorted_key[1:] != sorted_key[:-1]) | (sorted_more[1:] != sorted_more[:-1])]
        at = np.flatnonzero(new)
        total = np.add.reduceat(count[order], at)
        number = np.empty(len(order), np.uint32)
        number[order] = np.cumsum(new) - 1
        first = np.zeros(len(order), bool)
        first[order[at]] = True
        cut = [np.split(x, ends[:-1]) for x in (total[number], first, number)]
        places = zip(sent.column("chunk").to_pylist(), sent.column("range").to_pylist())
        rows = [(*place, *[x.tobytes() for x in arrays], None, None) for place, *arrays in zip(places, *cut)]
        plain = (total > 0) & ~((sorted_key[at] == _END_KEY) & (sorted_more[at] == _END_MORE >> 32))
        best = np.flatnonzero(plain)
        best = best[np.lexsort((sorted_more[at][best], sorted_key[at][best], -total[best]))[:units]]
        rows.append((None, None, total[best].tobytes(), None, None, sorted_key[at][best].tobytes(), sorted_more[at][best].tobytes()))
        return pa.Table.from_batches([_batch(_TOTALS, rows)])

    return merge


def _list_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, total, keys, more in _each(batches, totals=np.int64, keys=np.int64, more=np.uint32):
        yield _batch("total long, key long, more long", list(zip(total.tolist(), keys.tolist(), more.tolist())))


def _by_range(answers: pa.Table) -> pa.Table:
    return answers.sort_by("range")


def _gather(answers: pa.Table) -> pa.Table:
    """A chunk's answers in the order of its words."""
    rows = _by_range(answers)
    joined = [b"".join(rows.column(c).to_pylist()) for c in ("totals", "first", "numbers")]
    lengths = np.array([len(x) for x in rows.column("first").to_pylist()], np.int64)
    ranges = np.array(rows.column("range").to_pylist(), np.int64)
    return pa.Table.from_batches([_batch(_STATE, [(rows.column("chunk")[0].as_py(), *joined, ranges.tobytes(), lengths.tobytes())])])


def _gather_moved(answers: pa.Table) -> pa.Table:
    rows = _by_range(answers)
    return pa.Table.from_batches([_batch("chunk long, moved binary", [(rows.column("chunk")[0].as_py(), b"".join(rows.column("moved").to_pylist()))])])


@dataclass
class _Top:
    """Hashes of the words that are units of their own, commonest first."""

    keys: np.ndarray
    more: np.ndarray

    def units(self, keys: np.ndarray, more: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Unit of each word of a chunk: itself, or its ending; the end of a text is the last unit."""
        units = len(self.keys) + endings.astype(np.int64)
        units[(keys == _END_KEY) & (more == _END_MORE >> 32)] = len(self.keys) + ENDINGS
        at = np.searchsorted(keys, self.keys)
        near = np.minimum(at, len(keys) - 1)
        here = (at < len(keys)) & (keys[near] == self.keys) & (more[near] == self.more)
        units[at[here]] = np.flatnonzero(here)
        return units


def _pairs(seq: np.ndarray, kinds: int, end: int) -> np.ndarray:
    """Counts of neighbouring kinds of the training tokens of a chunk; a text begins behind the end of another."""
    before = np.concatenate([[end], seq[:-1]])
    return np.bincount(before * kinds + seq, minlength=kinds**2) if len(seq) else np.zeros(kinds**2, np.int64)


def _unit_pairs(top: _Top) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = len(top.keys) + ENDINGS + 1

    def count(batches):
        total = np.zeros(kinds**2, np.int64)
        columns = {"keys": np.uint64, "more": np.uint32, "endings": np.uint8, "codes": np.int32, "train": bool, "sizes": np.int64}
        for _, keys, more, endings, codes, train, sizes in _each(batches, **columns):
            total += _pairs(top.units(keys, more, endings)[codes[np.repeat(train, sizes)]], kinds, kinds - 1)
        yield slices(total, TaskContext.get().partitionId(), _SLICE)

    return count


def _first_classes(top: _Top, of: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def start(batches):
        for chunk, keys, more, endings in _each(batches, keys=np.uint64, more=np.uint32, endings=np.uint8):
            units = top.units(keys, more, endings)
            single = (units < len(top.keys)) | (units == len(of) - 1)
            yield _batch(_CLASSES, [(chunk, of[units].astype(np.uint8).tobytes(), single.tobytes())])

    return start


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of class pairs, then the number of distinct training words of each class."""
    total = np.zeros(CLASSES**2 + CLASSES, np.int64)
    columns = {"codes": np.int32, "train": bool, "sizes": np.int64, "totals": np.int64, "first": bool, "classes": np.uint8}
    for _, codes, train, sizes, totals, first, classes in _each(batches, **columns):
        of = classes.astype(np.int64)
        total[: CLASSES**2] += _pairs(of[codes[np.repeat(train, sizes)]], CLASSES, CLASSES - 1)
        total[CLASSES**2 :] += np.bincount(of[first & (totals > 0)], minlength=CLASSES)
    yield slices(total, TaskContext.get().partitionId(), _SLICE)


def _movable(totals: np.ndarray, numbers: np.ndarray, single: np.ndarray, part: int) -> np.ndarray:
    return (totals >= LEAST) & (numbers % PARTS == part) & ~single


def _send_neighbours(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For every word of the part: its number and class, and how often each class stands next to it in the chunk.

    An entry is (place among the chunk's words of the range and part) * 256 + 0 or CLASSES + class, for a neighbour
    behind or before it, or 2 * CLASSES for itself.
    """

    def send(batches):
        columns = {"codes": np.int32, "train": bool, "sizes": np.int64, "totals": np.int64, "numbers": np.uint32}
        columns |= {"ranges": np.int64, "lengths": np.int64, "classes": np.uint8, "single": bool}
        for chunk, codes, train, sizes, totals, numbers, ranges, lengths, classes, single in _each(batches, **columns):
            chosen = _movable(totals, numbers, single, part)
            seq = codes[np.repeat(train, sizes)].astype(np.int64)
            at = np.flatnonzero(chosen[seq])
            word, behind = seq[at], seq[at + 1]  # the last token ends a text, and no end is chosen
            before = np.where(at > 0, seq[at - 1], seq[-1] if len(seq) else 0)
            of = classes.astype(np.int64)
            own = word == behind
            entries = np.concatenate(
                [
                    word << 8 | np.where(own, 2 * CLASSES, of[behind]),
                    (word << 8 | CLASSES + of[before])[word != before],
                ]
            )
            entries, times = np.unique(entries, return_counts=True)
            place = np.cumsum(chosen) - 1
            rows, start = [], 0
            for r, length in zip(ranges.tolist(), lengths.tolist()):
                mine = start + np.flatnonzero(chosen[start : start + length])
                if len(mine):
                    a, b = np.searchsorted(entries, [start << 8, (start + length) << 8])
                    packed = (place[entries[a:b] >> 8] - place[mine[0]]) << 8 | entries[a:b] & 255
                    arrays = numbers[mine], classes[mine], packed.astype(np.uint32), times[a:b].astype(np.uint32)
                    rows.append((r, chunk, *[x.tobytes() for x in arrays]))
                start += length
            yield _batch(_ENTRIES, rows)

    return send


def _information(n: np.ndarray) -> np.ndarray:
    return n * np.log(np.maximum(n, 1e-300))


def likelihood(both: np.ndarray) -> float:
    """Part of the log likelihood of all bigrams that depends on the classes, from the counts of class pairs."""
    n = both.astype(np.float64)
    return float(_information(n).sum() - _information(n.sum(axis=0)).sum() - _information(n.sum(axis=1)).sum())


def best_classes(word: np.ndarray, code: np.ndarray, times: np.ndarray, of: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Best class of each word; ``of`` are the classes now.

    ``word`` is sorted; ``code`` is the class of a neighbour behind, CLASSES + that of one before, or 2 * CLASSES for
    the word itself, ``times`` their count. Words are weighed by blocks, each by the class counts that the blocks before
    it left; within a block a word is weighed as the only one that moves, and cells where it and its neighbour both
    change are left out of account. The last class is that of the end of a text alone.
    """
    n = both.astype(np.float64)
    found = of.copy()
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]][: len(word)])
    ends = np.r_[starts[1:], len(word)]
    most = min(_BLOCK, len(word) // _BLOCKS + 1)
    a = 0
    while a < len(starts):
        cells = np.vstack([n.T, n, np.diag(n)])
        heads, tails = n.sum(axis=1), n.sum(axis=0)
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + most, side="right")))
        rows = slice(starts[a], ends[b - 1])
        begin, words = starts[a:b] - starts[a], word[starts[a:b]]
        c, t, now = code[rows].astype(np.int64), times[rows].astype(np.float64), of[words].astype(np.int64)
        kinds, which = np.unique(c << 40 | times[rows].astype(np.int64), return_inverse=True)
        base = cells[kinds >> 40]
        gains = _information(base + (kinds & (1 << 40) - 1)[:, None]) - _information(base)
        gain = np.add.reduceat(gains[which], begin, axis=0)
        lengths = np.diff(np.r_[begin, len(c)])
        old = np.repeat(now, lengths)
        mine = cells[c, old]
        stay = np.add.reduceat(_information(mine) - _information(np.maximum(mine - t, 0)), begin)
        for total, sizes in ((heads, np.where(c // CLASSES == 1, 0, t)), (tails, np.where(c // CLASSES == 0, 0, t))):
            size = np.add.reduceat(sizes, begin)
            gain -= _information(total + size[:, None]) - _information(total)
            stay -= _information(total[now]) - _information(np.maximum(total[now] - size, 0))
        gain[np.arange(len(now)), now] = stay
        best = np.argmax(gain[:, :-1], axis=1)
        better = gain[np.arange(len(now)), best] > stay + 1e-9
        found[words[better]] = best[better]
        new, side, near = found[word[rows]].astype(np.int64), c // CLASSES, c % CLASSES
        for was, sign in ((old, -1), (new, 1)):
            np.add.at(n, (np.where(side == 1, near, was), np.where(side == 0, near, was)), sign * t)
        n = np.maximum(n, 0)
        a = b
    return found


def _move(both: np.ndarray) -> Callable[[pa.Table], pa.Table]:
    def move(sent: pa.Table) -> pa.Table:
        (numbers, ends), (classes, _) = _joined(sent, "numbers", np.uint32), _joined(sent, "classes", np.uint8)
        (entries, sent_ends), (times, _) = _joined(sent, "entries", np.uint32), _joined(sent, "times", np.uint32)
        begin = np.repeat(np.r_[0, ends[:-1]], np.diff(np.r_[0, sent_ends]))
        keys = numbers[begin + (entries >> 8)].astype(np.int64) << 8 | (entries & 255)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
        counts = np.add.reduceat(times[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        of = np.zeros(int(numbers.max()) + 1, np.uint8)
        of[numbers] = classes
        moved = best_classes(keys[at] >> 8, keys[at] & 255, counts, of, both)[numbers]
        cut = [x.tobytes() for x in np.split(moved, ends[:-1])]
        return pa.Table.from_batches([_batch(_MOVED, list(zip(sent.column("chunk").to_pylist(), sent.column("range").to_pylist(), cut)))])

    return move


def _apply(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def apply(batches):
        columns = {"totals": np.int64, "numbers": np.uint32, "classes": np.uint8, "single": bool, "moved": np.uint8}
        for chunk, totals, numbers, classes, single, moved in _each(batches, **columns):
            new = classes.copy()
            new[_movable(totals, numbers, single, part)] = moved
            yield _batch(_CLASSES, [(chunk, new.tobytes(), single.tobytes())])

    return apply


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of every unit, by moving one unit at a time to the class with the largest likelihood of all bigrams.

    ``pairs`` counts unit pairs; the last unit, the end of a text, keeps the last class for itself. Units begin in
    turn, commonest first; a round that moves none ends the search.
    """
    n = pairs.astype(np.float64)
    total = n.sum(axis=0) + n.sum(axis=1)
    order = np.argsort(-total[:-1], kind="stable")
    of = np.full(len(n), classes - 1)
    of[order] = np.arange(len(order)) % (classes - 1)
    member = np.eye(classes)[of]
    left, right = n.T @ member, n @ member  # what stands before and after each unit, by class
    both, heads, tails = member.T @ n @ member, member.T @ n.sum(axis=1), member.T @ n.sum(axis=0)
    out_degree, in_degree = n.sum(axis=1), n.sum(axis=0)
    for _ in range(rounds):
        moved = 0
        for u in order.tolist():
            a, own = of[u], n[u, u]
            after, before = right[u].copy(), left[u].copy()
            after[a] -= own
            before[a] -= own
            both[a, :] -= after
            both[:, a] -= before
            both[a, a] -= own
            heads[a] -= out_degree[u]
            tails[a] -= in_degree[u]
            rows, columns = _information(both + after) - _information(both), _information(both + before[:, None]) - _information(both)
            diagonal = np.diag(both)
            gain = rows.sum(axis=1) - np.diag(rows) + columns.sum(axis=0) - np.diag(columns)
            gain += _information(diagonal + after + before + own) - _information(diagonal)
            gain -= _information(heads + out_degree[u]) - _information(heads) + _information(tails + in_degree[u]) - _information(tails)
            b = int(np.argmax(gain[:-1]))
            if gain[b] <= gain[a] + 1e-9:
                b = int(a)
            both[b, :] += after
            both[:, b] += before
            both[b, b] += own
            heads[b] += out_degree[u]
            tails[b] += in_degree[u]
            if b != a:
                moved += 1
                of[u] = b
                left[:, a] -= n[u]
                left[:, b] += n[u]
                right[:, a] -= n[:, u]
                right[:, b] += n[:, u]
        if not moved:
            break
    return of


class Model:
    """Log10 probabilities of class transitions and of words in their class, and of the unigram base."""

    def __init__(self, both: np.ndarray, distinct: np.ndarray):
        self.counts, self.distinct = both.sum(axis=0), distinct
        self.tokens, self.words = int(both.sum()), int(distinct.sum())
        share = (self.counts + 1) / (self.counts + 1).sum()
        self.transition = np.log10((both + SMOOTH * share) / (both.sum(axis=1, keepdims=True) + SMOOTH))

    def emission(self, n: np.ndarray, of: np.ndarray) -> np.ndarray:
        """A seen word has its count less the discount; all discounts of a class go to its unseen words as one."""
        total, unseen = np.maximum(self.counts[of], 1), np.maximum(DISCOUNT * self.distinct[of], BASE)
        total = np.where(self.counts[of] > 0, total, BASE)
        return np.log10(np.where(n > 0, n - DISCOUNT, unseen) / total)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + BASE) / (self.tokens + BASE * (self.words + 1)))


def _score(m: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches):
        columns = {"ids": np.int64, "train": bool, "sizes": np.int64, "codes": np.int32, "totals": np.int64, "classes": np.uint8}
        for _, ids, train, sizes, at, totals, classes in _each(batches, **columns):
            n, of = totals.astype(np.float64), classes.astype(np.int64)
            behind = of[at]
            before = np.concatenate([[CLASSES - 1], behind[:-1]])  # a text begins behind the end of another
            logs = m.emission(n, of)[at] + m.transition[before, behind]
            arrays = [
                pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()),
                pa.array(~train),
                pa.array(sizes),
                pa.array(per_text(n[at] > 0, sizes)),
                pa.array(np.full(len(sizes), m.tokens)),
                pa.array(per_text(m.base(n)[at], sizes)),
                pa.array(per_text(logs, sizes)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in _SCORED.split(", ")])

    return score


def _beside(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Tables with one row for each chunk next to each other; they are bucketed by it, so nothing is shuffled."""
    for other in others:
        first = first.join(other.hint("merge"), "chunk")
    return first


@dataclass
class Clusters:
    """Tables of chunks: their coded texts, the totals of their words, the classes of these, and the class counts.

    ``steps`` are the likelihoods of the classes at first and after each round that was kept.
    """

    coded: DataFrame
    state: DataFrame
    classes: DataFrame
    both: np.ndarray
    distinct: np.ndarray
    steps: list[float]


def _counted(coded: DataFrame, state: DataFrame, classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = _beside(coded.select("chunk", "codes", "train", "sizes"), state.select("chunk", "totals", "first"), classes)
    sums = tree_sum(rows.mapInArrow(_statistics, SCHEMA), "int64", CLASSES**2 + CLASSES)
    return sums[: CLASSES**2].reshape(CLASSES, CLASSES), sums[CLASSES**2 :]


def cluster_words(docs: DataFrame, train: Column, units: int = UNITS, chunk_bytes: int = _CHUNK, sweeps: int = SWEEPS) -> Clusters:
    """Class of every word of the documents by exchange, from the bigrams of the documents that ``train`` marks."""
    slim = spread(docs.select("doc_id", "text", train.alias("train")))
    coded = bucketed(slim.mapInArrow(_Code(chunk_bytes), _CODED), "coded")
    held = coded.agg(F.sum("words")).first()[0] or 0
    bits = max(1, (held // _RANGE).bit_length())
    sent = coded.select("chunk", "keys", "more", "counts").mapInArrow(_send_counts(bits), _COUNTED)
    answers = saved(sent.groupBy("range").applyInArrow(_merge_counts(units), _TOTALS), "word_counts")
    best = answers.where("chunk is null").mapInArrow(_list_top, "total long, key long, more long")
    best = best.orderBy(F.desc("total"), "key", "more").limit(units).collect()
    top = _Top(np.array([r.key for r in best], np.int64).view(np.uint64), np.array([r.more for r in best], np.uint32))
    told = answers.where("chunk is not null").select("chunk", "range", "totals", "first", "numbers")
    state = bucketed(told.groupBy("chunk").applyInArrow(_gather, _STATE), "totals")

    side = len(best) + ENDINGS + 1
    words = coded.select("chunk", "keys", "more", "endings", "codes", "train", "sizes")
    pairs = tree_sum(words.mapInArrow(_unit_pairs(top), SCHEMA), "int64", side**2).reshape(side, side)
    start = coded.select("chunk", "keys", "more", "endings").mapInArrow(_first_classes(top, exchange(pairs)), _CLASSES)
    classes = bucketed(start, "classes")
    both, distinct = _counted(coded, state, classes)
    steps = [likelihood(both)]
    texts = coded.select("chunk", "codes", "train", "sizes")
    for part in [*range(PARTS)] * sweeps:
        seen = _beside(texts, state.drop("first"), classes).mapInArrow(_send_neighbours(part), _ENTRIES)
        told = seen.groupBy("range").applyInArrow(_move(both), _MOVED)
        moved = told.groupBy("chunk").applyInArrow(_gather_moved, "chunk long, moved binary")
        rows = _beside(state.select("chunk", "totals", "numbers"), classes).join(moved.hint("merge"), "chunk", "left")
        new = bucketed(rows.mapInArrow(_apply(part), _CLASSES), "classes")
        counts = _counted(coded, state, new)
        if likelihood(counts[0]) > steps[-1]:
            classes, (both, distinct) = new, counts
            steps.append(likelihood(both))
    return Clusters(coded, state, classes, both, distinct, steps)


def score_texts(docs: DataFrame, train: Column | None = None, units: int = UNITS, chunk_bytes: int = _CHUNK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    ``train`` says which documents are learnt from (by default all whose remainder modulo 10 is not 0). Tokens are
    words with A-Z in lower case and one end. ``base_score`` is the additive unigram model, ``score`` the class bigram
    model, both log10 probabilities; each counts all words not seen in training as one word (of their class). ``units``
    words begin as units of their own; words are told apart by 96 bits of hash.

    A null text is empty: its only token is the end. A null doc_id has the remainder of the empty text and is held
    out; rows that repeat an id are scored each. Without training texts all words are unknown.
    """
    learn = remainder("doc_id", 10) != 0 if train is None else train
    found = cluster_words(docs, F.coalesce(learn, F.lit(False)), units, chunk_bytes)
    texts = found.coded.select("chunk", "ids", "train", "sizes", "codes")
    rows = _beside(texts, found.state.select("chunk", "totals"), found.classes.select("chunk", "classes"))
    return rows.mapInArrow(_score(Model(found.both, found.distinct)), _SCORED)
