"""Substring dedup: word windows that an earlier document has too are removed.

Chunks of documents and ranges of hashes exchange packed arrays instead of a row for every window:

1. Each chunk sends, for every range of the count-min sketch, the counter cells its windows fall into. A range adds up
   what all chunks sent and answers each of them with one bit a cell: is the merged count 2 or more? Counts are of
   (document, window) pairs and never too low, so a window that two documents share is always marked.
2. Each chunk sends the 96-bit hashes of its marked windows, each once with the smallest doc_id that has it in the
   chunk. The range groups them exactly and answers with one bit: does a smaller doc_id have this window?
3. Each chunk removes the words its marked windows cover.

The sketch is as large as the input asks for, but every task holds one range of it; nothing is broadcast. A window
that a third of all documents share costs one entry for each chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenlake.llm.common import NO_ID, chunked, ids_of, saved, texts_of, words_of

WINDOW = 13
#: Counters in one range of the sketch, a byte each while they are merged.
RANGE_BITS = 24
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SENT = "range int, chunk long, cells binary, wide boolean, twice binary"
_KEYS = "range int, chunk long, keys binary, more binary, first binary"
_BITS = "chunk long, range int, bits binary"


class Words:
    """The words of a chunk's texts: the number of each, and the 128-bit hashes of the distinct ones, which repeat a lot."""

    def __init__(self, chunk: pa.Table):
        self.numbers, distinct, self.sizes = words_of(chunk)
        digests = b"".join(map(xxhash.xxh3_128_digest, distinct))
        self.hashes = np.frombuffer(digests, "<u8").reshape(-1, 2).T.copy()

    def runs(self, lane: int, size: int) -> np.ndarray:
        """A hash of each run of ``size`` words, whose hashes are the digits of a number; joined from shorter runs."""
        multiplier, words = int(_MULTIPLIERS[lane]), self.hashes[lane][self.numbers]
        x, length = words, 1
        for bit in f"{size:b}"[1:]:
            x = x[: max(0, len(x) - length)] * np.uint64(pow(multiplier, length, 1 << 64)) + x[length:]
            length *= 2
            if bit == "1":
                x = x[:-1] * _MULTIPLIERS[lane] + words[length:]
                length += 1
        return x


class Windows:
    """All windows of a chunk: their hashes, document and place, and the order of the first hash."""

    def __init__(self, chunk: pa.Table, size: int):
        self.words, self.size = Words(chunk), size
        self.sizes = self.words.sizes
        doc = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.sizes)
        windows = max(0, len(doc) - size + 1)
        self.start = np.flatnonzero(doc[:windows] == doc[size - 1 :]) if windows else np.zeros(0, np.int64)
        self.doc = doc[self.start]
        self.key = self._hash(0)
        self.order = np.argsort(self.key)

    def _hash(self, lane: int) -> np.ndarray:
        x = self.words.runs(lane, self.size)[self.start]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    @cached_property
    def more(self) -> np.ndarray:
        """32 more bits of hash, for the steps that compare windows exactly."""
        return (self._hash(1) >> np.uint64(32)).astype(np.uint32)

    def cells(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted counter cells of the chunk, whether two or more (document, window) pairs fall into each).

        Windows of one hash come in any order: those of two documents may count as more than two, those of one as one.
        """
        key, doc = self.key[self.order], self.doc[self.order]
        new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])][: len(key)]
        cell = key[new] >> np.uint64(64 - bits)
        at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
        return cell[at], np.diff(np.r_[at, len(cell)]) > 1

    def marked(self, bits: int, answers: dict[int, bytes]) -> np.ndarray:
        """Windows whose cell was answered with 2 or more, in the order of their hashes."""
        cells, _ = self.cells(bits)
        yes = np.concatenate([_unpack(answers[r], b - a) for r, a, b in _ranges(cells, bits)]) if len(cells) else np.zeros(0, bool)
        cell = self.key[self.order] >> np.uint64(64 - bits)
        return self.order[yes[np.searchsorted(cells, cell)]] if len(cells) else self.order

    def first_of(self, windows: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each distinct window, number of its window for every row): distinct ones begin with the smallest id."""
        key, more, doc_id = self.key[windows], self.more[windows], ids[self.doc[windows]]
        rows = np.lexsort((doc_id, more, key))
        key, more = key[rows], more[rows]
        new = np.r_[True, (key[1:] != key[:-1]) | (more[1:] != more[:-1])][: len(key)]
        number = np.empty(len(rows), np.int64)
        number[rows] = np.cumsum(new) - 1
        return windows[rows[new]], number


def _unpack(bits: bytes, count: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=count).astype(bool)


def _ranges(cells: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, first, end) of sorted cells."""
    of = (cells >> np.uint64(min(bits, RANGE_BITS))).astype(np.int64)
    at = np.flatnonzero(np.r_[True, of[1:] != of[:-1]][: len(of)]).tolist()
    return [(int(of[a]), a, b) for a, b in zip(at, [*at[1:], len(of)])]


def _answers(table: pa.Table, kind: int) -> dict[int, bytes]:
    return {r: b for r, b, k in zip(*(table.column(c).to_pylist() for c in ("range", "bits", "kind"))) if k == kind}


def _table(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [field.split() for field in schema.split(", ")]
    return pa.table({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(fields, columns)})


def _send_cells(size: int, bits: int) -> Callable[[pa.Table], pa.Table]:
    low = np.uint64((1 << min(bits, RANGE_BITS)) - 1)

    def send(chunk: pa.Table) -> pa.Table:
        number = chunk.column("chunk")[0].as_py()
        cells, twice = Windows(chunk, size).cells(bits)
        rows = []
        for r, a, b in _ranges(cells, bits):
            gaps = np.diff((cells[a:b] & low).astype(np.int64), prepend=0)
            wide = bool(gaps.max() > 0xFFFF)
            rows.append((r, number, gaps.astype(np.uint32 if wide else np.uint16).tobytes(), wide, np.packbits(twice[a:b]).tobytes()))
        return _table(_SENT, list(zip(*rows)) or [[]] * 5)

    return send


def _merge_cells(bits: int) -> Callable[[pa.Table], pa.Table]:
    def merge(sent: pa.Table) -> pa.Table:
        counts = np.zeros(1 << min(bits, RANGE_BITS), np.uint8)
        places = []
        for cells, wide, twice in zip(*(sent.column(c).to_pylist() for c in ("cells", "wide", "twice"))):
            at = np.cumsum(np.frombuffer(cells, np.uint32 if wide else np.uint16).astype(np.int64))
            counts[at] = np.minimum(2, counts[at] + 1 + _unpack(twice, len(at)))
            places.append((cells, wide))
        answers = []
        for cells, wide in places:
            at = np.cumsum(np.frombuffer(cells, np.uint32 if wide else np.uint16).astype(np.int64))
            answers.append(np.packbits(counts[at] > 1).tobytes())
        return _table(_BITS, [sent.column("chunk").to_pylist(), sent.column("range").to_pylist(), answers])

    return merge


def _send_keys(size: int, bits: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def send(chunk: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        if chunk.num_rows:
            number = chunk.column("chunk")[0].as_py()
            ids, windows = ids_of(chunk), Windows(chunk, size)
            firsts, _ = windows.first_of(windows.marked(bits, _answers(answers, 1)), ids)
            cells = windows.key[firsts] >> np.uint64(64 - bits)
            for r, a, b in _ranges(cells, bits):
                w = firsts[a:b]
                rows.append((r, number, windows.key[w].tobytes(), windows.more[w].tobytes(), ids[windows.doc[w]].tobytes()))
        return _table(_KEYS, list(zip(*rows)) or [[]] * 5)

    return send


def _merge_keys(sent: pa.Table) -> pa.Table:
    kinds = {"keys": np.uint64, "more": np.uint32, "first": np.int64}
    parts = {c: [np.frombuffer(x, kind) for x in sent.column(c).to_pylist()] for c, kind in kinds.items()}
    key, more, first = (np.concatenate(parts[c]) for c in kinds)
    order = np.lexsort((more, key))
    key, more, first = key[order], more[order], first[order]
    at = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (more[1:] != more[:-1])])
    least = np.minimum.reduceat(first, at)
    later = np.empty(len(order), bool)
    later[order] = first > np.repeat(least, np.diff(np.r_[at, len(first)]))
    ends = np.cumsum([len(x) for x in parts["keys"]])
    answers = [np.packbits(x).tobytes() for x in np.split(later, ends[:-1])]
    return _table(_BITS, [sent.column("chunk").to_pylist(), sent.column("range").to_pylist(), answers])


def _without(text: bytes, gone: np.ndarray) -> bytes:
    """The text without its marked words; white space stays where it stood before a word that is kept."""
    pieces, end = [], 0
    for match, out in zip(_WORD.finditer(text), gone.tolist()):
        if not out:
            pieces.append(text[end : match.end()] if pieces or end == 0 else text[match.start() : match.end()])
        end = match.end()
    return b"".join(pieces)


class _Remove:
    """Result rows of a chunk, and with ``whole`` the kept text and the other columns of its documents."""

    def __init__(self, size: int, bits: int, whole: bool):
        self.size, self.bits, self.whole = size, bits, whole

    def __call__(self, chunk: pa.Table, answers: pa.Table) -> pa.Table:
        if not chunk.num_rows:
            return _table(_RESULT, [[]] * 4)
        ids, texts = ids_of(chunk), texts_of(chunk)
        windows = Windows(chunk, self.size)
        starts = self._starts(windows, ids, answers)
        total = int(windows.sizes.sum())
        change = np.bincount(starts, minlength=total + self.size + 1) - np.bincount(starts + self.size, minlength=total + self.size + 1)
        gone = np.cumsum(change)[:total] > 0
        ends = np.cumsum(windows.sizes)
        removed, digests, kept = [], [], chunk.column("text").to_pylist() if self.whole else []
        for row, (text, a, b) in enumerate(zip(texts, (ends - windows.sizes).tolist(), ends.tolist())):
            mine, words = gone[a:b], text.split()
            count = int(mine.sum())
            removed.append(count)
            if count:
                words = [w for w, out in zip(words, mine.tolist()) if not out]
                if self.whole:
                    kept[row] = _without(text, mine).decode()
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        result = _table(_RESULT, [[None if i == NO_ID else i for i in ids.tolist()], windows.sizes.tolist(), removed, digests])
        if self.whole:
            result = result.append_column("text", pa.array(kept, pa.string())).append_column("rest", chunk.column("rest"))
        return result

    def _starts(self, windows: Windows, ids: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Places of the windows that an earlier document has too."""
        marked = windows.marked(self.bits, _answers(answers, 1))
        firsts, number = windows.first_of(marked, ids)
        said, later = _answers(answers, 2), np.zeros(len(firsts), bool)
        for r, a, b in _ranges(windows.key[firsts] >> np.uint64(64 - self.bits), self.bits):
            later[a:b] = _unpack(said[r], b - a)
        smallest = ids[windows.doc[firsts]][number]
        return windows.start[marked[later[number] | (ids[windows.doc[marked]] > smallest)]]


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _found(docs: DataFrame, size: int, chunk_bytes: int, whole: bool) -> DataFrame:
    columns = ["doc_id", "text", *(["rest"] if whole else [])]
    chunks = chunked(docs, columns, chunk_bytes=chunk_bytes)
    bits = max(16, int(chunks.agg(F.sum("octets")).first()[0] or 0).bit_length())
    slim = chunks.select("chunk", "doc_id", "text")
    sent = slim.groupBy("chunk").applyInArrow(_send_cells(size, bits), _SENT)
    first = saved(sent.groupBy("range").applyInArrow(_merge_cells(bits), _BITS), "repeated").withColumn("kind", F.lit(1))
    keys = slim.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(_send_keys(size, bits), _KEYS)
    second = keys.groupBy("range").applyInArrow(_merge_keys, _BITS).withColumn("kind", F.lit(2))
    result = T.StructType.fromDDL(_RESULT)
    if whole:
        result = result.add(chunks.schema["text"]).add(chunks.schema["rest"])
    rows = chunks.select("chunk", *columns).groupBy("chunk")
    remove = _Remove(size, bits, whole)
    return rows.cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(lambda c, a: remove(c, a), result)


def remove_repeats(docs: DataFrame, size: int = WINDOW, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Every document with its number of words, of removed words, and the digest of the kept words.

    A word goes if a window of ``size`` words that covers it also starts in a document with a smaller doc_id. Windows
    are judged on the input.

    A null text has no words, and neither null nor empty or short texts lose any. A document without a doc_id counts
    as later than all others, and two such documents don't remove anything from each other; nor do rows that repeat a
    doc_id. Windows are compared by 96 bits of hash.
    """
    return _found(docs, size, chunk_bytes, False)


def without_repeats(docs: DataFrame, size: int = WINDOW, chunk_bytes: int = 8 << 20) -> DataFrame:
    """The documents with all their columns, their repeated words removed from ``text``.

    A text that loses nothing stays as it is, byte for byte; one that loses every word leaves the table. ``n_chars``
    follows the new text where there is such a column. Rows are judged as in ``remove_repeats``.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(0).alias("none"))
    found = _found(docs.select("doc_id", "text", rest.alias("rest")), size, chunk_bytes, True)
    left = found.where("n_removed = 0 or n_removed < n_words")
    columns = {c: F.col("rest")[c] for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        changed = F.length("text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("n_removed") > 0, changed).otherwise(columns["n_chars"])
    return left.select(*[columns[c].alias(c) for c in docs.columns])
