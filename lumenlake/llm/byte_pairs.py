"""Byte-level BPE of a given vocabulary: encoding with a queue of merge ranks, and decoding.

Tokens of a piece are a linked list. A bucket for each merge rank holds the places of the list whose pair has it, and
a hierarchy of 64-bit bitmaps over the ranks finds the least one with a place by its first set bits. A merge changes
the pairs beside it; their old entries stay where they are and are skipped when they come up. So a piece of n bytes
takes n steps of the cost of a bucket's heap, however long it is, and many short pieces share one list and one queue.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import texts_of
from lumenlake.plans.parallel import spread

#: Pieces remembered by a worker, and the longest one that is: neither changes a result.
_MEMO, _MEMO_CHARS = 400_000, 64
#: Characters worked on at once, and pieces of one text taken at once.
_RUN_CHARS, _RUN_PIECES = 1 << 20, 1 << 17
_SHIFT = 32
_WORD, _BITS = 6, 63
ENCODED = "doc_id long, n_tokens long, ids binary"


class RankQueue:
    """Places by merge rank; the least rank that has any is found by the first set bit of each level of bitmaps."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.levels: list[list[int]] = []
        size = max(1, ranks)
        while not self.levels or size > 1:
            size = (size + _BITS) >> _WORD
            self.levels.append([0] * size)

    def fill(self, rank: int, places: list[int]) -> None:
        """Give an empty bucket its places, in ascending order."""
        self.buckets[rank] = places
        for level in self.levels:
            word = rank >> _WORD
            before = level[word]
            level[word] = before | 1 << (rank & _BITS)
            if before:
                break
            rank = word

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.fill(rank, [place])
        else:
            heappush(bucket, place)

    def least(self) -> int:
        """The least rank with a bucket, -1 if there is none."""
        if not self.levels[-1][0]:
            return -1
        word = 0
        for level in reversed(self.levels):
            bits = level[word]
            word = word << _WORD | (bits & -bits).bit_length() - 1
        return word

    def close(self, rank: int) -> None:
        """Take an emptied bucket away."""
        del self.buckets[rank]
        for level in self.levels:
            word = rank >> _WORD
            level[word] &= ~(1 << (rank & _BITS))
            if level[word]:
                break
            rank = word


class Vocabulary:
    """Merge ranks, which are the ids, from the lines of a rank file: a token in base 64, a space, its rank."""

    def __init__(self, lines: bytes):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines.splitlines() if x.strip())}
        singles = [self.ranks.get(bytes([k]), -1) for k in range(256)]
        if min(singles) < 0:
            raise ValueError("the vocabulary lacks single bytes")
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.top = max(self.tokens) + 1
        self.single = np.array(singles, np.int32)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << _SHIFT | right] = rank
        self.first = np.full((256, 256), -1, np.int32)
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.first[token[0], token[1]] = rank
        self.memo: dict[str, bytes] = {}

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece (not empty), as packed little-endian 32-bit integers."""
        out = [b""] * len(pieces)
        split = []
        for k, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is None:
                split.append(k)
            else:
                out[k] = rank.to_bytes(4, "little")
        if split:
            for k, ids in zip(split, self._merge([pieces[k] for k in split])):
                out[k] = ids
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        joined = np.frombuffer(b"".join(pieces), np.uint8)
        size = len(joined)
        ends = np.cumsum([len(p) for p in pieces])
        starts = np.concatenate([[0], ends[:-1]])
        follow = np.arange(1, size + 1)
        follow[ends - 1] = size
        lead = np.arange(-1, size - 1)
        lead[starts] = -1
        rank_at = np.full(size, -1, np.int32)
        rank_at[:-1] = self.first[joined[:-1], joined[1:]]
        rank_at[ends - 1] = -1
        queue = RankQueue(self.top)
        places = np.flatnonzero(rank_at >= 0)
        places = places[np.argsort(rank_at[places], kind="stable")]
        for run in np.split(places, np.flatnonzero(np.diff(rank_at[places])) + 1):
            if len(run):
                queue.fill(int(rank_at[run[0]]), run.tolist())
        tokens = array("i", self.single[joined].tobytes())
        self._drain(queue, tokens, array("q", follow.tobytes()), array("q", lead.tobytes()), array("i", rank_at.tobytes()))
        ids = np.frombuffer(tokens, np.int32)
        alive = ids >= 0
        packed = ids[alive].astype("<u4").tobytes()
        stops = (np.cumsum(alive)[ends - 1] * 4).tolist()
        return [packed[a:b] for a, b in zip([0, *stops[:-1]], stops)]

    def _drain(self, queue: RankQueue, tokens: array, follow: array, lead: array, rank_at: array) -> None:
        """Merge until no pair has a rank; ``rank_at`` is the rank of the pair that starts at a place now."""
        pairs, size = self.pairs.get, len(tokens)
        while (rank := queue.least()) >= 0:
            bucket = queue.buckets[rank]
            while bucket:
                at = heappop(bucket)
                if rank_at[at] != rank:
                    continue
                gone = follow[at]
                after = follow[gone]
                tokens[at], tokens[gone], rank_at[gone], follow[at] = rank, -1, -1, after
                lowest = rank
                new = -1
                if after < size:
                    lead[after] = at
                    new = pairs(rank << _SHIFT | tokens[after], -1)
                    if new >= 0:
                        queue.push(new, at)
                        lowest = min(lowest, new)
                rank_at[at] = new
                before = lead[at]
                if before >= 0:
                    rank_at[before] = new = pairs(tokens[before] << _SHIFT | rank, -1)
                    if new >= 0:
                        queue.push(new, before)
                        lowest = min(lowest, new)
                if lowest < rank:
                    break
            else:
                queue.close(rank)

    def encode_run(self, runs: list[list[str]]) -> list[bytes]:
        """Packed ids of each list of pieces; pieces that are new to the worker are merged together."""
        memo = self.memo
        if len(memo) > _MEMO:
            memo.clear()
        new = list({p for pieces in runs for p in pieces if p not in memo})
        memo.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        out = [b"".join(map(memo.__getitem__, pieces)) for pieces in runs]
        for piece in new:
            if len(piece) > _MEMO_CHARS:
                del memo[piece]
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of packed ids."""
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_LOADED: dict[bytes, Vocabulary] = {}


def vocabulary(lines: bytes) -> Vocabulary:
    """The vocabulary of a rank file's lines, built once for each worker."""
    if lines not in _LOADED:
        _LOADED.clear()
        _LOADED[lines] = Vocabulary(lines)
    return _LOADED[lines]


def _pieces(text: str, pattern: regex.Pattern) -> Iterator[list[str]]:
    """The matches of a text, in lists of bounded length if it is long; at least one list."""
    if len(text) <= _RUN_CHARS:
        yield pattern.findall(text)
        return
    matches = (m.group() for m in pattern.finditer(text))
    while run := list(islice(matches, _RUN_PIECES)):
        yield run


def _runs(texts: Iterable[bytes], pattern: regex.Pattern) -> Iterator[list[tuple[int, list[str], bool]]]:
    """Runs of (row, pieces, whether the row ends here) of about ``_RUN_CHARS`` characters."""
    run, chars = [], 0
    for row, raw in enumerate(texts):
        held: list[str] | None = None
        for pieces in _pieces(raw.decode("utf-8", "replace"), pattern):
            if held is not None:
                run.append((row, held, False))
                yield run
                run, chars = [], 0
            held = pieces
        run.append((row, held or [], True))
        chars += min(len(raw), _RUN_CHARS)
        if chars >= _RUN_CHARS:
            yield run
            run, chars = [], 0
    if run:
        yield run


class _Encode:
    """Encode the texts of a task; the ids are decoded beside them if asked for."""

    def __init__(self, lines: bytes, pattern: str, decoded: bool):
        self.lines, self.pattern, self.decoded = lines, pattern, decoded

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pattern = vocabulary(self.lines), regex.compile(self.pattern)
        for batch in batches:
            ids = batch.column("doc_id")
            parts: list[bytes] = []
            for run in _runs(texts_of(batch), pattern):
                rows, done = [], []
                for (row, _, ends), packed in zip(run, known.encode_run([pieces for _, pieces, _ in run])):
                    parts.append(packed)
                    if ends:
                        rows.append(row)
                        done.append(parts[0] if len(parts) == 1 else b"".join(parts))
                        parts = []
                columns = [ids.take(pa.array(rows, pa.int64())), pa.array([len(d) // 4 for d in done], pa.int64()), pa.array(done, pa.binary())]
                names = ["doc_id", "n_tokens", "ids"]
                if self.decoded:
                    columns.append(pa.array(list(map(known.decode, done)), pa.binary()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names)


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode(docs: DataFrame, path: str, pattern: str, decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens and ids (packed little-endian unsigned 32-bit integers) of every whole text.

    ``path`` is a rank file, read by the driver and sent to the tasks (half a megabyte for 50,000 tokens). Every match
    of ``pattern`` is encoded by itself: a match that is a token is that token; otherwise its bytes are merged, the
    least rank first and the leftmost of equal ones. Special tokens are ordinary text. With ``decoded`` the bytes of
    the ids are a fourth column. Null and empty texts have no ids; a null doc_id stays null; rows that repeat an id are
    encoded each; other columns are not looked at. A text of any length is encoded in runs of pieces, a piece of any
    length by the queue.
    """
    slim = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return slim.mapInArrow(_Encode(_read(path), pattern, decoded), ENCODED + (", decoded binary" if decoded else ""))


class _Decode:
    def __init__(self, lines: bytes):
        self.lines = lines

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(self.lines)
        for batch in batches:
            texts = [None if ids is None else known.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "decoded"])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of packed ids; null ids give null, an id outside the vocabulary is an error."""
    return encoded.select("doc_id", "ids").mapInArrow(_Decode(_read(path)), "doc_id long, decoded binary")
