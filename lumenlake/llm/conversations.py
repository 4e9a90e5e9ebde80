"""A prefix trie of conversations: padded turn-id matrices in range shards, and boundary nodes put together again.

Conversations are rows of turn ids, range-partitioned by them, so a node of the trie is a run of consecutive rows. In a
shard numpy sorts the padded matrix of ids, marks where a column differs from the row above, and accumulates these
marks by OR along the row: a mark in column d starts a node of depth d. Sums over the runs of each depth give every
node of the shard. A shard knows the last row before it and the first row after it, so the marks are right across
shards, every figure of a node is a sum over its rows, and nodes that reach over shards are added up by a shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import saved, word_count

#: A conversation begins with the first turns of the one whose id is the next lower multiple of ``BLOCK``.
BLOCK, MOST_SHARED = 20, 3
#: Conversations and bytes of turn ids of a shard, about; columns of a padded matrix.
SHARD_ROWS, SHARD_BYTES, COLUMNS = 100_000, 32 << 20, 32
_ID = 16
#: Ids of a run that reaches over shards travel in pieces of so many.
_PIECE = 1000
NO_ENDS = hashlib.sha256(b"").hexdigest()
_SHARD_NODES = (
    "shard int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long,"
    " saved_tokens long, ends_sha256 string, print binary, parent_print binary, ends array<string>"
)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ids (16 bytes a turn) and words (of each turn) of every rebuilt conversation.

    A turn's id is the MD5 of role and text, null ones empty. Turns are ordered by ``turn``, null first, equal ones by
    their ids. Rows without a conv_id belong to no conversation. Only ids and word counts are shuffled, not texts; the
    conversations of a block of twenty ids meet in one task, so a conversation is never copied to more than these.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    key = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    conv = F.col("conv_id").cast("long")
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        (conv - conv % BLOCK).alias("base"),
        conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(key.cast("binary")).alias("id"),
        word_count("text").cast("int").alias("words"),
    )
    own = F.sort_array(F.collect_list(F.struct("turn", "id", "words")))
    each = turns.repartition("base").groupBy("base", "conv_id").agg(own.alias("own"))
    heads = each.where("conv_id = base").select("base", F.slice("own", 1, MOST_SHARED).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    joined = each.join(heads, "base", "left").withColumn("h", h)
    none = F.slice("own", 1, 0)
    shared = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return joined.withColumn("turns", F.concat(shared, rest)).select(
        "conv_id", F.unhex(F.array_join(F.col("turns.id"), "")).alias("ids"), F.col("turns.words").alias("words")
    )


def _common(a: bytes, b: bytes) -> int:
    """Turns that two rows of ids begin with alike."""
    n = min(len(a), len(b)) // _ID
    differs = (np.frombuffer(a, "V16", n) != np.frombuffer(b, "V16", n)).nonzero()[0]
    return int(differs[0]) if len(differs) else n


def _codes(ids: bytes) -> np.ndarray:
    """Ids as numbers of the same order."""
    halves = np.frombuffer(ids, ">u8").reshape(-1, 2)
    high, low = halves[:, 0].astype(np.uint64), halves[:, 1].astype(np.uint64)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order[1:]] != high[order[:-1]]) | (low[order[1:]] != low[order[:-1]])
    codes = np.empty(len(order), np.int64)
    codes[order] = np.cumsum(new)
    return codes


class _Matrix:
    """Rows of a shard in order, as blocks of padded columns; later blocks hold only the rows that reach them.

    A block is (places of its rows in the order, marks, words): a mark says that the row starts a node of that depth.
    """

    def __init__(self, convs: np.ndarray, ids: list[bytes], words: np.ndarray):
        self.sizes = np.array([len(x) // _ID for x in ids], np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.codes, self.words = _codes(b"".join(ids)), words
        self.order = np.arange(len(ids))
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._sort(convs)
        self.length = self.sizes[self.order]

    def _padded(self, values: np.ndarray, rows: np.ndarray, a: int, pad: int) -> np.ndarray:
        columns = np.arange(a, a + COLUMNS)
        inside = columns < self.sizes[rows][:, None]
        if not len(values):
            return np.full(inside.shape, pad, np.int64)
        return np.where(inside, values[np.where(inside, self.first[rows][:, None] + columns, 0)], pad)

    def _sort(self, convs: np.ndarray) -> None:
        places, started = np.arange(len(self.order)), np.zeros(len(self.order), bool)
        started[:1] = True
        for a in range(0, max(1, int(self.sizes.max(initial=0))), COLUMNS):
            rows = self.order[places]
            matrix = self._padded(self.codes, rows, a, 0)
            goes_on = self.sizes[rows] > a + COLUMNS  # rows that end here come before those that go on
            by = np.lexsort((convs[rows], goes_on, *matrix.T[::-1], np.cumsum(started)))
            self.order[places] = rows = rows[by]
            matrix = matrix[by]
            marks = np.ones(matrix.shape, bool)
            marks[1:] = matrix[1:] != matrix[:-1]
            marks[:, 0] |= started
            marks = np.logical_or.accumulate(marks, axis=1)
            self.blocks.append((places, marks, self._padded(self.words, rows, a, 0)))
            longer = np.flatnonzero(self.sizes[rows] > a + COLUMNS)
            # a row starts a run of the next block if it differs already, or the row above it has ended
            started = marks[longer, -1] | (np.diff(longer, prepend=-2) != 1)
            places = places[longer]

    def continue_row_above(self, shared: int) -> None:
        """The first row shares so many turns with the last row of an earlier shard: no node of these starts here."""
        for k, (places, marks, _) in enumerate(self.blocks):
            if len(places) and places[0] == 0:
                marks[0] = np.arange(k * COLUMNS, (k + 1) * COLUMNS) >= shared

    def like_above(self) -> np.ndarray:
        """Turns that each row shares with the one above."""
        same = np.zeros(len(self.order), np.int64)
        for k, (places, marks, _) in enumerate(self.blocks):
            inside = np.arange(k * COLUMNS, (k + 1) * COLUMNS) < self.length[places][:, None]
            same[places] += (~marks & inside).sum(axis=1)
        return same

    def repeated_words(self) -> list[np.ndarray]:
        """For each block: words of the turns from a column on that do not start a node, by row."""
        carried = np.zeros(len(self.order), np.int64)
        out = []
        for places, marks, words in reversed(self.blocks):
            sums = np.cumsum(np.where(marks, 0, words)[:, ::-1], axis=1)[:, ::-1] + carried[places][:, None]
            carried[places] = sums[:, 0]
            out.append(sums)
        return out[::-1]


def _prints(ids: bytes, depth: int) -> list[bytes]:
    """A print of the first 0, 1, ... ``depth`` turns."""
    hashed = xxhash.xxh3_128(seed=1)
    out = [hashed.digest()]
    for d in range(depth):
        hashed.update(ids[d * _ID : (d + 1) * _ID])
        out.append(hashed.digest())
    return out


def _shard_nodes(rows: pa.Table, ends: pa.Table) -> pa.Table:
    """All nodes of a shard. Nodes that reach over its ends carry a print and what is to be added up."""
    convs = rows.column("conv_id").to_numpy()
    ids = rows.column("ids").to_pylist()
    words = rows.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    matrix = _Matrix(convs, ids, words)
    order, length = matrix.order, matrix.length
    end = ends.to_pylist()[0]
    top, bottom = ids[order[0]], ids[order[-1]]
    above = -1 if end["before"] is None else _common(top, end["before"])
    below = -1 if end["after"] is None else _common(bottom, end["after"])
    if above >= 0:
        matrix.continue_row_above(above)
    alike = matrix.like_above()
    # the last row of a childless node: the next row neither repeats nor continues it
    final = np.append(alike[1:] < length[:-1], below < int(length[-1]))
    repeated = matrix.repeated_words()
    prints_above, prints_below = _prints(top, above), _prints(bottom, below)
    conv = convs[order]
    reach = np.arange(len(order))
    marks0 = np.zeros(len(order), bool)
    marks0[0] = above < 0
    columns: list[list] = [[] for _ in range(11)]
    parent_first, parent_conv = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for depth in range(int(length.max(initial=0)) + 1):
        if depth == 0:
            places, marks, value = reach, marks0, repeated[0][:, 0]
        else:
            block, column = divmod(depth - 1, COLUMNS)
            here, all_marks, _ = matrix.blocks[block]
            inside = np.flatnonzero(length[here] >= depth)
            places, marks, value = here[inside], all_marks[inside, column], repeated[block][inside, column]
        child = np.zeros(len(order), np.int64)
        block, column = divmod(depth, COLUMNS)
        if block < len(matrix.blocks):
            here, all_marks, _ = matrix.blocks[block]
            child[here] = all_marks[:, column] & (length[here] > depth)
        starts = np.flatnonzero(marks)
        if not len(starts) or starts[0]:
            starts = np.concatenate([[0], starts])
        ending = (length[places] == depth).astype(np.int64)
        n_ends = np.add.reduceat(ending, starts).tolist()
        n = np.diff(np.append(starts, len(places)))
        least = np.minimum.reduceat(conv[places], starts)
        node_print: list[bytes | None] = [None] * len(starts)
        if below >= depth:
            node_print[-1] = prints_below[depth]
        if above >= depth:
            node_print[0] = prints_above[depth]
        hashes: list[str | None] = [NO_ENDS] * len(starts)
        pieces: list[list[str] | None] = [None] * len(starts)
        for k in np.flatnonzero(n_ends).tolist():
            run = conv[places[starts[k] : starts[k] + n_ends[k]]].tolist()
            if node_print[k] is None:
                hashes[k] = hashlib.sha256(",".join(map(str, run)).encode()).hexdigest()
            else:
                pieces[k] = [",".join(map(str, run[a : a + _PIECE])) for a in range(0, len(run), _PIECE)]
        parents: list[int | None] = [None] * len(starts)
        parent_print: list[bytes | None] = [None] * len(starts)
        if depth:
            at = np.searchsorted(parent_first, places[starts], "right") - 1
            parents = parent_conv[at].tolist()
            held = {0: prints_above[depth - 1]} if above >= depth - 1 else {}
            held |= {len(parent_first) - 1: prints_below[depth - 1]} if below >= depth - 1 else {}
            if held:
                parent_print = [held.get(k) for k in at.tolist()]
        parent_first, parent_conv = places[starts], least
        found = (
            [depth] * len(starts), least.tolist(), parents, n.tolist(), np.add.reduceat(child[places], starts).tolist(),
            np.add.reduceat(final[places].astype(np.int64), starts).tolist(), np.add.reduceat(value, starts).tolist(),
            hashes, node_print, parent_print, pieces,
        )
        for column_values, values in zip(columns, found):
            column_values.extend(values)
    kinds = [*[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.list_(pa.string())]
    names = [f.strip().split()[0] for f in _SHARD_NODES.split(",")]
    shard = pa.array([end["shard"]] * len(columns[0]), pa.int32())
    return pa.table([shard, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each print, which come in order; only the hash's state is held."""
    held, hashed = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held], pa.binary()), pa.array([hashed.hexdigest()])], ["print", "sha"])

    for batch in batches:
        for key, piece in zip(batch.column("print").to_pylist(), batch.column("piece").to_pylist()):
            if key != held:
                if held is not None:
                    yield row()
                held, hashed = key, hashlib.sha256(piece.encode())
            else:
                hashed.update(f",{piece}".encode())
    if held is not None:
        yield row()


def trie(conversations: DataFrame, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each node of the prefix trie of all rebuilt conversations; see ``rebuilt``.

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.
    Null roles and texts are empty; rows without a conv_id are left out; repeated rows are turns of their own; other
    columns are not looked at. A table without conversations has no nodes, not even a root.

    Shards are cut by (turns, conv_id), so copies of one conversation, however many, spread over shards. A task holds
    one shard; one conversation is never cut (20 bytes a turn). Deep rows stand in blocks of ``COLUMNS`` columns of
    their own, so a long conversation does not widen the matrix of the others. Every shard gives at most two partial
    nodes a depth, which are added up by print. The SHA-256 of ends in several shards reads their ids in one pass, in
    order, as that hash can't be cut; only its state is held.
    """
    rows = saved(rebuilt(conversations), "conversations")
    size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids"))).first()
    shards = max(1, math.ceil(size[0] / shard_rows), math.ceil((size[1] or 0) / shard_bytes))
    cut = saved(rows.repartitionByRange(shards, "ids", "conv_id").withColumn("shard", F.spark_partition_id()), "shards")
    # one row for each shard, with the rows of ids next to it
    by_shard = Window.orderBy("shard")
    ends = cut.groupBy("shard").agg(F.min("ids").alias("low"), F.max("ids").alias("high"))
    ends = ends.select("shard", F.lag("high").over(by_shard).alias("before"), F.lead("low").over(by_shard).alias("after"))
    found = cut.groupBy("shard").cogroup(ends.groupBy("shard")).applyInArrow(lambda a, b: _shard_nodes(a, b), _SHARD_NODES)
    nodes = saved(found, "nodes")
    parts = nodes.where(F.col("print").isNotNull())
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    over = saved(
        parts.groupBy("depth", "print").agg(F.min("conv_id").alias("conv_id"), *sums, F.min("parent_print").alias("parent_print")), "over"
    )
    pieces = parts.select("print", "shard", F.posexplode("ends").alias("place", "piece"))
    ordered = pieces.repartition("print").sortWithinPartitions("print", "shard", "place").select("print", "piece")
    hashes = ordered.mapInArrow(_hash_ends, "print binary, sha string")
    names = over.select(F.col("print").alias("parent_print"), F.col("conv_id").alias("parent_conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    whole_over = (
        over.join(hashes, "print", "left")
        .withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS)))
        .join(names, "parent_print", "left")
    )
    # a shard's nodes below one that reaches over it: the name comes by shard, so the root is no hot key
    near = parts.select("shard", F.col("print").alias("parent_print")).distinct().join(names, "parent_print")
    near = near.withColumnRenamed("parent_conv_id", "named")
    inside = nodes.where(F.col("print").isNull()).join(near, ["shard", "parent_print"], "left")
    inside = inside.withColumn("parent_conv_id", F.when(F.col("parent_print").isNull(), F.col("parent_conv_id")).otherwise(F.col("named")))
    return inside.select(columns).unionByName(whole_over.select(columns))
