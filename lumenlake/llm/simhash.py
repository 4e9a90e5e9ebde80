"""SimHash fingerprints of word shingles with groups by pigeonhole blocks, and near duplicates by exact shingle similarity."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import numbered, parts, saved, texts_of
from lumenlake.llm.components import components
from lumenlake.plans.parallel import spread
from lumenlake.plans.skew import by_key, join_lookup

SEED = 42
#: Distinct fingerprints of one block that are compared in one task; larger blocks are cut into pairs of slices.
SLICE = 4096
_STEPS = np.arange(1, 256, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int) -> list[bytes]:
    """Runs of ``size`` words with A-Z in lower case; of a shorter text its whole word sequence, of no words nothing."""
    words = text.lower().split()
    if not words:
        return []
    if len(words) < size:
        return [b" ".join(words)]
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def _mixed(h: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` hashes from each one; the first is the hash itself."""
    out = np.empty((len(h), lanes), np.uint64)
    out[:, 0] = h
    for k in range(1, lanes):
        x = h + _STEPS[k - 1]
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprint(text: bytes, size: int, lanes: int = 1) -> np.ndarray:
    """Majority bits over all shingles, as ``lanes`` unsigned 64-bit words; zero without words."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)), np.uint64)
    counts = np.zeros(64 * lanes, np.int64)
    for at in range(0, len(hashes), 255):  # sums of up to 255 bits fit a byte
        rows = _mixed(hashes[at : at + 255], lanes).astype(">u8")
        bits = np.unpackbits(rows.view(np.uint8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes)).view(">u8").astype(np.uint64)


def block_keys(bits: np.ndarray, blocks: int, equal: int) -> np.ndarray:
    """Keys of fingerprints (rows of 0/1): one for each choice of ``equal`` out of ``blocks`` blocks.

    Two fingerprints with at most ``blocks - equal`` differing bits agree in at least one key, because the bits that
    differ touch at most that many blocks. The number of the choice is part of the key.
    """
    edges = np.linspace(0, bits.shape[1], blocks + 1).round().astype(int)
    parts = [bits[:, a:b] for a, b in zip(edges, edges[1:])]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), equal)):
        joined = np.concatenate([parts[c] for c in chosen], axis=1)
        weights = np.left_shift(np.uint64(1), np.arange(joined.shape[1], dtype=np.uint64))
        keys.append(joined.astype(np.uint64) @ weights + (np.uint64(number) << np.uint64(52)))
    return np.stack(keys, axis=1).view(np.int64)


class _Fingerprints:
    def __init__(self, size: int, lanes: int):
        self.size, self.lanes = size, lanes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            prints = [fingerprint(t, self.size, self.lanes).astype(">u8").tobytes() for t in texts_of(batch)]
            nodes = [int.from_bytes(p, "big") if self.lanes == 1 else xxhash.xxh64_intdigest(p) for p in prints]
            columns = [batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(np.array(nodes, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "print", "node"])


class _Keys:
    """(node, kept words of the fingerprint, keys) of distinct fingerprints."""

    def __init__(self, blocks: int, equal: int, kept: int):
        self.blocks, self.equal, self.kept = blocks, equal, kept

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column("print").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys = block_keys(np.unpackbits(raw, axis=1), self.blocks, self.equal)
            kept = [x.tobytes() for x in raw[:, : 8 * self.kept]]
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * keys.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(kept, pa.binary()), lists], ["node", "kept", "keys"])


def fingerprints(docs: DataFrame, size: int = 3, lanes: int = 1) -> DataFrame:
    """(doc_id, print, node): the fingerprint of every whole text as big-endian bytes, and its number as a node.

    A null text has no words. The node is the fingerprint itself where it has 64 bits, else a hash of it.
    """
    slim = spread(docs.select("doc_id", "text"))
    return slim.mapInArrow(_Fingerprints(size, lanes), "doc_id long, print binary, node long")


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _spanning(prints: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links of a forest that joins the same rows as all pairs within the distance, by breadth-first search."""
    links, left = [], np.arange(len(prints))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _distance(prints[left], prints[at]) <= most
            found = left[near].tolist()
            links += [(at, other) for other in found]
            frontier += found
            left = left[~near]
    return links


class _Links:
    """Links within each run of rows with the same (key, part); runs are sorted, and bounded in length."""

    SHORT = 6

    def __init__(self, most: int):
        self.most = most

    def _of(self, key: np.ndarray, node: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[starts, len(key)])
        small = np.repeat(sizes <= self.SHORT, sizes)
        run = np.repeat(np.arange(len(starts)), sizes)
        a, b = [], []
        for step in range(1, self.SHORT):
            if len(run) <= step:
                break
            i = np.flatnonzero((run[step:] == run[:-step]) & small[step:])
            i = i[_distance(prints[i], prints[i + step]) <= self.most]
            a.append(node[i])
            b.append(node[i + step])
        for at, count in zip(starts[sizes > self.SHORT].tolist(), sizes[sizes > self.SHORT].tolist()):
            pairs = np.array(_spanning(prints[at : at + count], self.most), np.int64).reshape(-1, 2) + at
            a.append(node[pairs[:, 0]])
            b.append(node[pairs[:, 1]])
        columns = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy() for c in ("key", "part")], axis=1)
            node = batch.column("node").to_numpy()
            prints = np.frombuffer(b"".join(batch.column("kept").to_pylist()), np.uint64).reshape(len(node), -1)
            if held is not None:
                key, node, prints = (np.concatenate(x) for x in zip(held, (key, node, prints)))
            last = np.flatnonzero((key != key[-1]).any(axis=1))
            cut = int(last[-1]) + 1 if len(last) else 0
            held = key[cut:], node[cut:], prints[cut:]
            if cut:
                yield self._of(key[:cut], node[:cut], prints[:cut])
        if held is not None:
            yield self._of(*held)


def near_links(nodes: DataFrame, blocks: int, equal: int, most: int, kept: int = 1, slice_rows: int = SLICE) -> DataFrame:
    """Links (a, b) that join the same distinct fingerprints as all pairs within ``most`` differing bits would.

    ``nodes`` has a long ``node`` and the ``print``. Rows meet on block keys. Keys held by one fingerprint go first.
    A key of up to ``slice_rows`` fingerprints is one run; a larger one is cut into slices, and every pair of slices
    is a run of its own, so no task ever holds more than two slices. Within a run only a spanning forest is written,
    never all pairs.
    """
    keyed = nodes.mapInArrow(_Keys(blocks, equal, kept), "node long, kept binary, keys array<long>")
    postings = keyed.select("node", "kept", F.explode("keys").alias("key"))
    shared = postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    slices = F.ceil(F.col("n") / slice_rows).cast("int")
    own = F.pmod(F.xxhash64("node"), slices).cast("int")
    placed = postings.join(by_key(shared), "key").withColumns({"_slices": slices, "_own": own})
    other = F.sequence(F.lit(0), F.col("_slices") - 1)
    pairs = F.transform(other, lambda o: F.least(o, F.col("_own")) * F.col("_slices") + F.greatest(o, F.col("_own")))
    runs = placed.select("key", F.explode(pairs).alias("part"), "node", "kept").select("key", F.col("part").cast("long"), "node", "kept")
    ordered = runs.repartition("key", "part").sortWithinPartitions("key", "part")
    return ordered.mapInArrow(_Links(most), "a long, b long")


def groups(
    docs: DataFrame, size: int = 3, lanes: int = 1, blocks: int = 6, equal: int = 3, most: int = 3, kept: int = 1, slice_rows: int = SLICE
) -> DataFrame:
    """(doc_id, print, component_id): every document with its fingerprint and the smallest doc_id it is linked to.

    Documents with the same fingerprint are one node, whatever their number. With one lane (64 bits), six blocks of
    which three must be equal and three differing bits, every link is found. With more lanes the fingerprint is cut
    into bands (``equal=1``), ``most`` is measured on its first ``kept`` words.

    A null text has no words and the fingerprint zero. A null doc_id gets a group as others do, but is never its
    name; a group of null ids alone has the component null. A repeated doc_id gets one row for each row it has.
    """
    prints = saved(fingerprints(docs, size, lanes), "prints")
    nodes = prints.groupBy("print", "node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = saved(nodes, "nodes")
    links = near_links(nodes.select("node", "print"), blocks, equal, most, kept, slice_rows)
    member = components(links)
    named = member.join(by_key(nodes.select("node", "first")), "node")
    smallest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    lookup = nodes.join(by_key(named.select("node", "component").join(by_key(smallest), "component")), "node", "left").select(
        "print", "n", F.coalesce("component_id", "first").alias("component_id")
    )
    return join_lookup(prints, by_key(lookup), "print", F.col("n"), "doc_id", sizes=lookup)


def hex_print(column: str = "print"):
    """Fingerprint bytes as lower-case hex digits."""
    return F.lower(F.hex(column))


#: Texts are near duplicates if they share this part (of 5 parts) of their distinct shingles, or more.
ALIKE = (4, 5)
#: Bands of minima: a pair at the limit shares one of 32 bands of 6 with probability 0.99994, at 0.5 with 0.40, at 0.2 with 0.002.
BANDS, MINIMA = 32, 6
#: Runs of up to so many texts are compared as single pairs; longer runs with their shingles at hand.
_PAIRED = 16
#: Shingles that a slice of a run holds, about.
_HELD = 2 << 20
_FACTORS = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text."""
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(text, size)), np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """Keys of a set of hashes: one for each band of least values under ``MINIMA`` orders; none of an empty set."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * MINIMA, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 4096):
        np.minimum(least, (_FACTORS[:, None] * found[None, at : at + 4096]).min(axis=1), out=least)
    tagged = np.concatenate([np.arange(BANDS, dtype=np.uint64)[:, None], least.reshape(BANDS, MINIMA)], axis=1)
    return np.array([xxhash.xxh64_intdigest(row.tobytes()) for row in tagged], np.uint64).view(np.int64)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of ``ALIKE`` or more."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return ALIKE[1] * both >= ALIKE[0] * (len(x) + len(y) - both)


def _alike_sizes(x: Column, y: Column) -> Column:
    return ALIKE[1] * F.least(x, y) >= ALIKE[0] * F.greatest(x, y)


class _Marks:
    """(row, doc_id, node, size, keys): the number of a text's shingle set, its size and its band keys.

    If ``printed``, its fingerprint follows as bytes and as a number.
    """

    def __init__(self, size: int, printed: bool = False):
        self.size, self.printed = size, printed
        self.schema = "_row long, doc_id long, node long, size long, keys array<long>" + ", print binary, mark long" * printed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t, self.size) for t in texts_of(batch)]
            nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            keys = [band_keys(x) for x in sets]
            offsets = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            sizes = pa.array([len(x) for x in sets], pa.int64())
            columns = [batch.column("_row"), batch.column("doc_id"), pa.array(nodes), sizes, lists]
            names = ["_row", "doc_id", "node", "size", "keys"]
            if self.printed:
                prints = np.array([fingerprint(t, 3)[0] for t in texts_of(batch)], np.uint64)
                columns += [pa.array([p.tobytes() for p in prints.astype(">u8")], pa.binary()), pa.array(prints.view(np.int64))]
                names += ["print", "mark"]
            yield pa.RecordBatch.from_arrays(columns, names)


class _Sets:
    """(node, shingles) of texts; the hashes as bytes."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            sets = [shingle_set(t, self.size).tobytes() for t in texts_of(batch)]
            nodes = np.array([xxhash.xxh64_intdigest(x) for x in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(sets, pa.binary())], ["node", "shingles"])


def _alike_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose shingles x and y are alike."""
    for batch in batches:
        found = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(batch.column("x"), batch.column("y"))]
        yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))


def _alike_forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links of a forest that joins the same sets as all alike pairs would, by breadth-first search."""
    sizes = np.array([len(x) for x in sets], np.int64)
    ends = np.cumsum(sizes)
    numbers = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = [numbers[end - size : end] for end, size in zip(ends, sizes)]
    mark = np.zeros(int(numbers.max()) + 1 if len(numbers) else 1, bool)
    links, left = [], np.arange(len(sets))
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            mark[own[at]] = True
            both = np.zeros(len(left), np.int64)
            fit = ALIKE[1] * np.minimum(sizes[left], sizes[at]) >= ALIKE[0] * np.maximum(sizes[left], sizes[at])
            both[fit] = [np.count_nonzero(mark[own[k]]) for k in left[fit]]
            mark[own[at]] = False
            near = fit & (ALIKE[1] * both >= ALIKE[0] * (sizes[left] + sizes[at] - both))
            found = left[near].tolist()
            links += [(at, other) for other in found]
            frontier += found
            left = left[~near]
    return links


def _alike_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each run of rows with the same (key, part); runs are sorted, and bounded in length."""

    def linked(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        links = [(nodes[i], nodes[j]) for i, j in _alike_forest(sets)]
        columns = [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays(columns, ["a", "b"])

    run, nodes, sets = None, [], []
    for batch in batches:
        for key, part, node, found in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "node", "shingles"))):
            if (key, part) != run:
                if nodes:
                    yield linked(nodes, sets)
                run, nodes, sets = (key, part), [], []
            nodes.append(node)
            sets.append(np.frombuffer(found, np.uint64))
    if nodes:
        yield linked(nodes, sets)


def _alike_links(rows: DataFrame, nodes: DataFrame, size: int, paired: int, slice_rows: int) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs that share a band key and are alike would.

    Keys held by the same nodes are one run. The pairs of runs of up to ``paired`` nodes are compared once each, whatever
    the number of runs they meet in. Longer runs get the shingles of their nodes and write a spanning forest only; they
    are cut into slices as in ``near_links``, by their nodes and by their shingles.
    """
    postings = nodes.select("node", "size", F.explode("keys").alias("key"))
    held = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("p"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("q")
    )
    runs = saved(held.where("n > 1").groupBy("n", "p", "q").agg(F.min("key").alias("key"), F.max("total").alias("total")), "runs")
    short = postings.join(by_key(runs.where(F.col("n") <= paired).select("key")), "key")
    members = short.groupBy("key").agg(F.collect_list(F.struct("node", "size")).alias("them"))
    pairs = members.select(F.explode("them").alias("x"), "them").select("x", F.explode("them").alias("y"))
    pairs = pairs.where((F.col("x.node") < F.col("y.node")) & _alike_sizes(F.col("x.size"), F.col("y.size")))
    pairs = saved(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct(), "pairs")

    slices = F.ceil(F.greatest(F.col("n") / slice_rows, F.col("total") / _HELD)).cast("int")
    long = postings.join(by_key(runs.where(F.col("n") > paired).select("key", slices.alias("_slices"))), "key")
    long = saved(long.select("key", "node", "_slices", F.pmod(F.xxhash64("node"), "_slices").cast("int").alias("_own")), "long_runs")
    other = F.sequence(F.lit(0), F.col("_slices") - 1)
    parts = F.transform(other, lambda o: F.least(o, F.col("_own")).cast("long") * F.col("_slices") + F.greatest(o, F.col("_own")))

    ends = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    of = by_key(nodes.select("node", F.col("first._row").alias("_row")))
    needed = ends.unionByName(long.select("node")).distinct().join(of, "node").select("_row")
    texts = rows.select("_row", "text").join(by_key(needed), "_row", "left_semi")
    sets = saved(texts.mapInArrow(_Sets(size), "node long, shingles binary"), "sets")
    told = pairs.join(by_key(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))), "a")
    told = told.join(by_key(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))), "b")
    near = told.mapInArrow(_alike_pairs, "a long, b long")
    whole = long.select("key", "node", F.explode(parts).alias("part")).join(by_key(sets), "node")
    ordered = whole.repartition("key", "part").sortWithinPartitions("key", "part")
    return near.unionByName(ordered.mapInArrow(_alike_runs, "a long, b long"))


def _alike_nodes(rows: DataFrame, size: int, paired: int, slice_rows: int, printed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(_row, doc_id, node) of numbered rows, and (node, n, root, first) of distinct shingle sets.

    The root names the group of a set; if ``printed``, near fingerprints join groups, too.
    """
    slim = spread(rows.select("_row", "doc_id", "text"))
    mark = _Marks(size, printed)
    marks = saved(slim.mapInArrow(mark, mark.schema), "marks")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "_row")).alias("first")
    nodes = saved(marks.groupBy("node").agg(first, F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("keys").alias("keys")), "nodes")
    links = _alike_links(rows, nodes, size, paired, slice_rows)
    member = components(links.unionByName(_print_links(marks)) if printed else links)
    named = nodes.select("node", "n", "first").join(by_key(member), "node", "left")
    return marks.select("_row", "doc_id", "node"), named.select("node", "n", F.coalesce("component", "node").alias("root"), "first")


def near_duplicates(docs: DataFrame, size: int = 5, paired: int = _PAIRED, slice_rows: int = SLICE) -> DataFrame:
    """(doc_id, component_id): documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles.

    Candidates share one of 32 bands of 6 least hashes (a pair at 0.8 does with probability 0.99994, and surer above);
    only pairs whose exact sets of shingles reach the similarity are linked. Bits of fingerprints can't tell 0.8 from
    0.75, and would need thousands of them to find 99 % of the pairs. Texts without words are one group.
    The component is the smallest doc_id of the group, null for null ids alone; every row has a row.
    """
    marks, named = _alike_nodes(numbered(docs.select("doc_id", "text"))[0], size, paired, slice_rows)
    named = saved(named, "named")
    smallest = named.groupBy("root").agg(F.min("first").alias("least")).select("root", F.col("least.doc_id").alias("component_id"))
    lookup = named.select("node", "n", "root").join(by_key(smallest), "root").select("node", "n", "component_id")
    return join_lookup(marks, by_key(lookup), "node", F.col("n"), "_row", sizes=lookup).select("doc_id", "component_id")


def _print_links(marks: DataFrame) -> DataFrame:
    """Links (a, b) that join the nodes of rows whose fingerprints differ in three bits or less, by ``near_links``.

    Each distinct fingerprint is stood for by the least node that has it.
    """
    pairs = saved(marks.select("node", "print", "mark").distinct(), "printed")
    least = saved(pairs.groupBy("mark", "print").agg(F.min("node").alias("b")), "printed_least")
    same = pairs.join(by_key(least), ["mark", "print"]).where("node != b").select(F.col("node").alias("a"), "b")
    near = near_links(least.select(F.col("mark").alias("node"), "print"), 6, 3, 3)
    ends = [by_key(least.select(F.col("mark").alias(c), F.col("b").alias(f"_{c}"))) for c in "ab"]
    return same.unionByName(near.join(ends[0], "a").join(ends[1], "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the smallest doc_id.

    Rows are linked if their SimHash fingerprints (64 bits, three-word shingles, as in ``groups``) differ in three bits
    or less, and also if their five-word shingles are alike (``near_duplicates``), as a changed passage moves more bits
    than that. Every row is judged by its own text: rows that repeat a doc_id stay if their texts are not linked, and
    rows without a doc_id are matched as others are, but stay only if their group has no doc_id.
    """
    rows, row = numbered(docs)
    _, named = _alike_nodes(rows.select(F.col(row).alias("_row"), "doc_id", "text"), 5, _PAIRED, SLICE, printed=True)
    chosen = named.groupBy("root").agg(F.min("first").alias("least")).select(F.col("least._row").alias(row))
    return rows.join(by_key(chosen), row, "left_semi").drop(row)
