"""Nearest neighbours by multi-index hashing: learned rotated binary codes, substring indexes, floats last."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import saved
from lumenlake.plans.parallel import spread
from lumenlake.plans.skew import join_lookup

#: Bounds of the sample that rotations and radius are learnt from: vectors, and queries among them.
SAMPLE_ROWS, SAMPLE_QUERIES = 8_000, 300
CODE_BITS, SUBSTRING_BITS = 256, 16
#: Share of the sample's true neighbours that the radius reaches.
REACH = 0.98
#: Distinct vectors of one index, and distinct queries of one pass over all rows.
BLOCK, QUERIES = 16_384, 16_384


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose vectors take part, with a digest of the vector."""
    for batch in batches:
        kept, keys = [], []
        for k, vector in enumerate(batch.column("vector").to_pylist()):
            if vector and None not in vector:
                v = np.array(vector)
                if np.isfinite(v).all() and v.any():
                    kept.append(k)
                    keys.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest())
        rows = batch.take(pa.array(kept, pa.int64()))
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(keys, pa.binary())], ["vec_id", "vector", "key"])


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


class Codes:
    """Binary codes: several rotations that turn the leading directions towards the corners of a cube (ITQ).

    The largest inner product is made a smallest angle first: a vector gets one more component that brings it to the
    largest length of all, a query gets 0 there.
    """

    def __init__(self, sample: np.ndarray, longest: float, bits: int = CODE_BITS, rounds: int = 15):
        self.longest = max(longest, 1e-300)
        unit = self.lifted(sample)
        width = min(unit.shape[1], 64)
        _, _, directions = np.linalg.svd(unit, full_matrices=False)
        base = np.zeros((unit.shape[1], width))
        base[:, : min(width, len(directions))] = directions[:width].T
        random = np.random.default_rng(5)
        self.turns = []
        for _ in range(-(-bits // width)):
            turn, _ = np.linalg.qr(random.standard_normal((width, width)))
            flat = unit @ base
            for _ in range(rounds):
                u, _, v = np.linalg.svd(flat.T @ np.sign(flat @ turn))
                turn = u @ v
            self.turns.append(base @ turn)
        self.radius = 0

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        v = vectors / self.longest
        rest = np.sqrt(np.maximum(0, 1 - (v**2).sum(axis=1)))
        return np.concatenate([v, rest[:, None]], axis=1)

    def of(self, vectors: np.ndarray, query: bool = False) -> np.ndarray:
        """Substrings of the codes, 16 bits each."""
        lifted = np.concatenate([vectors, np.zeros((len(vectors), 1))], axis=1) if query else self.lifted(vectors)
        bits = np.concatenate([lifted @ t > 0 for t in self.turns], axis=1)[:, :CODE_BITS]
        full = np.zeros((len(bits), CODE_BITS), bool)
        full[:, : bits.shape[1]] = bits
        return np.packbits(full, axis=1).view(np.uint16)

    def learn_radius(self, sample: np.ndarray, k: int) -> None:
        """The Hamming distance within which ``REACH`` of the true neighbours of sampled queries lie."""
        queries = sample[:SAMPLE_QUERIES]
        inner = queries @ sample.T
        inner[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
        best = np.argsort(-inner, axis=1)[:, : min(k, len(sample) - 1)]
        mine, other = self.of(queries, query=True), self.of(sample)
        distances = np.bitwise_count(mine[:, None, :] ^ other[best]).sum(axis=2, dtype=np.int64)
        self.radius = int(np.quantile(distances, REACH)) if distances.size else CODE_BITS


class Index:
    """One block's codes: for each substring the buckets of its values, each a run of rows."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.tables, self.touched = codes, [], 0
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable")
            values, starts = np.unique(codes[order, j], return_index=True)
            self.tables.append((values, np.append(starts, len(order)), order))

    @staticmethod
    @cache
    def _masks(bits: int) -> np.ndarray:
        """All patterns of so many differing bits."""
        every = np.arange(1 << SUBSTRING_BITS, dtype=np.uint16)
        return every[np.bitwise_count(every) == bits]

    def _buckets(self, query: np.ndarray, radius: int) -> Iterator[np.ndarray]:
        """Rows of the buckets that differ from the query in 0, 1, 2, ... bits of some substring."""
        steps = range(SUBSTRING_BITS + 1)
        patterns = sum(len(self._masks(b)) for b in steps[: radius // len(self.tables) + 1])
        near = [None if patterns < len(v) else np.bitwise_count(v ^ own) for (v, _, _), own in zip(self.tables, query)]
        for bits in steps:
            rows = []
            for (values, starts, order), own, distance in zip(self.tables, query, near):
                if distance is None:
                    wanted = own ^ self._masks(bits)
                    at = np.minimum(np.searchsorted(values, wanted), len(values) - 1)
                    at = at[values[at] == wanted]
                else:  # fewer buckets than patterns of bits: their list is gone through, once
                    at = np.flatnonzero(distance == bits)
                lengths = starts[at + 1] - starts[at]
                ends = np.cumsum(lengths)
                rows.append(order[np.repeat(starts[at] - ends + lengths, lengths) + np.arange(int(lengths.sum()))])
            yield np.concatenate(rows)

    def probe(self, query: np.ndarray, radius: int, least: int = 0) -> np.ndarray:
        """Rows whose code is within the radius of the query's; if these are fewer than ``least``, within a larger one.

        Of codes that differ in fewer than (s + 1) x substrings bits, one substring differs in at most s. So buckets are
        looked up at 0, 1, 2, ... differing bits until all codes within the radius have been met, and only rows that
        were met have their whole distance worked out. The radius grows a step at a time while there are too few.
        """
        met = np.zeros(len(self.codes), bool)
        distances = np.full(len(self.codes), 8 * self.codes.itemsize * self.codes.shape[1] + 1)
        within = met
        for bits, rows in enumerate(self._buckets(query, radius)):
            new = np.zeros(len(met), bool)
            new[rows] = True
            new = np.flatnonzero(new & ~met)
            met[new] = True
            distances[new] = np.bitwise_count(self.codes[new] ^ query).sum(axis=1, dtype=np.int64)
            sure = (bits + 1) * len(self.tables) - 1  # every code within this distance has been met
            if sure >= radius:
                within = distances <= radius
                if within.sum() < least:
                    within = distances <= sure
                if within.sum() >= least:
                    break
        self.touched += int(met.sum())
        return np.flatnonzero(within)


class _Search:
    """(key of the query, vec_id, score) of the ``k`` nearest among a task's rows, block by block, for each query of a pass."""

    def __init__(self, codes: Codes, k: int, keys: list[bytes], asked: np.ndarray):
        self.codes, self.k, self.keys, self.asked = codes, k, keys, asked

    def _search(self, vectors: np.ndarray, ids: list[list[int]], best: list[list[tuple[float, int]]]) -> None:
        index, probes = Index(self.codes.of(vectors)), self.codes.of(self.asked, query=True)
        for q, probe in enumerate(probes):
            found = index.probe(probe, self.codes.radius, self.k)
            scores = vectors[found] @ self.asked[q]
            if len(found) > self.k:
                cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                found = found[scores >= cut - 1e-9 * max(1.0, abs(cut))]
            exact = (vectors[found] * self.asked[q]).sum(axis=1)
            more = [(-s, i) for f, s in zip(found.tolist(), exact.tolist()) for i in ids[f]]
            best[q] = sorted(best[q] + more)[: self.k]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, int]]] = [[] for _ in self.keys]
        held, size = [], 0

        def close() -> None:
            table = pa.Table.from_batches(held)
            self._search(_matrix(table, "vector"), table.column("ids").to_pylist(), best)

        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if held and size + part.num_rows > BLOCK:
                    close()
                    held, size = [], 0
                held.append(part)
                size += part.num_rows
        if size:
            close()
        rows = [(key, i, -s) for key, found in zip(self.keys, best) for s, i in found]
        columns = list(zip(*rows)) or [[]] * 3
        kinds = (pa.binary(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["key", "vec_id", "score"])


def nearest(vectors: DataFrame, wanted: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of every row that ``wanted`` selects, among all other rows.

    ``vectors`` has vec_id and embedding. Nearness is the largest inner product in double precision, ties go to the
    smaller vec_id. Equal vectors are searched and found once: of each distinct vector the ``k + 1`` smallest ids can be
    in a result, which is exact, however many copies there are. Distinct vectors stand where they are stored, in blocks
    that are each indexed by the substrings of its codes; queries come to them, at most ``QUERIES`` in a pass over the
    rows, so no vector is shuffled or copied for the search. A query looks up growing buckets until it has met every
    code within the learned radius, and goes on while a block gave it fewer than ``k + 1``.

    Rows with a null id, a null or zero vector, or one with null or non-finite components take no part, and neither do
    vectors whose length is not the commonest one. Rows that share the query's id are its own. Without rows there is no
    result.
    """
    spark = vectors.sparkSession
    slim = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    clean = saved(spread(slim).mapInArrow(_clean, "vec_id long, vector array<double>, key binary"), "vectors")
    lengths = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    clean = clean.where(F.size("vector") == lengths.n)
    turn = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    unique = clean.select("key", "vec_id").distinct().withColumn("turn", turn).where(F.col("turn") <= k + 1)
    ids = unique.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("first"))
    values = clean.groupBy("key").agg(F.min_by("vector", "vec_id").alias("vector"))
    nodes = saved(values.join(ids, "key"), "distinct_vectors")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    sample = nodes.orderBy(F.xxhash64("key")).limit(SAMPLE_ROWS).select("vector").collect()
    sample = np.array([r.vector for r in sample])
    codes = Codes(sample, nodes.agg(F.max(norm)).first()[0])
    codes.learn_radius(sample, k)
    asking = clean.where(wanted).select(F.col("vec_id").alias("query_id"), "key").distinct()
    counted = saved(asking.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "query_counts")
    passes = max(1, -(-counted.count() // QUERIES))
    asked = nodes.join(counted, "key", "left_semi").select("key", "vector", F.pmod(F.xxhash64("key"), F.lit(passes)).alias("pass"))
    rows, found = spread(nodes.select("vector", "ids")), None
    for number in range(passes):
        mine = asked.where(F.col("pass") == number).orderBy("key").collect()
        if mine:
            search = _Search(codes, k + 1, [bytes(r.key) for r in mine], np.array([r.vector for r in mine]))
            part = rows.mapInArrow(search, "key binary, vec_id long, score double")
            part = part if passes == 1 else saved(part, "found")
            found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    nearest_first = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("place", F.row_number().over(nearest_first)).where(F.col("place") <= k + 1)
    listed = best.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))
    answers = listed.join(counted, "key")
    joined = join_lookup(asking, answers, "key", F.col("n"), "query_id", "inner")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    ranked = joined.select("query_id", F.posexplode(others).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
