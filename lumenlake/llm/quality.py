"""Document quality: a linear-chain conditional random field over lines, its marginals added up by length."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import labelled, pieces, remainder, saved, texts_of
from lumenlake.plans.parallel import spread

KEEP = 0.7
#: Bounds of what the model is fitted on: labelled documents, and runs of lines of one of them, spread over its whole text.
SAMPLE_ROWS, RUNS, RUN_LINES = 4_000, 8, 50
STEPS, ROUNDS, RATE, RIDGE = 80, 2, 0.15, 1e-3
_PIECE = 2 << 20

_SPACE, _UPPER, _LOWER, _DIGIT, _STOP, _BAR, _BANG, _SYMBOL, _NEWLINE = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
for _codes, _kind in (
    (range(128, 256), _LOWER), (range(97, 123), _LOWER), (range(65, 91), _UPPER), (range(48, 58), _DIGIT),
    (b".,;:?'\"-()", _STOP), (b"|", _BAR), (b"!", _BANG), (b" \t\r\x0b\x0c", _SPACE), (b"\n", _NEWLINE),
):
    for _code in _codes:
        _CLASS[_code] = _kind

OWN = 15
#: Features that a line also takes from the line before and the line behind it.
NEIGHBOURS = (2, 4, 5, 6, 7, 8, 10, 11)
WIDTH = OWN + 2 * len(NEIGHBOURS) + 2


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines of each text, octets of each line); an empty text has one empty line."""
    buffer = b"\n".join(texts) + b"\n"
    kind = _CLASS[np.frombuffer(buffer, np.uint8)]
    ends = np.flatnonzero(kind == _NEWLINE)
    starts = np.concatenate([[0], ends[:-1] + 1])
    octets = ends - starts
    counts = np.array([t.count(b"\n") + 1 for t in texts], np.int64)

    def per_line(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, starts, dtype=np.int64).astype(np.float64)

    gap = (kind == _SPACE) | (kind == _NEWLINE)
    word_end = np.zeros(len(kind), bool)
    word_end[:-1] = ~gap[:-1] & gap[1:]
    words = per_line(word_end)
    marked = per_line(word_end & (kind == _SYMBOL))
    shares = [per_line(kind == k) / np.maximum(octets, 1) for k in (_UPPER, _LOWER, _DIGIT, _STOP, _BAR, _BANG, _SYMBOL)]
    distinct, repeated, copies = np.empty(len(starts)), np.empty(len(starts)), np.empty(len(starts))
    at = 0
    for text in texts:
        lines = text.split(b"\n")
        often = Counter(lines)
        for line in lines:
            found = line.split()
            distinct[at], repeated[at] = len(set(found)), sum(map(eq, found, found[1:]))
            copies[at] = often[line] > 1 and bool(found)
            at += 1
    many = np.maximum(words, 1)
    last = kind[np.maximum(ends - 1, starts)]
    own = np.stack(
        [
            np.ones(len(starts)),
            np.log1p(octets),
            *shares,
            words / np.maximum(octets, 1),
            np.where(words > 0, distinct / many, 1.0),
            repeated / many,
            marked / many,
            (last == _STOP) & (octets > 0),
            copies,
        ],
        axis=1,
    )
    first = np.zeros(len(starts), bool)
    first[np.cumsum(counts) - counts] = True
    final = np.zeros(len(starts), bool)
    final[np.cumsum(counts) - 1] = True
    near = own[:, NEIGHBOURS]
    before, behind = np.zeros_like(near), np.zeros_like(near)
    before[1:], behind[:-1] = near[:-1], near[1:]
    before[first], behind[final] = near[first], near[final]  # at the edges a line stands for its neighbour
    return np.concatenate([own, before, behind, first[:, None], final[:, None]], axis=1), counts, octets


class Chain:
    """Two labels (0 bad, 1 good): a weight for each feature of a good line, and one for each pair of labels."""

    def __init__(self, width: int = WIDTH):
        self.weights, self.pairs = np.zeros(width), np.zeros((2, 2))
        self.mean, self.scale = np.zeros(width), np.ones(width)

    def scaled(self, features: np.ndarray) -> np.ndarray:
        return (features - self.mean) / self.scale

    def marginals(self, features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability that each line is good, expected pairs of labels), by forward-backward over all texts at once.

        ``features`` are scaled. Texts go through their lines together, longest first, so that those still going are
        the first ones; every step is one line of each.
        """
        node = np.ones((len(features), 2))
        node[:, 1] = np.exp(np.clip(features @ self.weights, -30, 30))
        step = np.exp(self.pairs)
        order = np.argsort(-counts, kind="stable")
        starts, lengths = (np.cumsum(counts) - counts)[order], counts[order]
        going = np.searchsorted(-lengths, -np.arange(int(lengths.max(initial=0))), "left")
        forward, backward = np.empty_like(node), np.ones_like(node)
        for t, n in enumerate(going.tolist()):
            at = starts[:n] + t
            a = node[at] if t == 0 else node[at] * (forward[at - 1] @ step)
            forward[at] = a / a.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(len(going) - 1, 0, -1):
            at = starts[: going[t]] + t
            carried = node[at] * backward[at]
            b = carried @ step.T
            joint = forward[at - 1][:, :, None] * step * carried[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            backward[at - 1] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1), expected

    def fit(self, features: np.ndarray, counts: np.ndarray, labels: np.ndarray, steps: int = STEPS) -> None:
        """Maximise the conditional likelihood of the line labels by gradient steps with adapted rates."""
        observed = features.T @ labels
        inside = np.ones(len(labels), bool)
        inside[np.cumsum(counts) - counts] = False
        behind = labels[inside].astype(int)
        ahead = labels[np.flatnonzero(inside) - 1].astype(int)
        seen = np.zeros((2, 2))
        np.add.at(seen, (ahead, behind), 1)
        size = max(1, len(labels))
        theta = np.concatenate([self.weights, self.pairs.ravel()])
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, steps + 1):
            self.weights, self.pairs = theta[:-4], theta[-4:].reshape(2, 2)
            good, expected = self.marginals(features, counts)
            slope = np.concatenate([observed - features.T @ good, (seen - expected).ravel()]) / size - RIDGE * theta
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
            theta = theta + RATE * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
        self.weights, self.pairs = theta[:-4], theta[-4:].reshape(2, 2)


def pool_adjacent(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression: knots and their values. Points of one x share a value, in whatever order they come."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (
            blocks[-2][3] == blocks[-1][2] or blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]
        ):
            s, n, _, end = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], end]
    knots = [(x, s / n) for s, n, a, b in blocks for x in ((a, b) if b > a else (a,))]
    return np.array([k for k, _ in knots]), np.array([v for _, v in knots])


def spread_runs(lines: int) -> list[tuple[int, int]]:
    """(first, end) of the runs of a text's lines that are fitted on: all of a short text, else ``RUNS`` from start to end."""
    if lines <= RUNS * RUN_LINES:
        return [(0, lines)]
    starts = np.linspace(0, lines - RUN_LINES, RUNS).astype(int)
    return [(a, a + RUN_LINES) for a in starts.tolist()]


def _sampled_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, label, runs, features) of whole texts: features of the lines of their runs, worked out among all lines."""
    for batch in batches:
        texts, runs, kept = texts_of(batch), [], []
        for a, b in pieces([len(t) for t in texts], _PIECE):
            features, counts, _ = line_features(texts[a:b])
            for first, lines in zip((np.cumsum(counts) - counts).tolist(), counts.tolist()):
                chosen = spread_runs(lines)
                runs.append([y - x for x, y in chosen])
                kept.append(np.concatenate([features[first + x : first + y] for x, y in chosen]).astype(np.float32).tobytes())
        columns = [batch.column("doc_id"), batch.column("label"), pa.array(runs, pa.list_(pa.int32())), pa.array(kept, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "runs", "features"])


class Quality:
    """A fitted field and the curve from the length-weighted share of good lines to a probability."""

    def __init__(self, constant: float | None = None):
        self.chain, self.constant = Chain(), constant
        self.curve = np.array([0.0, 1.0]), np.array([0.0, 1.0])

    def fit(self, features: np.ndarray, runs: np.ndarray, of: np.ndarray, labels: np.ndarray) -> None:
        """Fit the field on runs of lines: their lengths, the document each belongs to, and the documents' labels."""
        self.chain.mean, self.chain.scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-6)
        self.chain.mean[0], self.chain.scale[0] = 0, 1
        scaled = self.chain.scaled(features)
        owner = np.repeat(of, runs)
        document = labels[owner].astype(float)
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.append(starts, len(owner)))
        lines = document
        for _ in range(ROUNDS):
            self.chain.fit(scaled, runs, lines)
            # a bad document may hold good lines: those the field is sure of count as good in the next round
            good, _ = self.chain.marginals(scaled, runs)
            lines = np.where((document == 0) & (good > 0.9), 1.0, document)
            worst = np.minimum.reduceat(lines, starts)
            lines = np.where(np.repeat(worst == 1, sizes) & (document == 0), document, lines)

    def calibrate(self, shares: np.ndarray, labels: np.ndarray) -> None:
        self.curve = pool_adjacent(shares, labels.astype(float))

    def _shares(self, texts: list[bytes]) -> np.ndarray:
        shares = np.empty(len(texts))
        for a, b in pieces([len(t) for t in texts], _PIECE):
            features, counts, octets = line_features(texts[a:b])
            good, _ = self.chain.marginals(self.chain.scaled(features), counts)
            starts, weight = np.cumsum(counts) - counts, octets + 1.0
            shares[a:b] = np.add.reduceat(good * weight, starts) / np.add.reduceat(weight, starts)
        return shares

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return np.interp(self._shares(texts), *self.curve)

    def labelled_shares(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(doc_id, label, share of good lines) of whole texts."""
        for batch in batches:
            shares = pa.array(self._shares(texts_of(batch)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), shares], ["doc_id", "label", "share"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(self.scores(texts_of(batch)), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), scores], ["doc_id", "score"])


def fit(docs: DataFrame, labels: DataFrame, train: Column, rows: int = SAMPLE_ROWS) -> Quality:
    """The model from at most ``rows`` labelled documents, two thirds for the field, the others for the curve.

    Features and shares come from whole texts, in tasks. The driver holds the features of at most ``RUNS`` runs of
    ``RUN_LINES`` lines of each document, spread from its first to its last line, and one share of each.
    """
    held = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 2
    sample = saved(spread(labelled(docs, labels, "quality", train, rows)).withColumn("held", held), "quality_sample")
    sizes = {(r.held, r.label): r["count"] for r in sample.groupBy("held", "label").count().collect()}
    classes = sorted({label for _, label in sizes})
    if len(classes) < 2:
        return Quality(float(classes[0]) if classes else 0.0)
    split = all((side, label) in sizes for side in (True, False) for label in classes)
    learn, check = (sample.where(~F.col("held")), sample.where("held")) if split else (sample, sample)
    schema = "doc_id long, label int, runs array<int>, features binary"
    found = learn.select("doc_id", "label", "text").mapInArrow(_sampled_lines, schema).collect()
    found.sort(key=lambda r: (r.doc_id, bytes(r.features)))
    features = np.concatenate([np.frombuffer(r.features, np.float32).reshape(-1, WIDTH) for r in found]).astype(np.float64)
    runs = np.concatenate([np.array(r.runs, np.int64) for r in found])
    of = np.repeat(np.arange(len(found)), [len(r.runs) for r in found])
    model = Quality()
    model.fit(features, runs, of, np.array([r.label for r in found], np.int64))
    shares = check.select("doc_id", "label", "text").mapInArrow(model.labelled_shares, "doc_id long, label int, share double").collect()
    shares.sort(key=lambda r: (r.doc_id, r.share))
    model.calibrate(np.array([r.share for r in shares]), np.array([r.label for r in shares]))
    return model


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text.

    Lines are cut at line feeds. Line labels begin as the label of the document. A null or empty text is one empty
    line and is scored as such; rows that repeat a doc_id are scored each, and so are null ids, whose remainder is that
    of the empty text. Without labels every score is 0; with one class only it is that class.
    """
    train = remainder("doc_id", 4) != 2
    model = fit(docs, labels, train)
    scored = spread(docs.select("doc_id", "text")).mapInArrow(model, "doc_id long, score double")
    return scored.select("doc_id", (~train).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))
