"""Toxicity: boosted trees over dense features of words and characters, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.boosting import Boosted
from lumenlake.llm.common import labelled, numbered, per_text, pieces, remainder, saved, texts_of
from lumenlake.plans.parallel import spread

REJECT = 0.7
#: Bound of the labelled sample that the lexicon and the trees are fitted on.
SAMPLE_ROWS = 20_000
#: Bound of the learnt lexicon.
LEXICON = 4_000
#: A term is learnt if its log-odds for toxic texts are so many standard errors above zero.
LEAST_Z = 3.0
PREFIXES = (4, 5, 6)
NEAR = 3
#: Octets of text whose features are worked out at once, and words whose kind a task remembers.
_PIECE, _MEMO = 2 << 20, 200_000

# fixed values: common insults, and second-person words, of four languages
INSULTS = frozenset(
    "idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown bastard jerk ugly hate kill shut "
    "dumm dummkopf trottel abschaum arschloch idioten hasse "
    "idiote stupide imbécile ordure salaud connard crétin haine "
    "idiota estúpido imbécil basura escoria asqueroso cabrón odio".split()
)
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
_LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_EDGES = re.compile(r"^\W+|\W+$|_+$|^_+")
_INNER = re.compile(r"[^\W\d_][^\w\s'’-]+[^\W\d_]|[^\W\d_]\d|\d[^\W\d_]|[^\W\d_]_+[^\W\d_]")
_THRICE = re.compile(r"([^\W\d_])\1\1")

LEARNT, PREFIX, INSULT, SECOND, CAPITALS, HIDDEN, VEILED, LONG = (1 << k for k in range(8))
_FLAGS = (LEARNT, PREFIX, INSULT, SECOND, CAPITALS, HIDDEN, VEILED, LONG)
_BYTES = np.zeros(256, np.uint8)  # 1 upper case, 2 punctuation, 3 exclamation mark, 4 digit
_BYTES[65:91] = 1
for _mark in b"\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~":
    _BYTES[_mark] = 2
_BYTES[33] = 3
_BYTES[48:58] = 4


def bare(word: str) -> str:
    """A word in lower case without the marks around it."""
    return _EDGES.sub("", word.lower())


def terms(word: str) -> list[str]:
    """What the lexicon may hold of a bare word: the word, and its beginnings (marked with a dash)."""
    return [word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)]


class _Terms:
    """(term, toxic texts with it, clean texts with it), added up within a task."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        for batch in batches:
            for text, label in zip(texts_of(batch), batch.column("label").to_pylist()):
                words = {bare(w) for w in text.decode().split()} - {""}
                (toxic if label else clean).update({t for w in words for t in terms(w)})
        names = sorted(toxic)  # a term without a toxic text is never learnt
        columns = [pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (toxic, clean))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])
        for at in range(0, len(rest := sorted(clean.keys() - toxic.keys())), 50_000):
            part = rest[at : at + 50_000]
            zeros, counts = pa.array([0] * len(part), pa.int64()), pa.array([clean[t] for t in part], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), zeros, counts], ["term", "toxic", "clean"])


def learn_lexicon(sample: DataFrame, most: int = LEXICON) -> dict[str, float]:
    """The terms that mark toxic texts, with their log-odds; at most ``most`` of them."""
    sizes = dict(sample.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return {}
    counted = sample.mapInArrow(_Terms(), "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))

    def odds(column: str, total: int) -> Column:
        return F.log((F.col(column) + 0.5) / (F.lit(total) - F.col(column) + 0.5))

    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    scored = counted.where("t >= 3").select("term", (odds("t", toxic) - odds("c", clean)).alias("weight"), error.alias("error"))
    best = scored.withColumn("z", F.col("weight") / F.col("error")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "term").limit(most)
    return {row.term: row.weight for row in best.collect()}


class Features:
    """Dense features of whole texts; what a word counts as is worked out once for each distinct word of a task."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon

    def _kind(self, raw: bytes) -> tuple[int, float]:
        word = raw.decode()
        plain = bare(word)
        found = [self.lexicon[t] for t in terms(plain) if t in self.lexicon] if plain else []
        flags = LEARNT * (plain in self.lexicon) | PREFIX * bool(found) | INSULT * (plain in INSULTS) | SECOND * (plain in YOU)
        flags |= CAPITALS * (len(plain) > 1 and word.isupper()) | LONG * bool(_THRICE.search(plain))
        if _INNER.search(word):
            flags |= HIDDEN
            open_word = re.sub(r"[\W\d_]", "", word.lower().translate(_LOOKALIKE))
            if open_word != plain and (open_word in INSULTS or open_word in self.lexicon):
                flags |= VEILED
        return flags, max(found, default=0.0)

    def of(self, texts: list[bytes], memo: dict[bytes, int], kinds: list[tuple[int, float]]) -> np.ndarray:
        """A row of features for every text; ``memo`` has the place of each word met so far in ``kinds``."""
        numbers: list[int] = []
        sizes = np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            words = text.split()
            sizes[k] = len(words)
            for word in words:
                number = memo.get(word)
                if number is None:
                    number = memo[word] = len(kinds)
                    kinds.append(self._kind(word))
                numbers.append(number)
        table = np.array(kinds, np.float64).reshape(-1, 2)
        at = np.array(numbers, np.int64)
        flags, weights = table[at, 0].astype(np.int64), table[at, 1]
        many = np.maximum(sizes, 1)
        counts = [per_text((flags & f) > 0, sizes) for f in _FLAGS]
        doc = np.repeat(np.arange(len(texts)), sizes)
        you, bad = (flags & SECOND) > 0, (flags & (LEARNT | PREFIX | INSULT | VEILED)) > 0
        close = np.zeros(len(flags), bool)
        for step in range(1, NEAR + 1):
            same = doc[step:] == doc[:-step]
            close[step:] |= same & you[:-step] & bad[step:]
            close[:-step] |= same & you[step:] & bad[:-step]
        heaviest = np.zeros(len(texts))
        np.maximum.at(heaviest, doc, weights)
        octets = np.array([len(t) for t in texts], np.int64)
        classes = _BYTES[np.frombuffer(b"".join(texts), np.uint8)]
        rates = [per_text(classes == k, octets) / np.maximum(octets, 1) for k in (1, 2, 3, 4)]
        columns = [c / many for c in counts] + [np.log1p(c) for c in counts[:3]] + [per_text(close, sizes) / many, heaviest, per_text(weights, sizes) / many]
        return np.stack([*columns, *rates, np.log1p(sizes)], axis=1)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        kinds: list[tuple[int, float]] = []
        for batch in batches:
            texts, found = texts_of(batch), []
            for a, b in pieces([len(t) for t in texts], _PIECE):
                if len(kinds) > _MEMO:
                    memo, kinds = {}, []
                found.append(self.of(texts[a:b], memo, kinds))
            rows = np.concatenate(found) if found else np.zeros((0, 1))
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1])
            lists = pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()))
            kept = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), lists], [*kept, "features"])


class Toxicity:
    """A fitted model: ``score`` gives every document a probability."""

    def __init__(self, docs: DataFrame, labels: DataFrame, train: Column, sample_rows: int = SAMPLE_ROWS):
        sample = saved(spread(labelled(docs, labels, "toxic", train, sample_rows)), "toxic_sample")
        self.features = Features(learn_lexicon(sample))
        rows = saved(sample.mapInArrow(self.features, "doc_id long, label int, features array<double>"), "toxic_features")
        self.model = Boosted(rows)

    def score(self, docs: DataFrame) -> DataFrame:
        """(doc_id, score, predicted) of every whole text."""
        rows = spread(docs.select("doc_id", "text")).mapInArrow(self.features, "doc_id long, features array<double>")
        return self.model.score(rows, ["doc_id"]).withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


def train_rows() -> Column:
    """Documents whose labels may be learnt from."""
    return remainder("doc_id", 3) != 1


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    The lexicon, the trees and the calibration come from at most ``SAMPLE_ROWS`` labelled documents. A null or empty
    text has no words and is scored by its zero features; rows that repeat a doc_id are scored each; a null doc_id is
    scored too and its remainder is that of the empty text. Without labels every score is 0.
    """
    found = Toxicity(docs, labels, train_rows()).score(docs)
    return found.select("doc_id", (~train_rows()).alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are not rejected. Columns named like the features are no matter.

    Every row is judged by its own text, also rows without a doc_id and rows that repeat one.
    """
    rows, row = numbered(docs)
    scored = Toxicity(docs, labels, train_rows()).score(rows.select(F.col(row).alias("doc_id"), "text"))
    bad = scored.where("predicted = 1").select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").drop(row)
