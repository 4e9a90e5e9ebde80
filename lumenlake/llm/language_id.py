"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays, one for each language."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlake.llm.common import pieces, remainder, saved
from lumenlake.plans.parallel import spread

ORDER = 4
#: Bounds of the training sample: documents of each language, and of all, but never fewer than ``EACH`` of each. All of
#: its n-grams make up the model.
SAMPLE_ROWS, ALL_ROWS, EACH = 4_000, 40_000, 20
#: Languages whose probabilities stand in one table.
TABLE = 8
#: One sampled document in so many is kept for the calibration.
CHECK = 5
UNKNOWN = "und"
#: Share of the training documents that the rejection is calibrated to accept.
ACCEPT = 0.995
_PIECE = 1 << 20
_CHAR = np.uint64(16)


@cache
def _folded() -> np.ndarray:
    """Lower-case letter of every code point, in 16 bits; 0 for everything that is no letter.

    Letters above U+FFFF are numbered in turn through the codes that no letter has (surrogates and private use), so
    they never meet those below, nor the next 8,447 of their own.
    """
    table = np.zeros(0x110000, np.uint16)
    above: dict[int, int] = {}
    for code in range(0x110000):
        if (char := chr(code)).isalpha():
            lower = ord(char.lower()[0])
            table[code] = lower if lower <= 0xFFFF else 0xD800 + above.setdefault(lower, len(above)) % 0x2100
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key of the n-gram that ends at each character, number of characters, number of letters of each text).

    Letters are in lower case, every run of other characters is one blank, and what lies before a text is blank. A key
    holds the characters themselves, 16 bits each, so different n-grams of such characters never meet.
    """
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _folded()[codes]
    keep = folded > 0
    keep[1:] |= folded[:-1] > 0
    doc = np.repeat(np.arange(len(texts)), sizes)[keep]
    chars = folded[keep].astype(np.uint64)
    lengths = np.bincount(doc, minlength=len(texts))
    letters = np.bincount(doc[chars > 0], minlength=len(texts))
    place = np.arange(len(doc)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys = chars.copy()
    for back in range(1, ORDER):
        before = np.zeros(len(chars), np.uint64)
        before[back:] = chars[:-back]
        before[place < back] = 0
        keys |= before << np.uint64(16 * back)
    return keys, lengths, letters


class _Count:
    """(language, key, count) of the n-grams of a task's documents."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            by: dict[str, list[str]] = {}
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                by.setdefault(label, []).append(text or "")
            for label, texts in by.items():
                held.setdefault(label, []).append(np.unique(ngrams(texts)[0], return_counts=True))
        for label, parts in sorted(held.items()):
            keys, places = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(places, np.concatenate([n for _, n in parts])).astype(np.int64)
            for a in range(0, len(keys), 100_000):
                part = keys[a : a + 100_000]
                columns = [pa.array([label] * len(part), pa.string()), pa.array(part.view(np.int64)), pa.array(counts[a : a + 100_000])]
                yield pa.RecordBatch.from_arrays(columns, ["label", "key", "n"])


def letters_of(counts: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Number of different characters in n-gram counts."""
    return len(np.unique(np.concatenate([np.unique(keys & np.uint64(0xFFFF)) for keys, _ in counts])))


class Models:
    """Models of some languages in common sorted arrays: a row of probabilities for each n-gram any of them has seen."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]], alphabet: int | None = None):
        """``counts`` has (n-gram keys, counts) of each language, ``alphabet`` the characters of all languages."""
        self.keys, self.probabilities, self.contexts, self.weights = {}, {}, {}, {}
        own = {ORDER: counts}
        for order in range(ORDER - 1, 0, -1):
            mask = np.uint64((1 << 16 * order) - 1)
            own[order] = [np.unique(keys & mask, return_counts=True) for keys, _ in own[order + 1]]  # continuations
        self.blank = 1 / (1 + (letters_of(counts) if alphabet is None else alphabet))
        for order in range(1, ORDER + 1):
            self._add(order, own[order])
        self.logs = np.log(self.probabilities[ORDER]).astype(np.float32)

    def _add(self, order: int, own: list[tuple[np.ndarray, np.ndarray]]) -> None:
        keys = np.unique(np.concatenate([k for k, _ in own]))
        contexts = np.unique(keys >> _CHAR)
        seen, weights = np.zeros((len(keys), len(own))), np.ones((len(contexts), len(own)))
        for k, (mine, n) in enumerate(own):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
            of = np.searchsorted(contexts, mine >> _CHAR)
            total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts))
            weights[:, k] = np.where(total > 0, discount * distinct / np.maximum(total, 1), 1.0)
            seen[np.searchsorted(keys, mine), k] = (n - discount) / total[of]
        self.contexts[order], self.weights[order] = contexts, weights
        lower = self.of(order - 1, keys & np.uint64((1 << 16 * (order - 1)) - 1))
        self.keys[order] = keys
        self.probabilities[order] = seen + weights[np.searchsorted(contexts, keys >> _CHAR)] * lower

    def of(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Probabilities of n-grams in all languages, by binary search; unseen ones by their shorter ends."""
        if not order:
            return np.full((len(keys), 1), self.blank)
        at = np.minimum(np.searchsorted(self.keys[order], keys), len(self.keys[order]) - 1)
        out = self.probabilities[order][at]
        missed = np.flatnonzero(self.keys[order][at] != keys)
        if len(missed):
            rest = keys[missed]
            context = np.minimum(np.searchsorted(self.contexts[order], rest >> _CHAR), len(self.contexts[order]) - 1)
            known = self.contexts[order][context] == rest >> _CHAR
            weight = np.where(known[:, None], self.weights[order][context], 1.0)
            out[missed] = weight * self.of(order - 1, rest & np.uint64((1 << 16 * (order - 1)) - 1))
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cross-entropy per character in every language, characters, letters) of each text."""
        keys, lengths, letters = ngrams(texts)
        at = np.minimum(np.searchsorted(self.keys[ORDER], keys), len(self.keys[ORDER]) - 1)
        logs = self.logs[at]
        missed = np.flatnonzero(self.keys[ORDER][at] != keys)
        if len(missed):
            logs[missed] = np.log(self.of(ORDER, keys[missed]))
        sums = np.zeros((len(texts), logs.shape[1]))
        full = np.flatnonzero(lengths)
        if len(full):
            sums[full] = np.add.reduceat(logs, (np.cumsum(lengths) - lengths)[full], axis=0, dtype=np.float64)
        return -sums / np.maximum(lengths, 1)[:, None], lengths, letters


def _confidence(entropies: np.ndarray, lengths: np.ndarray, sharpness: float) -> np.ndarray:
    logits = -entropies * np.sqrt(lengths)[:, None] * sharpness
    odds = np.exp(logits - logits.max(axis=1, keepdims=True))
    return odds.max(axis=1) / odds.sum(axis=1)


class _Identify:
    def __init__(self, languages: list[str], models: list[Models], sharpness: float = 1.0, limit: float = np.inf):
        self.languages, self.models, self.sharpness, self.limit = languages, models, sharpness, limit

    def _entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropies in all languages, table by table."""
        parts = [m.entropies(texts) for m in self.models]
        return np.concatenate([p[0] for p in parts], axis=1), parts[0][1], parts[0][2]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            kept = [n for n in batch.schema.names if n != "text"]
            for a, b in pieces([len(t) for t in texts], _PIECE):
                entropies, lengths, letters = self._entropies(texts[a:b])
                best, least = entropies.argmin(axis=1), entropies.min(axis=1)
                score = np.where(letters > 0, _confidence(entropies, np.maximum(lengths, 1), self.sharpness), 0.0)
                found = [self.languages[k] if n else UNKNOWN for k, n in zip(best.tolist(), letters.tolist())]
                accepted = (least <= self.limit) & (letters > 0)
                columns = [*(batch.column(n).slice(a, b - a) for n in kept), pa.array(found), pa.array(score), pa.array(least), pa.array(lengths), pa.array(accepted)]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "lang_pred", "score", "entropy", "length", "accepted"])


_FOUND = "lang_pred string, score double, entropy double, length long, accepted boolean"


def _fit(docs: DataFrame, train: Column, rows: int) -> _Identify | None:
    known = docs.where(F.col("lang").isNotNull() & train).select("doc_id", F.col("lang").alias("label"))
    sizes = known.groupBy("label").count().orderBy("label").collect()
    if not sizes:
        return None
    each = max(EACH, min(rows, ALL_ROWS // len(sizes)))
    share = F.create_map(*chain(*((F.lit(r.label), F.lit(each / r["count"])) for r in sizes)))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    # twice the share by a hash, so that a small language's documents are not left to chance; then exactly the first ones
    even = known.where(place < 2 * share[F.col("label")]).select("doc_id", "label", place.alias("place")).distinct()
    turn = F.row_number().over(Window.partitionBy("label").orderBy("place", "doc_id"))
    chosen = even.withColumn("turn", turn).where(F.col("turn") <= each)
    chosen = chosen.select("doc_id", "label", ((F.col("turn") > 1) & (F.col("turn") % CHECK == 0)).alias("check"))
    sample = docs.where(train).select("doc_id", "text", F.col("lang").alias("label")).join(F.broadcast(chosen), ["doc_id", "label"])
    sample = saved(spread(sample.select("text", "label", "check")), "languages")
    learn = sample.where("not check").select("text", "label")
    counted = learn.mapInArrow(_Count(), "label string, key long, n long").groupBy("label", "key").agg(F.sum("n").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("key", "n")))
    packed = counted.groupBy("label").agg(listed.alias("grams")).select("label", "grams.key", "grams.n").orderBy("label")
    languages, counts = [], []
    for batch in packed.toArrow().to_batches():
        for label, keys, n in zip(batch.column("label").to_pylist(), batch.column("key"), batch.column("n")):
            keys, n = (x.values.to_numpy(zero_copy_only=False) for x in (keys, n))
            order = np.argsort(keys.view(np.uint64))
            languages.append(label)
            counts.append((keys.view(np.uint64)[order], n[order]))
    if not languages:
        return None
    alphabet = letters_of(counts)
    tables = [Models(counts[a : a + TABLE], alphabet) for a in range(0, len(counts), TABLE)]
    sample = sample.where("check").select("text", "label")
    plain = _Identify(languages, tables)
    check = sample.mapInArrow(plain, f"label string, {_FOUND}").select("label", "lang_pred", "score", "entropy", "length").where("length > 0")
    seen = check.select("length", "entropy", (F.col("label") == F.col("lang_pred")).cast("int").alias("right"), "score").toPandas()
    if not len(seen):
        return plain
    # The softmax of two scores sharpens as a power of their odds, so the sharpness can be fitted on the stored odds.
    odds = np.log(np.clip(seen["score"], 1e-9, 1 - 1e-9) / np.clip(1 - seen["score"], 1e-9, 1))
    losses = []
    grid = np.geomspace(0.1, 30, 40)
    for sharpness in grid:
        p = np.clip(1 / (1 + np.exp(-sharpness * odds)), 1e-6, 1 - 1e-6)
        losses.append(-(np.log(p) * seen["right"] + np.log(1 - p) * (1 - seen["right"])).mean())
    return _Identify(languages, plain.models, float(grid[int(np.argmin(losses))]), float(seen["entropy"].quantile(ACCEPT)))


def identify(docs: DataFrame, train: Column | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, lang_pred, score and accepted of every whole text.

    The language is the one with the least cross-entropy per character; ``score`` is its calibrated share. A text is
    ``accepted`` if its cross-entropy is one that ``ACCEPT`` of the documents kept for the calibration stay below: others
    are in none of the languages. The models are fitted on all n-grams of at most ``rows`` documents of each language
    (and about ``ALL_ROWS`` of all, evenly, though ``EACH`` of each), chosen by a hash of the id, of those that ``train``
    allows; only their ids are broadcast. One in ``CHECK`` of these is kept for the calibration. Every language that has
    a training document has a model.

    A null text, or one without letters, is ``und`` with score 0 and not accepted; so is every text if nothing can be
    learnt. Null ids and repeated rows are judged by their text as any other. Ties go to the first language by name.
    """
    allowed = F.lit(True) if train is None else train
    model = _fit(docs, allowed, rows)
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(False).alias("accepted"))
    found = spread(docs.select("doc_id", "text")).mapInArrow(model, f"doc_id long, {_FOUND}")
    return found.select("doc_id", "lang_pred", "score", "accepted")


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and accepted; languages are learnt from remainders other than 0 modulo 5."""
    held_out = remainder("doc_id", 5) == 0
    found = identify(docs, ~held_out)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")
