"""Many stored specs against a catalog in one pass: an index of their distinct leaves, and trees over bit sets.

Thousands of specs share few columns. Their distinct leaves are numbered: bounds of a column stand in one array, phrases
in one automaton. For a run of assets every leaf gives two sets of bits, where it holds and where it does not; an asset
with an unknown value is in neither, as in SQL. A spec is then a few operations on whole sets, done once for specs that
say the same. What all of a spec's matches add up to is read off these sets, too, without a row for each match. The plan
has the same size whatever the number of specs of a block.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.constants import MEDIA_TYPES, UNSUPPORTED_ENTITIES, UNSUPPORTED_EXCLUSIONS
from lumenlake.functions.text import token_string
from lumenlake.operators.specs import Catalog, Spec, check_limits, field_value, leaves, wide_catalog
from lumenlake.registry import UnsupportedQuery
from lumenlake.session import cut_lineage

BLOCK_SPECS = 10_000
#: Rows whose bits are held at once, at most, and bits of all leaves together; matches in one Arrow batch.
_RUN, _HELD_BITS, _MATCHES = 4096, 1 << 23, 1 << 16
#: Assets matched in one task, at most about.
_PIECE = 16_384
#: Lists of terms whose bits a stored row holds, at most about: blocks that ask for more get tables of their own.
_LISTS = 4096
#: Trees whose sets are added up at once.
_TREES = 1024
#: Sums whose terms may add up to more are taken from whole numbers of any size, so that none wraps.
_EXACT = 1 << 62
Bits = tuple[np.ndarray, np.ndarray]
Leaf = tuple[str, str, object]

# fixed values: the test and column behind a capability's field
NUMBERS = {
    ("query.date", "before"): ("less", "created_at"),
    ("query.date", "after"): ("greater", "created_at"),
    ("metadata.core", "minFileSize"): ("at least", "file_size"),
    ("quality.visual", "maxQuality"): ("at most", "quality_score"),
    ("quality.visual", "minBlur"): ("at least", "blur_score"),
}
FLAGS = {
    "content.screenshot": "is_screenshot",
    "content.document": "has_text",
    "duplicate.exact": "in_duplicate",
    "similarity.perceptual": "in_similar",
}
_COMPARE = {"less": np.less, "greater": np.greater, "at least": np.greater_equal, "at most": np.less_equal}


def leaf_test(leaf: Spec) -> Leaf:
    """(test, column, value) of a leaf; leaves that no column answers are refused."""
    capability, (field, value) = leaf["capability"], field_value(leaf)
    if field in UNSUPPORTED_EXCLUSIONS or field in UNSUPPORTED_ENTITIES:
        raise UnsupportedQuery(field)
    if (capability, field) in NUMBERS and isinstance(value, int | float) and not isinstance(value, bool):
        return (*NUMBERS[capability, field], float(value))
    if capability in FLAGS and isinstance(value, bool):
        return "flag", FLAGS[capability], value
    if capability == "metadata.core" and field in ("favorite", "favorites") and isinstance(value, bool):
        return "equal", "favorite", value
    if capability == "metadata.core" and field == "mediaTypes" and isinstance(value, list):
        if all(v in MEDIA_TYPES for v in value):
            return "in", "media_type", tuple(sorted(value))
    if capability == "text.ocr" and field == "ocrTerms" and isinstance(value, list) and value:
        if all(isinstance(v, str) for v in value):
            return "text", "ocr_text", tuple(sorted(set(value)))
    raise UnsupportedQuery(f"{capability}:{field}")


class SpecIndex:
    """Distinct leaves and the trees over them. Specs that can't be read or run are left out, and match nothing."""

    def __init__(self, rows: list[tuple[object, str | None]]):
        self.keys: list = []
        self.trees: list = []  # distinct ones
        self.tree_of: list[int] = []  # for each key
        self.capabilities: set[str] = set()
        self.leaves: dict[Leaf, int] = {}
        numbers: dict[tuple, int] = {}
        for key, text in rows:
            try:
                spec = json.loads(text)
                check_limits(spec)
                found = {id(leaf): leaf_test(leaf) for leaf in leaves(spec)}
                tree = self._tree(spec, found)
            except (TypeError, ValueError, KeyError, AttributeError, IndexError):
                continue
            self.keys.append(key)
            self.tree_of.append(numbers.setdefault(tree, len(numbers)))
            self.capabilities.update(leaf["capability"] for leaf in leaves(spec))
        self.trees = list(numbers)
        # the term lists that a row has bits for, which may be more than those of the leaves
        self.texts = [leaf for leaf in self.leaves if leaf[0] == "text"]

    def _tree(self, node: Spec, found: dict[int, Leaf]) -> tuple:
        if node["type"] == "predicate":
            return "leaf", self.leaves.setdefault(found[id(node)], len(self.leaves))
        if node["type"] == "not":
            return "not", self._tree(node["child"], found)
        if node["type"] not in ("and", "or"):
            raise ValueError(node["type"])
        return node["type"], tuple(self._tree(child, found) for child in node["children"])

    def _values(self, batch: pa.RecordBatch, test: str, column: str) -> tuple[np.ndarray, np.ndarray]:
        """(values, known) of a column; a number that is none counts as the largest."""
        values = batch.column(column)
        known = values.is_valid().to_numpy(zero_copy_only=False)
        if test == "in":
            return np.array(values.to_pylist(), object), known
        kind, fill = (pa.bool_(), False) if test in ("equal", "flag") else (pa.float64(), 0.0)
        plain = values.cast(kind).fill_null(fill).to_numpy(zero_copy_only=False)
        return (np.where(np.isnan(plain), np.inf, plain) if kind == pa.float64() else plain), known

    def bits(self, batch: pa.RecordBatch) -> list[Bits]:
        """For each leaf the packed sets of rows where it holds, and where it does not."""
        out: list[Bits | None] = [None] * len(self.leaves)
        groups: dict[tuple[str, str], list[tuple[object, int]]] = {}
        for (test, column, value), number in self.leaves.items():
            groups.setdefault((test, column), []).append((value, number))
        for (test, column), listed in groups.items():
            numbers = [n for _, n in listed]
            if test == "text":
                # bit sets by row, in the order of ``texts``
                width = len(self.texts)
                rows = [np.frombuffer(b, np.uint8) if b is not None else np.zeros(-(-width // 8), np.uint8) for b in batch.column("_texts").to_pylist()]
                holds = np.unpackbits(np.stack(rows), axis=1, count=width).T.astype(bool)
                known = np.ones(batch.num_rows, bool)
                asked = [k for k, leaf in enumerate(self.texts) if leaf in self.leaves]
                holds, numbers = holds[asked], [self.leaves[self.texts[k]] for k in asked]
            else:
                values, known = self._values(batch, test, column)
                if test == "flag":
                    known = np.ones(len(values), bool)
                if test in _COMPARE:
                    bounds = np.array([v for v, _ in listed], float)
                    holds = _COMPARE[test](values[None, :], bounds[:, None])
                elif test == "in":
                    holds = np.stack([np.isin(values, list(v)) if v else np.zeros(len(values), bool) for v, _ in listed])
                    known = known | ~np.array([bool(v) for v, _ in listed])[:, None]
                else:
                    holds = np.stack([values == v for v, _ in listed])
            yes, no = np.packbits(holds & known, axis=1), np.packbits(~holds & known, axis=1)
            for k, number in enumerate(numbers):
                out[number] = yes[k], no[k]
        return out  # type: ignore[return-value]

    def match(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """For each distinct tree the packed set of rows it matches."""
        bits, rows = self.bits(batch), batch.num_rows
        every, none = np.packbits(np.ones(rows, bool)), np.packbits(np.zeros(rows, bool))

        def of(tree: tuple) -> Bits:
            kind, inner = tree
            if kind == "leaf":
                return bits[inner]
            if kind == "not":
                yes, no = of(inner)
                return no, yes
            parts = [of(child) for child in inner]
            if kind == "and":
                return reduce(lambda a, b: (a[0] & b[0], a[1] | b[1]), parts, (every, none))
            return reduce(lambda a, b: (a[0] | b[0], a[1] & b[1]), parts, (none, every))

        for tree in self.trees:
            yield of(tree)[0]


class _Texts:
    """(id, has_text, _texts): which term lists of the index a text holds, as bits."""

    def __init__(self, term_lists: list[tuple[str, ...]], phrases: dict[str, str]):
        self.term_lists, self.phrases = term_lists, phrases

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        wanted = [{self.phrases[t] for t in terms} for terms in self.term_lists]
        lists_of: dict[str, list[int]] = {}
        for k, phrases in enumerate(wanted):
            for phrase in phrases:
                lists_of.setdefault(phrase, []).append(k)
        for phrase in lists_of:
            if phrase.strip():
                automaton.add_word(phrase, phrase)
        automaton.make_automaton()
        for batch in batches:
            out = []
            for text in batch.column("padded").to_pylist():
                seen = {p for _, p in automaton.iter(text)} if text and len(automaton) else set()
                flags = np.zeros(len(wanted), bool)
                for k in {k for phrase in seen for k in lists_of[phrase]}:
                    flags[k] = wanted[k] <= seen
                out.append(np.packbits(flags).tobytes())
            columns = [batch.column("id"), batch.column("has_text"), pa.array(out, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "has_text", "_texts"])


class _Match:
    """Rows (spec_id, columns) of the matches, or (spec_id, found) with the matches of a spec in a run of assets as one list."""

    def __init__(self, index: SpecIndex, kind: pa.DataType, columns: list[str], lists: bool):
        self.index, self.kind, self.columns, self.lists = index, kind, columns, lists

    def run_rows(self) -> int:
        return max(8, min(_RUN, _HELD_BITS // max(1, len(self.index.leaves) + len(self.index.texts))))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = pa.array(self.index.keys, self.kind)
        rows = self.run_rows()
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                run = batch.slice(a, rows)
                sets = list(self.index.match(run))
                held, size = [], 0
                for number, tree in enumerate(self.index.tree_of):
                    found = np.flatnonzero(np.unpackbits(sets[tree], count=run.num_rows))
                    if len(found):
                        held.append((number, found))
                        size += len(found)
                    if size >= _MATCHES:
                        yield self._batch(keys, run, held)
                        held, size = [], 0
                if held:
                    yield self._batch(keys, run, held)

    def _batch(self, keys: pa.Array, run: pa.RecordBatch, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        numbers, sizes = np.array([n for n, _ in held]), np.array([len(f) for _, f in held])
        rows = pa.array(np.concatenate([f for _, f in held]))
        told = [run.column(name).take(rows) for name in self.columns]
        if not self.lists:
            return pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(numbers, sizes))), *told], ["spec_id", *self.columns])
        ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        found = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(told, self.columns))
        return pa.RecordBatch.from_arrays([keys.take(pa.array(numbers)), found], ["spec_id", "found"])


#: Place of the first and the last bit of a byte that is set.
_FIRST = np.array([8 - k.bit_length() for k in range(256)])
_LAST = np.array([7 - ((k & -k).bit_length() - 1) for k in range(256)])
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


class _Totals(_Match):
    """Rows (spec_id, first_id, last_id, columns): for each spec its smallest and largest id and sums over all its matches in a task.

    The rows of a task, a bounded number, are sorted by id: the first bit of a set is the smallest id, and sums come from
    a table of the sums of every eight rows.
    """

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := [b for b in batches if b.num_rows]):
            return
        table = pa.Table.from_batches(held).sort_by("id").combine_chunks()
        rows, trees = self.run_rows(), len(self.index.trees)
        first, last = np.full(trees, -1), np.full(trees, -1)
        values = [self._plain(table.column(name)) for name in self.columns]
        sums = [np.zeros(trees, v.dtype) for v in values]
        for at in range(0, table.num_rows, rows):
            [run] = table.slice(at, rows).combine_chunks().to_batches()
            tables = [self._eights(v[at : at + rows]) for v in values]
            sets = self.index.match(run)
            for a in range(0, trees, _TREES):
                them = slice(a, min(a + _TREES, trees))
                bits = np.stack([next(sets) for _ in range(a, them.stop)])
                met, place = bits.any(axis=1), np.arange(len(bits))
                low = (bits != 0).argmax(axis=1)
                high = bits.shape[1] - 1 - (bits[:, ::-1] != 0).argmax(axis=1)
                first[them] = np.where(met & (first[them] < 0), at + 8 * low + _FIRST[bits[place, low]], first[them])
                last[them] = np.where(met, at + 8 * high + _LAST[bits[place, high]], last[them])
                for k, eights in enumerate(tables):
                    sums[k][them] += eights[np.arange(bits.shape[1]), bits].sum(axis=1)
        of = np.array(self.index.tree_of, np.int64)
        found = np.flatnonzero(first[of] >= 0) if len(of) else of
        ids, keys = table.column("id").combine_chunks(), pa.array(self.index.keys, self.kind)
        for a in range(0, len(found), _MATCHES):
            some = found[a : a + _MATCHES]
            ends = [ids.take(pa.array(x[of[some]])) for x in (first, last)]
            told = [pa.array(x[of[some]], pa.int64()) for x in sums]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(some)), *ends, *told], ["spec_id", "first_id", "last_id", *self.columns])

    @staticmethod
    def _plain(values: pa.ChunkedArray) -> np.ndarray:
        """The values of a column; a null counts nothing."""
        plain = values.cast(pa.int64()).fill_null(0).to_numpy()
        return plain if np.abs(plain.astype(float)).sum() < _EXACT else plain.astype(object)

    @staticmethod
    def _eights(values: np.ndarray) -> np.ndarray:
        """For every eight rows the sum of each choice of them."""
        padded = np.zeros(-(-len(values) // 8) * 8, values.dtype)
        padded[: len(values)] = values
        return padded.reshape(-1, 8) @ _BYTE_BITS.T


def _slim(catalog: Catalog, indexes: list[SpecIndex], told: DataFrame | None) -> DataFrame:
    """What the leaves of some blocks ask for, and ``told``: one row for each asset, texts as bits."""
    spark = catalog.assets.sparkSession
    capabilities = {c for index in indexes for c in index.capabilities}
    lists = list(dict.fromkeys(leaf for index in indexes for leaf in index.texts))
    for index in indexes:
        index.texts = lists
    plain = [{"type": "predicate", "capability": c, "operator": "eq", "value": None} for c in capabilities - {"text.ocr", "content.document"}]
    wide = wide_catalog(catalog, plain)
    if capabilities & {"text.ocr", "content.document"}:
        terms = sorted({t for _, _, listed in lists for t in listed})
        folded = spark.createDataFrame([(t,) for t in terms], "term string").select("term", token_string(F.col("term")))
        phrases = {r[0]: r[1] for r in folded.collect()}
        marks = _Texts([listed for _, _, listed in lists], phrases)
        readable = F.coalesce(F.length(F.trim("ocr_text")) > 0, F.lit(False))
        padded = token_string(F.col("ocr_text")) if terms else F.lit(None).cast("string")
        texts = catalog.texts.select("id", readable.alias("has_text"), padded.alias("padded"))
        wide = wide.join(texts.mapInArrow(marks, "id string, has_text boolean, _texts binary"), "id", "left")
    columns = {column for index in indexes for test, column, _ in index.leaves if test != "text"} | ({"_texts"} if lists else set())
    slim = wide.select("id", *sorted(columns))
    return slim if told is None else slim.join(told, "id")


def _matched(slim: DataFrame, index: SpecIndex, key_type: str, carried: list[str], lists: bool, totals: list[str] | None) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kind, types = to_arrow_type(_parse_datatype_string(key_type)), dict(slim.dtypes)
    if totals is not None:
        schema = f"spec_id {key_type}, first_id {types['id']}, last_id {types['id']}" + "".join(f", `{c}` long" for c in totals)
        return slim.mapInArrow(_Totals(index, kind, totals, False), schema)
    fields = ", ".join(f"`{c}` {types[c]}" for c in carried)
    schema = f"spec_id {key_type}, found array<struct<{fields.replace('` ', '`:')}>>" if lists else f"spec_id {key_type}, {fields}"
    return slim.mapInArrow(_Match(index, kind, carried, lists), schema)


def _indexes(specs: DataFrame, key: str, spec: str, block_specs: int) -> Iterator[SpecIndex]:
    """The index of each block of specs; the driver is sent one block at a time."""
    blocks = max(1, math.ceil(specs.count() / block_specs))
    held: list[tuple[object, str | None]] = []
    for row in specs.select(key, spec).repartition(blocks).toLocalIterator():
        held.append((row[0], row[1]))
        if len(held) == block_specs:
            yield SpecIndex(held)
            held = []
    yield SpecIndex(held)


def bulk_match_many(
    catalog: Catalog,
    specs: DataFrame,
    key: str = "spec_id",
    spec: str = "spec",
    block_specs: int = BLOCK_SPECS,
    told: DataFrame | None = None,
    lists: bool = False,
    totals: list[str] | None = None,
) -> DataFrame:
    """(spec_id, id) of all assets that match the stored specs (JSON text) of a table.

    Specs are a query set: blocks of ``block_specs`` of them are indexed one at a time. Texts are reduced to bits before
    they are joined. If there are several blocks, what their leaves ask for is stored, and each block is one pass over
    that; the texts and tables of the catalog are read again only for every ``_LISTS`` lists of terms, about. A spec that can't be read, is too complex or
    asks for what no table answers matches nothing; ``spec_coverage`` says which. An empty AND matches every asset.

    Matches are many more rows than specs or assets. ``told``, a table with an id, is joined to the assets before the
    match, so that its columns come with the rows that a join of the result would have, and no match is shuffled; its
    names must not be those of the catalog. With ``lists`` a row is (spec_id, found): the matches of a spec among a run
    of assets as an array of structs. With ``totals``, integer columns of ``told``, a row is (spec_id, first_id, last_id,
    these columns): the smallest and largest id and the sums over all matches of a spec among the assets of a task, so
    that they can be added up without a row or an element for each match; nulls count nothing. A task holds a bounded
    number of bits and of matches, whatever matches.
    """
    key_type = dict(specs.dtypes)[key]
    slots = specs.sparkSession.sparkContext.defaultParallelism
    pieces = max(slots, math.ceil(catalog.assets.count() / _PIECE))
    carried = ["id", *([c for c in told.columns if c != "id"] if told is not None else [])]
    groups: list[list[SpecIndex]] = [[]]
    asked: set[Leaf] = set()
    for index in _indexes(specs, key, spec, block_specs):
        if not index.trees and groups[0]:
            continue
        if groups[-1] and len(asked | set(index.texts)) > _LISTS:
            groups.append([])
            asked = set()
        groups[-1].append(index)
        asked |= set(index.texts)
    parts = []
    for indexes in groups:
        slim = _slim(catalog, indexes, told).repartition(pieces)
        if len(indexes) > 1:
            slim = cut_lineage(slim)
        parts += [_matched(slim, index, key_type, carried, lists, totals) for index in indexes]
    return reduce(DataFrame.unionByName, parts)
