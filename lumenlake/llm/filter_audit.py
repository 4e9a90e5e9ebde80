"""What each filter of a chain removes, in every order: count-weighted decision diagrams of failure masks.

A part's documents are counted by the set of filters they fail. The diagram of a part tests one filter a level; its
leaves are counts. Walking through all orders by swaps of adjacent levels rewrites two levels a step, and the path on
which every filter passes gives the steps of the order: what leaves the path at a level is what that filter removes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


FILTERS = "ABCDE"
_SPACE = r"[\x20\x09-\x0D]+"
STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long,"
    " good_lost long, toxic_lost long, shapley long"
)


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next one, one after the other, so that every order of n comes up once."""
    if n < 2:
        return
    down = list(range(n - 2, -1, -1))
    runs = itertools.cycle((down, down[::-1]))
    yield from next(runs)
    for turn, level in enumerate(adjacent_swaps(n - 1)):
        yield level + 1 if turn % 2 == 0 else level  # the last one stands in front after every other run
        yield from next(runs)


Weights = tuple[int, ...]


class Diagram:
    """Levels of nodes (passes, fails), each an index of the next level; the last indexes are leaves, which are counts."""

    def __init__(self, counts: dict[int, Weights], filters: int, width: int):
        self.order = list(range(filters))
        self.leaves: list[Weights] = []
        self.levels: list[list[tuple[int, int]]] = [[] for _ in self.order]
        leaf_of: dict[Weights, int] = {}
        node_of: list[dict[tuple[int, int], int]] = [{} for _ in self.order]
        zero = (0,) * width

        def build(level: int, mask: int) -> int:
            if level == filters:
                weights = counts.get(mask, zero)
                if weights not in leaf_of:
                    leaf_of[weights] = len(self.leaves)
                    self.leaves.append(weights)
                return leaf_of[weights]
            node = build(level + 1, mask), build(level + 1, mask | 1 << level)
            if node not in node_of[level]:
                node_of[level][node] = len(self.levels[level])
                self.levels[level].append(node)
            return node_of[level][node]

        build(0, 0)
        self.totals: list[list[Weights]] = [*[[] for _ in self.order], self.leaves]
        for level in reversed(range(filters)):
            self._add_up(level)

    def _add_up(self, level: int) -> None:
        below = self.totals[level + 1]
        self.totals[level] = [tuple(a + b for a, b in zip(below[p], below[f])) for p, f in self.levels[level]]

    def swap(self, level: int) -> None:
        """Exchange a level with the next one; no other level changes."""
        below, found, nodes = self.levels[level + 1], {}, []

        def node(passes: int, fails: int) -> int:
            if (passes, fails) not in found:
                found[passes, fails] = len(nodes)
                nodes.append((passes, fails))
            return found[passes, fails]

        for k, (passes, fails) in enumerate(self.levels[level]):
            (pp, pf), (fp, ff) = below[passes], below[fails]
            self.levels[level][k] = node(pp, fp), node(pf, ff)
        self.levels[level + 1] = nodes
        self._add_up(level + 1)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> Iterator[tuple[int, Weights, Weights]]:
        """(filter, weights it removes, weights left) along the path on which every filter passes."""
        at = 0
        for level, variable in enumerate(self.order):
            at, fails = self.levels[level][at]
            yield variable, self.totals[level + 1][fails], self.totals[level + 1][at]


def steps_of(counts: dict[int, Weights], names: str) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step.

    ``counts`` has (documents, good ones, toxic ones) for each mask of failed filters.
    """
    n = len(names)
    diagram = Diagram(counts, n, 3)
    paths = [(tuple(diagram.order), list(diagram.all_pass()))]
    for level in adjacent_swaps(n):
        diagram.swap(level)
        paths.append((tuple(diagram.order), list(diagram.all_pass())))
    fails, alone, shapley = [0] * n, [0] * n, [0] * n
    for order, path in paths:
        fails[order[0]], alone[order[-1]] = path[0][1][0], path[-1][1][0]
        for variable, removed, _ in path:
            shapley[variable] += removed[0]
    for order, path in paths:
        name = "".join(names[v] for v in order)
        for step, (v, removed, kept) in enumerate(path, 1):
            yield name, step, kept[0], removed[0], fails[v] - removed[0], alone[v], removed[1], removed[2], shapley[v]


def _audit_part(table: pa.Table, names: str) -> pa.Table:
    counts: dict[int, list[int]] = {}
    for row in table.to_pylist():
        total = counts.setdefault(row["fails"], [0, 0, 0])
        for k, add in enumerate((row["n"], row["n"] * row["good"], row["n"] * row["toxic"])):
            total[k] += add
    part = table.column("part")[0].as_py()
    rows = [(part, *r) for r in steps_of({m: tuple(w) for m, w in counts.items()}, names)]
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * 7]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[f.split()[0] for f in STEPS.split(", ")])


def audit(counts: DataFrame, names: str = FILTERS) -> DataFrame:
    """Every step of every order of the filters, for each part.

    ``counts`` has part, fails (bit k: fails filter k), good and toxic (0 or 1) and n; rows may repeat a mask. They are
    added up first, so a part is at most 4 x 2^filters rows, whatever its documents. No rows give no rows.
    """
    keys = ["part", "fails", "good", "toxic"]
    added = counts.groupBy(*keys).agg(F.sum("n").alias("n"))
    return added.groupBy("part").applyInArrow(lambda table: _audit_part(table, names), STEPS)


def failures(text: Column) -> Column:
    """Bits of the filters A to D that a text (not null) fails."""
    words = F.array_remove(F.split(text, _SPACE), "")
    n = F.size(words)
    tests = [
        n < 200,
        100 * F.size(F.array_distinct(words)) < 50 * n,
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.char_length(text),
        text.rlike("[#$%&*|]"),
    ]
    return sum((t.cast("int") * (1 << k) for k, t in enumerate(tests)), F.lit(0))


def count_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents by part, failed filters, and labels: the counts that ``audit`` takes.

    A: under 200 words; B: under half of the words are distinct; C: over 3 % capitals A-Z; D: a mark out of #$%&*|;
    E: the same text as a document with a smaller doc_id, anywhere in the table. Texts are the same if their MD5 is.
    A null text is the empty text, a null lang the part of the empty name. A document is good if any of its labels has
    quality 1, toxic if any has toxic 1. A null doc_id is neither smaller nor larger than another, and has no labels;
    rows that repeat a doc_id and text are equal, none fails E for the other.

    Copies are added up before they meet: rows of the same text, part, mask and labels become one row that knows its
    least id, so a group of copies of any size is at most four rows a part.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("lang"), F.lit("")).alias("part"),
        F.unhex(F.md5(text.cast("binary"))).alias("digest"),
        failures(text).alias("fails"),
    )
    same = slim.groupBy("doc_id", "part", "digest", "fails").agg(F.count(F.lit(1)).alias("n"))
    flags = [F.max((F.col(c) == 1).cast("int")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*flags)
    marked = same.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    keys = ["digest", "part", "fails", "good", "toxic"]
    first = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    nameless = F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)
    groups = marked.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(first).alias("first"), F.sum(nameless).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    owners = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = groups.withColumn("least", least).withColumn("unique", owners + F.col("nameless"))
    bit = 1 << FILTERS.index("E")
    cases = F.array(
        F.struct(F.col("fails").alias("fails"), F.col("unique").alias("n")),
        F.struct((F.col("fails") + bit).alias("fails"), (F.col("n") - F.col("unique")).alias("n")),
    )
    exploded = split.select("part", "good", "toxic", F.explode(cases).alias("case"))
    return exploded.select("part", "case.fails", "good", "toxic", "case.n").where("n > 0")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents; see ``count_failures`` and ``audit``."""
    return audit(count_failures(docs, labels))
