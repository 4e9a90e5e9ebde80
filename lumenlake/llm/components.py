"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.plans.skew import by_key
from lumenlake.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang the larger neighbours of every node on the smallest node next to it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(by_key(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of them. Edges run from the larger end ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(by_key(least), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable from every node that has an edge.

    ``edges`` has two long columns ``a`` and ``b``. Minima are combined before each shuffle and joined back, so a
    star with very many leaves is no single hot task (adaptive execution splits its join), and neither side is
    broadcast, as the size of a graph is not known before. Every round is checkpointed; the number of rounds grows with the logarithm of the graph, and stops when nothing changes.
    """
    now = cut_lineage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    seen = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        now = cut_lineage(_small_star(_large_star(now)))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
