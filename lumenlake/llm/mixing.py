"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

The documents of a source queue in a shuffled order, turn after turn. The virtual finish time of a turn is the words of
its source up to its end, divided by the source's target; the turn in which the target lies is two packets, one up to
the target and the rest. All packets, range-sorted by this time, are the mix, and it ends where their running total
reaches the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.common import free_name, numbered, saved, word_count
from lumenlake.plans.ordering import ordered_totals, row_numbers
from lumenlake.plans.skew import join_lookup

WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3


def _key(source: Column) -> Column:
    """A source as a key that is never null; the null source is a source too."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """One row for each source: its key, rank, rows, words, weight and target.

    Sources in code point order (null last) get the weights in turn. They share the words of all sources by weight;
    a target stops at ``repeats`` times its source, and the rest is shared again by weight. Filling the sources in
    the order of (limit / weight) gives the same level as repeating the sharing until none is above its limit. Ranks
    and sums over sources come from range-partitioned slices, so there may be any number of them.
    """
    totals = sizes.groupBy("key").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    ranked = row_numbers(totals, [F.col("source").asc_nulls_last()], "rank")
    given = ranked.withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")),
            "limit": F.col("source_size") * repeats,
        }
    )
    full_at = F.col("limit") / F.col("weight")
    running = {"limit_sum": F.col("limit"), "weight_sum": F.col("weight").cast("long")}
    filled = saved(ordered_totals(given, [full_at, F.col("rank")], running), "filled")
    words, shares = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return filled.select("key", "rank", "n", "source_size", "weight", F.lit(0.0).alias("target"))
    level = (F.lit(words) - F.col("limit_sum") + F.col("limit")) / (F.lit(shares) - F.col("weight_sum") + F.col("weight"))
    levels = filled.withColumn("level", level).where(F.col("level") < full_at)
    [first_open] = levels.agg(F.min_by("level", F.struct(full_at, "rank"))).first()
    # without an open source all are full
    target = F.col("limit").cast("double") if first_open is None else F.least(F.col("limit").cast("double"), F.col("weight") * first_open)
    return filled.select("key", "rank", "n", "source_size", "weight", target.alias("target"))


def schedule(rows: DataFrame, weights: tuple[int, ...], repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The documents with their target, and the packets the mix takes (row, round, taken, virtual_finish).

    ``rows`` has row, doc_id, source, size and text_key. Documents of a source queue in a shuffled order that depends
    on the seed and the doc_id alone, again and again up to ``repeats`` times. A turn is eligible if it starts before
    its source's target. The packet at which the running total reaches the budget, the words of all sources, is cut. So
    the mix has as many words as the documents, and each source at least its target, rounded down.
    """
    sources = saved(targets(rows, weights, repeats), "targets")
    turn = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    order = [F.col("turn"), F.col("doc_id"), F.col("text_key"), F.col("row")]
    queued = ordered_totals(rows.withColumn("turn", turn), order, {"words": F.col("size")}, ["key"])
    placed = saved(join_lookup(queued, sources.drop("weight"), "key", F.col("n"), "turn", "inner"), "queue")
    budget = placed.agg(F.sum("size")).first()[0] or 0
    rounds = placed.where("size > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    first = F.col("words") - F.col("size") + F.col("source_size") * F.col("round")
    eligible = rounds.withColumn("first", first).where("first < target")
    inner = F.least(F.col("size"), F.floor("target") - F.col("first"))
    halves = F.array(
        F.struct(F.col("first").alias("start"), inner.alias("length")),
        F.struct((F.col("first") + inner).alias("start"), (F.col("size") - inner).alias("length")),
    )
    cut = eligible.withColumn("packet", F.explode(halves)).where("packet.length > 0")
    finish = (F.col("packet.start") + F.col("packet.length")) / F.col("target")
    entries = cut.select("row", "round", "rank", "packet.start", "packet.length", finish.alias("virtual_finish"))
    sorted_by = [F.col("virtual_finish"), F.col("rank"), F.col("start")]
    served = ordered_totals(entries, sorted_by, {"served": F.col("length")})
    taken = F.least(F.col("length"), F.lit(budget) - F.col("served") + F.col("length"))
    return placed, served.withColumn("taken", taken).where("taken > 0").select("row", "round", "taken", "virtual_finish")


def _slim(docs: DataFrame, row: Column) -> DataFrame:
    columns = [row.alias("row"), "doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("text_key")]
    return docs.select(*columns, _key(F.col("source")).alias("key"))


def stream(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """The documents of the mix in its order: one row for each time a document is served.

    All columns of ``docs``, then ``taken`` (words of this serving) and ``virtual_finish`` (of its last packet), range-
    partitioned and sorted by it. If ``docs`` has columns of these names, the new ones get the next free name
    (``taken_2``). Documents of which nothing is taken are left out. Rows that repeat a doc_id are documents of their own.
    """
    rows, row = numbered(docs)
    _, packets = schedule(_slim(rows, F.col(row)), weights, repeats, seed)
    taken, finish = free_name(rows, "taken"), free_name(rows, "virtual_finish")
    turns = packets.groupBy(F.col("row").alias(row), "round").agg(
        F.sum("taken").cast("long").alias(taken), F.max("virtual_finish").alias(finish)
    )
    mixed = rows.join(turns.drop("round"), row)
    return mixed.repartitionByRange(finish, row).sortWithinPartitions(finish, row).drop(row)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document; see ``schedule``.

    A null text has size 0 and is not taken; a null source is a source; a null doc_id queues like an empty one; rows
    that repeat a doc_id are documents of their own. Running totals come from range-partitioned slices, so one huge
    source is many tasks. The same rows give the same mix. Without words all targets are 0.
    """
    rows = saved(_slim(docs, F.monotonically_increasing_id()), "sizes")
    placed, packets = schedule(rows, weights, repeats, seed)
    columns = ["row", "doc_id", "size", "source_size", "target"]
    parts = placed.select(*columns, F.lit(0).cast("long").alias("taken"))
    taken = packets.groupBy("row").agg(F.sum("taken").cast("long").alias("some"))
    return parts.join(taken, "row", "left").withColumn("taken", F.coalesce("some", "taken")).select(*columns[1:], "taken")
