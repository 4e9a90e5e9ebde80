"""A positional index of text: phrases are found without reading the texts again.

One row per (chunk, token) lists the texts of the chunk that hold the token and where. A chunk is a fixed part of the
keys, so all rows about one text share a chunk: building shuffles the texts once, an update rewrites only the chunks it
touches, and a search of a table bucketed by chunk (:func:`save_phrase_index`) needs no shuffle. Choose ``chunks`` such that a chunk
holds some megabytes of text (:func:`chunks_for`), as the words of a chunk are sorted in one task; a very common token is
then one row in each chunk, never one row or task of its own.

Positions are ascending; the Parquet writer stores their differences (``DELTA_BINARY_PACKED``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.functions.text import tokens

CHUNK_BYTES = 8 << 20
#: Version 2 of Parquet's pages codes integers by their differences where no dictionary is kept.
DELTA_CODED = {
    "parquet.writer.version": "v2",
    "parquet.enable.dictionary#entries.list.element.positions.list.element": "false",
}


def chunk_of(key: str, chunks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int").alias("chunk")


def chunks_for(texts: DataFrame, text: str = "ocr_text", least: int = 16) -> int:
    """As many chunks as let each hold about ``CHUNK_BYTES`` of text, so that building never sorts more than fits."""
    total = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(least, math.ceil(total / CHUNK_BYTES))


def _packed(postings: DataFrame, key: str) -> DataFrame:
    entry = F.struct(F.col(key), F.col("positions"))
    return postings.groupBy("chunk", "token").agg(F.sort_array(F.collect_list(entry)).alias("entries"))


def _opened(index: DataFrame, key: str) -> DataFrame:
    """One row per (chunk, token, key) with its positions."""
    rows = index.select("chunk", "token", F.explode("entries").alias("_e"))
    return rows.select("chunk", "token", F.col(f"_e.{key}").alias(key), F.col("_e.positions").alias("positions"))


def _postings(texts: DataFrame, chunks: int, key: str, text: str) -> DataFrame:
    """One row per (chunk, token, key) with the positions of the token, from 0. Texts without a key or a token have none."""
    keyed = texts.where(F.col(key).isNotNull()).select(chunk_of(key, chunks), key, F.col(text).alias("_text"))
    # One piece for each chunk: pieces sized by their few bytes of text would hold many chunks' words.
    words = keyed.repartition(chunks, "chunk").select("chunk", key, F.posexplode(tokens(F.col("_text"))).alias("_at", "token"))
    return words.groupBy("chunk", "token", key).agg(F.sort_array(F.collect_list("_at")).alias("positions"))


def build_phrase_index(texts: DataFrame, chunks: int, key: str = "id", text: str = "ocr_text") -> DataFrame:
    """(chunk, token, entries of key and positions). Keys must be unique; only the texts are shuffled, by chunk."""
    return _packed(_postings(texts, chunks, key, text), key)


def update_phrase_index(
    index: DataFrame, changed: DataFrame, chunks: int, key: str = "id", text: str = "ocr_text"
) -> DataFrame:
    """The rows of every chunk that a changed text touches, made anew; other chunks stay as they are.

    ``changed`` has one row per touched key; a null text means the text was deleted. The result replaces the rows of the
    chunks of ``changed`` (of a table partitioned by chunk, those directories). A chunk that loses its last text has no rows left.
    """
    touched = changed.where(F.col(key).isNotNull()).select(chunk_of(key, chunks), key)
    old = _opened(index.join(touched.select("chunk").distinct(), "chunk", "left_semi"), key)
    kept = old.join(touched, ["chunk", key], "left_anti")
    return _packed(kept.unionByName(_postings(changed, chunks, key, text)), key)


def write_phrase_index(index: DataFrame, path: str, chunks: int | None = None) -> None:
    """Write an index, or the chunks an update made anew: one directory per chunk, tokens sorted.

    Only the directories of the chunks in ``index`` are replaced, so an update must be stored elsewhere first if it
    reads the same path (Spark refuses to overwrite what it reads).
    """
    # With the number of chunks it was built with, a new index is dealt out already and not shuffled again.
    ordered = (index.repartition(chunks, "chunk") if chunks else index.repartition("chunk")).sortWithinPartitions("chunk", "token")
    writer = ordered.write.mode("overwrite").partitionBy("chunk").options(**DELTA_CODED)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def save_phrase_index(index: DataFrame, table: str, buckets: int) -> None:
    """Save as a table bucketed by chunk and sorted by token; a search of it needs no shuffle."""
    writer = index.repartition(buckets, "chunk").write.options(**DELTA_CODED)
    writer.bucketBy(buckets, "chunk").sortBy("token").mode("overwrite").saveAsTable(table)


def phrase_tokens(spark: SparkSession, terms: Sequence[str]) -> list[list[str]]:
    """The tokens of each term, folded as the texts are (a local relation; no job runs)."""
    if not terms:
        raise ValueError("at least one term is needed")
    row = spark.sql("select 1").select(F.array(*[tokens(F.lit(t)) for t in terms])).first()
    return [list(found) for found in row[0]]


def phrase_matches(index: DataFrame, terms: Sequence[str], key: str = "id") -> DataFrame:
    """Keys whose text holds all terms, each as a phrase of whole tokens; the same keys as ``text_matches`` keeps.

    Only rows of the wanted tokens are read (the test reaches the Parquet scan). Every occurrence of a token that is the
    i-th of a phrase says where the phrase would start; a phrase is there if all its tokens agree on a start. Starts are
    counted before the shuffle, within the chunk.
    """
    phrases = phrase_tokens(index.sparkSession, terms)
    if not all(phrases):
        return index.select(F.explode("entries").alias("_e")).select(f"_e.{key}").limit(0)
    distinct = sorted(set(map(tuple, phrases)))
    wanted = sorted({token for phrase in distinct for token in phrase})
    uses = F.array(*[
        F.struct(F.lit(i).alias("phrase"), F.lit(at).alias("at"), F.lit(len(phrase)).alias("length"), F.lit(token).alias("token"))
        for i, phrase in enumerate(distinct)
        for at, token in enumerate(phrase)
    ])
    rows = _opened(index.where(F.col("token").isin(wanted)), key)
    used = rows.withColumn("_u", F.explode(F.filter(uses, lambda u: u["token"] == F.col("token"))))
    # One token is a phrase wherever it stands; its first position is enough.
    places = F.when(F.col("_u.length") == 1, F.slice("positions", 1, 1)).otherwise(
        F.filter(F.transform("positions", lambda p: p - F.col("_u.at")), lambda s: s >= 0)
    )
    starts = used.select("chunk", key, "_u.phrase", "_u.length", F.explode(places).alias("_start"))
    agreed = (
        starts.groupBy("chunk", key, "phrase", "length", "_start")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where("_n = length")
    )
    held = agreed.groupBy("chunk", key).agg(F.count_distinct("phrase").alias("_held"))
    return held.where(F.col("_held") == len(distinct)).select(key)
