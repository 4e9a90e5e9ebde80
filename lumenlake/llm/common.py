"""Shared pieces of the training-data operators: words, small tables, tasks over Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlake.plans.parallel import spread
from lumenlake.session import scratch_path

# A word is a run of anything but ASCII white space; bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
NO_ID = np.iinfo(np.int64).max


def _give_back() -> None:
    """Let glibc hand freed arrays back to the system at once: idle Python workers then hold little memory."""
    try:
        ctypes.CDLL("libc.so.6").mallopt(_MMAP_THRESHOLD, 1 << 20)
    except (OSError, AttributeError):  # another C library
        pass


_MMAP_THRESHOLD = -3
_give_back()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: computed once, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or the next one with a number that no column has (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    names = (name if k == 1 else f"{name}_{k}" for k in count(1))
    return next(n for n in names if n.lower() not in taken)


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a number for each row, written once so that all reads agree on it, and that column's name."""
    name = free_name(docs, "_row")
    return saved(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def remainder(column: str, divisor: int) -> Column:
    """crc32 of the id as text, modulo a number; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def word_count(column: str) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def texts_of(batch: pa.RecordBatch | pa.Table, column: str = "text") -> list[bytes]:
    """UTF-8 texts of an Arrow batch; null becomes the empty text."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def words_of(batch: pa.RecordBatch | pa.Table, column: str = "text") -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """The words of all texts in a row as numbers of distinct words, these, and the number of words of each text.

    Null, empty and blank texts have none.
    """
    texts = batch.column(column)
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pa.compute.ascii_trim_whitespace(texts.cast(pa.string()))
    blank = pa.compute.equal(pa.compute.binary_length(texts), 0)
    lists = pa.compute.ascii_split_whitespace(pa.compute.if_else(blank, pa.scalar(None, pa.string()), texts))
    coded = lists.flatten().dictionary_encode()
    sizes = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()
    return coded.indices.to_numpy(), distinct, sizes


def ids_of(batch: pa.RecordBatch | pa.Table, column: str = "doc_id") -> np.ndarray:
    """Ids as 64-bit integers; a null id is larger than all others."""
    return batch.column(column).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)


def bucketed(rows: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder, bucketed by ``chunk``, and read it back."""
    spark = rows.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table_name = f"llm_{name}_{uuid.uuid4().hex}"
    writer = rows.write.bucketBy(slots, "chunk").option("compression", "zstd").option("path", scratch_path(spark, name))
    writer.saveAsTable(table_name)
    chunks = spark.table(table_name)
    spark.sql(f"DROP TABLE `{table_name}`")  # its files stay, and the frame knows them: nothing is left in the catalog
    return chunks


def chunked(docs: DataFrame, columns: list[str], text: str = "text", chunk_bytes: int = 8 << 20) -> DataFrame:
    """Store documents in chunks of bounded size, bucketed by ``chunk``, without a shuffle.

    Each task cuts the rows it reads into chunks of at most ``chunk_bytes`` of text (one longer text is a chunk of
    its own). The table is written bucketed by the chunk, so that later steps can cogroup the texts of a chunk with
    small answers for it while only the answers move. Columns: ``chunk``, the given columns, ``octets``.
    """
    slim = spread(docs.select(*columns))
    schema = f"chunk long, {', '.join(f'`{n}` {t}' for n, t in slim.dtypes)}, octets long"
    rows = slim.mapInArrow(_Cut(text, chunk_bytes), schema)
    return bucketed(rows, "chunks")


class _Cut:
    """Number the chunks of a partition: the partition in the high bits, the chunk in the low ones."""

    def __init__(self, text: str, chunk_bytes: int):
        self.text, self.chunk_bytes = text, chunk_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 32
        number, filled = 0, 0
        for batch in batches:
            octets = pa.compute.binary_length(batch.column(self.text)).fill_null(0).to_numpy(zero_copy_only=False)
            chunks = np.empty(len(octets), np.int64)
            for row, size in enumerate(octets.tolist()):
                if filled and filled + size > self.chunk_bytes:
                    number, filled = number + 1, 0
                filled += size
                chunks[row] = first + number
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks), *batch.columns, pa.array(octets, pa.int64())],
                ["chunk", *batch.schema.names, "octets"],
            )


def labelled(docs: DataFrame, labels: DataFrame, name: str, train: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled rows, chosen by a hash of the id.

    ``train`` says which ids may be learnt from. Null labels and ids are left out; of several labels the largest counts.
    Only ids and labels are gathered for the choice; at most ``most`` of them are broadcast.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(name).isNotNull() & train)
    marks = marks.groupBy("doc_id").agg(F.max(name).cast("int").alias("label"))
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of ``sizes`` values; a run may be empty."""
    ends = np.cumsum(sizes)
    total = np.concatenate([[0], np.cumsum(values)])
    return total[ends] - total[ends - sizes]


def parts(batches: Iterator[pa.RecordBatch], octets: int = 4 << 20, text: str = "text") -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about so many octets of text, so that what is made of one stays small."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(text)).fill_null(0).to_pylist()
        for a, b in pieces(sizes, octets):
            yield batch.slice(a, b - a)


def pieces(sizes: Sequence[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs (first, end) of rows whose sizes add up to about ``most``, so that arrays over a run stay small."""
    first, size = 0, 0
    for k, one in enumerate(sizes):
        size += one + 1
        if size >= most or k + 1 == len(sizes):
            yield first, k + 1
            first, size = k + 1, 0
