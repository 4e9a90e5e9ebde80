"""A data source over the image files still pending for a stage.

The pending assets are a Parquet table of slices. Planning lists its files, one partition for each slice, so neither
the pending ids nor the folders of images pass through the driver. A reader opens the files of its slice one by one,
reduces each to its luma grids, and hashes the bytes only where the stage needs it. A file that can't be opened or
decoded gives a row without grids; the others go on.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenlake.session import scratch_path
from lumenlake.sources.images import GRIDS, both_grids

PENDING = "id string, media_type string, name string, folder string, path string"
ROWS = f"{PENDING}, grids {GRIDS}, content_hash string"
SLICE_ROWS = 512
_BATCH = 64
_PORTABLE = re.compile(rb"P([56])\s+(\d+)\s+(\d+)\s+(\d+)\s")


def store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def decode(content: bytes) -> np.ndarray:
    """(height, width, channels) of grey or BGR pixels; portable maps, and other formats where Pillow is installed."""
    head = _PORTABLE.match(content)
    if head:
        kind, width, height, white = (int(g) for g in head.groups())
        channels = 1 if kind == 5 else 3
        if white != 255:
            raise ValueError("pixels of other than one byte")
        pixels = np.frombuffer(content, np.uint8, width * height * channels, head.end())
        return pixels.reshape(height, width, channels)[..., ::-1]
    try:
        from PIL import Image
    except ImportError as missing:
        raise ValueError("not a portable map, and Pillow is not installed") from missing
    import io

    with Image.open(io.BytesIO(content)) as image:
        return np.asarray(image.convert("RGB"))[..., ::-1]


class Slice(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, pending: str, stage: str):
        self.pending, self.deep = pending, stage == "deep"

    def partitions(self) -> list[Slice]:
        files, folder = store(self.pending)
        found = files.get_file_info(pa.fs.FileSelector(folder))
        scheme = self.pending.partition("://")[0] + "://" if "://" in self.pending else ""
        return [Slice(scheme + f.path) for f in found if f.base_name.endswith(".parquet")]

    def _row(self, row: dict) -> dict:
        content = None
        row |= {"grids": {"fine": None, "coarse": None}, "content_hash": None}
        try:
            files, path = store(row["path"])
            with files.open_input_stream(path, compression=None) as stream:
                content = stream.read()
            fine, coarse = both_grids(decode(content))
            row["grids"] = {"fine": fine.ravel(), "coarse": coarse.ravel()}
        except (OSError, ValueError, TypeError, AttributeError, IndexError):
            pass  # kept as a row without grids: the stage reports it as failed
        if self.deep and content is not None and row["media_type"] != "video":
            row["content_hash"] = hashlib.sha256(content).hexdigest()
        return row

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        schema = pa.schema(
            [*[(n.split()[0], pa.string()) for n in PENDING.split(", ")],
             ("grids", pa.struct([("fine", ints), ("coarse", ints)])), ("content_hash", pa.string())]
        )
        files, path = store(partition.path)
        with files.open_input_file(path) as file:
            for batch in pa.parquet.ParquetFile(file).iter_batches(_BATCH):
                yield pa.RecordBatch.from_pylist([self._row(r) for r in batch.to_pylist()], schema)


class PendingImages(DataSource):
    """``spark.read.format("pending_images")`` with the options ``pending`` (a folder of slices) and ``stage``."""

    @classmethod
    def name(cls) -> str:
        return "pending_images"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options["pending"], self.options.get("stage", "fast"))


def read_pending(pending: DataFrame, stage: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Grids, and hashes of a deep stage, of pending assets with a ``path``; one task for each slice of them.

    The files must be in a store that pyarrow opens (local or mounted folders, and the usual object stores); elsewhere
    use ``read_images``, which reads by Spark's own sources.
    """
    spark: SparkSession = pending.sparkSession
    folder = scratch_path(spark, "pending")
    columns = [c.split()[0] for c in PENDING.split(", ")]
    pending.select(*columns).write.option("maxRecordsPerFile", slice_rows).parquet(folder)
    spark.dataSource.register(PendingImages)
    return spark.read.format("pending_images").option("pending", folder).option("stage", stage).load()
