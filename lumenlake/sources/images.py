"""Image files: original bytes, decoded pixels and luma grids, with failures kept per file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

# fixed values: luma weights of red, green and blue
LUMA = (0.299, 0.587, 0.114)
GRIDS = "struct<fine:array<int>,coarse:array<int>>"
FINE, COARSE = 32, 8
# Both sources name files alike in the file metadata, though not in their own columns.
PATH = "_metadata.file_path AS path"


Paths = str | list[str]


def _reader(spark: SparkSession, kind: str, pattern: str, modified_after: str | None) -> DataFrameReader:
    reader = spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return reader.option("modifiedAfter", modified_after) if modified_after else reader


def read_image_bytes(
    spark: SparkSession, path: Paths, pattern: str = "*", modified_after: str | None = None
) -> DataFrame:
    """(path, modified, length, content) per file; unreadable files are skipped, not fatal."""
    files = _reader(spark, "binaryFile", pattern, modified_after).option("ignoreCorruptFiles", "true").load(path)
    return files.selectExpr(PATH, "modificationTime AS modified", "length", "content")


def read_image_pixels(
    spark: SparkSession, path: Paths, pattern: str = "*", modified_after: str | None = None
) -> DataFrame:
    """(path, image) with decoded pixels; a file that cannot be decoded has a null image."""
    decoded = _reader(spark, "image", pattern, modified_after).option("dropInvalid", "false").load(path)
    return decoded.selectExpr(PATH, "case when image.height > 0 then image end AS image")


def _area_sums(pixels: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sums, areas) of n x n cells of a (height, width, channels) array; one band of rows at a time, in integers."""

    def edges(size: int) -> list[tuple[int, int]]:
        return [(k * size // n, max(k * size // n + 1, (k + 1) * size // n)) for k in range(n)]

    rows, columns = edges(pixels.shape[0]), edges(pixels.shape[1])
    bands = np.stack([pixels[a:b].sum(axis=0, dtype=np.int64) for a, b in rows])
    sums = np.stack([bands[:, a:b].sum(axis=1) for a, b in columns], axis=1)
    heights, widths = (np.array([b - a for a, b in spans]) for spans in (rows, columns))
    return sums, heights[:, None] * widths[None, :]


def _luma(sums: np.ndarray, areas: np.ndarray) -> np.ndarray:
    """Luma of averaged BGR (or grey) cells."""
    cells = (sums // areas[..., None]).astype(np.float64)
    if cells.shape[2] == 1:
        return cells[..., 0].astype(np.int32)
    blue, green, red = cells[..., 0], cells[..., 1], cells[..., 2]
    return (LUMA[0] * red + LUMA[1] * green + LUMA[2] * blue).astype(np.int32)


def area_grid(pixels: np.ndarray, n: int) -> np.ndarray:
    """n x n luma values from a (height, width, channels) BGR array, by area average."""
    return _luma(*_area_sums(pixels, n))


def both_grids(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The fine and the coarse grid from one pass over the pixels.

    Every coarse cell is a block of fine ones, unless a side has fewer pixels than the fine grid has cells.
    """
    sums, areas = _area_sums(pixels, FINE)
    if min(pixels.shape[:2]) < FINE:
        return _luma(sums, areas), area_grid(pixels, COARSE)
    step = FINE // COARSE
    joined = sums.reshape(COARSE, step, COARSE, step, -1).sum(axis=(1, 3))
    return _luma(sums, areas), _luma(joined, areas.reshape(COARSE, step, COARSE, step).sum(axis=(1, 3)))


def _luma_grids(images: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for height, width, channels, data in zip(
        images["height"], images["width"], images["nChannels"], images["data"]
    ):
        try:
            pixels = np.frombuffer(data, dtype=np.uint8).reshape(int(height), int(width), int(channels))
            fine, coarse = both_grids(pixels)
            rows.append({"fine": fine.ravel(), "coarse": coarse.ravel()})
        except (TypeError, ValueError, IndexError):
            rows.append({"fine": None, "coarse": None})
    return pd.DataFrame(rows, columns=["fine", "coarse"])


def luma_grids(image: Column) -> Column:
    """Both grids of decoded images; null where there are no pixels or they do not add up."""
    return F.pandas_udf(_luma_grids, GRIDS)(image)


def read_images(spark: SparkSession, path: Paths, pattern: str = "*", hashes: bool = True, modified_after: str | None = None) -> DataFrame:
    """(path, modified, length, content_hash, grids) per file, or (path, grids) without ``hashes``.

    Bytes are hashed and pixels reduced to grids where they are read, so the
    join by path moves a few hundred numbers per file and never an image. A fast
    stage needs no hashes and reads every file once. ``path`` may be the list of
    files still pending, and ``modified_after`` leaves out older ones: neither is
    then listed or read as a whole.
    """
    pixels = read_image_pixels(spark, path, pattern, modified_after)
    grids = pixels.select("path", luma_grids(F.col("image")).alias("grids"))
    if not hashes:
        return grids
    files = read_image_bytes(spark, path, pattern, modified_after).select(
        "path", "modified", "length", F.sha2("content", 256).alias("content_hash")
    )
    return files.join(grids, "path", "left")
