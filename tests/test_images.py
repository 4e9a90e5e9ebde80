import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from lumenlake.functions.signals import blur_score, brightness_score
from lumenlake.functions.vectors import cosine_similarity, mean_pool_normalize
from lumenlake.operators.analysis import analyze_assets
from lumenlake.registry import Signal, SignalRegistry
from lumenlake.sources.images import read_images


def png(width, height, pixel):
    """Bytes of an RGB image."""
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    header = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def images(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("images")
    files = {
        "flat.png": png(64, 64, lambda x, y: (128, 128, 128)),
        "half.png": png(64, 48, lambda x, y: (255, 255, 255) if y >= 24 else (0, 0, 0)),
        "stripes.png": png(32, 32, lambda x, y: (255, 255, 255) if x % 2 else (0, 0, 0)),
        "tiny.png": png(3, 5, lambda x, y: (10, 200, 30)),
        "broken.png": b"not an image",
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    table = read_images(spark, str(folder), "*.png")
    return files, table.withColumn("name", F.element_at(F.split("path", "/"), -1))


def test_every_file_is_listed_and_hashed_and_failures_stay_apart(images):
    files, table = images
    rows = {r.name: r for r in table.collect()}
    assert set(rows) == set(files)
    for name, data in files.items():
        assert rows[name].content_hash == hashlib.sha256(data).hexdigest()
    assert [r.name for r in table.where("grids.fine is null").collect()] == ["broken.png"]
    assert rows["tiny.png"].grids.coarse == [int(0.299 * 10 + 0.587 * 200 + 0.114 * 30)] * 64
    assert len(rows["flat.png"].grids.fine) == 1024 and set(rows["flat.png"].grids.fine) == {int(0.299 * 128 + 0.587 * 128 + 0.114 * 128)}


def test_stages_report_every_capability(images):
    _, table = images
    inputs = table.selectExpr(
        "name AS id", "case when name = 'tiny.png' then 'video' else 'photo' end AS media_type", "name",
        "'Pictures/Screenshots/' AS folder", "grids", "content_hash", "'text' AS ocr_text", "name <> 'half.png' AS text_done",
    )
    fast = {r.id: r for r in analyze_assets(inputs, "fast", F.lit(5).cast("bigint")).collect()}
    deep = {r.id: r for r in analyze_assets(inputs, "deep", F.lit(5).cast("bigint")).collect()}
    status = lambda row: {r.capability_id: r.error for r in row.capability_results}
    assert set(status(fast["flat.png"]).values()) == {None} and len(status(fast["flat.png"])) == 3
    assert fast["half.png"].perceptual_hash == "00000000ffffffff" and fast["half.png"].content_hash is None
    assert status(deep["broken.png"]) == {
        "content.screenshot": None, "quality.visual": "THUMBNAIL_UNAVAILABLE",
        "similarity.perceptual": "THUMBNAIL_UNAVAILABLE", "duplicate.exact": None, "text.ocr": "NOT_PROCESSED"}
    assert status(deep["half.png"])["text.ocr"] == "OCR_FAILED"
    assert set(status(deep["tiny.png"]).values()) == {None}
    assert deep["tiny.png"].content_hash is None and deep["tiny.png"].ocr_text is None
    assert deep["flat.png"].ocr_text == "text" and deep["flat.png"].is_screenshot
    assert deep["flat.png"].blur_score == 1.0 and deep["flat.png"].quality_score == 0.0
    assert deep["stripes.png"].blur_score == 0.0


def test_grid_scores(spark):
    rows = spark.createDataFrame([([0] * 64,), ([255] * 64,), ([127, 128] * 32,), ([1] * 9,)], "g array<int>")
    got = rows.select(blur_score(F.col("g"), 8), brightness_score(F.col("g"))).collect()
    assert [r[0] for r in got][:2] == [1.0, 1.0] and got[3][0] is None
    assert got[0][1] == 0.0 and got[1][1] == 0.0 and got[2][1] == pytest.approx(1.0)


def test_vectors(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([float("inf"), 1.0], [1.0, 1.0])],
        "a array<double>, b array<double>",
    )
    got = [r[0] for r in rows.select(cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[0] == 0.0 and got[1] == pytest.approx(1.0) and got[2:] == [None, None, None]
    tokens = spark.createDataFrame([("x", [3.0, 0.0]), ("x", [3.0, 8.0]), ("zero", [0.0, 0.0])], "id string, v array<double>")
    pooled = {r.id: r.v for r in mean_pool_normalize(tokens, "id", "v").collect()}
    assert pooled == {"x": pytest.approx([0.6, 0.8])}


def test_a_failing_signal_blocks_only_its_dependants(spark):
    registry = SignalRegistry()
    registry.register_signal(Signal("base.size", {"size": F.length("t")}, F.col("size") > 0, cost="cheap"))
    registry.register_signal(Signal("ratio.size", {"ratio": 10 / F.nullif(F.col("size"), F.lit(2))}, F.col("ratio").isNotNull(), ("base.size",)))
    registry.register_signal(Signal("other.upper", {"upper": F.upper("t")}, F.col("upper").isNotNull()))
    with pytest.raises(ValueError):
        registry.register_signal(Signal("other.upper", {}, F.lit(True)))
    df = spark.createDataFrame([("abcde",), ("",), ("ab",)], "t string")
    rows = {r.t: r for r in registry.run(df, ["ratio.size", "other.upper", "missing.one"]).collect()}
    status = {t: {c.capability_id: c.error for c in r.capability_results} for t, r in rows.items()}
    assert status["abcde"] == {"base.size": None, "ratio.size": None, "other.upper": None, "missing.one": "UNAVAILABLE"}
    assert status[""]["base.size"] == "FAILED" and status[""]["ratio.size"] == "UNAVAILABLE"
    assert status[""]["other.upper"] is None and status["ab"]["ratio.size"] == "FAILED"


def test_both_grids_equal_plain_averages():
    import numpy as np

    from lumenlake.sources.images import both_grids

    draw = np.random.default_rng(1)
    for height, width in ((32, 32), (100, 57), (5, 90), (1, 1)):
        pixels = draw.integers(0, 256, (height, width, 3), np.uint8)
        for grid, n in zip(both_grids(pixels), (32, 8)):
            for i in range(n):
                for j in range(n):
                    top, left = i * height // n, j * width // n
                    cell = pixels[top : max(top + 1, (i + 1) * height // n), left : max(left + 1, (j + 1) * width // n)]
                    blue, green, red = cell.reshape(-1, 3).astype(int).sum(axis=0) // (cell.shape[0] * cell.shape[1])
                    assert grid[i, j] == int(0.299 * red + 0.587 * green + 0.114 * blue)


def test_only_pending_files_are_read(spark, tmp_path):
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(png(40, 40, lambda x, y: (9, 9, 9)))
    rows = read_images(spark, [str(tmp_path / "b.png")], hashes=False)
    assert rows.columns == ["path", "grids"]
    assert [r.path.rsplit("/", 1)[1] for r in rows.collect()] == ["b.png"]
    assert read_images(spark, str(tmp_path), "*.png", modified_after="2999-01-01T00:00:00").count() == 0
