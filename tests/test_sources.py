"""Sources: tiles from PNG files, mosaics, tool logs from JSON lines."""

import struct
import zlib

from pyspark.sql import functions as F

from orograph.operators import spatial, style
from orograph.sources import raster
from orograph.streaming import logs


def png(path, rgb, side=4):
    """A plain PNG of one colour."""
    raw = b"".join(b"\0" + bytes(rgb) * side for _ in range(side))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", side, side, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_tiles_decode_and_join_up(spark, tmp_path):
    for x, rgb in ((10, (133, 220, 0)), (11, (128, 0, 0))):
        (tmp_path / f"3/{x}").mkdir(parents=True)
        png(tmp_path / f"3/{x}/7.png", rgb)
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(str(tmp_path))
    pixels = raster.tile_pixels(images)
    found = {(r["x"], r["y"]): r["e"] for r in pixels.groupBy("x", "y").agg(F.avg("elev").alias("e")).collect()}
    assert found == {(10, 7): 1500.0, (11, 7): 0.0}
    whole = raster.mosaic(pixels.withColumn("area", F.lit(1)), 4)
    assert whole.agg(F.max("col"), F.max("row"), F.count("*")).first()[:] == (7, 3, 32)
    assert style.image_fingerprints(images).selectExpr("size(fingerprint) AS n").distinct().collect()[0]["n"] == 100


def test_tiles_are_fetched_by_range(spark, tmp_path):
    """The tile source over file addresses: a missing tile is an error, unless it may be left out."""
    from orograph.sources import tiles

    for x, rgb in ((10, (133, 220, 0)), (11, (128, 0, 0))):
        (tmp_path / f"3/{x}").mkdir(parents=True)
        png(tmp_path / f"3/{x}/7.png", rgb)
    template = f"file://{tmp_path}/{{z}}/{{x}}/{{y}}.png"
    found = tiles.decoded(tiles.fetched(spark, template, 3, (10, 11), (7, 7), parts=2))
    assert {(r["x"], r["elev"]) for r in found.select("x", "elev").distinct().collect()} == {(10, 1500.0), (11, 0.0)} and found.count() == 32
    assert tiles.fetched(spark, template, 3, (10, 12), (7, 7), missing="skip").count() == 2


def test_png_filters_and_alpha():
    """Every row filter, with and without an alpha channel, against the bytes that were filtered."""
    import random

    from orograph.sources import tiles

    rnd = random.Random(1)
    for channels in (3, 4):
        w, h = 7, 10
        rows = [[rnd.randrange(256) for _ in range(w * channels)] for _ in range(h)]
        raw = b""
        for y, row in enumerate(rows):
            above = rows[y - 1] if y else [0] * len(row)
            out = []
            for i, v in enumerate(row):
                a, b, c = (row[i - channels] if i >= channels else 0), above[i], (above[i - channels] if i >= channels else 0)
                p = a + b - c
                best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out.append((v - (0, a, b, (a + b) // 2, best)[y % 5]) % 256)
            raw += bytes([y % 5, *out])
        chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        packed = zlib.compress(raw)
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if channels == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", packed[:20]) + chunk(b"IDAT", packed[20:]) + chunk(b"IEND", b"")
        assert tiles.pixels_of(data).reshape(h, w * channels).tolist() == rows


def test_tool_logs_drop_malformed_lines(spark, tmp_path):
    (tmp_path / "log.ndjson").write_text('{"id":"1","toolName":"a","startedAt":"2026-01-01T00:00:00Z","isError":false}\nnot json\n{"id":"2","toolName":"a","startedAt":"2026-01-02T00:00:00Z","isError":true}\n')
    path = str(tmp_path / "log.ndjson")
    assert [r["id"] for r in logs.read_tool_logs(spark, path).collect()] == ["2", "1"]
    assert [r["id"] for r in logs.read_tool_logs(spark, path, tool="a", errors=True).collect()] == ["2"]


def test_distance_join_equals_all_pairs(spark):
    a = spark.range(80).select((F.lit(39.5) + F.col("id") * 37 % 80 / 400).alias("lat"), (F.lit(-105.0) + F.col("id") * 53 % 80 / 300).alias("lng"), F.col("id").alias("i"))
    b = a.select(F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.col("i").alias("j"))
    from orograph.functions import geo

    near = {(r["i"], r["j"]) for r in spatial.within(a, b, 3000.0).collect()}
    every = a.crossJoin(b).filter(geo.haversine(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")) <= 3000)
    assert near == {(r["i"], r["j"]) for r in every.collect()}
