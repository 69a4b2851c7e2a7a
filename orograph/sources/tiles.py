"""Terrain tiles over HTTP (or file addresses) as a Spark data source: a range of tiles is dealt over partitions, which bound how many are fetched at a time."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orograph.sources import versions
from orograph.sources.raster import decode_rgb
from orograph.sources.shared import checkpointed

# Fixed values.
TIMEOUT_S, PARTS = 15, 8


class Tiles(InputPartition):
    """The tiles of a partition: (x, y) each."""

    def __init__(self, places: list[tuple[int, int]]) -> None:
        self.places = places


class TileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.url, self.z = options["url"], int(options["z"])
        self.xs, self.ys = ((int(options[f"{a}_min"]), int(options[f"{a}_max"])) for a in "xy")
        self.parts, self.skips = int(options.get("parts", PARTS)), options.get("missing", "fail") == "skip"

    def partitions(self) -> list[Tiles]:
        every = [(x, y) for x in range(self.xs[0], self.xs[1] + 1) for y in range(self.ys[0], self.ys[1] + 1)]
        return [Tiles(every[i :: self.parts]) for i in range(min(self.parts, len(every)))]

    def read(self, partition: Tiles) -> Iterator[tuple]:
        from urllib.error import HTTPError, URLError
        from urllib.request import urlopen

        for x, y in partition.places:
            try:
                with urlopen(self.url.format(z=self.z, x=x, y=y), timeout=TIMEOUT_S) as answer:
                    yield self.z, x, y, answer.read()
            except (HTTPError, URLError) as error:
                # A tile that isn't there; anything else fails the task, which Spark tries again.
                gone = getattr(error, "code", None) == 404 or isinstance(getattr(error, "reason", None), FileNotFoundError) or "No such file" in str(error)
                if not (gone and self.skips):
                    raise


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "terrain_tiles"

    def schema(self) -> str:
        return "z int, x int, y int, png binary"

    def reader(self, schema) -> TileReader:
        return TileReader(dict(self.options))


def fetched(spark: SparkSession, url: str, z: int, xs: tuple[int, int], ys: tuple[int, int], parts: int = PARTS, missing: str = "fail") -> DataFrame:
    """Tiles (z, x, y, png) of a range; ``url`` has places for z, x and y. ``missing``: fail, or skip."""
    spark.dataSource.register(TileSource)
    reader = spark.read.format("terrain_tiles").option("url", url).option("z", z).option("parts", parts).option("missing", missing)
    return reader.option("x_min", xs[0]).option("x_max", xs[1]).option("y_min", ys[0]).option("y_max", ys[1]).load()


TILE = "z int, x int, y int, png binary, error string, tries int"


def fetched_table(wanted: DataFrame, url: str, in_flight: int = PARTS, tries: int = 3, wait_s: float = 0.2) -> DataFrame:
    """The tiles (z, x, y) of a table, each once: (z, x, y, png, error, tries).

    Tiles are dealt over ``in_flight`` partitions, which fetch one after another,
    so that no more requests are open at a time, however many tiles there are. An
    answer that may change (a server's error, no connection, time out) is asked
    for again; what stays without a tile is a row with its error.
    """

    def fetch(z: int, x: int, y: int) -> tuple[bytes | None, str | None, int]:
        import time
        from http.client import HTTPException
        from urllib.error import HTTPError
        from urllib.request import urlopen

        said = None
        for n in range(1, tries + 1):
            try:
                with urlopen(url.format(z=z, x=x, y=y), timeout=TIMEOUT_S) as answer:
                    return answer.read(), None, n
            except HTTPError as error:
                said = f"HTTP {error.code}"
                if error.code < 500 and error.code != 429:
                    return None, said, n
            except (OSError, HTTPException) as error:
                said = str(error) or type(error).__name__
                if "No such file" in said:
                    return None, said, n
            if n < tries:
                time.sleep(wait_s * 2 ** (n - 1))
        return None, said, tries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                png, error, n = fetch(z, x, y)
                columns = [pa.array([v], t) for v, t in zip((z, x, y, png, error, n), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["z", "x", "y", "png", "error", "tries"])

    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int32()]
    places = wanted.select(*[F.col(c).cast("int") for c in "zxy"]).dropna().distinct()
    return places.repartition(in_flight, "z", "x", "y").mapInArrow(run, TILE)


LAKE = "z int, x int, y int, png binary, fetched_at double"


def read_through(wanted: DataFrame, lake: str, url: str, ttl_s: float, now: float, in_flight: int = PARTS, tries: int = 3) -> DataFrame:
    """The tiles (z, x, y) of a table from a lake, after what it lacks was fetched: (z, x, y, png, error).

    ``lake``: the folder of a table of snapshots. A tile is too old when its age is
    over ``ttl_s``. Keys and ages alone are read to find what is missing; the
    fetched tiles are written once, to the lake, and read from there. Failures
    aren't kept, so the next read tries them again.
    """
    spark = wanted.sparkSession
    places = wanted.select(*[F.col(c).cast("int") for c in "zxy"]).dropna().distinct()
    fresh = F.lit(now) - F.col("fetched_at") <= F.lit(ttl_s)
    held = versions.read(spark, lake, LAKE).filter(fresh).select("z", "x", "y")
    # Written before it is looked at twice, so that each tile is asked for once.
    answers = checkpointed(fetched_table(places.join(held, ["z", "x", "y"], "left_anti"), url, in_flight, tries))
    found = answers.filter("png IS NOT NULL").select("z", "x", "y", "png", F.lit(float(now)).alias("fetched_at"))
    if not found.isEmpty():
        versions.added(spark, lake, found)
    tiles = versions.read(spark, lake, LAKE).filter(fresh)
    newest = tiles.groupBy("z", "x", "y").agg(F.max("fetched_at").alias("fetched_at"))
    known = tiles.join(places, ["z", "x", "y"], "left_semi").join(newest, ["z", "x", "y", "fetched_at"]).select("z", "x", "y", "png", F.lit(None).cast("string").alias("error"))
    return known.unionByName(answers.filter("png IS NULL").select("z", "x", "y", "png", "error"))


def compacted(spark: SparkSession, lake: str, ttl_s: float, now: float) -> None:
    """The lake without what is too old or was fetched again since: one snapshot instead of many."""

    def change(tiles: DataFrame) -> DataFrame:
        fresh = tiles.filter(F.lit(now) - F.col("fetched_at") <= F.lit(ttl_s))
        newest = fresh.groupBy("z", "x", "y").agg(F.max("fetched_at").alias("fetched_at"))
        return fresh.join(newest, ["z", "x", "y", "fetched_at"]).select("z", "x", "y", "png", "fetched_at").repartition("z", "x").sortWithinPartitions("z", "x", "y")

    versions.replaced(spark, lake, LAKE, change)


def pixels_of(png: bytes) -> np.ndarray:
    """Samples (height, width, channels) of a PNG of eight bits, RGB or RGBA, not interlaced: what terrain tiles are."""
    at, data, head = 8, [], None
    while at < len(png):
        size, kind = struct.unpack(">I4s", png[at : at + 8])
        body = png[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in (2, 6) or head[6]:
        raise ValueError("not a PNG of eight-bit RGB or RGBA samples")
    w, h, n = head[0], head[1], 3 if head[3] == 2 else 4
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, w + 1, n), np.int64)  # with a row and a column of nothing before the first
    for y in range(h):
        line, above, kind = raw[y, 1:].reshape(w, n).astype(np.int64), out[y], raw[y, 0]
        row = out[y + 1]
        if kind == 0:
            row[1:] = line
        elif kind == 1:
            row[1:] = np.cumsum(line, 0) & 255
        elif kind == 2:
            row[1:] = (line + above[1:]) & 255
        else:
            for x in range(1, w + 1):
                a, b, c = row[x - 1], above[x], above[x - 1]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    da, db, dc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))
                row[x] = (line[x - 1] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def decoded(tiles: DataFrame) -> DataFrame:
    """Pixels (z, x, y, py, px, elev) of fetched tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z, x, y, png in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                p = pixels_of(png)
                h, w = p.shape[:2]
                at = np.arange(h * w)
                places = [pa.array(np.full(h * w, v, np.int32)) for v in (z, x, y)] + [pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*places, *[pa.array(p[:, :, k].ravel().astype(np.int32)) for k in range(3)]], names=["z", "x", "y", "py", "px", "r", "g", "b"])

    samples = tiles.select("z", "x", "y", "png").mapInArrow(run, "z int, x int, y int, py int, px int, r int, g int, b int")
    return samples.select("z", "x", "y", "py", "px", decode_rgb(F.col("r"), F.col("g"), F.col("b")).alias("elev"))
