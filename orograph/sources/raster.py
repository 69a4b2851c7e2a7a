"""Elevation rasters as tables of cells (area, row, col, elev), row 0 in the north.

Many areas are held at once; every operator works within an area, so that areas
spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 64


def from_embeddings(df: DataFrame) -> DataFrame:
    """64 successive vectors of 64 numbers form an area; the last one can have fewer rows."""
    rows = df.select((F.col("vec_id") / SIDE).cast("long").alias("area"), (F.col("vec_id") % SIDE).cast("int").alias("row"), F.posexplode("embedding").alias("col", "e"))
    return rows.select("area", "row", "col", (F.lit(1500.0) + F.lit(2500.0) * F.col("e").cast("double")).alias("elev"))


def whole(cells: DataFrame, side: int = SIDE) -> DataFrame:
    """Cells of the areas that have all their rows, for operators on square rasters."""
    full = cells.groupBy("area").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == side * side).select("area")
    return cells.join(full, "area", "left_semi")


def closed_form(spark: SparkSession, side: int, elev: Column, area: int = 0) -> DataFrame:
    """A raster from an expression over ``row`` and ``col``: fixtures without data."""
    cells = spark.range(side * side).select(F.lit(area).cast("long").alias("area"), (F.col("id") / side).cast("int").alias("row"), (F.col("id") % side).cast("int").alias("col"))
    return cells.withColumn("elev", elev.cast("double"))


def encode_rgb(elev: Column) -> Column:
    """Elevation as the three bytes of a terrain tile's pixel."""
    v = elev + 32768.0
    return F.struct(F.floor(v / 256).cast("int").alias("r"), F.floor(v % 256).cast("int").alias("g"), F.floor((v - F.floor(v)) * 256).cast("int").alias("b"))


def decode_rgb(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def tile_pixels(images: DataFrame) -> DataFrame:
    """Pixels (z, x, y, py, px, elev) of tiles read by the ``image`` source, whose paths end in z/x/y.png; its bytes are blue, green, red."""
    import numpy as np
    import pyarrow as pa

    def decode(batches):
        for batch in batches:
            for z, x, y, h, w, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                px = np.frombuffer(raw, np.uint8).reshape(h, w, n).astype(np.float64)
                e = (px[:, :, 2] * 256 + px[:, :, 1] + px[:, :, 0] / 256 - 32768).ravel()
                at = np.arange(h * w)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(h * w, v, np.int32)) for v in (z, x, y)] + [pa.array((at // w).astype(np.int32)), pa.array((at % w).astype(np.int32)), pa.array(e)], names=["z", "x", "y", "py", "px", "elev"])

    part = lambda i: F.regexp_extract("image.origin", r"(\d+)/(\d+)/(\d+)\.png$", i).cast("int")
    return images.select(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"), "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(decode, "z int, x int, y int, py int, px int, elev double")


def mosaic(pixels: DataFrame, side: int = 256, keys: list[str] | None = None) -> DataFrame:
    """Pixels of each area's tiles (``keys`` name the area) as one raster; only the corners, a row an area, are aggregated and joined."""
    keys = keys or ["area"]
    corner = pixels.groupBy(*keys).agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return pixels.join(corner, keys).select(*keys, ((F.col("y") - F.col("y0")) * side + F.col("py")).cast("int").alias("row"), ((F.col("x") - F.col("x0")) * side + F.col("px")).cast("int").alias("col"), "elev")


def resampled(raster: DataFrame, sizes: DataFrame, cells: int = 128) -> DataFrame:
    """Each area's raster (``sizes``: area, height, width) as ``cells`` x ``cells``, corners on corners: four cells by one equi-join.

    Places are made from a row an area, by whose size they would be taken for few and broadcast: both sides are shuffled.
    """
    side = F.sequence(F.lit(0), F.lit(cells - 1))
    at = sizes.withColumn("i", F.explode(side)).withColumn("j", F.explode(side)).withColumns({"r": F.col("i") * (F.col("height") - 1) / (cells - 1.0), "c": F.col("j") * (F.col("width") - 1) / (cells - 1.0)})
    at = at.withColumns({"r0": F.least(F.floor("r"), F.col("height") - 2), "c0": F.least(F.floor("c"), F.col("width") - 2)})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    four = at.withColumn("q", corner).select("area", "i", "j", (F.col("r0") + F.col("q.a")).cast("int").alias("row"), (F.col("c0") + F.col("q.b")).cast("int").alias("col"), ((F.lit(1.0) - F.abs(F.col("r") - F.col("r0") - F.col("q.a"))) * (F.lit(1.0) - F.abs(F.col("c") - F.col("c0") - F.col("q.b")))).alias("w"))
    return four.join(raster.select("area", "row", "col", "elev").hint("merge"), ["area", "row", "col"]).groupBy("area", F.col("i").alias("row"), F.col("j").alias("col")).agg(F.sum(F.col("w") * F.col("elev")).alias("elev"))


def fidelity(tiles: DataFrame, provider: str = "terrarium", cells: int = 128) -> DataFrame:
    """What each area's raster was made of. ``tiles``: area, zoom_requested, zoom and a row a tile."""
    return tiles.groupBy("area", "zoom_requested", "zoom").agg(F.count(F.lit(1)).alias("tile_count")).select("area", F.lit(provider).alias("provider"), "zoom_requested", F.col("zoom").alias("zoom_used"), F.lit(cells).alias("grid_width"), F.lit(cells).alias("grid_height"), F.lit("bilinear").alias("resampling"), "tile_count")


def write_tiles(pixels: DataFrame, path: str) -> None:
    """Decoded tiles as a lake by zoom and column of tiles, which later scans read instead of the images: ``read_tiles`` prunes it."""
    pixels.repartition("z", "x").sortWithinPartitions("y", "py", "px").write.mode("overwrite").partitionBy("z", "x").parquet(path)


def read_tiles(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Pixels of the tiles (z, x, y) of ``wanted``, each once; partitions are pruned by the join."""
    return spark.read.parquet(path).join(wanted.select("z", "x", "y").distinct(), ["z", "x", "y"])
