"""Elevation at single places on raw tiles, at full resolution."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.functions import geo

TILE = 256


def placed(points: DataFrame, zoom: int, side: int = TILE) -> DataFrame:
    """Adds the tile (x, y) of each point (pid, lat, lng), its first pixel there (px, py), and how far past it the point lies (dx, dy)."""
    z = F.lit(zoom)
    at = points.withColumns({"__x": geo.tile_x(F.col("lng"), z), "__y": geo.tile_y(F.col("lat"), z)}).withColumns({"x": F.floor("__x"), "y": F.floor("__y")})
    at = at.withColumns({"__px": (F.col("__x") - F.col("x")) * side, "__py": (F.col("__y") - F.col("y")) * side})
    at = at.withColumns({"px": F.least(F.floor("__px"), F.lit(side - 1)), "py": F.least(F.floor("__py"), F.lit(side - 1))})
    return at.withColumns({"dx": F.col("__px") - F.col("px"), "dy": F.col("__py") - F.col("py")}).drop("__x", "__y", "__px", "__py")


def corners(points: DataFrame, zoom: int, side: int = TILE) -> DataFrame:
    """The four pixels around each point (pid, x, y, px, py, w, primary pixel): the next tile's where the point lies at a seam.

    Columns of tiles go around the globe; rows end at the poles, where the last tile stands for the one beyond.
    """
    n = 2**zoom
    four = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for j in (0, 1) for i in (0, 1)]))
    q = placed(points, zoom, side).withColumn("q", four).withColumns({"__px": F.col("px") + F.col("q.i"), "__py": F.col("py") + F.col("q.j")})
    row = lambda y: F.greatest(F.lit(0), F.least(F.lit(n - 1), y))
    weight = F.when(F.col("q.i") == 1, F.col("dx")).otherwise(1 - F.col("dx")) * F.when(F.col("q.j") == 1, F.col("dy")).otherwise(1 - F.col("dy"))
    return q.select(
        "pid",
        F.pmod(F.col("x") + F.floor(F.col("__px") / side), F.lit(n)).cast("int").alias("x"),
        row(F.col("y") + F.floor(F.col("__py") / side)).cast("int").alias("y"),
        F.pmod(F.col("__px"), F.lit(side)).cast("int").alias("px"),
        F.pmod(F.col("__py"), F.lit(side)).cast("int").alias("py"),
        F.pmod(F.col("x"), F.lit(n)).cast("int").alias("x0"),
        row(F.col("y")).cast("int").alias("y0"),
        weight.alias("w"),
    )


def tiles_of(points: DataFrame, zoom: int, side: int = TILE) -> DataFrame:
    """The tiles that each point needs, one to four, each once: pid, tiles."""
    return corners(points, zoom, side).groupBy("pid").agg(F.array_sort(F.collect_set(F.struct(F.lit(zoom).alias("z"), "x", "y"))).alias("tiles"))


def elevation(points: DataFrame, pixels: DataFrame, zoom: int, side: int = TILE) -> DataFrame:
    """Bilinear elevation (two decimals) of points from tiles' pixels (z, x, y, py, px, elev), and metres a pixel.

    A missing neighbour tile is stood in for by the same pixel of the point's own
    tile. Two equi-joins: the second only finds pixels for what the first missed.
    """
    of = pixels.filter(F.col("z") == zoom).select("x", "y", "px", "py", "elev")
    need = corners(points, zoom, side)
    own = of.select(F.col("x").alias("x0"), F.col("y").alias("y0"), "px", "py", F.col("elev").alias("__own"))
    met = need.join(of, ["x", "y", "px", "py"], "left")
    found = met.filter("elev is not null").select("pid", "w", "elev").unionByName(met.filter("elev is null").drop("elev").join(own, ["x0", "y0", "px", "py"], "left").select("pid", "w", F.col("__own").alias("elev")))
    value = found.groupBy("pid").agg(F.count("elev").alias("__n"), F.sum(F.col("w") * F.col("elev")).alias("__v"))
    meters = F.lit(2 * math.pi * geo.EARTH_RADIUS) * F.cos(F.radians("lat")) / (2**zoom * side)
    out = points.join(value, "pid", "left")
    return out.select(*points.columns, F.when(F.col("__n") == 4, F.bround("__v", 2)).alias("elevation"), F.lit(zoom).alias("zoom"), F.bround(meters, 3).alias("meters_per_pixel"))
