"""Neighbourhood operators on rasters: separable passes of window frames within an area's rows and columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F



def across():
    """Cells of a row, west to east."""
    return W.partitionBy("area", "row").orderBy("col")


def down():
    """Cells of a column, north to south."""
    return W.partitionBy("area", "col").orderBy("row")


def difference(x: str, along, cell: float) -> Column:
    """Central difference, one-sided at edges."""
    back, ahead = F.lag(x).over(along), F.lead(x).over(along)
    steps = F.when(back.isNull() | ahead.isNull(), F.lit(1.0)).otherwise(F.lit(2.0))
    return (F.coalesce(ahead, F.col(x)) - F.coalesce(back, F.col(x))) / (steps * cell)


def gradient(cells: DataFrame, cell: float, x: str = "elev") -> DataFrame:
    """Adds dx (along columns) and dy (along rows)."""
    return cells.withColumn("dx", difference(x, across(), cell)).withColumn("dy", difference(x, down(), cell))


def slope(cells: DataFrame, cell: float) -> DataFrame:
    """Adds dx, dy and the slope in degrees."""
    return gradient(cells, cell).withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))))


def curvature(cells: DataFrame, cell: float) -> DataFrame:
    """Adds the profile curvature; flat cells have none."""
    g = gradient(cells, cell) if "dx" not in cells.columns else cells
    g = g.withColumn("dxx", difference("dx", across(), cell)).withColumn("dxy", difference("dx", down(), cell)).withColumn("dyy", difference("dy", down(), cell))
    dx, dy = F.col("dx"), F.col("dy")
    steep = dx * dx + dy * dy
    bent = -(dx * dx * F.col("dxx") + 2 * dx * dy * F.col("dxy") + dy * dy * F.col("dyy")) / (steep * F.sqrt(F.lit(1.0) + steep))
    return g.withColumn("curvature", F.when(steep > 1e-8, bent).otherwise(F.lit(0.0))).drop("dxx", "dxy", "dyy")


def moving(cells: DataFrame, x: str, name: str, half: int, of) -> DataFrame:
    """Adds ``of`` (F.max or F.min) over squares of 2 * half + 1 cells; frames end at edges, which for extremes is reflection."""
    return cells.withColumn(name, of(x).over(across().rowsBetween(-half, half))).withColumn(name, of(name).over(down().rowsBetween(-half, half)))


def relief(cells: DataFrame, half: int = 10) -> DataFrame:
    """Adds highest minus lowest within the square."""
    both = moving(moving(cells, "elev", "__high", half, F.max), "elev", "__low", half, F.min)
    return both.withColumn("relief", F.col("__high") - F.col("__low")).drop("__high", "__low")


def kernel(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights from -radius to radius."""
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def gaussian(cells: DataFrame, x: str, name: str, sigma: float) -> DataFrame:
    """Adds the Gaussian mean with mirrored edges (the edge cell repeats): along columns first, then rows.

    The mirror place of a cell beyond an edge is no farther than the kernel
    reaches, so a cell needs its neighbours along the line only, not the line.
    """
    weights = kernel(sigma)
    half = len(weights) // 2
    out = cells
    for partition, place, source in ((("area", "col"), "row", x), (("area", "row"), "col", name)):
        along = W.partitionBy(*partition).orderBy(place)
        near = F.array(*[F.lag(source, -k).over(along) if k < 0 else F.lead(source, k).over(along) if k else F.col(source) for k in range(-half, half + 1)])
        out = out.withColumns({"__near": near, "__n": F.count(F.lit(1)).over(W.partitionBy(*partition))})

        def mirrored(k: int, place: str = place) -> Column:
            m = F.pmod(F.col(place) + k, 2 * F.col("__n")).cast("int")
            return F.least(m, (2 * F.col("__n")).cast("int") - 1 - m) - F.col(place) + half

        total = F.lit(0.0)
        for k, w in enumerate(weights):
            total = total + F.lit(w) * F.get("__near", mirrored(k - half))
        out = out.withColumn(name, total).drop("__near", "__n")
    return out


def normalised(cells: DataFrame, x: str, name: str) -> DataFrame:
    """Adds x scaled to 0..1 within the area; 0 where it is constant."""
    w = W.partitionBy("area")
    low, high = F.min(x).over(w), F.max(x).over(w)
    return cells.withColumn(name, F.when(high - low < 1e-12, F.lit(0.0)).otherwise((F.col(x) - low) / (high - low)))


def dilated(mask: DataFrame, cells: DataFrame) -> DataFrame:
    """Cells (area, row, col) of a mask and those of their four neighbours that ``cells`` have."""
    moves = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))])
    moved = mask.select("area", "row", "col", F.explode(moves).alias("m")).select("area", (F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"))
    return moved.distinct().join(cells.select("area", "row", "col"), ["area", "row", "col"], "left_semi")


def bilinear(points: DataFrame, cells: DataFrame, height: int, width: int) -> DataFrame:
    """Adds ``value`` to points (area, r, c: fractional, clamped): four cells by one equi-join and an aggregate.

    ``points`` needs a column ``pid`` that is unique. Both sides are shuffled, as points that were made from few rows would be taken for few.
    """
    r, c = F.greatest(F.lit(0.0), F.least(F.lit(height - 1.0), F.col("r"))), F.greatest(F.lit(0.0), F.least(F.lit(width - 1.0), F.col("c")))
    p = points.select("pid", "area", r.alias("__r"), c.alias("__c")).withColumns({"__r0": F.least(F.floor("__r"), F.lit(height - 2)).cast("int"), "__c0": F.least(F.floor("__c"), F.lit(width - 2)).cast("int")})
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    q = p.withColumn("q", F.explode(corners)).select("pid", "area", (F.col("__r0") + F.col("q.i")).alias("row"), (F.col("__c0") + F.col("q.j")).alias("col"), ((F.lit(1.0) - F.abs(F.col("__r") - F.col("__r0") - F.col("q.i"))) * (F.lit(1.0) - F.abs(F.col("__c") - F.col("__c0") - F.col("q.j")))).alias("w"))
    value = q.join(cells.select("area", "row", "col", "elev").hint("merge"), ["area", "row", "col"]).groupBy("pid").agg(F.sum(F.col("w") * F.col("elev")).alias("value"))
    return points.join(value, "pid", "left")
