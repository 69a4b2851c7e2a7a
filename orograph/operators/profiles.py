"""Profiles along paths: sampling, smoothing, and the viewing distance that suits a ridge."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.operators import stencil, visibility
from orograph.operators.viewpoints import LEAST_M, MOST_M

# Fixed values.
SAMPLES, SCALES_M, TARGET_DIMENSION = 64, (150.0, 300.0, 600.0, 1200.0), 1.3


def arc_lengths(path: Column) -> Column:
    """Lengths along a path of places up to each vertex, in degrees."""
    steps = F.zip_with(F.slice(path, F.lit(2), F.size(path)), F.slice(path, F.lit(1), F.size(path) - 1), lambda a, b: F.sqrt((a["lat"] - b["lat"]) * (a["lat"] - b["lat"]) + (a["lng"] - b["lng"]) * (a["lng"] - b["lng"])))
    return F.aggregate(steps, F.array(F.lit(0.0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + x))


def along(paths: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """Places (keys, i, lat, lng) at equal arc lengths along ``path`` (lat, lng); a path of one place gives it each time, an empty one none."""
    cut = paths.filter(F.size("path") > 0).select(*keys, "path", arc_lengths(F.col("path")).alias("__arc"))
    cut = cut.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)))).withColumn("__d", F.element_at("__arc", -1) * F.col("i") / (samples - 1.0))
    # The segment: the first whose end isn't before the place, the last at most.
    passed = F.size(F.filter(F.slice("__arc", F.lit(2), F.greatest(F.size("__arc") - 2, F.lit(0))), lambda x: x < F.col("__d")))
    cut = cut.withColumn("__k", passed)
    a, b = F.get("path", F.col("__k")), F.coalesce(F.get("path", F.col("__k") + 1), F.get("path", F.col("__k")))
    from_, to = F.get("__arc", F.col("__k")), F.coalesce(F.get("__arc", F.col("__k") + 1), F.get("__arc", F.col("__k")))
    t = F.when(to - from_ < 1e-12, F.lit(0.0)).otherwise((F.col("__d") - from_) / (to - from_))
    return cut.select(*keys, "i", (a["lat"] + t * (b["lat"] - a["lat"])).alias("lat"), (a["lng"] + t * (b["lng"] - a["lng"])).alias("lng"))


def profiles(paths: DataFrame, keys: list[str], cells: DataFrame, side: int) -> DataFrame:
    """Elevations of the nearest cells along paths: keys, i, elev. ``paths``: keys (with area), b, path."""
    from orograph.functions import geo

    places = along(paths, [*keys, "b"])
    near = places.withColumn("g", geo.geo_to_grid(F.col("lat"), F.col("lng"), F.col("b"), side, side))
    whole = lambda x: F.greatest(F.lit(0), F.least(F.lit(side - 1), F.bround(x).cast("int")))
    return near.withColumns({"row": whole("g.row"), "col": whole("g.col")}).join(cells.select("area", "row", "col", "elev"), ["area", "row", "col"]).select(*keys, "i", "elev")


def mirrored_weights(cells: int, n: int = SAMPLES) -> list[list[float]]:
    """What each of n samples weighs in the Gaussian mean (sigma a third of ``cells``) at each other: places beyond the ends are mirrored, as often as the kernel reaches."""
    weights = stencil.kernel(cells / 3.0)
    half = len(weights) // 2
    out = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for k, w in enumerate(weights):
            m = (i + k - half) % (2 * n)
            out[i][min(m, 2 * n - 1 - m)] += w
    return out


def smoothed(profile: DataFrame, keys: list[str], widths: list[int]) -> DataFrame:
    """Profiles (keys, i, elev) smoothed over several widths: keys, n (number of the width), i, value. The weights are a table of fixed size."""
    rows = [(n, i, row) for n, cells in enumerate(widths) for i, row in enumerate(mirrored_weights(cells))]
    weights = profile.sparkSession.createDataFrame(rows, "n int, i int, weights array<double>")
    line = profile.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "elev"))), lambda x: x["elev"]).alias("line"))
    mean = F.aggregate(F.zip_with("line", "weights", lambda x, w: x * w), F.lit(0.0), lambda s, x: s + x)
    return line.join(F.broadcast(weights), how="cross").select(*keys, "n", "i", mean.alias("value"))


def viewing_distances(paths: DataFrame, keys: list[str], cells: DataFrame, side: int, cell_m: float, fov: float) -> DataFrame:
    """Keys and the distance at which a ridge's outline is as rough as suits: the scale whose smoothed profile has a dimension nearest TARGET_DIMENSION, the first of equals."""
    raw = profiles(paths, keys, cells, side)
    rough = visibility.box_dimension(smoothed(raw, keys, [max(1, int(scale / cell_m)) for scale in SCALES_M]), [*keys, "n"], "i", "value", SAMPLES)
    scale = F.element_at(F.array(*map(F.lit, SCALES_M)), F.col("n") + 1)
    found = rough.select(*keys, F.struct(F.abs(F.col("dimension") - TARGET_DIMENSION).alias("miss"), "n", scale.alias("scale")).alias("s"))
    best = found.groupBy(*keys).agg(F.min("s")["scale"].alias("scale"))
    return best.select(*keys, F.greatest(F.lit(LEAST_M), F.least(F.lit(MOST_M), F.col("scale") / math.tan(math.radians(fov) / 2))).alias("distance"))
