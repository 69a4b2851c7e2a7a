"""What a camera sees: rays over a raster, the running horizon, and scores of the view."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.sources.shared import checkpointed

# Fixed values.
RAYS, STEPS, BINS = 90, 40, 8
WEIGHTS = {"richness": 0.20, "entropy": 0.15, "skyline": 0.20, "prospect": 0.15, "depth": 0.10, "mystery": 0.10, "water": 0.10}


def rays(cameras: DataFrame, height: int, width: int, n: int = RAYS, steps: int = STEPS) -> DataFrame:
    """Samples inside the grid: ``cameras`` (vp_id, area, lat, lng, alt, head, fov, bounds b and others) with ray, step, dist, row and col."""
    c = cameras.withColumn("ray", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    c = c.withColumns({"dist": geo.diagonal(F.col("b")) * F.col("step") / steps, "__az": F.col("head") - F.col("fov") / 2 + F.col("fov") * F.col("ray") / (n - 1.0)})
    c = c.withColumn("__p", geo.destination(F.col("lat"), F.col("lng"), F.col("__az"), F.col("dist"))).withColumn("__g", geo.geo_to_grid(F.col("__p.lat"), F.col("__p.lng"), F.col("b"), height, width))
    c = c.withColumns({"row": F.bround("__g.row").cast("int"), "col": F.bround("__g.col").cast("int")})
    return c.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).drop("__az", "__p", "__g", "lat", "lng", "head", "fov", "b")


def packed(cells: DataFrame, height: int, width: int) -> DataFrame:
    """(area, cells): an area's cells as one array in reading order, null where a cell is missing. A raster's size bounds it."""
    values = [x for x in cells.columns if x not in ("area", "row", "col")]
    i = (F.col("row") * width + F.col("col")).cast("long")
    every = cells.select("area").distinct().crossJoin(cells.sparkSession.range(height * width).select(F.col("id").alias("i")))
    placed = cells.select("area", i.alias("i"), F.struct(*values).alias("cell"))
    rows = every.join(placed, ["area", "i"], "left").groupBy("area").agg(F.array_sort(F.collect_list(F.struct("i", "cell"))).alias("all"))
    return rows.select("area", F.col("all.cell").alias("cells"))


SLICES = 8


def views(cameras: DataFrame, cells: DataFrame, height: int, width: int, n: int = RAYS, steps: int = STEPS, sliced: bool = False) -> DataFrame:
    """What each camera sees: samples of its rays with the cells' columns, the angle to each, and whether it rises above all before it on its ray.

    ``sliced`` leaves the column ``slice``: what is grouped by area, slice and more isn't shuffled.

    Rasters go to their cameras as arrays, in which samples look their cells up,
    and rays are compared where they were made: no sample is shuffled. The
    cameras of an area are dealt over ``SLICES`` parts, each with the raster once,
    so an area with many cameras is no single task.
    """
    parts = int(cameras.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = [x for x in cells.columns if x not in ("area", "row", "col")]
    own = cameras.select("vp_id", "area", "lat", "lng", "alt", "head", "fov", "b", F.pmod(F.xxhash64("vp_id"), F.lit(SLICES)).alias("slice"))
    rasters = own.select("area", "slice").distinct().join(packed(cells, height, width), "area")
    met = own.repartition(parts, "area", "slice").join(rasters.repartition(parts, "area", "slice"), ["area", "slice"])
    found = rays(met, height, width, n, steps).withColumn("cell", F.get("cells", F.col("row") * width + F.col("col"))).drop("cells").filter("cell IS NOT NULL")
    seen = found.select("vp_id", "area", "slice", "alt", "ray", "step", "dist", "row", "col", *[F.col("cell")[v].alias(v) for v in values]).withColumn("angle", F.atan2(F.col("elev") - F.col("alt"), F.col("dist")))
    # Keyed by what the join has dealt the rows by, and the ray.
    before = F.max("angle").over(W.partitionBy("area", "slice", "vp_id", "ray").orderBy("step").rowsBetween(W.unboundedPreceding, -1))
    out = seen.withColumn("visible", F.col("angle") > F.coalesce(before, F.lit(-math.pi / 2)))
    return out if sliced else out.drop("slice")


def entropy(count: Column, total: Column) -> Column:
    """The summand -p ln p."""
    return F.when(count > 0, -(count / total) * F.ln(count / total)).otherwise(F.lit(0.0))


def terrain_entropy(view: DataFrame) -> DataFrame:
    """Entropy of visible elevations over eight equal bins, by ln 8; each cell once."""
    cells = view.filter("visible").select("vp_id", "row", "col", "elev").distinct()
    ends = cells.groupBy("vp_id").agg(F.min("elev").alias("lo"), F.max("elev").alias("hi"), F.count(F.lit(1)).alias("n"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("elev") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))).otherwise(F.lit(0))
    return cells.join(ends, "vp_id").groupBy("vp_id", b.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n")).groupBy("vp_id").agg((F.sum(entropy(F.col("k"), F.col("n"))) / math.log(BINS)).alias("entropy"))


def richness(view: DataFrame, interest: DataFrame) -> DataFrame:
    """Interest of the visible cells over that of the whole area."""
    total = interest.groupBy("area").agg(F.sum("interest").alias("total"))
    seen = view.filter("visible").select("vp_id", "area", "row", "col").distinct().join(interest, ["area", "row", "col"]).groupBy("vp_id", "area").agg(F.sum("interest").alias("seen"))
    return seen.join(total, "area").select("vp_id", F.when(F.col("total") > 0, F.col("seen") / F.col("total")).otherwise(F.lit(0.0)).alias("richness"))


def box_dimension(profiles: DataFrame, keys: list[str], order: str, value: str, n: int) -> DataFrame:
    """Box-counting dimension of profiles of n values: slope of ln(boxes) on ln(scale), the last box of a scale may be cut short; 1 where flat."""
    scaled = profiles.withColumns({"__lo": F.min(value).over(W.partitionBy(*keys)), "__hi": F.max(value).over(W.partitionBy(*keys))})
    scaled = scaled.select(*keys, F.col(order).alias("__i"), F.when(F.col("__hi") - F.col("__lo") >= 1e-12, (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).alias("__v"))
    sizes = F.array(*[F.lit(2**k) for k in range(1, int(math.log2(n // 2)) + 1)])
    boxes = scaled.withColumn("__s", F.explode(sizes)).groupBy(*keys, "__s", F.floor(F.col("__i") / F.col("__s")).alias("__seg")).agg(F.max("__v").alias("__hi"), F.min("__v").alias("__lo"))
    counts = boxes.groupBy(*keys, "__s").agg(F.sum(F.floor(F.col("__hi") * n / F.col("__s")) - F.floor(F.col("__lo") * n / F.col("__s")) + 1).alias("__k"))
    return counts.groupBy(*keys).agg(F.coalesce(F.regr_slope(F.ln("__k"), F.ln(F.lit(float(n)) / F.col("__s"))), F.lit(1.0)).alias("dimension"))


def depth_layers(view: DataFrame) -> DataFrame:
    """Entropy of visible interest over near, middle and far thirds of the farthest visible distance, by ln 3. ``view`` has interest."""
    far = view.filter("visible").groupBy("vp_id").agg(F.max("dist").alias("far"))
    third = F.least(F.floor(F.col("dist") / F.col("far") * 3), F.lit(2))
    parts = view.filter("visible").join(far, "vp_id").groupBy("vp_id", third.alias("third")).agg(F.sum("interest").alias("k"))
    return parts.withColumn("n", F.sum("k").over(W.partitionBy("vp_id"))).groupBy("vp_id").agg((F.sum(F.when(F.col("n") > 0, entropy(F.col("k"), F.col("n"))).otherwise(F.lit(0.0))) / math.log(3)).alias("depth"))


def total(scores: DataFrame) -> DataFrame:
    """Adds the weighted total of the seven scores; absent ones count as 0."""
    return scores.withColumn("total", sum((F.coalesce(F.col(n), F.lit(0.0)) * w for n, w in WEIGHTS.items()), F.lit(0.0)))


def skyline(view: DataFrame, cameras: DataFrame, n: int = RAYS) -> DataFrame:
    """Highest angle of every ray (vp_id, ray, angle); rays without a sample lie straight down."""
    every = cameras.select("vp_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("ray"))
    top = view.groupBy("vp_id", "ray").agg(F.max("angle").alias("angle"))
    return every.join(top, ["vp_id", "ray"], "left").fillna(-math.pi / 2, ["angle"])


def skyline_score(dimension: Column) -> Column:
    """How near a skyline's dimension is to 1.3."""
    return F.exp(-(dimension - 1.3) * (dimension - 1.3) / (2 * 0.15**2))


def reach(b: Column, side: int, meters: float = 500.0) -> tuple[Column, Column]:
    """Rows and columns of a raster that cover ``meters``."""
    ns, ew = geo.spans(b)
    return F.ceil(F.lit(meters) / (ns / (side - 1))).cast("int"), F.ceil(F.lit(meters) / (ew / (side - 1))).cast("int")


def prospect_refuge(view: DataFrame, cells: DataFrame, cameras: DataFrame) -> DataFrame:
    """Harmonic mean of the share of cells seen and of the share of higher cells around the camera. ``cameras``: vp_id, area, alt, row, col, rows, cols (how far around)."""
    size = cells.groupBy("area").agg(F.count(F.lit(1)).alias("all"))
    seen = view.filter("visible").select("vp_id", "area", "row", "col").distinct().groupBy("vp_id", "area").agg(F.count(F.lit(1)).alias("seen")).join(size, "area").select("vp_id", (F.col("seen") / F.col("all")).alias("prospect"))
    step = lambda n: F.explode(F.sequence(-F.col(n), F.col(n)))
    around = cameras.withColumn("__r", step("rows")).withColumn("__c", step("cols")).select("vp_id", "area", "alt", (F.col("row") + F.col("__r")).alias("row"), (F.col("col") + F.col("__c")).alias("col"))
    refuge = around.join(cells.select("area", "row", "col", "elev").hint("merge"), ["area", "row", "col"]).groupBy("vp_id").agg(F.avg((F.col("elev") > F.col("alt")).cast("int")).alias("refuge"))
    both = cameras.select("vp_id").join(seen, "vp_id", "left").join(refuge, "vp_id", "left").fillna(0.0)
    total_ = F.col("prospect") + F.col("refuge")
    return both.select("vp_id", F.when(total_ > 0, 2 * F.col("prospect") * F.col("refuge") / F.when(total_ > 0, total_)).otherwise(F.lit(0.0)).alias("prospect"))


def water_share(view: DataFrame, water: DataFrame) -> DataFrame:
    """Share of an area's water points (area, row, col; repeats count) that are seen."""
    total_ = water.groupBy("area").agg(F.count(F.lit(1)).alias("all"))
    seen = view.filter("visible").select("vp_id", "area", "row", "col").distinct()
    hit = seen.join(water, ["area", "row", "col"]).groupBy("vp_id").agg(F.count(F.lit(1)).alias("hit"))
    return seen.select("vp_id", "area").distinct().join(total_, "area").join(hit, "vp_id", "left").select("vp_id", (F.coalesce("hit", F.lit(0)) / F.col("all")).alias("water"))


def mystery(view: DataFrame, limits: DataFrame) -> DataFrame:
    """Rays whose next step after the last visible one is of high interest, over the visible cells of high interest. ``limits``: area, p75; ``view`` has interest.

    The view is read once, and with its ``slice`` no sample is shuffled: a ray's last visible
    step and a camera's cells are found where its samples are.
    """
    keys = ["area", *(["slice"] if "slice" in view.columns else []), "vp_id"]
    high = F.col("interest") >= F.col("p75")
    last = F.max(F.when(F.col("visible"), F.col("step"))).over(W.partitionBy(*keys, "ray"))
    seen = view.join(F.broadcast(limits), "area").withColumns({"__hidden": high & (F.col("step") == last + 1), "__shown": high & F.col("visible")})
    # Cells by camera, then cameras: both within what the samples were dealt by.
    cells = seen.groupBy(*keys, "row", "col").agg(F.count_if("__hidden").alias("hidden"), F.max("__shown").alias("shown"))
    both = cells.groupBy(*keys).agg(F.sum("hidden").alias("hidden"), F.count_if("shown").alias("shown")).filter("shown > 0")
    return both.select("vp_id", F.least(F.lit(1.0), F.col("hidden") / F.col("shown")).alias("mystery"))


def all_scores(cameras: DataFrame, surface: DataFrame, water: DataFrame, side: int) -> DataFrame:
    """The seven scores of each camera and their weighted total. ``cameras``: vp_id, area, lat, lng, alt, head, fov, b; ``surface``: cells with elev and interest; ``water``: area, row, col of channel vertices, repeats counted.

    The view is written once, as every score reads it.
    """
    view = checkpointed(views(cameras, surface.select("area", "row", "col", "elev", "interest"), side, side))
    limits = surface.groupBy("area").agg(F.percentile("interest", F.lit(0.75)).alias("p75"))
    rows, cols = reach(F.col("b"), side)
    grid = cameras.withColumn("__g", geo.geo_to_grid(F.col("lat"), F.col("lng"), F.col("b"), side, side)).select("vp_id", "area", "alt", F.bround("__g.row").cast("int").alias("row"), F.bround("__g.col").cast("int").alias("col"), rows.alias("rows"), cols.alias("cols"))
    line = skyline(view, cameras)
    uneven = line.groupBy("vp_id").agg((F.max("angle") - F.min("angle")).alias("range")).filter(F.col("range") >= 1e-12).select("vp_id")
    sky = box_dimension(line.join(uneven, "vp_id"), ["vp_id"], "ray", "angle", RAYS).select("vp_id", skyline_score(F.col("dimension")).alias("skyline"))
    parts = [richness(view, surface.select("area", "row", "col", "interest")), terrain_entropy(view), sky, prospect_refuge(view, surface, grid), depth_layers(view), mystery(view, limits), water_share(view, water)]
    out = cameras.select("vp_id")
    for part in parts:
        out = out.join(part, "vp_id", "left")
    return total(out.fillna(0.0))


def line_of_sight(lines: DataFrame, cells: DataFrame, height: int, width: int, samples: int = 64) -> DataFrame:
    """(vp_id, clear): whether terrain stays below the straight line between two places in cells (r1, c1, alt1, r2, c2, alt2); the ends are passed over."""
    from orograph.operators import stencil

    t = F.col("i") / (samples - 1.0)
    between = lambda a, b: F.col(a) + (F.col(b) - F.col(a)) * t
    points = lines.withColumn("i", F.explode(F.sequence(F.lit(2), F.lit(samples - 3)))).select("vp_id", "area", between("r1", "r2").alias("r"), between("c1", "c2").alias("c"), between("alt1", "alt2").alias("alt"), F.struct("vp_id", "i").alias("pid"))
    ground = stencil.bilinear(points, cells, height, width)
    return ground.groupBy("vp_id").agg((~F.bool_or(F.col("value") > F.col("alt") - 0.5)).alias("clear"))
