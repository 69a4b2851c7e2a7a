"""Queries of scalar operators: tile arithmetic, distances, cameras, lookups.

Points stand for customers: a key gives a place inside a fixed square and a
radius by whole-number arithmetic, so that SQL can build the same points.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph import engine
from orograph.functions import geo, sql
from orograph.plans.registry import ORACLE_SQL, query, table
from orograph.sources import raster

POINTS_SQL = "(SELECT c_custkey AS k, 39.5 + (c_custkey * 7919 % 1000) / 2000.0 AS lat, -105.5 + (c_custkey * 104729 % 1000) / 2000.0 AS lng, 1000.0 + (c_custkey % 50) * 1000.0 AS radius, (c_custkey * 31 % 360) * 1.0 + 0.25 AS head, ((c_custkey * 17) % 40) * 1.0 - 20.0 AS pitch, 20.0 + (c_custkey * 13 % 80) AS fov, 500.0 + (c_custkey * 37 % 2000) AS alt FROM customer)"
BOUNDS_SQL = """(SELECT k, lat, lng, radius,
  GREATEST(LEAST(lat + degrees(radius / 6378137.0), 85.051129), -85.051129) AS north,
  LEAST(GREATEST(lat - degrees(radius / 6378137.0), -85.051129), 85.051129) AS south,
  LEAST(lng + degrees(radius / (6378137.0 * cos(radians(lat)))), 180.0) AS east,
  GREATEST(lng - degrees(radius / (6378137.0 * cos(radians(lat)))), -180.0) AS west FROM """ + POINTS_SQL + " p)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("k"),
        (F.lit(39.5) + (k * 7919 % 1000) / 2000.0).alias("lat"),
        (F.lit(-105.5) + (k * 104729 % 1000) / 2000.0).alias("lng"),
        (F.lit(1000.0) + (k % 50) * 1000.0).alias("radius"),
        ((k * 31 % 360) * 1.0 + 0.25).alias("head"),
        ((k * 17 % 40) * 1.0 - 20.0).alias("pitch"),
        (F.lit(20.0) + k * 13 % 80).alias("fov"),
        (F.lit(500.0) + k * 37 % 2000).alias("alt"),
    )


def with_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).withColumn("b", geo.bounds(F.col("lat"), F.col("lng"), F.col("radius")))


def c(name: str):
    return F.col(name)


def r6(x, name: str):
    return F.round(x, 6).alias(name)


@query("p1_bounds", f"SELECT k, round(north, 6) AS north, round(south, 6) AS south, round(east, 6) AS east, round(west, 6) AS west FROM {BOUNDS_SQL}")
def p1(spark, d):
    return with_bounds(spark, d).select("k", *[r6(c(f"b.{x}"), x) for x in ("north", "south", "east", "west")])


ZOOM_SQL = "(SELECT *, 8 + k % 7 AS z FROM " + POINTS_SQL + " q)"
FRAC_X = "((lng + 180.0) / 360.0) * power(2.0, z)"
FRAC_Y = "(1.0 - ln(tan(radians({lat})) + 1.0 / cos(radians({lat}))) / pi()) / 2.0 * power(2.0, z)"


def zoomed(spark, d):
    return points(spark, d).withColumn("z", (F.lit(8) + c("k") % 7).cast("int"))


@query("p2_tile_index", f"SELECT k, CAST(trunc({FRAC_X}) AS INTEGER) AS tx, CAST(trunc({FRAC_Y.format(lat='lat')}) AS INTEGER) AS ty FROM {ZOOM_SQL} s")
def p2(spark, d):
    return zoomed(spark, d).select("k", geo.tile_x(c("lng"), c("z")).cast("int").alias("tx"), geo.tile_y(c("lat"), c("z")).cast("int").alias("ty"))


CLAMPED = "GREATEST(-85.05, LEAST(85.05, lat))"


@query("p3_tile_fraction", f"SELECT k, round({FRAC_X}, 6) AS fx, round({FRAC_Y.format(lat=CLAMPED)}, 6) AS fy FROM {ZOOM_SQL} s")
def p3(spark, d):
    return zoomed(spark, d).select("k", r6(geo.tile_x(c("lng"), c("z")), "fx"), r6(geo.tile_y(geo.clamp(c("lat"), -85.05, 85.05), c("z")), "fy"))


RANGE_SQL = "(SELECT k, z, " + ", ".join(
    f"CAST(GREATEST(0, LEAST(power(2, z) - 1, trunc({e}))) AS INTEGER) AS {n}"
    for n, e in (
        ("x_min", "((west + 180.0) / 360.0) * power(2.0, z)"),
        ("x_max", "((east + 180.0) / 360.0) * power(2.0, z)"),
        ("y_min", FRAC_Y.format(lat="north")),
        ("y_max", FRAC_Y.format(lat="south")),
    )
)


@query("p4_tile_range", f"{RANGE_SQL[1:]} FROM (SELECT *, 9 + k % 5 AS z FROM {BOUNDS_SQL} b) s")
def p4(spark, d):
    z = (F.lit(9) + c("k") % 5).cast("int")
    return with_bounds(spark, d).select("k", (F.lit(9) + c("k") % 5).alias("z"), geo.tile_range(c("b"), z).alias("t")).select("k", "z", "t.*")


@query(
    "p5_tile_bounds",
    "SELECT k, round(degrees(atan(sinh(pi() * (1 - 2.0 * ty / power(2.0, z))))), 6) AS north, round(degrees(atan(sinh(pi() * (1 - 2.0 * (ty + 1) / power(2.0, z))))), 6) AS south, round((tx + 1) / power(2.0, z) * 360.0 - 180.0, 6) AS east, round(tx / power(2.0, z) * 360.0 - 180.0, 6) AS west FROM "
    f"(SELECT k, z, trunc({FRAC_X}) AS tx, trunc({FRAC_Y.format(lat='lat')}) AS ty FROM {ZOOM_SQL} s) t",
)
def p5(spark, d):
    t = zoomed(spark, d).select("k", geo.tile_bounds(c("z"), geo.tile_x(c("lng"), c("z")).cast("int"), geo.tile_y(c("lat"), c("z")).cast("int")).alias("b"))
    return t.select("k", *[r6(c(f"b.{x}"), x) for x in ("north", "south", "east", "west")])


@query("p6_tile_list", f"SELECT k, x, y FROM (SELECT k, x_max, y_min, y_max, unnest(range(x_min, x_max + 1)) AS x FROM ({RANGE_SQL[1:]} FROM (SELECT *, 11 AS z FROM {BOUNDS_SQL} b) s) r) u, LATERAL (SELECT unnest(range(y_min, y_max + 1)) AS y) v")
def p6(spark, d):
    t = with_bounds(spark, d).select("k", geo.tile_range(c("b"), F.lit(11)).alias("t")).select("k", "t.*")
    return t.select("k", "y_min", "y_max", F.explode(F.sequence(c("x_min").cast("long"), c("x_max").cast("long"))).alias("x")).select("k", "x", F.explode(F.sequence(c("y_min").cast("long"), c("y_max").cast("long"))).alias("y"))


@query("a24_fidelity", f"SELECT k AS area, 13 AS zoom_requested, 11 AS zoom_used, 128 AS grid_width, 'bilinear' AS resampling, (x_max - x_min + 1) * (y_max - y_min + 1) AS tile_count FROM ({RANGE_SQL[1:]} FROM (SELECT *, 11 AS z FROM {BOUNDS_SQL} b) s) r")
def a24(spark, d):
    """What an area's raster is made of, from its list of tiles."""
    tiles = p6(spark, d).select(c("k").alias("area"), F.lit(13).alias("zoom_requested"), F.lit(11).alias("zoom"))
    return raster.fidelity(tiles).select("area", "zoom_requested", "zoom_used", "grid_width", "resampling", "tile_count")


@query(
    "p7_adaptive_zoom",
    f"SELECT k, CAST(max(z) AS INTEGER) AS zoom FROM (SELECT k, z, (x_max - x_min + 1) * (y_max - y_min + 1) AS n FROM ({RANGE_SQL[1:]} FROM (SELECT * FROM {BOUNDS_SQL} b, (SELECT unnest(range(0, 14)) AS z) zs) s) r) c WHERE n <= 64 GROUP BY k",
)
def p7(spark, d):
    """The highest zoom up to 13 whose tiles are no more than 64."""
    z = with_bounds(spark, d).select("k", "b", F.explode(F.sequence(F.lit(0), F.lit(13))).alias("z")).select("k", "z", geo.tile_range(c("b"), c("z")).alias("t"))
    n = (c("t.x_max") - c("t.x_min") + 1) * (c("t.y_max") - c("t.y_min") + 1)
    return z.filter(n <= 64).groupBy("k").agg(F.max("z").alias("zoom"))


SPANS = "radians(north - south) * 6378137.0 AS ns, radians(east - west) * 6378137.0 * cos(radians((north + south) / 2)) AS ew"


@query("p8_cell_size", f"SELECT k, round((ns + ew) / 2 / 128, 4) AS cell_m, round(sqrt(ns * ns + ew * ew), 4) AS diagonal_m FROM (SELECT k, {SPANS} FROM {BOUNDS_SQL} b) s")
def p8(spark, d):
    ns, ew = geo.spans(c("b"))
    return with_bounds(spark, d).select("k", F.round((ns + ew) / 2 / 128, 4).alias("cell_m"), F.round(geo.diagonal(c("b")), 4).alias("diagonal_m"))


@query(
    "p9_p10_grid_geo",
    f"SELECT k, round(lat2, 6) AS lat, round(lng2, 6) AS lng, round((north - lat2) / (north - south) * 127.0, 6) AS r, round((lng2 - west) / (east - west) * 127.0, 6) AS c FROM (SELECT *, north - (k % 128) / 127.0 * (north - south) AS lat2, west + (k * 7 % 128) / 127.0 * (east - west) AS lng2 FROM {BOUNDS_SQL} b) s",
)
def p9(spark, d):
    """Cell to place and back; unrounded places go back to the cell."""
    b = with_bounds(spark, d)
    lat = c("b.north") - (c("k") % 128) / 127.0 * (c("b.north") - c("b.south"))
    lng = c("b.west") + (c("k") * 7 % 128) / 127.0 * (c("b.east") - c("b.west"))
    s = b.select("k", "b", lat.alias("lat2"), lng.alias("lng2")).select("k", "lat2", "lng2", geo.geo_to_grid(c("lat2"), c("lng2"), c("b"), 128, 128).alias("g"))
    return s.select("k", r6(c("lat2"), "lat"), r6(c("lng2"), "lng"), r6(c("g.row"), "r"), r6(c("g.col"), "c"))


PAIRS_SQL = "(SELECT k, lat AS lat1, lng AS lng1, 39.5 + (k * 613 % 1000) / 2000.0 AS lat2, -105.5 + (k * 271 % 1000) / 2000.0 AS lng2, head, pitch, fov, alt FROM " + POINTS_SQL + " q)"


def pairs(spark, d):
    return points(spark, d).select("k", c("lat").alias("lat1"), c("lng").alias("lng1"), (F.lit(39.5) + (c("k") * 613 % 1000) / 2000.0).alias("lat2"), (F.lit(-105.5) + (c("k") * 271 % 1000) / 2000.0).alias("lng2"), "head", "pitch", "fov", "alt")


def ends():
    return [c(x) for x in ("lat1", "lng1", "lat2", "lng2")]


@query("p11_haversine", f"SELECT k, round(2 * 6378137.0 * asin(sqrt(power(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng1) / 2), 2))), 4) AS meters FROM {PAIRS_SQL} p")
def p11(spark, d):
    return pairs(spark, d).select("k", F.round(geo.haversine(*ends()), 4).alias("meters"))


@query("p12_planar_distance", f"SELECT k, round(sqrt(power((lat2 - lat1) * 111320.0, 2) + power((lng2 - lng1) * 111320.0 * cos(radians((lat1 + lat2) / 2)), 2)), 4) AS meters FROM {PAIRS_SQL} p")
def p12(spark, d):
    return pairs(spark, d).select("k", F.round(geo.planar(*ends()), 4).alias("meters"))


@query(
    "p13_path_length",
    "SELECT c_nationkey AS path, CAST(round(sum(seg)) AS BIGINT) AS meters FROM (SELECT c_nationkey, k, 6378137.0 * sqrt(power(radians(lng - lag(lng) OVER w) * cos(radians((lat + lag(lat) OVER w) / 2)), 2) + power(radians(lat - lag(lat) OVER w), 2)) AS seg FROM "
    "(SELECT c_nationkey, c_custkey AS k, 39.5 + (c_custkey * 7919 % 1000) / 2000.0 AS lat, -105.5 + (c_custkey * 104729 % 1000) / 2000.0 AS lng FROM customer) p WINDOW w AS (PARTITION BY c_nationkey ORDER BY k)) s GROUP BY c_nationkey HAVING count(seg) > 0",
)
def p13(spark, d):
    """Length of the path through each nation's customers in order."""
    from pyspark.sql import Window as W

    p = points(spark, d).join(table(spark, d, "customer").select(c("c_custkey").alias("k"), "c_nationkey"), "k")
    w = W.partitionBy("c_nationkey").orderBy("k")
    seg = geo.equirectangular(F.lag("lat").over(w), F.lag("lng").over(w), c("lat"), c("lng"))
    return p.select("c_nationkey", seg.alias("seg")).groupBy(c("c_nationkey").alias("path")).agg(F.round(F.sum("seg")).cast("long").alias("meters"), F.count("seg").alias("n")).filter("n > 0").drop("n")


@query("p14_destination", f"SELECT k, round(lat1 + degrees(alt * cos(radians(head)) / 6378137.0), 6) AS lat, round(lng1 + degrees(alt * sin(radians(head)) / (6378137.0 * cos(radians(lat1)))), 6) AS lng FROM {PAIRS_SQL} p")
def p14(spark, d):
    return pairs(spark, d).select("k", geo.destination(c("lat1"), c("lng1"), c("head"), c("alt")).alias("p")).select("k", r6(c("p.lat"), "lat"), r6(c("p.lng"), "lng"))


ENU_SQL = "(SELECT *, radians(lng2 - lng1) * 6378137.0 * cos(radians(lat1)) AS e, radians(lat2 - lat1) * 6378137.0 AS n FROM " + PAIRS_SQL + " q)"


def enu(spark, d):
    return pairs(spark, d).withColumn("enu", geo.to_enu(c("lat2"), c("lng2"), c("lat1"), c("lng1"))).withColumns({"e": c("enu.e"), "n": c("enu.n")})


@query("p16_enu", f"SELECT k, round(e, 4) AS e, round(n, 4) AS n, round(lat1 + degrees(n / 6378137.0), 6) AS lat, round(lng1 + degrees(e / (6378137.0 * cos(radians(lat1)))), 6) AS lng FROM {ENU_SQL} s")
def p16(spark, d):
    return enu(spark, d).withColumn("g", geo.from_enu(c("e"), c("n"), c("lat1"), c("lng1"))).select("k", F.round("e", 4).alias("e"), F.round("n", 4).alias("n"), r6(c("g.lat"), "lat"), r6(c("g.lng"), "lng"))


ECEF = "(6378137.0 / sqrt(1 - 0.00669437999014 * power(sin(radians({lat})), 2)))"


@query(
    "p17_ecef",
    "SELECT k, round(x2 - x1, 4) AS dx, round(y2 - y1, 4) AS dy, round(z2 - z1, 4) AS dz, round(-sin(radians(lng1)) * (x2 - x1) + cos(radians(lng1)) * (y2 - y1), 4) AS e, round(-sin(radians(lat1)) * cos(radians(lng1)) * (x2 - x1) - sin(radians(lat1)) * sin(radians(lng1)) * (y2 - y1) + cos(radians(lat1)) * (z2 - z1), 4) AS n, round(cos(radians(lat1)) * cos(radians(lng1)) * (x2 - x1) + cos(radians(lat1)) * sin(radians(lng1)) * (y2 - y1) + sin(radians(lat1)) * (z2 - z1), 4) AS u FROM (SELECT *, "
    + ", ".join(
        f"({ECEF.format(lat=f'lat{i}')} + alt) * cos(radians(lat{i})) * cos(radians(lng{i})) AS x{i}, ({ECEF.format(lat=f'lat{i}')} + alt) * cos(radians(lat{i})) * sin(radians(lng{i})) AS y{i}, ({ECEF.format(lat=f'lat{i}')} * (1 - 0.00669437999014) + alt) * sin(radians(lat{i})) AS z{i}" for i in (1, 2)
    )
    + f" FROM {PAIRS_SQL} p) s",
)
def p17(spark, d):
    s = pairs(spark, d).select("k", "lat1", "lng1", geo.to_ecef(c("lat1"), c("lng1"), c("alt")).alias("a"), geo.to_ecef(c("lat2"), c("lng2"), c("alt")).alias("b"))
    s = s.select("k", "lat1", "lng1", *[(c(f"b.{x}") - c(f"a.{x}")).alias(f"d{x}") for x in "xyz"]).withColumn("l", geo.ecef_to_enu(c("dx"), c("dy"), c("dz"), c("lat1"), c("lng1")))
    return s.select("k", *[F.round(f"d{x}", 4).alias(f"d{x}") for x in "xyz"], *[F.round(f"l.{x}", 4).alias(x) for x in "enu"])


HEADING = "CASE WHEN degrees(atan2(e, n)) < 0 THEN degrees(atan2(e, n)) + 360 ELSE degrees(atan2(e, n)) END"


@query("p18_p21_heading", f"SELECT k, round(h, 6) AS heading, round(LEAST(abs(h - head), 360 - abs(h - head)), 6) AS delta FROM (SELECT k, head, {HEADING} AS h FROM {ENU_SQL} s) t")
def p18(spark, d):
    return enu(spark, d).withColumn("h", geo.heading(c("e"), c("n"))).select("k", r6(c("h"), "heading"), r6(geo.heading_delta(c("h"), c("head")), "delta"))


@query("p19_pitch", f"SELECT k, round(degrees(atan(((k % 100) / 100.0 - 0.5) * 2 * tan(radians(fov * 9 / 32)))), 6) AS pitch FROM {POINTS_SQL} p")
def p19(spark, d):
    return points(spark, d).select("k", r6(geo.pitch_from_horizon((c("k") % 100) / 100.0, c("fov")), "pitch"))


PROJECTED = f"""(SELECT *, 0.5 + (e * ry0 + n * ry1) / depth / (2 * tan(radians(fov / 2))) AS px, 0.5 - (e * (ry1 * fz) + n * (-ry0 * fz) + du * (ry0 * fy - ry1 * fx)) / depth / (2 * tan(radians(fov * 9 / 32))) AS py FROM (
 SELECT *, fy / sqrt(fx * fx + fy * fy) AS ry0, -fx / sqrt(fx * fx + fy * fy) AS ry1, e * fx + n * fy + du * fz AS depth FROM (
 SELECT *, alt - 1000.0 AS du, sin(radians(head)) / sqrt(1 + power(sin(radians(pitch)), 2)) AS fx, cos(radians(head)) / sqrt(1 + power(sin(radians(pitch)), 2)) AS fy, sin(radians(pitch)) / sqrt(1 + power(sin(radians(pitch)), 2)) AS fz FROM {ENU_SQL} s) a) b)"""


@query("p20_project", f"SELECT k, CASE WHEN ok THEN round(px, 6) END AS x, CASE WHEN ok THEN round(py, 6) END AS y FROM (SELECT *, depth > 0 AND px BETWEEN 0 AND 1 AND py BETWEEN 0 AND 1 AS ok FROM {PROJECTED} q) z")
def p20(spark, d):
    return enu(spark, d).select("k", geo.project(c("e"), c("n"), c("alt") - 1000.0, c("head"), c("pitch"), c("fov")).alias("p")).select("k", r6(c("p.x"), "x"), r6(c("p.y"), "y"))


@query("p22_compass", f"SELECT k, (['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'])[CAST(round_even(head / 22.5, 0) AS INTEGER) % 16 + 1] AS compass FROM {POINTS_SQL} p")
def p22(spark, d):
    return points(spark, d).select("k", geo.compass(c("head")).alias("compass"))


@query("p25_clamped_adjustments", f"SELECT k, CAST(GREATEST(-15.0, LEAST(15.0, head - 180)) AS DOUBLE) AS heading, CAST(GREATEST(-10.0, LEAST(10.0, pitch)) AS DOUBLE) AS pitch, CAST(GREATEST(-200.0, LEAST(200.0, alt - 1500)) AS DOUBLE) AS altitude, CAST(GREATEST(-5.0, LEAST(5.0, fov - 60)) AS DOUBLE) AS fov FROM {POINTS_SQL} p")
def p25(spark, d):
    return points(spark, d).select("k", geo.clamp(c("head") - 180, -15, 15).alias("heading"), geo.clamp(c("pitch"), -10, 10).alias("pitch"), geo.clamp(c("alt") - 1500, -200, 200).alias("altitude"), geo.clamp(c("fov") - 60, -5, 5).alias("fov"))


@query("p26_fractal_score", f"SELECT k, round(exp(-power(1.0 + (k % 100) / 100.0 - 1.3, 2) / (2 * power(0.15, 2))), 6) AS score FROM {POINTS_SQL} p")
def p26(spark, d):
    fd = F.lit(1.0) + (c("k") % 100) / 100.0
    return points(spark, d).select("k", r6(F.exp(-(fd - 1.3) * (fd - 1.3) / (2 * 0.15**2)), "score"))


@query("p27_p28_agl", f"SELECT k, round(GREATEST(alt, g + 5), 2) AS effective, alt < g + 5 AS clamped, round(GREATEST(alt, g + 5) - g, 2) AS clearance, round(alt - g, 2) AS agl FROM (SELECT *, 400.0 + (k * 53 % 1500) AS g FROM {POINTS_SQL} p) s")
def p27(spark, d):
    g = F.lit(400.0) + c("k") * 53 % 1500
    s = points(spark, d).select("k", geo.agl_clamp(c("alt"), g, F.lit(5.0)).alias("s"), F.bround(c("alt") - g, 2).alias("agl"))
    return s.select("k", "s.*", "agl")


@query("p43_camera_validation", f"SELECT k, lat BETWEEN -90 AND 90 AND lng BETWEEN -180 AND 180 AND alt > 0 AND fov BETWEEN 20 AND 60 AS valid, CASE WHEN fov < 20 OR fov > 60 THEN 'fov' ELSE '' END AS errors FROM {POINTS_SQL} p")
def p43(spark, d):
    ok_fov = c("fov").between(20, 60)
    return points(spark, d).select("k", (c("lat").between(-90, 90) & c("lng").between(-180, 180) & (c("alt") > 0) & ok_fov).alias("valid"), F.when(~ok_fov, "fov").otherwise("").alias("errors"))


@query("api14_problems", """SELECT k, 422 AS status, 'invalid: ' || concat_ws(', ', CASE WHEN k % 11 = 0 THEN 'lat' END, CASE WHEN k % 13 = 0 THEN 'lng' END, CASE WHEN k % 17 = 0 OR 1000.0 + (k % 50) * 1100.0 > 50000 THEN 'radius_m' END) AS detail
FROM (SELECT c_custkey AS k FROM customer) s WHERE k % 11 = 0 OR k % 13 = 0 OR k % 17 = 0 OR 1000.0 + (k % 50) * 1100.0 > 50000""")
def api14(spark, d):
    """Requests that can't be served, set aside as rows with what is wrong; places out of range, missing ones, radii too large."""
    k = c("k")
    asked = points(spark, d).select("k", F.when(k % 11 == 0, 91.0).otherwise(c("lat")).alias("lat"), F.when(k % 13 != 0, c("lng")).alias("lng"), F.when(k % 17 == 0, 10.0).otherwise(F.lit(1000.0) + (k % 50) * 1100.0).alias("radius_m"))
    return engine.problems(asked).select("k", "status", "detail")


def said(spark, d, name: str, frame, text: str):
    """SQL text over a frame, with the engine's functions."""
    sql.register(spark)
    return spark.sql(text, **{name: frame})


@query("p2_sql_text", ORACLE_SQL["p2_tile_index"])
def p2_text(spark, d):
    return said(spark, d, "places", zoomed(spark, d), "SELECT k, CAST(oro_tile_x(lng, z) AS INT) AS tx, CAST(oro_tile_y(lat, z) AS INT) AS ty FROM {places}")


@query("p6_sql_text", ORACLE_SQL["p6_tile_list"])
def p6_text(spark, d):
    """The tile list as a table function, joined laterally."""
    return said(spark, d, "places", points(spark, d), "SELECT k, x, y FROM {places} p, LATERAL oro_tiles(p.lat, p.lng, p.radius, 11)")


@query("p11_sql_text", ORACLE_SQL["p11_haversine"])
def p11_text(spark, d):
    lat1, lng1, lat2, lng2 = ends()
    frame = pairs(spark, d).select("k", lat1.alias("lat1"), lng1.alias("lng1"), lat2.alias("lat2"), lng2.alias("lng2"))
    return said(spark, d, "pairs", frame, "SELECT k, round(oro_haversine(lat1, lng1, lat2, lng2), 4) AS meters FROM {pairs}")
