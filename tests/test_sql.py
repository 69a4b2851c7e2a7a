"""The engine's functions in SQL text: their plans, the generators, the fold; and verification of a view's own anchors."""

import math

from pyspark.sql import functions as F

from orograph.functions import geo, sql
from orograph.operators import previews


def test_filters_reach_the_scan_through_functions(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "39.5 + id / 2000.0 AS lat", "-105.0 + id / 3000.0 AS lng", "id % 7 AS other").write.parquet(str(tmp_path / "p"))
    sql.register(spark)
    spark.read.parquet(str(tmp_path / "p")).createOrReplaceTempView("sql_places")
    scalar = spark.sql("SELECT k, oro_haversine(lat, lng, 40, -105) AS m FROM sql_places WHERE k < 10 AND oro_tile_x(lng, 11) > 1")
    table = spark.sql("SELECT k, x, y FROM sql_places p, LATERAL oro_tiles(p.lat, p.lng, 2000, 12) WHERE k = 5")
    for df, wanted in ((scalar, "LessThan(k,10)"), (table, "EqualTo(k,5)")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert wanted in plan and "other" not in plan and "Python" not in plan
    assert scalar.count() == 10
    t = spark.range(1).select(geo.tile_range(geo.bounds(F.lit(39.5025), F.lit(-105.0 + 5 / 3000.0), F.lit(2000.0)), F.lit(12)).alias("t")).first()["t"]
    assert {(r["x"], r["y"]) for r in table.collect()} == {(x, y) for x in range(t["x_min"], t["x_max"] + 1) for y in range(t["y_min"], t["y_max"] + 1)}


def test_scalar_functions_equal_columns(spark):
    sql.register(spark)
    df = spark.range(200).selectExpr("CAST(id AS INT) % 14 AS z", "CAST(-80 + id * 0.8 AS DOUBLE) AS lat", "CAST(-179 + id * 1.7 AS DOUBLE) AS lng", "CAST(1000 + id * 300 AS DOUBLE) AS r", "CAST(id * 7 % 360 AS DOUBLE) AS h")
    lat, lng, z, r, h = map(F.col, ("lat", "lng", "z", "r", "h"))
    pairs = {
        "oro_tile_x(lng, z)": geo.tile_x(lng, z), "oro_tile_y(lat, z)": geo.tile_y(lat, z), "oro_bounds(lat, lng, r).east": geo.bounds(lat, lng, r)["east"], "oro_bounds(lat, lng, r).south": geo.bounds(lat, lng, r)["south"],
        "CAST(oro_tile_range(oro_bounds(lat, lng, r), z).y_max AS DOUBLE)": geo.tile_range(geo.bounds(lat, lng, r), z)["y_max"].cast("double"), "oro_haversine(lat, lng, 1, 2)": geo.haversine(lat, lng, F.lit(1.0), F.lit(2.0)),
        "oro_destination(lat, lng, h, r).lng": geo.destination(lat, lng, h, r)["lng"], "oro_heading_delta(h, 10)": geo.heading_delta(h, F.lit(10.0)), "oro_elevation(z, 3, 128)": z * 256.0 + 3 - 32767.5,
    }
    made = df.select(*[F.expr(text).alias(f"a{i}") for i, text in enumerate(pairs)], *[x.alias(f"b{i}") for i, x in enumerate(pairs.values())])
    for row in made.collect():
        for i, text in enumerate(pairs):
            assert math.isclose(row[f"a{i}"], row[f"b{i}"], rel_tol=1e-9, abs_tol=1e-7), text


def test_generators_and_fold(spark):
    sql.register(spark)
    windows = {tuple(r) for r in spark.sql("SELECT * FROM oro_windows(10, 13, 4, 3)").collect()}
    assert windows == {(r, c) for r in range(0, 7, 3) for c in range(0, 10, 3)}
    assert spark.sql("SELECT * FROM oro_windows(3, 13, 4, 3)").count() == 0
    rays = spark.sql("SELECT p.id, ray, step, at FROM (SELECT 7 AS id, 40D AS lat, -105D AS lng) p, LATERAL oro_rays(p.lat, p.lng, 4, 3, 100)").collect()
    assert {(r["ray"], r["step"]) for r in rays} == {(a, s) for a in range(4) for s in range(1, 4)}
    north = next(r["at"] for r in rays if (r["ray"], r["step"]) == (0, 3))
    assert math.isclose(north["lat"], 40 + math.degrees(300 / 6378137.0)) and north["lng"] == -105
    rows = [("a", i, "text" if i % 3 else "tool", f"{i} ") for i in range(9)] + [("b", 0, None, None), ("b", 1, None, "x")]
    spark.createDataFrame(rows, "key string, place int, kind string, text string").repartition(4).createOrReplaceTempView("sql_events")
    found = spark.sql("SELECT * FROM oro_fold(TABLE(SELECT key, place, kind, text FROM sql_events) PARTITION BY key ORDER BY place)").collect()
    assert sorted((r["part"], r["kind"] or "", r["text"]) for r in found) == sorted([(1, "tool", "0 "), (2, "text", "1 2 "), (3, "tool", "3 "), (4, "text", "4 5 "), (5, "tool", "6 "), (6, "text", "7 8 "), (1, "", "x")])


def test_anchors_of_views_against_plain_projection(spark):
    """A view to the north: an anchor ahead at the wanted point, one off, one behind; no anchors; a template that isn't supported; the last decimal."""
    anchor = lambda lat, lng, x=0.5, y=0.5: {"lat": lat, "lng": lng, "alt_meters": 1000.0, "desired_normalized_x": x, "desired_normalized_y": y}
    ahead, behind = anchor(40.05, -105.0), anchor(39.95, -105.0)
    cases = {
        "near": ([ahead], "rule_of_thirds", 0.5), "off": ([ahead, anchor(40.05, -105.0, 0.75, 0.5)], "rule_of_thirds", None), "behind": ([behind], "golden_ratio", None), "none": ([], "rule_of_thirds", 0.5), "null": (None, "rule_of_thirds", 0.5), "line": ([ahead], "leading_line", 0.5)}
    rows = [(k, 40.0, -105.0, 1000.0, 0.0, 0.0, 0.0, 50.0, 1920, 1080, t, h, a) for k, (a, t, h) in cases.items()]
    schema = "k string, lat double, lng double, alt double, head double, pitch double, roll double, fov double, width int, height int, template string, horizon_ratio double, anchors array<struct<lat double, lng double, alt_meters double, desired_normalized_x double, desired_normalized_y double>>"
    got = {r["k"]: r["verification"] for r in previews.verified(spark.createDataFrame(rows, schema)).collect()}
    assert {k: v["status"] for k, v in got.items()} == {"near": "verified", "off": "failed", "behind": "failed", "none": "skipped", "null": "skipped", "line": "unsupported_template"}
    assert got["near"]["horizon_error_px"] == 0.0 and got["near"]["mean_anchor_error_px"] < 10 and got["near"]["passes_threshold"]
    assert got["behind"]["mean_anchor_error_px"] == round(math.hypot(1920, 1080), 1) and got["behind"]["notes"] == "Mean anchor error 2202.9px exceeds 80.0px threshold."
    assert got["off"]["mean_anchor_error_px"] > 200 and got["off"]["horizon_error_px"] is None and got["line"]["mean_anchor_error_px"] is None
