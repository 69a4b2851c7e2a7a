"""Operators on analytic rasters, engine entry points, and streams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph import engine
from orograph.functions import geo
from orograph.operators import features, hydro, stencil, style, viewpoints, visibility
from orograph.sources import raster
from orograph.streaming import logs

SIDE = 64


def surface(spark, expression):
    return raster.closed_form(spark, SIDE, expression)


def test_flat_and_ramp_derivatives(spark):
    flat = stencil.curvature(stencil.slope(surface(spark, F.lit(500.0)), 78.0), 78.0).agg(F.max("slope"), F.max(F.abs("curvature"))).first()
    assert flat[0] == 0 and flat[1] == 0
    ramp = stencil.slope(surface(spark, F.lit(1000.0) - F.col("row") * 5), 78.0).agg(F.min("slope"), F.max("slope")).first()
    assert ramp[0] == pytest.approx(math.degrees(math.atan(5 / 78))) and ramp[1] == pytest.approx(ramp[0])


def test_gaussian_equals_numpy(spark):
    cells = surface(spark, F.col("row") * F.col("col") % 17 + F.sin(F.col("col")))
    found = stencil.gaussian(cells, "elev", "g", 2.0).toPandas()
    grid, out = hydro.grid_of(found, "elev"), hydro.grid_of(found, "g")
    weights = np.array(stencil.kernel(2.0))
    for axis in (0, 1):
        padded = np.pad(grid, [(8, 8) if k == axis else (0, 0) for k in (0, 1)], mode="symmetric")
        grid = np.apply_along_axis(lambda v: np.convolve(v, weights, "valid"), axis, padded)
    assert np.abs(grid - out).max() < 1e-9


def test_cone_has_its_peak_and_plateaus_count_once(spark):
    cone = surface(spark, F.greatest(F.lit(1000.0), F.lit(2000.0) - 24 * F.sqrt((F.col("row") - 32) * (F.col("row") - 32) + (F.col("col") - 32) * (F.col("col") - 32))))
    found = features.peaks(cone, 50).collect()
    assert len(found) == 1 and (found[0]["r"], found[0]["c"]) == (32, 32) and found[0]["score"] == 1.0
    flat_top = surface(spark, F.when(F.col("row").between(20, 29) & F.col("col").between(20, 29), 2000.0).otherwise(1000.0))
    found = features.peaks(flat_top, 50).collect()
    assert len(found) == 1 and found[0]["elev"] == 2000.0


def test_valley_channel_ridge_and_step(spark):
    valley = surface(spark, F.lit(1000.0) + 10 * F.abs(F.col("col") - 32) + F.col("row") * 0.5)
    water = features.water_channels(valley, 78.0, 10).collect()
    assert len(water) >= 1 and water[0]["length_m"] > 0 and len(water[0]["path"]) <= hydro.MOST_VERTICES
    ridge = surface(spark, F.lit(1320.0) - 10 * F.abs(F.col("col") - 32) - F.col("row") * 0.5)
    assert features.ridges(ridge, 78.0, 10).count() >= 1
    step = surface(spark, F.when(F.col("col") >= 32, 1500.0).otherwise(1000.0) + F.col("row") * 0.01)
    cliffs = features.cliffs(stencil.curvature(stencil.slope(step, 78.0), 78.0), 5).collect()
    assert cliffs and cliffs[0]["drop_m"] > 0


def test_accumulation_sums_to_cells_at_sinks(spark):
    cells = surface(spark, F.sin(F.col("row") * 0.7) * 50 + F.cos(F.col("col") * 0.9) * 40 + (F.col("row") * 31 + F.col("col") * 17) % 7)
    flow = hydro.flow_direction(cells)
    joined = hydro.accumulation(flow).join(flow, ["area", "row", "col"])
    assert joined.filter("dir = -1").agg(F.sum("acc")).first()[0] == SIDE * SIDE


def test_trace_and_labels():
    assert len(hydro.trace([(i, i) for i in range(2, 8)])) == 6
    branch = hydro.trace([*[(i, 2) for i in range(2, 7)], *[(4, c) for c in range(3, 7)]])
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(branch, branch[1:], strict=False))
    rows, cols = np.array([0, 1, 5]), np.array([0, 1, 5])
    assert hydro.labels(rows, cols).tolist() == [0, 0, 1] and hydro.labels(rows, cols, eight=False).tolist() == [0, 1, 2]


def test_solver_finds_planted_poses(spark):
    """Targets are where known cameras see the anchors: the poses found must show them there, too."""
    rng = np.random.default_rng(3)
    n, fov, horizon = 60, 55.0, 0.382
    pitch = np.full(n, math.degrees(math.atan((horizon - 0.5) * 2 * math.tan(math.radians(fov * 9 / 32)))))
    pose = np.column_stack([rng.uniform(-500, 500, (n, 2)), rng.uniform(300, 600, n), np.zeros(n)])
    anchors = np.stack([np.column_stack([pose[:, 0] + rng.uniform(100, 500, n), pose[:, 1] + rng.uniform(1500, 2500, n), rng.uniform(100, 300, n)]), np.column_stack([pose[:, 0] - rng.uniform(100, 500, n), pose[:, 1] + rng.uniform(1500, 2500, n), rng.uniform(100, 300, n)])], 1)
    seen = viewpoints.misses(pose, anchors, np.zeros((n, 2, 2)), pitch, fov).reshape(n, 2, 2)
    good = (seen < 1).all((1, 2))
    rows = [(i, *map(float, anchors[i].ravel()), *map(float, seen[i].ravel()), horizon, 2000.0, 100.0) for i in range(n) if good[i]]
    pairs = spark.createDataFrame(rows, "k long, e1 double, n1 double, z1 double, e2 double, n2 double, z2 double, x1 double, y1 double, x2 double, y2 double, horizon double, distance double, relief double")
    found = viewpoints.solved(pairs, "k", fov).collect()
    assert len(found) == len(rows) > 30
    assert np.mean([r["accepted"] and r["rms"] < 1e-3 for r in found]) > 0.9
    best = {r["k"]: r for r in found}
    for row in rows:
        r = best[row[0]]
        left = viewpoints.misses(np.array([[r["e"], r["n"], r["z"], r["heading"]]]), np.array([row[1:7]]).reshape(1, 2, 3), np.array([row[7:11]]).reshape(1, 2, 2), pitch[:1], fov)
        assert math.sqrt((left**2).mean()) == pytest.approx(r["rms"], abs=1e-6) and r["accepted"] == (r["rms"] <= viewpoints.MOST_RMS)


def test_wall_hides_what_is_behind(spark):
    cells = surface(spark, F.when(F.col("row").between(18, 21), 5000.0).otherwise(100.0)).withColumn("interest", F.lit(1.0))
    b = F.struct(F.lit(47.05).alias("north"), F.lit(46.95).alias("south"), F.lit(-121.95).alias("east"), F.lit(-122.05).alias("west"))
    camera = spark.range(1).select(F.lit(0).alias("vp_id"), F.lit(0).cast("long").alias("area"), F.lit(47.045).alias("lat"), F.lit(-122.0).alias("lng"), F.lit(110.0).alias("alt"), F.lit(180.0).alias("head"), F.lit(180.0).alias("fov"), b.alias("b"))
    view = visibility.views(camera, cells, SIDE, SIDE)
    share = view.filter("row >= 35").agg(F.avg(F.col("visible").cast("int"))).first()[0]
    assert share < 0.3


def test_rgb_and_geo_round_trips(spark):
    rgb = spark.createDataFrame([(128, 0, 0, 0.0), (134, 55, 128, 1591.5), (127, 0, 0, -256.0), (128, 1, 0, 1.0)], "r int, g int, b int, elev double")
    assert all(r[0] == r[1] for r in rgb.select(raster.decode_rgb(F.col("r"), F.col("g"), F.col("b")), "elev").collect())
    poles = spark.createDataFrame([(90.0, 0.0, 1000.0), (0.0, 180.0, 2000.0)], "lat double, lng double, radius_m double")
    found = poles.select(geo.bounds(F.col("lat"), F.col("lng"), F.col("radius_m")).alias("b")).select("b.*").collect()
    assert all(r["north"] <= geo.MERCATOR_LIMIT and r["south"] <= r["north"] and r["east"] <= 180 for r in found)


def test_engine_end_to_end(spark):
    cells = surface(spark, F.greatest(F.lit(1000.0), F.lit(2000.0) - 40 * F.sqrt((F.col("row") - 20) * (F.col("row") - 20) + (F.col("col") - 20) * (F.col("col") - 20)), F.lit(1800.0) - 40 * F.sqrt((F.col("row") - 45) * (F.col("row") - 45) + (F.col("col") - 45) * (F.col("col") - 45)))).cache()
    b = F.struct(F.lit(40.0).alias("north"), F.lit(39.955).alias("south"), F.lit(-104.94).alias("east"), F.lit(-105.0).alias("west"))
    bounds = spark.range(1).select(F.col("id").alias("area"), b.alias("b"))
    found = engine.analyze(cells, bounds, 78.0, SIDE)
    assert found["hotspots"].count() >= 1 and found["features"].filter("kind = 'peaks'").count() == 2
    assert found["scenes"].count() >= 1 and found["summary"].count() == 1
    grid = engine.elevation_grid(cells).first()
    assert len(grid["grid"]) == SIDE and len(grid["grid"][0]) == SIDE
    areas = spark.createDataFrame([(1, 39.7, -105.0, 20000.0), (2, 99.0, -105.0, 20.0)], "k long, lat double, lng double, radius_m double")
    assert [r["errors"] for r in engine.validated(areas).orderBy("k").collect()] == [[], ["lat", "radius_m"]]
    planned = engine.plan_areas(areas.filter("k = 1"))
    assert engine.tile_list(planned, "k").count() <= 64
    with pytest.raises(ValueError):
        engine.checked_weights({"peaks": 3.0})


def test_style_kernels():
    rows, cols = np.mgrid[:32, :32]
    v = style.fingerprint(style.contours(1000 + 30 * np.hypot(rows - 16.0, cols - 16.0)))
    assert len(v) == 100 and np.isfinite(v).all()
    assert style.fingerprint(np.zeros((16, 16), bool))[98] == 0.5
    square = np.zeros((32, 32))
    square[8:24, 8:24] = 255
    assert style.edges(square).sum() > 30 and style.skeleton(square > 0).sum() < 64


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2026-01-01 {i % 5:02}:10:00", "click" if i % 2 else "view", float(i)) for i in range(50)], "id long, ts string, kind string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = logs.usage_by_window(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ts", "kind", "value")
    query = stream.writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r["start"], r["kind"])
    assert sorted(spark.table("usage").collect(), key=key) == sorted(logs.usage_by_window(events, "ts", "kind", "value").collect(), key=key)


def test_cache_replay_evicts_and_expires(spark):
    accesses = spark.createDataFrame([(0, float(t), k) for t, k in enumerate("abcab")] + [(0, 100.0, "b")], "shard long, at double, key string")
    hits = [r["hit"] for r in logs.cache_replay(accesses, 2, 50.0).orderBy("at").collect()]
    assert hits == [False, False, False, False, False, False]
    wide = [r["hit"] for r in logs.cache_replay(accesses, 3, 50.0).orderBy("at").collect()]
    assert wide == [False, False, False, True, True, False]
