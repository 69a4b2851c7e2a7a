"""Viewpoints, distance joins, profiles and kernels against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orograph import engine
from orograph.functions import geo
from orograph.operators import features, hydro, previews, profiles, spatial, style, viewpoints, visibility
from orograph.sources import raster

SIDE, CELL = 64, 78.0
NORTH, SOUTH, EAST, WEST = 40.0, 39.955, -104.94, -105.0


def haversine(a, b):
    (lat1, lng1), (lat2, lng2) = np.radians(a), np.radians(b)
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lng2 - lng1) / 2) ** 2
    return 2 * 6378137.0 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("radius", [5_000.0, 400_000.0])
def test_distance_join_equals_all_pairs(spark, radius):
    """Around the globe: at the antimeridian, at both poles, on the equator."""
    rng = np.random.default_rng(int(radius))
    spread = radius / 111_000
    places = [(90, 0), (-90, 0), (89.99, 20), (0, 180), (60, -180), (0, 0), (45, 10), (-89.9, -170)]
    points = []
    for lat, lng in places:
        for _ in range(12):
            turn = rng.uniform(-spread, spread) / max(0.01, math.cos(math.radians(min(89.9, abs(lat)))))
            points.append((float(np.clip(lat + rng.uniform(-spread, spread), -90, 90)), float((lng + turn + 180) % 360 - 180)))
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "a long, lat double, lng double")
    right = left.select(F.col("a").alias("b"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    found = spatial.within(left, right, radius).select("a", "b").collect()
    expected = {(i, j) for i, p in enumerate(points) for j, q in enumerate(points) if haversine(p, q) <= radius}
    assert len(found) == len({tuple(r) for r in found}) and {tuple(r) for r in found} == expected


def test_components_and_flow_equal_plain_walks():
    rng = np.random.default_rng(4)
    mask = rng.random((40, 30)) < 0.45
    rows, cols = np.nonzero(mask)
    shuffled = rng.permutation(len(rows))
    for eight in (True, False):
        own = hydro.labels(rows[shuffled], cols[shuffled], eight)
        label = {(int(r), int(c)): int(k) for r, c, k in zip(rows[shuffled], cols[shuffled], own, strict=True)}
        seen, n = {}, 0
        for cell in sorted(label):
            if cell in seen:
                continue
            stack = [cell]
            seen[cell] = n
            while stack:
                r, c = stack.pop()
                for dr, dc in hydro.OFFSETS:
                    q = (r + dr, c + dc)
                    if q in label and q not in seen and (eight or dr * dc == 0):
                        seen[q] = n
                        stack.append(q)
            n += 1
        assert seen == label
    elev = rng.random((12, 9)) * 100
    direction = np.full(elev.shape, -1)
    for r in range(12):
        for c in range(9):
            drops = [(elev[r, c] - elev[r + dr, c + dc]) / math.hypot(dr, dc) if 0 <= r + dr < 12 and 0 <= c + dc < 9 else 0 for dr, dc in hydro.OFFSETS]
            direction[r, c] = int(np.argmax(drops)) if max(drops) > 0 else -1
    expected = np.zeros(elev.shape, int)
    for r in range(12):
        for c in range(9):
            a, b = r, c
            while True:
                expected[a, b] += 1
                if direction[a, b] < 0:
                    break
                dr, dc = hydro.OFFSETS[direction[a, b]]
                a, b = a + dr, b + dc
    assert (hydro.accumulate(elev, direction) == expected).all()


def test_best_cells_equal_a_plain_search(spark):
    rng = np.random.default_rng(6)
    grid = rng.integers(0, 3, (30, 30))
    rows = [(0, int(r), int(c), float(grid[r, c]), float((r * 7 + c) % 2)) for r, c in zip(*np.nonzero(rng.random((30, 30)) < 0.4), strict=True)]
    found = features.best_cells(spark.createDataFrame(rows, "area long, row int, col int, a double, b double"), ["a", "b"]).collect()
    own = hydro.labels(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
    expected = []
    for k in range(own.max() + 1):
        part = sorted(r for r, o in zip(rows, own, strict=True) if o == k)
        most = [max(r[i] for r in part) for i in (3, 4)]
        top = [r for r in part if [r[3], r[4]] == most]
        middle = (np.mean([r[1] for r in part]), np.mean([r[2] for r in part]))
        if top:
            one = min(top, key=lambda r: ((r[1] - middle[0]) ** 2 + (r[2] - middle[1]) ** 2, r))
            expected.append((k, one[1], one[2]))
    assert sorted((r["component"], r["row"], r["col"]) for r in found) == expected


def test_path_ends_are_the_farthest_in_a_straight_line():
    hook = [(0, c) for c in range(10)] + [(r, 9) for r in range(1, 6)] + [(5, c) for c in range(2, 9)]
    path = hydro.trace(hook)
    assert {path[0], path[-1]} == {(0, 0), (5, 2)} or hydro.farthest([(0, 0), (5, 2)], (0, 0)) == path[0]
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:], strict=False))


def plain_dimension(values):
    n = len(values)
    low, high = values.min(), values.max()
    if high - low < 1e-12:
        return 1.0
    v = (values - low) / (high - low)
    x, y, s = [], [], 2
    while s <= n // 2:
        boxes = sum(math.floor(v[i : i + s].max() * n / s) - math.floor(v[i : i + s].min() * n / s) + 1 for i in range(0, n, s))
        x.append(math.log(n / s))
        y.append(math.log(boxes))
        s *= 2
    return float(np.polyfit(x, y, 1)[0])


def test_viewing_distance_equals_plain_version(spark):
    cells = raster.closed_form(spark, SIDE, F.sin(F.col("row") * 0.8) * 40 + F.cos(F.col("col") * 1.7) * 30 + F.col("row"))
    grid = hydro.grid_of(cells.toPandas(), "elev")
    paths = [[(39.999, -104.999), (39.98, -104.97), (39.96, -104.95)], [(39.97, -104.96)], [(39.99, -104.98), (39.99, -104.98)]]
    b = F.struct(F.lit(NORTH).alias("north"), F.lit(SOUTH).alias("south"), F.lit(EAST).alias("east"), F.lit(WEST).alias("west"))
    df = spark.createDataFrame([(i, 0, [{"lat": p[0], "lng": p[1]} for p in path]) for i, path in enumerate(paths)], "k long, area long, path array<struct<lat:double,lng:double>>").withColumn("b", b)
    found = {r["k"]: r["distance"] for r in profiles.viewing_distances(df, ["k", "area"], cells, SIDE, CELL, 55.0).collect()}
    for k, path in enumerate(paths):
        p = np.array(path)
        arc = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(p, axis=0).T))]) if len(p) > 1 else np.zeros(1)
        at = np.linspace(0, arc[-1], 64)
        lat, lng = (np.interp(at, arc, p[:, i]) if arc[-1] > 0 else np.full(64, p[0, i]) for i in (0, 1))
        row, col = (np.clip(np.rint(x), 0, 63).astype(int) for x in ((NORTH - lat) / (NORTH - SOUTH) * 63, (lng - WEST) / (EAST - WEST) * 63))
        line = grid[row, col]
        misses = []
        for scale in profiles.SCALES_M:
            sigma = max(1, int(scale / CELL)) / 3
            half = int(4 * sigma + 0.5)
            w = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
            padded = np.pad(line, half, mode="symmetric")
            misses.append(abs(plain_dimension(np.convolve(padded, w / w.sum(), "valid")) - 1.3))
        best = profiles.SCALES_M[int(np.argmin(np.round(misses, 9)))]
        assert found[k] == pytest.approx(min(15000, max(400, best / math.tan(math.radians(55) / 2))))


@pytest.fixture(scope="module")
def flow(spark):
    """Three summits, a ridge and two channels."""
    r, c = F.col("row"), F.col("col")
    hill = lambda y, x, h, w: h * F.exp(-F.sqrt((r - y) * (r - y) + (c - x) * (c - x)) / w)
    cells = raster.closed_form(spark, SIDE, 1000 + hill(20, 20, 900, 12) + hill(24, 42, 700, 12) + hill(48, 30, 500, 10) + r * 1.5 + F.abs(c - 31) * 2).cache()
    b = F.struct(F.lit(NORTH).alias("north"), F.lit(SOUTH).alias("south"), F.lit(EAST).alias("east"), F.lit(WEST).alias("west"))
    bounds = spark.range(1).select(F.col("id").alias("area"), b.alias("b"))
    analysis = engine.analyze(cells, bounds, CELL, SIDE, threshold=12)
    found = engine.find_viewpoints(analysis, cells, bounds, SIDE, CELL, ["ruleOfThirds", "goldenRatio", "leadingLine", "symmetry"])
    return cells, bounds, analysis, found


def test_every_candidate_has_one_fate(flow):
    _, _, analysis, found = flow
    rows = found["candidates"].collect()
    assert rows and {r["rejected"] for r in rows} <= {None, *viewpoints.REJECTIONS}
    summary = found["summary"].first()
    assert summary["generated"] == len(rows)
    assert sum(summary[n] for n in viewpoints.REJECTIONS) == sum(r["rejected"] is not None for r in rows)
    assert summary["returned"] == found["viewpoints"].count() and summary["scenes"] == analysis["scenes"].count()
    per_scene = found["viewpoints"].groupBy("scene_id").count().agg(F.max("count")).first()[0]
    assert (per_scene or 0) <= 3


def ground_at(grid, lat, lng):
    r, c = np.clip((NORTH - lat) / (NORTH - SOUTH) * 63, 0, 63), np.clip((lng - WEST) / (EAST - WEST) * 63, 0, 63)
    r0, c0 = min(int(r), 62), min(int(c), 62)
    a, b = r - r0, c - c0
    return grid[r0, c0] * (1 - a) * (1 - b) + grid[r0, c0 + 1] * (1 - a) * b + grid[r0 + 1, c0] * a * (1 - b) + grid[r0 + 1, c0 + 1] * a * b


def test_accepted_views_see_their_anchors(flow):
    cells, _, _, found = flow
    grid = hydro.grid_of(cells.toPandas(), "elev")
    stays = [r for r in found["candidates"].collect() if r["rejected"] is None]
    assert stays
    for r in stays:
        assert SOUTH <= r["lat"] <= NORTH and WEST <= r["lng"] <= EAST
        assert r["alt"] - ground_at(grid, r["lat"], r["lng"]) == pytest.approx(r["clearance"], abs=0.5) and r["clearance"] >= 2
        clear = []
        for a in r["anchors"]:
            assert a["z"] == pytest.approx(ground_at(grid, a["lat"], a["lng"]), abs=1e-6)
            t = np.arange(2, 62) / 63
            line = [ground_at(grid, r["lat"] + (a["lat"] - r["lat"]) * x, r["lng"] + (a["lng"] - r["lng"]) * x) - (r["alt"] + (a["z"] - r["alt"]) * x) for x in t]
            clear.append(max(line) <= -0.5)
            if abs(max(line) + 0.5) > 0.5:
                assert (a["feature_id"] in r["visible_ids"]) == clear[-1]
        assert r["visible_ids"]


def test_all_seven_scores_equal_plain_version(flow):
    cells, bounds, analysis, found = flow
    grid = hydro.grid_of(cells.toPandas(), "elev")
    interest = hydro.grid_of(analysis["surface"].toPandas(), "interest")
    paths = [r["path"] for r in analysis["features"].filter("kind = 'waterChannels'").collect()]
    water = [(NORTH - round(NORTH - v["r"] / 63 * (NORTH - SOUTH), 6), round(WEST + v["c"] / 63 * (EAST - WEST), 6)) for p in paths for v in p]
    spots = [(round(a / (NORTH - SOUTH) * 63), round((lng - WEST) / (EAST - WEST) * 63)) for a, lng in water]
    ns, ew = math.radians(NORTH - SOUTH) * 6378137, math.radians(EAST - WEST) * 6378137 * math.cos(math.radians((NORTH + SOUTH) / 2))
    far = math.hypot(ns, ew)
    scored = found["scored"].collect()
    assert scored
    for v in scored[:6]:
        mask, dists, tops, lasts = np.zeros(grid.shape, bool), [], [], []
        rays = []
        for k in range(90):
            az = math.radians(v["head"] - v["fov"] / 2 + v["fov"] * k / 89)
            top, line = -math.pi / 2, {}
            for step in range(1, 41):
                d = far * step / 40
                lat, lng = v["lat"] + math.degrees(d * math.cos(az) / 6378137), v["lng"] + math.degrees(d * math.sin(az) / (6378137 * math.cos(math.radians(v["lat"]))))
                r, c = round((NORTH - lat) / (NORTH - SOUTH) * 63), round((lng - WEST) / (EAST - WEST) * 63)
                if 0 <= r < 64 and 0 <= c < 64:
                    line[step] = (r, c)
                    angle = math.atan2(grid[r, c] - v["alt"], d)
                    if angle > top:
                        mask[r, c], top = True, angle
                        dists.append((r, c, d))
            tops.append(top)
            rays.append(line)
        seen = grid[mask]
        share = np.histogram(seen, bins=8)[0] / len(seen)
        entropy = -sum(p * math.log(p) for p in share if p > 0) / math.log(8)
        tops = np.array(tops)
        skyline = math.exp(-((plain_dimension(tops) - 1.3) ** 2) / (2 * 0.15**2)) if np.ptp(tops) >= 1e-12 else 0.0
        rr, cc = math.ceil(500 / (ns / 63)), math.ceil(500 / (ew / 63))
        r, c = round((NORTH - v["lat"]) / (NORTH - SOUTH) * 63), round((v["lng"] - WEST) / (EAST - WEST) * 63)
        near = grid[max(0, r - rr) : r + rr + 1, max(0, c - cc) : c + cc + 1]
        p, q = mask.mean(), (near > v["alt"]).mean()
        prospect = 2 * p * q / (p + q) if p > 0 and q > 0 else 0.0
        most = max(d for _, _, d in dists)
        thirds = np.zeros(3)
        for a, b, d in dists:
            thirds[min(2, int(d / most * 3))] += interest[a, b]
        depth = -sum(t / thirds.sum() * math.log(t / thirds.sum()) for t in thirds if t > 0) / math.log(3) if thirds.sum() > 0 else 0.0
        limit = np.percentile(interest, 75)
        shown = (mask & (interest >= limit)).sum()
        hidden = 0
        for line in rays:
            visible = [s for s, cell in line.items() if mask[cell]]
            if visible and max(visible) + 1 in line and interest[line[max(visible) + 1]] >= limit:
                hidden += 1
        expected = {"richness": interest[mask].sum() / interest.sum(), "entropy": entropy, "skyline": skyline, "prospect": prospect, "depth": depth, "water": np.mean([mask[s] for s in spots]) if spots else 0.0}
        for name, value in expected.items():
            assert v[name] == pytest.approx(value, abs=0.02), name
        assert v["mystery"] == pytest.approx(min(1.0, hidden / shown) if shown else 0.0, abs=0.02)
        assert v["total"] == pytest.approx(sum(v[n] * w for n, w in visibility.WEIGHTS.items()), abs=1e-3)


def test_responses_hold_preview_anchors(flow):
    _, _, analysis, found = flow
    rows = previews.responses(found["viewpoints"], analysis["features"], analysis["scenes"], 3000.0).collect()
    assert len(rows) == found["viewpoints"].count()
    for r in rows:
        assert [t["feature_id"] for t in r["targets"]] == [a["id"] for a in r["preview_input"]["composition"]["anchors"]]
        assert r["preview_input"]["scene"]["scene_id"] == r["scene"] and r["score_breakdown"]["mystery"] is not None


def test_analysis_response_holds_all_parts(spark, flow):
    import json

    _, bounds, analysis, _ = flow
    planned = bounds.withColumn("zoom", F.lit(13)).withColumn("cell_m", F.lit(CELL))
    body = json.loads(engine.analysis_response(analysis, planned).first()["response"])
    assert "elevations" not in body
    with_cells = json.loads(engine.analysis_response(analysis, planned, flow[0]).first()["response"])["elevations"]
    assert len(with_cells["grid"]) == SIDE and all(len(line) == SIDE for line in with_cells["grid"]) and with_cells["low"] == min(map(min, with_cells["grid"]))
    assert body["request"]["zoom"] == 13 and body["request"]["bounds"]["north"] == NORTH
    for kind in ("peaks", "ridges", "cliffs", "waterChannels"):
        ids = [r["feature_id"] for r in analysis["features"].filter(F.col("kind") == kind).orderBy("ord").collect()]
        assert [x["feature_id"] for x in body[kind]] == ids
    assert [x["scene_id"] for x in body["scenes"]] == [r["scene_id"] for r in analysis["scenes"].orderBy("rank").collect()]
    assert len(body["hotspots"]) == analysis["hotspots"].count() and "max_elev" in body["summary"]


def test_style_flow_ranks_views(spark, flow):
    cells, bounds, analysis, _ = flow
    one = style.patch_fingerprints(cells.filter("row < 21 AND col < 21")).select(F.lit(0).alias("reference_id"), F.col("fingerprint").alias("vector"))
    found = engine.style_viewpoints(analysis, cells, bounds, SIDE, CELL, one, ["goldenRatio", "leadingLine"])
    placed = found["patches"].orderBy("rank").collect()
    assert len(placed) == style.TOP and placed[0]["similarity"] == pytest.approx(1.0, abs=1e-6)
    scenes, own = {r["scene_id"]: (r["lat"], r["lng"]) for r in analysis["scenes"].collect()}, []
    order = [r["scene_id"] for r in analysis["scenes"].orderBy("rank").collect()]
    plane = lambda a, b: math.hypot((a[0] - b[0]) * geo.METERS_PER_DEGREE, (a[1] - b[1]) * geo.METERS_PER_DEGREE * math.cos(math.radians((a[0] + b[0]) / 2)))
    for p in placed:
        at = (p["lat"], p["lng"])
        near = [s for s in [*order, *own] if plane(scenes[s], at) < 500]
        expected = near[0] if near else f"style-patch-{p['rank']}"
        assert p["scene_id"] == expected and p["own"] == (not near)
        if not near:
            own.append(expected)
            scenes[expected] = at
    for v in found["viewpoints"].collect():
        assert v["style_score"] == pytest.approx(0.45 * v["contour"] + 0.35 * v["patch"] + 0.2 * v["total"], abs=1e-9)


def test_density_grid_and_resize():
    lines = np.zeros((21, 21), bool)
    lines[[3, 20, 10], [2, 20, 5]] = True
    v = style.fingerprint(lines)
    thin = style.skeleton(lines)
    expected = np.array([[thin[5 * i : 5 * i + 5 if i < 3 else 21, 5 * j : 5 * j + 5 if j < 3 else 21].sum() for j in range(4)] for i in range(4)], float).ravel() / max(1, thin.sum())
    assert np.allclose(v[80:96], expected)
    assert style.resized(np.ones((300, 100))).shape == (300, 100)
    assert style.resized(np.full((1030, 500), 7.0)).shape == (512, 248) and np.allclose(style.resized(np.full((1030, 500), 7.0)), 7.0)


def test_views_are_verified_by_their_own_anchors(flow):
    """Every ranked view of the flow, against the projection in plain loops."""
    _, _, analysis, found = flow
    made = previews.responses(found["viewpoints"], analysis["features"], analysis["scenes"], 3000.0)
    got = {(r["area"], r["id"]): r["verification"] for r in engine.verify_composition(made).collect()}
    rows = made.collect()
    assert len(got) == len(rows) > 0

    def ecef(lat, lng, alt):
        a, b = math.radians(lat), math.radians(lng)
        n = 6378137.0 / math.sqrt(1 - 0.00669437999014 * math.sin(a) ** 2)
        return (n + alt) * math.cos(a) * math.cos(b), (n + alt) * math.cos(a) * math.sin(b), (n * (1 - 0.00669437999014) + alt) * math.sin(a)

    for r in rows:
        cam, comp, v = r["preview_input"]["camera"], r["preview_input"]["composition"], got[r["area"], r["id"]]
        if not comp["anchors"] or comp["target_template"] == "leading_line":
            assert v["status"] == ("skipped" if not comp["anchors"] else "unsupported_template")
            continue
        at, errors = cam["position"], []
        la, lo, h, p = (math.radians(x) for x in (at["lat"], at["lng"], cam["heading_deg"], cam["pitch_deg"]))
        for a in comp["anchors"]:
            d = [x - y for x, y in zip(ecef(a["lat"], a["lng"], a["alt_meters"]), ecef(at["lat"], at["lng"], at["alt_meters"]), strict=True)]
            e = math.cos(lo) * d[1] - math.sin(lo) * d[0]
            out = math.cos(lo) * d[0] + math.sin(lo) * d[1]
            n, u = math.cos(la) * d[2] - math.sin(la) * out, math.cos(la) * out + math.sin(la) * d[2]
            x, y = math.cos(h) * e + math.sin(h) * n, math.cos(h) * n - math.sin(h) * e
            depth, up = math.cos(p) * y - math.sin(p) * u, math.sin(p) * y + math.cos(p) * u
            if depth <= 0:
                errors.append(math.hypot(1920, 1080))
                continue
            t = math.tan(math.radians(cam["fov_deg"] / 2)) * depth
            errors.append(math.hypot((x / (t * 1920 / 1080) + 1) / 2 * 1920 - a["desired_normalized_x"] * 1920, (1 - up / t) / 2 * 1080 - a["desired_normalized_y"] * 1080))
        mean = sum(errors) / len(errors)
        assert abs(v["mean_anchor_error_px"] - mean) <= 0.051 and v["status"] == ("verified" if mean <= 80 else "failed")
