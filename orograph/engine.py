"""The engine's entry points: each takes DataFrames of requests, for many areas at once, and returns DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.operators import features, previews, profiles, scenes, stencil, style, viewpoints, visibility
from orograph.sources.shared import checkpointed

DEFAULT_WEIGHTS = {"peaks": 1.0, "ridges": 0.9, "cliffs": 0.8, "water": 0.7, "relief": 0.6}
# Fixed limits of requests.
RADIUS_M, MOST_WEIGHT = (1_000.0, 50_000.0), 2.0


def validated(areas: DataFrame) -> DataFrame:
    """Adds ``errors``: what is wrong with lat, lng and radius_m of each request; empty if nothing is."""
    checks = {"lat": F.col("lat").between(-90, 90), "lng": F.col("lng").between(-180, 180), "radius_m": F.col("radius_m").between(*RADIUS_M)}
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    return areas.withColumn("errors", F.filter(found, lambda x: x.isNotNull()))


def problems(areas: DataFrame) -> DataFrame:
    """What becomes of requests that can't be served, as rows beside the others: every column of ``areas`` with the status 422 and what is wrong; ``accepted`` has the rest."""
    bad = validated(areas).filter(F.size("errors") > 0)
    return bad.withColumns({"status": F.lit(422), "detail": F.concat(F.lit("invalid: "), F.array_join("errors", ", "))}).drop("errors")


def accepted(areas: DataFrame) -> DataFrame:
    """The requests in which nothing is wrong."""
    return validated(areas).filter(F.size("errors") == 0).drop("errors")


def fetch_problems(wanted: DataFrame, tiles_: DataFrame, key: str) -> DataFrame:
    """(key, status 502, detail) of areas some of whose tiles failed. ``wanted``: key, z, x, y; ``tiles_``: z, x, y, error, as the tile sources give them. The other areas go on."""
    failed = wanted.join(tiles_.filter("error IS NOT NULL").select("z", "x", "y", "error"), ["z", "x", "y"])
    first = F.min(F.struct("z", "x", "y", "error"))["error"]
    return failed.groupBy(key).agg(first.alias("__e")).select(key, F.lit(502).alias("status"), F.concat(F.lit("Upstream tile fetch failed: "), "__e").alias("detail"))


def checked_weights(weights: dict[str, float] | None) -> dict[str, float]:
    """Weights of all layers: 0 to 2 each, not all 0."""
    merged = DEFAULT_WEIGHTS | (weights or {})
    if set(merged) - set(DEFAULT_WEIGHTS) or not all(0 <= w <= MOST_WEIGHT for w in merged.values()) or not sum(merged.values()):
        raise ValueError(f"weights must be 0 to {MOST_WEIGHT} for {', '.join(DEFAULT_WEIGHTS)}, and not all 0")
    return merged


def plan_areas(areas: DataFrame, zoom: int = 13, most_tiles: int = 64, cells: int = 128) -> DataFrame:
    """Requests with bounds, the highest zoom whose tiles are few enough, its tile range and the cell size. Zoom 0 stands for the default."""
    b = areas.withColumn("b", geo.bounds(F.col("lat"), F.col("lng"), F.col("radius_m")))
    levels = F.transform(F.sequence(F.lit(zoom or 13), F.lit(0), F.lit(-1)), lambda z: F.struct(z.alias("zoom"), geo.tile_range(F.col("b"), z).alias("t")))
    fits = F.filter(levels, lambda x: (x["t"]["x_max"] - x["t"]["x_min"] + 1) * (x["t"]["y_max"] - x["t"]["y_min"] + 1) <= most_tiles)
    return b.withColumn("__l", F.get(fits, 0)).select("*", F.col("__l.zoom").alias("zoom"), F.col("__l.t").alias("tiles"), geo.cell_size(F.col("b"), cells).alias("cell_m")).drop("__l")


def tile_list(planned: DataFrame, key: str) -> DataFrame:
    """The tiles (key, z, x, y) that planned areas need: columns first, then rows."""
    x = planned.select(key, F.col("zoom").alias("z"), "tiles", F.explode(F.sequence("tiles.x_min", "tiles.x_max")).alias("x"))
    return x.select(key, "z", "x", F.explode(F.sequence("tiles.y_min", "tiles.y_max")).alias("y"))


def elevation_grid(cells: DataFrame) -> DataFrame:
    """A row an area: lists of rows of elevations to one decimal, with lowest, highest and mean."""
    line = cells.groupBy("area", "row").agg(F.array_sort(F.collect_list(F.struct("col", F.bround("elev", 1).alias("e")))).alias("l"))
    grid = line.groupBy("area").agg(F.array_sort(F.collect_list(F.struct("row", F.col("l.e").alias("e")))).alias("g")).select("area", F.col("g.e").alias("grid"))
    stats = cells.groupBy("area").agg(F.bround(F.min("elev"), 1).alias("low"), F.bround(F.max("elev"), 1).alias("high"), F.bround(F.avg("elev"), 1).alias("mean"))
    return grid.join(stats, "area")


def located(rows: DataFrame, bounds: DataFrame, side: int, r: str = "r", c: str = "c") -> DataFrame:
    """Adds lat and lng of fractional cells. ``bounds``: area, b."""
    return rows.join(bounds, "area").withColumn("__p", geo.grid_to_geo(F.col(r), F.col(c), F.col("b"), side, side)).withColumns({"lat": F.col("__p.lat"), "lng": F.col("__p.lng")}).drop("__p", "b")


def analyze(cells: DataFrame, bounds: DataFrame, cell_m: float, side: int, weights: dict[str, float] | None = None, threshold: int = 24) -> dict[str, DataFrame]:
    """Features, hotspots, scenes and summary of areas, and their interest surface.

    Features and the surface feed several results, so they are written once.
    """
    w = checked_weights(weights)
    found = checkpointed(features.all_features(cells, cell_m, threshold, bounds, side))
    surface = checkpointed(features.interest(features.layers(cells, found, tuple(n for n in features.LAYERS if w[n] > 0)), w))
    hot = checkpointed(located(features.hotspots(surface, w), bounds, side, "row", "col"))
    placed = checkpointed(located(found, bounds, side))
    bent = stencil.curvature(stencil.slope(cells, cell_m), cell_m)
    summary = bent.groupBy("area").agg(*[F.bround(f(x), 4).alias(f"{n}_{x}") for x in ("elev", "slope", "curvature") for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])
    return {"features": placed, "hotspots": hot, "scenes": checkpointed(scenes.scenes(hot.select("area", "hotspot_id", "ord", "lat", "lng", "score"), placed)), "surface": surface, "summary": summary}


def analysis_response(analysis: dict[str, DataFrame], planned: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """A JSON text an area: the request's bounds, zoom and cell size (``planned``: area, b, zoom, cell_m), the summary, features by kind, hotspots and scenes, each in order; with ``cells`` also the elevations."""
    listed = lambda df, order, *columns: df.groupBy("area").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*columns).alias("row")))), lambda x: x["row"]).alias("rows"))
    base = analysis["features"]
    columns = ("feature_id", "lat", "lng", "elev", "prominence", "drop_m", "length_m", "score")
    out = planned.select("area", F.struct(F.col("b").alias("bounds"), "zoom", "cell_m").alias("request")).join(analysis["summary"].select("area", F.struct(*[c for c in analysis["summary"].columns if c != "area"]).alias("summary")), "area", "left")
    for kind in scenes.KINDS:
        out = out.join(listed(base.filter(F.col("kind") == kind), "ord", *columns).withColumnRenamed("rows", kind), "area", "left")
    out = out.join(listed(analysis["hotspots"], "ord", "hotspot_id", "lat", "lng", "score", "reasons").withColumnRenamed("rows", "hotspots"), "area", "left")
    out = out.join(listed(analysis["scenes"], "rank", "scene_id", "type", "lat", "lng", "feature_ids", "summary", "score").withColumnRenamed("rows", "scenes"), "area", "left")
    lists = [F.coalesce(F.col(c), F.array().cast(dict(out.dtypes)[c])).alias(c) for c in (*scenes.KINDS, "hotspots", "scenes")]
    if cells is not None:
        out = out.join(elevation_grid(cells).select("area", F.struct("grid", "low", "high", "mean").alias("elevations")), "area", "left")
    more = ["elevations"] if cells is not None else []
    return out.select("area", F.to_json(F.struct("request", "summary", *lists, *more)).alias("response"))


def scene_contexts(analysis: dict[str, DataFrame], bounds: DataFrame, cells: DataFrame, side: int, cell_m: float, fov: float) -> DataFrame:
    """Scenes with their points, lines (paths as places), extent, relief and viewing distance. Features that an area doesn't have are passed over."""
    scene = analysis["scenes"].select("area", "scene_id", "rank", "type", F.col("lat").alias("lat0"), F.col("lng").alias("lng0"), F.col("score").alias("scene_score"), "feature_ids")
    path = F.when(F.col("path").isNotNull(), F.transform("path", lambda v: geo.grid_to_geo(v["r"], v["c"], F.col("b"), side, side)))
    feature = analysis["features"].join(bounds, "area").select("area", "feature_id", "kind", "score", "lat", "lng", "elev", path.alias("path"))
    # The place of a line is the middle vertex of its path, to six decimals.
    feature = feature.withColumn("__c", features.center_of(F.when(F.col("path").isNull(), F.struct("lat", "lng")), F.col("path"), F.struct(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lng")))).withColumns({"lat": F.col("__c.lat"), "lng": F.col("__c.lng")}).drop("__c")
    member = scene.select("area", "scene_id", F.explode("feature_ids").alias("feature_id")).join(feature, ["area", "feature_id"])
    known = checkpointed(scene.drop("feature_ids").join(viewpoints.contexts(member), ["area", "scene_id"]))
    ridge = known.withColumn("ridge", F.get(F.filter("lines", lambda x: x["kind"] == "ridges"), 0)).filter("ridge is not null").join(bounds, "area").select("area", "scene_id", "b", F.col("ridge.path").alias("path"))
    suited = profiles.viewing_distances(ridge, ["area", "scene_id"], cells, side, cell_m, fov)
    return known.join(suited, ["area", "scene_id"], "left").withColumn("distance", F.coalesce("distance", viewpoints.fallback_distance(F.col("extent"))))


def viewpoint_candidates(analysis: dict[str, DataFrame], cells: DataFrame, bounds: DataFrame, side: int, cell_m: float, compositions: list[str], fov: float = 55.0) -> DataFrame:
    """A row a scene and template that suits it: its pose, anchors with whether each is seen, and ``rejected``, why it goes (null: it stays)."""
    known = scene_contexts(analysis, bounds, cells, side, cell_m, fov)
    tried = viewpoints.anchored(viewpoints.eligible(known, compositions)).withColumn("vp_id", F.concat_ws("/", F.col("area").cast("string"), "scene_id", "template"))
    tried = checkpointed(tried)
    fits = tried.filter("fits").join(bounds, "area")

    def ground(rows: DataFrame, key: str) -> DataFrame:
        """key and the elevation at lat, lng."""
        at = rows.withColumn("__g", geo.geo_to_grid(F.col("lat"), F.col("lng"), F.col("b"), side, side)).select(F.col(key).alias("pid"), "area", F.col("__g.row").alias("r"), F.col("__g.col").alias("c"))
        return stencil.bilinear(at, cells, side, side).select(F.col("pid").alias(key), F.col("value").alias("ground"))

    role = F.array(*[F.struct(F.lit(i).alias("i"), F.col(name).alias("a")) for i, name in enumerate(("first", "second"))])
    flat = fits.withColumn("__a", F.explode(F.filter(role, lambda x: x["a"].isNotNull()))).withColumn("target", F.get("targets", F.col("__a.i")))
    flat = flat.select(F.struct("vp_id", F.col("__a.i").alias("i")).alias("anchor"), "area", "b", "lat0", "lng0", F.col("__a.a.feature_id").alias("feature_id"), F.col("__a.a.lat").alias("lat"), F.col("__a.a.lng").alias("lng"), "target")
    raised = flat.join(ground(flat, "anchor"), "anchor").withColumn("p", geo.to_enu(F.col("lat"), F.col("lng"), F.col("lat0"), F.col("lng0")))
    one = F.struct(F.col("anchor.i").alias("i"), "feature_id", F.col("target.role").alias("role"), F.col("target.x").alias("x"), F.col("target.y").alias("y"), "lat", "lng", F.col("ground").alias("z"), "p.e", "p.n")
    anchors = raised.groupBy(F.col("anchor.vp_id").alias("vp_id")).agg(F.array_sort(F.collect_list(one)).alias("anchors"))
    ready = checkpointed(fits.select("vp_id", "area", "b", "lat0", "lng0", "solver", "horizon", "distance", "relief", F.col("line.path").alias("line_path")).join(anchors, "vp_id"))

    a = lambda i, x: F.get("anchors", i)[x]
    pairs = ready.filter("solver = 'pnp'").select("vp_id", *[a(i, x).alias(f"{x}{i + 1}") for i in (0, 1) for x in ("e", "n", "z", "x", "y")], "horizon", "distance", "relief")
    posed = ready.join(viewpoints.solved(pairs, "vp_id", fov), "vp_id").withColumn("p", geo.from_enu(F.col("e"), F.col("n"), F.col("lat0"), F.col("lng0"))).select("vp_id", "accepted", F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"), F.col("z").alias("alt"), "heading", "rms")
    enu = lambda v: geo.to_enu(v["lat"], v["lng"], F.col("lat0"), F.col("lng0"))
    led = ready.filter("solver = 'leading_line'").filter(F.size("line_path") >= 2).withColumns({"__s": enu(F.get("line_path", 0)), "__t": enu(F.element_at("line_path", -1)), "__e": enu(viewpoints.entry(F.col("line_path")))})
    led = led.withColumns({"__de": F.col("__t.e") - F.col("__s.e"), "__dn": F.col("__t.n") - F.col("__s.n")}).withColumn("__l", F.sqrt(F.col("__de") * F.col("__de") + F.col("__dn") * F.col("__dn")))
    back = F.col("distance") / F.when(F.col("__l") > 0, F.col("__l")).otherwise(F.lit(1.0))
    led = led.withColumns({"e": F.col("__e.e") - F.col("__de") * back, "n": F.col("__e.n") - F.col("__dn") * back}).withColumn("p", geo.from_enu(F.col("e"), F.col("n"), F.col("lat0"), F.col("lng0"))).withColumns({"lat": F.col("p.lat"), "lng": F.col("p.lng"), "heading": geo.heading(a(0, "e") - F.col("e"), a(0, "n") - F.col("n"))})
    led = led.join(ground(led, "vp_id"), "vp_id").select("vp_id", F.lit(True).alias("accepted"), "lat", "lng", (F.col("ground") + F.greatest(F.lit(10.0), F.col("relief") * 0.08)).alias("alt"), "heading", F.lit(None).cast("double").alias("rms"))
    poses = checkpointed(ready.select("vp_id", "area", "b", "anchors", "horizon").join(posed.unionByName(led), "vp_id"))

    inside = F.col("lat").between(F.col("b.south"), F.col("b.north")) & F.col("lng").between(F.col("b.west"), F.col("b.east"))
    met = poses.filter("accepted").join(ground(poses.filter("accepted"), "vp_id"), "vp_id").withColumn("clearance", F.col("alt") - F.col("ground"))
    met = checkpointed(met.withColumn("why", viewpoints.rejection(inside, F.col("clearance"))))
    cell = lambda lat, lng: geo.geo_to_grid(lat, lng, F.col("b"), side, side)
    sights = met.filter("why is null").withColumn("__a", F.explode("anchors")).withColumns({"__f": cell(F.col("lat"), F.col("lng")), "__t": cell(F.col("__a.lat"), F.col("__a.lng"))})
    sights = sights.select(F.struct("vp_id", F.col("__a.i").alias("i")).alias("vp_id"), "area", F.col("__f.row").alias("r1"), F.col("__f.col").alias("c1"), F.col("alt").alias("alt1"), F.col("__t.row").alias("r2"), F.col("__t.col").alias("c2"), F.col("__a.z").alias("alt2"))
    seen = visibility.line_of_sight(sights, cells, side, side).groupBy(F.col("vp_id.vp_id").alias("vp_id")).agg(F.collect_list(F.when(F.col("clear"), F.col("vp_id.i"))).alias("clear"))
    judged = met.join(seen, "vp_id", "left").select("vp_id", "lat", "lng", "alt", "heading", "rms", "clearance", F.coalesce("why", F.when(F.size(F.coalesce("clear", F.array().cast("array<int>"))) == 0, F.lit("occluded"))).alias("why"), F.filter("anchors", lambda x: F.array_contains("clear", x["i"]))["feature_id"].alias("visible_ids"))
    failed = F.when(~F.col("fits"), "templateIneligible").when(F.col("lat").isNull(), "noConvergence").otherwise(F.col("why"))
    out = tried.select("vp_id", "area", "scene_id", "type", "template", "composition", "horizon", "lat0", "lng0", "scene_score", "fits").join(anchors, "vp_id", "left").join(judged, "vp_id", "left")
    camera = {"lat": F.bround("lat", 6), "lng": F.bround("lng", 6), "alt": F.bround("alt", 1), "head": F.bround(F.pmod("heading", F.lit(360.0)), 1), "pitch": F.bround(geo.pitch_from_horizon(F.col("horizon"), F.lit(fov)), 1)}
    out = out.withColumn("rejected", failed).withColumn("meters", F.bround(geo.planar(F.col("lat"), F.col("lng"), F.col("lat0"), F.col("lng0")), 1)).withColumns(camera).withColumns({"fov": F.lit(fov), "clearance": F.bround("clearance", 1)})
    return out.drop("heading", "why", "fits", "lat0", "lng0")


def scored_views(candidates: DataFrame, surface: DataFrame, features_: DataFrame, bounds: DataFrame, side: int) -> DataFrame:
    """Candidates that stay, with all seven scores and their total, to four decimals."""
    stays = candidates.filter("rejected is null")
    cameras = stays.join(bounds, "area").select("vp_id", "area", "lat", "lng", "alt", "head", "fov", "b")
    vertex = F.col("v")
    water = features_.filter("kind = 'waterChannels'").join(bounds, "area").select("area", "b", F.explode("path").alias("v")).withColumn("p", geo.grid_to_geo(vertex["r"], vertex["c"], F.col("b"), side, side)).withColumn("g", geo.geo_to_grid(F.col("p.lat"), F.col("p.lng"), F.col("b"), side, side))
    points = water.select("area", F.bround("g.row").cast("int").alias("row"), F.bround("g.col").cast("int").alias("col"))
    scores = visibility.all_scores(checkpointed(cameras), surface, points, side)
    rounded = scores.select("vp_id", *[F.bround(n, 4).alias(n) for n in (*visibility.WEIGHTS, "total")])
    return stays.join(rounded, "vp_id")


def ranked_views(scored: DataFrame, per_scene: int = 3, most: int = 12) -> DataFrame:
    """Near repeats cleared, then the best of each scene, then of each area: by total, score of the scene and its id as a string."""
    kept = viewpoints.deduplicated(scored.select("area", "scene_id", "composition", F.col("vp_id").alias("id"), "lat", "lng", "head", F.col("total").alias("score")), ["area", "scene_id", "composition"])
    full = scored.join(kept.select(F.col("id").alias("vp_id")), "vp_id")
    top = viewpoints.in_order(full, ["area", "scene_id"], "__s").filter(F.col("__s") <= per_scene)
    return viewpoints.in_order(top, ["area"], "rank").filter(F.col("rank") <= most).drop("__s").withColumn("viewpoint_id", F.concat(F.lit("vp-"), "rank"))


def view_summary(scenes_: DataFrame, candidates: DataFrame, ranked: DataFrame | None = None) -> DataFrame:
    """Per area: scenes, those with a template, candidates, how many went for each reason, and how many are returned (if they are given)."""
    count = F.count(F.lit(1))
    reasons = [F.count_if(F.col("rejected") == name).alias(name) for name in viewpoints.REJECTIONS]
    tried = candidates.groupBy("area").agg(F.countDistinct("scene_id").alias("eligible_scenes"), count.alias("generated"), *reasons)
    out = scenes_.groupBy("area").agg(count.alias("scenes")).join(tried, "area", "left")
    if ranked is not None:
        out = out.join(ranked.groupBy("area").agg(count.alias("returned")), "area", "left")
    return out.fillna(0)


def find_viewpoints(analysis: dict[str, DataFrame], cells: DataFrame, bounds: DataFrame, side: int, cell_m: float, compositions: list[str], fov: float = 55.0, per_scene: int = 3, most: int = 12) -> dict[str, DataFrame]:
    """Ranked viewpoints of areas, every candidate with its fate, and a summary an area."""
    candidates = checkpointed(viewpoint_candidates(analysis, cells, bounds, side, cell_m, compositions, fov))
    scored = checkpointed(scored_views(candidates, analysis["surface"], analysis["features"], bounds, side))
    ranked = checkpointed(ranked_views(scored, per_scene, most))
    return {"viewpoints": ranked, "candidates": candidates, "scored": scored, "summary": view_summary(analysis["scenes"], candidates, ranked)}


def point_context(points: DataFrame, cells: DataFrame, side: int, alt: Column | None = None) -> DataFrame:
    """Ground at points (pid, area, r, c), height above it where an altitude is given, and the area's range."""
    ground = stencil.bilinear(points, cells, side, side)
    stats = cells.groupBy("area").agg(F.min("elev").alias("low"), F.max("elev").alias("high"), F.avg("elev").alias("mean"))
    return ground.join(stats, "area").withColumn("agl", F.bround((alt if alt is not None else F.lit(None).cast("double")) - F.col("value"), 2))


def style_viewpoints(analysis: dict[str, DataFrame], cells: DataFrame, bounds: DataFrame, side: int, cell_m: float, reference: DataFrame, compositions: list[str], fov: float = 55.0, per_scene: int = 3, most: int = 12) -> dict[str, DataFrame]:
    """Viewpoints that suit a reference fingerprint (reference_id, vector: one row): windows like it join scenes or make their own; views of all scenes are found as usual, then ranked by style."""
    found = checkpointed(style.patch_fingerprints(cells))
    top = checkpointed(style.patch_centers(style.best_patches(found, reference).drop("reference_id"), bounds, side))
    placed = checkpointed(style.patch_scenes(top, analysis["scenes"], analysis["features"]))
    every = {**analysis, "scenes": checkpointed(style.with_patch_scenes(analysis["scenes"], placed))}
    views = find_viewpoints(every, cells, bounds, side, cell_m, compositions, fov, per_scene, 2 * most)
    normal = style.patch_normals(cells).join(top.select("area", "r0", "c0", "rank"), ["area", "r0", "c0"]).select("area", F.concat(F.lit("style-patch-"), "rank").alias("patch_id"), "normal")
    ranked = style.reranked(views["viewpoints"], style.scene_patches(placed), normal, per_scene, most)
    return {**views, "viewpoints": checkpointed(ranked), "patches": placed}


def verify_composition(responses: DataFrame, width: int = 1920, height: int = 1080) -> DataFrame:
    """Of each of ``previews.responses`` the verification of each preview's anchors, as its camera sees them on a screen of this size."""
    camera, composition = F.col("preview_input.camera"), F.col("preview_input.composition")
    views = responses.select(
        "area", "id", camera["position"]["lat"].alias("lat"), camera["position"]["lng"].alias("lng"), camera["position"]["alt_meters"].alias("alt"), camera["heading_deg"].alias("head"), camera["pitch_deg"].alias("pitch"), camera["roll_deg"].alias("roll"),
        camera["fov_deg"].alias("fov"), F.lit(width).alias("width"), F.lit(height).alias("height"), composition["target_template"].alias("template"), composition["horizon_ratio"].alias("horizon_ratio"), composition["anchors"].alias("anchors"),
    )
    return previews.verified(views).select("area", "id", "verification")


def verify_render(scores: DataFrame) -> DataFrame:
    """Fused score and status of rendered views (clip, edge, lpips, before)."""
    return scores.withColumn("v", previews.render_score(F.col("clip"), F.col("edge"), F.col("lpips"), F.col("before"))).select("*", "v.*").drop("v")
