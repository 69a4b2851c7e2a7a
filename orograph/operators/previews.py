"""Preview orchestration as data: provider chains, payloads, verification of poses, fused scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.operators import viewpoints

# Fixed values.
PASS_PX = 80.0
RENDER_WEIGHTS = (0.5, 0.3, 0.2)
RENAMED_MODELS = {"gemini-2.0-flash-exp-image-generation": "gemini-3.1-flash-image-preview", "gemini-2.0-flash-preview-image-generation": "gemini-3.1-flash-image-preview"}


def first_provider(available: dict[str, Column]) -> Column:
    """The first provider of the chain whose condition holds."""
    return F.get(F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in available.items()]), lambda x: x.isNotNull()), 0)


def attempts(results: Column) -> Column:
    """Of an array of (provider, ok) the first that succeeded; null if none did."""
    return F.get(F.filter(results, lambda x: x["ok"]), 0)["provider"]


def warnings_of(conditions: dict[str, Column]) -> tuple[Column, Column]:
    """Warnings whose conditions hold, and the status that follows."""
    found = F.filter(F.array(*[F.when(ok, F.lit(text)) for text, ok in conditions.items()]), lambda x: x.isNotNull())
    return found, F.when(F.size(found) > 0, "completed_with_warnings").otherwise("completed")


def render_score(clip: Column, edge: Column, lpips: Column, before: Column) -> Column:
    """Weighted mean of the scores that are there (the distance inverted), fused with the score before rendering, and how complete it is."""
    parts = [(clip, RENDER_WEIGHTS[0]), (edge, RENDER_WEIGHTS[1]), (F.lit(1.0) - lpips, RENDER_WEIGHTS[2])]
    weight = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for x, w in parts), F.lit(0.0))
    value = sum((F.coalesce(x * w, F.lit(0.0)) for x, w in parts), F.lit(0.0))
    score = F.when(weight > 0, value / F.when(weight > 0, weight))
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x, _ in parts), F.lit(0))
    status = F.when(n == 3, "full").when(n >= 1, "partial").otherwise("unavailable")
    return F.struct(score.alias("render"), F.when(score.isNotNull(), F.lit(0.6) * before + F.lit(0.4) * score).otherwise(before).alias("final"), status.alias("status"))


def pose_check(errors: Column, diagonal: Column) -> Column:
    """Mean pixel error of anchors; one behind the camera (null) costs the whole diagonal."""
    mean = F.aggregate(errors, F.lit(0.0), lambda s, x: s + F.coalesce(x, diagonal)) / F.size(errors)
    return F.struct(mean.alias("mean_px"), (mean <= PASS_PX).alias("passed"))


def horizon_error(pitch: Column, vertical_fov: Column, ratio: Column, height: Column) -> Column:
    return F.abs((F.radians(pitch) / (F.radians(vertical_fov) / 2) + 1) / 2 * height - ratio * height)


# Fixed sentences of verifications.
NO_ANCHORS, NOT_SUPPORTED, WITHIN = "No anchors supplied; verification skipped.", "Leading-line verification is not yet supported.", "Anchors fall within tolerance."


def anchor_errors(anchors: Column) -> Column:
    """Pixels between where each anchor of a view is seen and where it is wanted; the screen's diagonal if it lies behind the camera.

    Step by step over the array, so that no step's arithmetic is written out within the next.
    """
    eye = geo.to_ecef(F.col("lat"), F.col("lng"), F.col("alt"))
    wanted = lambda a: (a["desired_normalized_x"].alias("desired_normalized_x"), a["desired_normalized_y"].alias("desired_normalized_y"))
    far = F.transform(anchors, lambda a: F.struct(geo.to_ecef(a["lat"], a["lng"], a["alt_meters"].cast("double")).alias("at"), *wanted(a)))
    near = F.transform(far, lambda a: F.struct(*[(a["at"][x] - eye[x]).alias(f"d{x}") for x in "xyz"], *wanted(a)))
    local = F.transform(near, lambda a: F.struct(geo.ecef_to_enu(a["dx"], a["dy"], a["dz"], F.col("lat"), F.col("lng")).alias("l"), *wanted(a)))
    seen = F.transform(local, lambda a: F.struct(geo.to_pixels(a["l"]["e"], a["l"]["n"], a["l"]["u"], *map(F.col, ("head", "pitch", "roll", "fov", "width", "height"))).alias("s"), *wanted(a)))
    off = lambda a: F.hypot(a["s"]["px"] - a["desired_normalized_x"] * F.col("width"), a["s"]["py"] - a["desired_normalized_y"] * F.col("height"))
    return F.transform(seen, lambda a: F.coalesce(off(a), F.hypot(F.col("width"), F.col("height"))))


def verified(views: DataFrame) -> DataFrame:
    """Adds ``verification``: whether a view's own anchors are seen where its composition wants them.

    ``views``: lat, lng, alt, head, pitch, roll, fov (vertical), width, height,
    template, horizon_ratio (or null), anchors (lat, lng, alt_meters,
    desired_normalized_x and _y; null or empty: skipped). Anchors stay in their
    row: a map without joins.
    """
    errors = anchor_errors(F.col("anchors"))
    mean = F.aggregate(errors, F.lit(0.0), lambda s, x: s + x) / F.size(errors)
    rows = views.withColumn("__mean", F.when(F.size("anchors") > 0, mean))
    skipped, unsupported = F.coalesce(F.size("anchors") <= 0, F.lit(True)), F.col("template") == "leading_line"
    passes = F.col("__mean") <= PASS_PX
    told = lambda x: F.when(~skipped & ~unsupported, x)
    status = F.when(skipped, "skipped").when(unsupported, "unsupported_template").when(passes, "verified").otherwise("failed")
    too_far = F.concat(F.lit("Mean anchor error "), F.format_string("%.1f", F.bround("__mean", 1)), F.lit(f"px exceeds {PASS_PX}px threshold."))
    notes = F.when(skipped, NO_ANCHORS).when(unsupported, NOT_SUPPORTED).when(passes, WITHIN).otherwise(too_far)
    horizon = horizon_error(F.col("pitch"), F.col("fov"), F.col("horizon_ratio"), F.col("height"))
    found = F.struct(status.alias("status"), "template", told(passes).alias("passes_threshold"), told(F.bround("__mean", 1)).alias("mean_anchor_error_px"), told(F.bround(horizon, 1)).alias("horizon_error_px"), notes.alias("notes"))
    return rows.withColumn("verification", found).drop("__mean")


def payload(row: Column) -> Column:
    """A struct as URL-safe base64 JSON without padding."""
    return F.rtrim(F.translate(F.base64(F.encode(F.to_json(row), "utf-8")), "+/\r\n", "-_"), F.lit("="))


def model_name(name: Column, fallback: str) -> Column:
    """A trimmed model name with old ones renamed; the fallback for none."""
    known = F.create_map(*[F.lit(x) for kv in RENAMED_MODELS.items() for x in kv])
    asked = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit(fallback))
    return F.coalesce(F.try_element_at(known, asked), asked)


def prompt(guard: Column, creative: Column, default: str) -> Column:
    """Guard rails and the creative part, or its default if empty."""
    return F.concat(guard, F.lit("\n\n---\n\n"), F.coalesce(F.nullif(F.trim(creative), F.lit("")), F.lit(default)))


def critic_tier(iteration: Column) -> Column:
    return F.when(iteration >= 3, "smart").otherwise("fast")


def links(lat: Column, lng: Column) -> Column:
    """A map search and a geo address of a place."""
    at = F.concat(lat.cast("string"), F.lit(","), lng.cast("string"))
    return F.struct(F.concat(F.lit("https://www.google.com/maps/search/?api=1&query="), at).alias("google_maps_url"), F.concat(F.lit("geo:"), at).alias("geo_uri"))


def summary_text(scene_type: Column, heading: Column, template: Column) -> Column:
    """One sentence: what kind of scene, which way the camera looks, and the framing. Only the first letter is large."""
    kind = F.lower(F.coalesce(F.nullif(scene_type, F.lit("")), F.lit("terrain")))
    first = F.concat(F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 1 << 30))
    degrees = F.bround(heading).cast("long").cast("string")
    return F.concat(first, F.lit(" preview facing "), geo.compass(heading), F.lit(" at "), degrees, F.lit(" degrees with "), F.replace(template, F.lit("_"), F.lit("-")), F.lit(" framing."))


def preview_anchors(views: DataFrame, features: DataFrame) -> DataFrame:
    """The anchors of each view's preview: targets (feature_id, role, x, y, in order) joined to features (area, feature_id, lat, lng, elev).

    Features that aren't there are passed over; without an elevation it is 0.
    """
    target = views.select("vp_id", "area", F.posexplode("targets").alias("pos", "t")).select("vp_id", "area", "pos", F.col("t.feature_id").alias("feature_id"), F.col("t.role").alias("label"), F.col("t.x").alias("x"), F.col("t.y").alias("y"))
    one = F.struct("pos", F.col("feature_id").alias("id"), "label", "lat", "lng", F.coalesce("elev", F.lit(0.0)).alias("alt_meters"), F.col("x").alias("desired_normalized_x"), F.col("y").alias("desired_normalized_y"))
    met = target.join(features.select("area", "feature_id", "lat", "lng", "elev"), ["area", "feature_id"]).groupBy("vp_id").agg(F.array_sort(F.collect_list(one)).alias("anchors"))
    return views.select("vp_id").join(met, "vp_id", "left").select("vp_id", F.transform("anchors", lambda a: a.dropFields("pos")).alias("anchors"))


# Names of the scores in responses.
SCORE_NAMES = {"richness": "viewshed_richness", "entropy": "terrain_entropy", "skyline": "skyline_fractal", "prospect": "prospect_refuge", "depth": "depth_layering", "mystery": "mystery", "water": "water_visibility"}


def responses(views: DataFrame, features: DataFrame, scenes: DataFrame, radius_m: float) -> DataFrame:
    """Ranked views as rows of a response, with what a preview of each needs.

    ``views``: as ``engine.ranked_views`` gives them; ``scenes``: area, scene_id,
    lat, lng, type, summary, feature_ids.
    """
    camera = F.struct(F.struct("lat", "lng", F.col("alt").alias("alt_meters")).alias("position"), F.col("head").alias("heading_deg"), F.col("pitch").alias("pitch_deg"), F.lit(0.0).alias("roll_deg"), F.col("fov").alias("fov_deg"))
    targets = F.transform("anchors", lambda a: F.struct(a["feature_id"].alias("feature_id"), a["role"].alias("role"), a["x"].alias("x_norm"), a["y"].alias("y_norm")))
    asked = views.select("vp_id", "area", F.transform("anchors", lambda a: F.struct(a["feature_id"].alias("feature_id"), a["role"].alias("role"), a["x"].alias("x"), a["y"].alias("y"))).alias("targets"))
    placed = preview_anchors(asked, features).withColumnRenamed("anchors", "preview_anchors")
    scene = scenes.select("area", "scene_id", F.struct(F.struct("lat", "lng").alias("center"), F.lit(radius_m).alias("radius_meters"), "scene_id", F.col("type").alias("scene_type"), F.col("summary").alias("scene_summary"), "feature_ids").alias("scene"))
    name = viewpoints.snake(F.col("composition"))
    composition = F.struct(name.alias("target_template"), F.get("anchors", 0)["role"].alias("subject_label"), viewpoints.horizon_of(F.col("composition")).alias("horizon_ratio"), F.col("preview_anchors").alias("anchors"))
    joined = views.join(placed, "vp_id").join(scene, ["area", "scene_id"])
    return joined.select(
        "area", F.col("viewpoint_id").alias("id"), "rank", F.col("scene_id").alias("scene"), name.alias("composition"), camera.alias("camera"), targets.alias("targets"), F.col("meters").alias("distance_meters_approx"),
        F.col("total").alias("score"), F.struct(*[F.col(a).alias(b) for a, b in SCORE_NAMES.items()]).alias("score_breakdown"), F.struct(F.col("clearance").alias("clearance_meters"), F.col("visible_ids").alias("visible_target_ids")).alias("validation"),
        F.struct(camera.alias("camera"), F.col("scene"), composition.alias("composition")).alias("preview_input"),
    )


def short_id(id_: Column) -> Column:
    """The first eight characters of an id."""
    return F.substring(id_, 1, 8)


def table_rows(artifacts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines of a table of each session's artifacts (id, summary, alt, head, pitch, fov), numbered in order; numbers are rounded half up."""
    n = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    half_up = lambda x, unit: F.concat(F.floor(F.col(x) + 0.5).cast("string"), F.lit(unit))
    cells = [n.cast("string"), short_id(F.col("id")), table_cell(F.col("summary")), half_up("alt", "m"), half_up("head", "°"), half_up("pitch", "°"), half_up("fov", "°")]
    return artifacts.select(*keys, order, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def eager(views: DataFrame, most: int = 3) -> DataFrame:
    """Of ranked views (area, rank) those that get a preview at once."""
    return views.filter(F.col("rank") <= most)


def attempt_log(attempts_: DataFrame) -> DataFrame:
    """Per preview the provider that rendered it (the first in order that succeeded) and how many were tried until then. ``attempts_``: preview_id, n, provider, ok."""
    first = F.min(F.when(F.col("ok"), F.struct("n", "provider")))
    return attempts_.groupBy("preview_id").agg(first["provider"].alias("used"), F.coalesce(first["n"], F.max("n")).alias("tries"))


def table_cell(summary: Column) -> Column:
    """A summary of 50 characters at most, with dots for what is cut."""
    return F.when(F.length(summary) > 50, F.concat(F.substring(summary, 1, 47), F.lit("..."))).otherwise(summary)
