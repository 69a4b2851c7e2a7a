"""Viewpoints: composition templates, camera solving, validation and clearing of near repeats."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.operators import spatial
from orograph.operators.scenes import TYPES

# Name, composition, types (None: all), targets (role, x, y), horizon, solver.
TEMPLATES = [
    ("ruleOfThirds_A", "ruleOfThirds", None, [("primary", 0.667, 0.333), ("secondary", 0.333, 0.667)], 0.333, "pnp"),
    ("ruleOfThirds_B", "ruleOfThirds", None, [("primary", 0.333, 0.333), ("secondary", 0.667, 0.667)], 0.333, "pnp"),
    ("goldenRatio_A", "goldenRatio", None, [("primary", 0.618, 0.382), ("secondary", 0.382, 0.618)], 0.382, "pnp"),
    ("goldenRatio_B", "goldenRatio", None, [("primary", 0.382, 0.382), ("secondary", 0.618, 0.618)], 0.382, "pnp"),
    ("leadingLine", "leadingLine", None, [("subject", 0.618, 0.382)], 0.45, "leading_line"),
    ("symmetry", "symmetry", ["multi-peak", "mixed-terrain"], [("left", 0.35, 0.5), ("right", 0.65, 0.5)], 0.5, "pnp"),
]
LEAST_M, MOST_M, MOST_RMS, CLOSE_M, CLOSE_DEG, CLEARANCE_M = 400.0, 15000.0, 0.08, 150.0, 12.0, 2.0


def templates(spark) -> DataFrame:
    """The six templates, a row for each type of scene they suit."""
    rows = [(i + 1, n, comp, t, targets, h, s) for i, (n, comp, types, targets, h, s) in enumerate(TEMPLATES) for t in types or TYPES]
    return spark.createDataFrame(rows, "template_ord int, template string, composition string, type string, targets array<struct<role:string,x:double,y:double>>, horizon double, solver string")


def eligible(scenes: DataFrame, compositions: list[str]) -> DataFrame:
    """Scenes (with ``type``) joined to their templates: an equi-join with a fixed small table."""
    return scenes.join(F.broadcast(templates(scenes.sparkSession).filter(F.col("composition").isin(compositions))), "type")


def behind(lat1: Column, lng1: Column, lat2: Column, lng2: Column, distance: Column) -> Column:
    """The place ``distance`` metres before the first point on the line to the second."""
    length = geo.planar(lat1, lng1, lat2, lng2)
    return F.struct((lat1 - (lat2 - lat1) / length * distance).alias("lat"), (lng1 - (lng2 - lng1) / length * distance).alias("lng"))


def fallback_distance(extent: Column) -> Column:
    return geo.clamp(extent * 2.5, LEAST_M, MOST_M)


def camera_axes(head: np.ndarray, pitch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward, right and up of cameras, (n, 3) each."""
    forward = np.stack([np.sin(head), np.cos(head), np.sin(pitch)], -1)
    forward /= np.linalg.norm(forward, axis=-1, keepdims=True)
    right = np.stack([forward[..., 1], -forward[..., 0], np.zeros_like(head)], -1)
    right /= np.linalg.norm(right, axis=-1, keepdims=True)
    return forward, right, np.cross(right, forward)


def misses(pose: np.ndarray, anchors: np.ndarray, goals: np.ndarray, pitch: np.ndarray, fov: float) -> np.ndarray:
    """How far anchors (n, k, 3) lie from their goals (n, k, 2) in the images of poses (n, 4: east, north, altitude, heading); 1 where one isn't in the image."""
    forward, right, up = camera_axes(np.radians(pose[:, 3]), np.radians(pitch))
    way = anchors - pose[:, None, :3]
    depth = np.einsum("nki,ni->nk", way, forward)
    safe = np.where(depth > 0, depth, 1.0)
    x = 0.5 + np.einsum("nki,ni->nk", way, right) / safe / (2 * math.tan(math.radians(fov / 2)))
    y = 0.5 - np.einsum("nki,ni->nk", way, up) / safe / (2 * math.tan(math.radians(fov * 9 / 32)))
    seen = (depth > 0) & (x >= 0) & (x <= 1) & (y >= 0) & (y <= 1)
    return np.where(seen[:, :, None], np.stack([x, y], -1) - goals, 1.0).reshape(len(pose), -1)


def least_squares(residual, start: np.ndarray, most: int = 200, tolerance: float = 1e-8) -> np.ndarray:
    """Levenberg and Marquardt with forward differences and Nielsen's damping, for many problems (rows of ``start``) at once; a row that has converged is left alone."""
    x, damp, growth = start.astype(float).copy(), np.full(len(start), 1e-3), np.full(len(start), 2.0)
    live = np.arange(len(x))
    r = residual(x, live)
    cost = (r**2).sum(1)
    for _ in range(most):
        if not len(live):
            break
        at, here = x[live], r[live]
        step = np.sqrt(np.finfo(float).eps) * np.maximum(1.0, np.abs(at))
        jac = np.stack([(residual(at + step * (np.arange(at.shape[1]) == i), live) - here) / step[:, i : i + 1] for i in range(at.shape[1])], 2)
        grad = np.einsum("nri,nr->ni", jac, here)
        normal = np.einsum("nri,nrj->nij", jac, jac)
        pull = damp[live, None] * np.maximum(np.einsum("nii->ni", normal), 1e-12)
        move = -np.linalg.solve(normal + pull[:, :, None] * np.eye(at.shape[1]), grad[:, :, None])[:, :, 0]
        new = residual(at + move, live)
        fresh = (new**2).sum(1)
        gain = cost[live] - fresh
        # What the linear model promised; a step stays if it kept some of that.
        promised = (move * (pull * move - grad)).sum(1)
        ratio = gain / np.maximum(promised, 1e-300)
        better = (gain > 0) & (ratio > 1e-4)
        done = (np.abs(grad).max(1) < tolerance) | (damp[live] > 1e12)
        done |= better & ((gain < tolerance * cost[live]) | (np.linalg.norm(move, axis=1) < tolerance * np.linalg.norm(at, axis=1)))
        won = live[better]
        x[won] += move[better]
        r[won], cost[won] = new[better], fresh[better]
        damp[live] *= np.where(better, np.maximum(1 / 3, 1 - (2 * np.clip(ratio, 0, 2) - 1) ** 3), growth[live])
        growth[live] = np.where(better, 2.0, np.minimum(growth[live] * 2, 1e6))
        live = live[~done]
    return x


def solved(pairs: DataFrame, key: str, fov: float) -> DataFrame:
    """Poses (e, n, z, heading, rms, accepted) that show two anchors (e1, n1, z1, e2, n2, z2) at two targets (x1, y1, x2, y2).

    ``pairs`` has horizon, distance and relief as well. The start is behind the
    anchors' midpoint as seen from the first, above the higher one. A map over
    batches, whose rows are solved together.
    """
    numbers = ["e1", "n1", "z1", "e2", "n2", "z2", "x1", "y1", "x2", "y2", "horizon", "distance", "relief"]
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for frame in batches:
            if not len(frame):
                continue
            v = frame[numbers].to_numpy(float)
            anchors, goals = v[:, :6].reshape(-1, 2, 3), v[:, 6:10].reshape(-1, 2, 2)
            horizon, distance, relief = v[:, 10], v[:, 11], v[:, 12]
            pitch = np.degrees(np.arctan((horizon - 0.5) * 2 * math.tan(math.radians(fov * 9 / 32))))
            middle = anchors[:, :, :2].mean(1)
            way = middle - anchors[:, 0, :2]
            length = np.linalg.norm(way, axis=1)
            camera = middle + way / np.where(length > 0, length, 1.0)[:, None] * distance[:, None]
            height = anchors[:, :, 2].max(1) + np.maximum(30.0, 0.15 * relief)
            head = np.degrees(np.arctan2(middle[:, 0] - camera[:, 0], middle[:, 1] - camera[:, 1])) % 360
            x = least_squares(lambda p, rows: misses(p, anchors[rows], goals[rows], pitch[rows], fov), np.column_stack([camera, height, head]))
            rms = np.sqrt((misses(x, anchors, goals, pitch, fov) ** 2).mean(1))
            out = pd.DataFrame({"e": x[:, 0], "n": x[:, 1], "z": x[:, 2], "heading": x[:, 3] % 360, "rms": rms, "accepted": rms <= MOST_RMS})
            yield pd.concat([frame[[key]].reset_index(drop=True), out], axis=1)

    return pairs.select(key, *[F.col(n).cast("double").alias(n) for n in numbers]).mapInPandas(run, f"`{key}` {kind}, e double, n double, z double, heading double, rms double, accepted boolean")


def rejection(inside: Column, clearance: Column) -> Column:
    """Why a pose goes: out of bounds, then too near the ground; null if it stays."""
    return F.when(~inside, "outOfBounds").when(clearance < CLEARANCE_M, "underground")


REJECTIONS = ("templateIneligible", "noConvergence", "outOfBounds", "underground", "occluded")


def deduplicated(views: DataFrame, by: list[str]) -> DataFrame:
    """Best first (then by id) within groups, a view goes if one that stays is close in place and heading. A group has few views: those of a scene and composition."""
    close = lambda v, t: (geo.planar(v["lat"], v["lng"], t["lat"], t["lng"]) < CLOSE_M) & (geo.heading_delta(v["head"], t["head"]) < CLOSE_DEG)
    return spatial.greedy(views, by, [-F.col("score"), F.col("id")], close)


def in_order(views: DataFrame, by: list[str], name: str) -> DataFrame:
    """Adds the place of views within groups: by total, score of the scene, the scene's id and the view's as strings."""
    w = W.partitionBy(*by).orderBy(F.desc("total"), F.desc("scene_score"), F.col("scene_id"), F.col("vp_id"))
    return views.withColumn(name, F.row_number().over(w))


def snake(composition: Column) -> Column:
    """A composition's name with underscores, as in ``rule_of_thirds``; ``camel`` goes back."""
    return F.lower(F.regexp_replace(composition, "([A-Z])", "_$1"))


def camel(composition: Column) -> Column:
    parts = F.split(composition, "_")
    return F.concat(F.get(parts, 0), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), F.initcap), ""))


def horizon_of(composition: Column) -> Column:
    """A composition's horizon, a third by default."""
    known = {c: h for _, c, _, _, h, _ in TEMPLATES}
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), composition), F.lit(0.333))


def contexts(scene_features: DataFrame) -> DataFrame:
    """A row a scene: its points and its lines, best first (ids as strings break ties), its extent and relief.

    ``scene_features``: area, scene_id, kind, feature_id, score, lat, lng, elev,
    path (places); a scene has a bounded number of features. The extent is the
    largest distance between two of them; the relief that of the points that have
    an elevation.
    """
    every = F.collect_list(F.struct((-F.col("score")).alias("s"), "feature_id", "kind", "lat", "lng", "elev", "path"))
    rows = scene_features.groupBy("area", "scene_id").agg(F.array_sort(every).alias("f"))
    of = lambda *kinds: F.filter("f", lambda x: x["kind"].isin(*kinds))
    pairs = F.flatten(F.transform("f", lambda a: F.transform("f", lambda b: geo.planar(a["lat"], a["lng"], b["lat"], b["lng"]))))
    heights = F.filter(F.transform(F.col("points"), lambda x: x["elev"]), lambda e: e.isNotNull())
    rows = rows.select("area", "scene_id", of("peaks", "cliffs").alias("points"), of("ridges", "waterChannels").alias("lines"), F.array_max(pairs).alias("extent"))
    return rows.withColumn("relief", F.coalesce(F.array_max(heights) - F.array_min(heights), F.lit(0.0)))


def anchored(eligible_: DataFrame) -> DataFrame:
    """Adds the anchors of a scene's template by role (null where it can't be filled): ``first``, ``second`` and ``line``.

    Thirds and the golden ratio take the best point and the best line, or the
    second point; a leading line the best ridge, else water, and the best point;
    symmetry the two best peaks, else cliffs, the western one first.
    """
    point = lambda i: F.get("points", i)
    only = lambda column, kind: F.filter(column, lambda x: x["kind"] == kind)
    peaks, cliffs = only("points", "peaks"), only("points", "cliffs")
    pair = F.when(F.size(peaks) >= 2, peaks).when(F.size(cliffs) >= 2, cliffs)
    west = F.get(pair, 0)["lng"] <= F.get(pair, 1)["lng"]
    balanced, symmetric, leading = F.col("composition").isin("ruleOfThirds", "goldenRatio"), F.col("composition") == "symmetry", F.col("composition") == "leadingLine"
    first = F.when(balanced | leading, point(0)).when(symmetric, F.when(west, F.get(pair, 0)).otherwise(F.get(pair, 1)))
    second = F.when(balanced, F.coalesce(F.get("lines", 0), point(1))).when(symmetric, F.when(west, F.get(pair, 1)).otherwise(F.get(pair, 0)))
    line = F.when(leading, F.coalesce(F.get(only("lines", "ridges"), 0), F.get(only("lines", "waterChannels"), 0)))
    filled = eligible_.withColumns({"first": first, "second": second, "line": line})
    return filled.withColumn("fits", F.col("first").isNotNull() & F.when(leading, F.col("line").isNotNull()).otherwise(F.col("second").isNotNull()))


def entry(path: Column) -> Column:
    """Where a leading line is entered: the end of its first third."""
    return F.get(path, F.greatest(F.lit(0), F.floor(F.size(path) / 3).cast("int") - 1))


def top_parts(scores: dict[str, Column], most: int = 3) -> Column:
    """Names of the largest scores, the first of equals first."""
    parts = F.array(*[F.struct((-v).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("name")) for i, (n, v) in enumerate(scores.items())])
    return F.transform(F.slice(F.array_sort(parts), 1, most), lambda x: x["name"])
