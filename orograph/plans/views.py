"""Queries of the whole flow on rasters: features, scenes, viewpoints with their scores, style matching and responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph import engine
from orograph.operators import previews, style
from orograph.plans.raster import CELL, bounds, c, cells
from orograph.plans.registry import query
from orograph.sources import raster
from orograph.sources.shared import checkpointed

COMPOSITIONS = ["ruleOfThirds", "goldenRatio", "leadingLine", "symmetry"]


def flow(spark, d):
    """Analysis and viewpoints of every full raster, smoothed, so that it has valleys to follow."""
    raw = raster.whole(cells(spark, d))
    rows = checkpointed(engine.stencil.gaussian(raw, "elev", "__s", 2.0).withColumn("elev", c("__s") * 1.0).drop("__s"))
    where = bounds(spark, d)
    analysis = engine.analyze(rows, where, CELL, raster.SIDE, threshold=12)
    return rows, where, analysis


@query("v10_viewpoints")
def v10(spark, d):
    """Ranked views of every raster, with the response row of each, which holds the input of its preview."""
    rows, where, analysis = flow(spark, d)
    found = engine.find_viewpoints(analysis, rows, where, raster.SIDE, CELL, COMPOSITIONS)["viewpoints"]
    out = previews.responses(found, analysis["features"], analysis["scenes"], 3000.0)
    return out.select("area", "id", "scene", "composition", "score", F.to_json(F.struct("camera", "targets", "score_breakdown", "validation", "preview_input")).alias("response"))


@query("a16_v4_summary")
def summary(spark, d):
    """Per area how many scenes and candidates there are, and how many went for each reason."""
    rows, where, analysis = flow(spark, d)
    return engine.view_summary(analysis["scenes"], engine.viewpoint_candidates(analysis, rows, where, raster.SIDE, CELL, COMPOSITIONS))


@query("v11_style_viewpoints")
def v11(spark, d):
    """Views ranked by how like the first window of area 0 their scenes' windows are."""
    rows, where, analysis = flow(spark, d)
    one = style.patch_fingerprints(rows.filter("area = 0 AND row < 21 AND col < 21")).select(F.lit(0).alias("reference_id"), c("fingerprint").alias("vector"))
    found = engine.style_viewpoints(analysis, rows, where, raster.SIDE, CELL, one, COMPOSITIONS)["viewpoints"]
    return found.select("area", "vp_id", "scene_id", "patch_id", "head", "contour", "patch", F.round("style_score", 4).alias("style_score"), "style_rank")
