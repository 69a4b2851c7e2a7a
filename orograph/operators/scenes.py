"""Scenes: hotspots with the features around them, classified, scored, and cleared of near repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.operators import spatial

# Fixed values.
CLUSTER_M, MOST_SCENES, DEDUP_M = 5000.0, 12, 2000.0
KINDS = ("peaks", "ridges", "cliffs", "waterChannels")
TYPES = ("peak-water", "peak-ridge", "cliff-water", "multi-peak", "mixed-terrain")
SUMMARIES = {
    "peak-water": "Summit overlooking water feature",
    "peak-ridge": "Prominent summit with connecting skyline ridge",
    "cliff-water": "Dramatic cliff face above water channel",
    "multi-peak": "Cluster of prominent summits",
    "mixed-terrain": "Varied terrain with multiple interesting features",
}


def classify(kinds: Column) -> Column:
    """Type of a scene from the kinds of its features (an array, repeats counted)."""
    has = lambda k: F.array_contains(kinds, k)
    return (
        F.when(has("peaks") & has("waterChannels"), "peak-water")
        .when(has("peaks") & has("ridges"), "peak-ridge")
        .when(has("cliffs") & has("waterChannels"), "cliff-water")
        .when(F.size(F.filter(kinds, lambda k: k == "peaks")) >= 2, "multi-peak")
        .otherwise("mixed-terrain")
    )


def summary_of(scene_type: Column) -> Column:
    """The sentence of a scene's type."""
    return F.create_map(*[x for kv in SUMMARIES.items() for x in map(F.lit, kv)])[scene_type]


def candidates(hotspots: DataFrame, features: DataFrame) -> DataFrame:
    """Hotspots (area, hotspot_id, ord, lat, lng, score) with two or more features within CLUSTER_M: ids in order of kind and rank, type, score."""
    f = features.select(F.col("area").alias("__area"), "feature_id", F.col("kind"), F.col("ord").alias("__ord"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"), F.col("score").alias("__score"))
    near = spatial.within(hotspots, f, CLUSTER_M).filter(F.col("area") == F.col("__area"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # The mean is summed in the features' order: in that of a shuffle its last digit, and so what is rounded from a tie, would differ from run to run.
    parts = F.filter(F.transform(F.sort_array(F.collect_list(F.struct("__ord", rank.alias("k"), "__score"))), lambda x: x["__score"]), lambda s: s.isNotNull())
    anchors = F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.size(parts))
    grouped = near.groupBy("area", "hotspot_id", "ord", "lat", "lng", "score").agg(F.array_sort(F.collect_list(F.struct(rank.alias("k"), F.col("__ord").alias("o"), "feature_id", "kind"))).alias("f"), anchors.alias("anchors"))
    kept = grouped.filter(F.size("f") >= 2).withColumn("type", classify(F.col("f.kind")))
    return kept.select("area", "hotspot_id", "ord", "lat", "lng", F.col("f.feature_id").alias("feature_ids"), "type", F.bround(F.lit(0.6) * F.col("score") + F.lit(0.4) * F.col("anchors"), 2).alias("score"))


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def deduplicated(found: DataFrame) -> DataFrame:
    """Best first, a scene goes if it is close to a kept one and shares more than half of their features. An area has few scenes, so it is a group."""
    def close(v: Column, t: Column) -> Column:
        near = geo.haversine(v["lat"], v["lng"], t["lat"], t["lng"]) < DEDUP_M
        return near & (jaccard(v["feature_ids"], t["feature_ids"]) > 0.5)

    return spatial.greedy(found, ["area"], [-F.col("score"), F.col("ord")], close)


def scenes(hotspots: DataFrame, features: DataFrame) -> DataFrame:
    """The first MOST_SCENES of each area, by type, then score."""
    kept = deduplicated(candidates(hotspots, features))
    w = W.partitionBy("area").orderBy(F.array_position(F.array(*map(F.lit, TYPES)), F.col("type")), F.desc("score"), "ord")
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= MOST_SCENES).select("area", F.concat(F.lit("scene-"), "rank").alias("scene_id"), "rank", "type", "lat", "lng", "feature_ids", summary_of(F.col("type")).alias("summary"), "score")
