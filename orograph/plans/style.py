"""Queries of style operators on ``embeddings``."""

from __future__ import annotations

from pyspark.sql import functions as F

from orograph.operators import style
from orograph.plans.raster import CELLS_SQL, c, cells
from orograph.plans.registry import query, table
from orograph.sources.shared import checkpointed

COSINE_SQL = "cs AS (SELECT vec_id, label, (SELECT sum(x * y) FROM (SELECT unnest(embedding)::DOUBLE AS x, unnest(q.v)::DOUBLE AS y) z) / (sqrt((SELECT sum(x * x) FROM (SELECT unnest(embedding)::DOUBLE AS x) z)) * sqrt((SELECT sum(y * y) FROM (SELECT unnest(q.v)::DOUBLE AS y) z))) AS similarity FROM embeddings, (SELECT embedding AS v FROM embeddings WHERE vec_id = 0) q)"


def compared(spark, d):
    e = table(spark, d, "embeddings")
    one = e.filter("vec_id = 0").select(c("embedding").alias("v"))  # one row
    return e.crossJoin(F.broadcast(one)).select("vec_id", "label", style.cosine(c("embedding"), c("v")).alias("similarity"))


@query("a19_cosine", f"WITH {COSINE_SQL} SELECT vec_id, round(similarity, 6) AS similarity FROM cs")
def a19(spark, d):
    return compared(spark, d).select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("t5_top_similar", f"WITH {COSINE_SQL} SELECT label, vec_id FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity DESC, vec_id) AS k FROM cs) s WHERE k <= 24")
def t5(spark, d):
    from pyspark.sql import Window as W

    return compared(spark, d).withColumn("k", F.row_number().over(W.partitionBy("label").orderBy(F.desc("similarity"), "vec_id"))).filter("k <= 24").select("label", "vec_id")


@query("n22_a18_patch_fingerprints")
def a18(spark, d):
    """The hundred numbers of every window."""
    found = style.patch_fingerprints(cells(spark, d))
    return found.select("area", "r0", "c0", F.transform("fingerprint", lambda x: F.round(x.cast("double"), 4)).alias("fingerprint"))


@query("v11_style_search")
def v11(spark, d):
    """The windows of each area that are most like the first window of area 0, and of area 1."""
    found = checkpointed(style.patch_fingerprints(cells(spark, d)))
    two = found.filter("area < 2 AND r0 = 0 AND c0 = 0").select(c("area").alias("reference_id"), c("fingerprint").alias("vector"))
    return style.best_patches(found, two).select("reference_id", "area", "r0", "c0", "rank", F.round("similarity", 4).alias("similarity"))


@query("n23_patches", f'WITH {CELLS_SQL}, size AS (SELECT area, max("row") + 1 AS h FROM cells GROUP BY area) SELECT area, r0, c0, 441 AS cells FROM size, (SELECT CAST(unnest(range(0, 44, 8)) AS INTEGER) AS r0) y, (SELECT CAST(unnest(range(0, 44, 8)) AS INTEGER) AS c0) z WHERE r0 + 21 <= h')
def n23(spark, d):
    return style.patches(cells(spark, d)).groupBy("area", "r0", "c0").agg(F.count(F.lit(1)).cast("int").alias("cells"))


@query("v7_refinement", "SELECT k, round(CASE WHEN up > s + 0.0001 THEN h + g ELSE h END, 6) AS head, round(CASE WHEN up > s + 0.0001 THEN up ELSE s END, 6) AS contour FROM (SELECT *, 0.7 * s + 0.3 * (1 - LEAST(abs(h + g - t), 360 - abs(h + g - t)) / 180.0) AS up FROM (SELECT *, 0.15 * (0.3 * (1 - LEAST(abs(h + 1 - t), 360 - abs(h + 1 - t)) / 180.0) - 0.3 * (1 - LEAST(abs(h - 1 - t), 360 - abs(h - 1 - t)) / 180.0)) / (2 + 1e-10) AS g FROM (SELECT c_custkey AS k, (c_custkey % 100) / 100.0 AS s, 2.0 + (c_custkey * 37 % 356) * 1.0 AS h, 180.0 + (c_custkey * 11 % 180) * 1.0 AS t FROM customer) a) b) e")
def v7(spark, d):
    k = c("c_custkey")
    s = table(spark, d, "customer").select(k.alias("k"), ((k % 100) / 100.0).alias("s"), (F.lit(2.0) + (k * 37 % 356) * 1.0).alias("h"), ((k * 11 % 180) * 1.0).alias("normal"))
    head, contour = style.refined(c("s"), c("h"), c("normal"))
    return s.select("k", F.round(head, 6).alias("head"), F.round(contour, 6).alias("contour"))
