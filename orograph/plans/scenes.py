"""Queries of scenes and views. Suppliers stand for hotspots and cameras, customers for features; a thousand keys share a square, and squares follow each other eastwards, so that the table's size isn't the density's."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.functions import geo
from orograph.operators import features as land
from orograph.operators import previews, profiles, scenes, spatial, style, viewpoints, visibility
from orograph.plans.raster import CELLS_SQL, c, cells
from orograph.plans.registry import query, table

HOT_SQL = "hot AS (SELECT s_suppkey % 5 + s_suppkey // 1000 * 5 AS area, 'hotspot-' || s_suppkey AS hotspot_id, CAST(s_suppkey AS INTEGER) AS ord, 39.5 + (s_suppkey * 7919 % 1000) / 4000.0 AS lat, -105.5 + (s_suppkey * 613 % 1000) / 4000.0 + (s_suppkey // 1000 % 900) * 0.3 AS lng, (s_suppkey % 90 + 10) / 100.0 AS score FROM supplier)"
FEAT_SQL = "feat AS (SELECT c_custkey % 5 + c_custkey // 1000 * 5 AS area, c_custkey % 4 AS kn, (['peaks','ridges','cliffs','waterChannels'])[c_custkey % 4 + 1] AS kind, (['peak-','ridge-','cliff-','water-'])[c_custkey % 4 + 1] || c_custkey AS feature_id, CAST(c_custkey AS INTEGER) AS ord, 39.5 + (c_custkey * 104729 % 1000) / 4000.0 AS lat2, -105.5 + (c_custkey * 271 % 1000) / 4000.0 + (c_custkey // 1000 % 900) * 0.3 AS lng2, (c_custkey % 100) / 100.0 AS fscore FROM customer)"
NEAR_SQL = f"{HOT_SQL}, {FEAT_SQL}, near AS (SELECT *, 2 * 6378137.0 * asin(sqrt(power(sin(radians(lat2 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(lat2)) * power(sin(radians(lng2 - lng) / 2), 2))) AS meters FROM (SELECT h.area, hotspot_id, h.ord, lat, lng, score, kn, kind, feature_id, f.ord AS ford, lat2, lng2, fscore FROM hot h JOIN feat f ON f.area = h.area) p)"
CAND_SQL = f"""{NEAR_SQL}, cand AS (SELECT area, hotspot_id, ord, lat, lng, score, list(feature_id ORDER BY kn, ford) AS ids, count(*) AS n, avg(fscore) AS anchors, count(*) FILTER (kn = 0) AS p, count(*) FILTER (kn = 1) AS r, count(*) FILTER (kn = 2) AS cl, count(*) FILTER (kn = 3) AS w FROM near WHERE meters <= 5000 GROUP BY area, hotspot_id, ord, lat, lng, score HAVING count(*) >= 2)"""
TYPE_SQL = "CASE WHEN p > 0 AND w > 0 THEN 'peak-water' WHEN p > 0 AND r > 0 THEN 'peak-ridge' WHEN cl > 0 AND w > 0 THEN 'cliff-water' WHEN p >= 2 THEN 'multi-peak' ELSE 'mixed-terrain' END"


def area_of(k):
    """Five areas a square."""
    return k % 5 + F.floor(k / 1000) * 5


def hotspots(spark, d):
    k = c("s_suppkey")
    return table(spark, d, "supplier").select(area_of(k).alias("area"), F.concat(F.lit("hotspot-"), k).alias("hotspot_id"), k.cast("int").alias("ord"), (F.lit(39.5) + (k * 7919 % 1000) / 4000.0).alias("lat"), (F.lit(-105.5) + (k * 613 % 1000) / 4000.0 + F.floor(k / 1000) % 900 * 3 / 10.0).alias("lng"), ((k % 90 + 10) / 100.0).alias("score"))


def features(spark, d):
    k = c("c_custkey")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (k % 4 + 1).cast("int"))
    return table(spark, d, "customer").select(area_of(k).alias("area"), pick(*scenes.KINDS).alias("kind"), F.concat(pick("peak-", "ridge-", "cliff-", "water-"), k).alias("feature_id"), k.cast("int").alias("ord"), (F.lit(39.5) + (k * 104729 % 1000) / 4000.0).alias("lat"), (F.lit(-105.5) + (k * 271 % 1000) / 4000.0 + F.floor(k / 1000) % 900 * 3 / 10.0).alias("lng"), ((k % 100) / 100.0).alias("score"))


@query("j1_distance_join", f"WITH {NEAR_SQL} SELECT hotspot_id, feature_id, round(meters, 3) AS meters FROM near WHERE meters <= 5000")
def j1(spark, d):
    f = features(spark, d).select(c("area").alias("area2"), "feature_id", c("lat").alias("lat2"), c("lng").alias("lng2"))
    return spatial.within(hotspots(spark, d), f, 5000.0).filter("area = area2").select("hotspot_id", "feature_id", F.round("meters", 3).alias("meters"))


@query("p29_a14_scene_candidates", f"WITH {CAND_SQL} SELECT area, hotspot_id, {TYPE_SQL} AS type, array_to_string(ids, ',') AS ids, CAST(n AS INTEGER) AS n, round(0.6 * score + 0.4 * anchors, 4) AS score FROM cand")
def p29(spark, d):
    f = features(spark, d)
    found = scenes.candidates(hotspots(spark, d), f)
    anchors = found.select("hotspot_id", F.explode("feature_ids").alias("feature_id")).join(f.select("feature_id", c("score").alias("s")), "feature_id").groupBy("hotspot_id").agg(F.avg("s").alias("anchors"))
    exact = found.drop("score").join(anchors, "hotspot_id").join(hotspots(spark, d).select("hotspot_id", "score"), "hotspot_id")
    return exact.select("area", "hotspot_id", "type", F.array_join("feature_ids", ",").alias("ids"), F.size("feature_ids").alias("n"), F.round(F.lit(0.6) * c("score") + F.lit(0.4) * c("anchors"), 4).alias("score"))


@query("a17_jaccard", f"WITH {CAND_SQL} SELECT a.hotspot_id AS a, b.hotspot_id AS b, round(len(list_intersect(a.ids, b.ids)) / CAST(len(list_distinct(list_concat(a.ids, b.ids))) AS DOUBLE), 6) AS overlap FROM cand a JOIN cand b ON a.area = b.area AND a.ord < b.ord WHERE len(list_intersect(a.ids, b.ids)) > 0")
def a17(spark, d):
    found = scenes.candidates(hotspots(spark, d), features(spark, d)).select("area", "ord", "hotspot_id", F.size("feature_ids").alias("n"), F.explode("feature_ids").alias("f"))
    a, b = found.select("area", c("ord").alias("o1"), c("hotspot_id").alias("a"), c("n").alias("n1"), "f"), found.select("area", c("ord").alias("o2"), c("hotspot_id").alias("b"), c("n").alias("n2"), "f")
    shared = a.join(b, ["area", "f"]).filter("o1 < o2").groupBy("a", "b", "n1", "n2").agg(F.count(F.lit(1)).alias("both"))
    return shared.select("a", "b", F.round(c("both") / (c("n1") + c("n2") - c("both")), 6).alias("overlap"))


ORDERED_SQL = f"""{CAND_SQL}, typed AS (SELECT area, ord, lat, lng, ids, {TYPE_SQL} AS type, round_even(0.6 * score + 0.4 * anchors, 2) AS score FROM cand), seq AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY score DESC, ord) AS k FROM typed),
greedy AS (SELECT area, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(lat DOUBLE, lng DOUBLE, ids VARCHAR[])[]) AS kept, false AS took FROM (SELECT DISTINCT area FROM seq) a UNION ALL SELECT g.area, g.k + 1, CASE WHEN close THEN kept ELSE list_append(kept, {{'lat': lat, 'lng': lng, 'ids': ids}}) END, NOT close FROM (SELECT g.*, s.lat, s.lng, s.ids, len(list_filter(g.kept, lambda x: 2 * 6378137.0 * asin(sqrt(power(sin(radians(x.lat - s.lat) / 2), 2) + cos(radians(s.lat)) * cos(radians(x.lat)) * power(sin(radians(x.lng - s.lng) / 2), 2))) < 2000 AND len(list_intersect(x.ids, s.ids)) / CAST(len(list_distinct(list_concat(x.ids, s.ids))) AS DOUBLE) > 0.5)) > 0 AS close FROM greedy g JOIN seq s ON s.area = g.area AND s.k = g.k + 1) g)"""


@query("f8_scenes", f"WITH RECURSIVE {ORDERED_SQL}, r AS (SELECT s.*, row_number() OVER (PARTITION BY s.area ORDER BY list_position(['peak-water','peak-ridge','cliff-water','multi-peak','mixed-terrain'], type), score DESC, ord) AS rank FROM seq s JOIN greedy g ON g.area = s.area AND g.k = s.k AND g.took) SELECT area, 'scene-' || rank AS scene_id, type, CAST(len(ids) AS INTEGER) AS n, lat, lng FROM r WHERE rank <= 12")
def f8(spark, d):
    return scenes.scenes(hotspots(spark, d), features(spark, d)).select("area", "scene_id", "type", F.size("feature_ids").alias("n"), "lat", "lng")


@query("p30_scene_summaries", f"WITH {CAND_SQL} SELECT hotspot_id, CASE {TYPE_SQL} WHEN 'peak-water' THEN 'Summit overlooking water feature' WHEN 'peak-ridge' THEN 'Prominent summit with connecting skyline ridge' WHEN 'cliff-water' THEN 'Dramatic cliff face above water channel' WHEN 'multi-peak' THEN 'Cluster of prominent summits' ELSE 'Varied terrain with multiple interesting features' END AS summary FROM cand")
def p30(spark, d):
    return scenes.candidates(hotspots(spark, d), features(spark, d)).select("hotspot_id", scenes.summary_of(c("type")).alias("summary"))


MEMBER_SQL = f"{NEAR_SQL}, m AS (SELECT area, hotspot_id, kind, kn, feature_id, fscore, lat2 AS lat, lng2 AS lng, CASE WHEN kn = 0 THEN 1000 + ford % 900 END AS elev FROM near WHERE meters <= 5000)"


def scene_members(spark, d):
    """Features of each hotspot's scene; only peaks have an elevation."""
    f = features(spark, d).select(c("area").alias("area2"), "kind", "feature_id", c("score").alias("fscore"), c("lat").alias("lat2"), c("lng").alias("lng2"), c("ord").alias("ford"))
    near = spatial.within(hotspots(spark, d), f, 5000.0).filter("area = area2")
    elev = F.when(c("kind") == "peaks", (c("ford") % 900 + 1000).cast("double"))
    return near.select("area", c("hotspot_id").alias("scene_id"), "kind", "feature_id", c("fscore").alias("score"), c("lat2").alias("lat"), c("lng2").alias("lng"), elev.alias("elev"), F.lit(None).cast("array<struct<lat:double,lng:double>>").alias("path"))


@query("a15_scene_relief", f"WITH {MEMBER_SQL} SELECT hotspot_id AS scene_id, CAST(coalesce(max(elev) FILTER (kn IN (0, 2)) - min(elev) FILTER (kn IN (0, 2)), 0) AS DOUBLE) AS relief, count(*) FILTER (kn IN (0, 2)) AS points, count(*) FILTER (kn IN (1, 3)) AS lines FROM m GROUP BY hotspot_id")
def a15(spark, d):
    return viewpoints.contexts(scene_members(spark, d)).select("scene_id", "relief", F.size("points").cast("long").alias("points"), F.size("lines").cast("long").alias("lines"))


ANCHOR_SQL = f"""{MEMBER_SQL}, sc AS (SELECT hotspot_id AS scene_id, list({{'s': -fscore, 'f': feature_id, 'lng': lng, 'kn': kn}} ORDER BY fscore DESC, feature_id) AS f FROM m GROUP BY hotspot_id), pl AS (SELECT scene_id, list_filter(f, lambda x: x.kn IN (0, 2)) AS p, list_filter(f, lambda x: x.kn IN (1, 3)) AS l, list_filter(f, lambda x: x.kn = 0) AS pk, list_filter(f, lambda x: x.kn = 2) AS cl, list_filter(f, lambda x: x.kn = 1) AS rg, list_filter(f, lambda x: x.kn = 3) AS wt FROM sc), pr AS (SELECT *, CASE WHEN len(pk) >= 2 THEN pk WHEN len(cl) >= 2 THEN cl END AS pair FROM pl),
an AS (SELECT scene_id, 'goldenRatio_A' AS template, p[1].f AS first, coalesce(l[1].f, p[2].f) AS second, NULL AS line FROM pr UNION ALL SELECT scene_id, 'leadingLine', p[1].f, NULL, coalesce(rg[1].f, wt[1].f) FROM pr UNION ALL SELECT scene_id, 'symmetry', CASE WHEN pair[1].lng <= pair[2].lng THEN pair[1].f ELSE pair[2].f END, CASE WHEN pair[1].lng <= pair[2].lng THEN pair[2].f ELSE pair[1].f END, NULL FROM pr)"""


@query("t7_j5_anchors", f"WITH {ANCHOR_SQL} SELECT scene_id, template, first, second, line, first IS NOT NULL AND CASE WHEN template = 'leadingLine' THEN line IS NOT NULL ELSE second IS NOT NULL END AS fits FROM an")
def t7(spark, d):
    """The features that fill each template's roles, best first."""
    known = viewpoints.contexts(scene_members(spark, d)).withColumn("type", F.lit("mixed-terrain"))
    tried = viewpoints.eligible(known, ["goldenRatio", "leadingLine", "symmetry"]).filter("template != 'goldenRatio_B'")
    return viewpoints.anchored(tried).select("scene_id", "template", *[c(f"{x}.feature_id").alias(x) for x in ("first", "second", "line")], "fits")


@query("j4_scene_extent", f"WITH {NEAR_SQL}, f AS (SELECT * FROM near WHERE meters <= 5000) SELECT a.hotspot_id, round(max(sqrt(power((b.lat2 - a.lat2) * 111320.0, 2) + power((b.lng2 - a.lng2) * 111320.0 * cos(radians((a.lat2 + b.lat2) / 2)), 2))), 3) AS extent FROM f a JOIN f b ON a.hotspot_id = b.hotspot_id AND a.ford < b.ford GROUP BY a.hotspot_id")
def j4(spark, d):
    """Largest distance between two features of a hotspot, which has a bounded number of them."""
    found = viewpoints.contexts(scene_members(spark, d)).filter(F.size("points") + F.size("lines") >= 2)
    return found.select(c("scene_id").alias("hotspot_id"), F.round("extent", 3).alias("extent"))


PATCH_SQL = f"{HOT_SQL}, {FEAT_SQL}, close AS (SELECT hotspot_id, feature_id, kn, f.ord AS ford FROM hot h JOIN feat f ON f.area = h.area AND sqrt(power((lat2 - lat) * 111320.0, 2) + power((lng2 - lng) * 111320.0 * cos(radians((lat + lat2) / 2)), 2)) < 2000)"


@query("j6_j7_patch_joins", f"WITH {PATCH_SQL} SELECT hotspot_id, arg_min(feature_id, ford) AS first_scene, array_to_string(list(feature_id ORDER BY kn, ford), ',') AS features FROM close GROUP BY hotspot_id")
def j6(spark, d):
    """Windows (hotspots) with the first scene and all features nearer than a bound on the plane."""
    f = features(spark, d).select(c("area").alias("area2"), "feature_id", "kind", c("ord").alias("ford"), c("lat").alias("lat2"), c("lng").alias("lng2"))
    near = spatial.within(hotspots(spark, d), f, 2000.0, strict=True, flat=True).filter("area = area2")
    kind = F.array_position(F.array(*map(F.lit, scenes.KINDS)), c("kind"))
    g = near.groupBy("hotspot_id").agg(F.min_by("feature_id", "ford").alias("first_scene"), F.array_sort(F.collect_list(F.struct(kind.alias("k"), "ford", "feature_id"))).alias("f"))
    return g.select("hotspot_id", "first_scene", F.array_join(c("f.feature_id"), ",").alias("features"))


@query("j8_u3_patch_scenes", f"WITH {HOT_SQL}, b AS (SELECT area, ord // 3 AS scene, min(ord) AS rank, arg_min(score, ord) AS similarity FROM hot GROUP BY ALL) SELECT area, 'scene-' || scene AS scene_id, 'style-patch-' || rank AS patch_id, similarity FROM b")
def j8(spark, d):
    """The first window, by rank, of each scene: three windows share one here."""
    placed = hotspots(spark, d).select("area", F.concat(F.lit("scene-"), F.floor(c("ord") / 3)).alias("scene_id"), c("ord").alias("rank"), c("score").alias("similarity"), F.array(F.lit("x")).alias("feature_ids"))
    return style.scene_patches(placed).select("area", "scene_id", "patch_id", "similarity")


@query("j9_preview_anchors", f"WITH {FEAT_SQL}, t AS (SELECT s_suppkey AS vp, s_suppkey % 5 + (s_suppkey * 5 + s_suppkey % 5) // 1000 * 5 AS area, unnest([0, 1]) AS pos FROM supplier), k AS (SELECT vp, area, pos, vp * 5 + vp % 5 + pos * 5 AS ck FROM t) SELECT vp, array_to_string(list(feature_id || ':' || CAST(CASE WHEN kn = 0 THEN 1000 + ck ELSE 0 END AS BIGINT) ORDER BY pos), ',') AS anchors FROM k JOIN feat ON feat.ord = ck AND feat.area = k.area GROUP BY vp")
def j9(spark, d):
    """Targets of views joined to features; those beyond the table are passed over, only peaks have an elevation."""
    k = c("s_suppkey")
    key = lambda pos: k * 5 + k % 5 + pos * 5
    prefix = lambda x: F.element_at(F.array(*map(F.lit, ("peak-", "ridge-", "cliff-", "water-"))), (x % 4 + 1).cast("int"))
    target = lambda pos: F.struct(F.concat(prefix(key(pos)), key(pos)).alias("feature_id"), F.lit("primary").alias("role"), F.lit(0.5).alias("x"), F.lit(0.5).alias("y"))
    views = table(spark, d, "supplier").select(k.alias("vp_id"), area_of(key(0)).alias("area"), F.array(target(0), target(1)).alias("targets"))
    f = features(spark, d).withColumn("elev", F.when(c("kind") == "peaks", (c("ord") + 1000).cast("double")))
    found = previews.preview_anchors(views, f).filter("anchors is not null")
    return found.select(c("vp_id").alias("vp"), F.array_join(F.transform("anchors", lambda a: F.concat_ws(":", a["id"], a["alt_meters"].cast("long").cast("string"))), ",").alias("anchors"))


@query("t6_top_parts", "SELECT s_suppkey AS vp, array_to_string(list_transform(list_sort([{'v': -(s_suppkey % 11) / 10.0, 'i': 0, 'n': 'richness'}, {'v': -(s_suppkey % 7) / 10.0, 'i': 1, 'n': 'entropy'}, {'v': -(s_suppkey % 5) / 10.0, 'i': 2, 'n': 'skyline'}, {'v': -(s_suppkey % 3) / 10.0, 'i': 3, 'n': 'prospect'}])[1:3], lambda x: x.n), ',') AS top FROM supplier")
def t6(spark, d):
    k = c("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("vp"), F.array_join(viewpoints.top_parts({n: (k % m) / 10.0 for n, m in (("richness", 11), ("entropy", 7), ("skyline", 5), ("prospect", 3))}), ",").alias("top"))


@query("t2_ranking", "SELECT o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey * 31 % 10 DESC, o_orderkey * 17 % 7 DESC, 'scene-' || o_orderkey % 13, 'v-' || o_orderkey) AS INTEGER) AS rank FROM orders")
def t2(spark, d):
    """Views by score, then score of the scene, then ids as strings."""
    k = c("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("id"), c("o_custkey").alias("area"), (k * 31 % 10).alias("total"), (k * 17 % 7).alias("scene_score"), F.concat(F.lit("scene-"), k % 13).alias("scene_id"), F.concat(F.lit("v-"), k).alias("vp_id"))
    return viewpoints.in_order(o, ["area"], "rank").select("id", "rank")


CAM_SQL = 'cam AS (SELECT s_suppkey AS vp_id, s_suppkey % 7 AS area, 40.0 - (s_suppkey % 40) / 2000.0 - 0.01 AS lat, -105.0 + (s_suppkey * 7 % 40) / 1500.0 + 0.01 AS lng, 1800.0 + s_suppkey % 500 AS alt, (s_suppkey * 37 % 360) + 0.5 AS head, 40.0 + s_suppkey % 60 AS fov, 40.0 AS north, 39.955 AS south, -104.94 AS east, -105.0 AS west FROM supplier)'
RAY_SQL = f"""{CELLS_SQL}, {CAM_SQL}, ray0 AS (SELECT *, sqrt(power(radians(north - south) * 6378137.0, 2) + power(radians(east - west) * 6378137.0 * cos(radians((north + south) / 2)), 2)) * step / 40 AS dist, radians(head - fov / 2 + fov * ray / 89.0) AS az FROM cam, (SELECT unnest(range(0, 90)) AS ray) a, (SELECT unnest(range(1, 41)) AS step) b),
ray1 AS (SELECT *, CAST(round_even((north - (lat + degrees(dist * cos(az) / 6378137.0))) / (north - south) * 63.0, 0) AS INTEGER) AS "row", CAST(round_even((lng + degrees(dist * sin(az) / (6378137.0 * cos(radians(lat)))) - west) / (east - west) * 63.0, 0) AS INTEGER) AS col FROM ray0),
ray2 AS (SELECT r.*, e.elev, atan2(e.elev - alt, dist) AS angle FROM ray1 r JOIN cells e ON e.area = r.area AND e."row" = r."row" AND e.col = r.col),
view AS MATERIALIZED (SELECT *, angle > coalesce(max(angle) OVER (PARTITION BY vp_id, ray ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -pi() / 2) AS visible FROM ray2)"""


def bounds_column():
    return F.struct(F.lit(40.0).alias("north"), F.lit(39.955).alias("south"), F.lit(-104.94).alias("east"), F.lit(-105.0).alias("west"))


def cameras(spark, d):
    k = c("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("vp_id"), (k % 7).alias("area"), (F.lit(40.0) - (k % 40) / 2000.0 - 0.01).alias("lat"), (F.lit(-105.0) + (k * 7 % 40) / 1500.0 + 0.01).alias("lng"), (F.lit(1800.0) + k % 500).alias("alt"), ((k * 37 % 360) + 0.5).alias("head"), (F.lit(40.0) + k % 60).alias("fov"), bounds_column().alias("b"))


def view(spark, d, sliced=False):
    return visibility.views(cameras(spark, d), cells(spark, d).withColumn("interest", (c("elev") - 187.0) / 2500.0), 64, 64, sliced=sliced)


@query("g11_viewshed", f"WITH {RAY_SQL} SELECT vp_id, ray, count(*) AS samples, count(*) FILTER (visible) AS seen FROM view GROUP BY vp_id, ray")
def g11(spark, d):
    return view(spark, d).groupBy("vp_id", c("ray").cast("long").alias("ray")).agg(F.count(F.lit(1)).alias("samples"), F.count_if("visible").alias("seen"))


@query("a5_richness", f'WITH {RAY_SQL}, i AS (SELECT area, "row", col, (elev - 187.0) / 2500.0 AS interest FROM cells), t AS (SELECT area, sum(interest) AS total FROM i GROUP BY area) SELECT vp_id, round(sum(interest) / any_value(total), 6) AS richness FROM (SELECT DISTINCT vp_id, area, "row", col FROM view WHERE visible) v JOIN i USING (area, "row", col) JOIN t USING (area) GROUP BY vp_id')
def a5(spark, d):
    interest = cells(spark, d).select("area", "row", "col", ((c("elev") - 187.0) / 2500.0).alias("interest"))
    return visibility.richness(view(spark, d), interest).select("vp_id", F.round("richness", 6).alias("richness"))


@query("a6_entropy", f'WITH {RAY_SQL}, cl AS (SELECT DISTINCT vp_id, "row", col, elev FROM view WHERE visible), e AS (SELECT *, min(elev) OVER w AS lo, max(elev) OVER w AS hi, count(*) OVER w AS n FROM cl WINDOW w AS (PARTITION BY vp_id)), b AS (SELECT vp_id, n, CASE WHEN hi > lo THEN LEAST(floor((elev - lo) / (hi - lo) * 8), 7) ELSE 0 END AS bin, count(*) AS k FROM e GROUP BY ALL) SELECT vp_id, round(sum(-(k / n) * ln(k / n)) / ln(8), 6) AS entropy FROM b GROUP BY vp_id')
def a6(spark, d):
    return visibility.terrain_entropy(view(spark, d)).select("vp_id", F.round("entropy", 6).alias("entropy"))


@query("a10_depth_layers", f'WITH {RAY_SQL}, v AS (SELECT *, (elev - 187.0) / 2500.0 AS interest, max(dist) OVER (PARTITION BY vp_id) AS far FROM view WHERE visible), t AS (SELECT vp_id, LEAST(floor(dist / far * 3), 2) AS third, sum(interest) AS k FROM v GROUP BY ALL), n AS (SELECT *, sum(k) OVER (PARTITION BY vp_id) AS n FROM t) SELECT vp_id, round(sum(CASE WHEN k > 0 THEN -(k / n) * ln(k / n) ELSE 0 END) / ln(3), 5) AS depth FROM n GROUP BY vp_id')
def a10(spark, d):
    return visibility.depth_layers(view(spark, d)).select("vp_id", F.round("depth", 5).alias("depth"))


@query("a8_box_dimension", f"""WITH {CELLS_SQL}, p AS (SELECT area, "row", col, (elev - min(elev) OVER w) / (max(elev) OVER w - min(elev) OVER w) AS v FROM cells WINDOW w AS (PARTITION BY area, "row")), b AS (SELECT area, "row", s, col // s AS seg, max(v) AS hi, min(v) AS lo FROM p, (VALUES (2), (4), (8), (16), (32)) AS z(s) GROUP BY ALL), k AS (SELECT area, "row", s, sum(floor(hi * 64 / s) - floor(lo * 64 / s) + 1) AS k FROM b GROUP BY ALL) SELECT area, "row", round(regr_slope(ln(k), ln(64.0 / s)), 5) AS dimension FROM k GROUP BY ALL""")
def a8(spark, d):
    """Box-counting dimension of each raster row."""
    return visibility.box_dimension(cells(spark, d), ["area", "row"], "col", "elev", 64).select("area", "row", F.round("dimension", 5).alias("dimension"))


@query("a13_total", "SELECT s_suppkey AS vp_id, round(0.20 * (s_suppkey % 11) / 10.0 + 0.15 * (s_suppkey % 7) / 10.0 + 0.20 * (s_suppkey % 5) / 10.0 + 0.15 * (s_suppkey % 3) / 10.0 + 0.10 * (s_suppkey % 9) / 10.0 + 0.10 * (s_suppkey % 8) / 10.0 + 0.10 * (s_suppkey % 4) / 10.0, 6) AS total FROM supplier")
def a13(spark, d):
    k = c("s_suppkey")
    s = table(spark, d, "supplier").select(k.alias("vp_id"), *[((k % m) / 10.0).alias(n) for n, m in zip(visibility.WEIGHTS, (11, 7, 5, 3, 9, 8, 4), strict=True)])
    return visibility.total(s).select("vp_id", F.round("total", 6).alias("total"))


VIEWPOINTS_SQL = "vp AS (SELECT o_orderkey AS id, o_custkey % 50 AS scene, o_orderkey % 4 AS comp, (o_orderkey * 31 % 1000) / 1000.0 AS score FROM orders)"


@query("w2_top_per_scene", f"WITH {VIEWPOINTS_SQL} SELECT scene, id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY scene ORDER BY score DESC, id) AS k FROM vp) s WHERE k <= 3")
def w2(spark, d):
    """Three viewpoints a scene: Spark limits each partition's groups before the shuffle."""
    o = table(spark, d, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 50).alias("scene"), ((c("o_orderkey") * 31 % 1000) / 1000.0).alias("score"))
    return o.withColumn("rank", F.row_number().over(W.partitionBy("scene").orderBy(F.desc("score"), "id"))).filter("rank <= 3").select("scene", "id", "rank")


@query("t1_global_top", f"WITH {VIEWPOINTS_SQL} SELECT id, score FROM vp ORDER BY score DESC, id LIMIT 12")
def t1(spark, d):
    o = table(spark, d, "orders").select(c("o_orderkey").alias("id"), ((c("o_orderkey") * 31 % 1000) / 1000.0).alias("score"))
    return o.orderBy(F.desc("score"), "id").limit(12)


@query("a16_rejections", f"WITH {VIEWPOINTS_SQL} SELECT scene, count(*) AS generated, count(*) FILTER (comp = 0) AS no_convergence, count(*) FILTER (comp = 1) AS out_of_bounds, count(*) FILTER (comp = 2) AS under_ground FROM vp GROUP BY scene")
def a16(spark, d):
    comp = c("o_orderkey") % 4
    return table(spark, d, "orders").groupBy((c("o_custkey") % 50).alias("scene")).agg(F.count(F.lit(1)).alias("generated"), F.count_if(comp == 0).alias("no_convergence"), F.count_if(comp == 1).alias("out_of_bounds"), F.count_if(comp == 2).alias("under_ground"))


@query("a7_skyline_dimension", f"""WITH {RAY_SQL}, sk AS (SELECT c.vp_id, r.ray, coalesce(max(v.angle), -pi() / 2) AS a FROM cam c CROSS JOIN (SELECT unnest(range(0, 90)) AS ray) r LEFT JOIN view v ON v.vp_id = c.vp_id AND v.ray = r.ray GROUP BY ALL), p AS (SELECT vp_id, ray, (a - min(a) OVER w) / (max(a) OVER w - min(a) OVER w) AS v FROM sk WINDOW w AS (PARTITION BY vp_id)),
b AS (SELECT vp_id, s, ray // s AS seg, max(v) AS hi, min(v) AS lo FROM p, (VALUES (2), (4), (8), (16), (32)) AS z(s) GROUP BY ALL), k AS (SELECT vp_id, s, sum(floor(hi * 90 / s) - floor(lo * 90 / s) + 1) AS k FROM b GROUP BY ALL) SELECT vp_id, round(regr_slope(ln(k), ln(90.0 / s)), 4) AS dimension FROM k GROUP BY vp_id""")
def a7(spark, d):
    sky = visibility.skyline(view(spark, d), cameras(spark, d))
    return visibility.box_dimension(sky, ["vp_id"], "ray", "angle", 90).select("vp_id", F.round("dimension", 4).alias("dimension"))


CELL_CAM_SQL = 'cc AS (SELECT s_suppkey AS vp_id, s_suppkey % 7 AS area, 1600.0 + s_suppkey % 500 AS alt, CAST(s_suppkey * 7 % 64 AS INTEGER) AS "row", CAST(s_suppkey * 13 % 64 AS INTEGER) AS col, CAST(ceil(500 / (radians(40.0 - 39.955) * 6378137.0 / 63)) AS INTEGER) AS rows, CAST(ceil(500 / (radians(-104.94 + 105.0) * 6378137.0 * cos(radians((40.0 + 39.955) / 2)) / 63)) AS INTEGER) AS cols FROM supplier)'


def cell_cameras(spark, d):
    k = c("s_suppkey")
    rows, cols = visibility.reach(bounds_column(), 64)
    return table(spark, d, "supplier").select(k.alias("vp_id"), (k % 7).alias("area"), rows.alias("rows"), cols.alias("cols"), (F.lit(1600.0) + k % 500).alias("alt"), (k * 7 % 64).cast("int").alias("row"), (k * 13 % 64).cast("int").alias("col"))


@query("a9_prospect_refuge", f"""WITH {RAY_SQL}, {CELL_CAM_SQL}, p AS (SELECT vp_id, count(*) / CAST(any_value(n) AS DOUBLE) AS p FROM (SELECT DISTINCT vp_id, area, "row", col FROM view WHERE visible) s JOIN (SELECT area, count(*) AS n FROM cells GROUP BY area) z USING (area) GROUP BY vp_id), r AS (SELECT cc.vp_id, avg(CASE WHEN e.elev > cc.alt THEN 1.0 ELSE 0.0 END) AS r FROM cc JOIN cells e ON e.area = cc.area AND abs(e."row" - cc."row") <= cc.rows AND abs(e.col - cc.col) <= cc.cols GROUP BY cc.vp_id)
SELECT vp_id, round(CASE WHEN coalesce(p, 0) + r > 0 THEN 2 * coalesce(p, 0) * r / (coalesce(p, 0) + r) ELSE 0 END, 6) AS prospect FROM r LEFT JOIN p USING (vp_id)""")
def a9(spark, d):
    return visibility.prospect_refuge(view(spark, d), cells(spark, d), cell_cameras(spark, d)).select("vp_id", F.round("prospect", 6).alias("prospect"))


@query("a11_mystery", f"""WITH {RAY_SQL}, v AS (SELECT v.*, (v.elev - 187.0) / 2500.0 AS interest, p75 FROM view v JOIN (SELECT area, quantile_cont((elev - 187.0) / 2500.0, 0.75) AS p75 FROM cells GROUP BY area) q USING (area)), l AS (SELECT vp_id, ray, max(step) FILTER (visible) AS last FROM v GROUP BY ALL), h AS (SELECT vp_id, count(*) AS n FROM v JOIN l USING (vp_id, ray) WHERE step = last + 1 AND interest >= p75 GROUP BY vp_id), s AS (SELECT vp_id, count(*) AS n FROM (SELECT DISTINCT vp_id, "row", col FROM v WHERE visible AND interest >= p75) d GROUP BY vp_id)
SELECT s.vp_id, round(LEAST(1.0, coalesce(h.n, 0) / CAST(s.n AS DOUBLE)), 6) AS mystery FROM s LEFT JOIN h USING (vp_id)""")
def a11(spark, d):
    limits = cells(spark, d).groupBy("area").agg(F.percentile((c("elev") - 187.0) / 2500.0, F.lit(0.75)).alias("p75"))
    return visibility.mystery(view(spark, d, sliced=True), limits).select("vp_id", F.round("mystery", 6).alias("mystery"))


@query("a12_water_share", f"""WITH {RAY_SQL}, w AS (SELECT area, "row", col FROM cells WHERE elev < 1000), t AS (SELECT area, count(*) AS n FROM w GROUP BY area), s AS (SELECT DISTINCT vp_id, area, "row", col FROM view WHERE visible) SELECT s.vp_id, round(count(w.area) / CAST(any_value(t.n) AS DOUBLE), 6) AS water FROM s JOIN t USING (area) LEFT JOIN w ON w.area = s.area AND w."row" = s."row" AND w.col = s.col GROUP BY s.vp_id""")
def a12(spark, d):
    water = cells(spark, d).filter("elev < 1000").select("area", "row", "col")
    return visibility.water_share(view(spark, d), water).select("vp_id", F.round("water", 6).alias("water"))


@query("g12_line_of_sight", f"""WITH {CELLS_SQL}, {CELL_CAM_SQL}, ln AS (SELECT vp_id, area, "row" AS r1, col AS c1, alt + 600 AS alt1, 63.0 - "row" AS r2, 63.0 - col AS c2, alt + 300 AS alt2 FROM cc), sm AS (SELECT vp_id, area, i, r1 + (r2 - r1) * i / 63.0 AS r, c1 + (c2 - c1) * i / 63.0 AS c, alt1 + (alt2 - alt1) * i / 63.0 AS alt FROM ln, (SELECT unnest(range(2, 62)) AS i) s), q AS (SELECT *, LEAST(floor(r), 62) AS r0, LEAST(floor(c), 62) AS c0 FROM sm),
v AS (SELECT vp_id, i, any_value(alt) AS alt, sum((1 - abs(r - e."row")) * (1 - abs(c - e.col)) * e.elev) AS value FROM q JOIN cells e ON e.area = q.area AND e."row" BETWEEN q.r0 AND q.r0 + 1 AND e.col BETWEEN q.c0 AND q.c0 + 1 GROUP BY vp_id, i) SELECT vp_id, NOT bool_or(value > alt - 0.5) AS clear FROM v GROUP BY vp_id""")
def g12(spark, d):
    cam = cell_cameras(spark, d)
    lines = cam.select("vp_id", "area", c("row").alias("r1"), c("col").alias("c1"), (c("alt") + 600).alias("alt1"), (F.lit(63.0) - c("row")).alias("r2"), (F.lit(63.0) - c("col")).alias("c2"), (c("alt") + 300).alias("alt2"))
    return visibility.line_of_sight(lines, cells(spark, d), 64, 64)


@query("p23_feature_center", "WITH p AS (SELECT conv_id, count(*) AS n, list(turn ORDER BY turn) AS t FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN -1 WHEN conv_id % 3 = 1 THEN t[n // 2 + 1] ELSE 0 END AS lat FROM p")
def p23(spark, d):
    """A feature's own centre, else the middle vertex of its path (turns stand for vertices), else nowhere."""
    path = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(c("turn").cast("int").alias("lat")))).alias("p"))
    own = F.when(c("conv_id") % 3 == 0, F.struct(F.lit(-1).alias("lat")))
    line = F.when(c("conv_id") % 3 == 1, c("p")).otherwise(F.filter("p", lambda _: F.lit(False)))
    return path.select("conv_id", land.center_of(own, line, F.struct(F.lit(0).alias("lat")))["lat"].alias("lat"))


@query("p24_kind_by_id", "SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN 'point' WHEN 1 THEN 'line' WHEN 2 THEN 'point' WHEN 3 THEN 'line' END AS kind FROM customer")
def p24(spark, d):
    k = c("c_custkey")
    return table(spark, d, "customer").select(k.alias("k"), land.kind_of(F.concat(F.element_at(F.array(*map(F.lit, ("peak-", "ridge-", "cliff-", "water-", "other-"))), (k % 5 + 1).cast("int")), k)).alias("kind"))


@query("w4_arc_lengths", "SELECT c_custkey AS k, round(sqrt(power((c_custkey % 7) / 10.0, 2) + 0.04), 6) AS one, round(sqrt(power((c_custkey % 7) / 10.0, 2) + 0.04) + sqrt(0.09 + power((c_custkey % 5) / 10.0, 2)), 6) AS two FROM customer")
def w4(spark, d):
    k = c("c_custkey")
    at = lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng"))
    path = F.array(at(F.lit(1.0), F.lit(2.0)), at(F.lit(1.0) + (k % 7) / 10.0, F.lit(2.2)), at(F.lit(1.3) + (k % 7) / 10.0, F.lit(2.2) + (k % 5) / 10.0))
    s = table(spark, d, "customer").select(k.alias("k"), profiles.arc_lengths(path).alias("a"))
    return s.select("k", F.round(F.get("a", 1), 6).alias("one"), F.round(F.get("a", 2), 6).alias("two"))


@query("n18_ridge_profile", f"""WITH {CELLS_SQL}, p AS (SELECT s_suppkey AS k, s_suppkey % 7 AS area, 39.99812347 - (s_suppkey % 13) * 0.00113 AS lat1, -104.99814731 + (s_suppkey % 11) * 0.00197 AS lng1, 39.96023117 + (s_suppkey % 9) * 0.00109 AS lat2, -104.95071913 - (s_suppkey % 5) * 0.00301 AS lng2 FROM supplier), q AS (SELECT k, area, i, lat1 + i / 63.0 * (lat2 - lat1) AS lat, lng1 + i / 63.0 * (lng2 - lng1) AS lng FROM p, (SELECT unnest(range(0, 64)) AS i) s),
g AS (SELECT k, area, i, CAST(round_even((40.0 - lat) / (40.0 - 39.955) * 63.0, 0) AS INTEGER) AS "row", CAST(round_even((lng + 105.0) / (-104.94 + 105.0) * 63.0, 0) AS INTEGER) AS col FROM q) SELECT k, CAST(i AS INTEGER) AS i, elev FROM g JOIN cells USING (area, "row", col)""")
def n18(spark, d):
    """Nearest cells at 64 equal steps along a line."""
    k = c("s_suppkey")
    at = lambda lat, lng: F.struct(lat.alias("lat"), lng.alias("lng"))
    path = F.array(at(F.lit(39.99812347) - (k % 13) * 0.00113, F.lit(-104.99814731) + (k % 11) * 0.00197), at(F.lit(39.96023117) + (k % 9) * 0.00109, F.lit(-104.95071913) - (k % 5) * 0.00301))
    s = table(spark, d, "supplier").select(k.alias("k"), (k % 7).alias("area"), bounds_column().alias("b"), path.alias("path"))
    return profiles.profiles(s, ["k", "area"], cells(spark, d), 64).select("k", "i", "elev")
