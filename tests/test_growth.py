"""Plans at small sizes that must hold at large ones."""

import math
import re

import pytest
from pyspark.sql import functions as F

from orograph.operators import features, scenes, style
from orograph.plans import previews
from orograph.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["n16_resample", "g12_line_of_sight", "a9_prospect_refuge"])
def test_places_made_from_few_rows_are_not_broadcast(spark, name):
    plan = final_plan(QUERIES[name](spark, SF))
    assert re.search(r"SortMergeJoin[^\n]*\[area[^\]]*row[^\]]*col", plan)
    assert not re.search(r"BroadcastHashJoin[^\n]*\[area[^\]]*row[^\]]*col", plan)


def test_tiles_of_points_are_in_the_order_of_their_names(spark, tmp_path):
    """Two hundred areas need zoom 4, whose columns have one and two digits."""
    spark.range(64 * 200).selectExpr("id AS vec_id", "array(0.5f) AS embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.range(30_000).selectExpr("id AS c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    found = [r["tiles"].split(",") for r in QUERIES["u4_point_tiles"](spark, str(tmp_path)).collect()]
    assert any("4/9/" in a and "4/10/" in b for t in found for a in t for b in t)
    assert all(t == sorted(set(t)) for t in found)


def test_references_that_share_an_id_are_asked_for_one_by_one(spark, monkeypatch):
    made = previews.uploads
    monkeypatch.setattr(previews, "uploads", lambda s, d: made(s, d).withColumn("token", F.lit("a" * 64)))
    events = spark.read.parquet(f"{SF}/events.parquet")
    newest = events.agg(F.max("ts")).first()[0]
    fresh = F.unix_micros(F.lit(newest).cast("timestamp")) - F.unix_micros(F.date_trunc("second", F.col("ts").cast("timestamp"))) <= 24 * 3_600_000_000
    expected = events.filter(fresh & (F.col("event_id") % 2 == 0)).count()
    assert 0 < expected < events.filter(fresh).count()
    assert QUERIES["src7_reference_load"](spark, SF).count() == expected


def test_scenes_sum_their_features_in_order(spark):
    """The mean of 0.1, 0.2 and 0.3 depends on the order of the sum: any order of rows gives the same score."""
    hot = spark.createDataFrame([(1, "h", 0, 40.0, -105.0, 0.5)], "area long, hotspot_id string, ord int, lat double, lng double, score double")
    # Summed in order 0.545 exactly or a digit beside it: whichever it is, it stays.
    rows = [(1, "peaks", f"peak-{i}", i, 40.0, -105.0, s) for i, s in enumerate([0.07, 0.99, 0.29, 0.83, 0.41, 0.13, 0.57, 0.0])]
    schema = "area long, kind string, feature_id string, ord int, lat double, lng double, score double"
    results = {scenes.candidates(hot, spark.createDataFrame(order, schema)).select("score").first()[0] for order in (rows, rows[::-1], rows[1::2] + rows[::2])}
    total = 0.0
    for r in rows:
        total += r[-1]
    plan = scenes.candidates(hot, spark.createDataFrame(rows, schema))._jdf.queryExecution().optimizedPlan().toString()
    assert len(results) == 1 and abs(results.pop() - round(0.3 + 0.4 * total / len(rows), 2)) <= 0.0100001
    assert "avg(" not in plan


def test_window_normals_sort_nothing_unless_cells_are_missing(spark):
    cells = QUERIES["src2_rgb_codec"](spark, SF).select("area", "row", "col", F.col("decoded").alias("elev"))
    full = style.patch_normals(cells)
    assert " Window [" not in final_plan(full).split("Initial Plan")[0]
    holes = cells.filter("NOT (row = 11 AND col IN (0, 9, 40))")
    for some in (cells, holes):
        rounded = [{tuple(r[:3]): (round(r["normal"], 6), round(r["steepness"], 6)) for r in df.collect()} for df in (style.patch_normals(some), style.line_normals(style.patches(some)))]
        assert rounded[0] == rounded[1] and rounded[0]
    flat = cells.withColumn("elev", F.lit(1234.1))
    assert {r["normal"] for r in style.patch_normals(flat).collect()} == {0.0}


def test_decay_adds_points_in_order_without_a_fold_a_cell(spark):
    """Sums of 600 points a cell are made for an area at once; they equal a plain loop."""
    cells = spark.range(3 * 400).selectExpr("id div 400 AS area", "CAST(id % 400 div 20 AS INT) AS row", "CAST(id % 20 AS INT) AS col").filter("NOT (row = 3 AND col < 5)")
    places = [(area, (i * 7 % 191) / 10.0, (i * 13 % 197) / 10.0, (i % 9 + 1) / 10.0) for area in (0, 1) for i in range(40)] + [(7, 1.0, 1.0, 1.0)]
    found = features.decay(cells, spark.createDataFrame(places, "area long, r double, c double, score double"), 3.0, "water")
    assert "aggregate(" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = {(r["area"], r["row"], r["col"]): r["water"] for r in found.collect()}
    assert set(rows) == {(r["area"], r["row"], r["col"]) for r in cells.filter("area < 2").collect()}
    for area in (0, 1):
        own = sorted(p[1:] for p in places if p[0] == area)
        plain = {k: sum(s * math.exp(-((k[1] - r) ** 2 + (k[2] - c) ** 2) / 18.0) for r, c, s in own) for k in rows if k[0] == area}
        low, high = min(plain.values()), max(plain.values())
        assert all(abs(rows[k] - (v - low) / (high - low)) < 1e-12 for k, v in plain.items())


def test_hidden_interest_is_found_where_samples_are(spark):
    """Cameras and rasters are dealt by area and slice, and samples never again."""
    plan = final_plan(QUERIES["a11_mystery"](spark, SF)).split("Initial Plan")[0]
    assert not re.search(r"hashpartitioning\((vp_id|[^)\n]*\b(ray|row)#)", plan)


def test_hotspots_of_a_plateau_equal_their_sql(spark, tmp_path):
    """Far from any peak all that counts is relief, which is equal over a plateau: SQL takes each of its cells, in an order that it leaves open."""
    import duckdb

    from orograph.plans.catalog import ORACLE_SQL

    high = {(3, 3): 0.116, (50, 50): 0.0476}  # a peak, and a hill too low for one
    rows = [(r, [high.get((r, c), 0.0) for c in range(64)]) for r in range(64)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    for name, columns in (("f7_hotspots", ["area", "hotspot_id", "score"]), ("f7_hotspot_reasons", ["area", "hotspot_id", "reasons"])):
        theirs = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({ORACLE_SQL[name]}) s").fetchall())
        found = QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted(tuple(r[c] for c in columns) for r in found) == theirs and len(theirs) == 10
        if "row" in found[0]:
            tied = [(r["row"], r["col"]) for r in sorted(found, key=lambda r: int(r["hotspot_id"].split("-")[1]))[1:]]
            assert tied == sorted(tied) and all(max(abs(r - 50), abs(c - 50)) <= 10 for r, c in tied)
