"""Stores, logs and caches against plain versions."""

import json
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from orograph.sources import points, raster, stores, versions
from orograph.streaming import logs


def test_logs_come_in_reverse_file_order(spark, tmp_path):
    lines = [json.dumps({"id": f"{i:03}", "toolName": "a" if i % 2 else "b", "startedAt": "same", "isError": i % 5 == 0}) for i in range(200)]
    lines.insert(50, "{broken")
    (tmp_path / "log.json").write_text("\n".join(lines))
    found = logs.read_tool_logs(spark, str(tmp_path / "log.json"), tool="a", limit=20)
    assert [r["id"] for r in found.collect()] == [f"{i:03}" for i in range(199, 0, -1) if i % 2][:20]
    assert [r["id"] for r in logs.read_tool_logs(spark, str(tmp_path / "log.json"), errors=True, limit=3).collect()] == ["195", "190", "185"]
    with pytest.raises(ValueError):
        logs.read_tool_logs(spark, str(tmp_path / "log.json"), limit=0)


def test_redaction_reaches_any_depth(spark):
    raw = {"a": [{"apiKey": "x", "deep": {"Authorization": {"k": 1}, "note": "use Bearer abc.def now"}}, "Basic Zm9v and token t1"], "cookies": 3, "n": None, "ü": "é"}
    deep = "[" * 3000 + '"token abc"' + "]" * 3000
    df = spark.createDataFrame([(1, json.dumps(raw, ensure_ascii=False)), (2, "plain Bearer x"), (3, None), (4, deep)], "k long, body string")
    found = {r["k"]: r["clean"] for r in logs.redacted_json(df, "body", "clean").collect()}
    assert json.loads(found[1]) == {"a": [{"apiKey": "[REDACTED]", "deep": {"Authorization": "[REDACTED]", "note": "use Bearer [REDACTED] now"}}, "Basic [REDACTED] and token [REDACTED]"], "cookies": "[REDACTED]", "n": None, "ü": "é"}
    assert found[2] == "plain Bearer [REDACTED]" and found[3] is None and "abc" not in found[4]


def test_redacted_stream_is_appended(spark, tmp_path):
    rows = spark.createDataFrame([(i, json.dumps({"token": "t", "n": i})) for i in range(20)], "id long, body string")
    rows.write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, body string").json(str(tmp_path / "in"))
    logs.appended(stream, "body", str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    found = spark.read.json(str(tmp_path / "out")).collect()
    assert len(found) == 20 and all(json.loads(r["body"])["token"] == "[REDACTED]" for r in found)


def test_caches_equal_plain_replays(spark):
    import random

    rnd = random.Random(3)
    accesses = [(0, float(t * 10), rnd.choice("abcdefg")) for t in range(300)]
    for recent in (True, False):
        held, expected = OrderedDict(), []
        for _, at, key in accesses:
            hit = key in held and at - held[key] <= 400
            if hit and recent:
                held.move_to_end(key)
            elif not hit:
                held.pop(key, None)
                held[key] = at
                while len(held) > 4:
                    held.popitem(last=False)
            expected.append(hit)
        df = spark.createDataFrame(accesses, "shard long, at double, key string")
        assert [r["hit"] for r in logs.cache_replay(df, 4, 400.0, recent).orderBy("at").collect()] == expected


def test_store_tables_are_appended_replaced_and_emptied(spark, tmp_path):
    path = str(tmp_path / "store")
    uploads = spark.createDataFrame([("a.png", "image/png", "x", 10, 20, [0.5])], "filename string, content_type string, label string, height int, width int, fingerprint array<double>")
    schema = "reference_id string, original string, created_at timestamp, metadata string, fingerprint array<double>"
    for day in ("2026-01-01 10:00:00", "2026-01-03 10:00:00"):
        versions.added(spark, path, stores.references(uploads.withColumn("created_at", F.to_timestamp(F.lit(day)))))
    made = versions.read(spark, path, schema)
    assert made.count() == 2 and made.filter(F.col("reference_id").rlike("^style-ref-2026010[13]-[0-9a-f]{8}$")).count() == 2
    now = F.to_timestamp(F.lit("2026-01-04 10:00:00"))
    versions.replaced(spark, path, schema, lambda t: stores.swept_references(t, now))
    store = versions.read(spark, path, schema)
    left = store.collect()
    assert len(left) == 1 and left[0]["reference_id"].startswith("style-ref-20260103")
    assert stores.loaded_reference(store, F.lit(left[0]["reference_id"]), now).count() == 1
    assert stores.loaded_reference(store, F.lit(left[0]["reference_id"]), F.to_timestamp(F.lit("2026-01-04 10:00:01"))).count() == 0
    versions.truncated(spark, path, schema)
    emptied = versions.read(spark, path, schema)
    assert emptied.count() == 0 and emptied.columns == made.columns


def test_mosaics_keep_areas_apart_and_tiles_are_read_once(spark, tmp_path):
    tile = lambda area, x, y, v: [(area, 3, x, y, r, c, float(v + r * 2 + c)) for r in range(2) for c in range(2)]
    rows = [*tile(1, 4, 5, 0), *tile(1, 5, 5, 10), *tile(2, 0, 0, 100)]
    pixels = spark.createDataFrame(rows, "area long, z int, x int, y int, py int, px int, elev double")
    found = {(r["area"], r["row"], r["col"]): r["elev"] for r in raster.mosaic(pixels, 2).collect()}
    assert found[1, 0, 0] == 0 and found[1, 1, 3] == 13 and found[2, 1, 1] == 103 and len(found) == 12
    sizes = spark.createDataFrame([(1, 2, 4), (2, 2, 2)], "area long, height int, width int")
    small = {(r["area"], r["row"], r["col"]): r["elev"] for r in raster.resampled(raster.mosaic(pixels, 2), sizes, 3).collect()}
    assert small[1, 0, 0] == 0 and small[1, 2, 2] == 13 and small[1, 0, 1] == pytest.approx((1 + 10) / 2) and small[2, 1, 1] == pytest.approx(101.5)
    raster.write_tiles(pixels.drop("area"), str(tmp_path / "lake"))
    wanted = spark.createDataFrame([(3, 4, 5), (3, 4, 5)], "z int, x int, y int")
    assert raster.read_tiles(spark, str(tmp_path / "lake"), wanted).count() == 4


def test_points_cross_seams_and_go_around(spark):
    """A raster of the whole globe at zoom 1: a plane in x, so that the value between columns is known."""
    side = 4
    pixels = spark.createDataFrame([(1, x, y, r, c, float(x * side + c)) for x in range(2) for y in range(2) for r in range(side) for c in range(side)], "z int, x int, y int, py int, px int, elev double")
    lng = lambda column: column / (2 * side) * 360 - 180
    spots = [(0, 10.0, lng(1.5)), (1, 10.0, lng(3.5)), (2, -10.0, lng(7.25)), (3, 10.0, lng(0.0))]
    df = spark.createDataFrame(spots, "pid long, lat double, lng double")
    found = {r["pid"]: r["elevation"] for r in points.elevation(df, pixels, 1, side).collect()}
    assert found == {0: 1.5, 1: 3.5, 2: pytest.approx(7 * 0.75 + 0 * 0.25), 3: 0.0}
    assert {r["pid"]: len(r["tiles"]) for r in points.tiles_of(df, 1, side).collect()}[1] >= 2
    missing = {r["pid"]: r["elevation"] for r in points.elevation(df, pixels.filter("x = 0"), 1, side).collect()}
    assert missing[1] == pytest.approx(3 * 0.5 + 0 * 0.5) and missing[2] is None
