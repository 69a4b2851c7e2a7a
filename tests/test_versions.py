"""Tables of snapshots, session logs and the tile lake: failures between steps, repeated batches, what is fetched and how often."""

import http.server
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orograph import engine
from orograph.sources import tiles, versions
from test_sources import png

T = "k long, v string"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_versions_survive_a_failure_between_the_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    assert rows(versions.read(spark, path, T), "k") == []
    versions.added(spark, path, spark.createDataFrame([(1, "a"), (2, "b")], T))
    versions.added(spark, path, spark.createDataFrame([(3, "c")], T))
    assert rows(versions.read(spark, path, T), "k", "v") == [(1, "a"), (2, "b"), (3, "c")]

    def broken(self, manifest):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(versions.Files, "publish", broken)
        with pytest.raises(OSError):
            versions.replaced(spark, path, T, lambda t: t.filter("k > 1"))
        with pytest.raises(OSError):
            versions.truncated(spark, path, T)
    assert rows(versions.read(spark, path, T), "k") == [(1,), (2,), (3,)]
    versions.replaced(spark, path, T, lambda t: t.filter("k > 1"))
    assert rows(versions.read(spark, path, T), "k") == [(2,), (3,)]
    with monkeypatch.context() as m:  # after it is published, before old folders go
        m.setattr(versions.Files, "sweep", lambda self: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            versions.truncated(spark, path, T)
    assert versions.read(spark, path, T).columns == ["k", "v"] and versions.read(spark, path, T).isEmpty()
    for k in range(4):
        versions.added(spark, path, spark.createDataFrame([(k, "z")], T))
    assert len(list((tmp_path / "t/manifests").glob("*.json"))) == versions.KEPT
    assert rows(versions.read(spark, path, T), "k") == [(0,), (1,), (2,), (3,)]


def test_a_taken_version_is_a_conflict(spark, tmp_path):
    path = str(tmp_path / "t")
    before = versions.added(spark, path, spark.createDataFrame([(1, "a")], T))
    versions.write(spark, path, before, {"x": spark.createDataFrame([(2, "b")], T)})
    with pytest.raises(versions.Conflict):
        versions.write(spark, path, before, {"y": spark.createDataFrame([(3, "c")], T)})
    assert rows(versions.read(spark, path, T), "k") == [(1,), (2,)]


R = "session string, at long, text string"


def plain_log(batches, most):
    held = {}
    for batch in batches:
        for row in sorted(batch, key=lambda r: r[1]):
            held.setdefault(row[0], []).append(row)
    return sorted(r for log in held.values() for r in log[-most:])


def test_retention_by_session_and_as_a_whole(spark, tmp_path):
    batches = [[(f"s{(i * k) % 5}", i, f"{k}-{i}") for i in range(30)] for k in range(1, 5)]
    path, whole = str(tmp_path / "s"), str(tmp_path / "w")
    for n, batch in enumerate(batches):
        df = spark.createDataFrame(batch, R)
        after = versions.retained(spark, path, df, ["at"], 7, "session", parts=3, batch=("log", n))
        again = versions.retained(spark, path, df, ["at"], 7, "session", parts=3, batch=("log", n))
        assert again == after
        versions.retained(spark, whole, df, ["at"], 50)
    schema = R + ", serial long"
    assert rows(versions.read(spark, path, schema), "session", "at", "text") == plain_log(batches, 7)
    newest = sorted(((n, r) for n, b in enumerate(batches) for r in b), key=lambda x: (x[0], x[1][1]))[-50:]
    assert rows(versions.read(spark, whole, schema), "text") == sorted((r[2],) for _, r in newest)
    untouched = versions.current(spark, path).folders
    versions.retained(spark, path, spark.createDataFrame([("s0", 99, "more")], R), ["at"], 7, "session", parts=3)
    changed = {p for p, f in versions.current(spark, path).folders.items() if untouched[p] != f}
    assert len(changed) == 1


def test_session_stream_keeps_order_and_repeats_nothing(spark, tmp_path):
    """Runs of a stream, each from its checkpoint; then the last batch delivered again, as after a crash before the checkpoint noted it."""
    path, checkpoint = str(tmp_path / "log"), tmp_path / "checkpoint"
    batches = [[(f"s{i % 3}", 100 - i, f"{k}-{i}") for i in range(20)] for k in range(3)]
    for batch in batches:
        spark.createDataFrame(batch, R).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(R).parquet(str(tmp_path / "in"))
        versions.session_log(stream, path, str(checkpoint), "session", ["at"], 9).awaitTermination(120)
    held = rows(versions.read(spark, path, R + ", serial long"), "session", "at", "text")
    assert held == plain_log(batches, 9)
    version = versions.current(spark, path).version
    last = max(checkpoint.glob("commits/[0-9]*"), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)
    stream = spark.readStream.schema(R).parquet(str(tmp_path / "in"))
    versions.session_log(stream, path, str(checkpoint), "session", ["at"], 9).awaitTermination(120)
    assert versions.current(spark, path).version == version and last.exists()
    assert rows(versions.read(spark, path, R + ", serial long"), "session", "at", "text") == held


@pytest.fixture
def server(tmp_path):
    """Tiles of zoom 5: (x, 1) is missing, (x, 2) fails twice before it is there, (x, 3) always fails; counts what is asked for, and how much at once."""
    png(tmp_path / "tile.png", (130, 0, 0))
    body, asked, open_, most = (tmp_path / "tile.png").read_bytes(), Counter(), [0], [0]
    lock = threading.Lock()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                asked[self.path] += 1
                open_[0] += 1
                most[0] = max(most[0], open_[0])
                n = asked[self.path]
            y = self.path.rsplit("/", 1)[1]
            code = 404 if y == "1" else 503 if y == "3" or y == "2" and n < 3 else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(body if code == 200 else b"")
            with lock:
                open_[0] -= 1

        def log_message(self, *args):
            pass

    running = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{running.server_address[1]}/{{z}}/{{x}}/{{y}}", asked, most
    running.shutdown()


def test_tiles_of_many_areas_are_fetched_once(spark, server):
    url, asked, most = server
    areas = spark.range(50).select((F.col("id") % 10).cast("int").alias("x0"), F.col("id").alias("area"))
    wanted = areas.select("area", F.lit(5).alias("z"), F.explode(F.sequence("x0", F.col("x0") + 2)).alias("x"), F.explode(F.array(*map(F.lit, range(5)))).alias("y"))
    got = {(r["x"], r["y"]): r for r in tiles.fetched_table(wanted, url, in_flight=4, wait_s=0.01).collect()}
    assert len(got) == 12 * 5 and most[0] <= 4
    for (x, y), r in got.items():
        expected = {1: (None, "HTTP 404", 1), 2: (r["png"], None, 3), 3: (None, "HTTP 503", 3)}.get(y, (r["png"], None, 1))
        assert (r["png"], r["error"], r["tries"]) == expected and asked[f"/5/{x}/{y}"] == expected[2]
    assert all(got[x, y]["png"] for x in range(12) for y in (0, 2, 4))


def test_lake_fetches_what_is_missing_only(spark, server, tmp_path):
    url, asked, _ = server
    lake = str(tmp_path / "lake")
    wanted = spark.range(6).select(F.lit(5).alias("z"), F.col("id").alias("x"), F.lit(0).alias("y"))
    first = tiles.read_through(wanted, lake, url, 300.0, now=1000.0)
    assert first.count() == 6 and sum(asked.values()) == 6
    again = tiles.read_through(wanted.unionByName(wanted), lake, url, 300.0, now=1300.0)  # as old as may be
    assert again.count() == 6 and sum(asked.values()) == 6
    more = tiles.read_through(wanted.withColumn("x", F.col("x") + 3), lake, url, 300.0, now=1200.0)
    assert more.count() == 6 and sum(asked.values()) == 9
    old = tiles.read_through(wanted, lake, url, 300.0, now=1300.5)  # three were fetched at 1000, none of the rest asked for
    assert old.count() == 6 and sum(asked.values()) == 15
    failed = tiles.read_through(wanted.withColumn("y", F.lit(1)), lake, url, 300.0, now=1301.0)
    assert rows(failed, "x", "error") == [(x, "HTTP 404") for x in range(6)]
    tiles.compacted(spark, lake, 300.0, now=1301.0)
    assert versions.read(spark, lake, tiles.LAKE).count() == 9
    assert tiles.decoded(tiles.read_through(wanted, lake, url, 300.0, now=1302.0)).count() == 6 * 16 and sum(asked.values()) == 21


def test_areas_with_failed_tiles_are_set_aside(spark, server):
    url, _, _ = server
    wanted = spark.createDataFrame([(a, 5, x, y) for a, x, y in ((1, 0, 0), (1, 1, 0), (2, 1, 0), (2, 2, 1), (3, 2, 1), (3, 3, 3))], "area long, z int, x int, y int")
    found = engine.fetch_problems(wanted, tiles.fetched_table(wanted, url, wait_s=0.01), "area").collect()
    assert {tuple(r) for r in found} == {(2, 502, "Upstream tile fetch failed: HTTP 404"), (3, 502, "Upstream tile fetch failed: HTTP 404")}
    asked = spark.createDataFrame([(1, 40.0, -105.0, 5000.0), (2, 91.0, None, 5000.0), (3, 40.0, -105.0, 10.0)], "k long, lat double, lng double, radius_m double")
    assert rows(engine.accepted(asked), "k") == [(1,)] and rows(engine.problems(asked), "k", "status", "detail") == [(2, 422, "invalid: lat, lng"), (3, 422, "invalid: radius_m")]
