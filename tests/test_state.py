"""Stream state against plain walks: streams in several runs, each from the checkpoint of the one before."""

import datetime as dt
import random
from collections import OrderedDict, defaultdict, deque

import pytest
from pyspark.sql import functions as F

from orograph.streaming import logs, state

T0 = dt.datetime(2026, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def streamed(spark, folder, parts, schema, operator):
    """Rows that ``operator`` gives for a stream that comes in ``parts``; every part is a run of its own."""
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in").withWatermark("ts", "10 seconds")
        writer = operator(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    return [r.asDict() for r in spark.read.parquet(f"{folder}/out").collect()]


def plain_hits(rows, most, ttl, recent):
    held, out = OrderedDict(), {}
    for shard, ts, key in sorted(rows, key=lambda r: r[1]):
        here = held.setdefault(shard, OrderedDict())
        hit = key in here and (ts - here[key]).total_seconds() <= ttl
        if hit and recent:
            here.move_to_end(key)
        elif not hit:
            here.pop(key, None)
            here[key] = ts
            if len(here) > most:
                here.popitem(last=False)
        out[shard, ts] = hit
    return out


@pytest.mark.parametrize("recent", [True, False])
def test_cache_stream_equals_plain_replay(spark, tmp_path, recent):
    rnd = random.Random(5)
    rows = [(i % 3, at(7 * i), rnd.choice("abcdefgh")) for i in range(120)]
    schema = "shard long, ts timestamp, key string"
    parts = [rows[:40], rows[40:41], rows[41:]]
    got = streamed(spark, tmp_path, parts, schema, lambda s: state.cached(s, 4, 150.0, recent))
    expected = plain_hits(rows, 4, 150.0, recent)
    assert {(r["shard"], r["ts"]): r["hit"] for r in got} == expected and len(got) == len(rows)
    assert 0 < sum(expected.values()) < len(rows)
    batch = state.cached(spark.createDataFrame(rows, schema), 4, 150.0, recent).collect()
    assert {(r["shard"], r["ts"]): r["hit"] for r in batch} == expected
    replay = logs.cache_replay(spark.createDataFrame(rows, schema).select("shard", F.unix_micros("ts").cast("double").alias("at"), "key"), 4, 150e6, recent).collect()
    assert sum(r["hit"] for r in replay) == sum(expected.values())


def test_idle_cache_state_expires(spark, tmp_path):
    rows = [(0, at(0), "a"), (1, at(1), "b")]
    later = [(1, at(5000), "c"), (1, at(5001), "c")]
    streamed(spark, tmp_path, [rows, later, [(1, at(5002), "c")]], "shard long, ts timestamp, key string", lambda s: state.cached(s, 4, 60.0))
    held = spark.read.format("statestore").option("stateVarName", "entries").load(f"{tmp_path}/checkpoint")
    assert {(r["key"][0]) for r in held.select("key").collect()} == {1}


def plain_calls(rows):
    waiting, out = defaultdict(deque), []
    for request, tool, ident, _, _, starts in sorted(rows, key=lambda r: (r[3], r[4])):
        queue = waiting[request, tool]
        if starts:
            queue.append(ident)
        else:
            out.append((request, tool, queue.popleft() if queue else None, ident))
    return out + [(*key, ident, None) for key, queue in waiting.items() for ident in queue]


CALL = "request string, tool string, id string, ts timestamp, place long, starts boolean"


def call_rows():
    rnd = random.Random(8)
    return [(f"r{rnd.randrange(3)}", rnd.choice("xy"), f"c{i}", at(3 * i // 2), i, rnd.random() < 0.5) for i in range(160)]


def test_calls_stream_equals_plain_walk(spark, tmp_path):
    rows = call_rows()
    over = [("end", "z", "last", at(100_000), 999, False), ("end", "z", "after", at(100_001), 1000, False)]
    names = ["request", "tool", "start_id", "end_id"]
    got = streamed(spark, tmp_path, [rows[:50], rows[50:110], rows[110:], over, over], CALL, lambda s: state.matched(s, 3600))
    found = sorted((tuple(r[n] for n in names) for r in got if r["request"] != "end"), key=str)
    assert found == sorted(plain_calls(rows), key=str)
    assert any(s is None for _, _, s, _ in found) and any(e is None for *_, e in found)


def test_calls_in_batches_equal_plain_walk(spark):
    """Windows and state both: an end before every start isn't matched to a later one."""
    rows = [*call_rows(), ("q", "x", "early", at(-5), -1, False), ("q", "x", "s", at(0), 0, True), ("q", "x", "e", at(1), 1, False)]
    df = spark.createDataFrame(rows, CALL)
    expected = sorted(plain_calls(rows), key=str)
    by_state = [tuple(r) for r in state.matched(df).select("request", "tool", "start_id", "end_id").collect()]
    assert sorted(by_state, key=str) == expected
    kinds = df.withColumn("kind", F.when(F.col("starts"), "start").otherwise("end"))
    paired = logs.matched_calls(kinds, ["request", "tool"], "kind", ["ts", "place", "id"], "start", "end")
    assert sorted([tuple(r) for r in paired.select("request", "tool", "start_id", "end_id").collect()], key=str) == expected
    assert ("q", "x", None, "early") in expected and ("q", "x", "s", "e") in expected


PART = "conversation string, ts timestamp, place long, kind string, text string"


def part_rows():
    rnd = random.Random(9)
    return [(f"k{rnd.randrange(2)}", at(i), i, rnd.choice(["text", "text", "tool"]), rnd.choice(["a", "b ", "", None])) for i in range(90)]


@pytest.mark.parametrize("cuts", [(30, 60), (1, 89)])
def test_parts_stream_equals_fold_for_any_split(spark, tmp_path, cuts):
    rows = part_rows()
    over = [("end", at(90_000), 0, "text", ""), ("end", at(90_001), 1, "text", "")]
    parts = [rows[: cuts[0]], rows[cuts[0] : cuts[1]], rows[cuts[1] :], over, over]
    got = streamed(spark, tmp_path, parts, PART, lambda s: state.folded(s, 3600))
    df = spark.createDataFrame(rows, PART)
    expected = sorted(tuple(r) for r in logs.folded(df.na.fill(""), ["conversation"], "place", "kind", "text").select("conversation", "part", "kind", "text").collect())
    assert sorted((r["conversation"], r["part"], r["kind"], r["text"]) for r in got if r["conversation"] != "end") == expected
    assert sorted(tuple(r) for r in state.folded(df).collect()) == expected


DELTA = "round string, ts timestamp, place long, index int, id string, name string, arguments string"


def delta_rows():
    rnd = random.Random(11)
    rows, plain = [], {}
    for k in range(6):
        texts = {i: ['{"a": [1, 2], "b": "ü"}', '{"broken": ', "", "[]"][rnd.randrange(4)] for i in rnd.sample(range(5), 3)}
        queue = [(i, [t[a : a + 4] for a in range(0, len(t), 4)] or [None]) for i, t in texts.items()]
        first = set()
        while queue:
            n = rnd.randrange(len(queue))
            i, pieces = queue[n]
            ident, name = ((f"id{i}" if i != 2 else None, f"n{i}") if i not in first else ("late", None))
            if i not in first:
                plain.setdefault(f"r{k}", []).append([i, ident or "", name or "", ""])
                first.add(i)
            piece = pieces.pop(0)
            next(c for c in plain[f"r{k}"] if c[0] == i)[3] += piece or ""
            rows.append((f"r{k}", at(len(rows)), len(rows), i, ident, name, piece))
            if not pieces:
                queue.pop(n)
        rows.append((f"r{k}", at(len(rows)), len(rows), None, None, None, None))
    return rows, {(r, p, *c) for r, calls in plain.items() for p, c in enumerate(calls)}


def test_deltas_by_index(spark, tmp_path):
    rows, expected = delta_rows()
    columns = ["round", "place", "index", "id", "name", "arguments"]
    got = streamed(spark, tmp_path, [rows[:7], rows[7:30], rows[30:]], DELTA, state.gathered)
    assert {tuple(r[c] for c in columns) for r in got} == expected and len(got) == len(expected)
    df = spark.createDataFrame(rows, DELTA)
    assert {tuple(r) for r in state.gathered(df).select(columns).collect()} == expected
    native = logs.tool_calls(df, ["round"], "place")
    assert {tuple(r) for r in native.select(columns).collect()} == expected
    checked = state.parsed_arguments(native).collect()
    assert {(r["arguments"], r["broken"]) for r in checked} == {(a, a == '{"broken": ') for *_, a in expected}


def test_late_rows_are_dropped(spark, tmp_path):
    rows = [("k", at(0), 0, "text", "a"), ("k", at(500), 1, "text", "b")]
    late = [("k", at(1), 2, "text", "late"), ("k", at(501), 3, "tool", "c"), ("end", at(90_000), 0, "text", "")]
    got = streamed(spark, tmp_path, [rows, late, [("end", at(90_001), 0, "text", "")]], PART, lambda s: state.folded(s, 3600))
    assert sorted((r["part"], r["text"]) for r in got if r["conversation"] == "k") == [(1, "ab"), (2, "c")]
