"""Logs of tool calls and conversations: redaction, truncation, retention, matching of starts and ends, folding of events; batch and streaming."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed values.
SECRET_KEY = r"(?i)api[_-]?key|token|secret|authorization|password|cookie"
SECRET_TEXT = r"(?i)\b(Bearer|Basic|Token)\s+\S+"
REDACTED, TRUNCATED = "[REDACTED]", "\n[truncated]"
TOOL_LOGS, SESSION_LOGS, PREVIEW_CHARS, OUTPUT_CHARS = 2000, 500, 4000, 50_000

TOOL_LOG = "id string, eventType string, requestId string, toolName string, startedAt string, endedAt string, durationMs long, isError boolean, errorMessage string, input string, output string"


def masked(text: Column) -> Column:
    """Credentials after an authorization scheme; the scheme stays."""
    return F.regexp_replace(text, SECRET_TEXT, "$1 [REDACTED]")


def masked_map(values: Column) -> Column:
    """A map of strings: values of secret keys go whole, others are masked."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit(REDACTED)).otherwise(masked(v)))


def redacted_json(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds ``name``: the JSON of ``column`` with values of secret keys gone at any depth and credentials masked in every string.

    Depth isn't bounded by a schema, so this is an Arrow map over strings; text
    that isn't JSON is masked as text. Keys keep their order.
    """
    key, text = re.compile(SECRET_KEY), re.compile(SECRET_TEXT)

    def clean(x):
        if isinstance(x, str):
            return text.sub(lambda m: f"{m[1]} {REDACTED}", x)
        if isinstance(x, list):
            return [clean(v) for v in x]
        if isinstance(x, dict):
            return {k: REDACTED if key.search(k) else clean(v) for k, v in x.items()}
        return x

    def one(raw):
        if raw is None:
            return None
        try:
            return json.dumps(clean(json.loads(raw)), ensure_ascii=False, separators=(",", ":"))
        except (ValueError, RecursionError):
            return clean(raw)

    @F.pandas_udf("string")
    def cleaned(values: pd.Series) -> pd.Series:
        return values.map(one)

    return df.withColumn(name, cleaned(column))


def tool_output(text: Column, most: int = OUTPUT_CHARS) -> Column:
    """A tool's output as a model sees it: whole up to ``most`` characters, else cut with a note."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(f"\n[output truncated at {most} chars]"))).otherwise(text)


def appended(events: DataFrame, column: str, path: str, checkpoint: str):
    """A stream of log lines, redacted, appended as JSON: the sink writes each batch once, so the queue needs no lock."""
    clean = redacted_json(events, column, "__clean").drop(column).withColumnRenamed("__clean", column)
    return clean.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def truncated(text: Column, most: int = PREVIEW_CHARS) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)


def read_tool_logs(spark, path: str, tool: str | None = None, errors: bool | None = None, limit: int = 50) -> DataFrame:
    """Newest first from JSON lines, which is the reverse of their order in the files; malformed lines are dropped."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    df = spark.read.schema(TOOL_LOG).option("mode", "DROPMALFORMED").json(path)
    # A line's place: its file, the block that a task reads, the number within.
    df = df.withColumns({"__f": F.col("_metadata.file_path"), "__b": F.col("_metadata.file_block_start"), "__i": F.monotonically_increasing_id()})
    if tool is not None:
        df = df.filter(F.col("toolName") == tool)
    if errors is not None:
        df = df.filter(F.col("isError") == errors)
    return df.orderBy(F.desc("__f"), F.desc("__b"), F.desc("__i")).limit(limit).drop("__f", "__b", "__i")


def retained(df: DataFrame, order: list[Column], most: int, by: list[str] | None = None) -> DataFrame:
    """The newest ``most`` rows, of each group if ``by`` is given. Without groups a sorted limit, which no single task has to hold, takes the place of a window."""
    if not by:
        return df.orderBy(*order).limit(most)
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= most).drop("__n")


def matched_calls(events: DataFrame, keys: list[str], kind: str, order: list[str], start: str, end: str) -> DataFrame:
    """First start with first end, second with second, and so on, of the same keys; what has no partner stays with nulls.

    An end with no open start before it stands alone: there the count of starts
    less ends, which falls below all its values so far, reaches a new low. Other
    ends take the starts in turn. ``n`` is the start's number.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    open_ = F.sum(F.when(F.col(kind) == start, 1).otherwise(-1)).over(w.rowsBetween(W.unboundedPreceding, 0))
    marked = events.filter(F.col(kind).isin(start, end)).withColumn("__open", open_)
    marked = marked.withColumn("__low", F.least(F.lit(0), F.min("__open").over(w.rowsBetween(W.unboundedPreceding, 0))))
    marked = marked.withColumn("__alone", F.col("__low") < F.coalesce(F.lag("__low").over(w), F.lit(0)))
    turn = F.row_number().over(W.partitionBy(*keys, kind, "__alone").orderBy(*order))
    numbered = marked.withColumn("n", F.when(~F.col("__alone"), turn)).withColumn("__turn", F.when(F.col("__alone"), -turn).otherwise(turn))
    # A start and its end are a group: one more aggregation by keys that the windows have already dealt.
    side = lambda name, short: [F.max(F.when(F.col(kind) == name, F.col(o))).alias(f"{short}_{o}") for o in order]
    return numbered.groupBy(*keys, "__turn").agg(F.max("n").alias("n"), *side(start, "start"), *side(end, "end")).drop("__turn")


def tool_calls(deltas: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Tool calls of finished rounds from their deltas (index, id, name, arguments): id and name of a call's first delta, the fragments of its arguments joined, and its place among the round's calls."""
    some = deltas.filter(F.col("index").isNotNull())
    first = F.min_by(F.struct(F.coalesce("id", F.lit("")).alias("id"), F.coalesce("name", F.lit("")).alias("name")), order)
    fragments = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce("arguments", F.lit("")).alias("a"))))
    calls = some.groupBy(*keys, "index").agg(F.min(order).alias("__first"), first.alias("f"), F.array_join(fragments.getField("a"), "").alias("arguments"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy("__first")) - 1
    return calls.select(*keys, place.cast("int").alias("place"), "index", "f.id", "f.name", "arguments")


def folded(events: DataFrame, keys: list[str], order: str, kind: str, text: str) -> DataFrame:
    """Runs of adjacent events of one kind become one part with their texts joined."""
    w = W.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(kind).over(w) == F.col(kind), 0).otherwise(1)
    runs = events.withColumn("__new", changed).withColumn("__part", F.sum("__new").over(w))
    parts = runs.groupBy(*keys, "__part", kind).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("p"))
    return parts.select(*keys, F.col("__part").cast("int").alias("part"), kind, F.array_join(F.col("p").getField(text), "").alias("text"))


def parsed_stream(lines: DataFrame, schema: str) -> DataFrame:
    """Server-sent lines ``data: {...}`` to rows; others, and what doesn't parse, are dropped. Works on batch and streaming frames."""
    data = lines.filter(F.col("value").startswith("data: ")).select(F.from_json(F.substring("value", 7, 1 << 30), schema, {"mode": "PERMISSIVE"}).alias("e"))
    return data.filter("e is not null").select("e.*").dropna(how="all")


def usage_by_window(events: DataFrame, ts: str, kind: str, value: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums a window and kind, with a watermark: for streams (an addition of this engine)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def sessions(events: DataFrame, by: list[str], ts: str, value: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Visits: events of the same ``by`` with less than ``gap`` between them, as start, end, n and total (an addition of this engine)."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(*by, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def usage_sliding(events: DataFrame, ts: str, kind: str, value: str, width: str = "6 hours", step: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """As ``usage_by_window`` over windows that overlap."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, step), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def distinct_events(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """Each of ``keys`` once: on a stream for as long as the watermark holds its state, on a batch frame for good."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)


def cache_key(request: Column) -> Column:
    """SHA-256 of a request's JSON with its fields in order of name (a struct whose fields are in that order)."""
    return F.sha2(F.to_json(request), 256)


def cache_replay(accesses: DataFrame, most: int, ttl_s: float, recent: bool = True) -> DataFrame:
    """Hits of a cache with a bound and a time to live, replayed a shard: (shard, at, key, hit).

    An entry expires when its age is over ``ttl_s``; a miss puts it anew. A hit
    refreshes the place, not the age, if ``recent`` (least recently used goes
    first), else neither (first in, first out). Order matters within a shard
    only, so shards are groups.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        hits = []
        frame = frame.sort_values(["at", "key"])
        for at, key in zip(frame["at"], frame["key"], strict=True):
            put = held.get(key)
            hit = put is not None and at - put <= ttl_s
            if recent or not hit:
                held.pop(key, None)
                held[key] = put if hit else at
            if len(held) > most:
                held.pop(next(iter(held)))
            hits.append(hit)
        return frame.assign(hit=hits)

    return accesses.select("shard", "at", "key").groupBy("shard").applyInPandas(run, "shard long, at double, key string, hit boolean")
