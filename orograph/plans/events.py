"""Queries of log operators: events stand for tool calls, conversations for chats."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.plans.registry import query, table
from orograph.sources import versions
from orograph.sources.shared import shared_folder
from orograph.streaming import logs, state


def c(name: str):
    return F.col(name)


@query("src6_upload_filter", "SELECT page_id, length(html) AS bytes FROM pages WHERE length(html) <= 3000 AND page_id % 4 IN (0, 1)")
def src6(spark, d):
    return table(spark, d, "pages").filter((F.length("html") <= 3000) & (c("page_id") % 4).isin(0, 1)).select("page_id", F.length("html").cast("long").alias("bytes"))


@query("src8_tool_logs", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click' AND event_id % 10 = 0 ORDER BY ts DESC, event_id DESC LIMIT 50")
def src8(spark, d):
    """The newest errors of a tool: filters pushed to the scan, then a sorted limit."""
    return table(spark, d, "events").filter((c("event_type") == "click") & (c("event_id") % 10 == 0)).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "event_type", "value")


@query("src9_preview_truncation", "SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 4000) || chr(10) || '[truncated]' ELSE text END AS preview FROM documents")
def src9(spark, d):
    return table(spark, d, "documents").select("doc_id", logs.truncated(c("text")).alias("preview"))


@query("src11_payload_decode", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def src11(spark, d):
    """A payload in URL-safe base64 without padding, decoded and parsed."""
    sent = F.regexp_replace(F.translate(F.base64(F.encode("props", "utf-8")), "+/", "-_"), "=+$", "")
    back = F.translate(c("sent"), "-_", "+/")
    padded = F.rpad(back, F.ceil(F.length(back) / 4).cast("int") * 4, F.lit("="))
    raw = table(spark, d, "events").select("event_id", sent.alias("sent")).select("event_id", F.decode(F.unbase64(padded), "utf-8").alias("j"))
    return raw.select("event_id", F.from_json("j", "k long")["k"].alias("k"))


@query("p38_redaction", "SELECT doc_id, regexp_replace('Authorization: Bearer ' || text || ' token abc.def', '\\b(Bearer|Basic|Token)\\s+\\S+', '\\1 [REDACTED]', 'gi') AS masked FROM documents")
def p38(spark, d):
    text = F.concat(F.lit("Authorization: Bearer "), "text", F.lit(" token abc.def"))
    return table(spark, d, "documents").select("doc_id", logs.masked(text).alias("masked"))


@query("p38_redacted_json", "SELECT conv_id, turn, '[REDACTED]' AS secret, regexp_replace('Bearer ' || text, '\\b(Bearer|Basic|Token)\\s+\\S+', '\\1 [REDACTED]', 'gi') AS deep FROM conversations")
def p38_json(spark, d):
    """Secrets at any depth of a payload: in lists, in objects, in strings."""
    body = F.to_json(F.struct(F.array(F.struct(F.struct(c("text").alias("api_key")).alias("inner"), F.concat(F.lit("Bearer "), "text").alias("note"))).alias("items")))
    s = logs.redacted_json(table(spark, d, "conversations").select("conv_id", "turn", body.alias("body")), "body", "clean")
    return s.select("conv_id", "turn", F.get_json_object("clean", "$.items[0].inner.api_key").alias("secret"), F.get_json_object("clean", "$.items[0].note").alias("deep"))


@query("p39_tool_output", "SELECT doc_id, CASE WHEN length(t) > 50000 THEN substr(t, 1, 50000) || chr(10) || '[output truncated at 50000 chars]' ELSE t END AS output FROM (SELECT doc_id, text || ' ' || text || ' ' || text AS t FROM documents) s")
def p39(spark, d):
    return table(spark, d, "documents").select("doc_id", logs.tool_output(F.concat_ws(" ", "text", "text", "text")).alias("output"))


@query("p38_redacted_keys", "SELECT event_id, '[REDACTED]' AS api_key, event_type AS name FROM events")
def p38_keys(spark, d):
    m = logs.masked_map(F.create_map(F.lit("api_key"), c("props"), F.lit("name"), c("event_type")))
    return table(spark, d, "events").select("event_id", m.alias("m")).select("event_id", c("m")["api_key"].alias("api_key"), c("m")["name"].alias("name"))


@query("p45_json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def p45(spark, d):
    return table(spark, d, "events").select("event_id", (F.get_json_object("props", "$.k").cast("long") % 10).alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@query("snk9_retention", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 2000")
def snk9(spark, d):
    return logs.retained(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], logs.TOOL_LOGS).select("event_id")


@query("snk10_session_retention", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) s WHERE n <= 500")
def snk10(spark, d):
    return logs.retained(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")], logs.SESSION_LOGS, ["user_id"]).select("user_id", "event_id")


@query("snk7_ttl_sweep", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR")
def snk7(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("newest"))  # one row
    return e.join(F.broadcast(newest), F.col("ts") >= F.col("newest") - F.expr("INTERVAL 24 HOUR")).select("event_id")


#: A walk over each user's clicks and views: a view without an open click before it stands alone where clicks less views reach a new low.
CALLS = """
WITH w AS (SELECT user_id, event_id, event_type, sum(CASE event_type WHEN 'click' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS o FROM events WHERE event_type IN ('click', 'view')),
     l AS (SELECT *, least(0, min(o) OVER (PARTITION BY user_id ORDER BY event_id)) AS low FROM w),
     a AS (SELECT *, low < coalesce(lag(low) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS alone FROM l),
     t AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM a WHERE NOT alone)
SELECT user_id, n, s.event_id AS start_event_id, e.event_id AS end_event_id
FROM (SELECT * FROM t WHERE event_type = 'click') s FULL JOIN (SELECT * FROM t WHERE event_type = 'view') e USING (user_id, n)
UNION ALL SELECT user_id, NULL, NULL, event_id FROM a WHERE alone
"""


@query("j11_call_matching", CALLS)
def j11(spark, d):
    e = table(spark, d, "events")
    return logs.matched_calls(e, ["user_id"], "event_type", ["event_id"], "click", "view").withColumn("n", c("n").cast("long"))


@query("j11_call_state", f"SELECT CAST(user_id AS VARCHAR) AS request, CAST(start_event_id AS VARCHAR) AS start_id, CAST(end_event_id AS VARCHAR) AS end_id FROM ({CALLS}) q")
def j11_state(spark, d):
    """The same walk as keyed state: a queue of open calls a user."""
    e = table(spark, d, "events").filter(c("event_type").isin("click", "view"))
    calls = e.select(c("user_id").cast("string").alias("request"), F.lit("call").alias("tool"), c("event_id").cast("string").alias("id"), F.timestamp_micros("event_id").alias("ts"), c("event_id").alias("place"), (c("event_type") == "click").alias("starts"))
    return state.matched(calls).select("request", "start_id", "end_id")


@query("st4_fold_parts", "SELECT conv_id, CAST(part AS INTEGER) AS part, role, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS nw FROM conversations) a) b GROUP BY conv_id, part, role")
def st4(spark, d):
    return logs.folded(table(spark, d, "conversations"), ["conv_id"], "turn", "role", "text")


@query("st4_parts_state", "SELECT CAST(conv_id AS VARCHAR) AS conversation, CAST(part AS INTEGER) AS part, role AS kind, string_agg(text, '' ORDER BY turn) AS text FROM (SELECT *, sum(nw) OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS nw FROM conversations) a) b GROUP BY conv_id, part, role")
def st4_state(spark, d):
    """The same fold as keyed state: the open part of a conversation."""
    t = table(spark, d, "conversations")
    return state.folded(t.select(c("conv_id").cast("string").alias("conversation"), F.timestamp_seconds("turn").alias("ts"), c("turn").cast("long").alias("place"), c("role").alias("kind"), "text"))


PIECE = 24


def call_deltas(spark, d):
    """Every turn of a conversation as a tool call whose arguments come in pieces, those of its calls interleaved. Ids are missing in each fifth call and come late; each seventh loses its end."""
    t = table(spark, d, "conversations").withColumn("body", F.to_json(F.struct("role", "text")))
    whole = F.when(c("turn") % 7 == 3, F.expr("substring(body, 1, length(body) - 1)")).otherwise(c("body"))
    pieces = F.transform(F.sequence(F.lit(0), F.expr(f"(length(body) - 1) div {PIECE}")), lambda i: F.substring(whole, i * PIECE + 1, F.lit(PIECE)))
    cut = t.select(c("conv_id").cast("string").alias("round"), c("turn").cast("int").alias("index"), "role", F.posexplode(pieces).alias("p", "arguments"))
    place = (c("p").cast("long") * 100_000 + c("index")).alias("place")
    known = F.when((c("p") == 0) & (c("index") % 5 != 4) | (c("p") == 1), F.concat(F.lit("call_"), "index"))
    return cut.select("round", F.timestamp_seconds(place).alias("ts"), place, "index", known.alias("id"), F.when(c("p") == 0, c("role")).alias("name"), "arguments")


DELTAS = "SELECT CAST(conv_id AS VARCHAR) AS round, CAST(turn AS INTEGER) AS index, CASE WHEN turn % 5 = 4 THEN '' ELSE 'call_' || turn END AS id, role AS name, turn % 7 = 3 AS broken, CASE WHEN turn % 7 <> 3 THEN text END AS said FROM conversations"


def parsed(calls):
    said = F.try_variant_get("payload", "$.text", "string").alias("said")
    return state.parsed_arguments(calls).select("round", "index", "id", "name", "broken", said)


@query("st5_tool_calls", DELTAS)
def st5_calls(spark, d):
    return parsed(logs.tool_calls(call_deltas(spark, d), ["round"], "place"))


@query("st5_tool_calls_state", DELTAS)
def st5_state(spark, d):
    """The same as keyed state: calls by index."""
    return parsed(state.gathered(call_deltas(spark, d)))


@query("st3_stream_lines", "SELECT event_id, event_type AS kind FROM events WHERE event_id % 3 <> 0")
def st3(spark, d):
    """Lines of a server-sent stream; a third of them are malformed or of another field."""
    line = F.when(c("event_id") % 3 != 0, F.concat(F.lit("data: "), F.to_json(F.struct("event_id", c("event_type").alias("kind"))))).when(c("event_id") % 2 == 0, F.lit("data: {broken")).otherwise(F.lit(": ping"))
    return logs.parsed_stream(table(spark, d, "events").select(line.alias("value")), "event_id long, kind string")


@query("st2_cache_key", "SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS cache_key FROM events")
def st2(spark, d):
    return table(spark, d, "events").select("event_id", logs.cache_key(F.struct("event_type", "user_id")).alias("cache_key"))


@query("st5_delta_concat", "SELECT conv_id, role, string_agg(text, '' ORDER BY turn) AS joined FROM conversations GROUP BY conv_id, role")
def st5(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", c("text").alias("t")))).alias("p"))
    return t.select("conv_id", "role", F.array_join(c("p.t"), "").alias("joined"))


@query("a23_usage_totals", "SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS total, count(*) FILTER (event_id % 10 = 0) AS errors FROM events GROUP BY user_id, event_type")
def a23(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.count_if(c("event_id") % 10 == 0).alias("errors"))


@query("st_tumbling_window", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_window(spark, d):
    """Spark's own windows over event time (an addition of this engine)."""
    e = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return logs.usage_by_window(e, "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n")


@query("st1_cache_replay")
def st1(spark, d):
    """The tile cache as keyed state: its entries with their order of use."""
    e = table(spark, d, "events").select(c("user_id").alias("shard"), c("ts").cast("timestamp").alias("ts"), (c("event_id") % 97).cast("string").alias("key"))
    return state.cached(e, 16, 3600.0)


@query("st2_preview_cache")
def st2_replay(spark, d):
    """The first-in-first-out preview cache: 24 entries, a quarter of an hour."""
    e = table(spark, d, "events").select(c("user_id").alias("shard"), c("ts").cast("timestamp").alias("ts"), logs.cache_key(F.struct("event_type", (c("event_id") % 97).alias("n"))).alias("key"))
    return state.cached(e, 24, 900.0, recent=False)


@query("st_session_windows", """
WITH g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS nw FROM events),
     v AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM v GROUP BY user_id, visit
""")
def st_sessions(spark, d):
    """Visits of users: Spark's own session windows (an addition of this engine)."""
    e = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return logs.sessions(e, ["user_id"], "ts", "value", "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 4).alias("total"))


@query("st_sliding_windows", """
SELECT strftime(make_timestamp(CAST((epoch(ts)::BIGINT // 7200 - k) * 7200 * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
FROM (SELECT *, date_trunc('second', ts) AS s FROM events) e, (VALUES (0), (1), (2)) v(k) GROUP BY ALL
""".replace("epoch(ts)::BIGINT", "CAST(floor(epoch(s)) AS BIGINT)"))
def st_sliding(spark, d):
    e = table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    return logs.usage_sliding(e, "ts", "event_type", "value").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("snk9_versions", "SELECT event_id FROM events ORDER BY event_type = 'click', ts DESC, event_id DESC LIMIT 2000")
def snk9_versions(spark, d):
    """A log that two writes have appended to and cut to its newest rows, in a table of snapshots: what the second brought is newer, whatever its times."""
    e, path = table(spark, d, "events").select("event_id", "event_type", "ts"), f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    for n, rows in enumerate((e.filter("event_type = 'click'"), e.filter("event_type <> 'click'"))):
        versions.retained(spark, path, rows, ["ts", "event_id"], logs.TOOL_LOGS, batch=("tools", n))
    return versions.read(spark, path, f"event_id long, event_type string, ts {e.schema['ts'].dataType.simpleString()}").select("event_id")


@query("snk10_session_store", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'click', ts DESC, event_id DESC) AS n FROM events) s WHERE n <= 500")
def snk10_store(spark, d):
    """The same by session, the second write delivered twice: the newest rows of each user."""
    e, path = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts"), f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    for n, kind in ((0, "event_type = 'click'"), (1, "event_type <> 'click'"), (1, "event_type <> 'click'")):
        versions.retained(spark, path, e.filter(kind), ["ts", "event_id"], logs.SESSION_LOGS, "user_id", batch=("sessions", n))
    return versions.read(spark, path, f"user_id long, event_id long, event_type string, ts {e.schema['ts'].dataType.simpleString()}").select("user_id", "event_id")


@query("w8_newest_by_user", "SELECT user_id, max(event_id) AS newest FROM events GROUP BY user_id")
def w8(spark, d):
    e = table(spark, d, "events")
    return e.withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))).filter("n = 1").select("user_id", c("event_id").alias("newest"))
