"""Keyed stream state: tile and preview caches, calls matched with their ends, events folded into parts, tool-call deltas gathered.

Each operator is a ``StatefulProcessor`` that takes streaming and batch frames
alike. Rows of one micro-batch are taken in order of time (and a tie-break);
micro-batches in the order in which they come. On a stream, frames need a
watermark on ``ts``: rows behind it are dropped, as Spark's stateful operators
do, and event-time timers release what waits and clear what is idle, so state
doesn't outlive its use. State is bounded by what a key has open: a cache's
entries, calls that wait, one part.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Timed(StatefulProcessor):
    """A processor with at most one timer a key, at event time (none on batch frames)."""

    def __init__(self, streams: bool) -> None:
        self.streams = streams

    def wake(self, at: int) -> None:
        """One timer at ``at`` (milliseconds) instead of any before it."""
        if self.streams:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def stateful(df: DataFrame, keys: list[str], processor: type[Timed], schema: str, **options) -> DataFrame:
    """``processor`` on the rows of each of ``keys``."""
    # Timers and several states a key need this store; the session's streams hold its coordinator, on batch frames too.
    _ = df.sparkSession.streams.active
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    mode = "EventTime" if df.isStreaming else "None"
    # Microseconds since 1970, whatever the time zones of session and workers.
    df = df.withColumn("us", F.unix_micros("ts"))
    return df.groupBy(*keys).transformWithState(processor(df.isStreaming, **options), schema, "Append", mode)


class Cache(Timed):
    """Hits of a cache with a bound and a time to live.

    An entry is too old when its age is over ``ttl_ms``; a miss puts it anew. A hit
    refreshes the place, not the age, if ``recent`` (least recently used goes
    first), else neither (first in, first out).
    """

    def __init__(self, streams: bool, most: int, ttl_ms: int, recent: bool) -> None:
        super().__init__(streams)
        self.most, self.ttl_ms, self.recent = most, ttl_ms, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "put_us long, place long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        stored = {k[0]: (v[0], v[1]) for k, v in self.entries.iterator()}
        held = OrderedDict(sorted(stored.items(), key=lambda e: e[1][1]))
        places = count(max((p for _, p in held.values()), default=-1) + 1)
        last = 0
        for row in sorted(rows, key=lambda r: (r.us, r.key)):
            now = row.us
            put = held.get(row.key)
            hit = put is not None and now - put[0] <= 1000 * self.ttl_ms
            if self.recent or not hit:
                held.pop(row.key, None)
                held[row.key] = (put[0] if hit else now, next(places))
            if len(held) > self.most:
                held.popitem(last=False)
            last = max(last, now // 1000)
            yield Row(**{k: v for k, v in zip(self.keys, key, strict=True)}, ts=row.ts, key=row.key, hit=hit)
        for name in stored.keys() - held.keys():
            self.entries.removeKey((name,))
        for name, entry in held.items():
            if stored.get(name) != entry:
                self.entries.updateValue((name,), entry)
        self.wake(last + self.ttl_ms + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Nothing was asked for as long as an entry lives: the key's state goes."""
        self.entries.clear()
        return iter(())


class ShardCache(Cache):
    keys = ("shard",)


def cached(accesses: DataFrame, most: int, ttl_s: float, recent: bool = True) -> DataFrame:
    """(shard, ts, key, hit) for accesses (shard long, ts timestamp, key string): a cache a shard, its entries as keyed state."""
    kept = accesses.select("shard", "ts", "key")
    return stateful(kept, ["shard"], ShardCache, "shard long, ts timestamp, key string, hit boolean", most=most, ttl_ms=round(1000 * ttl_s), recent=recent)


class Calls(Timed):
    """Starts wait in a queue; an end takes the first of those before it, or stands alone."""

    def __init__(self, streams: bool, patience_ms: int) -> None:
        super().__init__(streams)
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string, us long")

    def keep(self, queue: deque) -> None:
        self.waiting.clear()
        if queue:
            self.waiting.put(list(queue))
            self.wake(queue[0][1] // 1000 + self.patience_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        queue = deque((x[0], x[1]) for x in self.waiting.get())
        done = []
        for row in sorted(rows, key=lambda r: (r.us, r.place)):
            if row.starts:
                queue.append((row.id, row.us))
            else:
                done.append((queue.popleft()[0] if queue else None, row.id))
        if not self.streams:
            done += [(start, None) for start, _ in queue]
            queue.clear()
        self.keep(queue)
        for start, end in done:
            yield Row(request=key[0], tool=key[1], start_id=start, end_id=end)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Starts whose patience is over are given up."""
        now = timerValues.getCurrentWatermarkInMs()
        queue = deque((x[0], x[1]) for x in self.waiting.get())
        given_up = []
        while queue and queue[0][1] // 1000 + self.patience_ms <= now:
            given_up.append(queue.popleft()[0])
        self.keep(queue)
        for start in given_up:
            yield Row(request=key[0], tool=key[1], start_id=start, end_id=None)


def matched(events: DataFrame, patience_s: float = 3600) -> DataFrame:
    """(request, tool, start_id, end_id) for events (request, tool, id strings, ts timestamp, place long, starts boolean): first start, first end.

    An end without a start before it stands alone at once; a start without an end
    when ``patience_s`` of event time have gone by (on batch frames, at the end).
    """
    kept = events.select("request", "tool", "id", "ts", "place", "starts")
    return stateful(kept, ["request", "tool"], Calls, "request string, tool string, start_id string, end_id string", patience_ms=round(1000 * patience_s))


class Parts(Timed):
    """The open part; it closes when the kind changes, or when nothing came for a while."""

    def __init__(self, streams: bool, idle_ms: int) -> None:
        super().__init__(streams)
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "part int, kind string, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        part, kind, texts = (0, None, []) if not self.open.exists() else (lambda x: (x[0], x[1], [x[2]]))(self.open.get())
        closed, last = [], 0
        for row in sorted(rows, key=lambda r: (r.us, r.place)):
            if not texts or row.kind != kind:
                if texts:
                    closed.append((part, kind, "".join(texts)))
                part, kind, texts = part + 1, row.kind, []
            texts.append(row.text or "")
            last = max(last, row.us // 1000)
        if self.streams:
            self.open.update((part, kind, "".join(texts)))
            self.wake(last + self.idle_ms)
        else:
            closed.append((part, kind, "".join(texts)))
        for number, name, text in closed:
            yield Row(conversation=key[0], part=number, kind=name, text=text)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The last part; what comes later would be counted anew."""
        if self.open.exists():
            part, kind, text = self.open.get()
            self.open.clear()
            yield Row(conversation=key[0], part=part, kind=kind, text=text)


def folded(events: DataFrame, idle_s: float = 3600) -> DataFrame:
    """(conversation, part, kind, text) for events (conversation string, ts timestamp, place long, kind, text strings): adjacent events of one kind are a part."""
    kept = events.select("conversation", "ts", "place", "kind", "text")
    return stateful(kept, ["conversation"], Parts, "conversation string, part int, kind string, text string", idle_ms=round(1000 * idle_s))


class Deltas(Timed):
    """Tool calls by index, in the order in which they first appeared; all come out when the round ends or nothing came for a while."""

    def __init__(self, streams: bool, idle_ms: int) -> None:
        super().__init__(streams)
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.calls = handle.getMapState("calls", "index int", "place int, id string, name string, arguments string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        calls = {k[0]: [v[0], v[1], v[2], [v[3]]] for k, v in self.calls.iterator()}
        seen, over, last = set(), False, 0
        for row in sorted(rows, key=lambda r: (r.us, r.place)):
            last = max(last, row.us // 1000)
            if row["index"] is None:
                over = True
                continue
            if row["index"] not in calls:
                calls[row["index"]] = [len(calls), row.id or "", row.name or "", []]
            calls[row["index"]][3].append(row.arguments or "")
            seen.add(row["index"])
        if over or not self.streams:
            self.calls.clear()
            yield from self.given(key, calls)
            return
        for index in seen:
            place, ident, name, texts = calls[index]
            self.calls.updateValue((index,), (place, ident, name, "".join(texts)))
        self.wake(last + self.idle_ms)

    def given(self, key, calls: dict) -> Iterator[Row]:
        for index, (place, ident, name, texts) in sorted(calls.items(), key=lambda c: c[1][0]):
            yield Row(round=key[0], place=place, index=index, id=ident, name=name, arguments="".join(texts))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        calls = {k[0]: [v[0], v[1], v[2], [v[3]]] for k, v in self.calls.iterator()}
        self.calls.clear()
        yield from self.given(key, calls)


def gathered(deltas: DataFrame, idle_s: float = 3600) -> DataFrame:
    """(round, place, index, id, name, arguments) for deltas (round string, ts timestamp, place long, index int, id, name, arguments strings).

    Id and name are those of a call's first delta, also where they are missing
    there. A row without an index ends the round.
    """
    kept = deltas.select("round", "ts", "place", "index", "id", "name", "arguments")
    return stateful(kept, ["round"], Deltas, "round string, place int, index int, id string, name string, arguments string", idle_ms=round(1000 * idle_s))


def parsed_arguments(calls: DataFrame) -> DataFrame:
    """Adds ``payload`` (a variant; null where the arguments aren't whole JSON) and ``broken``."""
    payload = F.try_parse_json(F.when(F.trim("arguments") == "", F.lit("{}")).otherwise(F.col("arguments")))
    return calls.withColumn("payload", payload).withColumn("broken", F.col("payload").isNull())
