"""Operator 13, packing of documents into sequences by cutting-stock column generation.

1. Documents are encoded; each gives pieces of ``CAPACITY`` tokens, sequences of
   their own, and a rest. Every ``FILLER``-th rest of a task is set aside with
   its ids. The others are counted by length, rounded up by at most a 32nd.
2. The linear program over patterns (how many rests of each length a sequence
   holds) is solved by column generation: the program's prices go to a knapsack
   by dynamic programming, whose best pattern enters, until the bound says that
   no better program is near. The histogram has at most 256 lengths, whatever
   the corpus, so this is a small computation at the driver.
3. Patterns are taken as often as the whole part of the solution says; what is
   left is packed greedily, largest first.
4. Rests are ranked within their length (their number in the task, after those
   of earlier tasks), and ranks are dealt to patterns by intervals.
5. What rounding and rest patterns leave free in the sequences is filled: gaps
   and the tokens set aside are two streams of positions, cut where either ends.
   What is set aside beyond that makes sequences of its own, the last of them
   powers of two.

Most documents are cut at multiples of ``CAPACITY`` only; those set aside are cut
to measure. Defined results: a null text is an empty one and has the end token
only; rows of equal or no id are packed each for itself; equal lengths tie by
their number in the task; a very long text gives as many pieces as it needs; an
empty table gives an empty result; other columns are not read. Where less is set
aside than there are gaps (a few rows), what stays is padding.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.llm.common import SLICE_ROWS, holds, shared_folder, table
from orograph.llm.token_alignment import byte_symbols

VOCABULARY, END_ID = "word_bpe_49k.json", 2
CAPACITY, FILLER = 4096, 16
#: Share of sequences over the bound at which columns stop; columns at most.
NEAR, COLUMNS = 0.002, 400
#: Bytes of chunks and of words with their ids before a worker's caches drop what is older; what is longer than LONG isn't kept.
CACHE_BYTES, PART_BYTES, LONG = 220_000_000, 60_000_000, 200
#: Rows of a block of sequences whose gaps are summed together.
BLOCK = 1024

ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: As the vocabulary's own pattern.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def little(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordEncoder:
    """The tokenizer, with its ids of chunks between white space in a bounded cache.

    No token crosses white space, so a text's ids are those of its chunks. A new
    chunk of plain characters is lower-cased and split here and its words go to
    the tokenizer's model; any other goes to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            self.begins = {t["content"][0] for t in json.load(file)["added_tokens"]}
        #: White space, marks to compose and what begins a special token are left out.
        self.plain = re.compile("[" + "".join(re.escape(chr(c)) for c in [*range(0x21, 0x7F), *range(0xA1, 0x250)] if chr(c) not in self.begins) + "]+")
        self.words = regex.compile(WORDS)
        symbols = {b: c for c, b in byte_symbols().items()}
        self.symbols = [symbols[b] for b in range(256)]
        self.chunks: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.held = [0, 0]

    def _word(self, word: str) -> bytes:
        found = self.parts.get(word)
        if found is None:
            if self.held[1] > PART_BYTES:
                self.parts, self.held[1] = {}, 0
            raw = word if word.isascii() else "".join(map(self.symbols.__getitem__, word.encode()))
            found = little([t.id for t in self.model.tokenize(raw)])
            if len(word) < LONG:
                self.parts[word] = found
                self.held[1] += 200 + len(word) + len(found)
        return found

    def _chunk(self, chunk: str) -> bytes:
        if self.plain.fullmatch(chunk):
            low = chunk.lower()
            if low.isalpha():
                return self._word(low)
            return b"".join(map(self._word, (ASCII_WORDS if low.isascii() else self.words).findall(low)))
        return little(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def _cut(self, text: str | None) -> list[str]:
        text = (text or "").replace("\n", " ")
        # Lower case where no special token can come of it.
        return (text.lower() if text.isascii() and not any(b in text for b in self.begins) else text).split(" ")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end token, as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) for t in texts]
        if self.held[0] > CACHE_BYTES // 2:
            # Half full: what isn't asked for until it is so again goes.
            self.old, self.chunks, self.held[0] = self.chunks, {"": b""}, 0
        known, once = self.chunks, {}
        for c in set().union(*cut) - known.keys():
            found = self.old.get(c)
            if found is None:
                found = self._chunk(c)
            if len(c) < LONG:
                known[c] = found
                self.held[0] += 150 + len(c) + len(found)
            else:
                once[c] = found
        end = little([END_ID])
        if once:
            return [b"".join([once[c] if c in once else known[c] for c in chunks]) + end for chunks in cut]
        return [b"".join(map(known.__getitem__, chunks)) + end for chunks in cut]


@lru_cache(2)
def encoder(path: str | None = None) -> WordEncoder:
    """The encoder of a vocabulary file; by default of the installed one."""
    import public_tokenizers

    return WordEncoder(path or public_tokenizers.path(VOCABULARY))


def rounded(length: int) -> int:
    """The length up to a 32nd: exact to 64, then in steps that double with the length."""
    step = 1 << max(0, (length - 1).bit_length() - 6)
    return -(-length // step) * step


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, kind int, rank long, ids binary"
#: Kinds besides rounded lengths: a whole sequence, and what is set aside (its rank is its first position in the task's stream).
WHOLE, ASIDE = 0, -1


def cut(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """A row a piece (``PIECES``): kind, and number among the task's pieces of that kind."""
    fields = [x.split()[0] for x in PIECES.split(", ")]
    types = [pa.binary() if x.endswith("binary") else pa.int32() if x.endswith("int") else pa.int64() for x in PIECES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, count, rests, aside = TaskContext.get().partitionId(), {}, 0, 0
        holds("packing", encoder.cache_clear)
        enc = encoder(path)
        for batch in batches:
            step = max(1, min(SLICE_ROWS, 4_000_000 * batch.num_rows // max(1, batch.column(1).nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = []
                for i, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist()), strict=True):
                    n = len(ids) // 4
                    for start in range(0, n, CAPACITY):
                        length = min(CAPACITY, n - start)
                        piece, kept = ids[4 * start : 4 * (start + length)], None
                        if length == CAPACITY:
                            kind = WHOLE
                        else:
                            kind, rests = ASIDE if rests % FILLER == 0 else rounded(length), rests + 1
                        if kind == ASIDE:
                            rank, aside, kept = aside, aside + length, piece
                        else:
                            rank = count[kind] = count.get(kind, -1) + 1
                        out.append((i, start, length, zlib.crc32(piece), n, task, kind, rank, kept))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=fields)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, PIECES)


def knapsack(lengths: np.ndarray, prices: np.ndarray) -> tuple[float, np.ndarray]:
    """The most that a sequence's worth of pieces can cost, and how many of each length that takes. ``lengths`` ascend."""
    useful = np.flatnonzero(prices > 1e-9)
    size, price = lengths[useful], prices[useful]
    best = np.zeros(CAPACITY + 1)
    for length, worth in zip(size.tolist(), price.tolist(), strict=True):
        # Copies by doubling: one more, two more, four more.
        while length <= CAPACITY:
            np.maximum(best[length:], best[:-length] + worth, out=best[length:])
            length, worth = 2 * length, 2 * worth
    many, c = np.zeros(len(lengths), np.int64), CAPACITY
    while n := int(np.searchsorted(size, c, side="right")):
        worth = best[c - size[:n]] + price[:n]
        k = int(worth.argmax())
        if worth[k] < best[c] - 1e-9:
            c -= 1
            continue
        many[useful[k]] += 1
        c -= int(size[k])
    return float(best[CAPACITY]), many


def solved(lengths: np.ndarray, demand: np.ndarray, near: float = NEAR, columns: int = COLUMNS) -> list[tuple[np.ndarray, float]]:
    """Patterns with how often (a fraction) the linear program takes each: the fewest sequences that hold ``demand`` pieces of each of ``lengths``."""
    m = len(lengths)
    base = np.diag((CAPACITY // lengths).astype(float))
    inverse, cost = np.diag(1 / np.diag(base)), np.ones(m)
    x = np.diag(inverse) * demand
    for _ in range(columns):
        prices = np.einsum("i,ij->j", cost, inverse)
        if (least := int(prices.argmin())) < 0 or prices[least] < -1e-9:
            column, price = -np.eye(m)[least], 0.0  # more pieces of a length than there are
        else:
            worth, many = knapsack(lengths, prices)
            # Prices scaled so that no pattern costs more than 1 bound the program from below.
            if worth <= 1 + 1e-9 or float((x * cost).sum()) <= (1 + near) * float((prices * demand).sum()) / worth:
                break
            column, price = many.astype(float), 1.0
        step = np.einsum("ij,j->i", inverse, column)
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        base[:, out], cost[out] = column, price
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return [(base[:, j].astype(np.int64), float(x[j])) for j in range(m) if cost[j] > 0 and x[j] > 1e-9]


def dealt(histogram: dict[int, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Intervals (kind, first rank, end, first sequence, ranks a sequence) for a histogram of rounded lengths, and the number of sequences. Sequences of left-over patterns, which have the larger gaps, come first."""
    kinds = sorted(k for k, n in histogram.items() if n)
    if not kinds:
        return [], 0
    lengths, left = np.array(kinds), np.array([histogram[k] for k in kinds])
    taken = []
    for many, often in solved(lengths, left.astype(float)):
        if (times := int(often + 1e-6)) > 0:
            # Where a length is covered more often than it has pieces, the last copies go without.
            taken.append((many, times))
    for many, times in taken:
        left = np.maximum(left - many * times, 0)
    greedy = []
    while left.any():
        many, room = np.zeros(len(kinds), np.int64), CAPACITY
        for i in range(len(kinds) - 1, -1, -1):
            many[i] = min(left[i], room // lengths[i])
            room -= many[i] * lengths[i]
        times = int((left[many > 0] // many[many > 0]).min())
        greedy.append((many, times))
        left = left - many * times
    rows, rank, sequence = [], dict.fromkeys(range(len(kinds)), 0), 0
    for many, times in [*greedy, *taken]:
        for i in np.flatnonzero(many):
            end = min(histogram[kinds[i]], rank[i] + int(many[i]) * times)
            if end > rank[i]:
                rows.append((kinds[i], rank[i], end, sequence, int(many[i])))
                rank[i] = end
        sequence += times
    return rows, sequence


def summed(rows: DataFrame, block: str, order: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all rows before, by blocks (each a window of bounded size) and then over the blocks' sums."""
    sums = rows.groupBy(block).agg(F.sum(value).alias("__sum"))
    before = sums.select(block, F.coalesce(F.sum("__sum").over(W.orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy(block).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__in", inside).join(before, block).withColumn(name, F.col("__in") + F.col("__before")).drop("__in", "__before")


def tail(first: int, sequence: int, length: int) -> list[tuple[int, int, int, int]]:
    """Rows (sequence, offset, position, size) of the last ``length`` positions: a sequence a power of two."""
    out = []
    for bit in reversed(range(length.bit_length())):
        if length >> bit & 1:
            out.append((sequence + len(out), 0, first, 1 << bit))
            first += 1 << bit
    return out


RESULT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/packing-{uuid.uuid4().hex}"
    cut(docs, doc_id, text, path).write.parquet(f"{folder}/pieces")
    pieces = spark.read.schema(PIECES).parquet(f"{folder}/pieces")
    # A row a task and kind, then a row a kind: at most 256 lengths.
    counts = pieces.filter(F.col("kind") != ASIDE).groupBy("kind", "task").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(WHOLE, 0)
    rows, sequences = dealt(histogram)
    rows.append((WHOLE, 0, whole, sequences, 1))
    plan = F.broadcast(spark.createDataFrame(rows, "kind int, low long, high long, first long, many long"))
    earlier = counts.select("kind", "task", F.coalesce(F.sum("n").over(W.partitionBy("kind").orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    ranked = pieces.filter(F.col("kind") != ASIDE).drop("ids").join(earlier, ["kind", "task"]).withColumn("rank", F.col("rank") + F.col("earlier"))
    placed = ranked.join(plan, (ranked["kind"] == plan["kind"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    placed = placed.select(ranked["kind"], "rank", *RESULT[:5], (F.col("first") + F.expr("(rank - low) div many")).alias("sequence_id"))
    offset = F.sum("length").over(W.partitionBy("sequence_id").orderBy(F.desc("kind"), "rank").rowsBetween(W.unboundedPreceding, -1))
    placed.filter(F.col("kind") != WHOLE).select(*RESULT[:6], F.coalesce(offset, F.lit(0)).alias("offset")).write.parquet(f"{folder}/placed")
    set_down = spark.read.parquet(f"{folder}/placed")
    used = set_down.groupBy("sequence_id").agg(F.sum("length").alias("offset")).select("sequence_id", "offset", (F.lit(CAPACITY) - F.col("offset")).alias("size"), F.expr(f"sequence_id div {BLOCK}").alias("block"))
    gaps = summed(used.filter("size > 0"), "block", "sequence_id", "size", "position").select("sequence_id", "offset", "position", "size")
    room = used.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    aside = pieces.filter(F.col("kind") == ASIDE)
    ends = aside.groupBy("task").agg(F.sum("length").alias("n"))
    total = ends.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    more = max(0, total - room)
    after = sequences + whole
    extra = spark.range(more // CAPACITY).select((F.col("id") + after).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), (F.col("id") * CAPACITY + room).alias("position"), F.lit(CAPACITY).cast("long").alias("size"))
    last = spark.createDataFrame(tail(room + more // CAPACITY * CAPACITY, after + more // CAPACITY, more % CAPACITY), "sequence_id long, offset long, position long, size long")
    before = ends.select("task", F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    tokens = aside.join(before, "task").select("doc_id", F.col("start").alias("from"), "length", "doc_tokens", "ids", (F.col("rank") + F.col("before")).alias("at"))
    # Both streams by blocks of positions; a piece belongs to the block in which it begins.
    spread = lambda df, at, n: df.withColumn("slot", F.explode(F.sequence(F.expr(f"`{at}` div {CAPACITY}"), F.expr(f"(`{at}` + `{n}` - 1) div {CAPACITY}"))))
    met = spread(tokens, "at", "length").join(spread(gaps.unionByName(extra).unionByName(last), "position", "size"), "slot")
    begin, end = F.greatest("at", "position"), F.least(F.col("at") + F.col("length"), F.col("position") + F.col("size"))
    fills = met.withColumns({"begin": begin, "end": end}).filter((F.col("begin") < F.col("end")) & (F.expr(f"`begin` div {CAPACITY}") == F.col("slot")))
    skipped, taken = F.col("begin") - F.col("at"), F.col("end") - F.col("begin")
    digest = F.crc32(F.substring("ids", (4 * skipped + 1).cast("int"), (4 * taken).cast("int")))
    filled = fills.select("doc_id", (F.col("from") + skipped).alias("start"), taken.alias("length"), digest.alias("ids_crc32"), "doc_tokens", "sequence_id", (F.col("offset") + F.col("begin") - F.col("position")).alias("offset"))
    full = placed.filter(F.col("kind") == WHOLE).select(*RESULT[:6], F.lit(0).cast("long").alias("offset"))
    return set_down.unionByName(full).unionByName(filled).select(RESULT)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op13_packing": op13_packing}
