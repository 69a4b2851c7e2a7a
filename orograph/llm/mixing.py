"""Operator 9, mixing sources to target weights by a low-discrepancy schedule.

Documents of a source are shuffled by a hash of key and text and laid end to end; that line is
cut into blocks of equally many words. Slot k of the mix has the golden-ratio
point ``frac(k * phi)``; mapped through the cumulative weights it names a source,
and its rank among the slots of that source names the block (rank modulo the
blocks, so a source that must give more than it has starts over). Any stretch of
slots is close to the target weights.

Sizes: only sums a source, a bucket and a chunk of slots are gathered. One row a
source reaches the driver; positions within a source come from sums of hash
buckets of some thousand rows and from windows within a bucket, so that a hot
source spreads over many tasks.

Defined results: a null text has size 0 and gets nothing; null sources form one
source, the last; rows without an id or with equal ids differ by their text;
repeated rows are separate documents, ties in the hash are broken by id and
size; very long texts span several blocks; an empty table gives an empty result.
Blocks have the 200,000th part of all words, from 16 to 2,048: this is only how
fine the mix is, every word lies in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.llm.common import checkpointed, table

PHI = (5**0.5 - 1) / 2
#: Repeats of a document at most; rows of a hash bucket; slots of a chunk; least and most words of a block; blocks of a source at least.
REPEATS, BUCKET_ROWS, CHUNK, LEAST_WORDS, MOST_WORDS, LEAST_BLOCKS = 3, 4_000, 65_536, 16, 2_048, 512
WEIGHTS = (1, 2, 3)


def weights_by_order(sources: list[str | None]) -> dict[str | None, float]:
    """1, 2, 3, repeating, over sources by code point, null last."""
    ordered = sorted(sources, key=lambda s: (s is None, s or ""))
    return {s: float(WEIGHTS[i % len(WEIGHTS)]) for i, s in enumerate(ordered)}


def fill(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, repeats: int = REPEATS) -> dict[str | None, float]:
    """Targets that share ``total`` by weight, at most ``repeats`` times a source's size; excess is reshared until none is above."""
    target = dict.fromkeys(sizes, 0.0)
    open_, left = {s for s in sizes if sizes[s] and weights[s] > 0}, float(total)
    while open_ and left > 0:
        share = left / sum(weights[s] for s in open_)
        full = [s for s in open_ if share * weights[s] >= repeats * sizes[s]]
        if not full:
            target.update((s, share * weights[s]) for s in open_)
            break
        for s in full:
            target[s] = float(repeats * sizes[s])
            left -= target[s]
            open_.remove(s)
    return target


@dataclass(frozen=True)
class Plan:
    """Sources in order with their sizes, rows, targets, blocks, and how many slots the mix has."""

    sources: list[str | None]
    sizes: np.ndarray
    rows: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    edges: np.ndarray  # cumulative share of slots
    slots: int


def plan(found: dict[str | None, tuple[int, int]], weights: dict[str | None, float] | None = None) -> Plan:
    sources = sorted(found, key=lambda s: (s is None, s or ""))
    sizes = np.array([found[s][0] for s in sources], np.int64)
    weights = weights or weights_by_order(sources)
    total = int(sizes.sum())
    target = fill({s: found[s][0] for s in sources}, weights, total)
    targets = np.array([target[s] for s in sources])
    block = min(MOST_WORDS, max(LEAST_WORDS, total // 200_000))
    blocks = np.maximum(-(-sizes // block), np.minimum(sizes, LEAST_BLOCKS)).clip(1)
    wanted = np.where(sizes > 0, targets * blocks / np.maximum(sizes, 1), 0.0)
    edges = np.cumsum(wanted) / max(wanted.sum(), 1e-9)
    return Plan(sources, sizes, np.array([found[s][1] for s in sources]), targets, blocks, edges, int(round(wanted.sum())))


def source_of_slots(first: int, n: int, edges: np.ndarray) -> np.ndarray:
    k = np.arange(first, first + n, dtype=np.uint64)
    # frac(k * phi) in 64-bit fixed point: exact to the last bit for any k.
    point = (k * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64) / 2.0**64
    return np.minimum(np.searchsorted(edges, point, side="right"), len(edges) - 1)


def schedule(spark: SparkSession, p: Plan) -> DataFrame:
    """The mix: slot, source (number), rank among the source's slots, block. Ranks come from counts by chunk."""
    edges, blocks, slots, n = p.edges, p.blocks, p.slots, len(p.sources)
    chunks = -(-slots // CHUNK)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in batch.column(0).to_pylist():
                found = np.bincount(source_of_slots(c * CHUNK, min(CHUNK, slots - c * CHUNK), edges), minlength=n)
                yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(found, pa.int64())], names=["chunk", "src", "n"])

    parts = max(1, min(chunks, 4 * spark.sparkContext.defaultParallelism))
    by_chunk = spark.range(0, chunks, 1, parts).mapInArrow(counts, "chunk long, src int, n long")
    before = W.partitionBy("src").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    bases = by_chunk.select("chunk", "src", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("src", "base"))).alias("b"))

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                src = source_of_slots(c * CHUNK, min(CHUNK, slots - c * CHUNK), edges)
                order = np.argsort(src, kind="stable")
                starts = np.searchsorted(src[order], np.arange(n))
                rank = np.empty(len(src), np.int64)
                rank[order] = np.arange(len(src)) - starts[src[order]]
                rank += np.array(base, np.int64)[src]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(src)) + c * CHUNK), pa.array(src.astype(np.int32)), pa.array(rank), pa.array(rank % blocks[src])], names=["slot", "src", "rank", "block"])

    return bases.select("chunk", F.col("b.base").alias("base")).mapInArrow(ranks, "slot long, src int, rank long, block long")


def sized(df: DataFrame, keys: list[str], source: str, text: str, row: str | None = None) -> DataFrame:
    """Keys, source, number of words and a hash that shuffles, with a number a row (``row``, or a new one); written once, as texts are read for it."""
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    words = F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    return df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(source).cast("string").alias("__source"), words.alias("size"), F.xxhash64(F.lit(17), *keys, text).alias("__h"), number.alias("__row"))


def mix(df: DataFrame, keys: list[str], source: str = "source", text: str = "text", weights: dict[str | None, float] | None = None, row: str | None = None) -> DataFrame:
    """Each row's keys, size, source_size, target, and the words that the mix takes from it; and ``row``, a column of numbers unlike in all rows, if named."""
    spark = df.sparkSession
    rows = checkpointed(sized(df, keys, source, text, row))
    found = {r["__source"]: (r["s"], r["n"]) for r in rows.groupBy("__source").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).collect()}
    p = plan(found, weights)
    facts = spark.createDataFrame(
        [(s, i, int(p.sizes[i]), float(p.targets[i]), int(p.blocks[i]), int(max(1, -(-p.rows[i] // BUCKET_ROWS)))) for i, s in enumerate(p.sources)],
        "s string, src int, source_size long, target double, blocks long, buckets long",
    )
    # A row a source on the driver already; Spark broadcasts it if it is small.
    placed = rows.join(facts, F.col("__source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.withColumn("__bucket", F.floor((F.shiftrightunsigned("__h", 32) / F.lit(float(1 << 32))) * F.col("buckets")))
    sums = placed.groupBy("src", "__bucket").agg(F.sum("size").alias("__sum"))
    offsets = sums.select("src", "__bucket", F.coalesce(F.sum("__sum").over(W.partitionBy("src").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inner = W.partitionBy("src", "__bucket").orderBy("__h", *[f"__k{i}" for i in range(len(keys))], "size", "__row").rowsBetween(W.unboundedPreceding, W.currentRow)
    running = placed.withColumn("__end", F.sum("size").over(inner)).join(offsets, ["src", "__bucket"]).withColumn("__end", F.col("__end") + F.col("__offset")).withColumn("__start", F.col("__end") - F.col("size"))

    if p.slots:
        passes = schedule(spark, p).groupBy("src", "block").agg(F.least(F.count(F.lit(1)), F.lit(REPEATS)).alias("passes"))
    else:
        passes = spark.createDataFrame([], "src int, block long, passes long")
    # Blocks that a document lies in: block j holds the words from floor(j * size / blocks) on.
    block_of = lambda word: F.expr(f"(({word} + 1) * blocks - 1) div source_size")
    some = running.filter("size > 0").withColumn("block", F.explode(F.sequence(block_of("__start"), block_of("(__end - 1)"))))
    low, high = F.expr("(block * source_size) div blocks"), F.expr("((block + 1) * source_size) div blocks")
    overlap = F.greatest(F.least("__end", high) - F.greatest("__start", low), F.lit(0))
    taken = some.withColumn("__overlap", overlap).join(passes, ["src", "block"]).groupBy("__row").agg(F.sum(F.col("__overlap") * F.col("passes")).alias("taken"))
    out = placed.join(taken, "__row", "left")
    return out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], *([] if row is None else [F.col("__row").alias(row)]), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op9_mixing": op9_mixing}
