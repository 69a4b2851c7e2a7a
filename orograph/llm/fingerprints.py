"""Operator 5, document fingerprints by invertible Bloom lookup sketches.

A text is cut into paragraphs: after line ends and, so that long lines have
several, after spaces chosen by the characters before them; a longer run than
``MOST`` characters ends every so many. Each paragraph has a 64-bit digest that
carries its length. A sketch has cells of (count, digests
xor-ed, checks xor-ed); each digest lies in three of them. The sketches of two
versions subtract; cells that hold one digest are peeled until none is left,
which recovers the paragraphs that differ. If that fails, both are sketched
again with four times the cells. Likeness is the weighted Jaccard similarity:
characters in shared paragraphs over those in either.

Rows need the row after them: ids are cut at quantiles, a range is a part, and
the row at which the next range begins is dealt to both, so that texts move
once and no task holds more than two texts and their sketches. An id (or null)
that fills several quantiles is cut further by a hash of the text.

Defined results: a null text counts as empty; two empty texts have likeness 1,
an empty one and another 0; rows follow each other by id, then a hash of the
text, null ids last; repeated rows follow each other; after the last row comes the first; a
table of one row has itself as the next; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm.common import table

#: Cells of a first sketch and growth on failure; characters of a paragraph, which its digest has room for; parts a shuffle partition.
CELLS, GROWTH, MOST, PARTS = 24, 4, 32_768, 8
#: Larger sketches that are tried, and cells of the largest: as many as the cells' numbers reach.
TRIES, MOST_CELLS = 4, 3 << 20
MIX, ODD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    x = (x ^ (x >> np.uint64(29))) * ODD
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of ODD and of its inverse, modulo 2 ** 64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 2 * len(_powers), 4096)
        _powers = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, ODD))])
        _inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, INVERSE))])
    if len(_powers) > 1 << 20 and n < 1 << 16:  # a long text's table isn't kept
        _powers, _inverses = _powers[: 1 << 16].copy(), _inverses[: 1 << 16].copy()
    return _powers, _inverses


def digests(text: str) -> np.ndarray:
    """A digest of each paragraph; its low 16 bits are the length, repeats differ by their number."""
    if not text:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = c == 10
    if len(c) > 4:
        near = c[3:-1] * np.uint32(0x9E3779B1) + c[2:-2] * np.uint32(0x85EBCA77) + c[1:-3] * np.uint32(0xC2B2AE3D)
        near ^= near >> np.uint32(15)
        ends[4:] |= (c[4:] == 32) & ((near * np.uint32(0x2C1B3C6D)) >> np.uint32(29) == 0)
    ends[-1] = True
    stop = np.flatnonzero(ends) + 1
    start = np.concatenate([[0], stop[:-1]])
    if (stop - start).max() > MOST:
        pieces = -(-(stop - start) // MOST)
        first = np.cumsum(pieces) - pieces
        within = np.arange(pieces.sum()) - np.repeat(first, pieces)
        start = np.repeat(start, pieces) + within * MOST
        stop = np.minimum(start + MOST, np.repeat(stop, pieces))
    up, down = powers(len(c))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(c.astype(np.uint64)) * up[: len(c)])])
    size = stop - start
    h = mixed((sums[stop] - sums[start]) * down[start] + size.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    s = h[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    at = np.arange(len(s))
    number = at - np.maximum.accumulate(np.where(first, at, 0))
    repeated = np.empty(len(h), np.uint64)
    repeated[order] = number
    h = np.where(repeated > 0, mixed(h + repeated * ODD), h)
    return (h & ~np.uint64(0xFFFF)) | size.astype(np.uint64)


def weight(keys: np.ndarray) -> int:
    return int((keys & np.uint64(0xFFFF)).sum())


def cells_of(keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each key, one in each third: all first, all second, all third ones."""
    third = np.uint64(cells // 3)
    h = mixed(keys)
    return np.concatenate([(h & np.uint64(0xFFFFF)) % third, ((h >> np.uint64(20)) & np.uint64(0xFFFFF)) % third + third, (h >> np.uint64(42)) % third + np.uint64(2) * third]).astype(np.intp)


def check(keys: np.ndarray) -> np.ndarray:
    x = (keys ^ (keys >> np.uint64(33))) * INVERSE
    return (x ^ (x >> np.uint64(29))) * MIX >> np.uint64(32)


def sketch(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts; digests (first half) and checks (second half), each xor-ed."""
    at = cells_of(keys, cells)
    xored = np.zeros(2 * cells, np.uint64)
    np.bitwise_xor.at(xored, np.concatenate([at, at + cells]), np.concatenate([keys, keys, keys, *[check(keys)] * 3]))
    return np.bincount(at, minlength=cells), xored


def peel(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray] | None:
    """Keys of sketch a alone and of b alone; None if cells are left that can't be told apart."""
    count, xored = a[0] - b[0], a[1] ^ b[1]
    cells, plus, minus, n = len(count), [], [], 0
    while True:
        single = np.flatnonzero(np.abs(count) == 1)
        values = xored[single]
        pure = check(values) == xored[single + cells]
        if not pure.any():
            break
        single, values = single[pure], values[pure]
        keys, first = np.unique(values, return_index=True)
        sign = count[single[first]]
        plus.append(keys[sign > 0])
        minus.append(keys[sign < 0])
        n += len(keys)
        if n > 2 * cells:
            return None  # a wrong check value: never ends
        at = cells_of(keys, cells)
        np.subtract.at(count, at, np.concatenate([sign, sign, sign]))
        np.bitwise_xor.at(xored, np.concatenate([at, at + cells]), np.concatenate([keys, keys, keys, *[check(keys)] * 3]))
    if count.any() or xored.any():
        return None
    none = [np.zeros(0, np.uint64)]
    return np.concatenate(plus or none), np.concatenate(minus or none)


class Paragraphs:
    """Digests of a text, their weight, and the first sketch."""

    __slots__ = ("keys", "weight", "first")

    def __init__(self, text: str) -> None:
        self.keys = digests(text)
        self.weight, self.first = weight(self.keys), sketch(self.keys, CELLS)


def difference(a: Paragraphs, b: Paragraphs) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph digests of a alone and of b alone.

    If the first sketches don't peel, larger ones are made: of twice as many cells
    as there are digests, then larger. After ``TRIES``, or where that would take
    more than ``MOST_CELLS``, the digests themselves are compared.
    """
    got, cells = peel(a.first, b.first), 6 * (-(-(len(a.keys) + len(b.keys)) // 3))
    for _ in range(TRIES):
        if got is not None or cells > MOST_CELLS:
            break
        got, cells = peel(sketch(a.keys, cells), sketch(b.keys, cells)), cells * GROWTH
    return (np.setdiff1d(a.keys, b.keys), np.setdiff1d(b.keys, a.keys)) if got is None else got


def likeness(a: Paragraphs, b: Paragraphs) -> float:
    only_a, only_b = map(weight, difference(a, b))
    total = a.weight + b.weight
    shared = (total - only_a - only_b) / 2
    return shared / (shared + only_a + only_b) if total else 1.0


def fingerprint(p: Paragraphs) -> str:
    """The first sketch, with the number of paragraphs and their length."""
    count, xored = p.first
    raw = count.astype("<i4").tobytes() + xored[:CELLS].astype("<u8").tobytes() + xored[CELLS:].astype("<u4").tobytes()
    return f"{len(p.keys)}.{p.weight}.{base64.b64encode(raw).decode()}"


def edited(text: str, after: str) -> str:
    """The last quarter replaced by the beginning of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + after[:k]


NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def cuts_of(base: DataFrame, parts: int) -> tuple[np.ndarray, np.ndarray, tuple[int, int] | None]:
    """Ids and text hashes at which parts begin, and those of the first row. Each number of them is that of parts at most.

    A cut within an id that fills several quantiles is at a hash that a row has.
    """
    lowest = -(1 << 63)
    found = base.agg(F.percentile_approx("__k", F.array(*[F.lit(i / parts) for i in range(parts)]), F.lit(100 * parts)).alias("q"), F.min("__k").alias("first")).first()
    if found["first"] is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), None
    ids, often = np.unique(np.array(found["q"], np.int64), return_counts=True)
    hot = {int(k): int(n) for k, n in zip(ids, often, strict=True) if n > 1}
    cuts = [(int(k), lowest) for k in ids if int(k) not in hot]
    if hot:
        shares = F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair])
        piece = F.floor((F.shiftrightunsigned("__h", 32) / F.lit(float(1 << 32))) * F.element_at(shares, F.col("__k")))
        # The hash orders as an unsigned number here.
        heads = base.filter(F.col("__k").isin(list(hot))).groupBy("__k", piece.alias("piece")).agg(F.min("__u").alias("u")).collect()
        cuts += [(r["__k"], r["u"]) for r in heads]
    cuts = sorted({*cuts})
    first = (found["first"], next((u for k, u in cuts if k == found["first"]), lowest))
    cuts = [c for c in cuts if c > first]
    return np.array([k for k, _ in cuts], np.int64), np.array([u for _, u in cuts], np.int64), first


def fingerprints(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Fingerprints of each text and its edited text, and likeness to that and to the next text by ``key`` (a number)."""
    spark = df.sparkSession
    kind = dict(df.dtypes)[key]
    base = df.select(F.col(key).alias("__id"), F.coalesce(F.col(key).cast("long"), F.lit((1 << 63) - 1)).alias("__k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    # __u orders as a signed number as __h does as an unsigned one.
    base = base.withColumn("__h", F.xxhash64("__text")).withColumn("__u", F.col("__h").bitwiseXOR(F.lit(-(1 << 63))))
    cut_k, cut_u, first = cuts_of(base, PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    last = len(cut_k)
    first_k, first_u = first or (0, 0)
    lowest = -(1 << 63)

    @F.pandas_udf("array<struct<part:int,look:int>>")
    def dealt(k: pd.Series, u: pd.Series) -> pd.Series:
        k, u = k.to_numpy(), u.to_numpy()
        low, at = np.searchsorted(cut_k, k, side="left"), np.searchsorted(cut_k, k, side="right")
        for i in np.flatnonzero(at - low > 1):
            at[i] = low[i] + np.searchsorted(cut_u[low[i] : at[i]], u[i], side="right")
        single = (at - low == 1) & (low < last)
        if last:
            own = np.minimum(low, last - 1)
            at = np.where(single & (cut_u[own] > u), low, at)
        out = [[{"part": int(p), "look": 0}] for p in at]
        if last:
            before = np.maximum(at - 1, 0)
            for i in np.flatnonzero((at > 0) & (cut_k[before] == k) & ((cut_u[before] == u) | (cut_u[before] == lowest))):
                out[i].append({"part": int(at[i]) - 1, "look": 1})
        for i in np.flatnonzero((k == first_k) & ((u == first_u) | (first_u == lowest))):
            out[i].append({"part": last, "look": 1})
        return pd.Series(out)

    rows = base.withColumn("__to", F.explode(dealt("__k", "__u"))).select(F.col("__to.part").alias("part"), F.col("__to.look").alias("look"), "__k", "__u", "__text", "__id")
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part").sortWithinPartitions("part", "look", "__k", "__u", "__text")
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, types = None, [], None

        def pair(a: tuple, text: str, after: Paragraphs) -> tuple:
            changed = edited(a[1], text)
            new = Paragraphs(changed)
            return (a[2], len(a[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(a[3]), fingerprint(new), likeness(a[3], new), likeness(a[3], after))

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), [types, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()], strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(arrays, names=[key, *NAMES])

        for batch in batches:
            types = batch.schema.field(5).type
            for i in range(batch.num_rows):
                part, look, text, id_ = (batch.column(j)[i].as_py() for j in (0, 1, 4, 5))
                own = Paragraphs(text)
                if held is not None:
                    out.append(pair(held, text, own))
                # A row that only looks ahead closes its part; others of its kind follow it at most.
                held = None if look else (part, text, id_, own)
                if len(out) >= 512:
                    yield flush()
        if out:
            yield flush()

    return ordered.mapInArrow(run, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {"op5_fingerprints": op5_fingerprints}
