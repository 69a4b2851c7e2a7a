"""Operator 6, near-duplicate groups by an LSH forest.

1. Every text becomes its set of word shingles (64-bit hashes), a digest of the
   set and a MinHash signature of ``VALUES`` values. Equal sets are one class
   from here on, however many copies there are.
2. Each of ``TREES`` trees orders the classes by values of its own. A region is
   a run with a common prefix of ``LEAST_DEPTH`` values. A region of up to
   ``REGION`` classes is compared whole. Classes of a larger one are sorted by
   ``ORDERS`` whole signature orders and meet their ``SPAN`` nearest on either
   side, which are those of the longest common prefix: the depth adapts to how
   dense a region is, and neighbours are never cut off at a block's edge.
   Those whose signatures agree often enough are candidates; only a spanning
   forest of these leaves a region or window.
3. Connected components of the candidates (large-star, small-star) hold every
   group together. Each class's whole text goes once to its component's task,
   where links are confirmed on full sets. A component too large for a task is
   dealt over chunks that share pivots; where that leaves several groups, what
   isn't in the largest meets its neighbours of the signature orders with their
   texts.
4. What neighbours can have missed is found exactly: classes of dense regions
   and of large components that are in different groups meet by the rarest
   shingles of their sets, of which two similar ones share one.
5. Groups of linked classes get the smallest id.

At a similarity of 0.85 a pair shares a region of at least one of 16 trees with
a probability of 0.999993, and the signature test (0.76 of 256 values) misses it
with one of 3e-5. Of a region of more than ``REGION`` classes, and of a component
too large for a task, every link is found.

Defined results: a text without words (or null) has an empty set and stands
alone; rows with equal sets are linked whatever their ids; a null id never is
the smallest of a group that has another id; very long texts are whole sets, and
a component's task is bounded by shingles as well as by classes; an empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orograph.llm.common import checkpointed, holds, map_rows, table

TREES, DEPTH, LEAST_DEPTH, VALUES = 16, 16, 4, 256
#: Share of signature values that candidates have in common; classes of a region that is compared whole; signature orders of larger ones, and neighbours on either side.
ESTIMATE, REGION, ORDERS, SPAN = 0.76, 512, 32, 256
#: Classes and shingles of a component before it is dealt over chunks; pivots of such a component; neighbours that meet with their texts; rounds of components.
GROUP, GROUP_SHINGLES, PIVOTS, TEXT_SPAN, ROUNDS = 2000, 4_000_000, 4, 256, 60
CACHE_BYTES = 8_000_000
#: Links that a task of ``components`` takes: few links in many tasks would be thousands of small files.
LINKS = 50_000
#: Bits of a set's parities; buckets of shingles whose classes are counted.
BITS, BUCKETS = 2048, 1 << 21
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Rule:
    """Shingle length, and the similarity as a ratio of whole numbers."""

    words: int = 5
    numerator: int = 85
    denominator: int = 100


class WordHashes(dict):
    """A bounded cache of 64-bit hashes of words."""

    held = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self.held += 150 + len(word)
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = WordHashes()


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of k-word shingles; of the whole sequence if it has fewer words."""
    holds("near_dup", _hashes.clear)
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([_hashes[w] for w in words], np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.full(n, min(k, len(h)), np.uint64)
    for i in range(min(k, len(h))):
        out = (out ^ (out >> np.uint64(29))) * MIX + h[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, VALUES, dtype=np.uint64).astype(np.uint32)


_MUL, _ADD = _coefficients()


def signature(s: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits."""
    low, high = (s & np.uint64(0xFFFFFFFF)).astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    best = np.full(VALUES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(s), 1024):
        x = low[at : at + 1024, None] * _MUL + (high[at : at + 1024, None] ^ _ADD)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(best, x.min(0), out=best)
    # The minimum is small; mixed, its low bits tell values apart.
    best ^= best >> np.uint32(12)
    best *= np.uint32(0x297A2D39)
    return (best >> np.uint32(16)).astype(np.uint16)


def _orders() -> np.ndarray:
    """Orders of the values: each tree's own come first in its order; the orders beyond the trees are drawn."""
    rng = np.random.default_rng(21)
    return np.array([np.roll(np.arange(VALUES), -DEPTH * t) if t < TREES else rng.permutation(VALUES) for t in range(ORDERS)])


_ORDERS = _orders()


def signed(df: DataFrame, keys: list[str], text: str, rule: Rule) -> DataFrame:
    """Keys, n_shingles, digest of the set, a long a tree that holds its first four values, and the low bytes of all values."""

    def kernel(texts: list[str | None]) -> list[tuple]:
        out = []
        for t in texts:
            s = shingles(t, rule.words)
            if not len(s):
                out.append((0, None, None, None))
                continue
            values = signature(s)
            first = values.reshape(TREES, DEPTH)[:, :LEAST_DEPTH].astype(np.uint64)
            packed = (first << np.array([48, 32, 16, 0], np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
            out.append((len(s), digest(s), packed.tolist(), values.astype(np.uint8).tobytes()))
        return out

    return map_rows(df, kernel, keys, text, "n_shingles long, cls binary, tops array<long>, low binary")


def _values(low: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(low), np.uint8).reshape(len(low), VALUES)


def region_forest(ids: list[bytes], values: np.ndarray) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the pairs of a region whose signatures agree enough."""
    n, need = len(ids), ESTIMATE * values.shape[1]
    if n == 2:
        return [(ids[0], ids[1])] if (values[0] == values[1]).sum() >= need else []
    edges, left = [], np.arange(n)
    # Breadth-first: all that agree with a reached row join it, and are not looked at again.
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = (values[left] == values[x]).sum(1) >= need
            for y in left[near]:
                edges.append((ids[x], ids[y]))
                queue.append(y)
            left = left[~near]
    return edges


def pairs_batch(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    """Pairs of unlike classes, the smaller one first."""
    pairs = [p for p in pairs if p[0] != p[1]]
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], names=["a", "b"])


def forests(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate links (a, b) of groups by ``keys``, whose rows (keys, cls, low) are few enough for a task."""
    grouped = rows.select(F.struct(*keys).alias("part"), "cls", "low").repartition("part").sortWithinPartitions("part", "cls")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lows, out = None, [], [], []
        for batch in batches:
            for part, cls, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if len(ids) > 1:
                        out += region_forest(ids, _values(lows))
                    now, ids, lows = part, [], []
                ids.append(cls)
                lows.append(low)
            if out:
                yield pairs_batch(out)
                out.clear()
        if len(ids) > 1:
            yield pairs_batch(region_forest(ids, _values(lows)))

    return grouped.mapInArrow(run, "a binary, b binary")


def windows(classes: DataFrame, span: int) -> DataFrame:
    """Rows of ``classes`` (cls, low and others) with (block, look), in all signature orders.

    Places are counted over the sorted whole, so two classes at most ``span``
    places apart in an order share a block: each is a member of its own (look 0)
    and looks at the next (look 1).
    """

    def sorting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values = _values(part.column(1).to_pylist())
                keys = [bytes(k) for order in _ORDERS for k in values[:, order[:32]]]
                order = np.repeat(np.arange(ORDERS, dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(keys, pa.binary()), pa.array(part.column(0).to_pylist() * ORDERS, pa.binary())], names=["order", "key", "cls"])

    keyed = classes.select("cls", "low").mapInArrow(sorting, "order int, key binary, cls binary")
    # The place within a partition is read from the row's number, so it must be written before it is used.
    placed = checkpointed(keyed.repartitionByRange("order", "key", "cls").sortWithinPartitions("order", "key", "cls").select("cls", F.monotonically_increasing_id().alias("number")))
    numbered = placed.select("cls", F.shiftright("number", 33).alias("slice"), F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    # A row a partition of the sorted whole.
    before = numbered.groupBy("slice").agg(F.count(F.lit(1)).alias("n")).select("slice", F.coalesce(F.sum("n").over(W.orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    blocks = numbered.join(before, "slice").select("cls", F.floor((F.col("before") + F.col("at")) / F.lit(span)).alias("own"))
    # Signatures join a place each; only then does a place go to two blocks.
    return blocks.join(classes, "cls").select(*classes.columns, F.posexplode(F.array(F.col("own"), F.col("own") + 1)).alias("look", "block"))


def regions(classes: DataFrame) -> DataFrame:
    """Classes (cls) by region (tree, hi) with its number of classes n, of two or more."""
    keyed = classes.select("cls", F.posexplode("tops").alias("tree", "hi"))
    sizes = keyed.groupBy("tree", "hi").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return checkpointed(keyed.join(sizes, ["tree", "hi"]))


def candidates(classes: DataFrame, met: DataFrame) -> DataFrame:
    """Candidate links (a, b) between classes, as many as a region or window has members at most. ``met``: as ``regions`` gives them."""
    lows = classes.select("cls", "low")
    links = forests(met.filter(F.col("n") <= REGION).join(lows, "cls"), ["tree", "hi"])
    dense = met.filter(F.col("n") > REGION).select("cls").distinct()
    if dense.limit(1).count():
        some = checkpointed(dense.join(lows, "cls"))
        links = links.unionByName(forests(windows(some, SPAN), ["block"]))
    return links.distinct()


def components(links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(cls, root) of every class in a link: alternating large-star and small-star steps, written to the checkpoint folder each round.

    A hub's neighbours are never gathered: each step needs the smallest
    neighbour of a node only, which tasks sum before the shuffle. Steps end when
    every link leads to a root; what isn't done after ``rounds`` is an error.
    """
    links = checkpointed(links)
    last, n = None, links.count()
    for _ in range(rounds):
        few = lambda df, tasks=max(1, -(-n // LINKS)): df.coalesce(tasks)
        links = few(links)
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).filter("x != y")
        large = few(few(large).distinct())
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x").select(F.explode(F.array(F.struct(F.col("x").alias("b"), F.col("m").alias("a")), F.struct(F.col("y").alias("b"), F.col("m").alias("a")))).alias("e")).select("e.a", "e.b").filter("a != b")
        links = checkpointed(few(few(small).distinct()))
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == last or not state[0]:
            break
        last, n = state, state[0]
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    roots = links.groupBy("b").agg(F.min("a").alias("root")).select(F.col("b").alias("cls"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("cls"), "root").distinct())


def linked(a: np.ndarray, b: np.ndarray, rule: Rule) -> bool:
    """Whether two sorted sets are similar enough."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if rule.denominator * len(small) < rule.numerator * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return rule.denominator * both >= rule.numerator * (len(a) + len(b) - both)


class Groups:
    """Union-find over numbers."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = sorted((self.root(x), self.root(y)))
        self.up[y] = x


def exact_groups(sets: list[np.ndarray], rule: Rule, groups: Groups) -> None:
    """Join every linked pair; pairs already together are passed over. Sorted by size, a set meets only those of a size within the similarity."""
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    ends = np.searchsorted(sizes, rule.denominator * sizes // rule.numerator, side="right")
    for i, x in enumerate(order):
        for y in order[i + 1 : ends[i]]:
            if groups.root(x) != groups.root(y) and linked(sets[x], sets[y], rule):
                groups.join(x, y)


def confirmed(texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that full sets confirm, at most one fewer than the rows of a part. ``texts``: part, cls, text; a part's rows are all compared."""

    def close(ids: list[bytes], sets: list[np.ndarray]) -> pa.RecordBatch:
        groups = Groups(len(ids))
        exact_groups(sets, rule, groups)
        return pairs_batch([(ids[groups.root(i)], ids[i]) for i in range(len(ids)) if groups.root(i) != i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets = None, [], []
        for batch in batches:
            for part, cls, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != now:
                    if len(ids) > 1:
                        yield close(ids, sets)
                    now, ids, sets = part, [], []
                found = shingles(text, rule.words)
                if digest(found) != cls or ids and ids[-1] == cls:
                    continue  # a repeated row, or another text with the same row hash
                ids.append(cls)
                sets.append(found)
        if len(ids) > 1:
            yield close(ids, sets)

    rows = texts.select("part", "cls", "text").repartition("part").sortWithinPartitions("part", "cls")
    return rows.mapInArrow(run, "a binary, b binary")


def neighbour_links(texts: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that full sets confirm between an open class and the classes of its window. ``texts``: block, cls, low, open, text."""

    def close(ids: list[bytes], lows: list[bytes], opened: list[bool], sets: list[np.ndarray]) -> pa.RecordBatch:
        groups, values, need = Groups(len(ids)), _values(lows), ESTIMATE * VALUES
        for x in np.flatnonzero(opened):
            for y in np.flatnonzero((values == values[x]).sum(1) >= need):
                if groups.root(x) != groups.root(y) and linked(sets[x], sets[y], rule):
                    groups.join(int(x), int(y))
        return pairs_batch([(ids[groups.root(i)], ids[i]) for i in range(len(ids)) if groups.root(i) != i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, ([], [], [], [])
        for batch in batches:
            for block, cls, low, opened, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != now:
                    if len(held[0]) > 1:
                        yield close(*held)
                    now, held = block, ([], [], [], [])
                found = shingles(text, rule.words)
                if digest(found) != cls or held[0] and held[0][-1] == cls:
                    continue
                for column, value in zip(held, (cls, low, opened, found), strict=True):
                    column.append(value)
        if len(held[0]) > 1:
            yield close(*held)

    rows = texts.select("block", "cls", "low", "open", "text").repartition("block").sortWithinPartitions("block", "cls")
    return rows.mapInArrow(run, "a binary, b binary")


def large_links(rows: DataFrame, rule: Rule) -> DataFrame:
    """Confirmed links within components that are too large for a task. ``rows``: cls, low, root, chunks, chunk, text.

    First each chunk with the component's pivots. What isn't in the largest
    group found so is open: it then meets its neighbours of all signature
    orders. Two classes of the largest group are together already.
    """
    rows = checkpointed(rows)
    pivots = rows.withColumn("r", F.row_number().over(W.partitionBy("root").orderBy("cls"))).filter(F.col("r") <= PIVOTS)
    sent = pivots.select("root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("to"), "chunk", "cls", "text").filter("to != chunk")
    members = rows.select(F.struct("root", "chunk").alias("part"), "cls", "text").unionByName(sent.select(F.struct("root", F.col("to").alias("chunk")).alias("part"), "cls", "text"))
    first = checkpointed(confirmed(members, rule))
    inside = rows.select("cls", "root").distinct().join(components(first).select("cls", F.col("root").alias("group")), "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    sizes = inside.groupBy("root", "group").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("root").agg(F.max(F.struct("size", "group"))["group"].alias("main"))
    judged = checkpointed(inside.join(main, "root").select("root", "cls", (F.col("group") != F.col("main")).alias("open")))
    split = judged.filter("open").select("root").distinct()
    if not split.limit(1).count():
        return first
    left = checkpointed(rows.dropDuplicates(["cls"]).select("cls", "low").join(judged.join(split, "root", "left_semi").select("cls", "open"), "cls"))
    near = windows(left, TEXT_SPAN)
    used = checkpointed(near.groupBy("block").agg(F.max("open").alias("some")).filter("some").select("block"))
    texts = near.join(used, "block", "left_semi").join(rows.select("cls", "text"), "cls")
    return first.unionByName(neighbour_links(texts, rule))


def parity(s: np.ndarray) -> bytes:
    """BITS bits: whether a set has an odd number of shingles of each remainder. Two of them differ in as many bits as the sets in shingles, at most."""
    return np.packbits((np.bincount((s % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def near_pairs(tiles: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (a, b) of classes of different groups whose sizes and parities allow a link. ``tiles``: tile (with i and j), side, cls, group, n, bits; a tile holds two blocks."""

    def close(own: bool, rows: list[tuple]) -> pa.RecordBatch:
        side, ids, groups, n = (np.array([r[k] for r in rows], object if k in (1, 2) else np.int64) for k in range(4))
        bits = np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(len(rows), -1)
        pairs = []
        # One of two that differ is outside the largest group.
        names, group = np.unique(groups, return_inverse=True)
        for x in np.flatnonzero(group != np.bincount(group, minlength=len(names)).argmax()):
            y = np.flatnonzero((group != group[x]) & (own | (side != side[x])))
            y = y[(rule.denominator * np.minimum(n[y], n[x]) >= rule.numerator * np.maximum(n[y], n[x]))]
            apart = np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64)
            y = y[(rule.denominator + rule.numerator) * apart <= (rule.denominator - rule.numerator) * (n[y] + n[x])]
            pairs += [(ids[x], ids[z]) for z in y]
        return pairs_batch(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for tile, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tile != now:
                    if len(rows) > 1:
                        yield close(now["i"] == now["j"], rows)
                    now, rows = tile, []
                rows.append(row)
        if len(rows) > 1:
            yield close(now["i"] == now["j"], rows)

    dealt = tiles.select("tile", "side", "cls", "group", "n", "bits").repartition("tile").sortWithinPartitions("tile", "side", "cls")
    return dealt.mapInArrow(run, "a binary, b binary")


def weights(sets: DataFrame) -> np.ndarray:
    """How many classes hold the shingles of each of BUCKETS buckets, in eighths of powers of two; 0 where all of them are in one group. ``sets``: group, s.

    A fixed size, whatever the corpus: Spark sums a bucket's row, of which there are BUCKETS at most.
    """
    each = sets.select("group", F.explode("s").alias("x")).select("group", F.col("x").bitwiseAND(F.lit(BUCKETS - 1)).cast("int").alias("bucket"))
    counts = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"), F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi")
    found = counts.select("bucket", F.least(F.floor(F.log2("held") * 8), F.lit(255)).cast("short").alias("weight")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[found.column("bucket").to_numpy()] = found.column("weight").to_numpy()
    return out


def prefixes(sets: DataFrame, held: np.ndarray, rule: Rule) -> DataFrame:
    """Of each class (cls, group, n, s) the shingles x by which it meets others: among the first of its set, those of the least weight first, without those of one group."""
    sent = sets.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, kept = [], []
            for i, s in enumerate(batch.column("s")):
                x = s.values.to_numpy(zero_copy_only=False)
                weight = sent.value[x & (BUCKETS - 1)]
                first = np.lexsort((x, weight))[: len(x) - -(-len(x) * rule.numerator // rule.denominator) + 1]
                kept.append(x[first[weight[first] > 0]])
                at.append(np.full(len(kept[-1]), i))
            if kept:
                rows = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept))] + [batch.column(c).take(rows) for c in ("cls", "group", "n")], names=["x", "cls", "group", "n"])

    return sets.select("cls", "group", "n", "s").mapInArrow(run, "x long, cls binary, group binary, n long")


def rest_links(texts: DataFrame, rule: Rule) -> DataFrame:
    """Every link (a, b) between classes of different groups that full sets confirm. ``texts``: cls, group, text.

    Exact: sets that are similar enough share one of their first n - ceil(n * similarity) + 1
    shingles in any common order, here by the weight of their bucket, the rarest first. Those that one
    group alone has need no meeting; the classes of another one meet in tiles of two blocks of ``REGION`` at most.
    """

    def kernel(rows: list[str | None]) -> list[tuple]:
        found = [shingles(t, rule.words) for t in rows]
        return [(digest(s), parity(s), s.view(np.int64).tolist()) for s in found]

    made = map_rows(texts, kernel, ["cls", "group"], "text", "found binary, bits binary, s array<long>")
    sets = checkpointed(made.filter("found = cls").drop("found").withColumn("n", F.size("s").cast("long")).dropDuplicates(["cls"]))
    prefix = checkpointed(prefixes(sets, weights(sets), rule))
    mixed = prefix.groupBy("x").agg(F.ceil(F.count(F.lit(1)) / REGION).alias("blocks"), F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("x", "blocks")
    rows = prefix.join(mixed, "x").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks"))).join(sets.select("cls", "bits"), "cls")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.struct("x", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    pairs = near_pairs(rows.select(tile.alias("tile"), (F.col("block") > F.col("other")).cast("long").alias("side"), "cls", "group", "n", "bits"), rule).distinct()
    of = lambda name: sets.select(F.col("cls").alias(name), F.col("s").alias(f"s_{name}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("both", F.size(F.array_intersect("s_a", "s_b")))
    return both.filter(rule.denominator * F.col("both") >= rule.numerator * (F.size("s_a") + F.size("s_b") - F.col("both"))).select("a", "b")


def near_dup(df: DataFrame, key: str, text: str = "text", rule: Rule | None = None) -> DataFrame:
    """key, n_shingles, component_id and kept of every row."""
    rule = rule or Rule()
    base = df.select(F.col(key).alias("__id"), F.col(text).cast("string").alias("__text")).withColumn("__row", F.xxhash64("__id", "__text"))
    rows = checkpointed(signed(base, ["__id", "__row"], "__text", rule))
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "tops", "low")]
    classes = checkpointed(rows.filter("cls is not null").groupBy("cls").agg(F.min("__id").alias("id"), F.min("__row").alias("__row"), *firsts))
    met = regions(classes)
    likely = components(candidates(classes, met)).join(classes.select("cls", "__row", "n_shingles"), "cls")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n_shingles") / GROUP_SHINGLES)).cast("long")
    sizes = likely.groupBy("root").agg(chunks.alias("chunks"))
    placed = checkpointed(likely.join(sizes, "root").select("cls", "root", "__row", "chunks", F.pmod(F.xxhash64("cls"), F.col("chunks")).alias("chunk")))
    whole = base.select("__row", F.col("__text").alias("text")).join(placed, "__row")
    links = confirmed(whole.filter("chunks = 1").select(F.col("root").alias("part"), "cls", "text"), rule)
    if placed.filter("chunks > 1").limit(1).count():
        large = whole.filter("chunks > 1").join(classes.select("cls", "low"), "cls")
        links = links.unionByName(large_links(large.select("cls", "low", "root", "chunks", "chunk", "text"), rule))
    joined = components(links)
    # What neighbours can have missed: between groups of dense regions and of large components.
    hard = checkpointed(met.filter(F.col("n") > REGION).select("cls").unionByName(placed.filter("chunks > 1").select("cls")).distinct())
    if hard.limit(1).count():
        grouped = hard.join(joined.select("cls", F.col("root").alias("group")), "cls", "left").join(classes.select("cls", "__row"), "cls")
        grouped = grouped.select("cls", "__row", F.coalesce("group", "cls").alias("group"))
        rest = checkpointed(rest_links(base.select("__row", F.col("__text").alias("text")).join(grouped, "__row"), rule))
        if rest.limit(1).count():
            joined = components(joined.filter("cls != root").select(F.col("root").alias("a"), F.col("cls").alias("b")).unionByName(rest))
    named = joined.join(classes.select("cls", "id"), "cls")
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    lookup = named.join(least, "root").select("cls", "component_id")
    # Written, so that the last join deals both sides anew and can split a class that holds many rows.
    every = checkpointed(classes.select("cls", "id").join(lookup, "cls", "left").select("cls", F.coalesce("component_id", "id").alias("component_id")))
    out = rows.select("__id", "n_shingles", "cls").join(every, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("__id")).otherwise(F.col("component_id"))
    return out.select(F.col("__id").alias(key), "n_shingles", component.alias("component_id"), F.col("__id").eqNullSafe(component).alias("kept"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup(table(spark, sf_dir, "documents"), "doc_id")


QUERIES = {"op6_near_dup": op6_near_dup}
