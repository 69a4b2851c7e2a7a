"""Operator 3, byte-level BPE encoding and decoding.

Pre-tokenisation without a regex: code points become classes by one table
lookup; a finite automaton over the classes finds where tokens start. A
character is a function from state to state, functions compose associatively,
so a batch is scanned in blocks: compose each block's function, combine the
blocks by a doubling scan, then replay all blocks at once from known states.
The slices feed pair merging through a bounded cache; their offsets stay with
the ids, so that any span of ids can be traced to the text.

Defined results: a null text encodes as an empty one (no ids, the hash of
nothing); repeated rows give equal rows; other columns are not read. Memory:
one slice of a batch (a few MB) or one document if that is larger.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from orograph.llm.common import holds, map_rows, table

RANKS = "byte_bpe_50k.tiktoken"
#: Bytes of pieces and their ids in a worker's cache before it starts anew.
CACHE_BYTES = 40_000_000
BLOCK = 256

# Classes of code points; ends of runs and contractions are told apart by what follows.
LETTER, NUMBER, OTHER, SPACES, JOINER, LONE, SHORT, LONG, RESET = range(9)
# States: what the token that holds the last character can take next.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, JOINED, ONE_LEFT, TWO_LEFT = range(8)
#: White_Space of Unicode.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: LETTER, NUMBER, SPACES or OTHER."""
    import regex

    points = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, points):
            a, b = m.span()
            out[[ord(c) for c in points[a:b]]] = kind
    out[WHITE] = SPACES
    return out


@lru_cache(1)
def machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts) by class and state."""
    go = np.zeros((9, 8), np.uint8)
    starts = np.ones((9, 8), bool)

    def runs(kind: int, state: int, into: int | None = None) -> None:
        """A run goes on within its own state or after a joined space; else a token starts."""
        go[kind] = state if into is None else into
        for s in (state, JOINED):
            go[kind, s], starts[kind, s] = state, False

    runs(LETTER, IN_LETTERS)
    runs(NUMBER, IN_NUMBERS)
    runs(OTHER, IN_OTHERS)
    runs(SHORT, IN_OTHERS, ONE_LEFT)
    runs(LONG, IN_OTHERS, TWO_LEFT)
    go[LETTER, [ONE_LEFT, TWO_LEFT]] = FRESH, ONE_LEFT
    starts[LETTER, [ONE_LEFT, TWO_LEFT]] = False
    go[SPACES], starts[SPACES, IN_SPACES] = IN_SPACES, False
    go[JOINER], go[LONE], go[RESET] = JOINED, FRESH, FRESH
    return go, starts


def refine(points: np.ndarray, resets: np.ndarray) -> np.ndarray:
    """Classes with what follows told apart."""
    kind = classes()[points]
    kind[resets] = RESET
    after = np.append(kind[1:], RESET)
    ends = (kind == SPACES) & (after != SPACES) & (after != RESET)
    out = kind.copy()
    out[ends] = np.where(points[ends] == 32, JOINER, LONE)
    quotes = np.flatnonzero((points == 39) & (after == LETTER))
    if len(quotes):
        one = points[quotes + 1]
        two = points[np.minimum(quotes + 2, len(points) - 1)]
        out[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        out[quotes[pair & (quotes + 2 < len(points))]] = LONG
    return out


def token_starts(kind: np.ndarray) -> np.ndarray:
    """Where tokens start (a RESET counts as one), by a scan over blocks of transition functions."""
    go, starts = machine()
    n = len(kind)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, RESET, np.uint8)
    padded[:n] = kind
    columns = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp) * 8
    flat = go.ravel().astype(np.intp)
    # The function of each block, composed character by character for all blocks at once.
    f = np.tile(np.arange(8, dtype=np.intp), (blocks, 1))
    for c in columns:
        f = flat[c[:, None] + f]
    # Inclusive scan of the compositions by doubling.
    step = 1
    while step < blocks:
        g = f.copy()
        g[step:] = np.take_along_axis(f[step:], f[:-step], axis=1)
        f, step = g, step * 2
    state = np.concatenate([[FRESH], f[:-1, FRESH]]).astype(np.intp)
    out = np.empty((BLOCK, blocks), bool)
    begin = starts.ravel()
    for j, c in enumerate(columns):
        at = c + state
        out[j] = begin[at]
        state = flat[at]
    return np.flatnonzero(out.T.ravel()[:n])


class Encoder:
    """Ranks, their bytes, and a bounded cache of merged pieces."""

    def __init__(self, path: str) -> None:
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self._pair_table()
        self.cache: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.held = 0

    def _pair_table(self) -> None:
        """Rank of two adjacent tokens' concatenation: hash tables over a * 2**20 + b, a later one for what collides in those before."""
        keys, values = [], []
        ranks = self.ranks
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (x := ranks.get(token[:i])) is not None and (y := ranks.get(token[i:])) is not None:
                    keys.append(x << 20 | y)
                    values.append(rank)
        left, ranked = np.array(keys, np.uint64), np.array(values, np.int32)
        self.levels, seed = [], 0x9E3779B97F4A7C15
        while len(left):
            bits = max(4, int(len(left)).bit_length() + 1)
            slot = ((left * np.uint64(seed)) >> np.uint64(64 - bits)).astype(np.intp)
            _, first = np.unique(slot, return_index=True)
            key, value = np.full(1 << bits, (1 << 64) - 1, np.uint64), np.full(1 << bits, _NONE, np.int32)
            key[slot[first]], value[slot[first]] = left[first], ranked[first]
            self.levels.append((np.uint64(seed), np.uint64(64 - bits), key, value))
            rest = np.ones(len(left), bool)
            rest[first] = False
            left, ranked, seed = left[rest], ranked[rest], (seed * 0xD1342543DE82EF95 + 2) % (1 << 64) | 1

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(20)) | right.astype(np.uint64)
        out = np.full(keys.shape, _NONE, np.int32)
        for seed, shift, key, value in self.levels:
            slot = ((keys * seed) >> shift).astype(np.intp)
            out = np.where(key[slot] == keys, value[slot], out)
        return out

    def merge_many(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece: the pair of the lowest rank is merged first, leftmost on ties. A round merges one pair in each piece of a group of like length."""
        out: list[tuple[int, ...] | None] = [None if (whole := self.ranks.get(p)) is None else (whole,) for p in pieces]
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if out[k] is None:
                if len(p) > 64:
                    out[k] = self._merge_long(p)
                else:
                    groups.setdefault(-(-len(p) // 4) * 4, []).append(k)
        for width, members in groups.items():
            raw = np.frombuffer(b"".join([pieces[k].ljust(width, b"\0") for k in members]), np.uint8).reshape(-1, width)
            size = np.array([len(pieces[k]) for k in members])
            ids = np.append(self.bytes[raw], np.zeros((len(members), 1), np.int32), axis=1)
            ranks = np.full((len(members), width), _NONE, np.int32)
            ranks[:, : width - 1] = self.pair_ranks(ids[:, : width - 1], ids[:, 1:width])
            at = np.arange(width)
            ranks[at[None, :] >= size[:, None] - 1] = _NONE
            live = np.arange(len(members))
            while len(live):
                r, i = ranks[live], ids[live]
                where = r.argmin(1)
                best = r[np.arange(len(live)), where]
                going = best < _NONE
                live, r, i, where, best = live[going], r[going], i[going], where[going], best[going]
                if not len(live):
                    break
                row, after = np.arange(len(live)), at[None, :] > where[:, None]
                i = np.append(np.where(after, i[:, 1:], i[:, :-1]), i[:, -1:], axis=1)
                i[row, where] = best
                r = np.append(np.where(after[:, :-1], r[:, 1:], r[:, :-1]), r[:, -1:], axis=1)
                size[live] -= 1
                n = size[live]
                r[row, where] = np.where(where < n - 1, self.pair_ranks(i[row, where], i[row, where + 1]), _NONE)
                prior = np.maximum(where - 1, 0)
                r[row, prior] = np.where(where > 0, self.pair_ranks(i[row, prior], i[row, prior + 1]), r[row, prior])
                ids[live], ranks[live] = i, r
            for k, x, n in zip(members, ids.tolist(), size.tolist(), strict=True):
                out[k] = tuple(x[:n])
        return out

    def _merge_long(self, piece: bytes) -> tuple[int, ...]:
        """As merge, with a heap over linked parts: n log n for pieces of any length."""
        ranks, n = self.ranks, len(piece)
        end, prev, after, alive = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

        def rank(i: int) -> int | None:
            return ranks.get(piece[i : end[after[i]]]) if after[i] < n else None

        heap = [(r, i, end[i + 1]) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or after[i] >= n or end[after[i]] != stop:
                continue
            j = after[i]
            end[i], after[i], alive[j] = end[j], after[j], False
            if after[j] < n:
                prev[after[j]] = i
            for k in (prev[i], i):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, end[after[k]]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = after[i]
        return tuple(out)

    def learn(self, pieces: set[str]) -> None:
        """Merge pieces and keep them."""
        texts = list(pieces)
        for text, ids in zip(texts, self.merge_many([t.encode() for t in texts]), strict=True):
            self.cache[text] = (" ".join(map(str, ids)), ids)
            self.held += 300 + len(text) + 15 * len(ids)

    def encode(self, texts: list[str | None]) -> list[tuple[list[tuple[str, tuple[int, ...]]], np.ndarray]]:
        """For each text its pieces, (ids as text, ids), and the code points where they start."""
        joined = "\0" + "\0".join([t or "" for t in texts])
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t or "") + 1 for t in texts])
        resets = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.intp)
        at = token_starts(refine(points, resets))
        first = np.searchsorted(at, resets)
        stops, out = np.append(at[1:], len(joined)), []
        words = [joined[i:j] for i, j in zip(at.tolist(), stops.tolist(), strict=True)]
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        unknown = {w for w in set(words) if w not in self.cache}
        if unknown:
            self.learn(unknown)
        known = self.cache
        merged = [known[w] for w in words]
        for k, a in enumerate(first):
            b = first[k + 1] if k + 1 < len(first) else len(at)
            out.append((merged[a + 1 : b], at[a + 1 : b] - resets[k] - 1))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_NONE = (1 << 31) - 1


@lru_cache(4)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of a rank file; by default of the installed vocabulary files."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(RANKS)
    return Encoder(path)


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_bpe(df: DataFrame, keys: list[str], text: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Ids of each whole text with digests of the ids and of the decoded bytes.

    ``path``: the rank file, readable where tasks run. With ``with_ids`` also the
    ids, each piece's start (code points) and its number of ids.
    """

    def kernel(texts: list[str | None]) -> list[tuple]:
        holds("byte_bpe", encoder.cache_clear)
        enc = encoder(path)
        rows = []
        for pieces, at in enc.encode(texts):
            ids = list(chain.from_iterable([p[1] for p in pieces]))
            digest = hashlib.sha256(" ".join([p[0] for p in pieces]).encode()).hexdigest()
            row = (len(ids), digest, hashlib.sha256(enc.decode(ids)).hexdigest())
            rows.append((*row, ids, at.tolist(), [len(p[1]) for p in pieces]) if with_ids else row)
        return rows

    return map_rows(df, kernel, keys, text, DIGESTS + (", ids array<int>, piece_starts array<int>, piece_ids array<int>" if with_ids else ""))


def decoded(df: DataFrame, keys: list[str], ids: str = "ids", path: str | None = None) -> DataFrame:
    """The bytes that lists of ids stand for (null for a null list)."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    def mapped(batches):
        enc = encoder(path)
        for batch in batches:
            n = batch.num_columns - 1
            out = [None if x is None else enc.decode(x) for x in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(out, pa.binary())], names=[*batch.schema.names[:n], "decoded"])

    kept = df.select(*keys, F.col(ids).alias("__ids"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(mapped, f"{schema}, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
