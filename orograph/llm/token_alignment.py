"""Operator 11, alignment of two tokenizers' tokens.

Every byte of a text gets a label: no token ends there, a token of A does, one of
B does, or both do. A regular expression takes spans up to each label "both";
the labels of a span, counted, say how many tokens of either side form a group.

Texts are cut where both tokenizers always start a token: at a space between two
characters that aren't white space (A's pattern starts a token there, and no
piece of B holds a space after another character). Such chunks repeat, so each
distinct one is encoded, labelled and scanned once as long as it is in a bounded
cache; a text without such places is one chunk.

Corpus-wide counts: tokens of a link end together, so the bytes of one are the
end of the other's. There are at most as many such pairs as the vocabularies
have bytes (two for single bytes, about half a million), whatever the corpus. A
link is stored as its number among them, tasks count by number, and the counts,
bounded so, go to all tasks.

Defined results: texts that are null, empty, or that either tokenizer doesn't
give back byte by byte (a literal U+2581, say) have zeros and an empty column;
links of equal counts tie, so all of them are best; repeated rows give equal
rows and count as often as they stand; an empty table gives an empty result;
other columns are not read. Time is in proportion to a text's length, and memory
to a slice of a batch (a few MB) or to one document if that is larger.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orograph.llm.common import holds, map_rows, shared_folder, table

FILES = ("byte_bpe_50k.json", "piece_bpe_32k.model")
#: Bytes of chunks and of what is kept for them, before a worker's cache starts anew; a chunk longer than LONG isn't kept.
CACHE_BYTES, LONG = 160_000_000, 200
#: White space beside space and newline, or B's sign of a space: such texts are cut with care. Where a text may be cut.
RARE = re.compile("[▁\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Labels of bytes, and a span that ends where both tokenizers end a token.
NONE, A_END, B_END, BOTH = range(4)
SPAN = re.compile(rb"[^\x03]*\x03")


class Chunk(NamedTuple):
    """Groups as text, numbers of links as little-endian 32-bit integers, and A's tokens with B's in the high bits; ``groups`` is None where bytes differ."""

    groups: str | None
    links: bytes
    tokens: int


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves, the others come after 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


def link_table(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """Sorted numbers ``a id * len(b) + b id`` of all pairs whose shorter token is the end of the longer one."""
    found = []
    for outer, inner, key in ((a, b, lambda x, y: x * len(b) + y), (b, a, lambda x, y: y * len(b) + x)):
        ids: dict[bytes, list[int]] = {}
        for i, token in enumerate(inner):
            if token:
                ids.setdefault(token, []).append(i)
        for x, token in enumerate(outer):
            for at in range(len(token)):
                found += [key(x, y) for y in ids.get(token[at:], ())]
    return np.unique(np.array(found, np.int64))


class Aligner:
    """Both tokenizers, their tokens' bytes, the table of possible links and the cache of chunks."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        import tiktoken

        symbols = byte_symbols()
        with open(path_a, encoding="utf-8") as file:
            ranks = {bytes(map(symbols.__getitem__, token)): i for token, i in json.load(file)["model"]["vocab"].items()}
        # Ids of this vocabulary are in the order of its merges (a test holds them against the file's own library).
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        model = self.b
        self.bytes_b = [b"" if model.is_control(i) or model.is_unknown(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(t) for t in tokens]) for tokens in (self.bytes_a, self.bytes_b))
        self.table = link_table(self.bytes_a, self.bytes_b)
        n = max(len(self.bytes_a), len(self.bytes_b))
        #: Ids with the sign after them: within a side, between the sides, between groups, after a chunk.
        self.names = np.array([[f"{i}{sign}" for i in range(n)] for sign in (",", "|", ";", "\n")], object)
        self.cache: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.held = 0

    def chunks(self, text: str) -> list[str]:
        plain = not (text[0] == " " or text[-1] == " " or "  " in text or " \n" in text or "\n " in text or RARE.search(text))
        return text.split(" ") if plain else CUT.split(text)

    def align(self, chunks: list[str]) -> list[Chunk]:
        """Each chunk (a space before it is understood) labelled and scanned."""
        ids_a = [self.a.encode_ordinary(" " + c) for c in chunks]
        ids_b = self.b.encode(chunks, num_threads=1)
        whole = [b" " + c.encode() for c in chunks]
        out = [Chunk(None, b"", 0)] * len(chunks)
        size, many_a, many_b, flat_a, flat_b = self._flat(whole, ids_a, ids_b)
        ends = np.cumsum(size)
        if not self._same(whole, ends, many_a, many_b, flat_a, flat_b):
            ok = [k for k, (w, x, y) in enumerate(zip(whole, ids_a, ids_b, strict=True)) if b"".join(map(self.bytes_a.__getitem__, x)) == w == b"".join(map(self.bytes_b.__getitem__, y))]
            for k, found in zip(ok, self.align([chunks[k] for k in ok]) if ok else [], strict=True):
                out[k] = found
            return out
        # One label string for all chunks: each ends in a label "both".
        end_a, end_b = np.cumsum(self.length_a[flat_a]), np.cumsum(self.length_b[flat_b])
        labels = np.zeros(int(ends[-1]), np.uint8)
        labels[end_a - 1] |= A_END
        labels[end_b - 1] |= B_END
        stops = np.array([m.end() for m in SPAN.finditer(labels.tobytes())], np.int64)
        # A span's labels counted: the tokens of either side up to its end.
        count_a, count_b = (np.searchsorted(e, stops, side="right") for e in (end_a, end_b))
        links = np.searchsorted(self.table, flat_a[count_a - 1] * len(self.bytes_b) + flat_b[count_b - 1]).astype("<u4").tobytes()
        last = np.searchsorted(stops, ends, side="right")
        # Groups as text, all chunks at once: A's ids of a group, then B's, each with the sign after it.
        sign_a, sign_b = np.zeros(len(flat_a), np.int64), np.zeros(len(flat_b), np.int64)
        sign_a[count_a - 1], sign_b[count_b - 1] = 1, 2
        sign_b[np.cumsum(many_b) - 1] = 3
        words = np.empty(len(flat_a) + len(flat_b), object)
        words[np.arange(len(flat_a)) + np.repeat(np.append(0, count_b[:-1]), np.diff(count_a, prepend=0))] = self.names[sign_a, flat_a]
        words[np.arange(len(flat_b)) + np.repeat(count_a, np.diff(count_b, prepend=0))] = self.names[sign_b, flat_b]
        texts, at = "".join(words.tolist()).split("\n"), 0
        for k, stop in enumerate((4 * last).tolist()):
            out[k] = Chunk(texts[k], links[at:stop], many_a[k] + (many_b[k] << 40))
            at = stop
        return out

    def _flat(self, whole: list[bytes], ids_a: list[list[int]], ids_b: list[list[int]]) -> tuple:
        return list(map(len, whole)), list(map(len, ids_a)), list(map(len, ids_b)), np.fromiter(chain.from_iterable(ids_a), np.int64), np.fromiter(chain.from_iterable(ids_b), np.int64)

    def _same(self, whole: list[bytes], ends: np.ndarray, many_a: list[int], many_b: list[int], flat_a: np.ndarray, flat_b: np.ndarray) -> bool:
        """Whether both sides give back every chunk byte by byte: the same bytes in all, and ends at the same places."""
        text = b"".join(whole)
        for flat, many, length, tokens in ((flat_a, many_a, self.length_a, self.bytes_a), (flat_b, many_b, self.length_b, self.bytes_b)):
            if 0 in many or not np.array_equal(np.cumsum(length[flat])[np.cumsum(many) - 1], ends) or b"".join(map(tokens.__getitem__, flat.tolist())) != text:
                return False
        return True

    def bytes_of(self, text: str) -> tuple[bytes, bytes]:
        return b"".join(map(self.bytes_a.__getitem__, self.a.encode_ordinary(" " + text))), b"".join(map(self.bytes_b.__getitem__, self.b.encode(text)))

    def rows(self, texts: list[str | None]) -> list[list[Chunk] | None]:
        """Each text's chunks; None for one without tokens."""
        cut = [self.chunks(t) if t else [] for t in texts]
        every = set().union(*cut)
        if self.held > CACHE_BYTES // 2:
            # Half full: what isn't asked for until it is so again goes.
            self.old, self.cache, self.held = self.cache, {}, 0
        known = self.cache
        new = every - known.keys()
        for c in new & self.old.keys():
            x = known[c] = self.old[c]
            self.held += 350 + len(c) + len(x.groups) + len(x.links)
        new = list(new - known.keys())
        found = dict(zip(new, self.align(new), strict=True)) if new else {}
        differ = {c for c, x in found.items() if x.groups is None}
        for c, x in found.items():
            if len(c) <= LONG and x.groups is not None:
                known[c] = x
                self.held += 350 + len(c) + len(x.groups) + len(x.links)
        once = {c: x for c, x in found.items() if c not in known}
        out: list[list[Chunk] | None] = []
        for chunks in cut:
            if not chunks:
                out.append(None)
            elif not once or once.keys().isdisjoint(chunks):
                out.append(list(map(known.__getitem__, chunks)))
            elif differ.isdisjoint(chunks):
                out.append([once[c] if c in once else known[c] for c in chunks])
            else:
                # The whole can only agree if its chunks differ in ways that make up for each other.
                text = " ".join(chunks)
                a, b = self.bytes_of(text)
                out.append(self.align([text]) if a == b == b" " + text.encode() else None)
        return out


@lru_cache(2)
def aligner(path_a: str | None = None, path_b: str | None = None) -> Aligner:
    """The aligner of two files; by default of the installed vocabulary files."""
    import public_tokenizers

    return Aligner(path_a or public_tokenizers.path(FILES[0]), path_b or public_tokenizers.path(FILES[1]))


SCHEMA = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def aligned(df: DataFrame, keys: list[str], text: str = "text", paths: tuple[str, str] | None = None, with_groups: bool = False) -> DataFrame:
    """Token counts, the digest of the groups and the numbers of the links of each whole text; with ``with_groups`` also the groups (``a1,a2|b1;a3|b2``)."""
    get_links, get_tokens, get_groups = itemgetter(1), itemgetter(2), itemgetter(0)

    def kernel(texts: list[str | None]) -> list[tuple]:
        holds("token_alignment", aligner.cache_clear)
        rows = []
        for chunks in aligner(*(paths or (None, None))).rows(texts):
            if chunks is None:
                rows.append((0, 0, 0, 0, "", b"", *([""] * with_groups)))
                continue
            groups, links, tokens = ";".join(map(get_groups, chunks)), b"".join(map(get_links, chunks)), sum(map(get_tokens, chunks))
            n = len(links) // 4  # a link a group: the tokens that end where the group does
            rows.append((tokens & (1 << 40) - 1, tokens >> 40, n, n, hashlib.sha256(groups.encode()).hexdigest(), links, *([groups] * with_groups)))
        return rows

    return map_rows(df, kernel, keys, text, SCHEMA + ", groups string" * with_groups)


def link_counts(links: DataFrame) -> DataFrame:
    """(link, n): how often each numbered link stands in ``links`` (a column of numbers); a task sends each number once."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = np.frombuffer(b"".join(x for x in batch.column(0).slice(k, 64).to_pylist() if x), "<u4")
                if len(some):
                    count = np.bincount(some)
                    if len(count) > len(total):
                        total = np.pad(total, (0, len(count) - len(total)))
                    total[: len(count)] += count
        some = np.flatnonzero(total)
        for at in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 100_000]), pa.array(total[some[at : at + 100_000]])], names=["link", "n"])

    return links.mapInArrow(counted, "link long, n long").groupBy("link").agg(F.sum("n").alias("n"))


def alignment(df: DataFrame, keys: list[str], text: str = "text", paths: tuple[str, str] | None = None) -> DataFrame:
    """keys, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row.

    Texts are encoded once; what later steps need is written to the shared folder.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/aligned-{uuid.uuid4().hex}"
    aligned(df, keys, text, paths).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.parquet(folder)
    # As many rows as the table of possible links has at most.
    counts = link_counts(stored.select("links")).toArrow()
    known = spark.sparkContext.broadcast((counts.column("link").to_numpy(), counts.column("n").to_numpy()))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(*(paths or (None, None)))
        count = np.zeros(len(both.table), np.int64)
        link, n = known.value
        count[link] = n
        of_b = both.table % len(both.bytes_b)
        highest = np.zeros(len(both.bytes_b), np.int64)
        np.maximum.at(highest, of_b, count)
        best = count == highest[of_b]
        for batch in batches:
            rows = [np.frombuffer(x, "<u4") for x in batch.column("links").to_pylist()]
            arrays = [pa.array([int(best[x].sum()) for x in rows], pa.int64()), pa.array([int(count[x].sum()) for x in rows], pa.int64())]
            kept = [n for n in batch.schema.names if n != "links"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *arrays], names=[*kept, "n_best", "count_sum"])

    fields = [f for f in stored.schema.fields if f.name != "links"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    out = stored.mapInArrow(scored, f"{schema}, n_best long, count_sum long")
    return out.select(*keys, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op11_token_alignment": op11_token_alignment}
