"""Token alignment, ranked search and packing against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orograph.llm import lexical_search, packing, secret_scan, token_alignment, toxicity

DOCS = "doc_id long, text string, n_a string, rank string, ids string"
BITS = ["the", "The", "Über", "naïve", "  ", "\n", "\t", "\r\n", "'s", "it's", "<|endoftext|>", "<s>", "<0x41>", "12345", "½", "①", "e\u0301", "日本語", "▁", "😀", "a" * 300, ".,;", "x\x00y", "\x1c", "İı", "Σας", "ﬁ", "<|startoftext|>"]


def texts(seed, n):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(BITS) + " " * (rnd.random() < 0.6) for _ in range(rnd.randint(1, 14))) for _ in range(n)]
    return [None, "", " ", "a", "a b", "a b", *made, "word and word, again. " * 9000]


@pytest.fixture(scope="module")
def libraries():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a, c = (Tokenizer.from_file(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), c


def plain_alignment(text, a, b):
    """(A ids, B ids, groups, links), or None for a text without tokens."""
    symbols = token_alignment.byte_symbols()
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    pieces = [[bytes(symbols[c] for c in a.id_to_token(i)) for i in ids[0]], [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [b.id_to_piece(i)]]]
    if not b"".join(pieces[0]) == b"".join(pieces[1]) == (" " + text).encode():
        return None
    ends = [np.cumsum([len(p) for p in side]).tolist() for side in pieces]
    groups, links, at = [], [], [0, 0]
    for end in sorted(set(ends[0]) & set(ends[1])):
        to = [ends[k].index(end) + 1 for k in (0, 1)]
        groups.append("|".join(",".join(map(str, ids[k][at[k] : to[k]])) for k in (0, 1)))
        links.append((ids[0][to[0] - 1], ids[1][to[1] - 1]))
        at = to
    return len(ids[0]), len(ids[1]), ";".join(groups), links


def test_alignment_equals_plain_version(spark, libraries):
    a, b, _ = libraries
    rows = list(enumerate(texts(1, 300)))
    df = spark.createDataFrame([(i if i else None, t, "x", "y", "z") for i, t in rows], DOCS).repartition(5)
    got = {r["doc_id"]: r for r in token_alignment.alignment(df, ["doc_id"]).collect()}
    assert len(got) == len(rows)
    plain = {i if i else None: plain_alignment(t, a, b) for i, t in rows}
    count = Counter(link for p in plain.values() if p for link in p[3])
    highest = Counter()
    for (_, y), n in count.items():
        highest[y] = max(highest[y], n)
    for i, p in plain.items():
        r = got[i]
        if p is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"]) == (p[0], p[1], p[2].count("|"), len(p[3]))
        assert r["groups_sha256"] == hashlib.sha256(p[2].encode()).hexdigest()
        assert (r["n_best"], r["count_sum"]) == (sum(count[x] == highest[x[1]] for x in p[3]), sum(count[x] for x in p[3]))
    assert sum(p is None for p in plain.values()) > 2
    assert token_alignment.alignment(df.limit(0), ["doc_id"]).count() == 0
    shown = token_alignment.aligned(df, ["doc_id"], with_groups=True).collect()
    assert {r["doc_id"]: r["groups"] for r in shown} == {i: p[2] if p else "" for i, p in plain.items()}


def test_links_are_bounded_by_the_vocabularies():
    both = token_alignment.aligner()
    assert len(both.table) < sum(map(len, both.bytes_a)) + sum(map(len, both.bytes_b)) < 700_000


def plain_search(docs, items, k=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 25 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, x[2], -x[0]) for r, x in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return out


def test_search_equals_plain_ranking(spark, monkeypatch):
    rnd = random.Random(4)
    vocabulary = ["alpha", "Beta", "GAMMA", "über", "12", "日本", "x1", "rare", "the", "a"]
    docs = [(i, " ".join(rnd.choices(vocabulary[:7] + ["the"] * 9, k=rnd.randint(1, 40)))) for i in range(300)]
    docs += [(300 + i, docs[5][1]) for i in range(40)] + [(None, docs[5][1]), (7, docs[5][1]), (400, None), (401, ""), (402, "!! ,"), (403, "rare " * 50_000)]
    items = [(0, "alpha ALPHA the"), (1, docs[5][1]), (2, "nowhere"), (3, None), (3, "rare"), (4, "日本 über"), (5, "the"), (6, "--")]
    df = spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS).repartition(7)
    queries = spark.createDataFrame([(*q, 0) for q in items], "item_id long, text string, score int")
    expected = sorted(plain_search(docs, items), key=str)
    monkeypatch.setattr(lexical_search, "BLOCK_QUERIES", 3)  # several blocks
    for size in (400_000, 60):  # one shard a task, and many
        monkeypatch.setattr(lexical_search, "SHARD_WORDS", size)
        shards, whole = lexical_search.written_index(df)
        got = [tuple(r) for r in lexical_search.search(shards, whole, queries).collect()]
        assert sorted(got, key=str) == expected, size
        assert shards.count() > (50 if size == 60 else 0)
    assert lexical_search.search(shards, whole, queries.limit(0)).count() == 0
    shards, whole = lexical_search.written_index(df.limit(0))
    assert lexical_search.search(shards, whole, queries).count() == 0


def test_index_is_written_a_shard_at_a_time(spark, monkeypatch):
    """However many shards a task makes, neither its file's writer nor a reader holds more than one."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(lexical_search, "SHARD_WORDS", 60)
    shards, _ = lexical_search.written_index(spark.createDataFrame([(i, "alpha beta gamma " * 10, "x", "y", "z") for i in range(400)], DOCS).coalesce(2))
    files = [pq.ParquetFile(f.removeprefix("file:")).metadata for f in shards.inputFiles()]
    assert max(m.num_rows for m in files) > 50
    assert all(m.row_group(g).num_rows == 1 for m in files for g in range(m.num_row_groups))


def test_places_of_equal_scores_go_by_id():
    rnd = random.Random(6)
    for _ in range(200):
        n, k = rnd.randint(0, 40), rnd.randint(1, 12)
        scores, ids = np.array([rnd.randrange(4) for _ in range(n)], np.int64), np.array(rnd.sample(range(100), n), np.int64)
        wanted = sorted((i for i in range(n) if scores[i] > 0), key=lambda i: (-scores[i], ids[i]))[:k]
        assert lexical_search.best_places(scores, ids, k).tolist() == wanted


def packed(rows, ids):
    """Checks that every id is in one piece and sequences are gapless; gives the padding."""
    seen = Counter()
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        x = ids[r["doc_id"]]
        assert r["start"] == seen[r["doc_id"]] and r["length"] > 0 and r["doc_tokens"] == len(x)
        assert r["ids_crc32"] == zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]] += r["length"]
    assert all(seen[i] == len(x) for i, x in ids.items())
    sizes = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sizes.get(r["sequence_id"], 0)
        sizes[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sizes.values(), default=0) <= 4096
    return sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes.values())


def test_packing_keeps_every_id_once(spark, libraries):
    c = libraries[2]
    rnd = random.Random(7)
    docs = dict(enumerate(texts(2, 150)))
    docs |= {1000 + i: " ".join(rnd.choices(["word", "Größe", "it's", "12,", "other"], k=int(rnd.expovariate(1 / 700)))) for i in range(900)}
    docs |= {5000 + i: docs[1003] for i in range(300)}
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in docs.items()], DOCS).repartition(5)
    ids = {i: np.array([*c.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in docs.items()}
    rows = packing.pack(df).collect()
    assert packed(rows, ids) <= 0.001 * sum(map(len, ids.values()))
    few = df.filter("doc_id in (0, 3, 1001)")
    packed(packing.pack(few).collect(), {i: ids[i] for i in (0, 3, 1001)})
    assert packing.pack(df.limit(0)).count() == 0
    twice = packing.pack(df.selectExpr("null AS doc_id", "text").unionByName(df.select("doc_id", "text").limit(0))).groupBy().sum("length").first()[0]
    assert twice == sum(map(len, ids.values()))


def test_knapsack_and_program_against_plain_versions():
    rnd = np.random.default_rng(3)
    for _ in range(6):
        lengths = np.sort(rnd.choice(np.arange(200, 4097), 6, replace=False))
        prices = rnd.random(6) * lengths / 2048
        best = np.zeros(4097)
        for room in range(1, 4097):
            best[room] = max([best[room - 1], *(best[room - n] + p for n, p in zip(lengths, prices, strict=True) if n <= room)])
        worth, many = packing.knapsack(lengths, prices)
        assert abs(worth - best[4096]) < 1e-9 and abs((many * prices).sum() - worth) < 1e-6 and (many * lengths).sum() <= 4096
        demand = rnd.integers(1, 500, 6).astype(float)
        taken = packing.solved(lengths, demand, near=0)
        assert all((m * lengths).sum() <= 4096 for m, _ in taken)
        assert np.all(sum(m * x for m, x in taken) >= demand - 1e-6)
        assert sum(x for _, x in taken) >= (lengths * demand).sum() / 4096 - 1e-6
        rows, sequences = packing.dealt({int(n): int(d) for n, d in zip(lengths, demand, strict=True)})
        load = Counter()
        for kind, low, high, first, per in rows:
            for rank in range(low, high):
                load[first + (rank - low) // per] += kind
        assert max(load.values()) <= 4096 and max(load) < sequences <= sum(x for _, x in taken) + 7
    assert packing.dealt({}) == ([], 0)
    assert all(n <= packing.rounded(n) <= min(4096, n + max(0, n // 32)) for n in range(1, 4097))


def test_scans_are_linear():
    """Ten megabytes of digests, and a hundred thousand passages each below the last, in time in proportion."""
    import time

    began = time.process_time()
    digits = "831904785120983475019283 " * 400_000
    assert secret_scan.scan([digits])[0][2] == 400_000
    assert len(toxicity.maximal_segments([(3 * i, 5 - i * 1e-5) for i in range(100_000)], 5.0)) > 1000
    assert time.process_time() - began < 30
