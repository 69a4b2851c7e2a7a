"""Operators as Spark queries: edge cases, and results against plain versions on small tables."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orograph.llm import byte_bpe, fingerprints, html_extract, language_id, license_scan, mixing, near_dup, quality_rules, registry, secret_scan, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, cls string, part int"
LONG = "the quick brown fox jumps over the lazy dog again and again " * 2000
BASE = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, BASE, "en", "a", 1, 0.0, 1, "x", 1),
    (2, BASE, "en", "a", 1, 0.0, 1, "x", 1),
    (3, BASE.replace("word5 ", "other "), "en", "b", 1, 0.0, 1, "x", 1),
    (4, None, "de", "b", None, None, None, None, None),
    (5, "", None, None, 0, 0.0, 1, "x", 1),
    (6, LONG, "de", "c", 1, 0.0, 1, "x", 1),
    (7, "tiny text", "de", "c", 1, 0.0, 1, "x", 1),
    (7, "tiny text", "de", "c", 1, 0.0, 1, "x", 1),
    (None, "no id here", "fr", None, 1, 0.0, 1, "x", 1),
    (9, " \n\t", "fr", "d", 1, 0.0, 1, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_map_operators_take_nulls_repeats_and_clashing_columns(spark, docs):
    for op in (license_scan.license_scan, secret_scan.secret_scan, byte_bpe.byte_bpe, html_extract.html_extract):
        args = (docs, ["doc_id"]) if op is not html_extract.html_extract else (docs, ["doc_id"], "text")
        assert op(*args).count() == len(ROWS)
        assert op(args[0].limit(0), *args[1:]).count() == 0
    tokens = {r["doc_id"]: r for r in byte_bpe.byte_bpe(docs, ["doc_id"], with_ids=True).collect()}
    assert tokens[4]["n_tokens"] == 0 and tokens[4]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert tokens[6]["decoded_sha256"] == hashlib.sha256(LONG.encode()).hexdigest()
    back = byte_bpe.decoded(byte_bpe.byte_bpe(docs, ["doc_id"], with_ids=True), ["doc_id"])
    assert {r["doc_id"]: bytes(r["decoded"]) for r in back.collect()}[7] == b"tiny text"


def test_near_dup_edges(docs):
    found = rows(near_dup.near_dup(docs, "doc_id"), "doc_id", "n_shingles", "component_id", "kept")
    by = {r[0]: r for r in found}
    assert by[1][2:] == (1, True) and by[2][2:] == (1, False)
    assert by[3][2:] == (1, False)
    assert by[4] == (4, 0, 4, True) and by[9] == (9, 0, 9, True) and by[5] == (5, 0, 5, True)
    assert Counter(r[0] for r in found)[7] == 2 and by[7] == (7, 1, 7, True)
    assert by[None] == (None, 1, None, True)
    assert near_dup.near_dup(docs.limit(0), "doc_id").count() == 0


def test_near_dup_groups_equal_brute_force(spark, monkeypatch):
    """Chains and groups larger than a part, so that pivots and visitors are needed."""
    import random

    rnd = random.Random(8)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(150)]
        for _ in range((40, 3, 1, 12, 2, 25)[g]):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(150)] = f"n{rnd.random()}"
            texts.append(" ".join(w))
            if rnd.random() < 0.3:
                base = w
    sets = [near_dup.shingles(t) for t in texts]
    groups = near_dup.Groups(len(texts))
    near_dup.exact_groups(sets, near_dup.Rule(), groups)
    monkeypatch.setattr(near_dup, "GROUP", 7)
    found = dict(rows(near_dup.near_dup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id"), "doc_id", "component_id"))
    assert found == {i: groups.root(i) for i in range(len(texts))}


def test_near_dup_finds_pairs_in_a_dense_region(spark, monkeypatch):
    """Texts that share a long passage fill one region; their few near pairs are found by neighbours of the signature orders."""
    shared = [f"c{i}" for i in range(184)]
    texts = []
    for i in range(60):
        own = [f"d{i}x{j}" for j in range(60)]
        texts += [" ".join(shared + own), " ".join(shared + own[: -(8 + i % 12)] + [f"e{i}y{j}" for j in range(8 + i % 12)])]
    for name, value in (("REGION", 8), ("SPAN", 16), ("GROUP", 16), ("TEXT_SPAN", 16)):
        monkeypatch.setattr(near_dup, name, value)
    found = dict(rows(near_dup.near_dup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id"), "doc_id", "component_id"))
    assert found == {i: i - i % 2 for i in range(len(texts))}


def test_components_that_do_not_end_are_an_error(spark):
    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)], "a binary, b binary")
    with pytest.raises(RuntimeError):
        near_dup.components(links, rounds=1)
    assert {bytes(r["root"]) for r in near_dup.components(links).collect()} == {b"\x00"}


def test_fingerprints_follow_ids(docs):
    found = {(r["doc_id"]): r for r in fingerprints.fingerprints(docs, "doc_id").collect()}
    order = sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0))
    after = {a[0]: (b[1] or "") for a, b in zip(order, order[1:] + order[:1], strict=True)}
    text = {r[0]: r[1] or "" for r in ROWS}
    for i, r in found.items():
        assert r["n_chars"] == len(text[i])
        assert r["edited_sha256"] == hashlib.sha256(fingerprints.edited(text[i], after[i]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert found[1]["fingerprint"] == found[2]["fingerprint"] and found[1]["near_next"] == 1.0
    assert fingerprints.fingerprints(docs.limit(0), "doc_id").count() == 0
    assert fingerprints.fingerprints(docs.limit(1), "doc_id").count() == 1


def test_fingerprints_cut_hot_ids(spark):
    """An id and null that hold most rows lie in several parts; every row is still followed by the next."""
    texts = [f"text {i} of the table, {i * 37 % 11} and {i}" for i in range(300)]
    ids = [None if i % 3 == 0 else 5 if i % 3 == 1 else i for i in range(300)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(5)
    hashed = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(zip(ids, texts, strict=True), key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]] % (1 << 64)))
    expected = sorted((repr(a[0]), hashlib.sha256(fingerprints.edited(a[1], b[1]).encode()).hexdigest()) for a, b in zip(order, order[1:] + order[:1], strict=True))
    found = fingerprints.fingerprints(df, "doc_id").collect()
    assert sorted((repr(r["doc_id"]), r["edited_sha256"]) for r in found) == expected
    base = df.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__k"), F.xxhash64("text").alias("__h")).withColumn("__u", F.col("__h").bitwiseXOR(F.lit(-(1 << 63))))
    assert len([k for k in fingerprints.cuts_of(base, 32)[0] if k == 5]) > 3


def test_quality_counts_equal_plain_version(spark, docs):
    texts = [r[1] for r in ROWS] + ["a b c a b c a b c d", "#x|y\n#x|y\n\nz\nz", "one two three " * 40 + "four"]
    table = spark.createDataFrame([(i, t, "en", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")

    def plain(text):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        return len(w), sum(map(len, w)), sum(c in quality_rules.SYMBOLS for c in text), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)

    found = rows(quality_rules.quality_rules(table, ["doc_id"], ["lang", "source"]), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert [r[1:] for r in sorted(found)] == [plain(t) for t in texts]
    assert quality_rules.quality_rules(docs, ["doc_id"], ["lang", "source"]).count() == len(ROWS)
    assert quality_rules.quality_rules(docs.limit(0), ["doc_id"], ["lang", "source"]).count() == 0
    assert [c for c in ("Python", "Pandas", "Arrow") if c in quality_rules.quality_rules(docs, ["doc_id"], ["lang", "source"])._jdf.queryExecution().executedPlan().toString()] == []


def test_mixing_sums_and_limits(spark, docs):
    table = spark.createDataFrame([(i, "w " * (i % 37 + 1), f"s{i % 4 if i % 3 else 0}") for i in range(900)], "doc_id long, text string, source string")
    found = mixing.mix(table, ["doc_id"]).join(table.select("doc_id", "source"), "doc_id").toPandas()
    assert (found["taken"] <= 3 * found["size"]).all()
    by = found.groupby("source").agg(size=("size", "sum"), own=("source_size", "first"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["size"] == by["own"]).all() and ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"] + 4).all()
    again = mixing.mix(table.repartition(7), ["doc_id"]).toPandas().set_index("doc_id")["taken"].to_dict()
    assert again == found.set_index("doc_id")["taken"].to_dict()
    assert mixing.mix(docs, ["doc_id"]).count() == len(ROWS)
    assert mixing.mix(docs.limit(0), ["doc_id"]).count() == 0
    p = mixing.plan({"a": (5000, 10), "b": (100, 3)})
    ranks = mixing.schedule(spark, p).toPandas()
    assert len(ranks) == p.slots and (ranks.groupby("src")["rank"].apply(sorted).map(lambda x: x == list(range(len(x))))).all()


def test_language_id_learns_and_defaults(spark, docs):
    table = spark.createDataFrame([(i, ("der die und nicht ein " if i % 2 else "the and with for this ") * 5, "de" if i % 2 else "en") for i in range(80)], "doc_id long, text string, lang string")
    labels, model = language_id.train(table, "doc_id", "text", "lang", F.lit(True))
    found = {r["doc_id"]: r for r in language_id.language_id(docs, ["doc_id"], labels, model).collect()}
    assert found[4]["lang_pred"] == "und" and found[5]["lang_pred"] == "und" and found[6]["lang_pred"] == "en"
    none, empty = language_id.train(table.limit(0), "doc_id", "text", "lang", F.lit(True))
    assert {r["lang_pred"] for r in language_id.language_id(docs, ["doc_id"], none, empty).collect()} == {"und"}


def test_toxicity_learns_and_defaults(spark, docs):
    import random

    rnd = random.Random(1)
    calm = [f"calm{i}" for i in range(60)]
    data = [(i, " ".join(rnd.choices(calm, k=60) + (["awful", "vile"] if i % 4 == 0 else [])), i % 4 == 0) for i in range(600)]
    table = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, _, y in data], "doc_id long, toxic int")
    part = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = toxicity.fit(table, labels, "doc_id", "text", "toxic", part.isin(1, 2, 3), part == 4)
    found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(table, ["doc_id"], model).collect()}
    held = [(found[i], int(y)) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    none = toxicity.fit(table, labels.limit(0), "doc_id", "text", "toxic", part == 1, part == 4)
    scores = {r["score"] for r in toxicity.toxicity(docs, ["doc_id"], none).collect()}
    assert len(scores) == 1 and 0 <= scores.pop() < 0.5


def test_every_query_is_registered():
    names = registry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and set(registry.oracle_sql()) <= set(names)


def test_pipeline_stages_keep_rows_without_ids_or_texts(spark, docs):
    import corpus_pipeline

    plain = docs.select(corpus_pipeline.COLUMNS)
    kept = corpus_pipeline.drop_near_copies(spark, plain, "")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 4: 1, 5: 1, 6: 1, 7: 2, 9: 1, None: 1})
    clean = corpus_pipeline.redact_secrets(spark, kept, "")
    assert clean.columns == corpus_pipeline.COLUMNS and clean.count() == 8
    mixed = corpus_pipeline.mix_sources(spark, clean, "")
    assert mixed.columns == corpus_pipeline.COLUMNS and {r["doc_id"] for r in mixed.collect()} >= {4, 5, 9}
    assert corpus_pipeline.encode(spark, mixed, "").count() == mixed.count()
    for stage in (corpus_pipeline.drop_near_copies, corpus_pipeline.redact_secrets, corpus_pipeline.mix_sources, corpus_pipeline.encode):
        assert stage(spark, plain.limit(0), "").count() == 0


def test_pipeline_takes_rows_without_ids_one_by_one(spark):
    import corpus_pipeline

    text = lambda g: " ".join(f"g{g}w{i}" for i in range(80))
    plain = [(1, text(0)), (None, text(0)), (None, text(1)), (None, text(1)), (None, text(1) + " more"), (None, "alone"), (5, text(2)), (5, text(0)), (None, None), (None, None)]
    table = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in plain], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, table, "").collect()]
    ones = [(i, t) for i, t in kept if t and t.startswith("g1w0 ")]
    assert len(ones) == 1 and ones[0][0] is None
    assert Counter(x for x in kept if x not in ones) == Counter([(1, text(0)), (None, "alone"), (5, text(2)), (None, None), (None, None)])

    many = [(None if i % 3 == 0 else i, f"n{i} " * (i % 29 + 1), f"s{i % 4}") for i in range(1200)]
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in many], table.schema)
    target = {r["source"]: r["target"] for r in mixing.mix(docs.withColumn("k", F.col("source")), ["source"]).select("source", "target").distinct().collect()}
    words = Counter()
    for r in corpus_pipeline.mix_sources(spark, docs, "").collect():
        words[r["source"]] += len(r["text"].split())
    assert all(abs(words[s] - t) <= 0.03 * t for s, t in target.items()), (words, target)


def test_pipeline_equals_its_operators(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    calm = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    kept = {r["doc_id"] for r in calm.collect()}
    assert set(out["doc_id"]) <= kept
    text = {r["doc_id"]: r["text"] for r in calm.collect()}
    for r in out.head(50).itertuples():
        clean = secret_scan.redact([text[r.doc_id]])[0][0]
        assert r.decoded_sha256 == hashlib.sha256(clean.encode()).hexdigest()
    assert out.groupby("doc_id").size().max() <= 3
