"""Dense regions whose neighbours are all missed."""

import random

import numpy as np
import pytest

from orograph.llm import near_dup


@pytest.mark.parametrize("region", [1, 5])
def test_links_of_dense_regions_do_not_depend_on_neighbours(spark, monkeypatch, region):
    real = near_dup.forests
    monkeypatch.setattr(near_dup, "REGION", region)
    monkeypatch.setattr(near_dup, "forests", lambda rows, keys: real(rows, keys).filter("true" if keys != ["block"] else "false"))
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(150)]
    texts = [passage + [word() for _ in range(60)] for _ in range(40)]
    for t in texts[:12]:
        near = list(t)
        for at in (160, 175, 190):
            near[at] = word()
        texts.append(near)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["component_id"] for r in near_dup.near_dup(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id").collect()}
    groups = near_dup.Groups(len(rows))
    near_dup.exact_groups([near_dup.shingles(t) for _, t in rows], near_dup.Rule(), groups)
    assert found == {i: groups.root(i) for i in range(len(rows))}
    assert sum(i != c for i, c in found.items()) == 12


def test_parities_differ_in_no_more_places_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 400, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3 + 1, dtype=np.uint64)]))
        bits = [np.frombuffer(near_dup.parity(s), np.uint8) for s in (a, b)]
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_shingles_of_one_group_meet_nothing(spark, monkeypatch):
    """Sixty near copies are one group: none of their 200 shingles is joined, and those that two groups share are found."""
    rows = [(bytes([i]), b"one", list(range(1000 + i, 1200))) for i in range(60)] + [(b"x", b"two", list(range(5000, 5200))), (b"y", b"three", list(range(5003, 5203)))]
    sets = spark.createDataFrame([(a, b, len(s), s) for a, b, s in rows], "cls binary, group binary, n long, s array<long>")
    found = near_dup.prefixes(sets, near_dup.weights(sets), near_dup.Rule()).collect()
    assert {bytes(r["group"]) for r in found} == {b"two", b"three"}
    at = {g: {r["x"] for r in found if bytes(r["group"]) == g} for g in (b"two", b"three")}
    assert at[b"two"] & at[b"three"]


def test_few_links_are_not_dealt_over_many_tasks(spark, monkeypatch):
    from orograph.sources.shared import checkpointed

    parts = []
    monkeypatch.setattr(near_dup, "checkpointed", lambda df: parts.append((made := checkpointed(df)).rdd.getNumPartitions()) or made)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(30)], "a binary, b binary")
        found = {(bytes(r["cls"]), bytes(r["root"])) for r in near_dup.components(links).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == {(bytes([i]), bytes([0])) for i in range(31)}
    assert len(parts) > 2 and set(parts[1:]) == {1}
