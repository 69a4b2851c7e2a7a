"""Sketches that can't peel: texts of millions of unlike paragraphs, digests that meet."""

import time

import numpy as np
import pytest

from orograph.llm import fingerprints


def paragraphs(keys):
    p = fingerprints.Paragraphs("")
    p.keys = keys
    p.weight, p.first = fingerprints.weight(keys), fingerprints.sketch(keys, fingerprints.CELLS)
    return p


@pytest.mark.parametrize("n", [10, 3000, 200_000, 1_200_000])
def test_unlike_texts_of_any_size_end_with_the_likeness_of_plain_sets(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 1 << 63, 3 * n, dtype=np.uint64))
    rng.shuffle(keys)
    third = len(keys) // 3
    a, b = paragraphs(keys[: 2 * third]), paragraphs(keys[third:])
    began = time.process_time()
    only_a, only_b = fingerprints.difference(a, b)
    assert np.array_equal(np.sort(only_a), np.sort(keys[:third])) and np.array_equal(np.sort(only_b), np.sort(keys[2 * third :]))
    shared = fingerprints.weight(keys[third : 2 * third])
    assert fingerprints.likeness(a, b) == pytest.approx(shared / (shared + fingerprints.weight(only_a) + fingerprints.weight(only_b)))
    assert time.process_time() - began < 120


def test_two_paragraphs_of_one_digest_end():
    keys = np.arange(1, 200, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    twice = np.append(keys, keys[:3])
    only_a, only_b = fingerprints.difference(paragraphs(twice), paragraphs(keys[:150]))
    assert set(only_a.tolist()) - set(keys[:3].tolist()) == set(keys[150:].tolist()) and len(only_b) == 0
