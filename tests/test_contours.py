"""Contours against borders that are followed around, one after another."""

import numpy as np
import pytest

from orograph.operators import style

#: Neighbours in turn, clockwise from the east (row, column).
TURN = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def followed(mask):
    """Cells of every border of a mask, outer or of a hole, each walked around from its first cell until it closes."""
    m = np.pad(mask, 1).astype(int)
    seen = np.zeros(m.shape, bool)
    for r, c in zip(*np.nonzero(m), strict=True):
        for out in (4, 0):  # ground to the west: an outer border may begin here; to the east: one of a hole
            dr, dc = TURN[out]
            if m[r + dr, c + dc]:
                continue
            first = next((k % 8 for k in range(out, out + 8) if m[r + TURN[k % 8][0], c + TURN[k % 8][1]]), None)
            seen[r, c] = True
            if first is None:
                continue
            start = r + TURN[first][0], c + TURN[first][1]
            at, back = (r, c), first
            while True:
                k = next(n % 8 for n in range(back - 1, back - 9, -1) if m[at[0] + TURN[n % 8][0], at[1] + TURN[n % 8][1]])
                after = at[0] + TURN[k][0], at[1] + TURN[k][1]
                seen[at] = True
                if after == (r, c) and at == start:
                    break
                at, back = after, (k + 4) % 8
    return seen[1:-1, 1:-1]


def plain(elev, levels):
    low, high = float(elev.min()), float(elev.max())
    out = np.zeros(elev.shape, bool)
    if high - low < 1:
        return out
    scaled = ((elev - low) / (high - low) * 255).astype(np.uint8)
    for level in np.linspace(low, high, levels + 2)[1:-1]:
        out |= followed(scaled > int((level - low) / (high - low) * 255))
    return out


def fixtures():
    y, x = np.mgrid[:21, :21]
    ring = np.where((np.hypot(y - 10, x - 10) < 8) & (np.hypot(y - 10, x - 10) > 4), 100.0, 0.0)
    corners = np.where((y // 4 + x // 4) % 2 == 0, 100.0, 0.0)
    yield ring  # a hole
    yield np.maximum(ring, np.where(np.hypot(y - 10, x - 10) < 2, 50.0, 0.0))  # land within the hole
    yield corners  # areas that touch by corners
    yield 100.0 * (x > 9)  # along the end of the raster
    yield np.where((y == 5) & (x == 5), 100.0, 0.0)  # one cell
    yield np.where((y == 7) | (x == y), 100.0, 0.0)  # lines of one cell
    rng = np.random.default_rng(2)
    for _ in range(25):
        yield rng.normal(0, 50, (21, 21)).cumsum(0).cumsum(1)
        yield rng.random((rng.integers(3, 21), rng.integers(3, 21))) * 100
    yield np.full((9, 9), 7.0)


@pytest.mark.parametrize("levels", [1, 5])
def test_contours_are_the_borders_that_a_walk_visits(levels):
    for elev in fixtures():
        assert np.array_equal(style.contours(elev, levels), plain(elev, levels))
