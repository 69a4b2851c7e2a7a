"""Flow over rasters: direction by window expressions; accumulation, components and paths in grouped kernels, an area a group."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orograph.operators.stencil import across, down

# Neighbours in the order in which ties are broken, and the thresholds.
OFFSETS = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]
LEAST_ACCUMULATION, LEAST_PATH_CELLS, MOST_VERTICES, LEAST_SMOOTHED = 24, 5, 24, 10


def flow_direction(cells: DataFrame) -> DataFrame:
    """Adds ``dir``: the neighbour (0 to 7) of the steepest drop, the first of equals, or -1."""
    rows = cells.withColumns({"__u": F.lag("elev").over(down()), "__d": F.lead("elev").over(down())})
    around = [F.lag("__u").over(across()), F.col("__u"), F.lead("__u").over(across()), F.lag("elev").over(across()), F.lead("elev").over(across()), F.lag("__d").over(across()), F.col("__d"), F.lead("__d").over(across())]
    rows = rows.withColumns({f"__n{i}": e for i, e in enumerate(around)})
    drops = F.array(*[F.coalesce((F.col("elev") - F.col(f"__n{i}")) / math.hypot(*OFFSETS[i]), F.lit(0.0)) for i in range(8)])
    rows = rows.withColumn("__drops", drops)
    best = F.array_max("__drops")
    return rows.withColumn("dir", F.when(best > 0, F.array_position("__drops", best) - 1).otherwise(F.lit(-1)).cast("int")).drop("__u", "__d", "__drops", *[f"__n{i}" for i in range(8)])


def inverted(cells: DataFrame) -> DataFrame:
    """Elevations turned upside down: ridges become channels."""
    top = cells.groupBy("area").agg(F.max("elev").alias("__top"))
    return cells.join(top, "area").withColumn("elev", F.col("__top") - F.col("elev")).drop("__top")


def grid_of(frame: pd.DataFrame, column: str, fill: float = 0.0) -> np.ndarray:
    out = np.full((int(frame["row"].max()) + 1, int(frame["col"].max()) + 1), fill)
    out[frame["row"].to_numpy(), frame["col"].to_numpy()] = frame[column].to_numpy()
    return out


def accumulate(elev: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Cells that drain through each cell, itself included. All cells whose inflow is complete pass their counts on at once, until none is left."""
    h, w = elev.shape
    flat = direction.ravel().astype(np.int64)
    moves = np.array([r * w + c for r, c in OFFSETS])
    to = np.where(flat >= 0, np.arange(h * w) + moves[flat], -1)
    count, open_ = np.ones(h * w, np.int64), np.bincount(to[to >= 0], minlength=h * w)
    ready = np.flatnonzero(open_ == 0)
    while len(ready):
        ready = ready[to[ready] >= 0]
        np.add.at(count, to[ready], count[ready])
        np.subtract.at(open_, to[ready], 1)
        ready = np.unique(to[ready])
        ready = ready[open_[ready] == 0]
    return count.reshape(h, w)


def accumulation(flow: DataFrame) -> DataFrame:
    """Area, row, col and accumulation of cells with a direction."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        acc = accumulate(grid_of(frame, "elev"), grid_of(frame, "dir", -1))
        return pd.DataFrame({"area": frame["area"], "row": frame["row"], "col": frame["col"], "acc": acc[frame["row"], frame["col"]].astype("int32")})

    return flow.select("area", "row", "col", "elev", "dir").groupBy("area").applyInPandas(run, "area long, row int, col int, acc int")


def labels(rows: np.ndarray, cols: np.ndarray, eight: bool = True) -> np.ndarray:
    """The number of each cell's component; components are numbered by their first cell in reading order.

    Every cell takes the smallest place in reading order among its neighbours'
    roots, and roots are followed to their ends, until nothing changes.
    """
    if not len(rows):
        return np.zeros(0, np.int64)
    wide = int(cols.max()) + 2
    keys = rows.astype(np.int64) * wide + cols
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    a, b = [], []
    for r, c in [(0, 1), (1, 0), *([(1, -1), (1, 1)] if eight else [])]:
        to = sorted_ + r * wide + c
        at = np.minimum(np.searchsorted(sorted_, to), len(to) - 1)
        hit = np.flatnonzero((sorted_[at] == to) & (cols[order] + c >= 0))
        a.append(hit)
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(len(keys))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    out = np.empty(len(keys), np.int64)
    out[order] = np.unique(root, return_inverse=True)[1]
    return out


def members(own: np.ndarray) -> list[np.ndarray]:
    """The places of each component's cells, by number."""
    order = np.argsort(own, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(own[order])) + 1) if len(own) else []


#: Columns that a label has room for.
MOST_COLUMNS = 1 << 31


def components(mask: DataFrame, eight: bool = True) -> DataFrame:
    """Area, row, col and ``label`` of the cells of a mask: the smallest row * 2 ** 31 + col of the component."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        own = labels(frame["row"].to_numpy(), frame["col"].to_numpy(), eight)
        place = frame["row"].to_numpy().astype(np.int64) * MOST_COLUMNS + frame["col"].to_numpy()
        least = np.full(own.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, own, place)
        return frame.assign(label=least[own])[["area", "row", "col", "label"]]

    return mask.select("area", "row", "col").groupBy("area").applyInPandas(run, "area long, row int, col int, label long")


def farthest(cells: list[tuple[int, int]], place: tuple[int, int]) -> tuple[int, int]:
    """The cell of the longest straight line to a place; the first in order of equals."""
    return max(cells, key=lambda p: (p[0] - place[0]) ** 2 + (p[1] - place[1]) ** 2)


def trace(cells: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The shortest path between two far ends of a component, diagonal steps costing sqrt(2).

    Ends are cells with one neighbour at most, if there are two of these. The
    path runs from the end farthest, in a straight line, from the first one in
    reading order to the end farthest from that.
    """
    cells = sorted(cells)
    inside = set(cells)
    near = {p: [(p[0] + r, p[1] + c) for r, c in OFFSETS if (p[0] + r, p[1] + c) in inside] for p in cells}
    ends = [p for p in cells if len(near[p]) <= 1]
    ends = ends if len(ends) >= 2 else cells
    start = farthest(ends, ends[0])
    goal = farthest(ends, start)
    cost, before, heap = {start: 0.0}, {}, [(0.0, start)]
    while heap:
        x, p = heapq.heappop(heap)
        if p == goal:
            break
        if x > cost[p]:
            continue
        for q in near[p]:
            y = x + (math.sqrt(2) if p[0] != q[0] and p[1] != q[1] else 1.0)
            if y < cost.get(q, math.inf):
                cost[q], before[q] = y, p
                heapq.heappush(heap, (y, q))
    path = [goal]
    while path[-1] != start:
        path.append(before[path[-1]])
    return path[::-1]


def smoothed(path: np.ndarray) -> np.ndarray:
    """Gaussian of sigma 1 along long paths, edges repeated, ends kept."""
    if len(path) < LEAST_SMOOTHED:
        return path
    weights = np.exp(-0.5 * np.arange(-4, 5) ** 2.0)
    weights /= weights.sum()
    at = np.clip(np.arange(len(path))[:, None] + np.arange(-4, 5), 0, len(path) - 1)
    out = np.einsum("ikd,k->id", path[at], weights)
    out[[0, -1]] = path[[0, -1]]
    return out


def resampled(path: np.ndarray, most: int = MOST_VERTICES) -> np.ndarray:
    """No more than ``most`` vertices at equal arc lengths, ends exact."""
    if len(path) <= most:
        return path
    along = np.concatenate([[0.0], np.cumsum(np.hypot(*np.diff(path, axis=0).T))])
    to = np.linspace(0.0, along[-1], most)
    return np.stack([np.interp(to, along, path[:, k]) for k in (0, 1)], axis=1)


def paths(mask: DataFrame) -> DataFrame:
    """Traced paths of a mask's components of LEAST_PATH_CELLS or more: area, ord and vertices (fractional row, col)."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows, cols = frame["row"].to_numpy(), frame["col"].to_numpy()
        out = []
        for part in members(labels(rows, cols)):
            if len(part) >= LEAST_PATH_CELLS:
                p = trace(list(zip(rows[part].tolist(), cols[part].tolist(), strict=True)))
                v = resampled(smoothed(np.array(p, float)))
                out.append((frame["area"].iloc[0], len(out), [{"r": float(r), "c": float(c)} for r, c in v]))
        return pd.DataFrame(out, columns=["area", "ord", "path"])

    return mask.select("area", "row", "col").groupBy("area").applyInPandas(run, "area long, ord int, path array<struct<r:double,c:double>>")
