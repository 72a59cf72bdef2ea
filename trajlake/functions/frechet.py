"""Discrete Frechet distance: Arrow kernels that advance one dynamic programme for many trajectories at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Trajectories that one padded block holds; they are sorted by length first.
BLOCK = 512
#: Query vertices in one machine word of the decision kernel; the top bit is left for carries.
WORD = 63


class Lists:
    """An Arrow list column of doubles as a flat array with beginnings and lengths; a null list is empty."""

    def __init__(self, column: pa.Array):
        self.lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
        self.begin = np.asarray(column.offsets)[:-1].astype(np.int64)
        self.values = np.asarray(column.values, dtype=float)

    def padded(self, rows: np.ndarray) -> np.ndarray:
        """Rows of equal length: a repeated last point does not change the distance."""
        n = self.lengths[rows]
        return self.values[self.begin[rows][:, None] + np.minimum(np.arange(n.max())[None], n[:, None] - 1)]


def _table(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """Distances of blocks (b, n) to (b, m) or (1, m); the programme's last entry for each trajectory."""
    row: list[np.ndarray] = []
    for i in range(px.shape[1]):
        d = np.sqrt((px[:, i : i + 1] - qx) ** 2 + (py[:, i : i + 1] - qy) ** 2)
        new: list[np.ndarray] = []
        for j in range(d.shape[1]):
            if i and j:
                before = np.minimum(np.minimum(row[j], row[j - 1]), new[j - 1])
            elif i or j:
                before = row[j] if i else new[j - 1]
            else:
                before = d[:, 0]
            new.append(np.maximum(d[:, j], before))
        row = new
    return row[-1]


def _words(free: np.ndarray) -> np.ndarray:
    """Booleans (b, m) as words (b, ceil(m / 63)); bit k of word w is vertex 63 w + k."""
    b, m = free.shape
    n = -(-m // WORD)
    bits = np.zeros((b, n, 64), bool)
    for w in range(n):
        part = free[:, w * WORD : (w + 1) * WORD]
        bits[:, w, : part.shape[1]] = part
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)[:, :, 0]


def reachable(px: np.ndarray, py: np.ndarray, qx: np.ndarray, qy: np.ndarray, eps: float) -> np.ndarray:
    """Is the distance of each trajectory (b, n) to its query (b, m) or to one (1, m) at most ``eps``?

    For each point of the trajectory the vertices that a coupling within ``eps`` can have reached are the bits of a few
    words: those reached from the point before, at the same vertex or the next, and from there on along all free vertices -
    one addition, whose carry runs through them. Trajectories that can reach nothing any more are given up at once.
    """
    out, alive, reached = np.zeros(len(px), bool), np.arange(len(px)), None
    m = qx.shape[1]
    one, top = np.uint64(1), np.uint64(WORD - 1)
    for i in range(px.shape[1]):
        shared = len(qx) == 1
        ox, oy = (qx, qy) if shared else (qx[alive], qy[alive])
        free = _words(np.sqrt((px[alive, i : i + 1] - ox) ** 2 + (py[alive, i : i + 1] - oy) ** 2) <= eps)
        new = np.empty_like(free)
        carry = np.ones(len(alive), np.uint64) if reached is None else np.zeros(len(alive), np.uint64)
        for w in range(free.shape[1]):
            seeds = carry.copy()
            if reached is not None:
                seeds |= reached[:, w] | (reached[:, w] << one)
                if w:
                    seeds |= reached[:, w - 1] >> top
            seeds &= free[:, w]
            new[:, w] = (((free[:, w] + seeds) ^ free[:, w]) & free[:, w]) | seeds
            carry = new[:, w] >> top & one
        live = new.any(1)
        alive, reached = alive[live], new[live]
        if not len(alive):
            return out
    last = m - 1
    out[alive] = (reached[:, last // WORD] >> np.uint64(last % WORD) & one).astype(bool)
    return out


def _blocks(lengths: np.ndarray) -> Iterator[np.ndarray]:
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    for i in range(0, len(order), BLOCK):
        yield order[i : i + BLOCK]


def _query(query: list[tuple[float, float]]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([[p[0] for p in query]], float), np.array([[p[1] for p in query]], float)


def frechet_to(query: list[tuple[float, float]], xs: Column, ys: Column) -> Column:
    """Distance of each trajectory (arrays of x and of y) to a fixed query; null for an empty or null trajectory."""
    qx, qy = _query(query)

    @F.arrow_udf("double")
    def kernel(px: pa.Array, py: pa.Array) -> pa.Array:
        x, y = Lists(px), Lists(py)
        out = np.full(len(px), np.nan)
        for order in _blocks(x.lengths):
            out[order] = _table(x.padded(order), y.padded(order), qx, qy)
        return pa.array(out, mask=np.isnan(out))

    return kernel(xs, ys)


def frechet_within(query: list[tuple[float, float]], eps: float, xs: Column, ys: Column) -> Column:
    """Is the distance of each trajectory to a fixed query at most ``eps``? False for an empty or null one and an empty query."""
    qx, qy = _query(query)

    @F.arrow_udf("boolean")
    def kernel(px: pa.Array, py: pa.Array) -> pa.Array:
        x, y = Lists(px), Lists(py)
        out = np.zeros(len(px), bool)
        for order in _blocks(x.lengths) if len(query) and eps >= 0 else ():
            out[order] = reachable(x.padded(order), y.padded(order), qx, qy, eps)
        return pa.array(out)

    return kernel(xs, ys)


def _pair_blocks(n: np.ndarray, m: np.ndarray) -> Iterator[np.ndarray]:
    """Blocks of pairs whose queries have one length, by the trajectories' length: many rows a block, little padding."""
    order = np.lexsort((n, m))
    order = order[(n[order] > 0) & (m[order] > 0)]
    for own in np.split(order, np.flatnonzero(np.diff(m[order])) + 1):
        for i in range(0, len(own), 2 * BLOCK):
            yield own[i : i + 2 * BLOCK]


def frechet_between(xs: Column, ys: Column, us: Column, vs: Column) -> Column:
    """Distance of the two trajectories of each row; null where one is empty or null."""

    @F.arrow_udf("double")
    def kernel(px: pa.Array, py: pa.Array, qx: pa.Array, qy: pa.Array) -> pa.Array:
        x, y, u, v = map(Lists, (px, py, qx, qy))
        out = np.full(len(px), np.nan)
        for order in _pair_blocks(x.lengths, u.lengths):
            out[order] = _table(x.padded(order), y.padded(order), u.padded(order), v.padded(order))
        return pa.array(out, mask=np.isnan(out))

    return kernel(xs, ys, us, vs)


def within_between(eps: float, xs: Column, ys: Column, us: Column, vs: Column) -> Column:
    """Is the distance of the two trajectories of each row at most ``eps``? False where one is empty or null."""

    @F.arrow_udf("boolean")
    def kernel(px: pa.Array, py: pa.Array, qx: pa.Array, qy: pa.Array) -> pa.Array:
        x, y, u, v = map(Lists, (px, py, qx, qy))
        out = np.zeros(len(px), bool)
        for order in _pair_blocks(x.lengths, u.lengths):  # the bit of the last vertex is the same for queries of one length
            out[order] = reachable(x.padded(order), y.padded(order), u.padded(order), v.padded(order), eps)
        return pa.array(out)

    return kernel(xs, ys, us, vs)


def frechet_native(pts: Column, query: list[tuple[float, float]]) -> Column:
    """The same distance with built-in higher-order functions only: a fold over the points of the programme's row."""
    q = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in query])
    d = lambda p, c: F.sqrt((p["x"] - c["x"]) * (p["x"] - c["x"]) + (p["y"] - c["y"]) * (p["y"] - c["y"]))
    empty = F.array().cast("array<double>")

    def step(row: Column, p: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            up, left, corner = F.get(row, j), F.get(new, j - 1), F.get(row, j - 1)
            before = F.least(up, left, corner)  # nulls, outside the table, are passed over
            return F.concat(new, F.array(F.greatest(d(p, F.get(q, j)), before)))

        return F.aggregate(F.sequence(F.lit(0), F.lit(len(query) - 1)), empty, cell)

    return F.element_at(F.aggregate(pts, empty, step), -1)
