"""Uniform grid with Hilbert cell ids, and quadtree codes, as Column expressions and for the driver's few query points."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD = 1e-7


@dataclass(frozen=True)
class Grid:
    """2**bits cells an axis over [min, max), the upper bounds padded so that maxima fall inside."""

    bits: int
    min_x: float
    min_y: float
    max_x: float
    max_y: float

    @property
    def n(self) -> int:
        return 1 << self.bits

    def as_dict(self) -> dict:
        return asdict(self)

    def ordinal(self, value: Column, axis: str) -> Column:
        """Cell ordinal on an axis, clamped to the domain."""
        low, high = getattr(self, f"min_{axis}"), getattr(self, f"max_{axis}")
        return F.greatest(F.lit(0), F.least(F.lit(self.n - 1), F.floor((value - F.lit(low)) / F.lit(high - low) * F.lit(self.n)).cast("int")))

    def place(self, value: float, axis: str) -> int:
        low, high = getattr(self, f"min_{axis}"), getattr(self, f"max_{axis}")
        return max(0, min(self.n - 1, math.floor((value - low) / (high - low) * self.n)))

    def rect(self, ix: int, iy: int) -> tuple[float, float, float, float]:
        w, h = (self.max_x - self.min_x) / self.n, (self.max_y - self.min_y) / self.n
        return self.min_x + ix * w, self.min_y + iy * h, self.min_x + (ix + 1) * w, self.min_y + (iy + 1) * h

    def cells_near(self, x: float, y: float, eps: float) -> set[tuple[int, int]]:
        """Cells, of the window around (x, y), whose smallest distance to it is at most eps."""
        out = set()
        for ix in range(self.place(x - eps, "x"), self.place(x + eps, "x") + 1):
            for iy in range(self.place(y - eps, "y"), self.place(y + eps, "y") + 1):
                a, b, c, d = self.rect(ix, iy)
                # the outermost cells also hold what lies beyond the domain's border by rounding
                dx, dy = max(a - x, 0.0, x - c), max(b - y, 0.0, y - d)
                if math.sqrt(dx * dx + dy * dy) <= eps + 1e-9:
                    out.add((ix, iy))
        return out


def hilbert(ix: int, iy: int, bits: int) -> int:
    out, s = 0, 1 << bits >> 1
    while s:
        rx, ry = int(ix & s > 0), int(iy & s > 0)
        out += s * s * ((3 * rx) ^ ry)
        if not ry:
            if rx:
                ix, iy = s - 1 - (ix & (s - 1)), s - 1 - (iy & (s - 1))
            ix, iy = iy & (s - 1), ix & (s - 1)
        else:
            ix, iy = ix & (s - 1), iy & (s - 1)
        s >>= 1
    return out


def hilbert_column(ix: Column, iy: Column, bits: int) -> Column:
    """The same curve as an expression of ``bits`` steps."""
    state = F.struct(ix.cast("int").alias("x"), iy.cast("int").alias("y"), F.lit(0).cast("long").alias("d"))

    def step(now: Column, s: Column) -> Column:
        rx, ry = (now["x"].bitwiseAND(s) > 0).cast("int"), (now["y"].bitwiseAND(s) > 0).cast("int")
        d = now["d"] + s.cast("long") * s * (3 * rx).bitwiseXOR(ry)
        x, y = now["x"].bitwiseAND(s - 1), now["y"].bitwiseAND(s - 1)
        flip = (ry == 0) & (rx == 1)
        fx, fy = F.when(flip, s - 1 - x).otherwise(x), F.when(flip, s - 1 - y).otherwise(y)
        return F.struct(F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"), d.alias("d"))

    sides = F.array(*[F.lit(1 << b) for b in reversed(range(bits))]) if bits else F.array().cast("array<int>")
    return F.aggregate(sides, state, step)["d"]


def hilbert_place(cell: Column, bits: int) -> Column:
    """The ordinals (ix, iy) of a cell of the curve: the inverse of :func:`hilbert_column`."""
    state = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), cell.cast("long").alias("d"))

    def step(now: Column, s: Column) -> Column:
        size = s.cast("long")
        quarter = now["d"].bitwiseAND(F.lit(3))
        rx = F.floor(quarter / 2)
        ry = quarter.bitwiseXOR(rx).bitwiseAND(F.lit(1))
        flip = (ry == 0) & (rx == 1)
        x, y = F.when(flip, size - 1 - now["x"]).otherwise(now["x"]), F.when(flip, size - 1 - now["y"]).otherwise(now["y"])
        tx, ty = F.when(ry == 0, y).otherwise(x), F.when(ry == 0, x).otherwise(y)
        return F.struct((tx + size * rx).alias("x"), (ty + size * ry).alias("y"), F.floor(now["d"] / 4).alias("d"))

    sides = F.array(*[F.lit(1 << b) for b in range(bits)]) if bits else F.array().cast("array<int>")
    end = F.aggregate(sides, state, step)
    return F.struct(end["x"].cast("int").alias("ix"), end["y"].cast("int").alias("iy"))


def cells_in(grid: Grid, rect: tuple[float, float, float, float]) -> Column:
    """Is the row's ``cell`` one of those that meet a rectangle?"""
    near = [hilbert(ix, iy, grid.bits) for ix in range(grid.place(rect[0], "x"), grid.place(rect[2], "x") + 1) for iy in range(grid.place(rect[1], "y"), grid.place(rect[3], "y") + 1)]
    return F.col("cell").isin(near)


def quad_ranges(bounds: tuple[float, float, float, float], g: int, meets, holds, most: int | None = None, scale: float = 1.0) -> list[tuple[int, int]]:
    """Half-open ranges, merged, of the codes of the quadrants that ``meets`` accepts, given as boxes (x0, y0, x1, y1) whose sides are
    ``scale`` times the quadrant's; a quadrant that it refuses is not looked into. One that ``holds`` accepts counts with all
    below it. With ``most``, quadrants are taken whole, level by level, once so many are found or waiting."""
    width, height = bounds[2] - bounds[0], bounds[3] - bounds[1]
    found: list[tuple[int, int]] = []
    level, depth = [(0, 0.0, 0.0)], 0
    while level:
        w, following = 0.5**depth, []
        whole = most is not None and len(found) + len(level) > most
        for code, x, y in level:
            x0, y0 = bounds[0] + x * width, bounds[1] + y * height
            box = (x0, y0, x0 + scale * w * width, y0 + scale * w * height)
            if not meets(box):
                continue
            if whole or holds(box):
                found.append((code, code + subtree(g - depth + 1)))
                continue
            found.append((code, code + 1))
            if depth < g:
                following += [(code + 1 + q * subtree(g - depth), x + (q & 1) * w / 2, y + (q >> 1) * w / 2) for q in range(4)]
        level, depth = following, depth + 1
    return merged_ranges(found)


def merged_ranges(ranges: list[tuple[int, int]], most: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges in order, those that touch as one; with ``most``, the narrowest gaps are closed until so many are left."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    if most is not None and len(out) > most:
        gaps = sorted(range(1, len(out)), key=lambda i: out[i][0] - out[i - 1][1], reverse=True)[: most - 1]
        cuts = [0, *sorted(gaps), len(out)]
        out = [(out[a][0], out[b - 1][1]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def ranges_of(keys: list[int], most: int | None = None) -> list[tuple[int, int]]:
    """Exact keys as half-open ranges."""
    return merged_ranges([(k, k + 1) for k in keys], most)


def subtree(levels: int) -> int:
    """Quadrants of a subtree of so many levels, its root included."""
    return (4**levels - 1) // 3


def quad_code(digits: list[int], g: int) -> int:
    """Pre-order number of a quadrant in a quadtree of depth g; the root is 0."""
    return sum(1 + q * subtree(g - i) for i, q in enumerate(digits))


def packed_key(code: int, shape: int, cells: int) -> int:
    return code << cells | shape


def home_digits(rect: list[Column], bounds: tuple[float, float, float, float], g: int) -> Column:
    """Digits (2 * top + right) of the smallest quadrant, at most g deep, that holds a box: stop where it straddles a middle."""
    scale = lambda v, low, high: (v - F.lit(low)) / F.lit(high - low)
    x0, x1 = (scale(v, bounds[0], bounds[2]) for v in (rect[0], rect[2]))
    y0, y1 = (scale(v, bounds[1], bounds[3]) for v in (rect[1], rect[3]))
    start = F.struct(F.array().cast("array<int>").alias("digits"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(False).alias("stop"))

    def step(now: Column, _: Column) -> Column:
        mx, my = now["x"] + now["w"] / 2, now["y"] + now["w"] / 2
        stop = now["stop"] | ((x0 < mx) != (x1 < mx)) | ((y0 < my) != (y1 < my))
        right, top = (x0 >= mx).cast("int"), (y0 >= my).cast("int")
        return F.struct(
            F.when(stop, now["digits"]).otherwise(F.concat(now["digits"], F.array(2 * top + right))).alias("digits"),
            F.when(stop | (right == 0), now["x"]).otherwise(mx).alias("x"),
            F.when(stop | (top == 0), now["y"]).otherwise(my).alias("y"),
            F.when(stop, now["w"]).otherwise(now["w"] / 2).alias("w"),
            stop.alias("stop"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(g)), start, step)


def code_column(digits: Column, g: int) -> Column:
    sizes = F.array(*[F.lit(subtree(g - i)).cast("long") for i in range(g)])
    return F.aggregate(F.transform(digits, lambda q, i: 1 + q * F.get(sizes, i)), F.lit(0).cast("long"), lambda a, b: a + b)


def occupancy(pts: Column, x: Column, y: Column, w: Column, h: Column, cols: int, rows: int) -> Column:
    """Bits row * cols + col of the sub-cells of the box (x, y, w, h) that hold a point; a flat box has one column or row."""
    slot = lambda v, low, size, n: F.when(size <= 0, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / F.nullif(size, F.lit(0.0)) * n).cast("int"))))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), slot(p["y"], y, h, rows) * cols + slot(p["x"], x, w, cols))
    return F.aggregate(pts, F.lit(0).cast("long"), lambda a, p: a.bitwiseOR(bit(p)))
