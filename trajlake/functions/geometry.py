"""Distances and geometric predicates as Column expressions; points are structs (x, y), rectangles structs of four doubles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[float, float]


def _xy(p) -> tuple[Column, Column]:
    return (p["x"], p["y"]) if isinstance(p, Column) else (F.lit(float(p[0])), F.lit(float(p[1])))


def distance(p, q) -> Column:
    (px, py), (qx, qy) = _xy(p), _xy(q)
    return F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))


def within(p, q, eps) -> Column:
    """Is the distance at most ``eps``? False for a negative ``eps``."""
    return distance(p, q) <= F.lit(eps)


def _gap(low: Column, value: Column, high: Column) -> Column:
    return F.greatest(low - value, F.lit(0.0), value - high)


def point_rect(p, rect) -> Column:
    """Smallest distance from a point to a rectangle (min_x, min_y, max_x, max_y)."""
    x, y = _xy(p)
    dx, dy = _gap(rect[0], x, rect[2]), _gap(rect[1], y, rect[3])
    return F.sqrt(dx * dx + dy * dy)


def point_rect_minmax(p, rect) -> Column:
    """The smallest, over the rectangle's sides, of the largest distance to the nearer side's far corner (MINMAXDIST)."""
    x, y = _xy(p)
    near = lambda v, a, b: F.when(v <= (a + b) / 2, a).otherwise(b)
    far = lambda v, a, b: F.when(v >= (a + b) / 2, a).otherwise(b)
    sq = lambda c: c * c
    one = sq(x - near(x, rect[0], rect[2])) + sq(y - far(y, rect[1], rect[3]))
    two = sq(x - far(x, rect[0], rect[2])) + sq(y - near(y, rect[1], rect[3]))
    return F.sqrt(F.least(one, two))


def point_segment(p, a, b) -> Column:
    """Distance from a point to a segment; the foot of the perpendicular is clamped to the ends."""
    (px, py), (ax, ay), (bx, by) = _xy(p), _xy(a), _xy(b)
    dx, dy = bx - ax, by - ay
    squared = dx * dx + dy * dy
    t = F.when(squared == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(squared, F.lit(0.0)))))
    cx, cy = ax + t * dx - px, ay + t * dy - py
    return F.sqrt(cx * cx + cy * cy)


def rect_rect(a, b) -> Column:
    dx = F.greatest(b[0] - a[2], F.lit(0.0), a[0] - b[2])
    dy = F.greatest(b[1] - a[3], F.lit(0.0), a[1] - b[3])
    return F.sqrt(dx * dx + dy * dy)


def segment_crosses_rect(a, b, rect) -> Column:
    """Does a segment meet a rectangle? Parameter test of Liang and Barsky on the closed rectangle."""
    low, high = clip_range(a, b, rect)
    return low <= high


def clip_range(a, b, rect) -> tuple[Column, Column]:
    """The parameters from which to which the segment a + t (b - a), 0 <= t <= 1, lies in the rectangle; empty if low > high."""
    (ax, ay), (bx, by) = _xy(a), _xy(b)
    return clip_axes([(ax, bx, rect[0], rect[2]), (ay, by, rect[1], rect[3])])


def clip_axes(axes: list[tuple]) -> tuple[Column, Column]:
    """The same for any number of axes (start, end, least, most)."""
    low, high = F.lit(0.0), F.lit(1.0)
    for start, end, least, most in axes:
        step = end - start
        safe = F.nullif(step, F.lit(0.0))
        one, two = (least - start) / safe, (most - start) / safe
        inside = (start >= least) & (start <= most)
        low = F.greatest(low, F.when(step != 0, F.least(one, two)).when(inside, F.lit(0.0)).otherwise(F.lit(2.0)))
        high = F.least(high, F.when(step != 0, F.greatest(one, two)).when(inside, F.lit(1.0)).otherwise(F.lit(-1.0)))
    return low, high


def clip_segment(a, b, rect) -> Column:
    """The part of a segment inside a rectangle as a struct (x1, y1, x2, y2), null if there is none."""
    (ax, ay), (bx, by) = _xy(a), _xy(b)
    low, high = clip_range(a, b, rect)
    at = lambda s, e, t: s + t * (e - s)
    return F.when(low <= high, F.struct(at(ax, bx, low).alias("x1"), at(ay, by, low).alias("y1"), at(ax, bx, high).alias("x2"), at(ay, by, high).alias("y2")))


def clip_timed_segment(a: Column, b: Column, rect) -> Column:
    """The part of a segment between points (x, y, t) inside a rectangle, with times on the line rounded to whole numbers: a struct
    (x1, y1, t1, x2, y2, t2), null if there is none."""
    low, high = clip_range(a, b, rect)
    return F.when(low <= high, _between(a, b, low, high, lambda v: F.round(v).cast("long")))


def _between(a: Column, b: Column, low: Column, high: Column, time) -> Column:
    at = lambda k, t: a[k] + t * (b[k] - a[k])
    return F.struct(*[(time(at(k, t)) if k == "t" else at(k, t)).alias(f"{k}{i}") for i, t in ((1, low), (2, high)) for k in ("x", "y", "t")])


def _solid(a: Column, b: Column, box) -> list[tuple]:
    return [(a[k].cast("double"), b[k].cast("double"), box[i], box[i + 3]) for i, k in enumerate(("x", "y", "t"))]


def segment_crosses_box(a: Column, b: Column, box) -> Column:
    """Does a segment between points (x, y, t) meet a box (min_x, min_y, min_t, max_x, max_y, max_t)?"""
    low, high = clip_axes(_solid(a, b, box))
    return low <= high


def clip_solid_segment(a: Column, b: Column, box) -> Column:
    """The part of a segment inside a box of space and time as a struct (x1, y1, t1, x2, y2, t2), null if there is none."""
    low, high = clip_axes(_solid(a, b, box))
    return F.when(low <= high, _between(a, b, low, high, lambda v: v))


def legs(pts: str | Column) -> Column:
    """The segments of a trajectory as an array of structs (a, b); none for fewer than two points."""
    pts = F.col(pts) if isinstance(pts, str) else pts
    return F.zip_with(F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def trajectory_crosses_rect(pts: str | Column, rect) -> Column:
    """Does one of a trajectory's segments meet a rectangle?"""
    return F.exists(legs(pts), lambda s: segment_crosses_rect(s["a"], s["b"], rect))


def trajectory_near_rect(pts: str | Column, rect, eps: float) -> Column:
    """Does one of a trajectory's segments come within eps of a rectangle?"""
    return F.exists(legs(pts), lambda s: segment_rect(s["a"], s["b"], rect) <= F.lit(eps))


def trajectory_minmax(pts: str | Column, rect) -> Column:
    """The largest MINMAXDIST of a trajectory's points to a rectangle."""
    return F.array_max(F.transform(pts, lambda p: point_rect_minmax(p, rect)))


def intersection(a, b, c, d) -> Column:
    """The point in which two segments cross as a struct (x, y); null if they share none, or lie on one line."""
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = _xy(a), _xy(b), _xy(c), _xy(d)
    turn = F.nullif((bx - ax) * (dy - cy) - (by - ay) * (dx - cx), F.lit(0.0))
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / turn
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / turn
    return F.when(t.between(0.0, 1.0) & u.between(0.0, 1.0), F.struct((ax + t * (bx - ax)).alias("x"), (ay + t * (by - ay)).alias("y")))


def segment_rect(a, b, rect) -> Column:
    """Smallest distance from a segment to a rectangle, 0 if they meet."""
    corners = [F.struct(x.alias("x"), y.alias("y")) for x in (rect[0], rect[2]) for y in (rect[1], rect[3])]
    apart = F.least(point_rect(a, rect), point_rect(b, rect), *[point_segment(c, a, b) for c in corners])
    return F.when(segment_crosses_rect(a, b, rect), F.lit(0.0)).otherwise(apart)


def segments_intersect(a, b, c, d) -> Column:
    """Do two closed segments share a point?"""

    def side(p, q, r) -> Column:
        (px, py), (qx, qy), (rx, ry) = _xy(p), _xy(q), _xy(r)
        return F.signum((qx - px) * (ry - py) - (qy - py) * (rx - px))

    def on(p, q, r) -> Column:
        (px, py), (qx, qy), (rx, ry) = _xy(p), _xy(q), _xy(r)
        return rx.between(F.least(px, qx), F.greatest(px, qx)) & ry.between(F.least(py, qy), F.greatest(py, qy))

    s1, s2, s3, s4 = side(a, b, c), side(a, b, d), side(c, d, a), side(c, d, b)
    touching = ((s1 == 0) & on(a, b, c)) | ((s2 == 0) & on(a, b, d)) | ((s3 == 0) & on(c, d, a)) | ((s4 == 0) & on(c, d, b))
    return ((s1 != s2) & (s3 != s4)) | touching


def in_box(p, rect) -> Column:
    """Inclusive on all sides."""
    x, y = _xy(p)
    return x.between(rect[0], rect[2]) & y.between(rect[1], rect[3])


def in_cell(p, rect) -> Column:
    """Inclusive below, exclusive above."""
    x, y = _xy(p)
    return (x >= rect[0]) & (x < rect[2]) & (y >= rect[1]) & (y < rect[3])


def times_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return (a0 <= b1) & (b0 <= a1)


def time_at(x: Column, x1: Column, t1: Column, x2: Column, t2: Column) -> Column:
    """Time at ``x`` on the line from (x1, t1) to (x2, t2), rounded; t1 where x1 = x2."""
    return F.when(x1 == x2, t1).otherwise(F.round(t1 + (x - x1) / F.nullif(x2 - x1, F.lit(0.0)) * (t2 - t1)))


#: Queries of more vertices are folded over an array literal, so that plans and generated code stay small.
FEW = 8


def vertices(query: list[Point]) -> Column:
    """The query's vertices as an array of structs (x, y)."""
    return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in query])


def least_over(query: list[Point], measure) -> Column:
    """The smallest value of ``measure`` (of a point) over the query's vertices."""
    if len(query) > FEW:
        return F.array_min(F.transform(vertices(query), measure))
    all_ = [measure(q) for q in query]
    return F.least(*all_) if len(all_) > 1 else all_[0]


def nearest_to_query(p, query: list[Point]) -> Column:
    """Smallest distance from a point to the vertices of the query."""
    return least_over(query, lambda q: distance(p, q))


def rect_to_query(rect, query: list[Point]) -> Column:
    """Smallest distance from the query's vertices to a rectangle."""
    return least_over(query, lambda q: point_rect(q, rect))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)
