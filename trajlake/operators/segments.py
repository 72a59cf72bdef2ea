"""Segment index: grid runs keyed by the code of their box's home quadrant, with an occupancy signature of each box."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import any_of, nearest_to_query
from ..functions.grid import code_column, home_digits, occupancy, quad_ranges
from ..plans.predicates import Query, box_of, inside
from ..sources.layout import Layout
from . import trajectories as T
from .knn import nearest, rank
from .quadtree import G, rect_near, space
from .range_query import endpoint_filter, exact

ROWS, COLS = 3, 3
START, MIDDLE, END, WHOLE = range(4)


def with_keys(tracks: DataFrame, bounds: tuple[float, float, float, float], g: int = G, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Adds serial (from 1), seg_type, key, and the signature: a bit row * cols + col for each visited part of the box."""
    kind = F.when((F.col("seq_start") == 1) & F.col("is_last"), WHOLE).when(F.col("seq_start") == 1, START).when(F.col("is_last"), END).otherwise(MIDDLE)
    home = home_digits([F.col(c) for c in T.RECT], bounds, g)
    mark = occupancy(F.col("pts"), F.col("min_x"), F.col("min_y"), F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"), cols, rows)
    return tracks.withColumns({"seg_type": kind, "key": code_column(home["digits"], g), "signature": mark})


def touching(pts: str | Column) -> Column:
    """Pivots of a segment: its ends and the points that touch its box."""
    edge = lambda p: (p["x"] == F.col("min_x")) | (p["x"] == F.col("max_x")) | (p["y"] == F.col("min_y")) | (p["y"] == F.col("max_y"))
    return F.array_distinct(F.concat(F.array("first_pt"), F.filter(pts, edge), F.array("last_pt")))


def write_segments(layout: Layout) -> Layout:
    keyed = with_keys(T.tracklets(layout.whole, layout.grid), space(layout)).withColumn("pivots", touching("pts"))
    keyed.repartitionByRange("key", "id").sortWithinPartitions("key", "id", "seq_start").write.mode("overwrite").parquet(f"{layout.path}/segments")
    return layout


def key_ranges(box: tuple[float, float, float, float], bounds: tuple[float, float, float, float], g: int = G, most: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges of the codes of all quadrants whose enlarged box (its upper sides doubled) meets ``box``; about ``most``
    of them, and then of more quadrants, if that is given."""
    meets = lambda q: q[0] <= box[2] and q[1] <= box[3] and q[2] >= box[0] and q[3] >= box[1]
    holds = lambda q: q[0] >= box[0] and q[1] >= box[1] and q[2] <= box[2] and q[3] <= box[3]
    return quad_ranges(bounds, g, meets, holds, most, scale=2.0)


def in_ranges(ranges: list[tuple[int, int]]) -> Column:
    single = [lo for lo, hi in ranges if hi == lo + 1]
    wide = [(F.col("key") >= lo) & (F.col("key") < hi) for lo, hi in ranges if hi > lo + 1]
    return any_of([*wide, *([F.col("key").isin(single)] if single else [])])


def signature_near(query: Query, eps: float) -> Column:
    """Is each visited part of the segment's box within eps of a vertex of the query?"""
    w, h = (F.col("max_x") - F.col("min_x")) / COLS, (F.col("max_y") - F.col("min_y")) / ROWS
    parts = F.sequence(F.lit(0), F.lit(ROWS * COLS - 1))

    def near(i: Column) -> Column:
        x, y = F.col("min_x") + w * (i % COLS), F.col("min_y") + h * F.floor(i / COLS)
        visited = F.call_function("shiftright", F.col("signature"), i).bitwiseAND(F.lit(1)) == 1
        return ~visited | rect_near(x, y, w, h, query, eps)

    return F.forall(parts, near)


def candidates(layout: Layout, query: Query, eps: float) -> DataFrame:
    """Ids from segment metadata: key ranges, boxes inside the query's grown by eps, ends, signatures, completeness."""
    b = box_of(query)
    grown = (b[0] - eps, b[1] - eps, b[2] + eps, b[3] + eps)
    meta = layout.segments.where(in_ranges(key_ranges(grown, space(layout)))).where(inside(b, eps)).where(endpoint_filter(query, eps)).where(signature_near(query, eps))
    meta = meta.where(F.forall("pivots", lambda p: nearest_to_query(p, query) <= F.lit(eps)))
    grouped = meta.groupBy("id").agg(F.min("seq_start").alias("_first"), F.max("seq_end").alias("_end"), F.bool_or("is_last").alias("_last"), F.sum("n_points").alias("_n"))
    return grouped.where("_first = 1 and _last and _n = _end").select("id")


def range_query(layout: Layout, query: Query, eps: float) -> DataFrame:
    """(id, n_points): metadata first, then the points of the candidates by a semi join."""
    if not query or eps < 0:
        return layout.segments.select("id", "n_points").where("false")
    points = layout.segments.join(candidates(layout, query, eps), "id", "left_semi")
    return exact(T.reassemble(points), query, eps).select("id", "n_points")


def knn(layout: Layout, query: Query, k: int) -> DataFrame:
    """The k nearest: candidates within a radius that grows until it holds k, from the metadata, then their points."""
    if not query or k <= 0:
        return rank(T.reassemble(layout.segments.where("false")), query or [(0.0, 0.0)], 0)
    found = lambda eps: T.reassemble(layout.segments.join(candidates(layout, query, eps), "id", "left_semi"))
    return nearest(found, layout, query, k)
