"""Predicates on tracklet boxes that Parquet can evaluate from its statistics, in four strengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geometry import any_of
from ..functions.grid import Grid, hilbert

Query = list[tuple[float, float]]
#: So many boxes at most reach the scan as alternatives; of more, neighbours are united for the scan's sake, and each row is then
#: tested against all of them.
MOST_BOXES = 64


def query_cells(grid: Grid, query: Query, eps: float) -> list[set[int]]:
    """For each vertex the Hilbert ids of the cells within eps; none if the query is empty or eps is negative."""
    return [{hilbert(ix, iy, grid.bits) for ix, iy in grid.cells_near(x, y, eps)} if eps >= 0 else set() for x, y in query]


def box_of(query: Query) -> tuple[float, float, float, float]:
    x, y = [p[0] for p in query], [p[1] for p in query]
    return min(x), min(y), max(x), max(y)


def inside(box, eps: float) -> Column:
    return (F.col("min_x") >= box[0] - eps) & (F.col("max_x") <= box[2] + eps) & (F.col("min_y") >= box[1] - eps) & (F.col("max_y") <= box[3] + eps)


def overlaps(box, eps: float) -> Column:
    return (F.col("max_x") >= box[0] - eps) & (F.col("min_x") <= box[2] + eps) & (F.col("max_y") >= box[1] - eps) & (F.col("min_y") <= box[3] + eps)


def query_runs(grid: Grid, query: Query) -> list[tuple[float, float, float, float]]:
    """Boxes of the query's runs of consecutive vertices in one cell."""
    runs: list[list] = []
    for x, y in query:
        cell = grid.place(x, "x"), grid.place(y, "y")
        if runs and runs[-1][0] == cell:
            runs[-1][1].append((x, y))
        else:
            runs.append([cell, [(x, y)]])
    return [box_of(pts) for _, pts in runs]


def _fewer(boxes: list) -> list:
    while len(boxes) > MOST_BOXES:
        pairs = [boxes[i : i + 2] for i in range(0, len(boxes), 2)]
        boxes = [(min(b[0] for b in p), min(b[1] for b in p), max(b[2] for b in p), max(b[3] for b in p)) for p in pairs]
    return boxes


def meets_any(boxes: list[tuple[float, float, float, float]], eps: float) -> Column:
    """Does the row's box meet one of the boxes grown by eps? The test is the same for any number of boxes."""
    pushed = any_of([overlaps(b, eps) for b in _fewer(boxes)])
    if len(boxes) <= MOST_BOXES:
        return pushed
    all_ = F.array(*[F.struct(*[F.lit(float(v)).alias(k) for k, v in zip("abcd", b, strict=True)]) for b in boxes])
    e = F.lit(float(eps))
    meets = lambda b: (F.col("max_x") >= b["a"] - e) & (F.col("min_x") <= b["c"] + e) & (F.col("max_y") >= b["b"] - e) & (F.col("min_y") <= b["d"] + e)
    return pushed & F.exists(all_, meets)


def border_cells(grid: Grid, query: Query, eps: float) -> list[int]:
    """Cells whose ordinal is at an edge of the window of the query's box grown by eps."""
    b = box_of(query)
    x0, x1 = grid.place(b[0] - eps, "x"), grid.place(b[2] + eps, "x")
    y0, y1 = grid.place(b[1] - eps, "y"), grid.place(b[3] + eps, "y")
    return [hilbert(ix, iy, grid.bits) for ix in range(x0, x1 + 1) for iy in range(y0, y1 + 1) if ix in (x0, x1) or iy in (y0, y1)]


def pushdown(variant: str, grid: Grid, query: Query, eps: float) -> Column:
    """v1: in border cells the box must lie in the query's box grown by eps; v2: it meets a vertex grown by eps;
    v3: it meets the box of a same-cell run of the query, grown by eps; v4: anything."""
    if variant == "v1":
        return ~F.col("cell").isin(border_cells(grid, query, eps)) | inside(box_of(query), eps)
    if variant in ("v2", "v3"):
        return meets_any([(x, y, x, y) for x, y in query] if variant == "v2" else query_runs(grid, query), eps)
    return F.lit(True)
