"""k nearest trajectories by discrete Frechet distance; ties go to the smaller id."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.frechet import frechet_to
from ..plans.predicates import Query, box_of
from ..sources.layout import Layout
from . import trajectories as T
from .range_query import candidate_ids, near_tracklets


def rank(whole: DataFrame, query: Query, k: int) -> DataFrame:
    """(id, n_points, frechet) of the k nearest of ``whole``; fewer if there are fewer."""
    return whole.withColumn("frechet", frechet_to(query, T.xs("pts"), T.ys("pts"))).select("id", "n_points", "frechet").orderBy("frechet", "id").limit(k)


def farthest(layout: Layout, query: Query) -> float:
    """No trajectory of the layout is farther from the query than this."""
    g, b = layout.grid, box_of(query)
    return math.hypot(max(g.max_x, b[2]) - min(g.min_x, b[0]), max(g.max_y, b[3]) - min(g.min_y, b[1]))


def nearest(found: Callable[[float], DataFrame], layout: Layout, query: Query, k: int, first: float | None = None) -> DataFrame:
    """The k nearest by range searches of growing radius. ``found`` gives (id, n_points, pts) of at least the trajectories
    within a radius, reading no more than it has to.

    The radius begins at a cell's size and grows fourfold until k are found. If the k-th is nearer than the radius, these are
    the nearest; otherwise one more search, within the k-th one's distance, has them all. Only k rows reach the driver.
    """
    g = layout.grid
    most = farthest(layout, query)
    radius = min(most, first or max(g.max_x - g.min_x, g.max_y - g.min_y) / g.n)
    while True:
        ranked = rank(found(radius), query, k)
        rows = ranked.collect()
        if radius >= most or (len(rows) == k and rows[-1]["frechet"] <= radius):
            return layout.spark.createDataFrame(rows, ranked.schema)
        radius = min(most, rows[-1]["frechet"] if len(rows) == k else 4 * radius)


def knn(layout: Layout, query: Query, k: int) -> DataFrame:
    """The k nearest: complete candidates from the metadata of the cells near the query, then whole trajectories by id."""
    if not query or k <= 0:
        return rank(layout.whole.where("false"), query or [(0.0, 0.0)], 0)
    return nearest(lambda eps: layout.whole.join(candidate_ids(layout, query, eps, "pivot"), "id", "left_semi"), layout, query, k)


def knn_reassembled(layout: Layout, query: Query, k: int) -> DataFrame:
    """The same without the table of whole trajectories: the tracklets of the cells near the query are put together."""
    if not query or k <= 0:
        return knn(layout, query, k)
    return nearest(lambda eps: T.reassemble(near_tracklets(layout, query, eps, "pivot")).select("id", "n_points", "pts"), layout, query, k)
