"""Range search: all trajectories whose discrete Frechet distance to the query is at most eps.

One pipeline with three knobs stands for the whole family: the predicate that reaches the scan, the local filter on
tracklets, and where it stops (exact, approximate, or counters of each step).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frechet import frechet_within
from ..functions.geometry import FEW, any_of, nearest_to_query, rect_to_query, within
from ..plans.predicates import Query, box_of, overlaps, pushdown, query_cells
from ..sources.layout import Layout
from . import trajectories as T


def _rect() -> list[Column]:
    return [F.col(c) for c in T.RECT]


def endpoint_filter(query: Query, eps: float) -> Column:
    """A first tracklet begins, and a last one ends, within eps of the query's ends."""
    first = (F.col("seq_start") > 1) | within(F.col("first_pt"), query[0], eps)
    return first & (~F.col("is_last") | within(F.col("last_pt"), query[-1], eps))


def local_filter(kind: str, query: Query, eps: float) -> Column:
    """dist: every point is within eps of a vertex; pivot: every pivot is; mbr: the box is."""
    if kind == "mbr":
        return rect_to_query(_rect(), query) <= F.lit(eps)
    return F.forall("pts" if kind == "dist" else "pivots", lambda p: nearest_to_query(p, query) <= F.lit(eps))


def gap_filter(cells: list[set[int]]) -> Column:
    """Each vertex has a cell near it that the trajectory visits; not asked of trajectories of one tracklet."""
    asked = sorted({tuple(sorted(own)) for own in cells})
    if len(asked) > FEW:  # one folded literal, so that the plan stays small
        every = F.from_json(F.lit(json.dumps(asked)), "array<array<bigint>>")
        return (F.col("n_tracklets") == 1) | F.forall(every, lambda own: F.arrays_overlap(own, F.col("cells")))
    missed = [~F.arrays_overlap("cells", F.array(*[F.lit(c).cast("long") for c in own])) if own else F.lit(True) for own in asked]
    return (F.col("n_tracklets") == 1) | ~any_of(missed)


def exact(df: DataFrame, query: Query, eps: float) -> DataFrame:
    """The rows whose trajectory is within eps, decided without computing the distance."""
    return df.where(frechet_within(query, eps, T.xs("pts"), T.ys("pts")))


def brute_force(whole: DataFrame, query: Query, eps: float) -> DataFrame:
    """(id, n_points) from whole trajectories without an index."""
    return exact(whole.select("id", "n_points", "pts"), query, eps).select("id", "n_points")


def range_query(layout: Layout, query: Query, eps: float, variant: str = "v2", local: str = "dist", is_exact: bool = True, flat: bool = False) -> DataFrame:
    """(id, n_points) of the trajectories within eps; without ``is_exact`` of a superset, the candidates.

    Only the cells near the query's vertices are read. ``flat`` reads the layout without cell directories and asks for no
    cells. An empty query or a negative eps gives no rows.
    """
    if not query or eps < 0:
        return layout.whole.select("id", "n_points").where("false")
    cells = query_cells(layout.grid, query, eps)
    every = sorted(set().union(*cells))
    scan = layout.flat if flat else layout.tracks.where(F.col("cell").isin(every) if every else F.lit(False))
    kept = scan.where(pushdown(variant, layout.grid, query, eps)).where(endpoint_filter(query, eps)).where(local_filter(local, query, eps))
    candidates = T.reassemble(kept, F.collect_set("cell").alias("cells"))
    if not flat:
        candidates = candidates.where(gap_filter(cells))
    return (exact(candidates, query, eps) if is_exact else candidates).select("id", "n_points")


def near_tracklets(layout: Layout, query: Query, eps: float, local: str) -> DataFrame:
    """Tracklets, of the cells near the query only, that pass the box, endpoint and local filters."""
    every = sorted(set().union(*query_cells(layout.grid, query, eps)))
    scan = layout.tracks.where(F.col("cell").isin(every) if every else F.lit(False))
    return scan.where(overlaps(box_of(query), eps)).where(endpoint_filter(query, eps)).where(local_filter(local, query, eps))


def candidate_ids(layout: Layout, query: Query, eps: float, local: str = "mbr") -> DataFrame:
    """Ids of the trajectories all of whose tracklets pass, from metadata without points."""
    meta = near_tracklets(layout, query, eps, local)
    grouped = meta.groupBy("id").agg(F.min("seq_start").alias("_first"), F.max("seq_end").alias("_end"), F.bool_or("is_last").alias("_last"), F.sum("n_points").alias("_n"))
    return grouped.where("_first = 1 and _last and _n = _end").select("id")


def two_phase(layout: Layout, query: Query, eps: float, local: str = "mbr") -> DataFrame:
    """(id, n_points): candidates from tracklet metadata without points, then whole trajectories by a semi join on the id.

    Whether the id list is broadcast is left to the optimizer, which knows its size at run time.
    """
    if not query or eps < 0:
        return layout.whole.select("id", "n_points").where("false")
    return exact(layout.whole.join(candidate_ids(layout, query, eps, local), "id", "left_semi"), query, eps).select("id", "n_points")


def funnel(layout: Layout, query: Query, eps: float, variant: str = "v2", local: str = "dist") -> DataFrame:
    """One row: cells, tracklets in them, and complete trajectories after no filter, the predicate, the endpoint, local and
    gap filters, and the exact test. One scan and one aggregation give all counts."""
    cells = query_cells(layout.grid, query, eps)
    every = sorted(set().union(*cells))
    flagged = layout.tracks.where(F.col("cell").isin(every)).select(
        "id", "cell", "seq_start", "seq_end", "is_last", "n_points", "pts", pushdown(variant, layout.grid, query, eps).alias("_a"), endpoint_filter(query, eps).alias("_b"), local_filter(local, query, eps).alias("_c")
    )
    steps = {"none": F.lit(True), "predicate": F.col("_a"), "endpoints": F.col("_a") & F.col("_b"), "local": F.col("_a") & F.col("_b") & F.col("_c")}
    # the ends are at known places, so a sum of the points that are left tells whether any tracklet is missing
    left = [F.sum(F.when(c, F.col("n_points")).otherwise(0)).alias(f"_n_{k}") for k, c in steps.items()]
    by_id = flagged.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_tracklets"), F.max(F.when(F.col("is_last"), F.col("seq_end"))).alias("_end"), F.collect_set("cell").alias("cells"),
        F.array_sort(F.collect_list(F.struct("seq_start", "pts"))).alias("_parts"), *left,
    )
    whole = by_id.select(
        "n_tracklets", *[(F.coalesce(F.col("_end"), F.lit(-1)) == F.col(f"_n_{k}")).alias(k) for k in steps], gap_filter(cells).alias("_gap"), F.flatten(F.transform("_parts", lambda r: r["pts"])).alias("pts")
    ).withColumn("gap", F.col("local") & F.col("_gap"))
    close = frechet_within(query, eps, T.xs("pts"), T.ys("pts"))
    counted = whole.withColumn("exact", F.when(F.col("gap"), close).otherwise(F.lit(False)))
    return counted.agg(F.lit(len(every)).cast("long").alias("n_cells"), F.coalesce(F.sum("n_tracklets"), F.lit(0)).alias("n_tracklets"), *[F.count_if(k).alias(f"after_{k}") for k in (*steps, "gap", "exact")])
