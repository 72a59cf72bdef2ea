"""Batch range search: many queries at once, as equi-joins on the cells of both ends."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions.frechet import Lists, within_between
from ..functions.geometry import distance
from ..sources.layout import Layout
from . import trajectories as T

#: An end's cell is this fraction of eps wide; a query meets the cells within eps of its own end.
FINENESS = 2
#: Ids that one row of equal trajectories holds; more of them give more rows.
MEMBERS = 256


def _places(of: DataFrame, own: Column, other: Column, cell: float, reach: int = 0) -> DataFrame:
    """``of`` with _fx, _fy, _lx, _ly, the cells of the first and last point; with ``reach`` a row for each combination nearby."""
    for name, v in (("_fx", own["x"]), ("_fy", own["y"]), ("_lx", other["x"]), ("_ly", other["y"])):
        at = F.floor(v / F.lit(cell))
        of = of.withColumn(name, F.explode(F.sequence(at - reach, at + reach)) if reach else at)
    return of


def _equal_to_previous(h: np.ndarray, columns: list[Lists]) -> np.ndarray:
    """Is each row the one before it, in all of its values? ``h`` is a hash of them, which only spares comparisons."""
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    for c in columns:
        same[1:] &= c.lengths[1:] == c.lengths[:-1]
        rows = np.flatnonzero(same)
        n = c.lengths[rows]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = c.values[np.repeat(c.begin[rows], n) + place] != c.values[np.repeat(c.begin[rows - 1], n) + place]
        same[rows] = np.bincount(np.repeat(np.arange(len(rows)), n), differ, len(rows)) == 0
    return same


def _merged(key: str, members: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            new = ~_equal_to_previous(b.column("_h").to_numpy(zero_copy_only=False), [Lists(b.column("_u")), Lists(b.column("_v"))])
            at = np.arange(len(new))
            new |= (at - np.maximum.accumulate(np.where(new, at, 0))) % members == 0
            heads = np.flatnonzero(new)
            ids = pa.ListArray.from_arrays(pa.array(np.append(heads, len(new)), pa.int32()), b.column(key))
            yield pa.RecordBatch.from_arrays([b.column("_u").take(pa.array(heads)), b.column("_v").take(pa.array(heads)), ids], ["_u", "_v", "_ids"])

    return merge


def classes(of: DataFrame, key: str) -> DataFrame:
    """(_u, _v, _ids): the x and y of rows (``key``, pts) that have points, each with the keys of up to ``MEMBERS`` rows of just these points.

    Equal trajectories meet by a hash of their points. A class too large for one task is split, as are those that lie in two
    batches or have more members: every row is in one class, but a trajectory can have several.
    """
    rows = of.where(F.size("pts") > 0).select(key, T.xs("pts").alias("_u"), T.ys("pts").alias("_v")).withColumn("_h", F.xxhash64("_u", "_v"))
    numbers = S.ArrayType(S.DoubleType())
    schema = S.StructType([S.StructField("_u", numbers), S.StructField("_v", numbers), S.StructField("_ids", S.ArrayType(of.schema[key].dataType))])
    return rows.hint("rebalance", "_h").sortWithinPartitions("_h").mapInArrow(_merged(key, MEMBERS), schema)


def _described(of: DataFrame, prefix: str) -> DataFrame:
    """Points, ends (p1, pn) and box (a, b, c, d) of classes, their names after ``prefix``."""
    at = lambda i: F.struct(F.try_element_at("_u", F.lit(i)).alias("x"), F.try_element_at("_v", F.lit(i)).alias("y"))
    cols = {"u": F.col("_u"), "v": F.col("_v"), "ids": F.col("_ids"), "p1": at(1), "pn": at(-1), "a": F.array_min("_u"), "b": F.array_min("_v"), "c": F.array_max("_u"), "d": F.array_max("_v")}
    return of.select(*[c.alias(f"_{prefix}{n}") for n, c in cols.items()])


def batch_range(layout: Layout, queries: DataFrame, eps: float) -> DataFrame:
    """(qid, id) of all pairs within eps, for ``queries`` (qid, pts), among the trajectories of a layout; see :func:`pairs_within`."""
    return pairs_within(layout.whole, queries, eps)


def pairs_within(whole: DataFrame, queries: DataFrame, eps: float) -> DataFrame:
    """(qid, id) of all pairs within eps, for ``queries`` (qid, pts) and trajectories (id, pts); a negative eps gives none.

    Trajectories of equal points are decided once (:func:`classes`), so the work follows the pairs of different ones; only the
    result lists all. A pair within eps has its first points within eps, its last points too, and every point of either within
    eps of the other's box. First and last points are matched by an equi-join on cells of half eps, so a busy place is dealt out
    by where trajectories lead; the boxes are compared in the join; what is left is decided by the early-stopping kernel. A
    trajectory is shuffled to its class and a class once, with its points; a class of queries once for each of the cells near its ends.
    """
    if eps < 0:
        return queries.select("qid").crossJoin(whole.select("id").limit(0)).where("false")
    own, asked = _described(classes(whole, "id"), "o"), _described(classes(queries, "qid"), "q")
    keys = ["_fx", "_fy", "_lx", "_ly"]
    if eps == 0:
        cell, reach = 1.0, 0
    else:
        cell, reach = eps / FINENESS, FINENESS
    near = _places(asked, F.col("_qp1"), F.col("_qpn"), cell, reach)
    if reach:  # cells that no point within eps can lie in
        gap = lambda c, v: F.greatest(F.col(c) * cell - v, F.lit(0.0), v - (F.col(c) + 1) * cell)
        for x, y, p in (("_fx", "_fy", "_qp1"), ("_lx", "_ly", "_qpn")):
            dx, dy = gap(x, F.col(p)["x"]), gap(y, F.col(p)["y"])
            near = near.where(F.sqrt(dx * dx + dy * dy) <= F.lit(eps * (1 + 1e-9)))
    e, slack, fits = F.lit(eps), F.lit(eps * (1 + 1e-9)), F.lit(True)
    for side in "abcd":
        fits &= F.abs(F.col(f"_o{side}") - F.col(f"_q{side}")) <= slack
    fits &= (distance(F.col("_op1"), F.col("_qp1")) <= e) & (distance(F.col("_opn"), F.col("_qpn")) <= e)
    pairs = _places(own, F.col("_op1"), F.col("_opn"), cell).join(near, keys).where(fits)
    found = pairs.where(within_between(eps, F.col("_ou"), F.col("_ov"), F.col("_qu"), F.col("_qv")))
    return found.select(F.explode("_qids").alias("qid"), "_oids").select("qid", F.explode("_oids").alias("id"))
