"""Quadtree index with occupancy shapes: home-quadrant code and a bit for each visited sub-cell, packed in one key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.frechet import frechet_within
from ..functions.geometry import any_of, vertices, within
from ..functions.grid import PAD, code_column, home_digits, merged_ranges, occupancy, quad_ranges
from ..functions.polyline import boxes_apart, chord_boxes, simplify
from ..plans.predicates import Query
from ..sources.layout import Layout
from . import trajectories as T
from .knn import nearest, rank
from .range_query import exact

G, ALPHA, BETA = 6, 3, 3


def space(layout: Layout) -> tuple[float, float, float, float]:
    g = layout.grid
    return g.min_x - PAD, g.min_y - PAD, g.max_x, g.max_y


def with_keys(trajectories: DataFrame, bounds: tuple[float, float, float, float], g: int = G, alpha: int = ALPHA, beta: int = BETA) -> DataFrame:
    """Adds quad (code), level, shape (bits of visited sub-cells, ``alpha`` rows of ``beta``), key, and the quadrant's box."""
    width, height = bounds[2] - bounds[0], bounds[3] - bounds[1]
    df = trajectories.withColumn("_home", home_digits([F.col(c) for c in T.RECT], bounds, g))
    df = df.withColumns({"quad": code_column(F.col("_home.digits"), g), "level": F.size("_home.digits")})
    df = df.withColumns({"quad_x": F.lit(bounds[0]) + F.col("_home.x") * width, "quad_y": F.lit(bounds[1]) + F.col("_home.y") * height, "quad_w": F.col("_home.w") * width, "quad_h": F.col("_home.w") * height})
    df = df.withColumn("shape", occupancy(F.col("pts"), F.col("quad_x"), F.col("quad_y"), F.col("quad_w"), F.col("quad_h"), beta, alpha))
    return df.withColumn("key", F.shiftleft(F.col("quad"), alpha * beta).bitwiseOR(F.col("shape"))).drop("_home")


def dp_features(trajectories: DataFrame) -> DataFrame:
    """Adds dp_idx (kept vertices, from 0) and dp_boxes (8 numbers a chord)."""
    names = trajectories.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            idx, boxes = [], []
            for pts in pdf["pts"]:
                own = np.array([[p["x"], p["y"]] for p in pts], float)
                kept = simplify(own)
                idx.append(kept)
                boxes.append(chord_boxes(own, kept).ravel().tolist())
            yield pdf[names].assign(dp_idx=idx, dp_boxes=boxes)

    more = [StructField("dp_idx", ArrayType(IntegerType())), StructField("dp_boxes", ArrayType(DoubleType()))]
    return trajectories.mapInPandas(run, StructType([*trajectories.schema.fields, *more]))


def write_shapes(layout: Layout) -> Layout:
    """Records sorted by key, and beside them the present keys with their quadrant's box and number of records."""
    keyed = dp_features(with_keys(layout.whole, space(layout)))
    keyed.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{layout.path}/shapes")
    present = layout.shapes.groupBy("key", "quad", "shape", "quad_x", "quad_y", "quad_w", "quad_h").agg(F.count(F.lit(1)).alias("n"))
    present.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{layout.path}/shape_keys")
    return layout


def rect_near(x: Column, y: Column, w: Column, h: Column, query: Query, eps: float) -> Column:
    """Is a vertex of the query within eps of the box? Folded over an array, so that generated code stays small."""

    def near(q: Column) -> Column:
        dx = F.greatest(x - q["x"], F.lit(0.0), q["x"] - x - w)
        dy = F.greatest(y - q["y"], F.lit(0.0), q["y"] - y - h)
        return F.sqrt(dx * dx + dy * dy) <= F.lit(eps + 1e-9)

    return F.exists(vertices(query), near)


def _parts():
    """The sub-cells' numbers, their boxes and whether they are visited, of a row's key."""
    w, h = F.col("quad_w") / BETA, F.col("quad_h") / ALPHA
    x, y = lambda i: F.col("quad_x") + w * (i % BETA), lambda i: F.col("quad_y") + h * F.floor(i / BETA)
    visited = lambda i: F.call_function("shiftright", F.col("shape"), i).bitwiseAND(F.lit(1)) == 1
    return F.sequence(F.lit(0), F.lit(ALPHA * BETA - 1)), x, y, w, h, visited


def candidate_keys(keys: DataFrame, query: Query, eps: float) -> DataFrame:
    """The present keys (key, shape, quad box) all of whose visited sub-cells lie within eps of a vertex of the query."""
    cells, x, y, w, h, visited = _parts()
    whole = rect_near(F.col("quad_x"), F.col("quad_y"), F.col("quad_w"), F.col("quad_h"), query, eps)
    return keys.where(whole).where(F.forall(cells, lambda i: ~visited(i) | rect_near(x(i), y(i), w, h, query, eps)))


def window_keys(keys: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The present keys one of whose visited sub-cells meets a window."""
    cells, x, y, w, h, visited = _parts()
    meets = lambda i: (x(i) <= box[2]) & (x(i) + w >= box[0]) & (y(i) <= box[3]) & (y(i) + h >= box[1])
    return keys.where(F.exists(cells, lambda i: visited(i) & meets(i)))


def _packed(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [(lo << ALPHA * BETA, hi << ALPHA * BETA) for lo, hi in ranges]


def window_ranges(box: tuple[float, float, float, float], bounds: tuple[float, float, float, float], g: int = G, most: int | None = 100_000) -> list[tuple[int, int]]:
    """Half-open ranges of the packed keys of all quadrants that meet a window."""
    meets = lambda q: q[0] <= box[2] and q[1] <= box[3] and q[2] >= box[0] and q[3] >= box[1]
    holds = lambda q: q[0] >= box[0] and q[1] >= box[1] and q[2] <= box[2] and q[3] <= box[3]
    return _packed(quad_ranges(bounds, g, meets, holds, most))


def frechet_ranges(query: Query, eps: float, bounds: tuple[float, float, float, float], g: int = G, most: int | None = None) -> list[tuple[int, int]]:
    """Half-open ranges of the packed keys of all quadrants within eps of a vertex of the query, without the present keys."""
    far = lambda q, p: math.hypot(max(q[0] - p[0], 0.0, p[0] - q[2]), max(q[1] - p[1], 0.0, p[1] - q[3]))
    return _packed(quad_ranges(bounds, g, lambda q: any(far(q, p) <= eps + 1e-9 for p in query), lambda q: False, most))


def candidate_ranges(layout: Layout, query: Query, eps: float) -> list[tuple[int, int]]:
    """Half-open key ranges that hold all candidate keys and no other present key.

    The present keys are numbered in their order: their number is bounded by the index's resolution, not by the data.
    """
    by_key = Window.orderBy("key")
    kept = candidate_keys(layout.shape_keys.withColumn("_rank", F.row_number().over(by_key)), query, eps)
    runs = kept.withColumn("_run", F.col("_rank") - F.row_number().over(by_key)).groupBy("_run").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    return merged_ranges([(r["lo"], r["hi"] + 1) for r in runs.collect()])


#: Ranges that reach the scan at most; of more, neighbours are united and the keys between them left to a semi join.
MOST_RANGES = 256


def records(layout: Layout, query: Query, eps: float) -> DataFrame:
    """The records of the candidate keys, read by key ranges."""
    ranges = candidate_ranges(layout, query, eps)
    pushed = layout.shapes.where(any_of([(F.col("key") >= lo) & (F.col("key") < hi) for lo, hi in merged_ranges(ranges, MOST_RANGES)]))
    if len(ranges) <= MOST_RANGES:
        return pushed
    return pushed.join(candidate_keys(layout.shape_keys, query, eps).select("key"), "key", "left_semi")


def _box_filter(query: Query, eps: float):
    q = np.array(query, float)
    kept = simplify(q)
    boxes, vertices = chord_boxes(q, kept), q[kept]

    @F.pandas_udf("boolean")
    def close(pts: pd.Series, idx: pd.Series, own: pd.Series) -> pd.Series:
        out = []
        for p, i, b in zip(pts, idx, own, strict=True):
            at = [p[k] for k in i]
            out.append(not boxes_apart(vertices, boxes, np.array([[v["x"], v["y"]] for v in at], float), np.asarray(b, float).reshape(-1, 4, 2), eps))
        return pd.Series(out)

    return close("pts", "dp_idx", "dp_boxes")


def _ends(query: Query, eps: float) -> Column:
    return within(F.get("pts", F.lit(0)), query[0], eps) & within(F.element_at("pts", -1), query[-1], eps)


def candidates(layout: Layout, query: Query, eps: float) -> DataFrame:
    """Records of candidate keys whose ends lie within eps of the query's."""
    return records(layout, query, eps).where(_ends(query, eps))


def range_query(layout: Layout, query: Query, eps: float) -> DataFrame:
    """(id, n_points) of the trajectories within eps."""
    if not query or eps < 0:
        return layout.shapes.select("id", "n_points").where("false")
    kept = candidates(layout, query, eps).where(_box_filter(query, eps))
    return exact(kept.select("id", "n_points", "pts"), query, eps).select("id", "n_points")


def funnel(layout: Layout, query: Query, eps: float) -> DataFrame:
    """One row: records of candidate keys, those whose ends fit, those within eps."""
    loaded = records(layout, query, eps).select(_ends(query, eps).alias("_ends"), frechet_within(query, eps, T.xs("pts"), T.ys("pts")).alias("_exact"))
    return loaded.agg(F.count(F.lit(1)).alias("loaded"), F.count_if("_ends").alias("after_endpoints"), F.count_if(F.col("_ends") & F.col("_exact")).alias("after_exact"))


def knn(layout: Layout, query: Query, k: int) -> DataFrame:
    """The k nearest: records of the candidate keys of a radius that grows until it holds k."""
    if not query or k <= 0:
        return rank(layout.shapes.where("false"), query or [(0.0, 0.0)], 0)
    return nearest(lambda eps: candidates(layout, query, eps), layout, query, k)


def knn_funnel(layout: Layout, query: Query, k: int) -> DataFrame:
    """One row: the counters of :func:`funnel` for the last radius that a search of the k nearest needs, the k-th distance."""
    rows = knn(layout, query, k).collect()
    return funnel(layout, query, rows[-1]["frechet"] if rows else -1.0)
