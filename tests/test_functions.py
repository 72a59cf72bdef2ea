import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trajlake.functions import frechet as kernels
from trajlake.functions import geometry as geo
from trajlake.functions import grid as G
from trajlake.functions import polyline
from trajlake.functions.frechet import frechet_between, frechet_native, frechet_to
from trajlake.functions.polyline import chord_boxes, point_to_boxes, simplify
from trajlake.operators import quadtree, segments
from trajlake.operators import trajectories as T


def frechet(p, q):
    """The definition, cell by cell."""
    c = {}
    for i, a in enumerate(p):
        for j, b in enumerate(q):
            d = float(np.hypot(a[0] - b[0], a[1] - b[1]))
            before = [c[k] for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)) if k in c]
            c[i, j] = max(d, min(before)) if before else d
    return c[len(p) - 1, len(q) - 1]


def test_golden_codes():
    assert G.quad_code([3, 3], 2) == 20 and G.quad_code([0, 3], 2) == 5
    assert [G.quad_code([0, d], 2) for d in range(4)] == [2, 3, 4, 5]
    assert G.quad_code([3, 1], 3) == 70 and G.quad_code([3, 1, 0], 3) == 71 and G.quad_code([3, 2], 3) == 75 and G.subtree(2) == 5
    assert [G.packed_key(5, 0, 2), G.packed_key(5, 3, 2), G.packed_key(6, 0, 2)] == [20, 23, 24]
    assert [G.packed_key(5, 0, 9), G.packed_key(5, 511, 9), G.packed_key(6, 0, 9)] == [2560, 3071, 3072]


def test_hilbert_is_a_walk_through_all_cells(spark):
    df = spark.range(64).select((F.col("id") % 8).cast("int").alias("ix"), (F.col("id") / 8).cast("int").alias("iy"))
    got = {r["d"]: (r["ix"], r["iy"]) for r in df.select("ix", "iy", G.hilbert_column(F.col("ix"), F.col("iy"), 3).alias("d")).collect()}
    assert sorted(got) == list(range(64))
    assert all(abs(got[i][0] - got[i + 1][0]) + abs(got[i][1] - got[i + 1][1]) == 1 for i in range(63))
    assert all(G.hilbert(x, y, 3) == d for d, (x, y) in got.items())


def test_frechet_kernels_follow_the_definition(spark):
    r = random.Random(1)
    walks = [[(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(r.randint(1, 12))] for _ in range(60)]
    query = walks[7]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in w], [{"x": x, "y": y} for x, y in walks[-1 - i]]) for i, w in enumerate(walks)], "id int, pts array<struct<x:double,y:double>>, other array<struct<x:double,y:double>>")
    rows = df.select("id", frechet_to(query, T.xs("pts"), T.ys("pts")).alias("a"), frechet_native(F.col("pts"), query).alias("b"), frechet_between(T.xs("pts"), T.ys("pts"), T.xs("other"), T.ys("other")).alias("c")).collect()
    for row in rows:
        assert row["a"] == pytest.approx(frechet(walks[row["id"]], query), abs=1e-12) == row["b"]
        assert row["c"] == pytest.approx(frechet(walks[row["id"]], walks[-1 - row["id"]]), abs=1e-12)
    assert next(x["a"] for x in rows if x["id"] == 7) == 0


def test_geometry(spark):
    rect = [F.lit(v) for v in (2.0, 2.0, 4.0, 6.0)]
    one = spark.range(1).select(
        geo.point_rect((0.0, 2.0), rect).alias("a"), geo.point_segment((0.0, 1.0), (-1.0, 0.0), (1.0, 0.0)).alias("b"), geo.segment_crosses_rect((0.0, 0.0), (5.0, 5.0), rect).alias("c"),
        geo.segment_rect((0.0, 0.0), (0.0, 9.0), rect).alias("d"), geo.clip_segment((0.0, 4.0), (8.0, 4.0), rect).alias("e"), geo.segments_intersect((0.0, 0.0), (2.0, 2.0), (0.0, 2.0), (2.0, 0.0)).alias("f"),
        geo.in_cell((4.0, 3.0), rect).alias("g"), geo.within((0.0, 0.0), (0.0, 0.0), -1.0).alias("h"), geo.segments_intersect((0.0, 0.0), (1.0, 0.0), (2.0, 0.0), (3.0, 0.0)).alias("i"),
        geo.times_overlap(F.lit(1), F.lit(2), F.lit(2), F.lit(3)).alias("j"), geo.time_at(F.lit(1.0), F.lit(0.0), F.lit(10.0), F.lit(2.0), F.lit(20.0)).alias("k"),
    ).first()
    assert (one["a"], one["b"], one["c"], one["d"]) == (2.0, 1.0, True, 2.0)
    assert tuple(one["e"]) == (2.0, 4.0, 4.0, 4.0)
    assert (one["f"], one["g"], one["h"], one["i"], one["j"], one["k"]) == (True, False, False, False, True, 15.0)


def test_polyline_boxes_hold_their_points():
    pts = np.cumsum(np.random.default_rng(3).normal(size=(60, 2)), 0)
    kept = simplify(pts, 0.5)
    boxes = chord_boxes(pts, kept)
    assert kept[0] == 0 and kept[-1] == 59 and len(boxes) == len(kept) - 1
    for k, (a, b) in enumerate(zip(kept[:-1], kept[1:], strict=True)):
        assert point_to_boxes(pts[a : b + 1], boxes[k : k + 1]).max() < 1e-9
    assert pd.Series(simplify(np.array([[0, 0], [1, 0.001], [2, 0]]))).tolist() == [0, 2]


def test_decision_kernel_against_the_distance():
    r = np.random.default_rng(7)
    for n, m in ((1, 1), (5, 3), (4, 62), (9, 63), (7, 64), (30, 140)):
        px, py = r.normal(size=(40, n)).cumsum(1), r.normal(size=(40, n)).cumsum(1)
        for shared in (True, False):
            qx, qy = (r.normal(size=(1 if shared else 40, m)).cumsum(1) for _ in range(2))
            if not shared and n == m:
                qx[::2], qy[::2] = px[::2] + 0.01, py[::2]
            d = kernels._table(px, py, qx, qy)
            for eps in (0.0, *np.quantile(d, [0.1, 0.5, 0.9]), float(d[0])):
                assert (kernels.reachable(px, py, qx, qy, eps) == (d <= eps)).all()


def test_kernels_on_empty_and_null_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], [0.0, 0.0]), (2, [], []), (3, None, None), (4, [5.0], [5.0])], "id int, x array<double>, y array<double>")
    q = [(0.0, 0.0), (1.0, 0.0)]
    rows = df.select("id", kernels.frechet_to(q, F.col("x"), F.col("y")).alias("d"), kernels.frechet_within(q, 0.5, F.col("x"), F.col("y")).alias("w"), kernels.frechet_within([], 9.0, F.col("x"), F.col("y")).alias("e"),
                     kernels.frechet_between(F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("b"), kernels.within_between(0.0, F.col("x"), F.col("y"), F.col("x"), F.col("y")).alias("wb")).orderBy("id").collect()
    assert [(r["d"] == 0.0 if r["d"] is not None else None, r["w"], r["e"], r["b"], r["wb"]) for r in rows] == [(True, True, False, 0.0, True), (None, False, False, None, False), (None, False, False, None, False), (False, False, False, 0.0, True)]


def test_curve_there_and_back(spark):
    for bits in (1, 3, 5):
        side = spark.range(1 << bits)
        both = side.select(F.col("id").cast("int").alias("ix")).crossJoin(side.select(F.col("id").cast("int").alias("iy")))
        back = both.withColumn("cell", G.hilbert_column(F.col("ix"), F.col("iy"), bits)).withColumn("p", G.hilbert_place(F.col("cell"), bits))
        assert back.where("p.ix <> ix or p.iy <> iy").count() == 0 and back.select("cell").distinct().count() == 4**bits


def test_clipping_in_space_and_time(spark):
    row = spark.createDataFrame([((0.0, 0.0, 0.0), (10.0, 10.0, 100.0))], "a struct<x double, y double, t double>, b struct<x double, y double, t double>")
    rect, box = [F.lit(v) for v in (2.0, 1.0, 5.0, 4.0)], [F.lit(v) for v in (2.0, 1.0, 30.0, 5.0, 4.0, 90.0)]
    far = [F.lit(v) for v in (2.0, 1.0, 90.0, 5.0, 4.0, 95.0)]
    got = row.select(geo.clip_timed_segment(F.col("a"), F.col("b"), rect).alias("c"), geo.clip_solid_segment(F.col("a"), F.col("b"), box).alias("s"), geo.segment_crosses_box(F.col("a"), F.col("b"), far).alias("f"), geo.clip_solid_segment(F.col("a"), F.col("b"), far).alias("n")).first()
    assert tuple(got["c"]) == (2.0, 2.0, 20, 4.0, 4.0, 40) and tuple(got["s"]) == (3.0, 3.0, 30.0, 4.0, 4.0, 40.0) and got["f"] is False and got["n"] is None


def test_trajectories_and_rectangles(spark):
    df = spark.createDataFrame([(1, [(0.0, 0.0), (10.0, 0.0)]), (2, [(0.0, 9.0), (10.0, 9.0)]), (3, [(4.0, 4.0)])], "id int, pts array<struct<x double, y double>>")
    rect = [F.lit(v) for v in (3.0, -1.0, 5.0, 5.0)]
    got = df.select(geo.trajectory_crosses_rect("pts", rect), geo.trajectory_near_rect("pts", rect, 4.0), geo.trajectory_near_rect("pts", rect, 3.9), F.size(geo.legs("pts"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True, 1), (False, True, False, 1), (False, False, False, 0)]
    assert df.select(geo.trajectory_minmax("pts", rect).alias("m")).first()["m"] > 5
    x = spark.range(1).select(geo.intersection((0, 0), (4, 4), (0, 4), (4, 0)).alias("a"), geo.intersection((0, 0), (1, 1), (0, 4), (4, 0)).alias("b"), geo.intersection((0, 0), (1, 1), (0, 1), (1, 2)).alias("c")).first()
    assert tuple(x["a"]) == (2.0, 2.0) and x["b"] is None and x["c"] is None


def test_polygons():
    square = np.array([[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]])
    assert polyline.in_polygon(np.array([[1.0, 1.0], [2.0, 0.5], [2.1, 1.0]]), square).tolist() == [True, True, False]
    assert polyline.in_polygon(np.array([[1.0, 1.0]]), square[::-1]).all()
    p = lambda *v: np.array(v, float)
    assert polyline.segment_to_polygon(p(-1, 1), p(3, 1), square) == 0 and polyline.segment_to_polygon(p(3, 0), p(3, 9), square) == 1
    assert polyline.segment_to_polygon(p(5, 6), p(8, 6), square) == 5.0
    assert polyline.box_to_boxes(square + p(3, 0), np.stack([square, square + p(100, 0)])) == 3.0 and polyline.box_to_boxes(square, np.stack([square])) == 0


def test_ranges_of_quadrants():
    bounds = (0.0, 0.0, 8.0, 8.0)
    exact = segments.key_ranges((1.0, 1.0, 2.0, 2.0), bounds, 4)
    few = segments.key_ranges((1.0, 1.0, 2.0, 2.0), bounds, 4, most=6)
    codes = lambda ranges: {c for lo, hi in ranges for c in range(lo, hi)}
    assert codes(exact) < codes(few) and len(few) <= len(exact) and codes(segments.key_ranges((-1.0, -1.0, 20.0, 20.0), bounds, 4)) == set(range(G.subtree(5)))
    assert G.ranges_of([1, 2, 3, 7, 9]) == [(1, 4), (7, 8), (9, 10)] and G.ranges_of([1, 2, 3, 7, 9], 2) == [(1, 4), (7, 10)]
    assert codes(quadtree.window_ranges((0.0, 0.0, 0.1, 0.1), bounds, 2)) == {c << 9 | k for c in (0, 1, 2) for k in range(512)}
