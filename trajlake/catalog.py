"""The registered queries over the test tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geometry as geo
from .functions.frechet import frechet_native
from .functions.grid import cells_in, hilbert_column
from .operators import batch, knn, quadtree, range_query, segments, tools
from .operators import trajectories as T
from .plans import oracle
from .sources.layout import Layout, new_folder, present_cells, write_flat, write_trajectories
from .sources.points import fixture_points, read_points, read_queries

#: The batch search has every trajectory whose id is divisible by BATCH_STEP as a query, against all trajectories.
BITS, EPS, K, BATCH_EPS, BATCH_STEP = 4, 20.25, 5, 8.25, 100
#: Radius for the queries of all points (49 to 86 of them) over scattered and over coherent trajectories.
EPS_OF = {"short": EPS, "medium": 200.37, "walk": 16000.37}
RECT, SEG = (3.0, 2.0, 20.0, 7.0), ((5.0, 1.0), (40.0, 9.0))

_layouts: dict[tuple, Layout] = {}


def layout(spark: SparkSession, sf_dir: str, *parts: str, fixture: str = "short") -> Layout:
    """The stored layouts of a fixture, written once for a session, with the asked-for extra tables."""
    key = (spark.sparkContext.applicationId, sf_dir, fixture)
    if key not in _layouts:
        _layouts[key] = write_trajectories(T.build_trajectories(fixture_points(spark, sf_dir, fixture)), new_folder(spark, fixture), BITS)
    for part in parts:
        if (*key, part) not in _layouts:
            _layouts[(*key, part)] = {"flat": write_flat, "shapes": quadtree.write_shapes, "segments": segments.write_segments}[part](_layouts[key])
    return _layouts[key]


def query_of(own: Layout, n: int | None = 4) -> list[tuple[float, float]]:
    """The trajectory with the smallest id, of those with n points."""
    row = (own.whole if n is None else own.whole.where(F.col("n_points") == n)).orderBy("id").select("pts").first()
    return [(p["x"], p["y"]) for p in row["pts"]] if row else []


def _trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.build_trajectories(fixture_points(spark, sf_dir)).select("id", "n_points", *T.RECT)


def _tracklets(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layout(spark, sf_dir)
    return T.tracklets(own.whole, own.grid).select("id", "ix", "iy", "seq_start", "seq_end", "is_last", "n_points", *T.RECT)


def _reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.reassemble(layout(spark, sf_dir).tracks).select("id", "n_points", "n_tracklets", F.round(F.aggregate("pts", F.lit(0.0), lambda a, p: a * 0.5 + p["x"] + p["y"]), 6).alias("check"))


def _pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(spark, sf_dir).tracks.select("id", "seq_start", F.explode("pivots").alias("p")).select("id", "seq_start", "p.x", "p.y")


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layout(spark, sf_dir)
    return tools.load_stats(own.whole, own.tracks, BITS)


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(spark, sf_dir).tracks.groupBy("ix", "iy").agg(F.count(F.lit(1)).alias("n"), F.min("min_x").alias("least_x"))


def _hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = spark.range(1 << BITS)
    both = side.select(F.explode(F.sequence(F.lit(0), F.lit((1 << BITS) - 1))).alias("iy"), F.col("id").cast("int").alias("ix"))
    return both.select("ix", "iy", hilbert_column(F.col("ix"), F.col("iy"), BITS).alias("cell"))


def _brute(spark: SparkSession, sf_dir: str, fixture: str = "short", n: int | None = 4, eps: float = EPS) -> DataFrame:
    own = layout(spark, sf_dir, fixture=fixture)
    return range_query.brute_force(own.whole, query_of(own, n), eps).select("id", "n_points")


def _native(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layout(spark, sf_dir)
    return own.whole.where(frechet_native(F.col("pts"), query_of(own)) <= EPS).select("id", "n_points")


def _range(variant: str, local: str, is_exact: bool, spark: SparkSession, sf_dir: str, fixture: str = "short", n: int | None = 4) -> DataFrame:
    own = layout(spark, sf_dir, fixture=fixture)
    return range_query.range_query(own, query_of(own, n), EPS_OF[fixture], variant, local, is_exact)


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layout(spark, sf_dir, "flat")
    return range_query.range_query(own, query_of(own), EPS, flat=True)


def _two_phase(local: str, spark: SparkSession, sf_dir: str, fixture: str = "short", n: int | None = 4) -> DataFrame:
    own = layout(spark, sf_dir, fixture=fixture)
    return range_query.two_phase(own, query_of(own, n), EPS_OF[fixture], local)


def _funnel(variant: str, local: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layout(spark, sf_dir)
    return range_query.funnel(own, query_of(own), EPS, variant, local)


def _indexed(f: Callable, part: str, value: float, spark: SparkSession, sf_dir: str, fixture: str = "short", n: int | None = 4) -> DataFrame:
    own = layout(spark, sf_dir, *([part] if part else []), fixture=fixture)
    out = f(own, query_of(own, n), value)
    return out.withColumn("frechet", F.round("frechet", 6)) if "frechet" in out.columns else out


def _knn_brute(spark: SparkSession, sf_dir: str, fixture: str = "short", n: int | None = 4) -> DataFrame:
    own = layout(spark, sf_dir, fixture=fixture)
    return knn.rank(own.whole, query_of(own, n), K).withColumn("frechet", F.round("frechet", 6))


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the stored trajectories if the session has them, else over those of the points: no other table of a layout is needed."""
    stored = _layouts.get((spark.sparkContext.applicationId, sf_dir, "short"))
    whole = stored.whole if stored else T.build_trajectories(fixture_points(spark, sf_dir))
    queries = whole.where(F.col("id") % BATCH_STEP == 0).select(F.col("id").alias("qid"), "pts")
    return batch.pairs_within(whole, queries, BATCH_EPS)


def _shape_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(spark, sf_dir, "shapes").shapes.select("id", "quad", "level", "shape", "key")


def _dp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(spark, sf_dir, "shapes").shapes.select("id", F.size("dp_idx").alias("n_kept"), (F.size("dp_boxes") / 8).cast("int").alias("n_boxes"))


def _signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(spark, sf_dir, "segments").segments.select("id", "seq_start", "seg_type", "key", "signature")


def _box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.box_count(fixture_points(spark, sf_dir), F.col("x"), F.col("y"), (10.0, 2.0, 30.0, 6.0))


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.struct((F.col("o_totalprice") / 10000).alias("x"), F.month("o_orderdate").cast("double").alias("y")).alias("p"))
    rect, box = [F.lit(v) for v in RECT], [F.col("p.x"), F.col("p.y"), F.col("p.x") + 1, F.col("p.y") + 2]
    end, c = F.struct((F.col("p.x") + 9).alias("x"), (F.col("p.y") - 4).alias("y")), F.col("p")
    r = lambda v, n: F.round(v, 6).alias(n)
    return p.select(
        "o_orderkey", r(geo.distance(c, SEG[0]), "point_point"), geo.within(c, SEG[0], 6.5).alias("near"), r(geo.point_rect(c, rect), "point_rect"), r(geo.point_rect_minmax(c, rect), "point_rect_minmax"),
        r(geo.point_segment(c, *SEG), "point_segment"), r(geo.rect_rect(box, rect), "rect_rect"), geo.in_box(c, rect).alias("inside"), geo.segment_crosses_rect(c, end, rect).alias("crosses"),
    )


def _sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.as_query_lines(T.sample_whole(layout(spark, sf_dir).whole, 1000))


def _sample_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.as_query_lines(T.sample_parts(layout(spark, sf_dir, fixture="medium").whole, 1000))


def _rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.rectangle_lines(tools.random_rectangles(spark, 1000, (1.0, 0.0, 50.0, 10.0), 0, 10**9, (5.0, 1.0, 10**6)))


def _xz_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(spark, sf_dir, "shapes").shapes.select("id", F.col("quad").alias("code"), "level")


def _from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points written as delimited text, read back and loaded."""
    path = new_folder(spark, "text")
    p = fixture_points(spark, sf_dir)
    p.select(F.concat_ws(";", F.col("id").cast("string"), F.date_format("t", "yyyy-MM-dd HH:mm:ss"), F.col("x").cast("string"), F.col("y").cast("string")).alias("value")).write.text(path)
    return T.build_trajectories(read_points(spark, path, 0, 2, 3, 1, ";")).select(F.col("id").cast("long").alias("id"), "n_points", *T.RECT)


def _query_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported query trajectories, read back: how many points and where they lie."""
    path = new_folder(spark, "queries")
    T.as_query_lines(T.sample_whole(layout(spark, sf_dir).whole, 1000)).write.text(path)
    pts = read_queries(spark, path).select(F.explode("pts").alias("p"))
    return pts.agg(F.count(F.lit(1)).alias("n"), F.min("p.x").alias("min_x"), F.max("p.x").alias("max_x"), F.round(F.sum("p.y"), 6).alias("sum_y"))


def _cell_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points of the tracklets in the grid cells that a rectangle meets."""
    own = layout(spark, sf_dir)
    return own.tracks.where(cells_in(own.grid, RECT)).agg(F.count(F.lit(1)).alias("n"), F.sum("n_points").alias("n_points"))


def _window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose quadrant meets a window, by key ranges, and those of them that visit it by their sub-cells."""
    own = layout(spark, sf_dir, "shapes")
    ranges = quadtree.window_ranges(RECT, quadtree.space(own))
    visiting = quadtree.window_keys(own.shape_keys.where(segments.in_ranges(ranges)), RECT).select("key")
    in_window = own.shapes.where(segments.in_ranges(ranges)).agg(F.count(F.lit(1)).alias("n_window"))
    return in_window.select("n_window", F.lit(own.shapes.join(visiting, "key", "left_semi").count()).alias("n_visiting"))


def _present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return present_cells(layout(spark, sf_dir)).agg(F.count(F.lit(1)).alias("n"))


LOCALS = {"dist": "dist", "mbr": "mbr", "pivot": "pivot"}
LONG = ("medium", "walk")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "load_trajectories": _trajectories, "load_stats": _stats, "tracklets": _tracklets, "tracklet_reassembly": _reassembly, "pivots": _pivots, "cell_counts": _cells, "present_cells": _present, "hilbert_cells": _hilbert,
    "load_text": _from_text, "query_text": _query_text, "cell_window": _cell_points, "shape_window": _window, "xz_code": _xz_code,
    "range_brute": _brute, "range_native": _native,
    **{f"range_{k}_{f}": partial(q, fixture=f, n=None) for f in LONG for k, q in {
        "brute": partial(_brute, eps=EPS_OF[f]), "mbr_v3": partial(_range, "v3", "mbr", True), "pivot_v2": partial(_range, "v2", "pivot", True), "pivot_twophase": partial(_two_phase, "pivot"),
        "xzshape": partial(_indexed, quadtree.range_query, "shapes", EPS_OF[f]), "segment": partial(_indexed, segments.range_query, "segments", EPS_OF[f])}.items()},
    **{f"range_{k}_{v}": partial(_range, v, k, True) for k in LOCALS for v in ("v1", "v2", "v3", "v4")},
    "range_mbr_twophase": partial(_two_phase, "mbr"), "range_pivot_twophase": partial(_two_phase, "pivot"), "range_flat": _flat,
    "range_xzshape": partial(_indexed, quadtree.range_query, "shapes", EPS), "range_segment": partial(_indexed, segments.range_query, "segments", EPS),
    **{f"range_approx_{k}_{v}": partial(_range, v, k, False) for k in LOCALS for v in ("v2", "v3")},
    **{f"funnel_{k}_{v}": partial(_funnel, v, k) for k in LOCALS for v in ("v2", "v3")},
    "funnel_xzshape": partial(_indexed, quadtree.funnel, "shapes", EPS),
    "knn_brute": _knn_brute, "knn_brute_customer": partial(_knn_brute, fixture="customer", n=4), "knn_grid": partial(_indexed, knn.knn, "", K), "knn_grid_reassembled": partial(_indexed, knn.knn_reassembled, "", K),
    **{f"knn_{k}_walk": partial(q, fixture="walk", n=None) for k, q in {"brute": _knn_brute, "grid": partial(_indexed, knn.knn, "", K), "xzshape": partial(_indexed, quadtree.knn, "shapes", K), "segment": partial(_indexed, segments.knn, "segments", K)}.items()},
    "examined_knn_xzshape": partial(_indexed, quadtree.knn_funnel, "shapes", K), "knn_xzshape": partial(_indexed, quadtree.knn, "shapes", K), "knn_segment": partial(_indexed, segments.knn, "segments", K),
    "batch_range": _batch, "shape_key": _shape_key, "segment_signature": _signature, "dp_features": _dp, "box_filter": _box, "geo_distances": _geo,
    "export_sample": _sample, "export_parts": _sample_parts, "gen_rectangles": _rectangles,
}

_range_sql, _knn_sql = oracle.range_sql(EPS), oracle.knn_sql(K)
_with_runs = f"WITH {oracle.points()}, {oracle.runs(BITS)}"
_gap = "greatest({a} - {v}, 0, {v} - {b})"


def _geo_sql() -> str:
    x0, y0, x1, y1 = RECT
    (ax, ay), (bx, by) = SEG
    t = f"greatest(0, least(1, ((x - {ax}) * {bx - ax} + (y - {ay}) * {by - ay}) / {(bx - ax) ** 2 + (by - ay) ** 2}))"
    sq = lambda v, a, b, near: f"power({v} - CASE WHEN {v} {'<=' if near else '>='} {(a + b) / 2} THEN {a} ELSE {b} END, 2)"
    # the segment (x, y) - (x + 9, y - 4) meets the rectangle when the ranges of its parameter on both axes and [0, 1] overlap
    return f"""SELECT o_orderkey, round(sqrt(power(x - {ax}, 2) + power(y - {ay}, 2)), 6) AS point_point, sqrt(power(x - {ax}, 2) + power(y - {ay}, 2)) <= 6.5 AS near,
round(sqrt(power(greatest({x0} - x, 0, x - {x1}), 2) + power(greatest({y0} - y, 0, y - {y1}), 2)), 6) AS point_rect,
round(sqrt(least({sq('x', x0, x1, True)} + {sq('y', y0, y1, False)}, {sq('x', x0, x1, False)} + {sq('y', y0, y1, True)})), 6) AS point_rect_minmax,
round(sqrt(power({ax} + {t} * {bx - ax} - x, 2) + power({ay} + {t} * {by - ay} - y, 2)), 6) AS point_segment,
round(sqrt(power(greatest({x0} - (x + 1), 0, x - {x1}), 2) + power(greatest({y0} - (y + 2), 0, y - {y1}), 2)), 6) AS rect_rect,
x BETWEEN {x0} AND {x1} AND y BETWEEN {y0} AND {y1} AS inside,
greatest(0, ({x0} - x) / 9, ({y1} - y) / -4) <= least(1, ({x1} - x) / 9, ({y0} - y) / -4) AS crosses
FROM (SELECT o_orderkey, o_totalprice / 10000 AS x, CAST(month(o_orderdate) AS DOUBLE) AS y FROM orders)"""


ORACLE_SQL: dict[str, str] = {
    "load_trajectories": f"WITH {oracle.points()} SELECT id, any_value(n) AS n_points, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p GROUP BY id",
    "load_text": f"WITH {oracle.points()} SELECT id, any_value(n) AS n_points, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM p GROUP BY id",
    "tracklets": f"{_with_runs} SELECT id, ix, iy, s AS seq_start, e AS seq_end, last AS is_last, k AS n_points, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y FROM t",
    "tracklet_reassembly": f"""{_with_runs} SELECT p.id, any_value(n) AS n_points, any_value(z.nt) AS n_tracklets, round(sum((x + y) * power(0.5, n - i)), 6) AS "check"
FROM p JOIN (SELECT id, count(*) AS nt FROM t GROUP BY id) z ON z.id = p.id GROUP BY p.id""",
    "pivots": f"{_with_runs}, {oracle.PIVOTS} SELECT pv.id, t.s AS seq_start, pv.x, pv.y FROM pv JOIN t USING (id, run)",
    "cell_counts": f"{_with_runs} SELECT ix, iy, count(*) AS n, min(x0) AS least_x FROM t GROUP BY ix, iy",
    "present_cells": f"{_with_runs} SELECT count(DISTINCT (ix, iy)) AS n FROM t",
    "load_stats": f"""{_with_runs}, z AS (SELECT id, count(DISTINCT (ix, iy)) AS c, count(*) AS nt, sum(k) AS np FROM t GROUP BY id),
s AS (SELECT count(*) AS n_trajectories, CAST(sum(np) AS BIGINT) AS n_points, CAST(sum(nt) AS BIGINT) AS n_tracklets, round(avg(c), 6) AS cells_per_trajectory FROM z),
a AS (SELECT count(DISTINCT (ix, iy)) AS active_cells FROM t)
SELECT s.*, active_cells, {4 ** BITS} - active_cells AS empty_cells, round(n_points / n_tracklets, 6) AS points_per_tracklet, round(n_points / active_cells, 6) AS points_per_cell, round(n_points / n_trajectories, 6) AS points_per_trajectory FROM s, a""",
    "hilbert_cells": oracle.hilbert_sql(BITS),
    **{k: _range_sql for k in QUERIES if k.startswith("range_") and "approx" not in k and not k.endswith(LONG)},
    **{k: oracle.range_sql(EPS_OF[f], f, None) for f in LONG for k in QUERIES if k.startswith("range_") and k.endswith(f)},
    **{f"range_approx_{k}_{v}": oracle.approx_sql(EPS, BITS, k) for k in LOCALS for v in ("v2", "v3")},
    **{f"funnel_{k}_{v}": oracle.funnel_sql(EPS, BITS, k, v) for k in LOCALS for v in ("v2", "v3")},
    **{k: _knn_sql for k in QUERIES if k.startswith("knn_") and not k.endswith(("customer", "walk"))},
    **{k: oracle.knn_sql(K, "walk", None) for k in QUERIES if k.startswith("knn_") and k.endswith("walk")},
    "funnel_xzshape": oracle.examined_sql(EPS, K, quadtree.G, quadtree.ALPHA, quadtree.BETA), "examined_knn_xzshape": oracle.examined_sql(None, K, quadtree.G, quadtree.ALPHA, quadtree.BETA),
    "xz_code": oracle.home_sql(quadtree.G), "export_sample": oracle.sample_sql(1000), "export_parts": oracle.parts_sql(1000),
    "query_text": f"WITH {oracle.points()}, s AS (SELECT id FROM p WHERE n <= 200 GROUP BY id ORDER BY md5('1:' || id), id LIMIT 1000) SELECT count(*) AS n, min(x) AS min_x, max(x) AS max_x, round(sum(y), 6) AS sum_y FROM p JOIN s USING (id)",
    "cell_window": f"{_with_runs}, w AS (SELECT {', '.join(f'greatest(0, least({2 ** BITS - 1}, CAST(floor(({v} - b{a}0) / (b{a}1 - b{a}0) * {2 ** BITS}) AS INT))) AS {n}' for v, a, n in zip(RECT, 'xyxy', ('a0', 'c0', 'a1', 'c1')))} FROM b) SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS n_points FROM t, w WHERE ix BETWEEN a0 AND a1 AND iy BETWEEN c0 AND c1",
    "shape_window": oracle.window_sql(RECT, quadtree.G, quadtree.ALPHA, quadtree.BETA),
    "knn_brute_customer": oracle.knn_sql(K, "customer", 4),
    "batch_range": oracle.batch_sql(BATCH_EPS, BATCH_STEP),
    "shape_key": oracle.shape_sql(quadtree.G, quadtree.ALPHA, quadtree.BETA),
    "segment_signature": oracle.segment_sql(BITS, quadtree.G, segments.ROWS, segments.COLS),
    "box_filter": f"WITH raw AS ({oracle.FIXTURES['short']}) SELECT count(*) AS n FROM raw WHERE x BETWEEN 10 AND 30 AND y BETWEEN 2 AND 6",
    "geo_distances": _geo_sql(),
}
