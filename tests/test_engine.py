"""Every query against its SQL, and the operators on hand-made edge cases."""

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajlake import catalog
from trajlake.functions.frechet import Lists
from trajlake.operators import batch, knn, quadtree, range_query, segments, tools
from trajlake.operators import trajectories as T
from trajlake.plans import oracle
from trajlake.sources import layout as L
from trajlake.sources import points as P

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    con = duckdb.connect()
    for t in ("lineitem", "events", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert rows == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in got.fetchall()), key=str)


@pytest.fixture(scope="module")
def loops(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("points")
    lines = ["a,0,0,2020-01-01 00:00:00", "a,5,5,2020-01-01 00:00:01", "a,0,0,2020-01-01 00:00:02", "b,1,1,2020-01-01 00:00:00", "c,9,9,2020-01-01 00:00:00", "c,9,9,2020-01-01 00:00:00"]
    lines += ["bad,x,1,2020-01-01 00:00:00", "bad,NaN,1,2020-01-01 00:00:00", "bad,1,1,never", "short", "d,8,1,2020-01-01 00:00:01", "d,1,1,2020-01-01 00:00:00"]
    (path / "in.csv").write_text("\n".join(lines))
    trajectories = T.build_trajectories(P.read_points(spark, str(path / "in.csv"), 0, 1, 2, 3))
    own = L.write_trajectories(trajectories, f"file://{path}/store", 2)
    for write in (L.write_flat, quadtree.write_shapes, segments.write_segments):
        write(own)
    return own


def test_parsing_ordering_and_single_points(loops):
    got = {r["id"]: [(p["x"], p["y"]) for p in r["pts"]] for r in loops.whole.collect()}
    assert got == {"a": [(0, 0), (5, 5), (0, 0)], "c": [(9, 9), (9, 9)], "d": [(1, 1), (8, 1)]}


def test_revisited_cells_and_reassembly(loops):
    a = [(r["seq_start"], r["seq_end"], r["is_last"]) for r in loops.tracks.where("id = 'a'").orderBy("seq_start").collect()]
    assert a == [(1, 1, False), (2, 2, False), (3, 3, True)]
    assert {r["id"]: r["pts"] for r in T.reassemble(loops.tracks).collect()} == {r["id"]: r["pts"] for r in loops.whole.collect()}
    assert T.reassemble(loops.tracks.where("seq_start <> 2")).count() == 1
    assert L.open_layout(loops.spark, loops.path).grid == loops.grid


@pytest.mark.parametrize("eps,want", [(0.0, {"a"}), (-1.0, set()), (8.0, {"a"}), (8.07, {"a", "d"}), (100.0, {"a", "c", "d"})])
def test_range_on_all_indexes(loops, eps, want):
    query = [(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)]
    ids = lambda df: {r["id"] for r in df.collect()}
    if eps >= 0:
        assert ids(range_query.brute_force(loops.whole, query, eps)) == want
    for v in ("v1", "v2", "v3", "v4"):
        for local in ("dist", "mbr", "pivot"):
            assert ids(range_query.range_query(loops, query, eps, v, local)) == want
    assert ids(range_query.range_query(loops, query, eps, flat=True)) == want
    assert ids(range_query.two_phase(loops, query, eps)) == ids(quadtree.range_query(loops, query, eps)) == ids(segments.range_query(loops, query, eps)) == want


def test_queries_outside_the_domain_and_empty(loops):
    assert range_query.range_query(loops, [(500.0, 500.0), (501.0, 500.0)], 2.0).count() == 0
    assert range_query.range_query(loops, [], 2.0).count() == 0
    empty = L.write_trajectories(loops.whole.where("false"), loops.path + "-empty", 2)
    assert range_query.range_query(empty, [(0.0, 0.0)], 5.0).count() == 0 and knn.knn(empty, [(0.0, 0.0)], 3).count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 10])
def test_knn_on_all_indexes(loops, k):
    query = [(0.0, 1.0), (6.0, 5.0), (0.0, 0.0)]
    want = [tuple(r) for r in knn.rank(loops.whole, query, k).collect()]
    assert len(want) == min(k, 3)
    for f in (knn.knn, knn.knn_reassembled, quadtree.knn, segments.knn):
        assert [tuple(r) for r in f(loops, query, k).collect()] == want


def test_batch_equals_single_queries(loops):
    queries = loops.whole.select(F.col("id").alias("qid"), "pts")
    got = {(r["qid"], r["id"]) for r in batch.batch_range(loops, queries, 8.5).collect()}
    want = {(q["id"], r["id"]) for q in loops.whole.collect() for r in range_query.brute_force(loops.whole, [(p["x"], p["y"]) for p in q["pts"]], 8.5).collect()}
    assert got == want and len(got) > 3


def test_batch_has_every_query_divisible_by_100(spark):
    own = catalog.layout(spark, SF)
    got = {(r["qid"], r["id"]) for r in catalog.QUERIES["batch_range"](spark, SF).collect()}
    queries = own.whole.where("id % 100 = 0").collect()
    one = lambda q: range_query.brute_force(own.whole, [(p["x"], p["y"]) for p in q["pts"]], catalog.BATCH_EPS)
    assert got == {(q["id"], r["id"]) for q in queries for r in one(q).collect()}
    assert {q for q, _ in got} == {q["id"] for q in queries} and len(queries) > 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    assert {x for x in got if x[0] % 500 == 0} == set(con.execute(oracle.batch_sql(catalog.BATCH_EPS, 500)).fetchall())


def test_text_files_round_trip(spark, loops, tmp_path):
    T.as_query_lines(loops.whole).write.text(f"{tmp_path}/queries")
    back = sorted([(p["x"], p["y"]) for p in r["pts"]] for r in P.read_queries(spark, f"{tmp_path}/queries").collect())
    assert back == sorted([(p["x"], p["y"]) for p in r["pts"]] for r in loops.whole.collect())
    made = tools.random_rectangles(spark, 20, (0.0, 0.0, 9.0, 9.0), 0, 100)
    assert made.where("x1 < 0 or y1 < 0 or x2 > 9 or y2 > 9 or t2 > 100 or x2 < x1").count() == 0
    tools.rectangle_lines(made).write.text(f"{tmp_path}/rects")
    assert P.read_rectangles(spark, f"{tmp_path}/rects").count() == 20
    L.write_partitioned_text(loops.whole, "n_points", F.col("id"), f"{tmp_path}/by")
    assert spark.read.text(f"{tmp_path}/by").where("n_points = 2").count() == 2
    assert T.sample_parts(loops.whole, 5, 2).where("size(pts) <> 2").count() == 0


def test_metrics(spark, tmp_path):
    log = ['{"Event":"SparkListenerTaskEnd","Stage ID":3,"Task Metrics":{"Input Metrics":{"Bytes Read":7},"Shuffle Read Metrics":{"Local Bytes Read":2,"Remote Bytes Read":5},"Shuffle Write Metrics":{"Shuffle Bytes Written":4}}}']
    log += ['{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":3,"Submission Time":1000,"Completion Time":3500}}', "other"]
    (tmp_path / "log").write_text("\n".join(log))
    row = tools.stage_metrics(spark, str(tmp_path / "log")).first()
    assert (row["seconds"], row["input_bytes"], row["shuffle_local_bytes"], row["shuffle_remote_bytes"], row["shuffle_write_bytes"]) == (2.5, 7, 2, 5, 4)
    (tmp_path / "t").write_text("a pages = 3\npages: 4.5 end\nnone")
    assert tools.sum_in_log(spark, str(tmp_path / "t"), "pages").first()[0] == 7.5
    a = spark.createDataFrame([(1, True), (2, False)], "query int, Issued boolean")
    merged = tools.merge_metrics(a, spark.createDataFrame([(1, 5.0), (2, 6.0)], "query int, sec double"), issued="Issued")
    assert {r["query"]: r["sec"] for r in merged.collect()} == {1: 5.0, 2: None}


def test_statistics_are_stored_with_the_layout(loops):
    stats = L.read_stats(loops.spark, loops.path)
    assert (stats["n_trajectories"], stats["n_points"], stats["n_tracklets"], stats["active_cells"]) == (3, 7, loops.tracks.count(), loops.tracks.select("cell").distinct().count())
    assert stats["files"] >= 1 and stats["empty_cells"] == 16 - stats["active_cells"]


def test_times_are_kept(loops):
    lines = {r["value"] for r in T.as_query_lines(loops.whole.where("id <> 'c'")).collect()}
    assert lines == {"0.0,0.0,1577836800000;5.0,5.0,1577836801000;0.0,0.0,1577836802000;", "1.0,1.0,1577836800000;8.0,1.0,1577836801000;"}


def test_malformed_query_lines(spark, tmp_path):
    (tmp_path / "q").write_text("1,2,1000;x,3,1000;4,5,never;6;;\n\n")
    rows = P.read_queries(spark, str(tmp_path / "q")).collect()
    assert [[(p["x"], p["y"], p["t"] is None) for p in r["pts"]] for r in rows] == [[(1.0, 2.0, False), (4.0, 5.0, True)]]


def test_columns_by_index_and_by_name(spark, tmp_path):
    (tmp_path / "c.csv").write_text("a;1;2\nb;x;4\n")
    (tmp_path / "h.csv").write_text("n,lon,lat\na,1,2\n")
    assert [tuple(r) for r in P.read_columns(spark, str(tmp_path / "c.csv"), 1, 2, ";").collect()] == [(1.0, 2.0), (None, 4.0)]
    assert [tuple(r) for r in P.read_columns(spark, str(tmp_path / "h.csv"), "lon", "lat", header=True).collect()] == [(1.0, 2.0)]
    spark.createDataFrame([(3.0, 4.0)], "lon double, lat double").write.parquet(f"{tmp_path}/p")
    assert tools.box_count(P.read_columns(spark, f"{tmp_path}/p", "lon", "lat"), F.col("x"), F.col("y"), (3, 4, 5, 6)).first()["n"] == 1


@pytest.mark.parametrize("eps", [-1.0, 0.0, 3.0])
def test_batch_edges(loops, eps):
    queries = loops.whole.select(F.col("id").alias("qid"), "pts").unionByName(loops.whole.limit(1).select(F.lit("none").alias("qid"), F.slice("pts", 1, 0).alias("pts")))
    got = {(r["qid"], r["id"]) for r in batch.batch_range(loops, queries, eps).collect()}
    want = {(q["id"], r["id"]) for q in loops.whole.collect() for r in range_query.brute_force(loops.whole, [(p["x"], p["y"]) for p in q["pts"]], eps).collect()}
    assert got == want and (eps < 0) == (not got)


def test_scans_of_the_shape_index_are_by_key_ranges(spark, monkeypatch):
    own = catalog.layout(spark, SF, "shapes", fixture="walk")
    query = catalog.query_of(own, None)
    ranges = quadtree.candidate_ranges(own, query, 9000.0)
    held = {r["key"] for r in quadtree.candidate_keys(own.shape_keys, query, 9000.0).collect()}
    every = {r["key"] for r in own.shape_keys.collect()}
    assert {k for k in every if any(lo <= k < hi for lo, hi in ranges)} == held and own.shape_keys.agg(F.sum("n")).first()[0] == own.shapes.count()
    plan = quadtree.records(own, query, 9000.0)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(key" in plan
    want = {r["id"] for r in quadtree.records(own, query, 20000.0).collect()}
    monkeypatch.setattr(quadtree, "MOST_RANGES", 1)
    assert {r["id"] for r in quadtree.records(own, query, 20000.0).collect()} == want and want
    wide = quadtree.frechet_ranges(query, 9000.0, quadtree.space(own))
    assert all(any(lo <= k < hi for lo, hi in wide) for k in held)


def test_long_queries_are_tested_against_every_box(loops, monkeypatch):
    from trajlake.plans import predicates

    query = [(float(i % 10), float(i % 7)) for i in range(90)]
    for v in ("v2", "v3"):
        want = {(r["id"], r["seq_start"]) for r in loops.tracks.where(predicates.pushdown(v, loops.grid, query, 0.5)).collect()}
        monkeypatch.setattr(predicates, "MOST_BOXES", 3)
        assert {(r["id"], r["seq_start"]) for r in loops.tracks.where(predicates.pushdown(v, loops.grid, query, 0.5)).collect()} == want
        monkeypatch.undo()
    assert range_query.range_query(loops, query, 100.0).count() == 3


def test_metrics_by_job_and_stage(spark, tmp_path):
    log = ['{"Event":"SparkListenerJobStart","Job ID":%d,"Stage IDs":[%s]}' % (j, ids) for j, ids in ((0, "0,1"), (1, "1,2"), (2, "3"))]
    for s in range(4):
        log.append('{"Event":"SparkListenerStageCompleted","Stage Info":{"Stage ID":%d,"Submission Time":1000,"Completion Time":%d}}' % (s, 2000 + 1000 * s))
        log.append('{"Event":"SparkListenerTaskEnd","Stage ID":%d,"Task Metrics":{"Input Metrics":{"Bytes Read":%d}}}' % (s, 10 + s))
    (tmp_path / "log").write_text("\n".join(log))
    one = {r["query"]: (r["stages"], r["seconds"], r["input_bytes"]) for r in tools.job_metrics(spark, str(tmp_path / "log")).collect()}
    assert one == {0: (2, 3.0, 21), 1: (1, 3.0, 12), 2: (1, 4.0, 13)}
    assert {r["query"]: r["input_bytes"] for r in tools.job_metrics(spark, str(tmp_path / "log"), 2).collect()} == {0: 33, 1: 13}
    results = spark.createDataFrame([(0, 5), (1, 6), (7, 8)], "query long, n int")
    stages = spark.createDataFrame([(0, 1, 2.0), (0, 0, 1.0), (1, 2, 3.0)], "query long, stage_id int, seconds double")
    assert {tuple(r) for r in tools.merge_stages(results, stages, 2).collect()} == {(0, 5, 1.0, 2.0), (1, 6, 3.0, None), (7, 8, None, None)}


def test_batch_stores_no_tables(spark, tmp_path, monkeypatch):
    """The search needs whole trajectories only; tracklets and their layout, several times the input, are not written for it."""
    want = {tuple(r) for r in catalog.QUERIES["batch_range"](spark, SF).collect()}
    (tmp_path / "lineitem.parquet").symlink_to(f"{SF}/lineitem.parquet")
    monkeypatch.setattr(catalog, "write_trajectories", lambda *a: pytest.fail("a layout is written"))
    assert {tuple(r) for r in catalog.QUERIES["batch_range"](spark, str(tmp_path)).collect()} == want and want


def test_batch_decides_equal_trajectories_once(spark, monkeypatch):
    """700 copies of each of three trajectories: few rows are decided, all pairs are listed."""
    shapes = [[(0.0, 0.0), (5.0, 5.0)], [(0.0, 0.0), (5.0, 5.0), (5.0, 6.0)], [(30.0, 0.0), (5.0, 5.0)]]
    whole = spark.createDataFrame([(k, [*shapes[k % 3]]) for k in range(2100)], "id long, pts array<struct<x double, y double>>").repartition(7)
    made = batch.classes(whole, "id").collect()
    assert sorted(k for r in made for k in r["_ids"]) == list(range(2100)) and len(made) < 40 and max(len(r["_ids"]) for r in made) <= batch.MEMBERS
    assert all(list(zip(r["_u"], r["_v"], strict=True)) == shapes[k % 3] for r in made for k in r["_ids"])
    queries = whole.where("id % 100 = 0").withColumnRenamed("id", "qid")
    got = [tuple(r) for r in batch.pairs_within(whole, queries, 1.5).collect()]
    assert sorted(got) == [(q, k) for q in range(0, 2100, 100) for k in range(2100) if (q % 3 == 2) == (k % 3 == 2)]


def test_equal_hashes_of_different_trajectories_stay_apart():
    lists = lambda rows: Lists(pa.array(rows, pa.list_(pa.float64())))
    x, y = [[1.0, 2.0], [1.0, 2.0], [1.0, 3.0], [1.0], [1.0], [1.0]], [[0.0, 0.0], [0.0, 0.0], [0.0, 0.0], [0.0], [4.0], [4.0]]
    assert batch._equal_to_previous(np.zeros(6, int), [lists(x), lists(y)]).tolist() == [False, True, False, False, False, True]
