"""Rectangle queries, query generators, load statistics and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def box_count(df: DataFrame, x: Column, y: Column, rect: tuple[float, float, float, float]) -> DataFrame:
    """One row (n): points in the closed rectangle (min_x, min_y, max_x, max_y)."""
    return df.where(x.between(rect[0], rect[2]) & y.between(rect[1], rect[3])).agg(F.count(F.lit(1)).alias("n"))


def random_rectangles(spark: SparkSession, n: int, bounds: tuple[float, float, float, float], t0: int, t1: int, size: tuple[float, float, int] | None = None, seed: int = 1) -> DataFrame:
    """(qid, x1, y1, t1, x2, y2, t2): n boxes inside the bounds, of a fixed size (width, height, duration) or each of its own.

    Ends are drawn inside what the size leaves, so no box is ever rejected.
    """
    r = lambda k: F.rand(seed + k)
    w, h, d = (F.lit(float(size[0])), F.lit(float(size[1])), F.lit(float(size[2]))) if size else (r(4) * (bounds[2] - bounds[0]), r(5) * (bounds[3] - bounds[1]), r(6) * (t1 - t0))
    df = spark.range(n).select(F.col("id").alias("qid"), w.alias("w"), h.alias("h"), d.alias("d"))
    df = df.withColumns({"x1": F.lit(bounds[0]) + r(1) * (F.lit(bounds[2] - bounds[0]) - F.col("w")), "y1": F.lit(bounds[1]) + r(2) * (F.lit(bounds[3] - bounds[1]) - F.col("h")), "s": F.lit(float(t0)) + r(3) * (F.lit(float(t1 - t0)) - F.col("d"))})
    return df.select("qid", "x1", "y1", F.floor("s").alias("t1"), (F.col("x1") + F.col("w")).alias("x2"), (F.col("y1") + F.col("h")).alias("y2"), F.floor(F.col("s") + F.col("d")).alias("t2"))


def rectangle_lines(rectangles: DataFrame) -> DataFrame:
    """A column ``value`` of lines ``x1;y1;t1;x2;y2;t2`` for ``write.text``."""
    return rectangles.select(F.concat_ws(";", "x1", "y1", "t1", "x2", "y2", "t2").alias("value"))


def load_stats(trajectories: DataFrame, tracks: DataFrame, bits: int) -> DataFrame:
    """One row: trajectories, points, tracklets, active and empty cells, and the averages that a loader reports."""
    by_id = tracks.groupBy("id").agg(F.count_distinct("ix", "iy").alias("cells"), F.sum("n_points").alias("points"), F.count(F.lit(1)).alias("tracklets"))
    per_id = by_id.agg(F.count(F.lit(1)).alias("n_trajectories"), F.sum("points").alias("n_points"), F.sum("tracklets").alias("n_tracklets"), F.round(F.avg("cells"), 6).alias("cells_per_trajectory"))
    active = tracks.select("ix", "iy").distinct().agg(F.count(F.lit(1)).alias("active_cells"))
    both = per_id.crossJoin(active)  # one row each
    return both.select("*", (F.lit(4**bits) - F.col("active_cells")).alias("empty_cells"), F.round(F.col("n_points") / F.col("n_tracklets"), 6).alias("points_per_tracklet"), F.round(F.col("n_points") / F.col("active_cells"), 6).alias("points_per_cell"), F.round(F.col("n_points") / F.col("n_trajectories"), 6).alias("points_per_trajectory"))


def stage_metrics(spark: SparkSession, event_log: str) -> DataFrame:
    """(stage_id, seconds, input_bytes, shuffle_local_bytes, shuffle_remote_bytes, shuffle_write_bytes) from an event log.

    The log may be plain or compressed with a codec that Spark reads by file name.
    """
    lines = spark.read.text(event_log)
    at = lambda path: F.get_json_object("value", path)
    tasks = lines.where(at("$.Event") == "SparkListenerTaskEnd").select(at("$['Stage ID']").cast("int").alias("stage_id"), *[F.coalesce(at(f"$['Task Metrics']{p}").cast("long"), F.lit(0)).alias(n) for n, p in (("input_bytes", "['Input Metrics']['Bytes Read']"), ("shuffle_local_bytes", "['Shuffle Read Metrics']['Local Bytes Read']"), ("shuffle_remote_bytes", "['Shuffle Read Metrics']['Remote Bytes Read']"), ("shuffle_write_bytes", "['Shuffle Write Metrics']['Shuffle Bytes Written']"))])
    sums = tasks.groupBy("stage_id").agg(*[F.sum(c).alias(c) for c in tasks.columns[1:]])
    info = "$['Stage Info']"
    stages = lines.where(at("$.Event") == "SparkListenerStageCompleted").select(at(f"{info}['Stage ID']").cast("int").alias("stage_id"), ((at(f"{info}['Completion Time']").cast("long") - at(f"{info}['Submission Time']").cast("long")) / 1000).alias("seconds"))
    return stages.join(sums, "stage_id", "left").na.fill(0)


def job_metrics(spark: SparkSession, event_log: str, jobs: int = 1) -> DataFrame:
    """The metrics of :func:`stage_metrics` summed for each run of ``jobs`` jobs in their order: query (from 0), stages and the rest.

    A stage that several jobs name counts for the first of them.
    """
    lines = spark.read.text(event_log)
    at = lambda path: F.get_json_object("value", path)
    starts = lines.where(at("$.Event") == "SparkListenerJobStart").select(at("$['Job ID']").cast("long").alias("job"), F.from_json(at("$['Stage IDs']"), "array<int>").alias("ids"))
    of_stage = starts.select("job", F.explode("ids").alias("stage_id")).groupBy("stage_id").agg(F.min("job").alias("job"))
    joined = stage_metrics(spark, event_log).join(of_stage, "stage_id")
    sums = [F.sum(c).alias(c) for c in ("seconds", "input_bytes", "shuffle_local_bytes", "shuffle_remote_bytes", "shuffle_write_bytes")]
    return joined.groupBy(F.floor(F.col("job") / jobs).alias("query")).agg(F.count(F.lit(1)).alias("stages"), *sums)


def merge_stages(results: DataFrame, metrics: DataFrame, stages: int, on: str = "query") -> DataFrame:
    """Per-query results with the seconds of each of a query's stages, in order, in columns stage_1 to stage_n; ``metrics`` has
    (query, stage_id, seconds)."""
    seconds = F.transform(F.array_sort(F.collect_list(F.struct("stage_id", "seconds"))), lambda s: s["seconds"])
    own = metrics.groupBy(on).agg(seconds.alias("_seconds"))
    wide = own.select(on, *[F.get("_seconds", F.lit(i)).alias(f"stage_{i + 1}") for i in range(stages)])
    return results.join(wide, on, "left")


def sum_in_log(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One row (total): the sum of the numbers that stand after ``name`` and an = or : in a text log."""
    number = F.regexp_extract("value", rf"\Q{name}\E\s*[=:]\s*(-?\d+(?:\.\d+)?)", 1).try_cast("double")
    return spark.read.text(path).agg(F.coalesce(F.sum(number), F.lit(0.0)).alias("total"))


def merge_metrics(results: DataFrame, metrics: DataFrame, on: str = "query", issued: str | None = None) -> DataFrame:
    """Per-query results with their metrics; with ``issued``, queries whose flag is false have null metrics."""
    joined = results.join(metrics, on, "left")
    if issued is None:
        return joined
    return joined.select(*results.columns, *[F.when(F.col(issued), F.col(c)).alias(c) for c in metrics.columns if c != on])


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)
