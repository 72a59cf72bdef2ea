"""Trajectories from points: ordering, bounds, tracklets of consecutive points in one grid cell, pivots, reassembly, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import PAD, Grid, hilbert_column

RECT = ("min_x", "min_y", "max_x", "max_y")


def xs(pts: str | Column) -> Column:
    return F.transform(pts, lambda p: p["x"])


def ys(pts: str | Column) -> Column:
    return F.transform(pts, lambda p: p["y"])


def build_trajectories(points: DataFrame, min_points: int = 2) -> DataFrame:
    """(id, pts, n_points, min_x, min_y, max_x, max_y): points (x, y, t) ordered by (t, x, y), duplicates kept, shorter objects dropped."""
    sound = points.where("id is not null and x is not null and y is not null and t is not null")
    grouped = sound.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("t", "x", "y"))).alias("_pts"),
        *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")],
    )
    pts = F.transform("_pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["t"].alias("t")))
    return grouped.where(F.size("_pts") >= min_points).select("id", pts.alias("pts"), F.size("_pts").cast("long").alias("n_points"), *RECT)


def bounds(trajectories: DataFrame) -> tuple[float, float, float, float] | None:
    row = trajectories.agg(F.min("min_x"), F.min("min_y"), F.max("max_x"), F.max("max_y")).first()
    return None if row[0] is None else tuple(float(v) for v in row)


#: Longitudes and latitudes of the whole world.
WORLD = (-180.0, -90.0, 180.0, 90.0)


def make_grid(trajectories: DataFrame, bits: int, whole_world: bool = False) -> Grid:
    """A grid over the data's bounds, or the whole world; an empty input gives the unit square."""
    b = WORLD if whole_world else bounds(trajectories) or (0.0, 0.0, 1.0, 1.0)
    return Grid(bits, b[0], b[1], b[2] + PAD, b[3] + PAD)


def _pivots(pts: Column, rect: list[Column]):
    """Medoid (nearest to the box's centre), the point farthest from it, the point farthest from that; the first wins a tie."""
    cx, cy = (rect[0] + rect[2]) / 2, (rect[1] + rect[3]) / 2

    def best(x: Column, y: Column, sign: int) -> Column:
        ranked = F.transform(pts, lambda p, i: F.struct((sign * F.sqrt((p["x"] - x) * (p["x"] - x) + (p["y"] - y) * (p["y"] - y))).alias("d"), i.alias("i"), F.struct(p["x"].alias("x"), p["y"].alias("y")).alias("p")))
        return F.array_min(ranked)["p"]

    medoid = best(cx, cy, 1)
    return medoid, best


def tracklets(trajectories: DataFrame, grid: Grid) -> DataFrame:
    """Runs of consecutive points in one cell: id, cell (Hilbert), ix, iy, seq_start, seq_end (from 1), is_last, n_points,
    pts, box, first_pt, last_pt, pivots. A cell that is visited again gives another tracklet.

    The runs are cut inside each trajectory's array, so nothing is shuffled. A trajectory is one object's points.
    """
    placed = F.transform("pts", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["t"].alias("t"), grid.ordinal(p["x"], "x").alias("ix"), grid.ordinal(p["y"], "y").alias("iy")))
    df = trajectories.select("id", "n_points", placed.alias("_p"))
    new = lambda p, i: (i == 0) | (p["ix"] != F.get("_p", i - 1)["ix"]) | (p["iy"] != F.get("_p", i - 1)["iy"])
    starts = F.filter(F.transform("_p", lambda p, i: F.when(new(p, i), i)), lambda i: i.isNotNull())
    df = df.withColumn("_starts", starts)
    runs = F.transform("_starts", lambda s, k: F.struct(s.alias("s"), F.coalesce(F.get("_starts", k + 1), F.size("_p")).alias("e")))
    df = df.select("id", F.col("n_points").alias("_total"), "_p", F.explode(runs).alias("_r"))
    df = df.select("id", "_total", "_r", F.slice("_p", F.col("_r.s") + 1, F.col("_r.e") - F.col("_r.s")).alias("_q"))
    pick = lambda f, c: f(F.transform("_q", lambda p: p[c]))
    df = df.select(
        "id",
        F.get("_q", F.lit(0))["ix"].alias("ix"),
        F.get("_q", F.lit(0))["iy"].alias("iy"),
        (F.col("_r.s") + 1).cast("long").alias("seq_start"),
        F.col("_r.e").cast("long").alias("seq_end"),
        (F.col("_r.e") == F.col("_total")).alias("is_last"),
        F.size("_q").cast("long").alias("n_points"),
        F.transform("_q", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["t"].alias("t"))).alias("pts"),
        pick(F.array_min, "x").alias("min_x"), pick(F.array_min, "y").alias("min_y"), pick(F.array_max, "x").alias("max_x"), pick(F.array_max, "y").alias("max_y"),
    )
    medoid, best = _pivots(F.col("pts"), [F.col(c) for c in RECT])
    df = df.withColumn("_m", medoid)
    df = df.withColumn("_f", best(F.col("_m")["x"], F.col("_m")["y"], -1))
    df = df.withColumn("_g", best(F.col("_f")["x"], F.col("_f")["y"], -1))
    return df.select(
        hilbert_column(F.col("ix"), F.col("iy"), grid.bits).alias("cell"), "id", "ix", "iy", "seq_start", "seq_end", "is_last", "n_points", "pts", *RECT,
        F.get("pts", F.lit(0)).alias("first_pt"), F.element_at("pts", -1).alias("last_pt"), F.array_distinct(F.array("_m", "_f", "_g")).alias("pivots"),
    )


def reassemble(tracks: DataFrame, *extra: Column) -> DataFrame:
    """Complete trajectories (id, pts, n_points, n_tracklets, extra aggregates) of the tracklets that are left."""
    grouped = tracks.groupBy("id").agg(
        F.min("seq_start").alias("_first"), F.max("seq_end").alias("_end"), F.bool_or("is_last").alias("_last"), F.sum("n_points").alias("n_points"), F.count(F.lit(1)).alias("n_tracklets"),
        F.array_sort(F.collect_list(F.struct("seq_start", "pts"))).alias("_parts"), *extra,
    )
    whole = grouped.where("_first = 1 and _last and n_points = _end")
    return whole.withColumn("pts", F.flatten(F.transform("_parts", lambda r: r["pts"]))).drop("_first", "_end", "_last", "_parts")


def _order(seed: int) -> list[Column]:
    """A seeded order of ids that any engine with MD5 can repeat."""
    return [F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), F.col("id")]


def sample_whole(trajectories: DataFrame, n: int, most_points: int = 200, seed: int = 1) -> DataFrame:
    """n trajectories of at most ``most_points`` points in the order of a seeded hash of their ids."""
    return trajectories.where(F.col("n_points") <= most_points).orderBy(*_order(seed)).limit(n)


def sample_parts(trajectories: DataFrame, n: int, points: int = 30, seed: int = 1) -> DataFrame:
    """n runs of exactly ``points`` points, one of each sampled trajectory that has as many, at a seeded offset."""
    long_enough = trajectories.where(F.col("n_points") >= points).orderBy(*_order(seed)).limit(n)
    drawn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(":offset"))), 1, 8), 16, 10).cast("long")
    offset = F.pmod(drawn, F.col("n_points") - points + 1).cast("int")
    return long_enough.select("id", F.slice("pts", offset + 1, points).alias("pts"), F.lit(points).cast("long").alias("n_points"))


def epoch_millis(t: Column, of: T.DataType) -> Column:
    """Milliseconds since 1970 of a timestamp; one without a time zone counts as UTC."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t) if isinstance(of, T.TimestampNTZType) else F.unix_millis(t)


def as_query_lines(trajectories: DataFrame) -> DataFrame:
    """A column ``value`` of lines ``x,y,epochMs;`` for ``write.text``."""
    kind = trajectories.schema["pts"].dataType.elementType["t"].dataType
    point = lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"), epoch_millis(p["t"], kind).cast("string"))
    return trajectories.select(F.concat(F.array_join(F.transform("pts", point), ";"), F.lit(";")).alias("value"))
