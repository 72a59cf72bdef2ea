"""Stored layouts: tracklets by cell directory or globally sorted, whole trajectories, quadtree-shape records, segments."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..operators import trajectories as T
from ..operators.tools import load_stats

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Only a session within one process may leave it unset, as in tests;
    it gets a folder of its own. On a cluster that is an error."""
    global _own_folder
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if _own_folder is None:
        folder = tempfile.mkdtemp(prefix="trajlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _own_folder = "file://" + folder
    return _own_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/trajlake/{name}-{uuid.uuid4().hex}"


@dataclass
class Layout:
    """One stored data set. ``grid`` doubles as the space's metadata; it is written beside the data."""

    spark: SparkSession
    path: str
    grid: Grid

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    @cached_property
    def whole(self) -> DataFrame:
        return self._read("whole")

    @cached_property
    def tracks(self) -> DataFrame:
        """Tracklets in a directory for each cell; the cell is a partition column and prunes directories.

        The schema is given, not inferred: an empty data set has no file to infer it from.
        """
        schema = T.tracklets(self.whole, self.grid).schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/cells").withColumn("cell", F.col("cell").cast("long"))

    @cached_property
    def flat(self) -> DataFrame:
        """The same tracklets sorted by (cell, min_x) without directories; row groups prune."""
        return self._read("flat")

    @cached_property
    def shapes(self) -> DataFrame:
        return self._read("shapes")

    @cached_property
    def shape_keys(self) -> DataFrame:
        """The keys that records have, with their quadrants' boxes and numbers of records."""
        return self._read("shape_keys")

    @cached_property
    def segments(self) -> DataFrame:
        return self._read("segments")


def write_trajectories(trajectories: DataFrame, path: str, bits: int) -> Layout:
    """Write whole trajectories sorted by id, tracklets by cell and flat, and the metadata; read with :func:`open_layout`."""
    spark = trajectories.sparkSession
    trajectories.repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/whole")
    whole = spark.read.parquet(f"{path}/whole")
    grid = T.make_grid(whole, bits)
    tracks = T.tracklets(whole, grid)
    tracks.repartitionByRange("cell", "min_x").sortWithinPartitions("cell", "min_x").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")
    stored = Layout(spark, path, grid)
    write_metadata(spark, path, grid, **load_stats(stored.whole, stored.tracks, bits).first().asDict(), files=stored_files(spark, f"{path}/cells"))
    return stored


def stored_files(spark: SparkSession, path: str) -> int:
    """How many data files a stored table has."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path").count()


def write_flat(layout: Layout) -> Layout:
    tracks = T.tracklets(layout.whole, layout.grid)
    tracks.repartitionByRange("cell", "min_x").sortWithinPartitions("cell", "min_x").write.mode("overwrite").parquet(f"{layout.path}/flat")
    return layout


def write_metadata(spark: SparkSession, path: str, grid: Grid, **stats: float) -> None:
    """The space and the statistics of the load as one line of JSON."""
    text = json.dumps({"grid": grid.as_dict(), "stats": stats})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def open_layout(spark: SparkSession, path: str) -> Layout:
    text = "".join(r["value"] for r in spark.read.text(f"{path}/metadata").collect())
    return Layout(spark, path, Grid(**json.loads(text)["grid"]))


def read_stats(spark: SparkSession, path: str) -> dict[str, float]:
    """The statistics that were written with a layout."""
    return json.loads("".join(r["value"] for r in spark.read.text(f"{path}/metadata").collect()))["stats"]


def present_cells(layout: Layout) -> DataFrame:
    return layout.tracks.select("cell").distinct()


def write_partitioned_text(df: DataFrame, by: str, value: Column, path: str) -> None:
    """A directory of text files for each value of ``by``."""
    df.select(by, value.alias("value")).repartition(by).write.mode("overwrite").partitionBy(by).text(path)
