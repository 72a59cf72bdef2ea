"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One star step. Large: every larger neighbour of a node is tied to the node's smallest neighbour. Small: every smaller
    neighbour and the node itself are. The minimum of a node is aggregated and joined back, so no neighbourhood is collected."""
    if large:
        links = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")).withColumnRenamed("a", "u"), "cc-least")
        out = links.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("x"), F.col("m").alias("y"))
    else:
        links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(links.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "cc-least")
        out = links.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("x"), F.col("m").alias("y"))
        out = out.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    out = out.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    out = written(out, "cc-links")
    release(least)
    return out


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Ends when a round changes nothing, after about log(nodes) rounds. Self-links and repeated links do no harm; nulls are
    left out; no links give no rows.
    """
    nodes = written(links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-links")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
    now, last = nodes, None
    while (mark := state(now)) != last and mark[0]:
        last = mark
        large = _stars(now, True)
        release(now)
        now = _stars(large, False)
        release(large)
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
