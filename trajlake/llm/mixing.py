"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import BITMAP_BITS, bitmap_slot, parted, release, text_or_empty, unused_names, written

WORD = r"[^\x20\x09-\x0D]+"


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, reserve: int = 4096) -> np.ndarray:
    """How many documents of each size to take so that their sizes add up to ``budget``, or nearly so.

    Takes every size in proportion first, then single documents from large to small while ``reserve`` words stay open,
    and closes the rest by a bounded-knapsack dynamic programme over the documents still free. ``sizes`` are distinct, and
    the order in which they come makes no difference.
    """
    sizes, counts = np.asarray(sizes, np.int64), np.asarray(counts, np.int64)
    ascending = np.argsort(sizes, kind="stable")
    if not (ascending[:-1] < ascending[1:]).all():
        out = np.empty_like(counts)
        out[ascending] = fit_budget(sizes[ascending], counts[ascending], budget, reserve)
        return out
    total = int((sizes * counts).sum())
    if total <= budget:
        return counts.copy()
    take = np.zeros_like(counts)
    if budget <= 0 or total <= 0:
        return take
    take = np.array([int(c) * int(budget) // total for c in counts], np.int64)
    take[sizes == 0] = counts[sizes == 0]
    left = budget - int((take * sizes).sum())
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        if 0 < sizes[i] <= left - reserve and take[i] < counts[i]:
            take[i] += 1
            left -= int(sizes[i])
    return take + _knapsack(sizes, counts - take, left)


def _knapsack(sizes: np.ndarray, free: np.ndarray, room: int) -> np.ndarray:
    """The counts, within ``free``, whose sizes add up to the sum nearest to ``room``, the lower of two."""
    out = np.zeros_like(free)
    if room <= 0:
        return out
    goal, room = room, 2 * room
    first = np.full(room + 1, -1, np.int64)  # the step that first reached this sum
    reached = np.zeros(room + 1, bool)
    reached[0] = True
    steps: list[tuple[int, int]] = []
    for i in np.flatnonzero((sizes > 0) & (sizes <= room) & (free > 0)):
        many, part = min(int(free[i]), room // int(sizes[i])), 1
        while many > 0 and not reached[goal]:
            part = min(part, many)
            w = part * int(sizes[i])
            new = np.zeros_like(reached)
            new[w:] = reached[: room + 1 - w]
            new &= ~reached
            first[new] = len(steps)
            steps.append((i, part))
            reached |= new
            many, part = many - part, part * 2
        if reached[goal]:
            break
    sums = np.flatnonzero(reached)
    at = int(sums[np.abs(sums - goal).argmin()])
    while at > 0:
        i, part = steps[first[at]]
        out[i] += part
        at -= part * int(sizes[i])
    return out


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (_null, _src, _source_size) with _target: weights by code-point order, null last, ``share`` of all words.

    A target stops at ``most`` times its source's size; what it leaves is shared again by weight until none is above.
    """
    placed = written(sources.repartitionByRange("_null", "_src").withColumn("_p", F.spark_partition_id()), "mix-sources")
    before = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = before.select(F.col("_p").alias("_q"), (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy("_null", "_src")) - 1
    ranked = placed.withColumn("_own", own).join(before, F.col("_p") == F.col("_q")).withColumn("_rank", F.col("_own") + F.col("_offset")).drop("_p", "_q", "_own", "_offset")
    ranked = written(ranked, "mix-ranked")
    release(placed)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("_source_size") * F.lit(float(most)))
    total, level, capped = None, None, -1
    while True:
        above = F.lit(False) if level is None else F.col("_cap") <= F.col("_w") * F.lit(level)
        row = ranked.agg(
            F.sum("_source_size").alias("total"),
            F.sum(F.when(above, F.col("_cap")).otherwise(0.0)).alias("full"),
            F.sum(F.when(above, 0.0).otherwise(F.col("_w"))).alias("w"),
            F.count_if(above).alias("n"),
        ).first()
        total = share * float(row["total"] or 0)
        if not row["w"] or row["n"] == capped:
            break
        level, capped = (total - row["full"]) / row["w"], row["n"]
    return ranked.withColumn("_target", F.least(F.col("_cap"), F.col("_w") * F.lit(float(level or 0.0)))).drop("_rank", "_w", "_cap")


def row_hash(id_col: str, text_col: str, source_col: str, seed: int) -> Column:
    """Rows are told apart by this hash and their id."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col).cast("string"), text_or_empty(text_col))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
    keys: bool = False,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target (its source's), taken (words, repeats counted).

    Documents are counted by exact size for each source. A target of at least the source's size takes every document
    once; the rest of the budget is fitted by :func:`fit_budget` on the size histogram, and of each size the documents
    with the smallest seeded hashes are taken (once more). ``most`` is at most 2, so nothing is taken a third time.

    Choosing k of n documents of a size is distributed: hashes fall into about sqrt(rows) ranges, the ranges' counts say
    how many each one gives, and only documents of one range are ever ranked together.

    Null text has size 0 and adds nothing; a null source is a source of its own, last in the order. Rows that repeat an
    id, or have none, are documents of their own, each taken at most twice; which of rows that are equal in id, source and text
    is taken makes no difference. Other columns are not looked at. An empty table gives no rows.

    With ``keys`` the rows are (_hash, _id, times), for use by :func:`repeat`.
    """
    light = written(
        docs.select(
            F.col(id_col).alias("_id"),
            F.col(source_col).isNull().alias("_null"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_src"),
            F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("_size"),
            row_hash(id_col, text_col, source_col, seed).alias("_hash"),
        ),
        "mix-light",
    )
    hist = written(light.groupBy("_null", "_src", "_size").agg(F.count(F.lit(1)).alias("_n")), "mix-hist")
    sources = hist.groupBy("_null", "_src").agg(F.sum(F.col("_size") * F.col("_n")).cast("long").alias("_source_size"), F.sum("_n").alias("_docs"))
    targets = written(source_targets(sources.drop("_docs"), weights, share, most), "mix-targets")
    rows = hist.agg(F.sum("_n")).first()[0] or 0
    ranges = max(1, int(rows**0.5))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["_source_size"].iloc[0]), float(pdf["_target"].iloc[0])
        base = 1 if target >= size else 0
        extra = fit_budget(pdf["_size"].to_numpy(), pdf["_n"].to_numpy(), round(target) - base * size)
        return pdf.assign(_base=base, _extra=extra)

    schema = T.StructType([*hist.schema.fields, T.StructField("_source_size", T.LongType()), T.StructField("_target", T.DoubleType()), T.StructField("_base", T.LongType()), T.StructField("_extra", T.LongType())])
    quotas = hist.join(targets, ["_null", "_src"]).groupBy("_null", "_src").applyInPandas(fit, schema)

    part = F.floor((F.col("_hash").cast("double") / F.lit(2.0**64) + 0.5) * ranges).cast("long").alias("_range")
    light = light.select("*", part)
    before = Window.partitionBy("_null", "_src", "_size").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counted = light.groupBy("_null", "_src", "_size", "_range").agg(F.count(F.lit(1)).alias("_in"))
    plan = written(
        counted.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0)))
        .join(quotas.drop("_n"), ["_null", "_src", "_size"])
        .withColumn("_quota", F.greatest(F.lit(0), F.least(F.col("_extra") - F.col("_before"), F.col("_in"))))
        .select("_null", "_src", "_size", "_range", "_source_size", "_target", "_base", "_quota"),
        "mix-plan",
    )
    rank = F.row_number().over(Window.partitionBy("_null", "_src", "_size", "_range").orderBy("_hash", "_id"))
    picked = light.join(plan, ["_null", "_src", "_size", "_range"]).withColumn("_rank", rank)
    times = F.col("_base") + (F.col("_rank") <= F.col("_quota")).cast("long")
    if keys:
        return picked.select("_hash", "_id", times.alias("times"))
    return picked.select(
        F.col("_id").alias(id_col),
        F.when(~F.col("_null"), F.col("_src")).alias(source_col),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_size") * times).alias("taken"),
        times.alias("times"),
    )


def repeat(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, **options) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` takes it (0, 1 or 2 times); columns unchanged.

    Only rows that are not taken just once move. Rows that are equal in id, source and text are numbered, and what the mix takes of
    them is dealt out to them evenly. Null
    ids, sources and texts are treated as in :func:`mix`. Columns may have any names. An empty table gives no rows.
    """
    hash_, id_, total, rows, number, copy = unused_names(docs.columns, "_taken_hash", "_taken_id", "_taken", "_rows", "_number", "_copy")
    taken = mix(docs, id_col, text_col, source_col, seed=seed, keys=True, **options).groupBy("_hash", "_id").agg(F.sum("times").cast("int").alias(total), F.count(F.lit(1)).alias(rows))
    other = written(taken.where(F.col(total) != F.col(rows)).withColumnsRenamed({"_hash": hash_, "_id": id_}), "mix-other")
    own = row_hash(id_col, text_col, source_col, seed)
    same = (own == F.col(hash_)) & F.col(id_col).eqNullSafe(F.col(id_))
    once, near = parted(docs, other, bitmap_slot(own, BITMAP_BITS), bitmap_slot(F.col(hash_), BITMAP_BITS))
    told = near.join(other, same, "left")
    again = lambda df, times: df.withColumn(total, times).where(F.col(total) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(total)))).select(*[F.col(f"`{c}`") for c in docs.columns])
    out = once.unionByName(again(told.where(F.coalesce(F.col(rows), F.lit(1)) == 1), F.coalesce(F.col(total), F.lit(1))))
    if other.where(F.col(rows) > 1).isEmpty():
        return out
    numbered = told.where(F.col(rows) > 1).withColumn(number, F.row_number().over(Window.partitionBy(hash_, id_).orderBy(hash_)))
    share = F.floor(F.col(total) / F.col(rows)).cast("int") + (F.col(number) <= F.col(total) % F.col(rows)).cast("int")
    return out.unionByName(again(numbered, share))
