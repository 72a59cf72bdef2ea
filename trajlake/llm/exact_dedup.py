"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BITMAP_BITS, ascii_lower, bitmap, bitmap_marked, bitmap_slot, parted, text_or_empty, unused_names, written

PREFIX_CHARS = 256


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    prefix_chars: int = PREFIX_CHARS,
    bitmap_bits: int = BITMAP_BITS,
    carry: dict[str, Column] | None = None,
    keys: bool = False,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and the ``carry`` columns.

    Texts are equal when identical after lower-casing A-Z; of equal texts the largest id is kept. Pass 1 counts byte
    lengths, pass 2 hashes a prefix where the length is shared, pass 3 hashes the whole text where length and prefix are
    shared. Texts never move between executors: each pass leaves a bitmap of fixed size that the next one looks up; a
    false hit only costs one more hash, since the groups are formed on (length, SHA-256).

    With ``keys`` the rows are (_id, _keep, _size, _full, carried), for use by :func:`deduplicate`.
    ``carry`` maps output names to expressions over ``_text`` (the normalised text), computed in the last pass.
    Null text counts as empty. Rows repeating an id and a text each count in group_size and share ``kept``. A null id is
    below every other; a group of null ids only has keep_id null and its rows stay. An empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_raw")).withColumn("_len", F.octet_length("_raw").cast("long"))
    lengths = base.groupBy("_len").count().where("count > 1")
    marked = bitmap_marked(base, bitmap(lengths, bitmap_slot(F.col("_len"), bitmap_bits)), bitmap_slot(F.col("_len"), bitmap_bits), "_same_len")

    prefix = F.when(F.col("_same_len"), F.xxhash64(ascii_lower(F.substring("_raw", 1, prefix_chars))))
    staged = marked.withColumn("_prefix", prefix)
    prefixes = staged.where("_prefix is not null").groupBy("_len", "_prefix").count().where("count > 1")
    both = F.xxhash64("_len", "_prefix")
    marked = bitmap_marked(staged, bitmap(prefixes, bitmap_slot(both, bitmap_bits)), bitmap_slot(both, bitmap_bits), "_same_prefix")

    survives = F.col("_same_len") & F.col("_same_prefix")
    light = written(
        marked.withColumn("_text", ascii_lower(F.col("_raw"))).select(
            "_id", "_len", F.when(survives, F.unhex(F.sha2("_text", 256))).alias("_full"), *[c.alias(k) for k, c in (carry or {}).items()]
        ),
        "exact-light",
    )
    extras = [*(["_full"] if keys else []), *(carry or {})]
    sized = light.where("_full is not null").groupBy("_len", "_full").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    groups = written(sized.where("_size > 1").withColumnsRenamed({"_len": "_glen", "_full": "_gfull"}), "exact-groups")
    on = (F.col("_len") == F.col("_glen")) & (F.col("_full") == F.col("_gfull"))
    grouped = light.where("_full is not null").join(groups, on, "left")
    alone = light.where("_full is null").withColumns({"_keep": F.col("_id"), "_size": F.lit(1).cast("long")})
    cols = ["_id", F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("_keep"), F.coalesce("_size", F.lit(1).cast("long")).alias("_size"), *extras]
    rows = grouped.select(*cols).unionByName(alone.select(*cols))
    if keys:
        return rows
    return rows.select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"), F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"), *extras
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts (A-Z lower-cased), that with the largest id; columns unchanged.

    Rows that repeat an id and a text count as copies too: one of them stays, any one. Rows that repeat an id with different
    texts are told apart by their texts. Of a group of null ids only, one row stays; next to other ids a null id is dropped.
    Null text counts as empty. Columns may have any names. An empty table gives no rows.
    """
    id_, full, copy = unused_names(docs.columns, "_dropped_id", "_dropped_full", "_dropped_copy")
    known = exact_groups(docs, id_col, text_col, keys=True).where("_size > 1")
    known = written(known.groupBy("_id", "_full").agg(F.max("_keep").alias("_keep"), F.count(F.lit(1)).alias("_n")), "exact-copies")
    dropped = known.where("not (_id <=> _keep)").select(F.col("_id").alias(id_), F.col("_full").alias(full))
    own = F.unhex(F.sha2(ascii_lower(text_or_empty(text_col)), 256))
    stay, near = parted(docs, dropped, bitmap_slot(F.xxhash64(F.col(id_col)), BITMAP_BITS), bitmap_slot(F.xxhash64(F.col(id_)), BITMAP_BITS))
    out = stay.unionByName(near.join(dropped, F.col(id_col).eqNullSafe(F.col(id_)) & (own == F.col(full)), "left_anti"))
    several = known.where("_id <=> _keep and _n > 1").select(F.col("_id").alias(id_), F.col("_full").alias(full))
    if several.isEmpty():
        return out
    again = F.col(id_col).eqNullSafe(F.col(id_)) & (own == F.col(full))
    one = out.join(several, again).dropDuplicates([id_, full]).drop(id_, full)
    return out.join(several, again, "left_anti").unionByName(one)
