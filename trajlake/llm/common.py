"""Helpers shared by the operators: the shared work folder, written tables and text columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bits of the survivor bitmaps. A bitmap of 2**23 bits is 256 rows of 4 KiB whatever the input, so it can be broadcast.
BITMAP_BITS = 1 << 23

#: Bytes after which a batch of rows goes to a Python worker; a longer row is a batch of its own.
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20

_own_folder: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session within one process may leave it
    unset, as in tests; it gets a folder of its own. On a cluster that is an error, since no local folder would be shared."""
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


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/trajlake/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    try:
        df.write.parquet(path)
    except Exception:
        remove(spark, path)
        raise
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store once nothing reads it any more."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def release(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written`, which nothing that is still to run may read."""
    for df in tables:
        remove(df.sparkSession, df.written_path)


def unused_names(taken: list[str], *names: str) -> list[str]:
    """The names, with underscores before them as long as a column is called so."""
    lower, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in lower:
            name = "_" + name
        out.append(name)
    return out


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the byte-wise path of lower()."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` in batches bounded by bytes, not by rows only, since texts may be long.

    The bound is a setting of the session, as Spark reads it when the plan runs; one that the session already has stays.
    """
    if df.sparkSession.conf.get(BATCH_KEY, None) is None:
        df.sparkSession.conf.set(BATCH_KEY, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bitmap(keys: DataFrame, slot: Column) -> DataFrame:
    """Rows (_bucket, _bits) of a fixed-size bitmap over the slots 1..BITMAP_BITS."""
    return (
        keys.select(slot.alias("_slot"))
        .groupBy(F.expr("bitmap_bucket_number(_slot)").alias("_bucket"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(_slot))").alias("_bits"))
    )


def bitmap_slot(key: Column, bits: int) -> Column:
    return F.pmod(key, F.lit(bits)).cast("long") + 1


def bitmap_marked(df: DataFrame, bits: DataFrame, slot: Column, flag: str) -> DataFrame:
    """``df`` with a boolean ``flag``: is the row's slot set in the bitmap? The bitmap's size is fixed, so it is broadcast."""
    named = bits.select(F.col("_bucket").alias(f"{flag}_bucket"), F.col("_bits").alias(f"{flag}_bits"))
    with_slot = df.withColumn(f"{flag}_slot", slot)
    joined = with_slot.join(F.broadcast(named), F.expr(f"bitmap_bucket_number({flag}_slot) = {flag}_bucket"), "left")
    byte = F.expr(f"cast(conv(hex(substring({flag}_bits, cast(bitmap_bit_position({flag}_slot) div 8 as int) + 1, 1)), 16, 10) as int)")
    bit = F.expr(f"cast(pmod(bitmap_bit_position({flag}_slot), 8) as int)")
    hit = F.coalesce(F.call_function("shiftright", byte, bit).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return joined.withColumn(flag, hit).drop(f"{flag}_slot", f"{flag}_bucket", f"{flag}_bits")


def parted(docs: DataFrame, keys: DataFrame, slot: Column, key_slot: Column) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: the rows that no row of ``keys`` can match, and the others, told apart by a bitmap of fixed size.

    Only the others have to move for a join with the keys. Columns may have any names.
    """
    flag = "_maybe"
    while any(c.lower().startswith(flag) for c in docs.columns):
        flag = "_" + flag
    told = bitmap_marked(docs, bitmap(keys, key_slot), slot, flag)
    return told.where(~F.col(flag)).drop(flag), told.where(flag).drop(flag)
