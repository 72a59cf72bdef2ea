"""Sources: delimited point files, query-trajectory and rectangle files, and trajectories from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, id_at: int, x_at: int, y_at: int, t_at: int, delimiter: str = ",", time_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Points (id, x, y, t) of delimited text by column index; ``delimiter`` is a regular expression.

    Rows whose numbers or time do not parse, or are not finite, are left out.
    """
    parts = F.split("value", delimiter)
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    rows = spark.read.text(path).select(F.get(parts, F.lit(id_at)).alias("id"), number(x_at).alias("x"), number(y_at).alias("y"), F.try_to_timestamp(F.get(parts, F.lit(t_at)), F.lit(time_format)).alias("t"))
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.where(F.col("id").isNotNull() & finite("x") & finite("y") & F.col("t").isNotNull())


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query trajectories (line, pts), one a line: ``x,y,epochMs;`` repeated. Empty lines are left out, and points whose numbers do not
    parse; a time that does not parse is null."""
    numbered = spark.read.text(path).where("trim(value) <> ''").withColumn("line", F.monotonically_increasing_id())
    number = lambda p, i: F.get(F.split(p, ","), F.lit(i))
    point = lambda p: F.struct(number(p, 0).try_cast("double").alias("x"), number(p, 1).try_cast("double").alias("y"), F.timestamp_millis(number(p, 2).try_cast("long")).alias("t"))
    read = F.transform(F.filter(F.split("value", ";"), lambda p: F.trim(p) != ""), point)
    return numbered.select("line", F.filter(read, lambda p: p["x"].isNotNull() & p["y"].isNotNull()).alias("pts"))


def read_rectangles(spark: SparkSession, path: str) -> DataFrame:
    """Rectangles (x1, y1, t1, x2, y2, t2) of lines ``x1;y1;t1;x2;y2;t2``."""
    return spark.read.csv(path, sep=";", schema="x1 double, y1 double, t1 long, x2 double, y2 double, t2 long")


def read_columns(spark: SparkSession, path: str, x: str | int, y: str | int, sep: str = ",", header: bool = False) -> DataFrame:
    """Points (x, y) of Parquet by column name or of delimited text by column index (or name, with a header); null where a number
    does not parse."""
    df = spark.read.parquet(path) if isinstance(x, str) and not header else spark.read.csv(path, sep=sep, header=header)
    pick = lambda c: F.col(df.columns[c] if isinstance(c, int) else c).try_cast("double")
    return df.select(pick(x).alias("x"), pick(y).alias("y"))


#: Points (id, x, y, t) from the test tables; the same text runs in Spark and in DuckDB.
FIXTURES = {
    "short": "SELECT l_orderkey AS id, l_quantity AS x, round(l_discount * 100) AS y, l_shipdate AS t FROM lineitem",
    "medium": "SELECT user_id AS id, value AS x, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS DOUBLE) AS y, ts AS t FROM events",
    "walk": "SELECT user_id AS id, CAST(sum(CAST(round(value * 100) AS BIGINT) - 5000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS x, CAST(sum(CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS BIGINT) - 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS y, ts AS t FROM events",
    "customer": "SELECT o_custkey AS id, o_totalprice / 10000 AS x, CAST(month(o_orderdate) AS DOUBLE) AS y, o_orderdate AS t FROM orders",
}
TABLE_OF = {"short": "lineitem", "medium": "events", "walk": "events", "customer": "orders"}


def fixture_points(spark: SparkSession, sf_dir: str, name: str = "short") -> DataFrame:
    table = TABLE_OF[name]
    return spark.sql(FIXTURES[name].replace(f"FROM {table}", "FROM {" + table + "}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})
