"""Shared inputs of the registered queries, as DataFrames and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r(column, digits: int = 6, name: str | None = None):
    """Rounded double."""
    c = F.round(F.col(column) if isinstance(column, str) else column, digits)
    return c.alias(name or column) if name or isinstance(column, str) else c


def brand_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel: revenue by day and brand, in thousands. Summed in whole ten-thousandths, so in any order alike."""
    items, parts = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    joined = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    revenue = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 10000).cast("long")
    daily = joined.groupBy(F.to_date("l_shipdate").alias("day"), F.col("p_brand").alias("brand")).agg(F.sum(revenue).alias("n"))
    return daily.select(F.date_format("day", "yyyy-MM-dd").alias("d"), "brand", (F.col("n") / 1e7).alias("ret"))


BRAND_DAYS = """panel AS (SELECT strftime(l_shipdate, '%Y-%m-%d') AS d, p_brand AS brand,
    CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 10000) AS BIGINT)) AS DOUBLE) / 1e7 AS ret FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""


def flag_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series: mean quantity by day for each return flag."""
    items = read(spark, sf_dir, "lineitem")
    daily = items.groupBy(F.col("l_returnflag").alias("series"), F.to_date("l_shipdate").alias("day")).agg(F.avg("l_quantity").alias("y"))
    return daily.select("series", F.date_format("day", "yyyy-MM-dd").alias("d"), "y")


FLAG_DAYS = "days AS (SELECT l_returnflag AS series, strftime(l_shipdate, '%Y-%m-%d') AS d, avg(l_quantity) AS y FROM lineitem GROUP BY 1, 2)"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table to measure: y, a prediction, an interval, a label with a score and a class."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(
        "l_orderkey", "l_linenumber", "l_returnflag",
        (F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_quantity") * 1.5 + F.col("l_tax") * 10).alias("yhat"),
        (F.col("l_quantity") * 1.2).alias("low"),
        (F.col("l_quantity") * 1.8).alias("high"),
        (F.col("l_linestatus") == "F").cast("int").alias("label"),
        F.round(F.col("l_discount") * 8 + F.col("l_tax"), 4).alias("score"),
        F.when(F.col("l_quantity") > 33, "R").when(F.col("l_quantity") > 16, "A").otherwise("N").alias("guess"),
    )


PREDICTIONS = """pred AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice / 1000 AS y, l_quantity * 1.5 + l_tax * 10 AS yhat,
    l_quantity * 1.2 AS low, l_quantity * 1.8 AS high, CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS label,
    round(l_discount * 8 + l_tax, 4) AS score,
    CASE WHEN l_quantity > 33 THEN 'R' WHEN l_quantity > 16 THEN 'A' ELSE 'N' END AS guess FROM lineitem)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog entries made of the parts: key, kind, text, tags, fields."""
    p = read(spark, sf_dir, "part")
    return p.select(
        F.format_string("part-%05d", "p_partkey").alias("key"),
        F.lower("p_type").alias("kind"),
        F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("search_text"),
        F.split(F.concat_ws(" ", "p_name", F.concat(F.lit("size"), F.col("p_size").cast("string"))), " ").alias("tags"),
        F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")).alias("fields"),
        "p_partkey", "p_brand", "p_size", "p_name",
    )


ENTRIES = """entries AS (SELECT format('part-{:05d}', p_partkey) AS key, lower(p_type) AS kind,
    lower(p_name || ' ' || p_brand || ' ' || p_type) AS search_text, string_split(p_name || ' size' || p_size, ' ') AS tags,
    p_partkey, p_brand, p_size, p_name, p_type FROM part)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The experiment log made of the events: seq, run_name, event, step, payload."""
    e = read(spark, sf_dir, "events")
    step = F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 100)
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_name"), F.col("event_type").alias("event"), step.alias("step"), F.col("props").alias("payload"), "value", "ts")


LOG = """log AS (SELECT event_id AS seq, user_id AS run_name, event_type AS event,
    CASE WHEN event_id % 7 <> 0 THEN event_id % 100 END AS step, props AS payload, value, ts FROM events)"""
