"""Sinks: one profile's partition replaced as a whole, an append-only event log, JDBC tables, JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame


def jdbc(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None, mode: str = "append", batch: int = 10_000) -> None:
    """Write to a database table, a connection for each partition; ``overwrite`` empties the table and keeps its definition."""
    df.write.option("truncate", "true").option("batchsize", batch).jdbc(url, table, mode=mode, properties=properties or {})


def json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def fresh_rows(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not known yet, one for each key."""
    return df.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write ``df`` so that only the partitions it has are replaced."""
    df.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def append_new(df: DataFrame, path: str, key: str) -> int:
    """Append the rows whose key the log doesn't have; number of rows written."""
    spark = df.sparkSession
    fresh = fresh_rows(df, spark.read.parquet(path), key).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n
