"""Sources: Parquet (local or object store), CSV, JDBC and Hive queries, JSON, with one result contract.

All numeric columns come back as doubles, with the target (the last column by default) named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.prep import drop_incomplete, split_target, zscore
from quern.operators.timeseries import lag_table


def parquet(spark: SparkSession, path: str, target: str | None = None) -> tuple[DataFrame, list[str], str]:
    return split_target(spark.read.parquet(path), target)


def s3_parquet(spark: SparkSession, bucket: str, prefix: str, endpoint: str | None = None, access_key: str | None = None, secret_key: str | None = None, target: str | None = None):
    """The Parquet files right below ``bucket/prefix``; connection settings hold for this read alone."""
    given = {"endpoint": endpoint, "access.key": access_key, "secret.key": secret_key}
    reader = spark.read.options(**{f"fs.s3a.{name}": value for name, value in given.items() if value})
    return split_target(reader.parquet(f"s3a://{bucket}/{prefix.strip('/')}/*.parquet"), target)


def named_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The listed columns in their order, or all; KeyError for one that is missing."""
    missing = [c for c in columns or [] if c not in df.columns]
    if missing:
        raise KeyError(", ".join(missing))
    return df.select(*columns) if columns else df


def hive_query(spark: SparkSession, query: str, target: str | None = None):
    """A query against the session's metastore; empty queries and results are errors."""
    if not query.strip():
        raise ValueError("empty query")
    df = spark.sql(query)
    if df.isEmpty():
        raise ValueError("no rows")
    return split_target(df, target)


def jdbc_query(spark: SparkSession, url: str, query: str, driver: str, target: str | None = None, partition: tuple[str, int, int, int] | None = None, **options: str):
    """A query pushed to a database; ``partition`` (column, low, high, parts) reads it in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("driver", driver).options(**options)
    if partition:
        column, low, high, parts = partition
        reader = reader.option("dbtable", f"({query}) q").option("partitionColumn", column).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    else:
        reader = reader.option("query", query)
    return split_target(reader.load(), target)


def csv(spark: SparkSession, path: str, include: list[str] | None = None, exclude: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> DataFrame:
    """A CSV with header; columns by whitelist, in file order, without the excluded names and prefixes."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    return df.select([c for c in df.columns if (include is None or c in include) and c not in exclude and not c.startswith(prefixes or ("\0",))])


def factor_csv(spark: SparkSession, path: str, groups: dict[str, list[str]], target: str) -> tuple[DataFrame, dict[str, list[str]]]:
    """The target and the factors of all groups that the file has, complete rows only, factors standardised; the groups as found."""
    df = spark.read.csv(path, header=True, inferSchema=True)
    found = {g: [c for c in names if c in df.columns] for g, names in groups.items()}
    factors = list(dict.fromkeys(c for names in found.values() for c in names))
    rows = drop_incomplete(df.select(target, *(F.col(c).cast("double").alias(c) for c in factors)))
    return zscore(rows, factors), found


def returns(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """Date and numeric columns only; infinite values count as missing, rows with gaps go."""
    df = spark.read.parquet(path)
    date = date or ("date" if "date" in df.columns else df.columns[0])
    numeric = [c for c, t in df.dtypes if c != date and t in ("double", "float", "int", "bigint", "smallint", "tinyint")]
    if not numeric:
        raise ValueError("no numeric column")
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")).alias(c)
    return df.select(date, *map(value, numeric)).dropna("any")


def json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def sine(spark: SparkSession, n: int = 0, frequency: float = 1.0, noise: float = 0.0, seed: int = 42, at: DataFrame | None = None) -> DataFrame:
    """t and sin(frequency * t) plus seeded normal noise, for t from 0 to n, or for the t of ``at``."""
    rows = spark.range(n).withColumnRenamed("id", "t") if at is None else at.select("t")
    wave = F.sin(F.col("t") * frequency)
    return rows.select("t", (wave + noise * F.randn(seed) if noise else wave).alias("y"))


def sine_windows(df: DataFrame, y: str, order: str, window: int) -> DataFrame:
    """lag_0 (oldest) .. lag_n of each window of a series, and the value after it as target."""
    rows = lag_table(df, [y], order, [], window).dropna()
    return rows.select(order, *(F.col(f"{y}_{window - k}").alias(f"lag_{k}") for k in range(window)), F.col(y).alias("target"))
