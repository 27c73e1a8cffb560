"""Session helpers: the shared folder, durable intermediate tables and their owners, batch bounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Bytes of texts in one Arrow batch, about; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Paths that each open scope owns, innermost last.
_owned: ContextVar[tuple[list[str], ...]] = ContextVar("quern_owned", default=())


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset (a local test
    session), a temporary folder of this machine is set and used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    """Hadoop's file system of ``path``, and the path for it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder. All of an application's paths go when it ends."""
    top = f"{shared_dir(spark)}/quern/{spark.sparkContext.applicationId}"
    fs, place = _hadoop(spark, top)
    if not fs.exists(place):
        fs.mkdirs(place)
        fs.deleteOnExit(place)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    fs, place = _hadoop(spark, path)
    fs.delete(place, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Owns the tables that ``materialize`` writes inside, and removes them at its end.

    What is to outlive the scope is written by ``hand_over``, or outside.
    """
    own: list[str] = []
    token = _owned.set((*_owned.get(), own))
    try:
        yield
    finally:
        _owned.reset(token)
        for path in own:
            remove(spark, path)


def _table(df: DataFrame, name: str, owner: int) -> DataFrame:
    spark = df.sparkSession
    path = shared_path(spark, name)
    scopes = _owned.get()
    if len(scopes) >= owner:
        scopes[-owner].append(path)
    before = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage at a durable copy, so a lost executor costs only the tasks that
    ran on it. Spark removes the write's shuffle files with its last task. The side of a join
    that an aggregate made is a plain shuffle behind such a table, so adaptive execution can
    split a hot key of the other side. The innermost ``scope`` owns the table.
    """
    return _table(df, name, 1)


def hand_over(df: DataFrame, name: str) -> DataFrame:
    """Like ``materialize``, for the scope around the innermost one, or else the application."""
    return _table(df, name, 2)


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, so that a batch of long texts stays small.

    Plans read the option as they run, so all operators ask for one and the same value; a
    smaller one that the session has stays.
    """
    now = spark.conf.get(_BATCH_BYTES)
    if not now.rstrip("b").isdigit() or not 0 < int(now.rstrip("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def prune_joins(spark: SparkSession) -> None:
    """Let Spark test a large table's join keys against a Bloom filter of the small side's.

    Rows without a partner then go before the shuffle. Spark does so by itself above 10 GB; the
    filter's size is bounded by Spark's own settings.
    """
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.enabled", "true")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "1MB")
