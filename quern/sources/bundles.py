"""Artifact bundles: tables and facts of a finished run, kept together without pickled code.

A bundle is one commit of a ``TableStore``: its tables are profiles, its facts a table of one JSON row. What is read back is what was committed
together, and reading runs no code of the bundle's.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quern.sources.store import TableStore

FACTS = "_facts"


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], facts: dict[str, Any] | None = None) -> None:
    """Write a bundle, in place of one that may be there. Facts are what JSON can hold."""
    if FACTS in tables:
        raise ValueError(f"{FACTS} is no name for a table")
    text = json.dumps({"facts": facts or {}, "tables": {n: t.schema.jsonValue() for n, t in tables.items()}}, sort_keys=True)
    store = TableStore(spark, path)
    number, _ = store.state()
    staged = {name: store._stage(rows) for name, rows in {**tables, FACTS: spark.createDataFrame([(text,)], "facts string")}.items()}
    store._commit(number, staged)


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict[str, Any]]:
    """(tables by name, facts) of the last bundle; KeyError if there is none."""
    store = TableStore(spark, path)
    held = json.loads(store.read(FACTS).first().facts)
    return {name: store.read(name) for name in held["tables"]}, held["facts"]


def describe(spark: SparkSession, path: str) -> DataFrame:
    """table, column and type of everything in the bundle, without reading its data."""
    held = json.loads(TableStore(spark, path).read(FACTS).first().facts)
    rows = [(name, f["name"], json.dumps(f["type"])) for name, schema in held["tables"].items() for f in schema["fields"]]
    return spark.createDataFrame(rows, "table string, column string, type string")
