"""Nested JSON payloads as VARIANT: flattened to strings at any depth, and read at a path.

A payload is opened within its row: its pieces stand in order, and each level of nesting replaces those that are objects or arrays by what they
hold. So nothing is shuffled or gathered; only rows that nest deeper than ``STEP`` levels are gone over again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.runtime import materialize

#: Deeper payloads than this raise; levels opened in one pass.
MOST_LEVELS, STEP = 1000, 7


def _opened(piece: Column) -> Column:
    """The pieces that a piece (text or v) holds: a key comes before its value, members in order of their keys (as VARIANT keeps them), elements in theirs."""
    done = lambda text: F.struct(F.trim(text).alias("text"), F.lit(None).cast("variant").alias("v"))
    rest = lambda v: F.struct(F.lit(None).cast("string").alias("text"), v.alias("v"))
    members = F.map_entries(F.try_variant_get(piece["v"], "$", "map<string,variant>"))
    elements = F.try_variant_get(piece["v"], "$", "array<variant>")
    held = F.coalesce(
        F.flatten(F.transform(members, lambda m: F.array(done(m["key"]), rest(m["value"])))),
        F.transform(elements, rest),
        F.array(done(F.try_variant_get(piece["v"], "$", "string"))),
    )
    return F.when(piece["v"].isNull(), F.array(piece)).otherwise(held)


def flattened(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key`` and ``strings``: every key and scalar of the payload, in order, trimmed; blank and null ones go. None for null, blank and broken payloads."""
    whole = F.struct(F.lit(None).cast("string").alias("text"), F.try_parse_json(F.col(payload).cast("string")).alias("v"))
    now, parts = df.select(F.col(key), F.array(whole).alias("p")), []
    for _ in range(0, MOST_LEVELS + 1, STEP):
        for _ in range(STEP):
            now = now.withColumn("p", F.filter(F.flatten(F.transform("p", _opened)), lambda x: x["v"].isNotNull() | (x["text"] != "")))
        now = materialize(now.withColumn("open", F.exists("p", lambda x: x["v"].isNotNull())), "payload-pieces")
        parts.append(now.where("not open").select(key, F.col("p.text").alias("strings")))
        now = now.where("open").drop("open")
        if now.isEmpty():
            break
    else:
        raise ValueError(f"payloads nest deeper than {MOST_LEVELS} levels")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def read_path(payload: str | Column, path: str, kind: str = "string") -> Column:
    """What a JSON text holds at ``path`` (``$.a.b[0]``), as ``kind``; null if it isn't there, isn't of that kind, or the text is no JSON."""
    column = F.col(payload) if isinstance(payload, str) else payload
    return F.try_variant_get(F.try_parse_json(column), path, kind)


def point_read(table: DataFrame, key: str, value: str, payload: str, path: str, kind: str = "string") -> DataFrame:
    """One row: the stored payload's value at ``path`` for the row of a key; KeyError if there is no such row."""
    found = table.where(F.col(key) == value).select(key, read_path(payload, path, kind).alias("value"))
    if found.isEmpty():
        raise KeyError(value)
    return found
