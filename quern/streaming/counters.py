"""Outcome counters as an upsert stream: keyed state, safe against repeated records and restarts.

Each key's totals and the ids of its records are state of Spark's own (RocksDB), so a record that comes again, in the same batch or a later one, or after
a restart from the checkpoint, counts once. Ids are kept for ``remember`` of processing time; None keeps them for good.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

TOTALS = "seen long, success long, failure long, total_delta_score double, total_selected_score double"
_NAMES = [c.split()[0] for c in TOTALS.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def outcomes(log: DataFrame, keys: list[str], record: str, success: Column | None = None, delta: Column | None = None, selected: Column | None = None) -> DataFrame:
    """``keys``, record_id and what a record adds: a touch (success is null) adds to seen alone."""
    nothing = F.lit(None).cast("boolean") if success is None else success.cast("boolean")
    number = lambda c: F.lit(0.0) if c is None else F.when(nothing.isNotNull(), F.coalesce(c.cast("double"), F.lit(0.0))).otherwise(0.0)
    return log.select(*keys, F.col(record).cast("string").alias("record_id"), nothing.alias("ok"), number(delta).alias("delta"), number(selected).alias("selected"))


def totals(records: DataFrame, keys: list[str]) -> DataFrame:
    """The counters of a table of ``outcomes``: each record_id once in its key. What the stream comes to."""
    once = records.groupBy(*keys, "record_id").agg(F.min_by(F.struct("ok", "delta", "selected"), F.struct("ok", "delta", "selected")).alias("r"))
    return once.groupBy(*keys).agg(
        F.count("*").alias("seen"), F.count(F.when(F.col("r.ok"), 1)).alias("success"), F.count(F.when(~F.col("r.ok"), 1)).alias("failure"),
        F.sum("r.delta").alias("total_delta_score"), F.sum("r.selected").alias("total_selected_score"),
    )


class _Counter(StatefulProcessor):
    def __init__(self, keys: list[str], remember_ms: int | None):
        self.keys, self.remember_ms = keys, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("totals", TOTALS)
        ttl = {} if self.remember_ms is None else {"ttlDurationMs": self.remember_ms}
        self.records = handle.getMapState("records", "record_id string", "counted boolean", **ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = list(self.totals.get()) if self.totals.exists() else [0, 0, 0, 0.0, 0.0]
        for batch in rows:
            for record, ok, delta, selected in batch[["record_id", "ok", "delta", "selected"]].itertuples(index=False):
                if self.records.containsKey((record,)):
                    continue
                self.records.updateValue((record,), (True,))
                touch = ok is None or pd.isna(ok)
                now = [now[0] + 1, now[1] + (not touch and bool(ok)), now[2] + (not touch and not ok), now[3] + float(delta), now[4] + float(selected)]
        now = [int(v) for v in now[:3]] + now[3:]
        self.totals.update(tuple(now))
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key, strict=True)}, **{n: [v] for n, v in zip(_NAMES, now, strict=True)}})

    def close(self) -> None:
        pass


def stream(records: DataFrame, keys: list[str], remember_ms: int | None = None) -> DataFrame:
    """The running totals of each key that a batch touches. ``records`` is a stream of ``outcomes`` whose record_ids aren't null.

    The session must use the RocksDB state store (``ROCKSDB``).
    """
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema.fields if f.name in keys), TOTALS])
    return records.groupBy(*keys).transformWithStateInPandas(_Counter(keys, remember_ms), schema, "Update", "None")


def upsert(totals: DataFrame, keys: list[str], store, name: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of running totals into a ``sources.store.TableStore``; what is there is worked off, then it ends.

    A batch that is repeated after a failure writes the same totals over themselves.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        store.upsert(name, batch, keys)

    return totals.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
