"""Keyed state of streams in a state store: entries with a life of their own instead of one value rewritten at each batch.

The store is RocksDB (spark.sql.streaming.stateStore.providerClass), as Spark asks for here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.streaming import queues

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Ask the session for the state store that keyed state needs, where it has Spark's default."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(setting):
        spark.conf.set(setting, STORE)


class _Evictor(StatefulProcessor):
    """Last time of each entry, as a map in the store; a batch writes the entries that it changed."""

    def __init__(self, time: str, entry: str, order: list[str], ttl: int, most: int, fields: list[str]):
        self.step = queues.evicting_state(time, entry, ttl, most)()[1]
        self.order, self.fields = order, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "entry bigint", "t bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        before = {k[0]: v[0] for k, v in self.last.iterator()}
        now, out = dict(before), []
        for row in batch.to_dict("records"):
            now, made = self.step(now, row)
            out += made
        for k in before.keys() - now.keys():
            self.last.removeKey((k,))
        for k, t in now.items():
            if before.get(k) != t:
                self.last.updateValue((int(k),), (int(t),))
        if out:
            yield pd.DataFrame(out)[self.fields]

    def close(self) -> None:
        pass


def evicting_stream(stream: DataFrame, keys: list[str], time: str, entry: str, order: list[str], ttl: int, most: int, schema: str) -> DataFrame:
    """queues.evicting_state() over a stream whose batches come in order: the entries that go, by age or by number, oldest first (ties: the smaller).

    State is a map of at most that many entries a key; a batch reads it once and writes what changed.
    """
    use_rocksdb(stream.sparkSession)
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    rows = stream.withColumn(entry, F.col(entry).cast("long")).withColumn(time, F.col(time).cast("long"))
    return rows.groupBy(*keys).transformWithStateInPandas(_Evictor(time, entry, order, ttl, most, fields), schema, "Append", "None")


class _Queue(StatefulProcessor):
    """A step whose state is a list of rows, with a counter where it has one: a list in the store, written when a batch changed it."""

    def __init__(self, start, counted: bool, order: list[str], columns: list[str], kinds: str, fields: list[str]):
        self.start, self.counted, self.order, self.columns, self.kinds, self.fields = start, counted, order, columns, kinds, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.kinds)
        self.n = handle.getValueState("n", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable").astype(object)
        batch = batch.where(batch.notna(), None)
        before = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        held = [dict(zip(self.columns, r, strict=True)) for r in before]
        step = self.start()[1]
        state = (held, self.n.get()[0] if self.n.exists() else 0) if self.counted else held
        out = []
        for row in batch[self.columns].to_dict("records"):
            state, made = step(state, row)
            out += made
        if self.counted:
            self.n.update((int(state[1]),))
        after = [tuple(r[c] for c in self.columns) for r in (state[0] if self.counted else state)]
        if after != before:
            if after:
                self.waiting.put(after)
            else:
                self.waiting.clear()
        if out:
            yield pd.DataFrame(out)[self.fields]

    def close(self) -> None:
        pass


def queue_stream(stream: DataFrame, keys: list[str], order: list[str], start, schema: str, counted: bool) -> DataFrame:
    """queues.bounded_queue() (counted) or queues.pending() over a stream whose batches come in order: the same rows as the batch fold.

    State is the list of a key's waiting rows, bounded by the step's capacity; a batch reads it once and writes it if it changed.
    """
    use_rocksdb(stream.sparkSession)
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stream.schema.fields)
    return stream.groupBy(*keys).transformWithStateInPandas(_Queue(start, counted, order, stream.columns, kinds, fields), schema, "Append", "None")
