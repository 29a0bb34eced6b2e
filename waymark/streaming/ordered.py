"""Ordered release of late and shuffled events, and folds over them, in Structured Streaming.

Rows of a key wait in state until the watermark passes their time and then go, in order,
through the same step functions that batch folds use. With several sources in one stream the
watermark is the smallest over them if spark.sql.streaming.multipleWatermarkPolicy is min.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """A stream over the Parquet files of a folder with the columns of like; files_per_trigger bounds a micro-batch."""
    reader = spark.readStream.schema(like.schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(folder)


def ordered_fold(stream: DataFrame, keys: list[str], time: str, order: list[str], start: Callable, schema: str, delay: str) -> DataFrame:
    """The outputs of a step over each key's rows in the order of time (microseconds) and the other order columns.

    A row is released when the watermark, delay behind the latest time, passes it; rows that
    come after later ones were released are dropped. State holds the waiting rows and the
    step's own state of a key.
    """
    fields = [f.split(" ")[0] for f in schema.split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, step = start()
        waiting, released, own = pickle.loads(state.get[0]) if state.exists else ([], None, first)
        if not state.hasTimedOut:
            for frame in frames:
                waiting += [r for r in frame.drop(columns=["event_time"]).to_dict("records") if released is None or r[time] >= released]
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: tuple(r[c] for c in order))
        ready = [r for r in waiting if r[time] <= mark]
        waiting = waiting[len(ready) :]
        out = []
        for row in ready:
            own, made = step(own, row)
            out += made
            released = row[time]
        state.update((pickle.dumps((waiting, released, own)),))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][time] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out)[fields]

    timed = stream.withColumn("event_time", F.timestamp_micros(F.col(time))).withWatermark("event_time", delay)
    return timed.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", GroupStateTimeout.EventTimeTimeout)


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, tolerance_us: int, delay: str, how: str = "inner") -> DataFrame:
    """Pairs of two streams whose times (microseconds) differ by no more than the tolerance; with how = "leftOuter" rows without a partner follow when the watermark has passed them.

    Right columns get the prefix r_. State is bounded by the watermark and the interval.
    """
    lt = left.withColumn("event_time", F.timestamp_micros(F.col(time))).withWatermark("event_time", delay)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("r_event_time", F.timestamp_micros(F.col(f"r_{time}"))).withWatermark("r_event_time", delay)
    gap = F.expr(f"interval {tolerance_us} microseconds")
    on = (F.col("r_event_time") >= F.col("event_time") - gap) & (F.col("r_event_time") <= F.col("event_time") + gap)
    for k in keys:
        on = on & (F.col(k) == F.col(f"r_{k}"))
    return lt.join(r, on, how)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a folder and return what it wrote."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
