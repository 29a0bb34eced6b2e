"""Long runs folded in parallel: chunks are summarised, summaries composed, chunks replayed.

A fold whose steps can be summarised (as an affine map, a motion with its covariance) needs no
single task for one run. Rows are dealt out by range of key and order, so a run is a sequence of
chunks; each chunk that goes on in the next is summarised, the summaries before a chunk give the
state it starts from, and all chunks are then folded at once by the same steps as before. At most
two keys of a partition reach over its edges, so what the driver composes is two rows and one
summary a partition, whatever the table's size.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import lie
from waymark.operators import folds, inertial
from waymark.operators.select import checkpointed


@dataclass(frozen=True)
class Composition:
    """A fold with summaries.

    start() gives the first state and the step, as in folds.fold(). summarise(rows, before, count)
    is what the rows of a chunk do to a state, where before is the row ahead of them (None at the
    run's start) and count how many rows of the run there were; compose(a, b) is a, then b;
    advance(state, summary) is the state after the summarised rows.
    """

    start: Callable[[], tuple]
    summarise: Callable[[Iterator[dict], dict | None, int], Any]
    compose: Callable[[Any, Any], Any]
    advance: Callable[[Any, Any], Any]


def _pieces(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of a partition with their key, in order, a batch at a time: (key, rows of that key in the batch)."""
    for batch in batches:
        rows, own = [], object()
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != own and rows:
                yield own, rows
                rows = []
            own = key
            rows.append(row)
        if rows:
            yield own, rows


def fold(df: DataFrame, keys: list[str], order: list[str], how: Composition, schema: str, parts: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """folds.fold() in that many chunks (None: the session's shuffle partitions), with one run over as many tasks as its rows reach.

    The rows are shuffled once, by range, and checkpointed, as three passes need the same chunks;
    rows whose keys and order are equal stay in one chunk. Equal to the sequential fold up to the
    rounding of sums. An empty table gives no rows.
    """
    columns = columns or df.columns
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*columns).repartitionByRange(parts, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id())
    rows = checkpointed(rows)
    packed = "part int, key binary, n long, whole boolean, last binary"

    def edges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list] = []  # the first and the last key: key, rows, last row
        part = None
        for key, some in _pieces(batches, keys):
            part = some[0]["_part"]
            if not found or found[-1][0] != key:
                del found[1:]
                found.append([key, 0, None])
            found[-1][1] += len(some)
            found[-1][2] = some[-1]
        out = [{"part": part, "key": pickle.dumps(k), "n": n, "whole": len(found) == 1, "last": pickle.dumps(last)} for k, n, last in found]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("key", pa.binary()), ("n", pa.int64()), ("whole", pa.bool_()), ("last", pa.binary())]))

    found = sorted(rows.mapInArrow(edges, packed).collect(), key=lambda r: (r.part, r.whole))  # two rows a partition at most
    at: dict[int, list] = {}
    for r in found:
        at.setdefault(r.part, []).append((pickle.loads(bytes(r.key)), r.n, pickle.loads(bytes(r.last))))
    # a partition with two has them in the order of the keys' first rows: mapInArrow keeps it, the sort is stable
    goes_on: dict[int, tuple[dict, int]] = {}  # part -> row ahead of it and rows of the run so far, where its first key is the one before's last
    before: tuple | None = None
    for part in sorted(at):
        first, last = at[part][0], at[part][-1]
        count = 0
        if before is not None and before[0] == first[0]:
            goes_on[part], count = (before[2], before[1]), before[1]
        before = (last[0], last[1] + (count if len(at[part]) == 1 else 0), last[2])
    order_of = sorted(at)
    feeds = {p for p, following in zip(order_of, order_of[1:], strict=False) if following in goes_on}  # parts whose last key goes on

    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(batches, keys)
        head = next(pieces, None)
        if head is None or head[1][0]["_part"] not in feeds:
            return
        part = head[1][0]["_part"]
        carried, one = goes_on.get(part), len(at[part]) == 1
        wanted = at[part][-1][0]

        def own() -> Iterator[dict]:
            if head[0] == wanted:
                yield from head[1]
            for key, some in pieces:
                if key == wanted:
                    yield from some

        row, count = carried if one and carried else (None, 0)
        made = pickle.dumps(how.summarise(own(), row, count))
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([made], pa.binary())], ["part", "summary"])

    made = {r.part: pickle.loads(bytes(r.summary)) for r in rows.mapInArrow(summaries, "part int, summary binary").collect()} if feeds else {}
    states: dict[int, Any] = {}  # exclusive scan: the state that a part's first key starts from
    for part, following in zip(order_of, order_of[1:], strict=False):
        if following in goes_on:
            begun = states[part] if len(at[part]) == 1 and part in states else how.start()[0]
            states[following] = how.advance(begun, made[part])
    shared = df.sparkSession.sparkContext.broadcast(states)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def replay(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state, step, begun = object(), None, None, False
        for key, some in _pieces(batches, keys):
            if key != own:
                state, step = how.start()
                if not begun and some[0]["_part"] in shared.value:
                    state = shared.value[some[0]["_part"]]
                own, begun = key, True
            out: list[dict] = []
            for row in some:
                del row["_part"]
                state, more = step(state, row)
                out += more
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(replay, schema)


# ---- folds with summaries ----


def running_mean(value: str, cap: int, out: str) -> Composition:
    """folds.running_mean(): a chunk is an affine map of the mean, whose gains follow from the rows before it."""

    def summarise(rows: Iterator[dict], before: dict | None, count: int):
        n, keep, add = 0, 1.0, 0.0
        for row in rows:
            n += 1
            w = 1 / min(cap, count + n)
            keep, add = keep * (1 - w), add * (1 - w) + w * row[value]
        return n, keep, add

    return Composition(folds.running_mean(value, cap, out), summarise, lambda a, b: (a[0] + b[0], a[1] * b[1], b[1] * a[2] + b[2]), lambda s, e: (s[0] + e[0], e[1] * s[1] + e[2]))


def preintegrate(time: str, value: str, max_dt: int) -> Composition:
    """folds.preintegrate(): a chunk is a length of time, a change of velocity and one of place, from rest."""

    def summarise(rows: Iterator[dict], before: dict | None, count: int):
        last, length, dv, dp = before and before[time], 0.0, 0.0, 0.0
        for row in rows:
            if last is not None and 0 < row[time] - last <= max_dt:
                dt = (row[time] - last) / 1e6
                dp += dv * dt + 0.5 * row[value] * dt * dt
                dv += row[value] * dt
                length += dt
            last = row[time]
        return last, length, dv, dp

    def compose(a, b):
        return b[0], a[1] + b[1], a[2] + b[2], a[3] + a[2] * b[1] + b[3]

    return Composition(folds.preintegrate(time, value, max_dt), summarise, compose, lambda s, e: (e[0], s[1] + e[2], s[2] + s[1] * e[1] + e[3]))


def _turned(r: np.ndarray) -> np.ndarray:
    """Errors of place, velocity and gravity turned by a rotation."""
    out = np.eye(inertial.N)
    for part in (inertial.PLACE, inertial.VELOCITY, inertial.GRAVITY):
        out[part, part] = r
    return out


def inertial_propagation(time: str, unit: float, noise: inertial.Noise, start: inertial.State | None = None) -> Composition:
    """inertial.inertial_fold(): a chunk is a motion from rest without gravity, and what it does to the covariance.

    Errors of place, velocity and gravity are held in the frame of the chunk's first turn, where
    neither the transitions nor their noise depend on the state it starts from.
    """
    first = start or inertial.State()
    rest = {"rotation": np.eye(3), "place": np.zeros(3), "velocity": np.zeros(3), "gravity": np.zeros(3)}

    def summarise(rows: Iterator[dict], before: dict | None, count: int):
        s = inertial.State(**rest, gyro_bias=first.gyro_bias, accel_bias=first.accel_bias)
        phi, q, length = np.eye(inertial.N), np.zeros((inertial.N, inertial.N)), 0.0
        last, t0 = inertial.reading(before), before and before[time] / unit
        for row in rows:
            t, now = row[time] / unit, inertial.reading(row)
            if t0 is not None and last is not None and now is not None and 0 < t - t0 <= noise.max_gap:
                mean = (last + now) / 2
                f, more = inertial.transition(s, mean[:3], mean[3:], t - t0, noise)
                s = inertial.moved(s, mean[:3], mean[3:], t - t0)
                phi, q, length = f @ phi, f @ q @ f.T + more, length + t - t0
            t0, last = t if t0 is None else max(t, t0), now
        return t0, last, length, s.rotation, s.velocity, s.place, phi, q

    def compose(a, b):
        w = _turned(a[3])
        f = w @ b[6] @ w.T
        return b[0], b[1], a[2] + b[2], a[3] @ b[3], a[4] + a[3] @ b[4], a[5] + a[4] * b[2] + a[3] @ b[5], f @ a[6], f @ a[7] @ f.T + w @ b[7] @ w.T

    def advance(state, e):
        s = state[0] or first
        w, length = _turned(s.rotation), e[2]
        f = w @ e[6] @ w.T
        place = s.place + s.velocity * length + s.gravity * length**2 / 2 + s.rotation @ e[5]
        covariance = f @ s.covariance @ f.T + w @ e[7] @ w.T
        moved = inertial.State(e[0], s.rotation @ e[3], place, s.velocity + s.gravity * length + s.rotation @ e[4], s.gyro_bias, s.accel_bias, s.gravity, (covariance + covariance.T) / 2)
        return moved, e[1]

    return Composition(inertial.inertial_fold(time, unit, noise, start), summarise, compose, advance)
