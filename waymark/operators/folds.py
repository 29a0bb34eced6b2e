"""Ordered folds: one step function, used in batch over a key's sorted rows and in streams over its state.

A step takes (state, row) and returns (state, outputs); rows come as dictionaries. Batch runs
the step as rows stream by in the order of key and time, so a key may be of any length;
memory holds one key's state.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from waymark.operators.select import in_tasks

Step = Callable[[Any, dict], tuple[Any, list[dict]]]


def _records(column: pa.Array) -> list | None:
    """Lists of structs of doubles as NumPy records, one array a row; None if the column has other values, or nulls within its lists."""
    if not pa.types.is_list(column.type) or not pa.types.is_struct(column.type.value_type):
        return None
    items, fields = column.flatten(), list(column.type.value_type)
    if items.null_count or not all(pa.types.is_float64(f.type) and not items.field(k).null_count for k, f in enumerate(fields)):
        return None
    out = np.empty(len(items), [(f.name, float) for f in fields])
    for k, f in enumerate(fields):
        out[f.name] = items.field(k).to_numpy()
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy()).tolist()
    return [out[a:b] if there else None for a, b, there in zip([0, *ends], ends, column.is_valid().to_pylist(), strict=False)]


def _rows(batch: pa.RecordBatch, records: Iterable[str] = ()) -> Iterator[dict]:
    """A batch's rows as dictionaries, numbers by way of NumPy, which is much faster than one by one; lists of structs of the named columns as records where they can be."""
    plain = lambda c: not c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
    names = batch.schema.names
    columns = [c.to_numpy(zero_copy_only=False).tolist() if plain(c) else (_records(c) if n in records else None) or c.to_pylist() for n, c in zip(names, batch.columns, strict=True)]
    return (dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """Dictionaries as a batch, column by column."""
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def fold(df: DataFrame, keys: list[str], order: list[str], step: Callable[[], tuple[Any, Step]], schema: str, columns: list[str] | None = None, late: dict[str, Column] | None = None) -> DataFrame:
    """The outputs of a step over each key's rows in order; step() gives the first state and the step function, and, if the last state has something to say, a function of it.

    late are columns that are made of the others once the rows are in order, so that large ones
    are never shuffled or sorted; as their bytes don't show before, tasks are a given number then.
    Lists of structs of doubles among them come as NumPy records.
    """
    columns = columns or df.columns
    spark_schema = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark_schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, f, end = object(), None, None, None
        for batch in batches:
            out: list[dict] = []
            for row in _rows(batch, records):
                own = tuple(row[k] for k in keys)
                if own != key:
                    if end:
                        out += end(state)
                    key, (state, f, *rest) = own, step()
                    end = rest[0] if rest else None
                state, made = f(state, row)
                out += made
            if out:
                yield _batch(out, arrow)
        if end and (out := end(state)):
            yield _batch(out, arrow)

    records = list(late or ())
    rows = in_tasks(df.select(*columns), keys) if late else df.select(*columns).repartition(*keys)
    return rows.sortWithinPartitions(*keys, *order).withColumns(late or {}).mapInArrow(run, schema)


def rate_gate(time: str, interval: int) -> Callable:
    """Keep a row if it comes at least interval after the last kept one."""

    def start():
        def step(last, row):
            if last is None or row[time] - last >= interval:
                return row[time], [row]
            return last, []

        return None, step

    return start


def keyframes(time: str, distance: float, interval: int, both: bool = False) -> Callable:
    """Keep a pose (x, y) if it is far enough in space or (both: and) time from the last kept one."""

    def start():
        def step(last, row):
            if last is not None:
                dx, dy = row["x"] - last[0], row["y"] - last[1]
                far = math.sqrt(dx * dx + dy * dy) >= distance  # not hypot(), whose last bit may be another at the limit
                late = row[time] - last[2] >= interval
                if not ((far and late) if both else (far or late)):
                    return last, []
            return (row["x"], row["y"], row[time]), [row]

        return None, step

    return start


def running_mean(value: str, cap: int, out: str) -> Callable:
    """Mean that weighs a new value by one over the count so far, cap at most."""

    def start():
        def step(state, row):
            n, mean = state
            n += 1
            mean += (row[value] - mean) / min(cap, n)
            return (n, mean), [{**row, out: mean, "n": n}]

        return (0, 0.0), step

    return start


def anchors(value: str, alpha: float, mature: int, most: float, out: str) -> Callable:
    """Exponential mean whose mature state skips values that differ from it by more than most."""

    def start():
        def step(state, row):
            n, mean = state
            skipped = n >= mature and abs(row[value] - mean) > most
            if not skipped:
                mean = row[value] if n == 0 else mean + alpha * (row[value] - mean)
                n += 1
            return (n, mean), [{**row, out: mean, "n": n, "skipped": skipped}]

        return (0, 0.0), step

    return start


def agreement(value: str, tolerance: float, needed: int) -> Callable:
    """Confirm a value once enough successive ones agree with the first of their run."""

    def start():
        def step(state, row):
            base, n = state
            if base is not None and abs(row[value] - base) <= tolerance:
                n += 1
            else:
                base, n = row[value], 1
            return (base, n), [{**row, "support": n, "confirmed": n >= needed}]

        return (None, 0), step

    return start


def streak(value: str, jump: float, needed: int) -> Callable:
    """Smooth by 3/4 and 1/4; a jump starts the streak anew, and only a long enough streak is accepted."""

    def start():
        def step(state, row):
            mean, n = state
            if mean is None or abs(row[value] - mean) > jump:
                mean, n = row[value], 1
            else:
                mean, n = 0.75 * mean + 0.25 * row[value], n + 1
            return (mean, n), [{**row, "smooth": mean, "streak": n, "accepted": n >= needed}]

        return (None, 0), step

    return start


def cooldown(time: str, interval: int, budget: int) -> Callable:
    """Accept a row if the last accepted one is long enough ago and the budget is not spent."""

    def start():
        def step(state, row):
            last, n = state
            if n < budget and (last is None or row[time] - last >= interval):
                return (row[time], n + 1), [row]
            return state, []

        return (None, 0), step

    return start


def rate_limited(time: str, value: str, rate: float, gap: int, out: str) -> Callable:
    """Follow a target by no more than rate per second; after a gap start from it."""

    def start():
        def step(state, row):
            last, now = state
            if last is None or row[time] - last > gap:
                now = row[value]
            else:
                most = rate * (row[time] - last) / 1e6
                now += max(-most, min(most, row[value] - now))
            return (row[time], now), [{**row, out: now}]

        return (None, 0.0), step

    return start


def grade_limited(height: str, grade: float, dead: float, alpha: float, most_step: float, most: float, out: str) -> Callable:
    """Correction that pulls a height towards a path of limited grade: dead-band, gain, limits of step and total."""

    def start():
        def step(state, row):
            if state is None:
                return (row["x"], row["y"], row[height], 0.0), [{**row, out: 0.0}]
            x, y, z, correction = state
            reach = grade * math.hypot(row["x"] - x, row["y"] - y)
            prior = z + max(-reach, min(reach, row[height] + correction - z))
            miss = prior - (row[height] + correction)
            if abs(miss) > dead:
                correction += max(-most_step, min(most_step, alpha * miss))
                correction = max(-most, min(most, correction))
            return (row["x"], row["y"], prior, correction), [{**row, out: correction}]

        return None, step

    return start


def suppressed(ident: str, apart: int, cap: int) -> Callable:
    """Greedy suppression over rows in order of rank: keep a row whose id is far enough from all kept, cap at most."""

    def start():
        def step(kept, row):
            if len(kept) < cap and all(abs(row[ident] - k) >= apart for k in kept):
                return [*kept, row[ident]], [row]
            return kept, []

        return [], step

    return start


def one_per_cell(cells: list[list[str]], cap: int) -> Callable:
    """Greedy pick over rows in order of rank: keep a row none of whose cells (tuples of columns) is taken, cap at most."""

    def start():
        def step(state, row):
            taken, n = state
            own = [(k, *(row[c] for c in columns)) for k, columns in enumerate(cells)]
            if n < cap and not any(o in taken for o in own):
                taken.update(own)
                return (taken, n + 1), [row]
            return state, []

        return (set(), 0), step

    return start


def preintegrate(time: str, value: str, max_dt: int) -> Callable:
    """Velocity and position from an acceleration, steps out of (0, max_dt] left out."""

    def start():
        def step(state, row):
            last, v, p = state
            if last is not None and 0 < row[time] - last <= max_dt:
                dt = (row[time] - last) / 1e6
                p += v * dt + 0.5 * row[value] * dt * dt
                v += row[value] * dt
            return (row[time], v, p), [{**row, "dv": v, "dp": p}]

        return (None, 0.0, 0.0), step

    return start


def together(*starts: Callable) -> Callable:
    """Steps that give a row for each row, one after the other on the same row, each with a state of its own."""

    def start():
        firsts, steps = zip(*(s() for s in starts), strict=True)

        def step(states, row):
            after = []
            for state, f in zip(states, steps, strict=True):
                state, [row] = f(state, row)
                after.append(state)
            return after, [row]

        return list(firsts), step

    return start


def associate(radius: float, cap: int | None = None, out: str = "object") -> Callable:
    """Assign each observation (x, y, label) to the nearest object of its label within radius, else to a new one; objects follow by running mean.

    Objects lie in cells of the radius, so an observation looks at those around it only, however
    many there are. A caller that wants no more than cap objects gets null for what would be one
    more; so few are looked through in turn.
    """

    def start():
        def step(state, row):
            known, n = state  # objects by label and cell, and how many there are
            x, y, label = row["x"], row["y"], row["label"]
            ix, iy = (0, 0) if cap else (x // radius, y // radius)
            best, least = None, radius
            for cell in [(label, 0, 0)] if cap else [(label, ix + i, iy + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                for o in known.get(cell, ()):
                    distance = math.hypot(o[0] - x, o[1] - y)
                    if distance < least or (best and distance == least and o[3] < best[3]):  # of equally near ones the first
                        best, least = o, distance
            if best is None and (cap is None or n < cap):
                best = [x, y, 0, n, (label, ix, iy)]
                known.setdefault(best[4], []).append(best)
                n += 1
            if best is None:
                return (known, n), [{**row, out: None}]
            best[2] += 1
            share = min(20, best[2])
            best[0] += (x - best[0]) / share
            best[1] += (y - best[1]) / share
            if not cap and (moved := (label, best[0] // radius, best[1] // radius)) != best[4]:
                known[best[4]].remove(best)
                known.setdefault(moved, []).append(best)
                best[4] = moved
            return (known, n), [{**row, out: best[3]}]

        return ({}, 0), step

    return start
