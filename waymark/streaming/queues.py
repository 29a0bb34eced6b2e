"""Step functions of bounded queues, drops, pairing and state eviction, for batch folds and streams alike, and what windows say as well."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_queue(kind: str, first: str, capacity: int, drain: int) -> Callable:
    """A queue that takes every row and, over capacity, drops the oldest row of the kind that goes first, else the oldest; every drain-th row empties one place. Returns the dropped rows."""

    def start():
        def step(state, row):
            queue, n = state
            queue = [*queue, row]
            out = []
            if len(queue) > capacity:
                at = next((k for k, r in enumerate(queue) if r[kind] == first), 0)
                out.append({**queue[at], "queued": len(queue) - 1})
                queue = queue[:at] + queue[at + 1 :]
            n += 1
            if n % drain == 0 and queue:
                queue = queue[1:]
            return (queue, n), out

        return ([], 0), step

    return start


def lag_budget(df: DataFrame, keys: list[str], arrival: list[str], time: str, kind: str, budgets: dict[str, int], default: int) -> DataFrame:
    """Rows, in order of arrival, with their lag behind the latest time seen before and whether it is within their kind's budget."""
    seen = F.max(time).over(Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1))
    budget = F.lit(default)
    for name, most in budgets.items():
        budget = F.when(F.col(kind) == name, most).otherwise(budget)
    rows = df.withColumn("lag", F.coalesce(F.greatest(F.lit(0), seen - F.col(time)), F.lit(0)).cast("long"))
    return rows.withColumn("kept", F.col("lag") <= budget)


def late_drop(time: str, kind: str, budgets: dict[str, int], default: int) -> Callable:
    """lag_budget() as a step, for streams."""

    def start():
        def step(latest, row):
            lag = 0 if latest is None else max(0, latest - row[time])
            return row[time] if latest is None else max(latest, row[time]), [{**row, "lag": lag, "kept": lag <= budgets.get(row[kind], default)}]

        return None, step

    return start


def rewind_gate(time: str, interval: int) -> Callable:
    """A rate gate that starts anew when time runs backwards."""

    def start():
        def step(last, row):
            if last is None or row[time] < last or row[time] - last >= interval:
                return row[time], [{**row, "reset": last is not None and row[time] < last}]
            return last, []

        return None, step

    return start


def evicting_state(time: str, key: str, ttl: int, most: int) -> Callable:
    """Last time of each key; keys older than ttl go, and over most keys the oldest (ties: smaller key) down to nine tenths. Returns the keys that went."""

    def start():
        def step(state, row):
            out = [{**row, "evicted": k, "why": "ttl"} for k, t in sorted(state.items()) if row[time] - t > ttl]
            for o in out:
                del state[o["evicted"]]
            state[row[key]] = row[time]
            if len(state) > most:
                for k, _ in sorted(state.items(), key=lambda kv: (kv[1], kv[0]))[: len(state) - most * 9 // 10]:
                    out.append({**row, "evicted": k, "why": "size"})
                    del state[k]
            return state, out

        return {}, step

    return start


def pair_heads(time: str, side: str, tolerance: int) -> Callable:
    """Pair two sides (0 and 1) by their heads: both go if their times agree, else the older head is dropped. Returns pairs and drops."""

    def start():
        def step(state, row):
            heads = [list(state[0]), list(state[1])]
            heads[row[side]].append(row)
            out = []
            while heads[0] and heads[1]:
                a, b = heads[0][0], heads[1][0]
                if abs(a[time] - b[time]) <= tolerance:
                    out.append({**a, "partner": b["id"], "dropped": False})
                    heads[0].pop(0)
                    heads[1].pop(0)
                else:
                    old = 0 if a[time] <= b[time] else 1
                    out.append({**heads[old].pop(0), "partner": None, "dropped": True})
            return heads, out

        return ([], []), step

    return start


def pending(time: str, kind: str, request: str, wait: int, tries: int) -> Callable:
    """Requests that wait for the next row of another kind within wait, and expire; at most tries of them wait at a time. Returns the outcome of each request."""

    def start():
        def step(queue, row):
            out = [{**q, "outcome": "expired", "by": None} for q in queue if row[time] - q[time] > wait]
            queue = [q for q in queue if row[time] - q[time] <= wait]
            if row[kind] == request:
                if len(queue) < tries:
                    queue = [*queue, row]
                else:
                    out.append({**row, "outcome": "refused", "by": None})
            elif queue:
                out.append({**queue[0], "outcome": "applied", "by": row["id"]})
                queue = queue[1:]
            return queue, out

        return [], step

    return start


def back_pressure(kind: str, request: str, result: str, most: int) -> Callable:
    """Admit requests while fewer than most are pending; results take one off. Returns the requests with admitted and how many were pending."""

    def start():
        def step(pending, row):
            if row[kind] == result:
                return max(0, pending - 1), []
            if row[kind] != request:
                return pending, []
            admitted = pending < most
            return pending + admitted, [{**row, "admitted": admitted, "pending": pending}]

        return 0, step

    return start


def published(time: str, every: int) -> Callable:
    """A trajectory's state at every so-manieth keyframe (x, y): its number n and the path's length so far, what a map publisher writes out."""

    def start():
        def step(state, row):
            n, length, last = state
            n, length = n + 1, length + (math.hypot(row["x"] - last[0], row["y"] - last[1]) if last else 0.0)
            return (n, length, (row["x"], row["y"])), [{**row, "n": n, "length": length}] if n % every == 0 else []

        return (0, 0.0, None), step

    return start
