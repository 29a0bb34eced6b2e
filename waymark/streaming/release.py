"""Release of events from several sources in order, behind their common watermark, with required side streams.

Rows of all sources of a key come as one sequence of arrivals. Events wait until every event
source has reached a window past them and side streams cover them, and then go in the order of
their time. One step serves batch folds (over arrivals) and streams (over state).
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Release:
    """Which sources carry events, how far the others must have come, and when waiting ends; times in microseconds.

    All of events must have reached an event's time plus window. cover names side streams and how
    far past the event each must be (window at least); a side stream in timeouts is waited for
    only until the event sources are that far past the event. idle: silence after which the input
    counts as complete (0: never).
    """

    events: tuple[str, ...]
    window: int
    cover: tuple[tuple[str, int], ...] = ()
    timeouts: tuple[tuple[str, int], ...] = ()
    idle: int = 0


def releasing(how: Release, time: str = "t", source: str = "source", wall: str | None = "wall", ident: str = "id") -> Callable:
    """Step over arrivals: the events that each lets go, in order, with why: "watermark", "timeout", "idle", or "stale" if a later one went before.

    by is the arrival (its id) that let them go. With a wall time, a silence longer than idle
    before an arrival first lets all waiting events go. Rows of side streams only move their
    stream's latest time.
    """
    waits, ends = dict(how.cover), dict(how.timeouts)

    def start():
        def ready(latest: dict, t: int) -> str | None:
            mark = min((latest.get(s) for s in how.events if s in latest), default=None) if all(s in latest for s in how.events) else None
            if mark is None or mark < t + how.window:
                return None
            why = "watermark"
            for s, wait in waits.items():
                if latest.get(s, -(2**63)) < t + max(wait, how.window):
                    if s not in ends or mark < t + ends[s]:
                        return None
                    why = "timeout"
            return why

        def let_go(state: dict, by: int | None, idle: bool) -> list[dict]:
            out = []
            while state["waiting"]:
                row = state["waiting"][0][-1]
                why = "idle" if idle else ready(state["latest"], row[time])
                if why is None:
                    break
                heapq.heappop(state["waiting"])
                if state["last"] is not None and row[time] < state["last"]:
                    why = "stale"
                else:
                    state["last"] = row[time]
                out.append({**row, "why": why, "by": by})
            return out

        def step(state, row):
            out = []
            if row is None:  # the timer of a stream
                return state, let_go(state, None, True)
            if how.idle and wall is not None and state["wall"] is not None and row[wall] - state["wall"] > how.idle:
                out = let_go(state, row[ident], True)
            if wall is not None:
                state["wall"] = row[wall]
            state["latest"][row[source]] = max(row[time], state["latest"].get(row[source], row[time]))
            if row[source] in how.events:
                state["n"] += 1
                heapq.heappush(state["waiting"], (row[time], row[ident], state["n"], row))
            return state, out + let_go(state, row[ident], False)

        return {"waiting": [], "latest": {}, "last": None, "wall": None, "n": 0}, step

    return start


def release_stream(stream: DataFrame, keys: list[str], arrival: list[str], how: Release, schema: str, time: str = "t", source: str = "source", ident: str = "id") -> DataFrame:
    """The events that a stream of arrivals lets go, as releasing() says; rows of a micro-batch count in the order of arrival.

    how.idle is a timer: when no row of a key came for so long, all its waiting events go. State
    holds a key's waiting events and each source's latest time.
    """
    fields = [f.split(" ")[0] for f in schema.split(", ")]
    first, step = releasing(how, time, source, None, ident)()

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = pickle.loads(state.get[0]) if state.exists else pickle.loads(pickle.dumps(first))
        out: list[dict] = []
        if state.hasTimedOut:
            own, out = step(own, None)
        else:
            rows = pd.concat(list(frames)).sort_values(arrival, kind="stable")
            for row in rows.to_dict("records"):
                own, made = step(own, row)
                out += made
        state.update((pickle.dumps(own),))
        if how.idle and own["waiting"]:
            state.setTimeoutDuration(max(1, how.idle // 1000))
        if out:
            yield pd.DataFrame(out)[fields]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if how.idle else GroupStateTimeout.NoTimeout
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", timeout)
