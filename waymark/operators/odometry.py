"""A run from readings and scans to places and a map: one stateful pass in the order of time.

A step takes an inertial reading, a wheel speed or a scan. At a scan the state is propagated, the
scan's points are moved to its end, registered on the map by the iterated update, judged by the
ladder of registrations, and, where the ladder of insertions allows, written into the map. The
map is part of the state and bounded: cells beyond a radius of the place go, and of too many the
farthest. So memory doesn't grow with the run, and the same step serves batches and streams.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import lie
from waymark.operators import gates, inertial
from waymark.operators.estimate import Outage, Voxel, outage_guard
from waymark.operators.inertial import TURN, Noise, PlaneGates, State, UpdateGates, Wheel


@dataclass(frozen=True)
class Odometry:
    """How a run is followed: the parts' own limits, cells of scan and map, the map's bounds, windows of time in seconds."""

    noise: Noise = Noise()
    update: UpdateGates = UpdateGates()
    accept: gates.Registration = gates.Registration()
    insert: gates.Insertion = gates.Insertion()
    outage: Outage = Outage()
    voxel: Voxel = Voxel()
    planes: PlaneGates = PlaneGates()
    slice_cell: float | None = None
    slice_s: float = 0.01
    scan_cell: float = 0.3
    map_cell: float = 1.0
    radius: float = 60.0
    max_cells: int = 20_000
    least_points: int = 30
    start_readings: int = 10
    keyframe_shift: float = 0.3
    keyframe_turn: float = math.radians(3)
    keyframe_gap: float = 2.0
    yaw_window: float = 10.0
    turn_floor: float = math.radians(0.2)
    wheel_age: float = 0.2
    readings_kept: float = 5.0
    lost_after: int = 5
    trusted_after: int = 2


class VoxelMap:
    """Voxels with mean, scatter and plane, sorted by cell; points enter them as in estimate.voxel_update(), many cells at once."""

    def __init__(self, cell: float, how: Voxel):
        self.cell, self.how = cell, how
        self.key = np.empty(0, np.int64)
        self.n, self.width, self.thin = np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.mean, self.normal, self.scatter = np.empty((0, 3)), np.empty((0, 3)), np.empty((0, 3, 3))
        self.plane = np.empty(0, bool)

    _ARRAYS = ("key", "n", "width", "thin", "mean", "normal", "scatter", "plane")
    _SPAN = 1 << 20  # cells along half an axis

    def _keys(self, cells: np.ndarray) -> np.ndarray:
        c = cells + self._SPAN
        return (c[..., 0] << 42) | (c[..., 1] << 21) | c[..., 2]

    def keys_of(self, points: np.ndarray) -> np.ndarray:
        return self._keys(np.floor(points / self.cell).astype(np.int64))

    def _find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(keys.shape, -1)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.where(self.key[at] == keys, at, -1)

    def insert(self, points: np.ndarray, far: float | None = None) -> None:
        """Points in their order; with far, those that are farther than that from their voxel's plane stay out."""
        keys = self.keys_of(points)
        if far is not None:
            at = self._find(keys)
            off = np.abs(np.einsum("mi,mi->m", self.normal[at], points - self.mean[at])) if len(self.key) else np.zeros(len(points))
            keep = ~((at >= 0) & self.plane[at] & (off > far)) if len(self.key) else np.ones(len(points), bool)
            points, keys = points[keep], keys[keep]
        new = np.unique(keys[self._find(keys) < 0])
        if len(new):
            where = np.searchsorted(self.key, new)
            for name in self._ARRAYS:
                old = getattr(self, name)
                setattr(self, name, np.insert(old, where, new if name == "key" else np.zeros((), old.dtype), axis=0))
        at = np.searchsorted(self.key, keys)
        order = np.argsort(at, kind="stable")
        cells, start, count = np.unique(at[order], return_index=True, return_counts=True)
        nth = np.empty(len(at), np.int64)
        nth[order] = np.arange(len(at)) - np.repeat(start, count)
        for k in range(int(nth.max(initial=-1)) + 1):  # the k-th point of every cell at once
            self._add(at[nth == k], points[nth == k])
        self._refit(cells)

    def _add(self, at: np.ndarray, p: np.ndarray) -> None:
        how = self.how
        live = ~(how.freeze & self.plane[at] & (self.n[at] >= how.full))
        at, p = at[live], p[live]
        grows = self.n[at] < how.full
        self.n[at] += grows
        alpha = np.where(grows, 1.0, how.gain) / self.n[at]
        delta = p - self.mean[at]
        self.mean[at] += alpha[:, None] * delta
        rest = p - self.mean[at]
        filled = self.scatter[at] + delta[:, :, None] * rest[:, None, :]
        faded = (1 - alpha)[:, None, None] * self.scatter[at] + (alpha * (self.n[at] - 1))[:, None, None] * rest[:, :, None] * rest[:, None, :]
        self.scatter[at] = np.where(grows[:, None, None], filled, faded)
        full = at[self.n[at] >= how.full]
        if how.freeze and len(full):  # whether it freezes is known only once its plane is
            self._refit(full)

    def _refit(self, at: np.ndarray) -> None:
        how = self.how
        values, vectors = np.linalg.eigh(self.scatter[at] / np.maximum(1, self.n[at] - 1)[:, None, None])
        self.width[at], self.thin[at] = values[:, 1], np.maximum(0, values[:, 0])
        self.plane[at] = (self.n[at] >= how.least) & (values[:, 1] >= how.least_width) & (self.thin[at] <= how.max_flatness * values[:, 1])
        self.normal[at] = vectors[:, :, 0]

    def prune(self, place: np.ndarray, radius: float, most: int) -> None:
        """Drop cells whose mean is beyond the radius, and of more than most the farthest (ties: the larger cell number)."""
        distance = np.linalg.norm(self.mean - place, axis=1)
        keep = distance <= radius
        if keep.sum() > most:
            chosen = np.lexsort((self.key, np.where(keep, distance, np.inf)))[:most]
            keep = np.zeros(len(keep), bool)
            keep[chosen] = True
        if not keep.all():
            for name in self._ARRAYS:
                setattr(self, name, getattr(self, name)[keep])

    def planes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each point: whether a voxel around it has a plane, that of the nearest mean: normal, mean, variance across."""
        m = len(points)
        if not m or not len(self.key):
            return np.zeros(m, bool), np.zeros((m, 3)), np.zeros((m, 3)), np.zeros(m)
        cells, which = np.unique(self.keys_of(points), return_inverse=True)  # points of a cell have the same cells around
        planes = np.nonzero(self.plane)[0]
        if not len(planes):
            return np.zeros(m, bool), self.normal[np.zeros(m, int)], self.mean[np.zeros(m, int)], np.zeros(m)
        keys, want = self.key[planes], cells[:, None] + _AROUND
        at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
        held = keys[at] == want
        first = np.r_[0, np.cumsum(held.sum(axis=1))]
        near = planes[at[held]]  # the planes around each cell, one cell after the other
        count = np.diff(first)[which]
        some = np.nonzero(count)[0]
        count = count[some]
        start = np.cumsum(count) - count
        pair = near[np.repeat(first[which[some]] - start, count) + np.arange(count.sum())]
        off = self.mean[pair] - np.repeat(points[some], count, axis=0)
        off *= off
        distance = np.sqrt(off[:, 0] + off[:, 1] + off[:, 2])
        found, chosen = np.zeros(m, bool), np.zeros(m, int)
        found[some] = True
        if len(some):
            least = distance == np.repeat(np.minimum.reduceat(distance, start), count)
            hit = np.nonzero(least)[0]
            chosen[some] = pair[hit[np.searchsorted(hit, start)]]  # of equally near ones the first
        return found, self.normal[chosen], self.mean[chosen], self.thin[chosen] / np.maximum(1, self.n[chosen])



#: What the keys of the cells around a cell differ by from its own.
_AROUND = np.array([(i << 42) + (j << 21) + k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])


def cell_means(points: np.ndarray, cell: float) -> np.ndarray:
    """Means of the points of each cell, in the order of cells."""
    if not len(points):
        return points
    cells = np.floor(points / cell).astype(np.int64)
    order = np.lexsort(cells.T[::-1])
    cells, points = cells[order], points[order]
    group = np.cumsum(np.r_[True, (cells[1:] != cells[:-1]).any(axis=1)]) - 1
    return np.stack([np.bincount(group, p) for p in points.T], axis=1) / np.bincount(group)[:, None]


def slice_means(points: np.ndarray, cell: float, slice_s: float) -> np.ndarray:
    """Means of points (x, y, z, before) of each cell and slice of time, as scan_rows() makes them, in its order."""
    if not len(points):
        return points
    at = np.floor(points[:, [3, 0, 1, 2]] / [slice_s, cell, cell, cell]).astype(np.int64)
    order = np.lexsort(at.T[::-1])
    at, points = at[order], points[order]
    first = np.r_[True, (at[1:] != at[:-1]).any(axis=1)]
    group = np.cumsum(first) - 1
    out = np.zeros((group[-1] + 1, 4))
    np.add.at(out, group, points)
    return out / np.bincount(group)[:, None]


def deskew(points: np.ndarray, before: np.ndarray, path: list[State]) -> np.ndarray:
    """Points, each taken so many seconds before the last state of the path (in the body's frame then), in its frame at the end.

    Times ahead of the path's first state count as that one's.
    """
    end = path[-1]
    times = np.array([s.time for s in path])
    t = np.clip(end.time - before, times[0], end.time)
    k = np.clip(np.searchsorted(times, t, "right") - 1, 0, max(0, len(path) - 2))
    turns, places = np.array([s.rotation for s in path]), np.array([s.place for s in path])
    after = np.minimum(k + 1, len(path) - 1)
    share = (t - times[k]) / np.maximum(times[after] - times[k], 1e-12)
    step = lie.rotation_vector(np.swapaxes(turns[k], -1, -2) @ turns[after])
    rotation = turns[k] @ lie.rotation(step * share[:, None])
    place = places[k] + share[:, None] * (places[after] - places[k])
    return (np.einsum("mij,mj->mi", rotation, points) + place - end.place) @ end.rotation


@dataclass
class Run:
    """The state of a run: estimate, readings since the last scan, map, counters, what judges the next scan."""

    map: VoxelMap
    state: State | None = None
    readings: list = field(default_factory=list)
    wheel: tuple | None = None
    pose: tuple | None = None
    scan_time: float | None = None
    inserted: tuple | None = None
    rejected: int = 0
    yaws: list = field(default_factory=list)
    guard: tuple = (0, None, None, None)
    trust: tuple = (False, 0)


def _aligned(readings: list, time: float, start: State) -> State:
    """A state at rest: gravity along the mean acceleration, biases from the mean turn rate."""
    gyro, accel = (np.mean([r[k] for r in readings], axis=0) for k in (1, 2))
    up = accel / np.linalg.norm(accel)
    axis = np.cross(up, [0.0, 0, 1])
    size = float(np.linalg.norm(axis))
    turn = axis / size * math.atan2(size, up[2]) if size > 1e-9 else np.zeros(3)
    return replace(start, time=time, rotation=lie.rotation(turn), gyro_bias=gyro, gravity=np.array([0, 0, -float(np.linalg.norm(accel))]))


def follow(how: Odometry = Odometry(), time: str = "t", unit: float = 1e6, first: State | None = None) -> Callable:
    """Ordered fold over a run's rows (kind "imu", "wheel" or "scan"); every scan gives a row.

    Readings hold wx, wy, wz, ax, ay, az; wheels forward and yaw_rate (null: none); scans points,
    an array of (x, y, z, before), before in seconds ahead of the scan's time. Rows of one time
    come with readings first. Without a first state the run starts at rest, from start_readings
    readings. Null or infinite readings and points don't count, rows that go back in time neither;
    readings older than readings_kept go, so a run without scans holds no more.
    Outputs: the row's other columns and accepted, reason, map_reason, mode, px, py, pz, rx, ry, rz,
    vx, vy, vz, used, points, iterations, rmse, directions, yaw_limited, cells, readings.
    """
    guard_step = outage_guard("t", 1.0, how.outage)()[1]
    trust_step = gates.recovery_trust(how.trusted_after)()[1]
    registration, insertion = gates.registration_rules(how.accept), gates.insertion_rules(how.insert)

    def begin():
        def out(run: Run, row: dict, reason: str, map_reason: str, mode: str, points: int, result: dict) -> list[dict]:
            s = run.state or State()
            more = dict(zip(("px", "py", "pz"), map(float, s.place), strict=True)) | dict(zip(("rx", "ry", "rz"), map(float, lie.rotation_vector(s.rotation)), strict=True)) | dict(zip(("vx", "vy", "vz"), map(float, s.velocity), strict=True))
            more |= {"accepted": reason in ("accepted", "initialized"), "reason": reason, "map_reason": map_reason, "mode": mode, "points": points, "cells": len(run.map.key), "readings": len(run.readings)}
            more |= {"used": int(result.get("used", 0)), "iterations": int(result.get("iterations", 0)), "rmse": float(result.get("rmse", math.nan)), "directions": int(result.get("directions", 0)), "yaw_limited": bool(result.get("yaw_limited", False))}
            return [{k: v for k, v in row.items() if k not in _INPUTS} | more]

        def write(run: Run, scan: np.ndarray, t: float, far: float | None) -> None:
            s = run.state
            world = scan @ s.rotation.T + s.place
            run.map.insert(world[np.linalg.norm(world - s.place, axis=1) <= how.radius], far)
            run.map.prune(s.place, how.radius, how.max_cells)
            run.inserted = (s.rotation, s.place, t)

        def step(run: Run, row: dict):
            t = row[time] / unit
            if row["kind"] == "imu":
                values = [row[c] for c in ("wx", "wy", "wz", "ax", "ay", "az")]
                if all(x is not None and math.isfinite(x) for x in values) and (not run.readings or t > run.readings[-1][0]):
                    run.readings.append((t, np.array(values[:3], float), np.array(values[3:], float)))
                    if t - run.readings[0][0] > 2 * how.readings_kept:
                        run.readings = [r for r in run.readings if t - r[0] <= how.readings_kept]
                return run, []
            if row["kind"] == "wheel":
                if row["forward"] is not None and math.isfinite(row["forward"]):
                    run.wheel = (t, row["forward"], row["yaw_rate"])
                return run, []
            return run, scan(run, row, t)

        def scan(run: Run, row: dict, t: float) -> list[dict]:
            if run.state is None:
                if first is not None:
                    run.state = first
                elif len(run.readings) >= how.start_readings:
                    run.state = _aligned(run.readings, run.readings[-1][0], State())
                else:
                    return out(run, row, "waiting_for_start", "registration_rejected", "predicted", 0, {})
                run.pose = (run.state.rotation, run.state.place)
            if run.scan_time is not None and t <= run.scan_time:
                return out(run, row, "scan_before_state", "registration_rejected", "predicted", 0, {})
            times, gyro, accel = (np.array([r[k] for r in run.readings]) for k in range(3))
            path = inertial.propagate_to(run.state, t, times, gyro, accel, how.noise) if len(times) else None
            if path is None:
                return out(run, row, "insufficient_readings", "registration_rejected", "predicted", 0, {})
            predicted = path[-1]
            given = () if row["points"] is None else row["points"]  # from a stream an array, not a list
            if isinstance(given, np.ndarray) and given.dtype.names:
                raw = np.stack([given[c] for c in ("x", "y", "z", "before")], axis=1)
            else:
                raw = np.array([[p["x"], p["y"], p["z"], p["before"]] for p in given if p is not None and None not in (p["x"], p["y"], p["z"], p["before"])], float).reshape(-1, 4)
            raw = raw[np.isfinite(raw).all(axis=1)]
            if how.slice_cell is not None:
                raw = slice_means(raw, how.slice_cell, how.slice_s)
            points = cell_means(deskew(raw[:, :3], raw[:, 3], path), how.scan_cell)
            result, reason, map_reason, estimate = {}, "insufficient_points", "registration_rejected", predicted
            if len(points) >= how.least_points and run.inserted is None:
                reason, map_reason = "initialized", "initialized"
            elif len(points) >= how.least_points:
                estimate, result, reason = register(run, predicted, points, t)
            accepted = reason in ("accepted", "initialized")
            run.rejected = 0 if accepted else run.rejected + 1
            run.state = estimate if accepted else predicted
            wheel = run.wheel if run.wheel and abs(t - run.wheel[0]) <= how.wheel_age else None
            run.guard, [held] = guard_step(run.guard, {"t": t, "accepted": accepted, **dict(zip(("x", "y", "z"), map(float, run.state.place), strict=True)), "vx": float(run.state.velocity[0]), "vy": float(run.state.velocity[1]), "heading": float(lie.yaw_of(run.state.rotation)), "wheel": wheel[1] if wheel else None})
            if held["mode"] in ("held", "reckoned", "frozen"):
                here = run.guard[2]
                run.state = replace(run.state, place=np.array(here[:3]), velocity=np.array([*here[3:], run.state.velocity[2] if held["mode"] != "frozen" else 0.0]))
            run.trust, [judged] = trust_step(run.trust, {"outage": run.rejected >= how.lost_after, "strong": result.get("used", 0) >= how.accept.strong})
            if accepted:
                if reason == "accepted":
                    map_reason = gates.reason_of(insertion, result | {"trusted": judged["trusted"], "keyframe": moved(run, t)}, "updated")
                    run.yaws.append((t, result["yaw"]))
                if map_reason in ("updated", "initialized"):
                    write(run, points, t, how.planes.max_distance if map_reason == "updated" else None)
            run.pose, run.scan_time = (run.state.rotation, run.state.place), t
            run.readings = [r for k, r in enumerate(run.readings) if k + 1 >= len(run.readings) or run.readings[k + 1][0] > t]
            return out(run, row, reason, map_reason, held["mode"], len(points), result)

        def moved(run: Run, t: float) -> bool:
            rotation, place, when = run.inserted
            turned = float(np.linalg.norm(lie.rotation_vector(rotation.T @ run.state.rotation)))
            return float(np.linalg.norm(run.state.place - place)) >= how.keyframe_shift or turned >= how.keyframe_turn or t - when >= how.keyframe_gap

        def register(run: Run, predicted: State, points: np.ndarray, t: float) -> tuple[State, dict, str]:
            run.yaws = [y for y in run.yaws if t - y[0] <= how.yaw_window]
            spent = sum(y for _, y in run.yaws)
            wheel = None
            if run.wheel and abs(t - run.wheel[0]) <= how.wheel_age:
                rate = run.wheel[2]
                wheel = Wheel(run.wheel[1], None if rate is None or not math.isfinite(rate) else rate, run.readings[-1][1])

            def equations(s: State) -> inertial.Linear:
                return inertial.point_equations(s, predicted.covariance, points, *run.map.planes(points @ s.rotation.T + s.place), how.update, how.planes)

            estimate, result = inertial.iterate(predicted, equations, how.update, wheel, spent)
            change = lie.rotation_vector(predicted.rotation.T @ estimate.rotation)
            up = predicted.rotation.T @ np.array([0.0, 0.0, 1.0])
            rotation, place = run.pose
            turn_covariance = predicted.covariance[TURN, TURN] + how.turn_floor**2 * np.eye(3)
            result |= {
                "linearised": result["used"] >= how.update.least and math.isfinite(result["rmse"]), "ratio": result["used"] / len(points), "yaw": float(change @ up),
                "shift": float(np.linalg.norm(estimate.place - place)), "turn": math.degrees(float(np.linalg.norm(lie.rotation_vector(rotation.T @ estimate.rotation)))),
                "turn_nis": float(change @ np.linalg.solve(turn_covariance, change)), "yaw_total": math.degrees(spent + float(change @ up)),
                "correction_shift": float(np.linalg.norm(estimate.place - predicted.place)), "correction_turn": math.degrees(float(np.linalg.norm(change))),
            }
            return estimate, result, gates.reason_of(registration, result, "accepted")

        return Run(VoxelMap(how.map_cell, how.voxel)), step

    return begin


_INPUTS = {"kind", "wx", "wy", "wz", "ax", "ay", "az", "forward", "yaw_rate", "points"}

#: Types of what follow() adds to a scan's own columns.
OUTPUT = "accepted boolean, reason string, map_reason string, mode string, px double, py double, pz double, rx double, ry double, rz double, vx double, vy double, vz double, used int, points int, iterations int, rmse double, directions int, yaw_limited boolean, cells int, readings int"


def scan_rows(points: DataFrame, keys: list[str], cell: float, slice_s: float) -> DataFrame:
    """(keys, points array<struct<x, y, z, before>>): a row a scan from points (keys, x, y, z, before).

    Points of one cell and slice of time become their mean first, so a row is bounded by the
    scan's extent and duration and not by its density; the order is that of slices and cells.
    """
    at = {"ix": F.floor(F.col("x") / cell), "iy": F.floor(F.col("y") / cell), "iz": F.floor(F.col("z") / cell), "slice": F.floor(F.col("before") / slice_s)}
    means = points.withColumns(at).groupBy(*keys, *at).agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "before")])
    held = F.sort_array(F.collect_list(F.struct("slice", "ix", "iy", "iz", "x", "y", "z", "before")))
    return means.groupBy(*keys).agg(F.transform(held, lambda p: F.struct(*[p[c].alias(c) for c in ("x", "y", "z", "before")])).alias("points"))
