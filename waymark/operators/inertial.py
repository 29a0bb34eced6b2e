"""The inertial filter: an 18-state error-state filter on scans, wheels and images.

States are turn, place, velocity, gyroscope bias, accelerometer bias and gravity; errors are in
that order, turns in the body's frame. Propagation is by the midpoint between samples. A scan is
an iterated update on point-to-plane misses with the planes of a map. One run is one task, as
each step needs the state before it, and holds one state, one scan and the map's cells.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions import lie
from waymark.operators.select import in_tasks

TURN, PLACE, VELOCITY, GYRO, ACCEL, GRAVITY = (slice(3 * k, 3 * k + 3) for k in range(6))
N = 18


@dataclass(frozen=True)
class Noise:
    """Densities of the sensors' noise and of the walks of biases and gravity, and the longest gap between samples."""

    gyro: float = 0.01
    accel: float = 0.1
    gyro_walk: float = 1e-4
    accel_walk: float = 1e-3
    gravity_walk: float = 1e-5
    max_gap: float = 0.2


@dataclass
class State:
    """An estimate at a time, in seconds, with the covariance of its errors."""

    time: float = 0.0
    rotation: np.ndarray = field(default_factory=lambda: np.eye(3))
    place: np.ndarray = field(default_factory=lambda: np.zeros(3))
    velocity: np.ndarray = field(default_factory=lambda: np.zeros(3))
    gyro_bias: np.ndarray = field(default_factory=lambda: np.zeros(3))
    accel_bias: np.ndarray = field(default_factory=lambda: np.zeros(3))
    gravity: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, -9.81]))
    covariance: np.ndarray = field(default_factory=lambda: np.diag(np.repeat([1e-4, 1e-4, 1e-2, 1e-6, 1e-4, 1e-6], 3)))

    def plus(self, e: np.ndarray) -> State:
        """The state moved by an error."""
        return replace(self, rotation=self.rotation @ lie.rotation(e[TURN]), place=self.place + e[PLACE], velocity=self.velocity + e[VELOCITY], gyro_bias=self.gyro_bias + e[GYRO], accel_bias=self.accel_bias + e[ACCEL], gravity=self.gravity + e[GRAVITY])

    def minus(self, other: State) -> np.ndarray:
        """The error that takes other to this state."""
        return np.concatenate([lie.rotation_vector(other.rotation.T @ self.rotation), self.place - other.place, self.velocity - other.velocity, self.gyro_bias - other.gyro_bias, self.accel_bias - other.accel_bias, self.gravity - other.gravity])


def _tidy(p: np.ndarray) -> np.ndarray:
    p = (p + p.T) / 2
    p[np.diag_indices(N)] = np.maximum(np.diagonal(p), 1e-12)
    return p


def _middle(s: State, gyro: np.ndarray, accel: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turn rate and acceleration without biases, and the turn halfway."""
    w = gyro - s.gyro_bias
    return w, accel - s.accel_bias, s.rotation @ lie.rotation(w * dt / 2)


def moved(s: State, gyro: np.ndarray, accel: np.ndarray, dt: float, at: tuple | None = None) -> State:
    """propagate() without the covariance; at is _middle(), if it is known."""
    w, a, middle = at or _middle(s, gyro, accel, dt)
    world = middle @ a + s.gravity
    return replace(s, time=s.time + dt, rotation=s.rotation @ lie.rotation(w * dt), place=s.place + s.velocity * dt + world * dt**2 / 2, velocity=s.velocity + world * dt)


def transition(s: State, gyro: np.ndarray, accel: np.ndarray, dt: float, noise: Noise, at: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """What dt seconds do to errors, and the covariance that they add; at is _middle(), if it is known."""
    w, a, middle = at or _middle(s, gyro, accel, dt)
    f = np.zeros((N, N))
    f[TURN, TURN], f[TURN, GYRO] = -lie.hat(w), -np.eye(3)
    f[PLACE, VELOCITY] = np.eye(3)
    f[VELOCITY, TURN], f[VELOCITY, ACCEL], f[VELOCITY, GRAVITY] = -middle @ lie.hat(a), -middle, np.eye(3)
    f = f * dt
    return np.eye(N) + f + f @ f / 2, _added(dt, noise)


@functools.lru_cache(64)
def _added(dt: float, noise: Noise) -> np.ndarray:
    """The covariance that dt seconds add; not to be changed."""
    q, va = np.zeros((N, N)), noise.accel**2
    for part, value in ((TURN, noise.gyro**2 * dt), (VELOCITY, va * dt), (PLACE, va * dt**3 / 4), (GYRO, noise.gyro_walk**2 * dt), (ACCEL, noise.accel_walk**2 * dt), (GRAVITY, noise.gravity_walk**2 * dt)):
        q[part, part] = value * np.eye(3)
    q[PLACE, VELOCITY] = q[VELOCITY, PLACE] = va * dt**2 / 2 * np.eye(3)
    q.flags.writeable = False
    return q


def propagate(s: State, gyro: np.ndarray, accel: np.ndarray, dt: float, noise: Noise) -> State:
    """The state after dt seconds of constant turn rate and acceleration, as the sensors give them."""
    if dt <= 0:
        return s
    at = _middle(s, gyro, accel, dt)
    f, q = transition(s, gyro, accel, dt, noise, at)
    return replace(moved(s, gyro, accel, dt, at), covariance=_tidy(f @ s.covariance @ f.T + q))


def reading(row: dict | None) -> np.ndarray | None:
    """A row's turn rates and accelerations; None if any is missing or infinite."""
    found = [None] if row is None else [row[c] for c in ("wx", "wy", "wz", "ax", "ay", "az")]
    return None if any(x is None or not math.isfinite(x) for x in found) else np.array(found, float)


def propagate_to(s: State, end: float, times: np.ndarray, gyro: np.ndarray, accel: np.ndarray, noise: Noise) -> list[State] | None:
    """The states at every sample up to end and at end, samples interpolated where a step is cut; None if they don't cover the time, or leave a gap."""
    if end < s.time - 1e-8:
        return None
    if end <= s.time + 1e-8:
        return [s]
    if len(times) < 2 or times[0] > s.time + 1e-6 or times[-1] < end - 1e-6:
        return None
    out = [s]
    k = max(0, int(np.searchsorted(times, s.time, "right")) - 1)
    while out[-1].time < end - 1e-9:
        if k + 1 >= len(times) or not 0 < times[k + 1] - times[k] <= noise.max_gap:
            return None
        start, stop = out[-1].time, min(end, times[k + 1])
        cut = [min(1.0, max(0.0, (t - times[k]) / (times[k + 1] - times[k]))) for t in (start, stop)]
        mean = lambda x: ((1 - cut[0]) * x[k] + cut[0] * x[k + 1] + (1 - cut[1]) * x[k] + cut[1] * x[k + 1]) / 2  # noqa: B023, E731
        out.append(propagate(out[-1], mean(gyro), mean(accel), stop - start, noise))
        k += stop >= times[k + 1] - 1e-9
    return out


def inertial_fold(time: str, unit: float, noise: Noise, start: State | None = None) -> Callable:
    """Ordered fold over samples (time, wx, wy, wz, ax, ay, az): the state at each, propagated by the mean of the two samples around a step.

    A gap beyond the longest, or a time that doesn't grow, holds the state (mode "gap"); the first
    sample starts it ("start"); null readings count as a gap.
    """

    def begin():
        def step(state, row):
            s, last = state
            t = row[time] / unit
            now = reading(row)
            if s is None:
                s, mode = replace(start or State(), time=t), "start"
            elif last is None or now is None or not 0 < t - s.time <= noise.max_gap:
                s, mode = replace(s, time=max(t, s.time)), "gap"
            else:
                mean = (last + now) / 2
                s, mode = propagate(s, mean[:3], mean[3:], t - s.time, noise), "propagated"
            out = dict(row) | {"mode": mode} | dict(zip(("px", "py", "pz"), map(float, s.place), strict=True)) | dict(zip(("vx", "vy", "vz"), map(float, s.velocity), strict=True))
            turn = lie.rotation_vector(s.rotation)
            deviations = np.sqrt(np.diagonal(s.covariance))
            out |= dict(zip(("rx", "ry", "rz"), map(float, turn), strict=True)) | {"turn_sigma": float(np.linalg.norm(deviations[TURN])), "place_sigma": float(np.linalg.norm(deviations[PLACE])), "velocity_sigma": float(np.linalg.norm(deviations[VELOCITY]))}
            return (s, now), [out]

        return (None, None), step

    return begin


# ---- planes of a map ----


@dataclass(frozen=True)
class PlaneGates:
    """Cells of a map, and what a plane needs: voxels near a point, their number, flatness, support."""

    voxel: float = 0.5
    reach: float = 1.0
    nearest: int = 8
    least: int = 5
    least_points: int = 3
    max_flatness: float = 0.05
    least_width: float = 0.02
    max_distance: float = 0.5


class PlaneMap:
    """A map's voxels (count, mean, scatter) that answers, for points, the plane of the nearest voxels around each.

    Planes are weighted by counts and by nearness; a plane needs enough voxels, a smallest
    eigenvalue small against the middle one, and a middle one that isn't small itself.
    """

    def __init__(self, points: np.ndarray, gates: PlaneGates):
        self.gates = gates
        self.cells: dict[tuple, int] = {}
        self.n, self.sum, self.square = np.zeros(0), np.zeros((0, 3)), np.zeros((0, 3, 3))
        self.insert(points)

    def insert(self, points: np.ndarray) -> None:
        """Add points to their voxels."""
        if not len(points):
            return
        keys, place = np.unique(np.floor(points / self.gates.voxel).astype(np.int64), axis=0, return_inverse=True)
        at = np.array([self.cells.setdefault(tuple(k), len(self.cells)) for k in keys.tolist()], np.int64)[place.ravel()]
        more = len(self.cells) - len(self.n)
        self.n = np.concatenate([self.n, np.zeros(more)])
        self.sum = np.concatenate([self.sum, np.zeros((more, 3))])
        self.square = np.concatenate([self.square, np.zeros((more, 3, 3))])
        np.add.at(self.n, at, 1)
        np.add.at(self.sum, at, points)
        np.add.at(self.square, at, points[:, :, None] * points[:, None, :])
        self.means = self.sum / self.n[:, None]

    @classmethod
    def of_sums(cls, keys: np.ndarray, n: np.ndarray, sums: np.ndarray, squares: np.ndarray, gates: PlaneGates) -> PlaneMap:
        """A map of voxels that were summed before: distinct cells, counts, sums, sums of the upper products xx, xy, xz, yy, yz, zz."""
        out = cls(np.zeros((0, 3)), gates)
        out.cells = {tuple(k): i for i, k in enumerate(keys.astype(np.int64).tolist())}
        out.n, out.sum, out.square = n.astype(float), sums, squares[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
        out.means = out.sum / out.n[:, None]
        return out

    def planes(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each point: whether it has a plane, its normal, a point on it, and the variance across it."""
        g, m = self.gates, len(points)
        found, normal, center, variance = np.zeros(m, bool), np.zeros((m, 3)), np.zeros((m, 3)), np.zeros(m)
        if not m or not self.cells:
            return found, normal, center, variance
        span = int(math.ceil(g.reach / g.voxel))
        offsets = np.stack(np.meshgrid(*[np.arange(-span, span + 1)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
        home = np.floor(points / g.voxel).astype(np.int64)
        kinds, place = np.unique(home, axis=0, return_inverse=True)
        around = np.array([[self.cells.get(tuple(c), -1) for c in (k + offsets).tolist()] for k in kinds], np.int64)[place.ravel()]
        safe = np.maximum(around, 0)
        distance = np.linalg.norm(self.means[safe] - points[:, None], axis=2)
        distance[(around < 0) | (self.n[safe] < g.least_points) | (distance > g.reach)] = np.inf
        order = np.argsort(distance, axis=1, kind="stable")[:, : g.nearest]
        near, d = np.take_along_axis(safe, order, axis=1), np.take_along_axis(distance, order, axis=1)
        some = np.isfinite(d)
        enough = some.sum(axis=1) >= g.least
        w = np.where(some, self.n[near] * np.exp(-np.where(some, d, 0) / g.reach), 0.0)
        total = np.maximum(w.sum(axis=1), 1e-12)
        center = np.einsum("mk,mki->mi", w, self.means[near]) / total[:, None]
        inside = self.square[near] / self.n[near][..., None, None]
        moment = np.einsum("mk,mkij->mij", w, inside) / total[:, None, None]
        scatter = moment - center[:, :, None] * center[:, None, :]
        values, vectors = np.linalg.eigh(np.where(enough[:, None, None], scatter, np.eye(3)))
        values = np.maximum(values, 0)
        found = enough & (values[:, 1] >= g.least_width) & (values[:, 0] <= g.max_flatness * values[:, 1])
        normal = vectors[:, :, 0]
        return found, normal, center, values[:, 0] / np.maximum(1, (w > 0).sum(axis=1))


# ---- scan updates ----


@dataclass(frozen=True)
class UpdateGates:
    """Noise of points and wheels, innovation gates, robust kernels, caps and convergence of a scan's update."""

    noise: float = 0.02
    range_noise: float = 0.02
    beam_noise: float = 0.001
    innovation: float = 25.0
    huber: float = 2.0
    least: int = 30
    iterations: int = 8
    observable: float = 1e-4
    rotation_observable: float = 1e-3
    weak_share: float = 0.05
    damping: float = 1e-9
    max_turn: float = math.radians(2)
    max_shift: float = 0.5
    max_velocity: float = 2.0
    max_gyro_bias: float = 0.01
    max_accel_bias: float = 0.1
    yaw_budget: float = math.inf
    done_shift: float = 1e-4
    done_turn: float = math.radians(0.005)
    confirmations: int = 1
    forward_noise: float = 0.1
    lateral_noise: float = 0.05
    vertical_noise: float = 0.05
    forward_gate: float = 16.0
    wheel_huber: float = 2.0
    yaw_noise: float = 0.02
    yaw_scale: float = 0.02
    yaw_gate: float = 16.0


def huber(x: np.ndarray, delta: float) -> np.ndarray:
    """Weight of a miss: 1 up to delta, then delta over it."""
    size = np.abs(x)
    return np.where(size <= delta, 1.0, delta / np.maximum(size, 1e-12))


@dataclass
class Linear:
    """Normal equations of measurements at a state, and what was counted on the way."""

    h: np.ndarray = field(default_factory=lambda: np.zeros((N, N)))
    g: np.ndarray = field(default_factory=lambda: np.zeros(N))
    used: int = 0
    rejected: int = 0
    square: float = 0.0
    normalised: float = 0.0
    weight: float = 0.0
    sectors: int = 0


def point_equations(s: State, prior: np.ndarray, points: np.ndarray, found: np.ndarray, normal: np.ndarray, center: np.ndarray, variance: np.ndarray, gates: UpdateGates, plane_gates: PlaneGates, sectors: int = 12) -> Linear:
    """Point-to-plane misses as normal equations: robust weights over variances, misses beyond the innovation gate left out, directions counted by sector."""
    out = Linear()
    world = points @ s.rotation.T + s.place
    r = np.einsum("mi,mi->m", normal, world - center)
    ok = found & (np.abs(r) <= plane_gates.max_distance)
    p, n, r, v = points[ok], normal[ok], r[ok], variance[ok]
    jacobian = np.zeros((len(p), N))
    body = n @ s.rotation
    for j, a, b in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):  # the normals across the points
        jacobian[:, j] = body[:, b] * p[:, a] - body[:, a] * p[:, b]
    jacobian[:, PLACE] = n
    distance = np.linalg.norm(p, axis=1)
    across = np.einsum("mi,mi->m", body, p) / np.maximum(distance, 1e-9)
    beam = (gates.beam_noise * distance) ** 2
    v = np.maximum(1e-8, gates.noise**2 + beam + (gates.range_noise**2 - beam) * across**2 + v)
    pose = jacobian[:, :6]  # all other columns are zero
    expected = v + np.maximum(0, np.einsum("mi,ij,mj->m", pose, prior[:6, :6], pose))
    inside = r**2 / expected <= gates.innovation if gates.innovation > 0 else np.ones(len(r), bool)
    out.rejected = int((~inside).sum())
    jacobian, r, v, p = jacobian[inside], r[inside], v[inside], p[inside]
    w = huber(r / np.sqrt(v), gates.huber)
    out.h = (jacobian * (w / v)[:, None]).T @ jacobian
    out.g = jacobian.T @ (w / v * r)
    out.used, out.square, out.normalised, out.weight = len(r), float((r**2).sum()), float((r**2 / v).sum()), float(w.sum())
    share = np.clip((np.arctan2(p[:, 1], p[:, 0]) + math.pi) / (2 * math.pi), 0, 1 - 1e-12)
    out.sectors = int(np.count_nonzero(np.bincount((share * sectors).astype(int))))
    return out


@dataclass
class Wheel:
    """Wheel speed and turn rate at a scan, the gyroscope's reading then, and where the wheels sit."""

    forward: float
    yaw_rate: float | None = None
    gyro: np.ndarray | None = None
    lever: np.ndarray = field(default_factory=lambda: np.zeros(3))


def wheel_equations(s: State, prior: np.ndarray, wheel: Wheel, gates: UpdateGates) -> tuple[Linear, dict]:
    """Forward speed, no sideways or upward speed, and turn rate against the gyroscope, as normal equations with the flags of their gates.

    The velocity is that of the wheels' place in the body's frame, so a small pitch doesn't drift
    into height; forward speed and turn rate are left out where their normalised square passes its gate.
    """
    out, flags = Linear(), {"forward_rejected": False, "yaw_rejected": False, "yaw_used": False, "forward_nis": 0.0, "yaw_nis": 0.0}
    body = s.rotation.T @ s.velocity
    jacobian = np.zeros((3, N))
    jacobian[:, TURN], jacobian[:, VELOCITY] = lie.hat(body), s.rotation.T
    speed = body
    if wheel.gyro is not None and float(wheel.lever @ wheel.lever) > 1e-12:
        speed = body + np.cross(wheel.gyro - s.gyro_bias, wheel.lever)
        jacobian[:, GYRO] = lie.hat(wheel.lever)
    r = speed - np.array([wheel.forward, 0, 0])

    def add(row: np.ndarray, miss: float, variance: float, delta: float) -> None:
        w = float(huber(np.array(miss / math.sqrt(variance)), delta)) / variance
        out.h += w * np.outer(row, row)
        out.g += w * row * miss
        out.used += 1

    for axis, sigma in enumerate((gates.forward_noise, gates.lateral_noise, gates.vertical_noise)):
        row = jacobian[axis]
        if axis == 0:
            flags["forward_nis"] = float(r[0] ** 2 / max(1e-8, sigma**2 + row @ prior @ row))
            if gates.forward_gate > 0 and not flags["forward_nis"] <= gates.forward_gate:
                flags["forward_rejected"] = True
                out.rejected += 1
                continue
        add(row, float(r[axis]), sigma**2, gates.wheel_huber)
    if wheel.yaw_rate is not None and wheel.gyro is not None:
        row = np.zeros(N)
        row[GYRO.start + 2] = -1
        miss = float(wheel.gyro[2] - s.gyro_bias[2] - wheel.yaw_rate)
        variance = gates.yaw_noise**2 + (gates.yaw_scale * wheel.yaw_rate) ** 2
        flags["yaw_nis"] = miss**2 / max(1e-8, variance + row @ prior @ row)
        if gates.yaw_gate > 0 and not flags["yaw_nis"] <= gates.yaw_gate:
            flags["yaw_rejected"] = True
            out.rejected += 1
        else:
            add(row, miss, variance, gates.wheel_huber)
            flags["yaw_used"] = True
    return out, flags


def wheel_gates(forward_miss: Column, forward_variance: Column, yaw_miss: Column, yaw_rate: Column, yaw_variance: Column, gates: UpdateGates) -> dict[str, Column]:
    """The flags of wheel_equations() as columns, for a state whose predicted variances of forward speed and turn rate are known."""
    forward = forward_miss**2 / F.greatest(F.lit(1e-8), gates.forward_noise**2 + forward_variance)
    yaw = yaw_miss**2 / F.greatest(F.lit(1e-8), gates.yaw_noise**2 + (gates.yaw_scale * yaw_rate) ** 2 + yaw_variance)
    passes = lambda nis, gate: F.lit(True) if gate <= 0 else F.coalesce(nis <= gate, F.lit(False))
    good = passes(yaw, gates.yaw_gate)
    return {"forward_rejected": ~passes(forward, gates.forward_gate), "yaw_rejected": ~good, "yaw_used": good, "forward_nis": forward, "yaw_nis": yaw}


def observable_part(h: np.ndarray, ratio: float) -> tuple[np.ndarray, int, float]:
    """Projection on the directions whose eigenvalue is that share of the largest, their number, and the condition among them."""
    values, vectors = np.linalg.eigh((h + h.T) / 2)
    values = np.maximum(values, 0)
    kept = values >= max(1e-12, values.max()) * ratio
    v = vectors[:, kept]
    return v @ v.T, int(kept.sum()), float(max(1e-12, values.max()) / max(1e-12, values[kept].min())) if kept.any() else math.inf


def rotation_information(h: np.ndarray) -> np.ndarray:
    """What pose information (turn, place) says of the turn alone, the place unknown."""
    values, vectors = np.linalg.eigh((h[3:, 3:] + h[3:, 3:].T) / 2)
    good = values > max(1e-12, 1e-8 * max(1e-12, values.max()))
    back = (vectors[:, good] / values[good]) @ vectors[:, good].T
    out = h[:3, :3] - h[:3, 3:] @ back @ h[3:, :3]
    return (out + out.T) / 2


def _clamped(v: np.ndarray, most: float) -> np.ndarray:
    size = float(np.linalg.norm(v))
    return v * (most / size) if size > most > 0 else v


def iterate(predicted: State, equations: Callable[[State], Linear], gates: UpdateGates, wheel: Wheel | None = None, yaw_spent: float = 0.0) -> tuple[State, dict]:
    """The state after an iterated update, and its result: converged, iterations, counts, observability.

    Each round solves the prior's and the measurements' information for a step; information on weak
    turns keeps a share only; the step's turn and shift are capped, and over the whole scan the
    changes of velocity and biases, and the turn about the vertical by what is left of a budget.
    The last step is never taken without its measurements having been looked at again.
    """
    prior = np.linalg.inv(predicted.covariance)
    s, result, confirmed, information = predicted, {"converged": False, "iterations": 0, "used": 0, "rejected": 0, "sectors": 0, "rmse": math.nan, "directions": 0, "turn_directions": 0, "condition": math.inf, "yaw_share": 0.0, "yaw_limited": False, "flags": {}, "normalised": math.nan, "degenerate": True}, 0, None
    up = predicted.rotation.T @ np.array([0.0, 0.0, 1.0])
    for k in range(gates.iterations + 1):
        lin = equations(s)
        result |= {"used": lin.used, "rejected": lin.rejected, "sectors": lin.sectors}
        if lin.used < gates.least:
            break
        pose = lin.h[:6, :6]
        _, directions, condition = observable_part(pose, gates.observable)
        turn_part, turn_directions, _ = observable_part(rotation_information(pose), gates.rotation_observable)
        keep = np.eye(6)
        keep[:3, :3] = gates.weak_share * np.eye(3) + (1 - gates.weak_share) * turn_part
        h, g = np.zeros((N, N)), np.zeros(N)
        h[:6, :6], g[:6] = keep @ pose @ keep, keep @ lin.g[:6]
        if wheel is not None:
            more, result["flags"] = wheel_equations(s, predicted.covariance, wheel, gates)
            h, g = h + more.h, g + more.g
        change = s.minus(predicted)
        information = prior + h + gates.damping * np.eye(N)
        step = np.linalg.solve(information, -(prior @ change + g))
        if not np.isfinite(step).all():
            break
        step[GYRO] = keep[:3, :3] @ step[GYRO]
        step[TURN], step[PLACE] = _clamped(step[TURN], gates.max_turn), _clamped(step[PLACE], gates.max_shift)
        for part, most in ((VELOCITY, gates.max_velocity), (GYRO, gates.max_gyro_bias), (ACCEL, gates.max_accel_bias)):
            step[part] = _clamped(change[part] + step[part], most) - change[part]
        if math.isfinite(gates.yaw_budget):
            turned = lie.rotation_vector(predicted.rotation.T @ s.rotation @ lie.rotation(step[TURN]))
            about = float(turned @ up)
            allowed = min(gates.yaw_budget - yaw_spent, max(-gates.yaw_budget - yaw_spent, about))
            if abs(allowed - about) > 1e-10:
                result["yaw_limited"] = True
                step[TURN] = lie.rotation_vector(s.rotation.T @ predicted.rotation @ lie.rotation(turned + (allowed - about) * up))
        result |= {"iterations": k + 1, "rmse": math.sqrt(lin.square / lin.used), "directions": directions, "turn_directions": turn_directions, "condition": condition, "yaw_share": float(np.clip(turn_part[2, 2], 0, 1)), "normalised": lin.normalised / lin.used, "degenerate": directions < 6}
        small = float(np.linalg.norm(step[PLACE])) < gates.done_shift and float(np.linalg.norm(step[TURN])) < gates.done_turn
        confirmed = confirmed + 1 if small else 0
        if confirmed >= gates.confirmations:
            result["converged"] = True
            break
        if k >= gates.iterations:
            break
        s = s.plus(step)
    if information is None or result["used"] < gates.least:
        return predicted, result | {"converged": False}
    return replace(s, covariance=_tidy(np.linalg.inv(information))), result


def scan_update(predicted: State, points: np.ndarray, planes: PlaneMap, gates: UpdateGates, wheel: Wheel | None = None, yaw_spent: float = 0.0) -> tuple[State, dict]:
    """iterate() on a scan's points (in the body's frame) against a map's planes, which are looked up anew in every round."""

    def equations(s: State) -> Linear:
        return point_equations(s, predicted.covariance, points, *planes.planes(points @ s.rotation.T + s.place), gates, planes.gates)

    return iterate(predicted, equations, gates, wheel, yaw_spent)


def visual_update(predicted: State, equations: Callable[[State], Linear], gates: UpdateGates, max_z: float = 0.3) -> tuple[State, dict]:
    """iterate() on image misses, then the decision on height: a change of height that is weakly seen or beyond max_z is undone.

    Height counts as seen if its share of the observable directions is a half at least.
    """
    s, result = iterate(predicted, equations, gates)
    seen = 0.0
    if result["used"] >= gates.least:
        part, _, _ = observable_part(equations(s).h[3:6, 3:6], gates.observable)
        seen = float(np.clip(part[2, 2], 0, 1))
    change = float(s.place[2] - predicted.place[2])
    use = seen >= 0.5 and abs(change) <= max_z
    if not use:
        s = replace(s, place=np.array([s.place[0], s.place[1], predicted.place[2]]), velocity=np.array([*s.velocity[:2], predicted.velocity[2]]))
    return s, result | {"z_seen": seen, "z_change": change, "use_z": use}


def image_updates(sums: DataFrame, keys: list[str], turn: str, gates: UpdateGates = UpdateGates(), max_z: float = 0.3, covariance: np.ndarray | None = None) -> DataFrame:
    """visual_update() by the sums of equations.photometric_pose(), a row a key: (keys, px, py, pz, turn_x, turn_y, turn_z, landmarks, converged, z_seen, use_z).

    sums also has the predicted place (x, y, z) and, under the name turn, the predicted turn as an
    array (w, x, y, z). The equations are those at the prediction, moved along with the state to
    first order; turn_* is the change of turn in the body's axes. Keys without sums keep their
    prediction; a row is all that a task needs of a key.
    """
    from waymark.operators.equations import SIX

    kinds = ", ".join(f"{c} {sums.schema[c].dataType.simpleString()}" for c in keys)
    names = ["px", "py", "pz", "turn_x", "turn_y", "turn_z", "landmarks", "converged", "z_seen", "use_z"]
    first = np.diag(np.repeat([1e-4, 0.04, 0.25, 1e-8, 1e-6, 1e-8], 3)) if covariance is None else covariance

    def one(row) -> dict:
        start = State(rotation=lie.from_quaternion(np.array(row[turn], float)), place=np.array([row["x"], row["y"], row["z"]], float), covariance=first)
        h, g = np.zeros((6, 6)), np.zeros(6)
        n = 0 if row["landmarks"] is None or pd.isna(row["landmarks"]) else int(row["landmarks"])
        if n:
            for a in range(6):
                g[a] = row[f"g_{SIX[a]}"]
                for b in range(a, 6):
                    h[a, b] = h[b, a] = row[f"h_{SIX[a]}_{SIX[b]}"]

        def equations(s: State) -> Linear:
            out, change = Linear(used=n), s.minus(start)[:6]
            out.h[:6, :6], out.g[:6] = h, g + h @ change
            out.square = max(0.0, float(0 if not n else row["cost"]))
            return out

        s, result = visual_update(start, equations, gates, max_z)
        change = lie.rotation_vector(start.rotation.T @ s.rotation)
        return dict(zip(names, [*map(float, s.place), *map(float, change), n, bool(result["converged"]), result["z_seen"], bool(result["use_z"])], strict=True))

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame([{c: row[c] for c in keys} | one(row) for row in p.to_dict("records")], columns=[*keys, *names])

    return sums.mapInPandas(run, f"{kinds}, px double, py double, pz double, turn_x double, turn_y double, turn_z double, landmarks long, converged boolean, z_seen double, use_z boolean")


_PRODUCTS = ("xx", "xy", "xz", "yy", "yz", "zz")


def scan_parts(scans: DataFrame, world: DataFrame, states: DataFrame, keys: list[str], plane_gates: PlaneGates, scan_cell: float) -> DataFrame:
    """Rows that a scan's task needs: means of the scan's cells (what 0), sums of the map's voxels (1), the state (2).

    So a task grows with the space that scan and map cover and not with their density. Points with
    a place that is null or no number don't count; they are left out of the sums, as a filter before
    would be pushed down to the tables and work out the places there once more for each of its terms.
    """
    places = ["x", "y", "z"]
    cells = lambda size: {f"i{c}": F.floor(F.col(c) / size).cast("long") for c in places}
    known = " and ".join(f"coalesce(abs({c}) < double('Infinity'), false)" for c in places)
    counted = lambda df: df.withColumns({c: F.when(F.expr(known), F.col(c)) for c in places})
    of_scan = counted(scans).withColumns(cells(scan_cell)).groupBy(*keys, "ix", "iy", "iz").agg(F.lit(0).alias("what"), F.count("x").alias("n"), *[F.avg(c).cast("double").alias(c) for c in places])
    of_map = counted(world).withColumns(cells(plane_gates.voxel)).groupBy(*keys, "ix", "iy", "iz").agg(F.lit(1).alias("what"), F.count("x").alias("n"), *[F.sum(c).cast("double").alias(c) for c in places], *[F.sum(F.col(a) * F.col(b)).cast("double").alias(f"s{a}{b}") for a, b in _PRODUCTS])
    of_scan, of_map = of_scan.filter("n > 0"), of_map.filter("n > 0")
    first = states.select(*keys, F.lit(2).alias("what"), *[F.col(f"p{c}").cast("double").alias(c) for c in places], F.col("yaw").cast("double").alias("yaw"), F.col("speed").cast("double").alias("speed"))
    return of_scan.unionByName(of_map, allowMissingColumns=True).unionByName(first, allowMissingColumns=True)


def update_scans(scans: DataFrame, world: DataFrame, states: DataFrame, keys: list[str], plane_gates: PlaneGates = PlaneGates(), gates: UpdateGates = UpdateGates(), scan_cell: float = 0.3) -> DataFrame:
    """Scans (keys, x, y, z in the body's frame) registered on a map's points (keys, x, y, z) from states (keys, px, py, pz, yaw, speed).

    (keys, px, py, pz, yaw, converged, iterations, used, rejected, sectors, rmse, directions,
    turn_directions, condition, yaw_share). A scan is one task of its cells' means and its map's
    voxel sums, both made before; speed, if it is there, is the wheels' forward speed. Scans
    without a state don't count; one without points keeps its state.
    """
    kinds = ", ".join(f"{c} {scans.schema[c].dataType.simpleString()}" for c in keys)
    rows = scan_parts(scans, world, states, keys, plane_gates, scan_cell)
    columns = {"px": "double", "py": "double", "pz": "double", "yaw": "double", "converged": "boolean", "iterations": "int", "used": "int", "rejected": "int", "sectors": "int", "rmse": "double", "directions": "int", "turn_directions": "int", "condition": "double", "yaw_share": "double"}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part = {k: g.sort_values(["ix", "iy", "iz"]) for k, g in pdf.groupby("what")}
        if 2 not in part:
            return pd.DataFrame({c: pd.Series(dtype="object") for c in [*keys, *columns]})
        first = part[2].iloc[0]
        pose = lie.planar(first["x"], first["y"], first["yaw"], first["z"])
        speed = first["speed"]
        forward = np.array([0.0 if pd.isna(speed) else speed, 0, 0])
        start = State(rotation=pose[:3, :3], place=pose[:3, 3], velocity=pose[:3, :3] @ forward, covariance=np.diag(np.repeat([0.02, 0.5, 0.5, 1e-6, 1e-4, 1e-6], 3)))
        points = part[0][["x", "y", "z"]].to_numpy(float) if 0 in part else np.zeros((0, 3))
        held = part.get(1)
        known = PlaneMap(np.zeros((0, 3)), plane_gates) if held is None else PlaneMap.of_sums(held[["ix", "iy", "iz"]].to_numpy(np.int64), held["n"].to_numpy(float), held[["x", "y", "z"]].to_numpy(float), held[[f"s{c}" for c in _PRODUCTS]].to_numpy(float), plane_gates)
        s, result = scan_update(start, points, known, gates, None if pd.isna(speed) else Wheel(float(speed)))
        out = {c: pdf[c].iloc[0] for c in keys} | {"px": s.place[0], "py": s.place[1], "pz": s.place[2], "yaw": float(lie.yaw_of(s.rotation))}
        return pd.DataFrame([out | {c: result[c] for c in columns if c in result}])

    return in_tasks(rows, keys).groupBy(*keys).applyInPandas(run, f"{kinds}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))
