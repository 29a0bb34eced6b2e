"""Sequential state estimation: steps of filters, run as ordered folds per key.

One run is one task, as each step needs the state before it; runs are independent.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def planar_filter(process: float, turn_process: float, fix_sigma: float) -> Callable:
    """Extended filter on place and heading: predicts by an odometry step (ds along the middle heading, da), corrects by a fix (fx, fy) where there is one.

    The covariance follows the motion's derivative, process variance is added to place and heading,
    and the correction is in Joseph's form. Adds ex, ey, ea, var_xy (mean of both) and var_a. Null
    steps are none; a fix counts only if both parts are there.
    """

    def start():
        def step(state, row):
            x, p = state
            ds, da = row["ds"] or 0.0, row["da"] or 0.0
            mid = x[2] + da / 2
            f = np.eye(3)
            f[0, 2], f[1, 2] = -ds * math.sin(mid), ds * math.cos(mid)
            x = x + np.array([ds * math.cos(mid), ds * math.sin(mid), da])
            p = f @ p @ f.T + np.diag([process, process, turn_process])
            if row["fx"] is not None and row["fy"] is not None:
                h, r = np.eye(2, 3), fix_sigma**2 * np.eye(2)
                k = p @ h.T @ np.linalg.inv(h @ p @ h.T + r)
                x = x + k @ (np.array([row["fx"], row["fy"]]) - x[:2])
                keep = np.eye(3) - k @ h
                p = keep @ p @ keep.T + k @ r @ k.T
            return (x, p), [{**row, "ex": float(x[0]), "ey": float(x[1]), "ea": float(x[2]), "var_xy": float(p[0, 0] + p[1, 1]) / 2, "var_a": float(p[2, 2])}]

        return (np.zeros(3), np.eye(3)), step

    return start


def constant_velocity(time: str, reset: float) -> Callable:
    """Prediction from the last two positions (x, y); falls back to the last one where the prediction misses by more than reset."""

    def start():
        def step(state, row):
            before, last = state
            px, py, used = row["x"], row["y"], "first"
            if last is not None:
                px, py, used = last[1], last[2], "hold"
                if before is not None and last[0] > before[0]:
                    s = (row[time] - last[0]) / (last[0] - before[0])
                    px, py, used = last[1] + s * (last[1] - before[1]), last[2] + s * (last[2] - before[2]), "velocity"
                    if math.hypot(px - row["x"], py - row["y"]) > reset:
                        px, py, used = last[1], last[2], "reset"
            return (last, (row[time], row["x"], row["y"])), [{**row, "px": px, "py": py, "used": used}]

        return (None, None), step

    return start


@dataclass(frozen=True)
class Outage:
    """Rejected scans from which a state is held, and frozen without wheels; caps of speed and step, share of speed kept, height that may be lost."""

    hold: int = 2
    freeze: int = 5
    max_speed: float = 20.0
    max_step: float = 30.0
    decay: float = 0.8
    max_height: float = 0.5


def outage_guard(time: str, unit: float, how: Outage = Outage()) -> Callable:
    """Places through outages of the scans. Rows: accepted, propagated x, y, z, vx, vy, heading, wheel (speed, null without).

    While scans are accepted, or few were rejected, the propagated state counts ("tracked",
    "predicted"). Then the place goes on from the one before by the wheels along the heading
    ("reckoned") or by its own speed, which fades ("held"), both capped; without wheels it is frozen
    at the last accepted place after some more ("frozen"). Height stays near the last accepted one.
    Adds ex, ey, ez, speed and mode.
    """

    def start():
        def step(state, row):
            count, good, here, last = state
            t = row[time] / unit
            if row["accepted"]:
                here = good = (row["x"], row["y"], row["z"], row["vx"], row["vy"])
                count, mode = 0, "tracked"
            else:
                count += 1
                if good is None or count < how.hold:
                    here, mode = (row["x"], row["y"], row["z"], row["vx"], row["vy"]), "predicted"
                elif row["wheel"] is None and count >= how.freeze:
                    here, mode = (*good[:3], 0.0, 0.0), "frozen"
                else:
                    wheel = row["wheel"]
                    vx, vy = here[3:] if wheel is None else (wheel * math.cos(row["heading"]), wheel * math.sin(row["heading"]))
                    speed = math.hypot(vx, vy)
                    share = min(1.0, how.max_speed / speed) if speed > 0 else 1.0
                    vx, vy = vx * share, vy * share
                    dt = 0.0 if last is None else max(0.0, t - last)
                    length = math.hypot(vx, vy) * dt
                    cut = min(1.0, how.max_step / length) if length > 0 else 1.0
                    z = good[2] + max(-how.max_height, min(how.max_height, row["z"] - good[2]))
                    kept = 1.0 if wheel is not None else how.decay
                    here, mode = (here[0] + vx * dt * cut, here[1] + vy * dt * cut, z, vx * kept, vy * kept), "held" if wheel is None else "reckoned"
            return (count, good, here, t), [{**row, "ex": here[0], "ey": here[1], "ez": here[2], "speed": math.hypot(*here[3:]), "mode": mode}]

        return (0, None, None, None), step

    return start


@dataclass(frozen=True)
class Voxel:
    """Points up to which a voxel's mean and scatter are exact, the gain afterwards, and what its plane needs."""

    full: int = 20
    least: int = 5
    gain: float = 1.0
    freeze: bool = True
    max_flatness: float = 0.1
    least_width: float = 1e-3


def voxel_update(how: Voxel = Voxel()) -> Callable:
    """A voxel's points (x, y, z) one by one: mean and scatter exact while it fills, an exponential mean and covariance afterwards, and its plane refitted each time.

    A full voxel with a valid plane changes no more if freeze. A plane needs enough points, a
    smallest eigenvalue small against the middle one, and a middle one that isn't small. Adds n, mx,
    my, mz, nx, ny, nz (normal, largest part positive; 0 without a plane), width and plane.
    """

    def start():
        def step(state, row):
            n, mean, scatter, normal, width, plane = state
            p = np.array([row["x"], row["y"], row["z"]])
            if not (how.freeze and plane and n >= how.full):
                delta = p - mean
                if n < how.full:
                    n += 1
                    mean = mean + delta / n
                    scatter = scatter + np.outer(delta, p - mean)
                else:
                    alpha = how.gain / n
                    mean = mean + alpha * delta
                    scatter = (1 - alpha) * scatter + alpha * (n - 1) * np.outer(p - mean, p - mean)
                normal, width, plane = np.zeros(3), 0.0, False
                if n >= how.least:
                    values, vectors = np.linalg.eigh(scatter / max(1, n - 1))
                    width = float(values[1])
                    plane = width >= how.least_width and max(0.0, float(values[0])) <= how.max_flatness * width
                    if plane:
                        normal = vectors[:, 0] * (1 if vectors[np.abs(vectors[:, 0]).argmax(), 0] > 0 else -1)
            out = dict(zip(("mx", "my", "mz", "nx", "ny", "nz"), map(float, (*mean, *normal)), strict=True))
            return (n, mean, scatter, normal, width, plane), [{**row, "n": n, **out, "width": width, "plane": plane}]

        return (0, np.zeros(3), np.zeros((3, 3)), np.zeros(3), 0.0, False), step

    return start


@dataclass(frozen=True)
class HeightControl:
    """Residuals a frame needs, their largest spread, dead-band, frames that must agree, gain, step and total."""

    least: int = 10
    max_mad: float = 0.3
    dead: float = 0.05
    needed: int = 2
    gain: float = 0.5
    most_step: float = 0.1
    most: float = 2.0
    stale: int = 8


def height_controller(how: HeightControl = HeightControl()) -> Callable:
    """Height correction by frames' residuals (n, median, mad): enough of them that agree, in successive frames of one sign, by limited steps.

    A step is gain times trust times the median's rest; trust fades with the frames since the last
    good one. Adds correction, streak, trust and reason: applied, few, spread, dead_band or streak.
    """

    def start():
        def step(state, row):
            correction, sign, streak, missed = state
            trust = max(0.0, 1 - missed / how.stale)
            if row["n"] is None or row["n"] < how.least:
                now, reason = (correction, 0, 0, missed + 1), "few"
            elif row["mad"] > how.max_mad:
                now, reason = (correction, 0, 0, missed + 1), "spread"
            else:
                rest = row["median"] - correction
                if abs(rest) <= how.dead:
                    now, reason = (correction, 0, 0, 0), "dead_band"
                else:
                    side = 1 if rest > 0 else -1
                    streak = streak + 1 if side == sign else 1
                    reason = "streak"
                    if streak >= how.needed:
                        correction += max(-how.most_step, min(how.most_step, how.gain * trust * rest))
                        correction, reason = max(-how.most, min(how.most, correction)), "applied"
                    now = (correction, side, streak, 0)
            return now, [{**row, "correction": now[0], "streak": now[2], "trust": trust, "reason": reason}]

        return (0.0, 0, 0, 0), step

    return start


@dataclass(frozen=True)
class PlaneControl:
    """Inliers a frame's motion needs, the largest it may be, how near successive ones must be, how many, gain and caps of steps."""

    least: int = 10
    ratio: float = 0.4
    max_shift: float = 3.0
    max_turn: float = 0.1
    agree_shift: float = 0.5
    agree_turn: float = 0.02
    needed: int = 2
    gain: float = 0.4
    most_shift: float = 0.3
    most_turn: float = 0.01


def plane_controller(how: PlaneControl = PlaneControl()) -> Callable:
    """Correction in plane and heading by frames' motions (x, y, yaw, inliers, n): gates, agreement of successive frames, limited steps.

    Adds cx, cy, ca, streak and reason: applied, few, ratio, too_far or streak.
    """

    def start():
        def step(state, row):
            (cx, cy, ca), last, streak = state
            reason = (
                "few" if row["x"] is None or row["inliers"] < how.least
                else "ratio" if row["inliers"] < how.ratio * row["n"]
                else "too_far" if math.hypot(row["x"], row["y"]) > how.max_shift or abs(row["yaw"]) > how.max_turn
                else None
            )
            if reason:
                last, streak = None, 0
            else:
                near = last is not None and math.hypot(row["x"] - last[0], row["y"] - last[1]) <= how.agree_shift and abs(row["yaw"] - last[2]) <= how.agree_turn
                streak, last, reason = streak + 1 if near else 1, (row["x"], row["y"], row["yaw"]), "streak"
                if streak >= how.needed:
                    dx, dy, da = how.gain * (row["x"] - cx), how.gain * (row["y"] - cy), how.gain * (row["yaw"] - ca)
                    cut = min(1.0, how.most_shift / max(1e-12, math.hypot(dx, dy)))
                    cx, cy, ca, reason = cx + dx * cut, cy + dy * cut, ca + max(-how.most_turn, min(how.most_turn, da)), "applied"
            return ((cx, cy, ca), last, streak), [{**row, "cx": cx, "cy": cy, "ca": ca, "streak": streak, "reason": reason}]

        return ((0.0, 0.0, 0.0), None, 0), step

    return start
