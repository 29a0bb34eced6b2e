"""Ordered gates with named limits: registrations, map insertion, map matches, fixes, images, loop proposals.

Gates without memory are column expressions. Those with memory (budgets, cooldowns, support over
frames) are step functions for ordered folds, one run per task, with a state of a few numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.filters import first_reason


def over(c: Column, most: float) -> Column:
    """Whether a value is over a limit, or no number."""
    return F.coalesce(F.isnan(c) | (c > most), F.lit(True))


def under(c: Column, least: float) -> Column:
    """Whether a value is under a limit, or no number."""
    return F.coalesce(F.isnan(c) | (c < least), F.lit(True))


class _Columns:
    """The measures of a ladder of rules as columns."""

    over, under = staticmethod(over), staticmethod(under)

    def __getitem__(self, name: str) -> Column:
        return F.col(name)

    def known(self, condition: Column, otherwise: bool) -> Column:
        return F.coalesce(condition, F.lit(otherwise))


class _Row:
    """The measures of a ladder of rules as one row's values; conditions are NumPy booleans."""

    def __init__(self, row: dict):
        self.row = row

    def __getitem__(self, name: str):
        value = self.row[name]
        return np.bool_(value) if isinstance(value, (bool, np.bool_)) else np.float64(math.nan if value is None else value)

    def over(self, x: np.float64, most: float) -> np.bool_:
        return ~np.bool_(x <= most)

    def under(self, x: np.float64, least: float) -> np.bool_:
        return ~np.bool_(x >= least)

    def known(self, condition, otherwise: bool) -> np.bool_:
        return condition if isinstance(condition, np.bool_) else np.bool_(otherwise)


def reason_of(rules: Callable, row: dict, otherwise: str) -> str:
    """The first rule of a ladder that a row breaks, as the ladder's column would say."""
    return next((reason for broken, reason in rules(_Row(row)) if broken), otherwise)


# ---- registrations ----


@dataclass(frozen=True)
class Registration:
    """Limits of a scan's registration; those of strong support let weak ones pass."""

    least: int = 100
    least_ratio: float = 0.3
    strong: int = 800
    strong_rmse: float = 0.1
    max_rmse: float = 0.25
    max_normalised: float = 3.0
    directions: int = 5
    max_shift: float = 2.0
    max_turn: float = 15.0
    max_turn_nis: float = 16.0
    max_yaw_total: float = 3.0
    max_correction_shift: float = 1.0
    max_correction_turn: float = 5.0
    weak_ratio: float = 0.5
    weak_rmse: float = 0.15


def registration_reason(g: Registration = Registration()) -> Column:
    """Why a registration is refused, or "accepted": the first rule broken, in this order.

    Columns: used (correspondences), linearised, converged, ratio (inliers), rmse, normalised
    (mean normalised residual), directions (observable), shift and turn (motion since the last
    scan), turn_nis, yaw_total (over a trailing window), correction_shift and correction_turn,
    degenerate. Null or infinite measures break their rule.
    """
    return first_reason(registration_rules(g)(_Columns()))


def registration_rules(g: Registration) -> Callable:
    """The ladder of registration_reason(), for columns or for one row."""

    def rules(c):
        strong = c.known((c["used"] >= g.strong) & (c["rmse"] <= g.strong_rmse), False)
        return [
            (c.under(c["used"], g.least), "too_few_planes"),
            (~c.known(c["linearised"], False), "not_linearised"),
            (~c.known(c["converged"], False), "not_converged"),
            (c.under(c["ratio"], g.least_ratio) & ~strong, "low_support"),
            (c.over(c["rmse"], g.max_rmse), "high_residual"),
            (c.over(c["normalised"], g.max_normalised), "high_normalised_residual"),
            (c.under(c["directions"], g.directions) & ~strong, "unobservable"),
            (c.over(c["shift"], g.max_shift) | c.over(c["turn"], g.max_turn), "implausible_motion"),
            (c.over(c["turn_nis"], g.max_turn_nis), "turn_innovation"),
            (c.over(c["yaw_total"], g.max_yaw_total) | c.under(c["yaw_total"], -g.max_yaw_total), "persistent_yaw"),
            (c.over(c["correction_shift"], g.max_correction_shift) | c.over(c["correction_turn"], g.max_correction_turn), "implausible_correction"),
            (c.known(c["degenerate"], True) & ~strong & (c.under(c["ratio"], g.weak_ratio) | c.over(c["rmse"], g.weak_rmse)), "weak_degenerate"),
        ]

    return rules


@dataclass(frozen=True)
class Insertion:
    """Limits for writing a scan into the map; 0 switches a limit off."""

    directions: int = 6
    turn_directions: int = 3
    yaw_share: float = 0.5
    max_normalised: float = 2.0
    converged: bool = True
    max_shift: float = 0.5
    max_turn: float = 3.0


def insertion_reason(g: Insertion = Insertion()) -> Column:
    """Why a scan isn't written into the map, or "updated": the first rule broken, in this order.

    Columns: directions, turn_directions, yaw_share, normalised, converged, yaw_limited,
    correction_shift, correction_turn, trusted (after an outage), keyframe.
    """
    return first_reason(insertion_rules(g)(_Columns()), "updated")


def insertion_rules(g: Insertion) -> Callable:
    """The ladder of insertion_reason(), for columns or for one row."""

    def rules(c):
        large = [rule for on, rule in ((g.max_shift > 0, c.over(c["correction_shift"], g.max_shift)), (g.max_turn > 0, c.over(c["correction_turn"], g.max_turn))) if on]
        return [
            rule for on, rule in (
                (True, (c.under(c["directions"], g.directions), "insufficient_observability")),
                (g.turn_directions > 0, (c.under(c["turn_directions"], g.turn_directions), "insufficient_turn_observability")),
                (g.yaw_share > 0, (c.under(c["yaw_share"], g.yaw_share), "insufficient_yaw_observability")),
                (g.max_normalised > 0, (c.over(c["normalised"], g.max_normalised), "high_normalised_residual")),
                (g.converged, (~c.known(c["converged"], False), "not_converged")),
                (True, (c.known(c["yaw_limited"], True), "limited_yaw")),
                (bool(large), (large[0] | large[-1] if large else None, "large_correction")),
                (True, (~c.known(c["trusted"], False), "recovery")),
                (True, (~c.known(c["keyframe"], False), "not_keyframe")),
            ) if on
        ]

    return rules


def recovery_trust(needed: int) -> Callable:
    """After a row with outage, rows (strong) are trusted again once enough strong ones came in a row; adds trusted."""

    def start():
        def step(state, row):
            guarded, streak = state
            if row["outage"]:
                guarded, streak = True, 0
            elif guarded:
                streak = streak + 1 if row["strong"] else 0
                guarded = streak < max(1, needed)
            return (guarded, streak), [{**row, "trusted": not guarded}]

        return (False, 0), step

    return start


@dataclass(frozen=True)
class MapMatch:
    """Limits of a match against the prior map."""

    confidence: float = 0.4
    ratio: float = 0.25
    inliers: int = 15
    max_correction: float = 30.0
    max_gps: float = 20.0


def map_match_accepted(g: MapMatch = MapMatch()) -> Column:
    """Whether a match (e, n, confidence, ratio, inliers) is near the state (state_e, state_n) and the GPS position (gps_e, gps_n; null: not asked)."""
    far = lambda e, n: F.hypot(F.col("e") - F.col(e), F.col("n") - F.col(n))
    strong = ~under(F.col("confidence"), g.confidence) & ~under(F.col("ratio"), g.ratio) & ~under(F.col("inliers"), g.inliers)
    return strong & ~over(far("state_e", "state_n"), g.max_correction) & (F.col("gps_e").isNull() | F.col("gps_n").isNull() | ~over(far("gps_e", "gps_n"), g.max_gps))


def fix_deviation(covariance_type: Column, var_e: Column, var_n: Column, unknown: float = 999.0) -> Column:
    """Horizontal standard deviation of a fix: that of the mean variance; unknown if the type is 0, 0 without variance."""
    total = F.greatest(F.lit(0.0), var_e) + F.greatest(F.lit(0.0), var_n)
    return F.when(covariance_type == 0, unknown).when(total > 1e-12, F.sqrt(total / 2)).otherwise(0.0)


def fix_accepted(status: Column, deviation: Column, min_status: int, max_deviation: float) -> Column:
    """Whether a fix has the status and is exact enough; null or infinite parts fail."""
    return F.coalesce(status >= min_status, F.lit(False)) & ~over(deviation, max_deviation)


# ---- images ----


@dataclass(frozen=True)
class Tracking:
    """Limits of a relative pose from tracked features."""

    features: int = 60
    inliers: int = 25
    ratio: float = 0.4
    parallax: float = 1.0
    reprojection: float = 2.0
    max_turn: float = 20.0
    max_shift: float = 3.0


def tracking_reason(g: Tracking = Tracking()) -> Column:
    """Why tracked features give no relative pose, or "accepted". Columns: tracked, inliers, parallax (pixels), reprojection (pixels), turn (degrees), shift (metres)."""
    ratio = F.try_divide(F.col("inliers"), F.col("tracked"))
    return first_reason([
        (under(F.col("tracked"), g.features), "few_features"),
        (under(F.col("parallax"), g.parallax), "parallax"),
        (under(F.col("inliers"), g.inliers), "few_inliers"),
        (under(ratio, g.ratio), "inlier_ratio"),
        (over(F.col("reprojection"), g.reprojection), "reprojection"),
        (over(F.col("turn"), g.max_turn) | over(F.col("shift"), g.max_shift), "implausible_motion"),
    ])


def tracking_quality(g: Tracking = Tracking()) -> Column:
    """0 to 1: half the share of inliers, a third their number against twice the least, a sixth the reprojection error."""
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    return share(F.try_divide(F.col("inliers"), F.col("tracked"))) / 2 + share(F.col("inliers") / (2.0 * g.inliers)) / 3 + share(1 - F.col("reprojection") / g.reprojection) / 6


@dataclass(frozen=True)
class LoopVerification:
    """Limits of a loop between two images."""

    matches: int = 40
    inliers: int = 20
    ratio: float = 0.35
    reprojection: float = 3.0
    max_distance: float = 15.0
    cells: int = 6


def loop_verified(g: LoopVerification = LoopVerification()) -> tuple[Column, Column]:
    """Reason ("verified", or the first rule broken) and quality of matches between two images. Columns: matches, inliers, reprojection, distance (metres), cells (of the image that hold inliers)."""
    ratio = F.try_divide(F.col("inliers"), F.col("matches"))
    reason = first_reason([
        (under(F.col("matches"), g.matches), "few_matches"),
        (under(F.col("inliers"), g.inliers), "few_inliers"),
        (under(ratio, g.ratio), "inlier_ratio"),
        (over(F.col("reprojection"), g.reprojection), "reprojection"),
        (under(F.col("cells"), g.cells), "coverage"),
        (over(F.col("distance"), g.max_distance), "distance"),
    ], "verified")
    share = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))
    quality = 0.5 * share(ratio) + 0.3 * share(F.col("inliers") / (3.0 * g.inliers)) + 0.2 * share(1 - F.col("reprojection") / g.reprojection)
    return reason, quality


@dataclass(frozen=True)
class Overhead:
    """Limits of a match of a ground view on an image from above."""

    matches: int = 12
    inliers: int = 8
    ratio: float = 0.3
    max_offset: float = 60.0
    scale: tuple[float, float] = (0.6, 1.6)


def overhead_match(g: Overhead = Overhead()) -> tuple[Column, Column]:
    """Reason ("accepted", or the first rule broken) and confidence. Columns: matches, inliers, dx, dy (metres from the prediction), scale (of the fitted map)."""
    ratio = F.try_divide(F.col("inliers"), F.col("matches"))
    reason = first_reason([
        (under(F.col("matches"), g.matches), "few_matches"),
        (under(F.col("inliers"), g.inliers), "few_inliers"),
        (under(ratio, g.ratio), "inlier_ratio"),
        (under(F.col("scale"), g.scale[0]) | over(F.col("scale"), g.scale[1]), "scale"),
        (over(F.hypot("dx", "dy"), g.max_offset), "offset"),
    ])
    return reason, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(ratio, F.lit(0.0)) * (1 - F.exp(-F.col("inliers") / (2.0 * g.inliers)))))


# ---- planar poses with height in plain numbers, for folds ----

Pose = tuple[float, float, float, float]


def wrap(a: float) -> float:
    return math.atan2(math.sin(a), math.cos(a))


def compose(a: Pose, b: Pose) -> Pose:
    """Pose a, then b within it."""
    c, s = math.cos(a[3]), math.sin(a[3])
    return a[0] + c * b[0] - s * b[1], a[1] + s * b[0] + c * b[1], a[2] + b[2], wrap(a[3] + b[3])


def invert(a: Pose) -> Pose:
    c, s = math.cos(a[3]), math.sin(a[3])
    return -c * a[0] - s * a[1], s * a[0] - c * a[1], -a[2], -a[3]


def between(a: Pose, b: Pose) -> Pose:
    """Pose b seen from pose a."""
    return compose(invert(a), b)


def _finite(*values) -> bool:
    return all(v is not None and math.isfinite(v) for v in values)


# ---- loop proposals ----


@dataclass(frozen=True)
class Admission:
    """Limits of loop proposals; times in microseconds, lengths in metres, angles in radians, 0 factors: no budget."""

    quality: float = 0.5
    verified_quality: float = 0.3
    min_time: int = 5_000_000
    min_gap: int = 4
    max_factors: int = 0
    reference_near: int = 1
    min_interval: int = 4_000_000
    max_image_xy: float = 1.0
    max_image_yaw: float = 0.1
    max_ground_step: float = 0.25
    max_shift: float = 8.0
    max_turn: float = 0.5
    support: int = 2
    support_near: int = 3
    support_gap: int = 3
    support_xy: float = 1.5
    support_yaw: float = 0.15
    support_z: float = 0.5
    graph_xy: float = 5.0
    graph_yaw: float = 0.4
    graph_z: float = 1.0
    sigma_growth: float = 2.0


#: What admit() adds to a proposal.
ADMITTED = "reason string, support long, z_applied double, z_clipped boolean, sigma_scale double, fx double, fy double, fz double, fyaw double"


def _pose(row: dict, prefix: str) -> Pose:
    return tuple(row[f"{prefix}{c}"] for c in ("x", "y", "z", "yaw"))


class _Support:
    """Proposals of one place that agree from frame to frame, by the correction each implies."""

    def __init__(self) -> None:
        self.count, self.reference, self.current, self.correction = 0, 0, 0, (0.0, 0.0, 0.0, 0.0)

    def meets(self, i: int, j: int, near: int, gap: int) -> bool:
        return self.count > 0 and abs(i - self.reference) <= near and 0 < j - self.current <= gap

    def restart(self, i: int, j: int, correction: Pose) -> None:
        self.count, self.reference, self.current, self.correction = 1, i, j, correction

    def extend(self, j: int, correction: Pose) -> None:
        """One more frame; the correction becomes the mean of those so far."""
        delta = between(self.correction, correction)
        self.count += 1
        self.current, self.correction = j, compose(self.correction, tuple(d / self.count for d in delta))


def admit(g: Admission = Admission()) -> Callable:
    """Ordered fold over loop proposals: each gets the reason that stops it, or "waiting" for support, or "applied".

    Rows, in order of the current keyframe: i, j (reference, current), t_ref, t_cur, measured pose
    m*, raw poses a*, b*, graph poses ga*, gb* (each x, y, z, yaw), quality, verified (whether the
    scans of both agree), their pose l*, ground_dz (height the ground misses; null without).
    Rules in order: finite input, quality (lower if verified), time, index gap, budget, cooldown by
    reference and by time, agreement of scans, of images with them, ground (its step is capped),
    disagreement with raw poses, support by several frames, consistency with the graph (which
    starts support anew), no pair twice. The factor's pose f* and the growth of its sigmas follow.
    """

    def start():
        def step(state, row):
            support, made, last_time, last_reference, pairs = state
            out = dict(row) | {"support": support.count, "z_applied": 0.0, "z_clipped": False, "sigma_scale": None, "fx": None, "fy": None, "fz": None, "fyaw": None}

            def stop(reason):
                return (support, made, last_time, last_reference, pairs), [out | {"reason": reason, "support": support.count}]

            measured, a, b = _pose(row, "m"), _pose(row, "a"), _pose(row, "b")
            verified = bool(row["verified"])
            if not _finite(*measured, row["quality"], row["t_ref"], row["t_cur"]):
                return stop("invalid")
            if row["quality"] < (g.verified_quality if verified else g.quality):
                return stop("quality")
            if row["t_cur"] - row["t_ref"] < g.min_time:
                return stop("time")
            i, j = row["i"], row["j"]
            if not _finite(*a, *b) or j - i < g.min_gap:
                return stop("lookup")
            if g.max_factors and made >= g.max_factors:
                return stop("budget")
            if (last_reference is not None and abs(i - last_reference) <= g.reference_near) or (last_time is not None and row["t_cur"] - last_time < g.min_interval):
                return stop("cooldown")
            if row["verified"] is not None:
                if not verified:
                    return stop("scan_geometry")
                scan = _pose(row, "l")
                off = between(scan, measured)
                if not _finite(*off) or math.hypot(off[0], off[1]) > g.max_image_xy or abs(wrap(off[3])) > g.max_image_yaw:
                    return stop("image_disagreement")
                measured = scan
            dz = row["ground_dz"]
            if dz is not None:
                applied = max(-g.max_ground_step, min(g.max_ground_step, dz)) if g.max_ground_step > 0 else dz
                out |= {"z_applied": applied, "z_clipped": abs(applied - dz) > 1e-9}
                measured = (measured[0], measured[1], measured[2] + applied, measured[3])
            off = between(between(a, b), measured)
            if math.hypot(*off[:3]) > g.max_shift or abs(off[3]) > g.max_turn:
                return stop("raw_disagreement")
            if g.support > 1:
                correction = compose(compose(a, measured), invert(b))
                if not support.meets(i, j, g.support_near, g.support_gap):
                    support.restart(i, j, correction)
                    return stop("waiting")
                miss = between(support.correction, correction)
                if math.hypot(miss[0], miss[1]) > g.support_xy or abs(miss[3]) > g.support_yaw or abs(miss[2]) > g.support_z:
                    support.restart(i, j, correction)
                    return stop("support_disagreement")
                support.extend(j, correction)
                if support.count < g.support:
                    return stop("waiting")
            off = between(between(_pose(row, "ga"), _pose(row, "gb")), measured)
            if not _finite(*off) or math.hypot(off[0], off[1]) > g.graph_xy or abs(off[3]) > g.graph_yaw or abs(off[2]) > g.graph_z:
                support = _Support()
                return stop("graph_consistency")
            if (i, j) in pairs:
                return stop("duplicate")
            count = support.count
            quality = max(row["quality"], g.verified_quality) if verified else row["quality"]
            out |= {"reason": "applied", "support": count, "sigma_scale": 1 + g.sigma_growth * (1 - max(0.0, min(1.0, quality)))}
            out |= dict(zip(("fx", "fy", "fz", "fyaw"), measured, strict=True))
            pairs.add((i, j))
            return (_Support(), made + 1, row["t_cur"], i, pairs), [out]

        return (_Support(), 0, None, None, set()), step

    return start


# ---- references of labelled keyframes, and loops found by search ----


@dataclass(frozen=True)
class Reference:
    """Which earlier keyframes may bind a labelled one, and how often."""

    every: int = 1
    max_factors: int = 0
    min_interval: int = 0
    min_gap: int = 2
    max_gap: int = 0
    min_time: int = 2_000_000
    min_baseline: float = 0.5
    radius: float = 30.0
    max_uses: int = 2
    xy_for_z: bool = False
    graph_xy: float = 5.0
    graph_yaw: float = 0.4
    graph_z: float = 1.0


def bind_reference(g: Reference = Reference()) -> Callable:
    """Ordered fold over keyframes, each with candidates, that picks the best reference: plane before height before none, then score, then the earlier one.

    Rows, in order: j, t, candidates (array of structs i, t, baseline, distance, xy_accepted,
    z_accepted, score, reason, off_xy, off_yaw, off_z against the graph, in order of i). Adds i,
    kind ("xy", "z" or null) and reason. Only every so-manieth row is asked; budget, interval and
    uses of a reference are counted over the rows that were bound.
    """

    def start():
        def step(state, row):
            n, made, last, uses = state

            def done(reason, i=None, kind=None, bound=False):
                now = (n + 1, made + bound, row["t"] if bound else last, {**uses, i: uses.get(i, 0) + 1} if bound else uses)
                return now, [{"run": row.get("run"), "j": row["j"], "i": i, "kind": kind, "reason": reason}]

            if g.every > 1 and n % g.every:
                return done("skipped")
            if g.max_factors and made >= g.max_factors:
                return done("budget")
            if last is not None and row["t"] - last < g.min_interval:
                return done("interval")
            best = None
            for c in row["candidates"] or []:
                gap = row["j"] - c["i"]
                if gap < g.min_gap or (g.max_gap and gap > g.max_gap) or row["t"] - c["t"] < g.min_time:
                    continue
                if (g.max_uses and uses.get(c["i"], 0) >= g.max_uses) or not c["baseline"] >= g.min_baseline or not c["distance"] <= g.radius:
                    continue
                xy = bool(c["xy_accepted"])
                rank = 2 if xy else 1 if c["z_accepted"] and not g.xy_for_z else 0
                if best is None or (rank, c["score"]) > best[:2]:
                    best = (rank, c["score"], c)
            if best is None:
                return done("no_reference")
            rank, _, c = best
            if rank == 0:
                return done("xy_first" if c["z_accepted"] and g.xy_for_z else c["reason"] or "geometry", c["i"])
            xy = bool(c["xy_accepted"]) and c["off_xy"] <= g.graph_xy and c["off_yaw"] <= g.graph_yaw
            z = bool(c["z_accepted"]) and c["off_z"] <= g.graph_z and (xy or not g.xy_for_z)
            if not xy and not z:
                return done("graph_consistency", c["i"])
            return done("bound", c["i"], "xy" if xy else "z", True)

        return (0, 0, None, {}), step

    return start


@dataclass(frozen=True)
class Discovery:
    """Limits of loops found by search: how clear the best must be, support over frames, budget, cooldown."""

    min_score_gap: float = 0.1
    min_time: int = 5_000_000
    xy_for_z: bool = True
    support: int = 2
    support_near: int = 3
    support_gap: int = 3
    max_factors: int = 0
    min_interval: int = 4_000_000
    graph_xy: float = 5.0
    graph_yaw: float = 0.4
    graph_z: float = 1.0


def discover(g: Discovery = Discovery()) -> Callable:
    """Ordered fold over keyframes, each with its best and second candidate, that admits loops with support by several frames.

    Rows, in order: j, t, i, t_ref, score, second (null without), xy_accepted, z_accepted, off_xy,
    off_yaw, off_z. Adds support, kind and reason. A best whose relative lead over the second is
    too small is ambiguous; support counts frames that found nearly the same reference; what stops
    a supported loop starts support anew.
    """

    def start():
        def step(state, row):
            support, made, last = state

            def done(reason, kind=None, bound=False, anew=False):
                now = (_Support() if anew else support, made + bound, row["t"] if bound else last)
                return now, [dict(row) | {"support": support.count, "kind": kind, "reason": reason}]

            if row["i"] is None:
                return done("no_candidate")
            if row["second"] is not None and row["score"] - row["second"] < g.min_score_gap * max(abs(row["score"]), 1e-9):
                return done("ambiguous")
            if row["t"] - row["t_ref"] < g.min_time:
                return done("time")
            xy, z = bool(row["xy_accepted"]), bool(row["z_accepted"])
            if z and not xy and g.xy_for_z:
                return done("z_requires_xy")
            if not xy and not z:
                return done("geometry")
            if support.meets(row["i"], row["j"], g.support_near, g.support_gap):
                support.count, support.current = support.count + 1, row["j"]
            else:
                support.restart(row["i"], row["j"], (0.0, 0.0, 0.0, 0.0))
            if support.count < g.support:
                return done("waiting")
            if g.max_factors and made >= g.max_factors:
                return done("budget", anew=True)
            if last is not None and row["t"] - last < g.min_interval:
                return done("cooldown", anew=True)
            xy, z = xy and row["off_xy"] <= g.graph_xy and row["off_yaw"] <= g.graph_yaw, z and row["off_z"] <= g.graph_z
            if not xy and not z:
                return done("graph_consistency", anew=True)
            return done("applied", "xy" if xy else "z", True, True)

        return (_Support(), 0, None), step

    return start


# ---- exports ----


def pair_stages(pairs: DataFrame, residual: str, broad: float, inlier: float, applied: Column) -> DataFrame:
    """Pairs with their stage: outlier beyond broad, candidate beyond inlier, else inlier, and applied where their registration was."""
    r = F.abs(F.col(residual))
    stage = F.when(over(r, broad), "outlier").when(r > inlier, "candidate").when(F.coalesce(applied, F.lit(False)), "applied").otherwise("inlier")
    return pairs.withColumn("stage", stage)
