"""Registration of pairs of keyframes: lattice search, mutual matches, consensus, robust fit, height.

A pair is one task that holds the features of its two keyframes (a few thousand each, as
features are thinned when keyframes are made); pairs run in parallel. All steps work on whole
arrays: nearest features are looked up in sorted cells, hypotheses are scored together.
"""

from __future__ import annotations

import itertools
import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import lie


@dataclass(frozen=True)
class Gates:
    """Search ranges, distances and acceptance limits; lengths in metres, angles in radians."""

    reach: float = 1.5
    semantic: float = 0.5
    coarse_points: int = 400
    lattice_xy: float = 2.0
    lattice_step: float = 1.0
    lattice_yaw: float = math.radians(4)
    lattice_turn: float = math.radians(2)
    least_pairs: int = 8
    hypotheses: int = 400
    apart: float = 2.0
    inlier: float = 0.5
    huber: float = 0.2
    huber_rounds: int = 8
    max_xy: float = 4.0
    max_yaw: float = math.radians(10)
    least_inliers: int = 10
    least_ratio: float = 0.3
    max_rmse: float = 0.4
    least_spread: float = 2.0
    least_spread_ratio: float = 0.05
    z_reach: float = 1.0
    z_broad: float = 1.5
    z_inlier: float = 0.3
    least_z: int = 8
    max_z_mad: float = 0.2
    max_z: float = 1.0
    # What a match's score counts, and the largest rmse that counts.
    per_inlier: float = 2.0
    per_rmse: float = 180.0
    rmse_counted: float = 2.0
    per_z_inlier: float = 0.8
    per_similarity: float = 80.0
    per_coarse: float = 0.05


@dataclass
class Features:
    """Points (n, 3), labels and whether each is structural (else ground)."""

    points: np.ndarray
    labels: np.ndarray
    structural: np.ndarray

    def part(self, mask: np.ndarray) -> Features:
        return Features(self.points[mask], self.labels[mask], self.structural[mask])


class Cells:
    """Planar cells of points: for queries, the nearest point within reach; with labels of the same one only (0 matches any)."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, reach: float, semantic: bool = True):
        self.points, self.labels, self.reach, self.semantic = points[:, :2], labels, reach, semantic
        self.key = self._key(np.floor(self.points / reach).astype(np.int64))
        self.order = np.argsort(self.key, kind="stable")
        self.sorted = self.key[self.order]

    @staticmethod
    def _key(cell: np.ndarray) -> np.ndarray:
        return cell[:, 0] * (1 << 32) + cell[:, 1]

    def nearest(self, points: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index (-1 for none) and distance of the nearest point of each query; ties to the smaller index."""
        best, at = np.full(len(points), np.inf), np.full(len(points), -1)
        if not len(points) or not len(self.points):
            return at, best
        cell = np.floor(points[:, :2] / self.reach).astype(np.int64)
        for dx, dy in itertools.product((-1, 0, 1), repeat=2):
            key = self._key(cell + [dx, dy])
            lo, hi = np.searchsorted(self.sorted, key, "left"), np.searchsorted(self.sorted, key, "right")
            n = hi - lo
            who = np.repeat(np.arange(len(points)), n)
            other = self.order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            d = np.hypot(*(points[who, :2] - self.points[other]).T)
            ok = d <= self.reach
            if self.semantic:
                ok &= (labels[who] == self.labels[other]) | (labels[who] == 0) | (self.labels[other] == 0)
            who, other, d = who[ok], other[ok], d[ok]
            order = np.lexsort((other, d, who))
            first = np.concatenate([[True], who[order][1:] != who[order][:-1]]) if len(order) else np.empty(0, bool)
            who, other, d = who[order][first], other[order][first], d[order][first]
            better = (d < best[who]) | ((d == best[who]) & (other < at[who]))
            best[who[better]], at[who[better]] = d[better], other[better]
        return at, best


def moved(pose: np.ndarray, points: np.ndarray) -> np.ndarray:
    return points @ pose[:3, :3].T + pose[:3, 3]


def mutual(target: Features, source: Features, pose: np.ndarray, reach: float, semantic: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Indices (target, source) of features that are each other's nearest in the plane after the source is moved by pose."""
    there = moved(pose, source.points)
    forth, _ = Cells(target.points, target.labels, reach, semantic).nearest(there, source.labels)
    back, _ = Cells(there, source.labels, reach, semantic).nearest(target.points, target.labels)
    own = np.flatnonzero(forth >= 0)
    own = own[back[forth[own]] == own]
    return forth[own], own


def planar_fit(source: np.ndarray, target: np.ndarray, weights: np.ndarray) -> tuple[float, float, float]:
    """Heading and shift that best take weighted points onto others in the plane, in closed form."""
    w = weights / weights.sum()
    a, b = source[:, :2] - w @ source[:, :2], target[:, :2] - w @ target[:, :2]
    yaw = math.atan2(float(w @ (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0])), float(w @ (a * b).sum(axis=1)))
    c, s = math.cos(yaw), math.sin(yaw)
    shift = w @ target[:, :2] - np.array([[c, -s], [s, c]]) @ (w @ source[:, :2])
    return yaw, float(shift[0]), float(shift[1])


def _in_plane(pose: np.ndarray, yaw: float, x: float, y: float) -> np.ndarray:
    """pose with another heading and place in the plane; its tilt and height stay."""
    out = pose.copy()
    out[:3, :3] = lie.rotation(np.array([0.0, 0.0, yaw - float(lie.yaw_of(pose))])) @ pose[:3, :3]
    out[:2, 3] = x, y
    return out


def corrections(pose: np.ndarray, raw: np.ndarray) -> tuple[float, float]:
    """Planar shift and turn of what takes raw to pose."""
    delta = pose @ lie.inverse(raw)
    return float(np.hypot(*delta[:2, 3])), abs(float(lie.wrap(lie.yaw_of(pose) - lie.yaw_of(raw))))


def hypotheses(n: int, most: int, seed: int) -> np.ndarray:
    """Pairs of different numbers under n: all, if there are no more than most, else most seeded ones."""
    if n * (n - 1) // 2 <= most:
        return np.array(list(itertools.combinations(range(n), 2)), np.int64).reshape(-1, 2)
    draw = np.random.default_rng(seed).integers(0, n, (2 * most, 2))
    return draw[draw[:, 0] != draw[:, 1]][:most]


def consensus(target: np.ndarray, source: np.ndarray, raw: np.ndarray, gates: Gates, seed: int, weights: np.ndarray | None = None) -> tuple[np.ndarray | None, np.ndarray]:
    """The motion from two pairs that most pairs follow, and which do; None if no hypothesis is within the caps.

    Inliers count 1, or their weight; of equal scores the one of the least squared misses wins.
    A hypothesis whose two points lie close together, or that corrects raw beyond the caps, is out.
    """
    weights = np.ones(len(source)) if weights is None else weights
    pick = hypotheses(len(source), gates.hypotheses, seed)
    # the raw motion may tilt the points a little; its heading and place are taken off
    base = (moved(raw, source)[:, :2] - raw[:2, 3]) @ _turn(-float(lie.yaw_of(raw))).T
    a, b = base[pick[:, 1]] - base[pick[:, 0]], target[pick[:, 1], :2] - target[pick[:, 0], :2]
    far = (np.hypot(*a.T) >= gates.apart) & (np.hypot(*b.T) >= gates.apart)
    pick, a, b = pick[far], a[far], b[far]
    yaw = np.arctan2(a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0], (a * b).sum(axis=1))
    c, s = np.cos(yaw), np.sin(yaw)
    turned = np.stack([c[:, None] * base[:, 0] - s[:, None] * base[:, 1], s[:, None] * base[:, 0] + c[:, None] * base[:, 1]], axis=2)
    shift = target[pick[:, 0], :2] - turned[np.arange(len(pick)), pick[:, 0]]
    miss = np.hypot(*np.moveaxis(turned + shift[:, None] - target[None, :, :2], 2, 0))
    inside = miss <= gates.inlier
    score = np.where(inside, weights, 0.0).sum(axis=1)
    error = np.where(inside, miss**2, 0.0).sum(axis=1)
    best = None
    for k in np.lexsort((error, -score)):
        pose = _in_plane(raw, float(yaw[k]), *shift[k])
        xy, turn = corrections(pose, raw)
        if xy <= gates.max_xy and turn <= gates.max_yaw:
            best = k
            break
    if best is None:
        return None, np.zeros(len(source), bool)
    return pose, inside[best]


def _turn(a: float) -> np.ndarray:
    return np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])


def robust_fit(target: np.ndarray, source: np.ndarray, start: np.ndarray, raw: np.ndarray, gates: Gates) -> np.ndarray:
    """Planar motion by reweighted fits over pairs within reach, until it moves no more or leaves the caps."""
    pose = start
    for _ in range(gates.huber_rounds):
        there = moved(pose, source)
        miss = np.hypot(*(there - target)[:, :2].T)
        weights = np.where(miss <= gates.reach, np.minimum(1.0, gates.huber / np.maximum(miss, 1e-12)), 0.0)
        if np.count_nonzero(weights) < 2:
            break
        yaw, x, y = planar_fit(there, target, weights)
        place = _turn(yaw) @ pose[:2, 3] + [x, y]
        new = _in_plane(pose, float(lie.yaw_of(pose)) + yaw, *place)
        xy, turn = corrections(new, raw)
        if xy > gates.max_xy or turn > gates.max_yaw:
            break
        step = float(np.hypot(*(new - pose)[:2, 3])), abs(float(lie.wrap(lie.yaw_of(new) - lie.yaw_of(pose))))
        pose = new
        if step[0] < 1e-3 and step[1] < 1e-4:
            break
    return pose


def steps(reach: float, step: float) -> np.ndarray:
    """-reach ... reach by step."""
    return -reach + step * np.arange(int(math.floor(2 * reach / step + 1e-9)) + 1)


def alignment_score(cells: Cells, target: Features, source: Features, pose: np.ndarray, gates: Gates) -> float:
    """Sum over source features of how near their nearest target is (1 at it, 0 at reach), more for equal labels."""
    at, d = cells.nearest(moved(pose, source.points), source.labels)
    hit = at >= 0
    same = (source.labels[hit] != 0) & (target.labels[at[hit]] == source.labels[hit])
    return float(((1 - d[hit] / gates.reach) * (1 + gates.semantic * same)).sum())


def align(target: Features, source: Features, raw: np.ndarray, gates: Gates) -> tuple[np.ndarray, float]:
    """The best motion of a lattice of shifts and turns of raw, then of a finer one around it; raw wins ties.

    Structural features only, every so-manieth of them if there are more than coarse_points.
    """
    target, source = target.part(target.structural), source.part(source.structural)
    every = max(1, len(source.points) // gates.coarse_points)
    source = source.part(np.arange(len(source.points)) % every == 0)
    cells = Cells(target.points, target.labels, gates.reach)
    best, score = raw, alignment_score(cells, target, source, raw, gates)
    fine = (gates.lattice_step, max(0.15, gates.lattice_step / 3)), (gates.lattice_turn, max(math.radians(0.25), gates.lattice_turn / 3))
    for (xy, step), (yaw, turn) in (((gates.lattice_xy, gates.lattice_step), (gates.lattice_yaw, gates.lattice_turn)), fine):
        center = best
        for a, x, y in itertools.product(steps(yaw, turn), steps(xy, step), steps(xy, step)):
            pose = lie.planar(x, y, a) @ center
            new = alignment_score(cells, target, source, pose, gates)
            if new > score:
                best, score = pose, new
    return best, score


def spread(points: np.ndarray) -> tuple[float, float]:
    """Size of planar points about their mean, and the ratio of their short to their long side."""
    if len(points) < 2:
        return 0.0, 0.0
    low, high = np.linalg.eigvalsh(np.cov(points[:, :2].T, bias=True))
    low, high = max(0.0, float(low)), max(1e-9, float(high))
    return math.sqrt(low + high), math.sqrt(low / high)


def height(target: Features, source: Features, pose: np.ndarray, gates: Gates) -> dict:
    """Height that the source misses, from mutual matches of ground: median of those near the median of all, its spread, and whether it holds."""
    target, source = target.part(~target.structural), source.part(~source.structural)
    t, s = mutual(target, source, pose, gates.z_reach)
    miss = target.points[t, 2] - moved(pose, source.points[s])[:, 2]
    broad = np.abs(miss) <= gates.z_broad
    out = {"z_pairs": len(miss), "z_broad": int(broad.sum()), "z_inliers": 0, "z_median": 0.0, "z_mad": math.inf, "z_spread": 0.0, "z_spread_ratio": 0.0, "z_accepted": False}
    if not broad.any():
        return out
    center = float(np.median(miss[broad]))
    inside = broad & (np.abs(miss - center) <= gates.z_inlier)
    middle = float(np.median(miss[inside])) if inside.any() else center
    mad = float(np.median(np.abs(miss[inside] - middle))) if inside.any() else math.inf
    size, ratio = spread(moved(pose, source.points[s[inside]]))
    ok = int(inside.sum()) >= gates.least_z and abs(middle) <= gates.max_z and mad <= gates.max_z_mad
    return out | {"z_inliers": int(inside.sum()), "z_median": middle, "z_mad": mad, "z_spread": size, "z_spread_ratio": ratio, "z_accepted": ok}


def match(target: Features, source: Features, raw: np.ndarray, gates: Gates, seed: int, similarity: float = 0.0) -> dict:
    """One keyframe registered on another, from raw: search, consensus, robust fit, planar gates, height, score and reason."""
    pose, coarse = align(target, source, raw, gates)
    flat_t, flat_s = target.part(target.structural), source.part(source.structural)
    t, s = mutual(flat_t, flat_s, pose, gates.reach)
    candidates = len(t)
    if candidates >= gates.least_pairs:
        found, _ = consensus(flat_t.points[t], flat_s.points[s], raw, gates, seed)
        pose = robust_fit(flat_t.points[t], flat_s.points[s], pose if found is None else found, raw, gates)
    t, s = mutual(flat_t, flat_s, pose, gates.reach)
    there = moved(pose, flat_s.points[s])
    miss = np.hypot(*(there - flat_t.points[t])[:, :2].T)
    inside = miss <= gates.inlier
    inliers = int(inside.sum())
    ratio = inliers / len(miss) if len(miss) else 0.0
    rmse = float(np.sqrt((miss[inside] ** 2).mean())) if inliers else math.inf
    size, shape = spread(there[inside])
    xy, turn = corrections(pose, raw)
    accepted = inliers >= gates.least_inliers and ratio >= gates.least_ratio and rmse <= gates.max_rmse and size >= gates.least_spread and shape >= gates.least_spread_ratio and xy <= gates.max_xy and turn <= gates.max_yaw
    z = height(target, source, pose, gates)
    if z["z_accepted"]:
        pose = pose.copy()
        pose[2, 3] += z["z_median"]
    reason = (
        "accepted" if accepted or z["z_accepted"]
        else "few_candidates" if candidates < gates.least_pairs
        else "few_inliers" if inliers < gates.least_inliers
        else "rmse" if rmse > gates.max_rmse
        else "geometry"
    )
    score = gates.per_inlier * inliers - gates.per_rmse * min(gates.rmse_counted, rmse) + gates.per_z_inlier * z["z_inliers"] + gates.per_similarity * similarity + gates.per_coarse * coarse
    return {"yaw": float(lie.yaw_of(pose)), "x": float(pose[0, 3]), "y": float(pose[1, 3]), "z": float(pose[2, 3]), "candidates": candidates, "inliers": inliers, "ratio": ratio, "rmse": rmse, "spread": size, "spread_ratio": shape, "xy_accepted": bool(accepted), **z, "score": score, "reason": reason}


def rounds_match(target: Features, source: Features, raw: np.ndarray, gates: Gates, rounds: int = 5, max_step: float = 0.6, max_turn: float = math.radians(2), building: int = 3, least_buildings: int = 5) -> dict:
    """Registration in four degrees of freedom: linearised rounds with capped steps, then height by medians, then gates on counts, buildings, spread and corrections."""
    flat_t, flat_s = target.part(target.structural), source.part(source.structural)
    cells, pose, structured = Cells(flat_t.points, flat_t.labels, gates.reach), raw, True
    for _ in range(rounds):
        there = moved(pose, flat_s.points)
        at, _ = cells.nearest(there, flat_s.labels)
        a, b = there[at >= 0, :2], flat_t.points[at[at >= 0], :2]
        if len(a) < max(3, least_buildings):
            structured = False
            break
        d = a - a.mean(axis=0)
        if math.sqrt(float((d**2).sum(axis=1).mean())) < gates.least_spread:
            structured = False
            break
        # shift of the middle, and turn about it
        turn = float((d[:, 0] * (b - a)[:, 1] - d[:, 1] * (b - a)[:, 0]).sum() / max(1e-9, float((d**2).sum())))
        shift = (b - a).mean(axis=0)
        shift *= min(1.0, max_step / max(1e-12, float(np.hypot(*shift))))
        pose = _in_plane(pose, float(lie.yaw_of(pose)) + max(-max_turn, min(max_turn, turn)), *(pose[:2, 3] + shift))
    there = moved(pose, flat_s.points)
    at, d = cells.nearest(there, flat_s.labels)
    hit = at >= 0
    rmse = float(np.sqrt((d[hit] ** 2).mean())) if hit.any() else math.inf
    size, shape = spread(there[hit])
    buildings = int((flat_s.labels[hit] == building).sum())
    ground_t, ground_s = target.part(~target.structural), source.part(~source.structural)
    ground = Cells(ground_t.points, ground_t.labels, gates.z_reach)

    def misses() -> np.ndarray:
        here = moved(pose, ground_s.points)
        k, _ = ground.nearest(here, ground_s.labels)
        r = ground_t.points[k[k >= 0], 2] - here[k >= 0, 2]
        return r[np.abs(r) <= gates.z_broad]

    z = misses()
    if len(z):
        pose = pose.copy()
        pose[2, 3] += max(-0.2, min(0.2, float(np.median(z))))
        z = misses()
    middle = float(np.median(z)) if len(z) else 0.0
    mad = float(np.median(np.abs(z - middle))) if len(z) else math.inf
    xy, turned = corrections(pose, raw)
    ok = structured and int(hit.sum()) >= gates.least_inliers and buildings >= least_buildings and rmse <= gates.max_rmse and size >= gates.least_spread and shape >= gates.least_spread_ratio and xy <= gates.max_xy and turned <= gates.max_yaw
    z_ok = len(z) >= gates.least_z and abs(middle) <= gates.max_z and mad <= gates.max_z_mad and xy <= gates.max_xy
    score = max(float(hit.sum()) / (1 + rmse) + 2.0 * buildings + 100 * shape if ok else 0.0, len(z) / (1 + mad) if z_ok else 0.0)
    return {"yaw": float(lie.yaw_of(pose)), "x": float(pose[0, 3]), "y": float(pose[1, 3]), "z": float(pose[2, 3]), "inliers": int(hit.sum()), "buildings": buildings, "ground": len(z), "rmse": rmse, "spread": size, "spread_ratio": shape, "z_median": middle, "z_mad": mad, "xy_accepted": bool(ok), "z_accepted": bool(z_ok), "score": score}


def regrid_search(target: Features, source: Features, raw: np.ndarray, gates: Gates, size: float = 1.0, least: int = 10) -> dict:
    """Lattice search in which the source is put into cells anew for every candidate: labelled cells that meet the target's, by number over error, ground besides."""
    t = _label_cells(target, np.eye(4), size)
    cells = Cells(t.points, t.labels, gates.reach)
    best: dict = {}
    for a, x, y in sorted(itertools.product(steps(gates.lattice_yaw, gates.lattice_turn), steps(gates.lattice_xy, gates.lattice_step), steps(gates.lattice_xy, gates.lattice_step)), key=lambda c: any(abs(v) > 1e-9 for v in c)):
        pose = _in_plane(raw, float(lie.yaw_of(raw)) + a, raw[0, 3] + x, raw[1, 3] + y)
        s = _label_cells(source, pose, size)
        at, d = cells.nearest(s.points, s.labels)
        hit = at >= 0
        inliers, ground = int(hit.sum()), int((hit & ~s.structural).sum())
        rms = float(np.sqrt((d[hit] ** 2).mean())) if inliers else math.inf
        score = inliers / (1 + rms) + 0.25 * ground if inliers else 0.0
        if not best or (inliers >= least and score > best["score"]):
            best = {"x": float(pose[0, 3]), "y": float(pose[1, 3]), "z": float(pose[2, 3]), "yaw": float(lie.yaw_of(pose)), "inliers": inliers, "ground": ground, "rms": rms, "score": score if inliers >= least else -math.inf}
    return best


def _label_cells(f: Features, pose: np.ndarray, size: float) -> Features:
    """The means of a moved keyframe's points by cell and label."""
    points = moved(pose, f.points)
    key = np.concatenate([np.floor(points[:, :2] / size).astype(np.int64), f.labels[:, None], f.structural[:, None]], axis=1)
    kinds, place, n = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    sums = np.zeros((len(kinds), 3))
    np.add.at(sums, place.ravel(), points)
    return Features(sums / np.maximum(n, 1)[:, None], kinds[:, 2], kinds[:, 3].astype(bool))


# ---- pairs of keyframes as rows ----


def _features(pdf: pd.DataFrame) -> Features:
    pdf = pdf.sort_values("id")
    return Features(pdf[["x", "y", "z"]].to_numpy(float).reshape(-1, 3), pdf["label"].to_numpy(np.int64), pdf["structural"].to_numpy(bool))


METHODS = {
    "match": (match, "yaw double, x double, y double, z double, candidates int, inliers int, ratio double, rmse double, spread double, spread_ratio double, xy_accepted boolean, z_pairs int, z_broad int, z_inliers int, z_median double, z_mad double, z_spread double, z_spread_ratio double, z_accepted boolean, score double, reason string"),
    "rounds": (lambda t, s, raw, gates, seed: rounds_match(t, s, raw, gates), "yaw double, x double, y double, z double, inliers int, buildings int, ground int, rmse double, spread double, spread_ratio double, z_median double, z_mad double, xy_accepted boolean, z_accepted boolean, score double"),
    "align": (lambda t, s, raw, gates, seed: _placed(*align(t, s, raw, gates)), "yaw double, x double, y double, score double"),
    "regrid": (lambda t, s, raw, gates, seed: regrid_search(t, s, raw, gates), "yaw double, x double, y double, z double, inliers int, ground int, rms double, score double"),
    "consensus": (lambda t, s, raw, gates, seed: _consented(t, s, raw, gates, seed), "yaw double, x double, y double, inliers int, n int"),
}


def _placed(pose: np.ndarray, score: float) -> dict:
    return {"yaw": float(lie.yaw_of(pose)), "x": float(pose[0, 3]), "y": float(pose[1, 3]), "score": score}


def _consented(target: Features, source: Features, raw: np.ndarray, gates: Gates, seed: int) -> dict:
    """Consensus and robust fit over the mutual matches at raw."""
    t, s = mutual(target, source, raw, gates.reach)
    pose, inside = consensus(target.points[t], source.points[s], raw, gates, seed)
    pose = robust_fit(target.points[t], source.points[s], raw if pose is None else pose, raw, gates)
    return {k: v for k, v in _placed(pose, 0.0).items() if k != "score"} | {"inliers": int(inside.sum()), "n": len(t)}


def register_pairs(features: DataFrame, pairs: DataFrame, method: str = "match", gates: Gates = Gates()) -> DataFrame:
    """Pairs (a, b, x, y, z, yaw: frame b seen from frame a) with the result of a method of METHODS.

    features are (frame, id, x, y, z, label, structural). Each pair is a task of its own that gets
    both frames' features, so a frame that many pairs share is sent to each; seeds depend on the
    pair alone. Pairs of unknown or empty frames give the result of no features; null labels and
    structural flags are taken as 0 and false.
    """
    f, schema = METHODS[method]
    ready = features.select("frame", "id", "x", "y", "z", F.coalesce(F.col("label").cast("long"), F.lit(0)).alias("label"), F.coalesce("structural", F.lit(False)).alias("structural"))
    raw = pairs.select("a", "b", *[F.col(c).alias(f"raw_{c}") for c in ("x", "y", "z", "yaw")]).dropDuplicates(["a", "b"])
    sides = [raw.join(ready.withColumnRenamed("frame", end), end, "left").withColumn("side", F.lit(k)) for k, end in enumerate("ab")]
    rows = sides[0].unionByName(sides[1])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        pdf = pdf[pdf["id"].notna()]
        both = [_features(pdf[pdf["side"] == k]) for k in (0, 1)]
        start = lie.planar(first["raw_x"], first["raw_y"], first["raw_yaw"], first["raw_z"])
        return pd.DataFrame([{"a": first["a"], "b": first["b"], **f(*both, start, gates, zlib.crc32(f"{first['a']} {first['b']}".encode()))}])

    kinds = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in "ab")
    return rows.groupBy("a", "b").applyInPandas(run, f"{kinds}, {schema}")


def weighted_consensus(samples: DataFrame, keys: list[str], order: str, gates: Gates) -> DataFrame:
    """Samples (keys, sx, sy -> tx, ty, w) with whether each is an inlier of its key's best-weighted motion, and that motion's yaw, x, y (null without one).

    Hypotheses are pairs of samples in the order of a column, all of them while they are few, else
    seeded by the number of samples; a score is the inliers' weight. One key is one task.
    """
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in [*keys, order])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        source, target = (np.concatenate([pdf[[f"{p}x", f"{p}y"]].to_numpy(float), np.zeros((len(pdf), 1))], axis=1) for p in "st")
        pose, inside = consensus(target, source, np.eye(4), gates, len(pdf), pdf["w"].to_numpy(float)) if len(pdf) > 1 else (None, np.zeros(len(pdf), bool))
        out = pdf[[*keys, order]].assign(inlier=inside)
        return out.assign(**({"yaw": np.nan, "x": np.nan, "y": np.nan} if pose is None else {"yaw": float(lie.yaw_of(pose)), "x": pose[0, 3], "y": pose[1, 3]}))

    return samples.select(*keys, order, "sx", "sy", "tx", "ty", "w").groupBy(*keys).applyInPandas(run, f"{kinds}, inlier boolean, yaw double, x double, y double")


def with_gates(**changes: float) -> Gates:
    """The default gates with some changed."""
    return replace(Gates(), **changes)
