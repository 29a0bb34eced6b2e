"""A map of image landmarks kept along a run: frames are prepared, landmarks projected, compared, committed, culled and seeded.

One stateful pass in the order of time. The state holds at most max_landmarks landmarks, all
within a radius of the camera, each with a small normalised patch; it doesn't grow with the run,
and the same step serves batches and streams. Pixels and points of a frame are columns of its
row: an image has a fixed size, points come as one a voxel.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import lie


@dataclass(frozen=True)
class Landmarks:
    """Image and camera (pixels; the body's axes are rotated to the camera's), bounds of the map, gates of seeds and matches."""

    width: int = 800
    height: int = 600
    fx: float = 500.0
    fy: float = 500.0
    cx: float = 400.0
    cy: float = 300.0
    rotation: tuple = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    lever: tuple = (0.0, 0.0, 0.0)
    half: int = 3
    grid: int = 24
    max_landmarks: int = 1400
    max_active: int = 450
    max_candidates: int = 9000
    max_new: int = 180
    max_missed: int = 20
    refresh: int = 8
    min_depth: float = 1.0
    max_depth: float = 80.0
    min_gradient: float = 12.0
    min_deviation: float = 6.0
    min_ncc: float = 0.72
    voxel: float = 0.2
    radius: float = 65.0
    #: What labels 0 to 6 weigh; others weigh as label 0.
    weights: tuple = (1.0, 1.3, 1.5, 0.9, 0.75, 0.0, 0.6)


@dataclass
class Map:
    """Landmarks as columns of equal length, in the order of their ids."""

    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    points: np.ndarray = field(default_factory=lambda: np.empty((0, 3)))
    patches: np.ndarray | None = None
    labels: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    observations: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    seen: np.ndarray = field(default_factory=lambda: np.empty(0))
    missed: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    next_id: int = 0

    def keep(self, rows: np.ndarray) -> None:
        for c in ("ids", "points", "patches", "labels", "weights", "observations", "seen", "missed"):
            setattr(self, c, getattr(self, c)[rows])


class Frame:
    """A prepared frame: brightness, its smoothed differences along both axes, labels, mask. Pixels that are not there are NaN, unlabelled and unmasked."""

    def __init__(self, row: dict, how: Landmarks):
        shape, size = (how.height, how.width), how.height * how.width
        at = np.array([] if row["at"] is None else row["at"], np.int64)
        self.gray, self.labels, self.masked = np.full(size, math.nan), np.zeros(size, np.int64), np.zeros(size, bool)
        self.gray[at] = np.array(row["values"] if len(at) else [], float)
        self.labels[at] = row["labels"] if len(at) else []
        self.masked[at] = row["masked"] if len(at) else []
        self.gray, self.labels, self.masked = self.gray.reshape(shape), self.labels.reshape(shape), self.masked.reshape(shape)
        p = np.pad(self.gray, 1, mode="reflect")
        across, down = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
        self.gx = (across[:-2] + 2 * across[1:-1] + across[2:]) / 8
        self.gy = (down[:, :-2] + 2 * down[:, 1:-1] + down[:, 2:]) / 8
        self.valid, self.how = len(at) > 0, how

    def sampled(self, image: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Between the four pixels around; NaN outside."""
        left, top = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
        inside = (left >= 0) & (top >= 0) & (left + 1 < self.how.width) & (top + 1 < self.how.height)
        x, y = np.where(inside, left, 0), np.where(inside, top, 0)
        a, b = u - left, v - top
        upper = (1 - a) * image[y, x] + a * image[y, x + 1]
        lower = (1 - a) * image[y + 1, x] + a * image[y + 1, x + 1]
        return np.where(inside, (1 - b) * upper + b * lower, math.nan)

    def pixel(self, image: np.ndarray, uv: np.ndarray) -> np.ndarray:
        """The nearest pixels' values, 0 outside; halves go away from zero."""
        u, v = (np.trunc(uv + np.copysign(0.5, uv))).astype(np.int64).T
        inside = (u >= 0) & (v >= 0) & (u < self.how.width) & (v < self.how.height)
        return np.where(inside, image[np.where(inside, v, 0), np.where(inside, u, 0)], 0)

    def bordered(self, uv: np.ndarray) -> np.ndarray:
        b = self.how.half + 2
        return (uv >= b).all(axis=1) & (uv[:, 0] < self.how.width - b) & (uv[:, 1] < self.how.height - b)

    def patches(self, uv: np.ndarray) -> np.ndarray:
        """Normalised patches (n, pixels); NaN where a pixel isn't there or the patch is flat."""
        reach = np.arange(-self.how.half, self.how.half + 1)
        du, dv = np.meshgrid(reach, reach)
        raw = self.sampled(self.gray, uv[:, :1] + du.ravel(), uv[:, 1:] + dv.ravel())
        raw = np.where(self.bordered(uv)[:, None], raw, math.nan)
        deviation = raw.std(axis=1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(deviation >= self.how.min_deviation, (raw - raw.mean(axis=1, keepdims=True)) / deviation, math.nan)


def project(points: np.ndarray, rotation: np.ndarray, place: np.ndarray, how: Landmarks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pixels (n, 2), depths, and which points lie between the least and largest depth."""
    camera = ((points - place) @ rotation - np.array(how.lever)) @ np.array(how.rotation).T
    depth = camera[:, 2]
    ok = np.isfinite(camera).all(axis=1) & (depth >= how.min_depth) & (depth <= how.max_depth)
    z = np.where(ok, depth, 1.0)
    uv = np.c_[how.fx * camera[:, 0] / z + how.cx, how.fy * camera[:, 1] / z + how.cy]
    return np.where(ok[:, None], np.clip(uv, -1e9, 1e9), -1e9), depth, ok


def _weight(labels: np.ndarray, how: Landmarks) -> np.ndarray:
    table = np.array(how.weights)
    return table[np.where((labels >= 0) & (labels < len(table)), labels, 0)]


def _cells(uv: np.ndarray, how: Landmarks) -> np.ndarray:
    """Numbers of image cells, row by row; those outside the image are numbered on in the same way."""
    x, y = np.trunc(uv / how.grid).astype(np.int64).T
    return y * max(1, how.width // how.grid) + x


def _voxels(points: np.ndarray, how: Landmarks) -> list[tuple]:
    return [tuple(v) for v in np.floor(points / how.voxel).astype(np.int64).tolist()]


def compare(map_: Map, frame: Frame, rotation: np.ndarray, place: np.ndarray, how: Landmarks) -> tuple[np.ndarray, int, int, float]:
    """Rows of the landmarks that a frame confirms, how many were compared, how many are hidden by mask or label, and the mean correlation.

    Of the landmarks in one cell of the image the nearest is compared; of too many, the heaviest
    and most observed, ties to the smaller id.
    """
    if not len(map_.ids):
        return np.empty(0, np.int64), 0, 0, math.nan
    uv, depth, ok = project(map_.points, rotation, place, how)
    ok &= frame.bordered(uv)
    hidden = ok & (frame.pixel(frame.masked, uv).astype(bool) | (_weight(frame.pixel(frame.labels, uv), how) <= 0) | (map_.weights <= 0))
    rows = np.flatnonzero(ok & ~hidden)
    cell = _cells(uv[rows], how)
    nearest = rows[np.lexsort((map_.ids[rows], depth[rows], cell))]
    nearest = nearest[np.unique(np.sort(cell), return_index=True)[1]] if len(rows) else nearest
    score = map_.weights[nearest] * (1.0 + np.minimum(10, map_.observations[nearest]))
    active = nearest[np.lexsort((map_.ids[nearest], -score))][: how.max_active]
    ncc = np.einsum("ij,ij->i", frame.patches(uv[active]), map_.patches[active]) / (2 * how.half + 1) ** 2 if len(active) else np.empty(0)
    good = np.isfinite(ncc) & (np.nan_to_num(ncc) >= how.min_ncc)
    return active[good], len(active), int(hidden.sum()), float(ncc[good].mean()) if good.any() else math.nan


def commit(map_: Map, frame: Frame, rotation: np.ndarray, place: np.ndarray, t: float, confirmed: np.ndarray, accepted: bool, how: Landmarks) -> int:
    """Confirmed landmarks gain an observation and the frame's label, hidden ones lose all weight, others miss; then the map is culled. Returns how many went."""
    if not len(map_.ids):
        return 0
    uv, _, ok = project(map_.points, rotation, place, how)
    label = frame.pixel(frame.labels, uv)
    hidden = ok & (frame.pixel(frame.masked, uv).astype(bool) | (_weight(label, how) <= 0))
    hit = np.zeros(len(map_.ids), bool)
    hit[confirmed] = True
    hit &= ok & ~hidden
    map_.missed = np.where(hidden, how.max_missed + 1, np.where(hit, 0, map_.missed + 1))
    map_.weights = np.where(hidden, 0.0, map_.weights)
    map_.observations = map_.observations + hit
    map_.seen = np.where(hit, t, map_.seen)
    named = hit & (label != 0)
    map_.labels = np.where(named, label, map_.labels)
    map_.weights = np.where(named, _weight(label, how), map_.weights)
    due = np.flatnonzero(hit & (map_.observations % how.refresh == 0)) if accepted else np.empty(0, np.int64)
    if len(due):
        new = frame.patches(uv[due])
        whole = np.isfinite(new).all(axis=1)
        map_.patches[due[whole]] = new[whole]
    before = len(map_.ids)
    map_.keep(np.flatnonzero((map_.missed <= how.max_missed) & (np.linalg.norm(map_.points - place, axis=1) <= how.radius)))
    if len(map_.ids) > how.max_landmarks:
        map_.keep(np.sort(np.lexsort((map_.ids, -map_.seen, -map_.observations))[: how.max_landmarks]))
    return before - len(map_.ids)


def seed(map_: Map, frame: Frame, rotation: np.ndarray, place: np.ndarray, t: float, points: list, how: Landmarks) -> int:
    """New landmarks where the image has texture and neither its cell nor the voxel holds one; the best scores first, ties in the points' order. Returns how many came."""
    given = [p for p in points if p is not None and None not in (p["x"], p["y"], p["z"])]
    given = given[:: max(1, len(given) // how.max_candidates)][: how.max_candidates]
    world = np.array([[p["x"], p["y"], p["z"]] for p in given], float).reshape(-1, 3)
    finite = np.isfinite(world).all(axis=1)
    given, world = [p for p, f in zip(given, finite, strict=True) if f], world[finite]
    if len(given):  # one a voxel, the first
        first = np.sort(np.unique(np.floor(world / how.voxel), axis=0, return_index=True)[1])
        given, world = [given[k] for k in first], world[first]
    if not len(given) or len(map_.ids) >= how.max_landmarks:
        return 0
    weight = np.array([min(2.0, max(0.0, p["weight"])) if p["weight"] is not None and math.isfinite(p["weight"]) else 1.0 for p in given])
    uv, depth, ok = project(world, rotation, place, how)
    label = frame.pixel(frame.labels, uv)
    image_weight = _weight(label, how)
    with np.errstate(invalid="ignore"):
        gradient = np.hypot(frame.sampled(frame.gx, *uv.T), frame.sampled(frame.gy, *uv.T))
        ok &= (weight > 0) & (image_weight > 0) & ~frame.pixel(frame.masked, uv).astype(bool) & frame.bordered(uv) & (gradient >= how.min_gradient)
    score = np.where(ok, np.nan_to_num(gradient) * weight * image_weight / np.sqrt(np.maximum(1.0, depth)), 0.0)
    there, _, visible = project(map_.points, rotation, place, how)
    cells, voxels = set(_cells(there[visible], how).tolist()), set(_voxels(map_.points, how))
    cell, voxel, taken = _cells(uv, how).tolist(), _voxels(world, how), []
    patches = frame.patches(uv)
    whole = np.isfinite(patches).all(axis=1)
    held = set(voxels)
    for k in np.lexsort((np.arange(len(given)), -score)):
        if not ok[k] or voxel[k] in held or cell[k] in cells:
            continue
        if len(taken) >= how.max_new or len(map_.ids) + len(taken) >= how.max_landmarks:
            break
        cells.add(cell[k])
        if voxel[k] in voxels:
            continue
        voxels.add(voxel[k])
        if whole[k]:
            taken.append(int(k))
    if taken:
        n = len(taken)
        labels = np.array([label[k] if label[k] != 0 else (given[k]["label"] or 0) for k in taken], np.int64)
        add = {"ids": map_.next_id + np.arange(n), "points": world[taken], "patches": patches[taken], "labels": labels, "weights": weight[taken] * _weight(labels, how), "observations": np.ones(n, np.int64), "seen": np.full(n, t), "missed": np.zeros(n, np.int64)}
        for c, new in add.items():
            old = getattr(map_, c)
            setattr(map_, c, new if old is None else np.concatenate([old, new]))
        map_.next_id += n
    return len(taken)


#: Types of what keep_map() adds to a frame's own columns, and of the landmarks at a run's end.
FRAME_OUTPUT = "reason string, landmarks int, compared int, confirmed int, hidden int, seeded int, culled int, ncc double"
LANDMARK_OUTPUT = "landmark long, x double, y double, z double, label int, weight double, observations long, missed long"
_INPUTS = {"q", "p", "accepted", "at", "values", "labels", "masked", "points"}


def keep_map(time: str, how: Landmarks, keys: list[str] | None = None) -> Callable:
    """Step over frames (time, q, p, accepted, at, values, labels, masked, points) in order, as frame_rows() makes them.

    Gives a row a frame (FRAME_OUTPUT); with keys, nothing a frame and the landmarks of each run's
    end instead (LANDMARK_OUTPUT). A frame without pixels, or whose pose has a null or isn't finite
    leaves the map as it is; a null accepted is none. Points without a weight weigh 1, without a
    label are unlabelled; those with a null or infinite place are no candidates.
    """

    def start():
        own: dict = {}

        def step(map_: Map, row: dict):
            more = {"reason": "invalid_frame", "compared": 0, "confirmed": 0, "hidden": 0, "seeded": 0, "culled": 0, "ncc": None}
            pose = [] if row["q"] is None or row["p"] is None else [*row["q"], *row["p"]]
            frame = Frame(row, how)
            if keys:
                own.update({k: row[k] for k in keys})
            if frame.valid and len(pose) == 7 and all(x is not None and math.isfinite(x) for x in pose) and any(pose[:4]):
                rotation, place, t = lie.from_quaternion(np.array(pose[:4])), np.array(pose[4:]), float(row[time])
                more["reason"] = "compared" if len(map_.ids) else "map_empty"
                confirmed, more["compared"], more["hidden"], ncc = compare(map_, frame, rotation, place, how)
                more |= {"confirmed": len(confirmed), "ncc": None if math.isnan(ncc) else ncc}
                more["culled"] = commit(map_, frame, rotation, place, t, confirmed, bool(row["accepted"]), how)
                more["seeded"] = seed(map_, frame, rotation, place, t, [] if row["points"] is None else list(row["points"]), how)
            return map_, [] if keys else [{k: v for k, v in row.items() if k not in _INPUTS} | more | {"landmarks": len(map_.ids)}]

        def end(map_: Map) -> list[dict]:
            rows = zip(map_.ids.tolist(), map_.points.tolist(), map_.labels.tolist(), map_.weights.tolist(), map_.observations.tolist(), map_.missed.tolist(), strict=True)
            return [{**own, "landmark": i, "x": p[0], "y": p[1], "z": p[2], "label": n, "weight": w, "observations": o, "missed": m} for i, p, n, w, o, m in rows]

        return (Map(), step, end) if keys else (Map(), step)

    return start


def frame_rows(frames: DataFrame, pixels: DataFrame, points: DataFrame, keys: list[str], how: Landmarks, order: str = "id") -> DataFrame:
    """Rows for keep_map(): frames with their pixels (keys, u, v, value, label, masked) and points of the world (keys, order, x, y, z, label, weight).

    Pixels outside the image or without a value are left out, of repeated ones the brightest
    counts; a voxel's first point stands for it. So a row is bounded by the image and by the
    voxels in a frame's reach, whatever the density. Frames without pixels or points have nulls.
    """
    inside = pixels.filter((F.col("u") >= 0) & (F.col("u") < how.width) & (F.col("v") >= 0) & (F.col("v") < how.height) & F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    one = inside.groupBy(*keys, (F.col("v") * how.width + F.col("u")).cast("int").alias("_at")).agg(F.max(F.struct(F.col("value").cast("float").alias("value"), F.coalesce(F.col("label"), F.lit(0)).cast("int").alias("label"), F.coalesce(F.col("masked"), F.lit(False)).alias("masked"))).alias("_p"))
    image = one.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_at", "_p"))).alias("_i"))  # as many as pixels
    parts = {"at": lambda i: i["_at"], "values": lambda i: i["_p"]["value"], "labels": lambda i: i["_p"]["label"], "masked": lambda i: i["_p"]["masked"]}
    image = image.select(*keys, *[F.transform("_i", f).alias(c) for c, f in parts.items()])
    cell = {f"_{c}": F.floor(F.col(c) / how.voxel).cast("long") for c in "xyz"}
    near = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull()).withColumns(cell)
    first = F.min(F.struct(F.col(order).alias("_order"), *[F.col(c).cast("double").alias(c) for c in "xyz"], F.col("label").cast("int").alias("label"), F.col("weight").cast("double").alias("weight")))
    firsts = near.groupBy(*keys, *cell).agg(first.alias("_f")).groupBy(*keys).agg(F.sort_array(F.collect_list("_f")).alias("_l"))  # a voxel each
    held = firsts.select(*keys, F.transform("_l", lambda f: F.struct(*[f[c].alias(c) for c in ("x", "y", "z", "label", "weight")])).alias("points"))
    return frames.drop("at", "values", "labels", "masked", "points").join(image, keys, "left").join(held, keys, "left")
