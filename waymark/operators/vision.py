"""Motions from correspondences: camera poses from points, turns from two views, maps of one plane onto another.

Hypotheses come from minimal samples, all solved at once as stacks of small linear systems, and
are scored on all correspondences; the best is refined on what agrees with it. One pair of
keyframes is one group of correspondences, bounded by the features of an image.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions import lie


@dataclass(frozen=True)
class Consensus:
    """Hypotheses, the largest miss of an inlier (pixels), the camera's focal length (pixels), rounds of refinement, a robust kernel's width (pixels), cells of the image along an axis."""

    hypotheses: int = 400
    reach: float = 3.0
    focal: float = 500.0
    rounds: int = 5
    huber: float = 1.5
    cells: int = 4
    half_view: float = 0.8


def samples(n: int, size: int, hypotheses: int, seed: int) -> np.ndarray:
    """(hypotheses, size) places of distinct correspondences."""
    return np.argpartition(np.random.default_rng(seed).random((hypotheses, n)), size - 1, axis=1)[:, :size]


def _null(a: np.ndarray) -> np.ndarray:
    """The unit vectors that stacks of matrices take nearest to zero."""
    return np.linalg.svd(a)[2][..., -1, :]


def _nearest_rotation(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rotations nearest to stacks of matrices, and the matrices' mean singular values (negative if they mirror)."""
    u, s, v = np.linalg.svd(m)
    sign = np.linalg.det(u @ v)
    return u @ v * sign[..., None, None], s.mean(axis=-1) * sign


# ---- camera poses from points ----


def _pose_rows(points: np.ndarray, rays: np.ndarray) -> np.ndarray:
    """Two equations of each correspondence in the twelve entries of a camera matrix."""
    whole = np.concatenate([points, np.ones((*points.shape[:-1], 1))], axis=-1)
    zero = np.zeros_like(whole)
    u, v = rays[..., :1], rays[..., 1:2]
    return np.concatenate([np.concatenate([whole, zero, -u * whole], axis=-1), np.concatenate([zero, whole, -v * whole], axis=-1)], axis=-2)


def _seen(rotation: np.ndarray, shift: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where cameras see points, as image coordinates, and their depths."""
    there = np.einsum("...ij,nj->...ni", rotation, points) + shift[..., None, :]
    depth = there[..., 2]
    return there[..., :2] / np.where(np.abs(depth) < 1e-9, 1e-9, depth)[..., None], depth


def camera_pose(points: np.ndarray, rays: np.ndarray, how: Consensus, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(rotation, shift, inliers, mean miss in pixels) of the camera that sees the points (n, 3) at rays (n, 2, x / z and y / z); None without one.

    Hypotheses are linear solutions of six points each; an inlier lies ahead of the camera. The
    refinement is Gauss-Newton with a robust kernel on the inliers, chosen anew in every round.
    Points of one plane leave the linear solutions open, and then few agree.
    """
    n = len(points)
    if n < 6:
        return None
    center, size = points.mean(axis=0), max(1e-9, float(np.sqrt(((points - points.mean(axis=0)) ** 2).sum(axis=1).mean())))
    even = (points - center) / size
    pick = samples(n, 6, how.hypotheses, seed)
    p = _null(_pose_rows(even[pick], rays[pick])).reshape(-1, 3, 4)
    rotation, scale = _nearest_rotation(p[:, :, :3])
    good = np.abs(scale) > 1e-9
    rotation, shift = rotation[good], p[good, :, 3] / scale[good, None]
    if not len(rotation):
        return None
    seen, depth = _seen(rotation, shift, even)
    miss = np.where(depth > 0, np.linalg.norm(seen - rays, axis=2) * how.focal, np.inf)
    inside = miss <= how.reach
    best = np.lexsort((np.where(inside, miss, 0).sum(axis=1), -inside.sum(axis=1)))[0]
    r, t, keep = rotation[best], shift[best], inside[best]
    for _ in range(how.rounds):
        if keep.sum() < 6:
            return None
        for _ in range(3):
            there = even[keep] @ r.T + t
            x, y, z = there.T
            rest = (there[:, :2] / z[:, None] - rays[keep]) * how.focal
            project = np.zeros((len(there), 2, 3))
            project[:, 0, 0] = project[:, 1, 1] = how.focal / z
            project[:, 0, 2], project[:, 1, 2] = -how.focal * x / z**2, -how.focal * y / z**2
            j = np.concatenate([-project @ lie.hat(even[keep] @ r.T), project], axis=2).reshape(-1, 6)
            w = np.repeat(np.minimum(1, how.huber / np.maximum(np.linalg.norm(rest, axis=1), 1e-9)), 2)
            h = (j * w[:, None]).T @ j
            step = np.linalg.solve(h + 1e-9 * np.trace(h) * np.eye(6), -(j * w[:, None]).T @ rest.ravel())
            r, t = lie.rotation(step[:3]) @ r, t + step[3:]
        seen, depth = _seen(r, t, even)
        miss = np.where(depth > 0, np.linalg.norm(seen - rays, axis=1) * how.focal, np.inf)
        again = miss <= how.reach
        if (again == keep).all():
            break
        keep = again
    if keep.sum() < 6:
        return None
    return r, t * size - r @ center, keep, float(miss[keep].mean())


# ---- turns from two views ----


def two_view_turn(first: np.ndarray, second: np.ndarray, how: Consensus, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """(rotation, direction of the shift, inliers, mean miss in pixels) between two views of rays (n, 2); None without one.

    Eight-point solutions of an essential matrix, scored by the distance from both epipolar lines
    (to first order), fitted again on the inliers; of the four motions that it allows the one that
    sees the most points ahead of both cameras.
    """
    n = len(first)
    if n < 8:
        return None
    a, b = (np.concatenate([x, np.ones((n, 1))], axis=1) for x in (first, second))

    def solve(rows: np.ndarray) -> np.ndarray:
        e = _null(rows).reshape(*rows.shape[:-2], 3, 3)
        u, _, v = np.linalg.svd(e)
        return u[..., :, :2] @ v[..., :2, :]

    def misses(e: np.ndarray) -> np.ndarray:
        over, back = np.einsum("...ij,nj->...ni", e, a), np.einsum("...ji,nj->...ni", e, b)
        across = np.einsum("ni,...ni->...n", b, over)
        return np.abs(across) / np.sqrt(np.maximum(1e-18, (over[..., :2] ** 2).sum(axis=-1) + (back[..., :2] ** 2).sum(axis=-1))) * how.focal

    rows = (b[:, :, None] * a[:, None, :]).reshape(n, 9)
    miss = misses(solve(rows[samples(n, 8, how.hypotheses, seed)]))
    inside = miss <= how.reach
    keep = inside[np.lexsort((np.where(inside, miss, 0).sum(axis=1), -inside.sum(axis=1)))[0]]
    e = None
    for _ in range(how.rounds):
        if keep.sum() < 8:
            return None
        e = solve(rows[keep])
        again = misses(e) <= how.reach
        if (again == keep).all():
            break
        keep = again
    if e is None or keep.sum() < 8:
        return None
    u, _, v = np.linalg.svd(e)
    u, v = u * np.linalg.det(u), v * np.linalg.det(v)
    w = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    found = []
    for r in (u @ w @ v, u @ w.T @ v):
        for t in (u[:, 2], -u[:, 2]):
            # depths along both rays where they come nearest
            turned = a[keep] @ r.T
            ahead = np.cross(turned, b[keep])
            far = np.maximum(1e-18, (ahead**2).sum(axis=1))
            d1 = -(np.cross(np.broadcast_to(t, turned.shape), b[keep]) * ahead).sum(axis=1) / far
            d2 = -(np.cross(np.broadcast_to(t, turned.shape), turned) * ahead).sum(axis=1) / far
            found.append((int(((d1 > 0) & (d2 > 0)).sum()), r, t))
    _, r, t = max(found, key=lambda x: x[0])
    return r, t, keep, float(misses(e)[keep].mean())


# ---- maps of a plane ----


def _homography_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    whole = np.concatenate([a, np.ones((*a.shape[:-1], 1))], axis=-1)
    zero = np.zeros_like(whole)
    return np.concatenate([np.concatenate([whole, zero, -b[..., :1] * whole], axis=-1), np.concatenate([zero, whole, -b[..., 1:] * whole], axis=-1)], axis=-2)


def _evened(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points about their mean at a mean distance of the square root of 2, and the map that does it."""
    mean = x.mean(axis=0)
    s = math.sqrt(2) / max(1e-9, float(np.linalg.norm(x - mean, axis=1).mean()))
    return (x - mean) * s, np.array([[s, 0, -s * mean[0]], [0, s, -s * mean[1]], [0, 0, 1]])


def plane_map(a: np.ndarray, b: np.ndarray, how: Consensus, seed: int, affine: bool) -> tuple[np.ndarray, np.ndarray, float] | None:
    """(3 by 3 map, inliers, mean miss) that takes a (n, 2) to b, a homography from four points each or an affine map from three; None without one. Misses are in b's unit."""
    n, least = len(a), 3 if affine else 4
    if n < least:
        return None
    (p, pa), (q, qb) = _evened(a), _evened(b)
    back = np.linalg.inv(qb)

    def solve(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        if not affine:
            return _null(_homography_rows(p, q)).reshape(*p.shape[:-2], 3, 3)
        whole = np.concatenate([p, np.ones((*p.shape[:-1], 1))], axis=-1)
        top = np.swapaxes(np.linalg.pinv(whole) @ q, -1, -2)
        low = np.broadcast_to(np.array([[0.0, 0, 1]]), (*top.shape[:-2], 1, 3))
        return np.concatenate([top, low], axis=-2)

    def misses(h: np.ndarray) -> np.ndarray:
        there = np.einsum("...ij,nj->...ni", back @ h @ pa, np.concatenate([a, np.ones((n, 1))], axis=1))
        z = there[..., 2:]
        there = there[..., :2] / np.where(np.abs(z) < 1e-12, 1e-12, z)
        return np.linalg.norm(there - b, axis=-1)

    pick = samples(n, least, how.hypotheses, seed)
    miss = misses(solve(p[pick], q[pick]))
    inside = miss <= how.reach
    keep = inside[np.lexsort((np.where(inside, miss, 0).sum(axis=1), -inside.sum(axis=1)))[0]]
    h = None
    for _ in range(how.rounds):
        if keep.sum() < least:
            return None
        h = solve(p[keep], q[keep])
        again = misses(h) <= how.reach
        if (again == keep).all():
            break
        keep = again
    if h is None or keep.sum() < least:
        return None
    miss, h = misses(h), back @ h @ pa
    return h / h[2, 2], keep, float(miss[keep].mean())


# ---- pairs of keyframes ----


def _coverage(rays: np.ndarray, how: Consensus) -> int:
    """Cells of the image that hold a ray."""
    at = np.clip(np.floor((rays + how.half_view) / (2 * how.half_view) * how.cells), 0, how.cells - 1).astype(int)
    return len(np.unique(at[:, 0] * how.cells + at[:, 1]))


def _pose(rows: pd.DataFrame, how: Consensus, seed: int) -> dict:
    points, rays = rows[["x", "y", "z"]].to_numpy(float), rows[["u", "v"]].to_numpy(float)
    found = camera_pose(points, rays, how, seed)
    if found is None:
        return {"inliers": 0}
    r, t, keep, miss = found
    place = -r.T @ t
    return {"inliers": int(keep.sum()), "reprojection": miss, "cells": _coverage(rays[keep], how), "distance": float(np.linalg.norm(place)), "turn": math.degrees(float(np.linalg.norm(lie.rotation_vector(r)))), "px": place[0], "py": place[1], "pz": place[2]}


def _turn(rows: pd.DataFrame, how: Consensus, seed: int) -> dict:
    a, b = rows[["x", "y"]].to_numpy(float), rows[["u", "v"]].to_numpy(float)
    parallax = float(np.median(np.linalg.norm(a - b, axis=1))) * how.focal if len(a) else 0.0
    found = two_view_turn(a, b, how, seed)
    if found is None:
        return {"inliers": 0, "parallax": parallax}
    r, t, keep, miss = found
    v = lie.rotation_vector(r)
    return {"inliers": int(keep.sum()), "reprojection": miss, "parallax": parallax, "turn": math.degrees(float(np.linalg.norm(v))), "rx": v[0], "ry": v[1], "rz": v[2], "dx": t[0], "dy": t[1], "dz": t[2]}


def _map(affine: bool) -> Callable:
    def f(rows: pd.DataFrame, how: Consensus, seed: int) -> dict:
        found = plane_map(rows[["x", "y"]].to_numpy(float), rows[["u", "v"]].to_numpy(float), how, seed, affine)
        if found is None:
            return {"inliers": 0}
        h, keep, miss = found
        scale = math.sqrt(abs(float(np.linalg.det(h[:2, :2] - np.outer(h[:2, 2], h[2, :2])))))
        return {"inliers": int(keep.sum()), "reprojection": miss, "dx": h[0, 2], "dy": h[1, 2], "scale": scale, "turn": math.degrees(math.atan2(h[1, 0], h[0, 0]))}

    return f


#: Methods by name: what is solved, and the numbers that come of it besides matches and inliers.
METHODS: dict[str, tuple[Callable, list[str]]] = {
    "pose": (_pose, ["reprojection", "distance", "turn", "px", "py", "pz", "cells"]),
    "turn": (_turn, ["reprojection", "parallax", "turn", "rx", "ry", "rz", "dx", "dy", "dz"]),
    "homography": (_map(False), ["reprojection", "dx", "dy", "scale", "turn"]),
    "affine": (_map(True), ["reprojection", "dx", "dy", "scale", "turn"]),
}


def motions(matches: DataFrame, keys: list[str], order: str, method: str, how: Consensus = Consensus()) -> DataFrame:
    """(keys, matches, inliers, numbers of the method) of each key's correspondences (x, y[, z] -> u, v), the columns that the gates read.

    Correspondences are taken in the order of a column, so samples, seeded by the key, don't depend
    on how rows arrive; those with a null or infinite part don't count. Without a solution there are
    no inliers and the numbers are null. A key is a task of one image pair's correspondences.
    """
    f, numbers = METHODS[method]
    parts = ["x", "y", *(["z"] if method == "pose" else []), "u", "v"]
    kinds = ", ".join(f"{c} {matches.schema[c].dataType.simpleString()}" for c in keys)
    rows = matches.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in parts])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = {k: pdf[k].iloc[0] for k in keys}
        pdf = pdf[np.isfinite(pdf[parts].to_numpy(float)).all(axis=1)].sort_values([order, *parts])
        out = f(pdf, how, zlib.crc32(" ".join(map(str, first.values())).encode()))
        return pd.DataFrame([first | {"matches": len(pdf)} | {c: out.get(c) for c in ["inliers", *numbers]}])

    return rows.groupBy(*keys).applyInPandas(run, f"{kinds}, matches int, inliers int, " + ", ".join(f"{c} double" for c in numbers))
