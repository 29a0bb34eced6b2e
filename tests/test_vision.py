"""Motions from correspondences against known motions with many false matches."""

import math

import numpy as np
import pytest

from waymark.functions import lie
from waymark.operators import equations, vision
from waymark.operators.vision import Consensus
from waymark.plans import acceptance


def scene(seed, n=150, false=0.4, noise=0.3 / 500):
    """Points ahead of a camera, where a turned and shifted one sees them, and which of these are true."""
    rng = np.random.default_rng(seed)
    points = np.c_[rng.uniform(-8, 8, (n, 2)), rng.uniform(8, 25, n)]
    r, t = lie.rotation(rng.normal(0, 0.15, 3)), rng.normal(0, 0.6, 3)
    there = points @ r.T + t
    rays = there[:, :2] / there[:, 2:] + rng.normal(0, noise, (n, 2))
    true = rng.random(n) >= false
    rays[~true] = rng.uniform(-0.8, 0.8, (int((~true).sum()), 2))
    return points, rays, r, t, true


@pytest.mark.parametrize("seed", range(8))
def test_camera_poses(seed):
    points, rays, r, t, true = scene(seed)
    found, shift, keep, miss = vision.camera_pose(points, rays, Consensus(), seed)
    assert np.linalg.norm(lie.rotation_vector(found.T @ r)) < 1e-3 and np.linalg.norm(shift - t) < 0.02
    assert keep[true].mean() > 0.98 and keep[~true].mean() < 0.05 and miss < 0.8


@pytest.mark.parametrize("seed", range(8))
def test_two_views(seed):
    points, rays, r, t, true = scene(seed)
    first = points[:, :2] / points[:, 2:]
    found, direction, keep, miss = vision.two_view_turn(first, rays, Consensus(hypotheses=1500, reach=2.0), seed)
    assert np.linalg.norm(lie.rotation_vector(found.T @ r)) < 0.01
    assert direction @ t / np.linalg.norm(t) > 0.98
    assert keep[true].mean() > 0.95 and miss < 1


def test_tracked_features_of_the_fixture():
    """48 points in six rows of eight at depths of 6 and more, a camera that moves a tenth of a metre aside."""
    grid = [(r, c) for r in range(6) for c in range(8)]
    points = np.array([[(c - 3.5) * 0.6, (r - 2.5) * 0.6, 6 + 0.45 * ((r + 2 * c) % 6)] for r, c in grid])
    moved = points + [-0.10, 0.01, 0.0]
    first, second = (x[:, :2] / x[:, 2:] for x in (points, moved))
    r, t, keep, _ = vision.two_view_turn(first, second, Consensus(), 1)
    assert np.linalg.norm(lie.rotation_vector(r)) < 1e-6 and keep.all()
    assert np.abs(t - np.array([-0.10, 0.01, 0]) / math.hypot(0.10, 0.01)).max() < 1e-4
    r, t, keep, _ = vision.camera_pose(points, second, Consensus(), 1)
    assert np.abs(t - [-0.10, 0.01, 0]).max() < 1e-6 and np.linalg.norm(lie.rotation_vector(r)) < 1e-7


@pytest.mark.parametrize("affine", [True, False])
def test_plane_maps(affine):
    for seed in range(6):
        rng = np.random.default_rng(seed)
        a = rng.uniform(0, 640, (120, 2))
        h = np.array([[0.9, -0.2, 30], [0.25, 1.1, -12], [0 if affine else 2e-4, 0 if affine else -1e-4, 1]])
        b = np.c_[a, np.ones(120)] @ h.T
        b = b[:, :2] / b[:, 2:] + rng.normal(0, 0.3, (120, 2))
        true = rng.random(120) >= 0.4
        b[~true] = rng.uniform(0, 640, (int((~true).sum()), 2))
        found, keep, miss = vision.plane_map(a, b, Consensus(), seed, affine)
        assert np.abs(found - h)[:2].max() < 0.5 and keep[true].mean() > 0.98 and keep[~true].mean() < 0.1 and miss < 1


def test_too_few_and_degenerate():
    points, rays, *_ = scene(1)
    assert vision.camera_pose(points[:5], rays[:5], Consensus(), 1) is None and vision.two_view_turn(rays[:7], rays[:7], Consensus(), 1) is None
    assert vision.plane_map(rays[:2], rays[:2], Consensus(), 1, True) is None and vision.plane_map(rays[:3], rays[:3], Consensus(), 1, False) is None
    one = np.zeros((30, 3))
    vision.camera_pose(one, np.zeros((30, 2)), Consensus(), 1)  # no crash: no pose or one without meaning
    vision.plane_map(one[:, :2], one[:, :2], Consensus(), 1, True)


def test_rows(spark):
    points, rays, r, t, _ = scene(3)
    rows = [(7, k, *map(float, p), *map(float, q)) for k, (p, q) in enumerate(zip(points, rays, strict=True))]
    rows += [(7, 900, None, 1.0, 1.0, 1.0, 1.0), (7, 901, math.nan, 1.0, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "pair long, id long, x double, y double, z double, u double, v double")
    got = {x.pair: x for x in vision.motions(df.repartition(7), ["pair"], "id", "pose").collect()}
    again = {x.pair: x for x in vision.motions(df.orderBy("u").coalesce(1), ["pair"], "id", "pose").collect()}
    assert got == again and got[None].inliers == 0 and got[None].px is None and got[7].matches == 150
    assert np.linalg.norm(np.array([got[7].px, got[7].py, got[7].pz]) + r.T @ t) < 0.03 and got[7].cells >= 12
    assert vision.motions(df.limit(0), ["pair"], "id", "turn").collect() == []


def test_queries(spark, sf):
    from waymark.catalog import QUERIES

    rows = QUERIES["VIS2_loop_pose"](spark, sf).collect()
    good = [x for x in rows if x.reason == "verified"]
    assert len(rows) == 64 and len(good) > 50 and sum(x.off <= 0.3 for x in good) >= 0.95 * len(good)
    assert sum(abs(x.turn - round(math.degrees(abs(acceptance._view(x.frame)[0])))) <= 1 for x in good) >= 0.95 * len(good)
    rows = QUERIES["VIS1_two_view_turn"](spark, sf).collect()
    good = [x for x in rows if x.reason == "accepted"]
    assert len(good) > 25 and sum(abs(x.turn - round(math.degrees(abs(acceptance._view(x.frame)[0])))) <= 1 for x in good) >= 0.9 * len(good)
    rows = QUERIES["VIS6_plane_map"](spark, sf).collect()
    good = [x for x in rows if x.reason == "accepted"]
    assert len(good) > 50
    for x in good:
        _, px, py, _ = acceptance._view(x.frame)
        assert abs(x.dx - px) <= 0.2 and abs(x.dy - py) <= 0.2 and abs(x.scale - (0.9 + x.frame % 4 * 0.1)) <= 0.011


def test_photometric_equations_and_update(spark, sf):
    """The sums against numeric derivatives of every miss; the update finds the pose from which the picture was taken."""
    from waymark.catalog import QUERIES
    from waymark.operators import equations
    from waymark.plans import inertia
    from waymark.plans.views import Views

    v = Views(spark, sf)
    pixels = inertia.image_pixels(v).filter("frame in (3, 4)")
    got = {r.frame: r for r in equations.photometric_pose(pixels, ["frame"], "id", 81, inertia.CAMERA, 0.6, 0.5, 0.2).collect()}
    rows = pixels.toPandas()
    rotation, lever = np.array(inertia.CAMERA.rotation), np.array(inertia.CAMERA.lever)

    def place(b, r, e):
        """Pixel of a body's point after an error of the pose."""
        moved = lie.rotation(e[:3]).T @ (b - r.T @ e[3:])
        x, y, z = rotation @ (moved - lever)
        return np.array([300 * x / z, 300 * y / z])

    for frame, part in rows.groupby("frame"):
        h, g, used = np.zeros((6, 6)), np.zeros(6), 0
        for _, patch in part.groupby("id"):
            one = patch.iloc[0]
            b, r = one[["bx", "by", "bz"]].to_numpy(float), lie.from_quaternion(one[["qw", "qx", "qy", "qz"]].to_numpy(float))
            a, c = patch["reference"].to_numpy(), patch["current"].to_numpy()
            if np.corrcoef(a, c)[0, 1] < 0.6:
                continue
            used += 1
            e = 1e-6 * np.eye(6)
            moves = np.stack([(place(b, r, x) - place(b, r, -x)) / 2e-6 for x in e], axis=1)
            j = patch[["gx", "gy"]].to_numpy() @ moves / c.std()
            miss = (c - c.mean()) / c.std() - (a - a.mean()) / a.std()
            w = np.minimum(1, 0.5 / np.maximum(np.abs(miss), 1e-12)) / 0.04
            h, g = h + (j * w[:, None]).T @ j, g + j.T @ (w * miss)
        x = got[frame]
        assert x.landmarks == used and used > 20
        mine = np.array([[x[f"h_{equations.SIX[min(p, q)]}_{equations.SIX[max(p, q)]}"] for q in range(6)] for p in range(6)])
        assert np.abs(mine - h).max() < 1e-4 * np.abs(h).max() and np.abs(np.array([x[f"g_{n}"] for n in equations.SIX]) - g).max() < 1e-4 * np.abs(g).max()

    # turns and sideways shifts look much alike at like depths, so what counts is where landmarks are seen
    landmarks = inertia.image_pixels(v).select("frame", "bx", "by", "bz", "qw", "qx", "qy", "qz").distinct().toPandas()
    kept = []
    for x in QUERIES["EST6_image_update"](spark, sf).collect():
        turn, shift = inertia.image_error(x.frame)
        true, found = np.array([*turn, *shift]), np.array([x.turn_x, x.turn_y, x.turn_z, x.px, x.py, x.pz])
        off = np.zeros(2)
        for _, one in landmarks[landmarks["frame"] == x.frame].iterrows():
            b, r = one[["bx", "by", "bz"]].to_numpy(float), lie.from_quaternion(one[["qw", "qx", "qy", "qz"]].to_numpy(float))
            off += [np.linalg.norm(place(b, r, e) - place(b, r, true)) for e in (np.zeros(6), found)]
        kept.append(off[1] / off[0])
        assert x.use_z == (x.z_seen >= 0.5 and abs(x.pz) <= 0.3) or x.pz == 0
    assert len(kept) == 64 and sorted(kept)[57] < 0.4 and sorted(kept)[32] < 0.25


def test_flat_patches_have_no_correlation_to_divide_by(spark):
    """A patch whose reference doesn't vary counts in the shift's equations, and not in the pose's."""
    rows = [(1, p, float(u), float(v), 0.5 if p == 7 else 0.1 * (u + 2 * v), 0.1 * u + 0.2 * v, 0.1, 0.2, 5.0) for p in (7, 8) for u in (-1, 0, 1) for v in (-1, 0, 1)]
    pixels = spark.createDataFrame(rows, "frame long, id long, u double, v double, reference double, current double, gx double, gy double, depth double")
    got = equations.photometric(pixels, ["frame"], "id", 9, 300.0, 0.6, 0.1).collect()
    assert [(r.points, r.pixels) for r in got] == [(2, 18)]
    seen = pixels.selectExpr("*", "5D as bx", "0D as by", "0D as bz", "1D as qw", "0D as qx", "0D as qy", "0D as qz")
    got = equations.photometric_pose(seen, ["frame"], "id", 9, equations.Camera(), 0.6, 0.5, 0.2).collect()
    assert [(r.landmarks, r.pixels) for r in got] == [(1, 9)]
