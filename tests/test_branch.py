"""Branch and bound on a map against scoring every pose of the lattice."""

import math

import numpy as np
import pytest

from waymark.operators import branch, search


def brute(ix, iy, values, x, y, classes, n, size, yaws, xs, ys):
    """Every pose with its score, by a dictionary of cells."""
    at = {(int(a), int(b)): row for a, b, row in zip(ix, iy, values, strict=True)}
    out = []
    for a, yaw in enumerate(yaws):
        for i, dx in enumerate(xs):
            for j, dy in enumerate(ys):
                sum_, met = 0.0, False
                for p, q, c, w in zip(x, y, classes, n, strict=True):
                    u, v = math.cos(yaw) * p - math.sin(yaw) * q, math.sin(yaw) * p + math.cos(yaw) * q
                    if not (math.isfinite(u) and math.isfinite(v)):
                        continue
                    row = at.get((math.floor((u + dx) / size), math.floor((v + dy) / size)))
                    if row is not None:
                        sum_, met = sum_ + w * row[c], met or row[-1] > 0
                out.append((-(round(sum_ / sum(n), 9) if met else -1.0), (0, a, i, j), dx, dy, yaw))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_two_best_of_any_map(seed):
    """Random maps with holes, negative values and few distinct values, so that scores tie; a point that is nowhere."""
    rng = np.random.default_rng(seed)
    cells = np.array([(a, b) for a in range(-6, 7) for b in range(-6, 7) if rng.random() < 0.5], dtype=np.int64)
    values = np.c_[rng.integers(-2, 3, (len(cells), 2)) / 2 * (rng.random((len(cells), 1)) < 0.7), rng.random(len(cells)) < 0.7]
    values[values[:, -1] == 0, :] = 0
    m = int(rng.integers(1, 12))
    x, y, classes, n = rng.uniform(-5, 5, m), rng.uniform(-5, 5, m), rng.integers(0, 2, m), rng.integers(1, 4, m).astype(float)
    if m > 2:
        x[0] = math.nan
    yaws, xs, ys = np.linspace(-0.4, 0.4, 3), np.linspace(-2, 2, int(rng.integers(1, 8))), np.linspace(-1, 3, int(rng.integers(1, 8)))
    scores = branch.Scores(branch.Maxima(cells[:, 0], cells[:, 1], values), x, y, classes, n, 0.7)
    got = branch.best_two(scores, 0, yaws, xs, ys, [])
    want = brute(cells[:, 0], cells[:, 1], values, x, y, classes, n, 0.7, yaws, xs, ys)[:2]
    assert [g[1] for g in got] == [w[1] for w in want]
    assert np.allclose([g[0] for g in got], [w[0] for w in want], atol=1e-9)


def test_maxima_of_windows():
    rng = np.random.default_rng(3)
    held = {(int(a), int(b)): float(v) for a, b, v in zip(rng.integers(-9, 9, 60), rng.integers(-9, 9, 60), rng.normal(size=60), strict=True)}
    ix, iy = (np.array([k[c] for k in held], dtype=np.int64) for c in (0, 1))
    maxima = branch.Maxima(ix, iy, np.array(list(held.values()))[:, None])
    for k in range(4):
        for a in range(-18, 10):
            for b in range(-18, 10):
                want = max(held.get((a + p, b + q), 0.0) for p in range(1 << k) for q in range(1 << k))
                assert maxima.at(k, np.array([a]), np.array([b]), np.array([0]))[0] == want


def walls(spark):
    """A room with a pillar on a map of cells of half a metre, and what stands in it."""
    side = [(i, 0) for i in range(80)] + [(i, 60) for i in range(80)] + [(0, j) for j in range(60)] + [(79, j) for j in range(60)] + [(i, 20) for i in range(25)] + [(50, j) for j in range(30, 45)]
    cells = sorted(set(side))
    prior = spark.createDataFrame([(a, b, 1.0, 0.5, 1) for a, b in cells], "ix long, iy long, occ double, edge double, label int")
    return cells, prior


def test_a_scene_is_found_with_a_tenth_of_the_poses(spark):
    """Points of two frames moved off by known motions; fewer than a tenth of the lattice's poses are scored."""
    cells, prior = walls(spark)
    rows, starts, truth = [], [], {}
    for frame, (dx, dy, yaw) in enumerate([(1.5, -2.0, 0.0), (-2.5, 0.5, 0.0)]):
        truth[frame] = (dx, dy, yaw)
        rows += [(frame, (a + 0.5) * 0.5 - dx, (b + 0.5) * 0.5 - dy, 1, False, 3) for a, b in cells]
        starts.append((frame, 0.0, 0.0, 0.0, 100.0))
    points = spark.createDataFrame(rows, "frame long, x double, y double, label int, dynamic boolean, n long")
    at = spark.createDataFrame(starts, "frame long, x0 double, y0 double, yaw0 double, variance double")
    how = search.Localization(max_radius=8.0, step=0.5, yaw=0.1, yaw_step=0.05, fine_step=0.25)
    lattice = 5 * 33 * 33 + 3 * 7 * 7
    got = {r["frame"]: r for r in search.localize(points, prior, at, ["frame"], 0.5, how).collect()}
    assert set(got) == {0, 1}
    for frame, (dx, dy, yaw) in truth.items():
        r = got[frame]
        assert abs(r["dx"] - dx) < 0.26 and abs(r["dy"] - dy) < 0.26 and abs(r["yaw"] - yaw) < 1e-9
        assert r["ratio"] > 0.99 and r["scored"] < lattice / 10, r["scored"]


def test_nulls_strangers_and_empty_tables(spark):
    """Null labels and numbers, a frame off the map, one without a start, a null key, repeated cells, clashing names."""
    schema = "frame long, x double, y double, label int, dynamic boolean, n long, radius string, _tx int"
    points = spark.createDataFrame([(1, 0.5, 0.5, None, None, 2, "r", 1), (1, None, 3.0, 2, False, 1, "r", 1), (1, math.inf, 3.0, 2, False, 1, "r", 1), (2, 500.5, 0.5, 1, True, 1, None, 0), (3, 0.5, 0.5, 1, False, 1, None, 0), (None, 0.5, 0.5, 1, False, 1, None, 0)], schema)
    prior = spark.createDataFrame([(0, 0, 1.0, 0.0, None), (0, 0, 0.2, 0.0, 1), (1, 0, None, 0.5, 1), (None, 0, 1.0, 0.0, 1)], "ix long, iy long, occ double, edge double, label int")
    at = spark.createDataFrame([(1, 0.0, 0.0, 0.0, None), (2, 0.0, 0.0, 0.0, 1.0), (4, 0.0, 0.0, 0.0, 1.0)], "frame long, x0 double, y0 double, yaw0 double, variance double")
    got = {r["frame"]: r for r in search.localize(points, prior, at, ["frame"], 1.0).collect()}
    assert set(got) == {1, 2}
    assert got[1]["best"] == 0.5 and got[1]["ratio"] == 0.5 and got[1]["radius"] == 1.0
    assert got[2]["best"] == -1 and got[2]["reason"] == "no_overlap" and got[2]["ratio"] == 0
    assert search.localize(points.limit(0), prior, at, ["frame"], 1.0).count() == 0
    assert search.localize(points, prior.limit(0), at, ["frame"], 1.0).filter("best = -1").count() == 2
