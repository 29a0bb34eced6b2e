"""The inertial filter, pose graphs and registration against known motions."""

import math

import numpy as np
import pytest

from waymark.functions import lie
from waymark.operators import inertial, posegraph, registration
from waymark.operators.inertial import Noise, PlaneGates, PlaneMap, State, UpdateGates, Wheel


def random_motions(n, size=1.0, seed=0):
    return lie.motion(np.random.default_rng(seed).normal(0, size, (n, 6)))


def test_logarithms_undo_exponentials():
    x = np.random.default_rng(1).normal(0, 0.8, (200, 6))
    assert np.abs(lie.motion_vector(lie.motion(x)) - x)[np.linalg.norm(x[:, :3], axis=1) < 3].max() < 1e-8
    assert np.abs(lie.motion_vector(lie.motion(x * 1e-7)) - x * 1e-7).max() < 1e-12
    assert np.abs(lie.motion(x) @ lie.inverse(lie.motion(x)) - np.eye(4)).max() < 1e-12
    half = lie.rotation(np.array([[math.pi, 0, 0], [0, 0, math.pi - 1e-9], [1.2, -2, 0.5]]))
    assert np.abs(lie.rotation(lie.rotation_vector(half)) - half).max() < 1e-6
    m = np.eye(4)
    step = lie.motion(np.array([0.001, -0.0005, 0.0008, 0.01, -0.005, 0.002]))
    for _ in range(2000):
        m = lie.orthonormal(step @ m)
    assert np.abs(m[:3, :3].T @ m[:3, :3] - np.eye(3)).max() < 1e-10 and abs(np.linalg.det(m[:3, :3]) - 1) < 1e-10


def test_propagation_follows_a_known_motion():
    """A body that circles at a constant speed: the readings are exact, so is the state; covariances are those of small samples of errors."""
    rate, speed, dt = 0.5, 3.0, 0.002
    times = np.arange(0, 4 + dt / 2, dt)
    gyro = np.tile([0, 0, rate], (len(times), 1))
    accel = np.tile([0, speed * rate, 9.81], (len(times), 1))
    start = State(velocity=np.array([speed, 0, 0]))
    path = inertial.propagate_to(start, 4.0, times, gyro, accel, Noise())
    end = path[-1]
    radius = speed / rate
    assert np.abs(end.place - [radius * math.sin(2), radius * (1 - math.cos(2)), 0]).max() < 1e-4
    assert abs(float(lie.yaw_of(end.rotation)) - 2) < 1e-9 and len(path) == len(times)
    assert np.linalg.eigvalsh(end.covariance).min() > 0 and np.trace(end.covariance) > np.trace(start.covariance)
    # cut between samples; gaps and missing cover are refused
    half = inertial.propagate_to(start, 1.0011, times, gyro, accel, Noise())[-1]
    assert abs(half.time - 1.0011) < 1e-12 and abs(float(lie.yaw_of(half.rotation)) - rate * 1.0011) < 1e-9
    assert inertial.propagate_to(start, 5.0, times, gyro, accel, Noise()) is None
    gap = np.concatenate([times[:100], times[300:]])
    assert inertial.propagate_to(start, 4.0, gap, gyro[: len(gap)], accel[: len(gap)], Noise()) is None
    # the covariance's growth against errors drawn at random
    rng = np.random.default_rng(2)
    root = np.linalg.cholesky(start.covariance)
    quiet = Noise(gyro=0, accel=0, gyro_walk=0, accel_walk=0, gravity_walk=0)
    exact = inertial.propagate_to(start, 0.4, times, gyro, accel, quiet)[-1]
    errors = np.array([inertial.propagate_to(start.plus(root @ rng.normal(size=18)), 0.4, times, gyro, accel, quiet)[-1].minus(exact) for _ in range(300)])
    ratio = errors.std(axis=0) / np.sqrt(np.diagonal(exact.covariance))
    assert ratio.min() > 0.8 and ratio.max() < 1.2


def room(step=0.2):
    """A floor and two walls."""
    a, b = np.meshgrid(np.arange(-6, 6.01, step), np.arange(-4, 4.01, step))
    floor = np.stack([a.ravel(), b.ravel(), np.zeros(a.size)], axis=1)
    a, b = np.meshgrid(np.arange(-6, 6.01, step), np.arange(0, 3.61, step))
    back = np.stack([a.ravel(), np.full(a.size, 4.0), b.ravel()], axis=1)
    a, b = np.meshgrid(np.arange(-4, 4.01, step), np.arange(0, 3.61, step))
    side = np.stack([np.full(a.size, -6.0), a.ravel(), b.ravel()], axis=1)
    return np.concatenate([floor, back, side])


WORLD = room()
GATES = PlaneGates(voxel=0.4, reach=0.9, least=4, least_points=2, least_width=0.005)


def loose(rotation=0.05, place=0.5):
    return np.diag(np.repeat([rotation**2, place**2, 0.25, 1e-8, 1e-6, 1e-8], 3))


def test_planes_of_a_room():
    planes = PlaneMap(WORLD, GATES)
    found, normal, center, _ = planes.planes(np.array([[0, 0, 0.05], [1, 3.95, 2], [-5.98, 0, 2], [0, 0, 30]]))
    assert found.tolist() == [True, True, True, False]
    assert np.abs(np.abs(normal[[0, 1, 2], [2, 1, 0]]) - 1).max() < 1e-6
    assert abs(center[0, 2]) < 1e-6 and abs(center[1, 1] - 4) < 1e-6


def test_scan_update_finds_the_pose():
    rng = np.random.default_rng(3)
    truth = lie.planar(0.3, -0.2, 0.03, 1.0)
    scan = rng.permutation(WORLD)[:900] + rng.normal(0, 0.01, (900, 3))
    body = (scan - truth[:3, 3]) @ truth[:3, :3]
    guess = State(rotation=lie.rotation(np.array([0.01, -0.01, 0.0])), place=np.array([0.2, -0.05, 1.08]), covariance=loose())
    planes = PlaneMap(WORLD, GATES)
    s, result = inertial.scan_update(guess, body, planes, UpdateGates())
    assert result["converged"] and result["directions"] == 6 and result["sectors"] >= 6
    assert np.abs(s.place - truth[:3, 3]).max() < 0.01 and abs(float(lie.yaw_of(s.rotation)) - 0.03) < 0.003
    assert np.diagonal(s.covariance)[:6].max() < 0.01 * np.diagonal(guess.covariance)[:6].max()
    # a yaw budget that is spent keeps the heading, up to it
    kept, limited = inertial.scan_update(guess, body, planes, UpdateGates(yaw_budget=0.01))
    assert limited["yaw_limited"] and abs(float(lie.yaw_of(kept.rotation))) < 0.0125
    # too few points: the prediction stays
    few, nothing = inertial.scan_update(guess, body[:10], planes, UpdateGates())
    assert few is guess and not nothing["converged"]


def test_weak_directions_keep_the_prediction():
    """On a floor alone height, roll and pitch are seen; place and heading are not, and stay."""
    floor = WORLD[WORLD[:, 2] == 0]
    planes = PlaneMap(floor, GATES)
    guess = State(rotation=lie.rotation(np.array([0, 0, 0.2])), place=np.array([0.4, 0.3, 1.1]), covariance=loose())
    body = floor[::3] - [0, 0, 1.0]
    s, result = inertial.scan_update(guess, body, planes, UpdateGates())
    assert abs(s.place[2] - 1.0) < 0.005 and result["turn_directions"] == 2 and result["directions"] == 3
    assert np.abs(s.place[:2] - guess.place[:2]).max() < 0.02 and abs(float(lie.yaw_of(s.rotation)) - 0.2) < 0.01
    assert result["yaw_share"] < 0.05


def test_wheels_and_their_gates():
    s = State(velocity=np.array([2.0, 0.3, -0.1]), covariance=np.diag(np.repeat([1e-4, 1e-2, 0.25, 1e-4, 1e-6, 1e-8], 3)))
    lin, flags = inertial.wheel_equations(s, s.covariance, Wheel(2.1, 0.1, np.array([0, 0, 0.12])), UpdateGates())
    assert lin.used == 4 and flags["yaw_used"] and not flags["forward_rejected"]
    moved = s.plus(np.linalg.solve(np.linalg.inv(s.covariance) + lin.h, -lin.g))
    assert abs(moved.velocity[0] - 2.1) < 0.02 and np.abs(moved.velocity[1:]).max() < 0.02 and 0.001 < moved.gyro_bias[2] < 0.02
    fast, flags = inertial.wheel_equations(s, s.covariance, Wheel(9.0, 3.0, np.array([0, 0, 0.12])), UpdateGates())
    assert flags["forward_rejected"] and flags["yaw_rejected"] and fast.used == 2
    # numeric derivatives of the misses, with a lever
    wheel = Wheel(2.0, None, np.array([0.1, -0.2, 0.4]), np.array([0.3, -0.1, 0.2]))
    wide = UpdateGates(wheel_huber=1e9, forward_gate=0)
    base, _ = inertial.wheel_equations(s, s.covariance, wheel, wide)
    cost = lambda x: _wheel_cost(s.plus(x), wheel, wide)
    numeric = np.array([(cost(np.eye(18)[k] * 1e-6) - cost(-np.eye(18)[k] * 1e-6)) / 2e-6 for k in range(18)])
    assert np.abs(numeric - base.g).max() < 1e-3 * max(1, np.abs(base.g).max())


def _wheel_cost(s, wheel, gates):
    r = s.rotation.T @ s.velocity + np.cross(wheel.gyro - s.gyro_bias, wheel.lever) - [wheel.forward, 0, 0]
    return 0.5 * float(((r / [gates.forward_noise, gates.lateral_noise, gates.vertical_noise]) ** 2).sum())


def test_visual_update_decides_on_height():
    """Misses that see the plane move it; height changes only where it is seen and the change is small."""
    guess = State(place=np.array([1.0, 2.0, 0.5]), covariance=loose())

    def seeing(axes, goal):
        def equations(s):
            lin = inertial.Linear(used=100)
            for a in axes:
                lin.h[3 + a, 3 + a] += 1e4
                lin.g[3 + a] += 1e4 * (s.place[a] - goal[a])
            lin.h[:3, :3] += np.eye(3)
            return lin

        return equations

    s, result = inertial.visual_update(guess, seeing([0, 1, 2], [1.2, 1.9, 0.6]), UpdateGates())
    assert result["use_z"] and np.abs(s.place - [1.2, 1.9, 0.6]).max() < 1e-2
    s, result = inertial.visual_update(guess, seeing([0, 1], [1.2, 1.9, 9]), UpdateGates())
    assert not result["use_z"] and result["z_seen"] < 0.5 and s.place[2] == 0.5 and abs(s.place[0] - 1.2) < 1e-2
    s, result = inertial.visual_update(guess, seeing([0, 1, 2], [1.0, 2.0, 0.95]), UpdateGates())
    assert not result["use_z"] and s.place[2] == 0.5


# ---- pose graphs ----


@pytest.mark.parametrize("d", [1, 3, 6])
@pytest.mark.parametrize("small", [0, 10_000])
def test_block_solver_equals_dense(d, small, monkeypatch):
    monkeypatch.setattr(posegraph, "SMALL", small)
    rng = np.random.default_rng(d)
    n = 60
    edges = [(k, k + 1) for k in range(n - 1)] + [(2, 50), (10, 40), (11, 41), (0, 59)]
    dense = np.zeros((n * d, n * d))
    diagonal = np.tile(np.eye(d) * 0.01, (n, 1, 1))
    i, j, off = [], [], []
    for a, b in edges:
        x, y = rng.normal(size=(d, d)), rng.normal(size=(d, d))
        diagonal[a] += x.T @ x
        diagonal[b] += y.T @ y
        i.append(a), j.append(b), off.append(x.T @ y)
    for k in range(n):
        dense[k * d : (k + 1) * d, k * d : (k + 1) * d] = diagonal[k]
    for a, b, m in zip(i, j, off, strict=True):
        dense[a * d : (a + 1) * d, b * d : (b + 1) * d] += m
        dense[b * d : (b + 1) * d, a * d : (a + 1) * d] += m.T
    b = rng.normal(size=(n, d))
    x = posegraph.solve_blocks(diagonal, np.array(i), np.array(j), np.array(off), b)
    assert np.abs(x.ravel() - np.linalg.solve(dense, b.ravel())).max() < 1e-6 * np.abs(x).max()


def ring(n=40, radius=10.0):
    a = 2 * np.pi * np.arange(n) / n
    return lie.planar(radius * np.cos(a), radius * np.sin(a), a + np.pi / 2, 0.2 * np.sin(3 * a))


def test_solver_closes_a_ring_and_bears_false_loops():
    truth = ring()
    n = len(truth)
    rng = np.random.default_rng(4)
    i, j = np.arange(n - 1), np.arange(1, n)
    between = lie.inverse(truth[i]) @ truth[j] @ lie.motion(rng.normal(0, 1, (n - 1, 6)) * [0.002, 0.002, 0.01, 0.02, 0.02, 0.02])
    start = [truth[0]]
    for m in between:
        start.append(start[-1] @ m)
    start = np.stack(start)
    loops = np.array([[0, n - 1], [1, n - 2], [5, 33]])
    li, lj = np.concatenate([i, loops[:, 0]]), np.concatenate([j, loops[:, 1]])
    measured = np.concatenate([between, lie.inverse(truth[loops[:, 0]]) @ truth[loops[:, 1]]])
    measured[-1] = lie.planar(30.0, 0.0, 1.0)  # a false one
    sigma = np.array([0.002, 0.002, 0.01, 0.02, 0.02, 0.02])
    information = np.tile(np.diag(1 / sigma**2), (len(li), 1, 1))
    huber = np.where(np.arange(len(li)) >= n - 1, 1.0, 0.0)
    solved, rounds, _ = posegraph.solve_poses(start, li, lj, measured, information, huber, np.ones(len(li)), 60)
    error = lambda p: np.abs(p[:, :3, 3] - truth[:, :3, 3]).max()
    good = np.arange(len(li)) < len(li) - 1
    clean, _, _ = posegraph.solve_poses(start, li[good], lj[good], measured[good], information[good], huber[good], np.ones(good.sum()))
    assert error(clean) < 0.25 * error(start) and error(solved) < 0.8 * error(start)
    assert np.abs(solved[0] - truth[0]).max() < 1e-12
    blind, _, _ = posegraph.solve_poses(start, li, lj, measured, information, np.zeros(len(li)), np.ones(len(li)), 60)
    assert error(solved) < error(blind)


def test_window_of_two_states():
    solved, _, _ = posegraph.solve_poses(np.stack([np.eye(4), lie.planar(0.6, 0.2, 0.1)]), np.array([0]), np.array([1]), lie.planar(1.0, 0.0, 0.0)[None], np.eye(6)[None], np.ones(1), np.ones(1), 4, 1.0)
    assert abs(solved[1][0, 3] - 1) < 1e-4 and np.abs(solved[1][1:3, 3]).max() < 1e-4
    capped, _, _ = posegraph.solve_poses(np.stack([np.eye(4), np.eye(4)]), np.array([0]), np.array([1]), lie.planar(5.0, 0.0, 0.0)[None], np.eye(6)[None], np.zeros(1), np.ones(1), 2, 1.0)
    assert abs(capped[1][0, 3] - 2) < 1e-6


def brute_relax(poses, edges, rounds, how):
    """poses: k -> [x, y, z, yaw]; edges: dicts. In plain loops."""
    first, done = min(poses), False
    for _ in range(rounds):
        if done:
            break
        sums = {k: np.zeros(7) for k in poses}
        for e in edges:
            if e["i"] not in poses or e["j"] not in poses:
                continue
            a, b = poses[e["i"]], poses[e["j"]]
            c, s = math.cos(a[3]), math.sin(a[3])
            miss = np.array([a[0] + c * e["dx"] - s * e["dy"] - b[0], a[1] + s * e["dx"] + c * e["dy"] - b[1], a[2] + e["dz"] - b[2], math.remainder(a[3] + e["dyaw"] - b[3], 2 * math.pi)])
            robust = min(1, how.kernel / max(how.kernel, math.hypot(miss[0], miss[1]))) if e["loop"] else 1
            w = robust * np.array([e["w_xy"], e["w_xy"], e["w_z"], e["w_yaw"]])
            for k, sign in ((e["j"], 1), (e["i"], -1)):
                sums[k] += np.concatenate([sign * w * miss, w[1:]])
        largest = 0
        for k, v in sums.items():
            if k == first:
                continue
            step = how.gain * np.where(v[[4, 4, 5, 6]] > 1e-9, v[:4] / np.maximum(v[[4, 4, 5, 6]], 1e-12), 0)
            step[:2] *= min(1, how.max_shift / max(1e-12, math.hypot(*step[:2])))
            step[2:] = np.clip(step[2:], [-how.max_climb, -how.max_turn], [how.max_climb, how.max_turn])
            poses[k] = poses[k] + step
            largest = max(largest, math.hypot(*step[:2]), abs(step[2]), abs(step[3]))
        done = largest < how.stop
    return poses


def test_relaxation_equals_plain_loops(spark):
    rng = np.random.default_rng(5)
    how = posegraph.Relaxation()
    vertices, edges, want = [], [], {}
    for run in range(3):
        poses = {k: np.array([k + rng.normal(0, 0.3), rng.normal(0, 0.3), rng.normal(0, 0.1), rng.normal(0, 0.05)]) for k in range(1, 12)}
        own = [dict(i=k, j=k + 1, dx=1.0, dy=0.0, dz=0.0, dyaw=0.0, loop=False, w_xy=1.0, w_z=0.5, w_yaw=2.0) for k in range(1, 11)]
        own += [dict(i=1, j=9, dx=8.0, dy=0.1, dz=0.0, dyaw=0.0, loop=True, w_xy=0.7, w_z=0.0, w_yaw=0.3), dict(i=2, j=11, dx=30.0, dy=0.0, dz=0.0, dyaw=0.0, loop=True, w_xy=1.0, w_z=1.0, w_yaw=0.0), dict(i=3, j=99, dx=0.0, dy=0.0, dz=0.0, dyaw=0.0, loop=True, w_xy=1.0, w_z=1.0, w_yaw=1.0)]
        vertices += [(run, k, *map(float, p)) for k, p in poses.items()]
        edges += [{"run": run, **e} for e in own]
        want |= {(run, k): p for k, p in brute_relax(poses, own, 4, how).items()}
    vertices.append((7, 1, 0.0, 0.0, 0.0, 0.0))
    want[(7, 1)] = np.zeros(4)
    df = spark.createDataFrame(vertices, "run long, k long, x double, y double, z double, yaw double")
    e = spark.createDataFrame([tuple(r.values()) for r in edges], "run long, i long, j long, dx double, dy double, dz double, dyaw double, loop boolean, w_xy double, w_z double, w_yaw double")
    got = {(r.run, r.k): np.array([r.x, r.y, r.z, r.yaw]) for r in posegraph.relax_poses(df, e, ["run"], 4, how).collect()}
    assert got.keys() == want.keys() and max(np.abs(got[k] - want[k]).max() for k in want) < 1e-9


# ---- registration ----


def street(n=300, seed=6):
    """Walls along a street with labels, poles, and ground."""
    rng = np.random.default_rng(seed)
    walls = np.concatenate([np.stack([rng.uniform(-15, 15, n), np.where(rng.random(n) < 0.5, 6.0, -6.0) + rng.normal(0, 0.02, n), rng.uniform(0, 3, n)], axis=1), np.stack([rng.uniform(-15, 15, 40), rng.uniform(-5, 5, 40), rng.uniform(0, 2, 40)], axis=1)])
    ground = np.stack([rng.uniform(-15, 15, n), rng.uniform(-6, 6, n), rng.normal(0, 0.02, n)], axis=1)
    points = np.concatenate([walls, ground])
    labels = np.concatenate([np.full(n, 3), np.full(40, 4), np.full(n, 1)])
    return registration.Features(points, labels, np.arange(len(points)) < n + 40)


def seen_from(f, pose, seed=7, keep=0.8, noise=0.02):
    rng = np.random.default_rng(seed)
    mask = rng.random(len(f.points)) < keep
    p = registration.moved(lie.inverse(pose), f.points[mask]) + rng.normal(0, noise, (mask.sum(), 3))
    return registration.Features(p, f.labels[mask], f.structural[mask])


def test_nearest_in_cells_equals_brute_force():
    rng = np.random.default_rng(8)
    a, b = rng.uniform(-5, 5, (300, 3)), rng.uniform(-6, 6, (200, 3))
    la, lb = rng.integers(0, 4, 300), rng.integers(0, 4, 200)
    at, d = registration.Cells(a, la, 0.8).nearest(b, lb)
    for k in range(200):
        far = np.hypot(*(a[:, :2] - b[k, :2]).T)
        ok = (far <= 0.8) & ((la == lb[k]) | (la == 0) | (lb[k] == 0))
        want = int(np.argmin(np.where(ok, far, np.inf))) if ok.any() else -1
        assert at[k] == want and (want < 0 or d[k] == far[want])


def test_match_finds_motion_and_height():
    truth = lie.planar(1.2, -0.7, 0.05, -0.6)
    target = street()
    gates = registration.with_gates(lattice_xy=1.0, lattice_step=0.5, lattice_yaw=math.radians(4), lattice_turn=math.radians(2), z_reach=1.0)
    raw = lie.planar(0.8, -0.3, 0.02, 0.0)
    got = registration.match(target, seen_from(target, truth), raw, gates, 1)
    assert got["reason"] == "accepted" and got["xy_accepted"] and got["z_accepted"]
    assert abs(got["x"] - 1.2) < 0.05 and abs(got["y"] + 0.7) < 0.05 and abs(got["yaw"] - 0.05) < 0.01
    assert abs(got["z_median"] + 0.6) < 0.05 and abs(got["z"] + 0.6) < 0.05
    far = registration.match(target, seen_from(street(seed=99), lie.planar(40, 3, 1.0)), raw, gates, 1)
    assert not far["xy_accepted"]
    nothing = registration.match(target, target.part(np.zeros(len(target.points), bool)), raw, gates, 1)
    assert nothing["reason"] == "few_candidates" and nothing["inliers"] == 0


def test_rounds_match_caps_its_steps():
    truth = lie.planar(0.5, -0.3, 0.02, -0.1)
    target = street()
    got = registration.rounds_match(target, seen_from(target, truth), np.eye(4), registration.with_gates(), rounds=8)
    assert got["xy_accepted"] and abs(got["x"] - 0.5) < 0.08 and abs(got["yaw"] - 0.02) < 0.01 and abs(got["z"] + 0.1) < 0.05 and got["buildings"] > 50
    one = registration.rounds_match(target, seen_from(target, lie.planar(1.4, 0, 0)), np.eye(4), registration.with_gates(reach=2.0), rounds=1)
    assert math.hypot(one["x"], one["y"]) <= 0.6 + 1e-9


def test_consensus_bears_outliers():
    rng = np.random.default_rng(9)
    truth = lie.planar(1.0, 2.0, 0.1)
    source = np.concatenate([rng.uniform(-10, 10, (60, 2)), np.zeros((60, 1))], axis=1)
    target = registration.moved(truth, source) + np.concatenate([rng.normal(0, 0.02, (60, 2)), np.zeros((60, 1))], axis=1)
    target[:25, :2] += rng.uniform(3, 8, (25, 2))
    gates = registration.with_gates()
    pose, inside = registration.consensus(target, source, np.eye(4), gates, 3)
    assert inside[25:].all() and not inside[:25].any()
    fit = registration.robust_fit(target, source, pose, np.eye(4), gates)
    assert np.abs(fit - truth).max() < 0.03
    # weights decide: many light pairs against few heavy ones
    w = np.where(np.arange(60) < 25, 10.0, 0.01)
    target[:25] = registration.moved(lie.planar(-2.0, 0.5, -0.05), source[:25])
    heavy, inside = registration.consensus(target, source, np.eye(4), gates, 3, w)
    assert inside[:25].all() and abs(heavy[0, 3] + 2) < 0.1


def test_regrid_search():
    target = street()
    truth = lie.planar(1.0, -1.0, math.radians(2))
    got = registration.regrid_search(target, seen_from(target, truth), np.eye(4), registration.with_gates(lattice_xy=2.0, lattice_step=0.5))
    assert abs(got["x"] - 1) <= 0.51 and abs(got["y"] + 1) <= 0.51 and abs(got["yaw"] - truth[1, 0]) < 0.04


def test_graphs_are_solved_together(spark, monkeypatch):
    """Graphs of several sizes solved at once equal each alone, in few solutions; a long graph among short ones is still whole."""
    rng = np.random.default_rng(3)
    count = np.r_[rng.integers(2, 9, 120), 70]
    first = np.cumsum(count) - count
    n, owner = int(count.sum()), np.repeat(np.arange(len(count)), count)
    j = np.flatnonzero(np.arange(n) > first[owner])
    i = j - 1
    loops = np.flatnonzero(np.arange(n) - first[owner] >= 4)
    i, j = np.r_[i, loops - 4, first[::3]], np.r_[j, loops, np.full(len(first[::3]), -1)]
    start = lie.motion(rng.normal(0, 0.2, (n, 6)))
    measured = lie.motion(rng.normal(0, 0.3, (len(i), 6)))
    information = np.broadcast_to(np.diag([100.0, 100, 400, 25, 25, 4]), (len(i), 6, 6))
    huber, confidence = np.where(j < 0, 1.0, 0.0), rng.uniform(0.5, 1, len(i))
    fixed = np.arange(len(count)) % 3 != 0
    solutions = []
    solve = np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda a, b: solutions.append(len(a)) or solve(a, b))
    poses, done, error = posegraph.solve_many(start, count, i, j, measured, information, huber, confidence, 6, 1.0, fixed)
    assert len(solutions) <= 6 * 7
    for g in range(len(count)):
        at, own = slice(first[g], first[g] + count[g]), owner[i] == g
        alone = posegraph.solve_poses(start[at], i[own] - first[g], np.where(j[own] < 0, -1, j[own] - first[g]), measured[own], information[own], huber[own], confidence[own], 6, 1.0, bool(fixed[g]))
        assert np.abs(poses[at] - alone[0]).max() < 1e-6 and done[g] == alone[1] and abs(error[g] - alone[2]) <= 1e-6 * (1 + error[g])
    lengths = {"a": 3, "b": 6000, "c": 1, "d": 4}
    vertices = spark.createDataFrame([(r, k, k * 1.01, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0) for r, m in lengths.items() for k in range(m)], "run string, k long, x double, y double, z double, qw double, qx double, qy double, qz double")
    steps = [(r, k, k + 1, 1.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, *[0.1] * 6, 0.0, None) for r, m in [*lengths.items(), ("none", 2)] for k in range(m)]
    factors = spark.createDataFrame(steps, "run string, i long, j long, " + ", ".join(f"{c} double" for c in posegraph.FACTOR) + ", huber double, confidence double")
    got = posegraph.smooth(vertices, factors.coalesce(1), ["run"], 4).collect()
    assert sorted((r.run, r.k) for r in got) == sorted((r, k) for r, m in lengths.items() for k in range(m))
    assert max(abs(r.x - r.k) + abs(r.y) for r in got) < 1e-4


def test_relaxation_makes_edges_once(spark, monkeypatch):
    """Edges are stored once for all rounds; the last round stores nothing."""
    stored = []
    keep = posegraph.checkpointed
    monkeypatch.setattr(posegraph, "checkpointed", lambda df: stored.append(df.columns) or keep(df))
    vertices = spark.createDataFrame([(1, k, 1.1 * k, 0.0, 0.0, 0.0) for k in range(4)], "run long, k long, x double, y double, z double, yaw double")
    edges = spark.createDataFrame([(1, k, k + 1, 1.0, 0.0, 0.0, 0.0, False, 1.0, 1.0, 1.0) for k in range(3)], "run long, i long, j long, dx double, dy double, dz double, dyaw double, loop boolean, w_xy double, w_z double, w_yaw double")
    got = {r.k: r.x for r in posegraph.relax_poses(vertices, edges, ["run"], 3).collect()}
    assert got[0] == 0 and 3.0 < got[3] < 3.3
    assert len(stored) == 3 and ["dx" in c for c in stored] == [True, False, False]
