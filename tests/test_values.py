"""Values of queries that no SQL expresses, against known motions, plain Python or dense NumPy."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.catalog import QUERIES
from waymark.functions import labels, lie
from waymark.operators import folds, gates, inertial, posegraph
from waymark.plans import graphs, inertia, registrations
from waymark.plans.views import Views


@pytest.fixture(scope="module")
def v(spark, sf):
    return Views(spark, sf)


def truth_of(a):
    """The motion of the copy of frame a."""
    return (a % 3) * 0.3, -(a % 4) * 0.2, (a % 5 - 2) * 0.01, (a % 2) * 0.1


@pytest.mark.parametrize("name, xy, turn", [("OPT2_feature_alignment", 0.2, 0.02), ("OPT6_ransac", 0.01, 0.001), ("OPT8_keyframe_match", 0.01, 0.001), ("OPT10_registration_rounds", 0.01, 0.001), ("OPT3_coarse_relative", 0.6, 0.02)])
def test_registrations_find_the_motion(spark, sf, name, xy, turn):
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == 64
    # the copy of frame a is turned and shifted about the origin: read off two of its points
    near = [math.hypot(r.x - truth_of(r.a)[0], r.y - truth_of(r.a)[1]) <= xy and abs(r.yaw - truth_of(r.a)[2]) <= turn for r in rows]
    assert sum(near) >= 0.9 * len(rows)
    if name == "OPT8_keyframe_match":
        assert sum(r.z_accepted and abs(r.z - truth_of(r.a)[3]) < 0.01 and r.reason == "accepted" for r in rows) >= 0.9 * len(rows)


def test_weighted_inliers(spark, sf, v):
    got = {r.frame: r for r in QUERIES["OPT7_weighted_inliers"](spark, sf).collect()}
    rows = registrations.features_of(v.sql(registrations.LANDMARKS))
    for r in rows.groupBy("frame").agg(F.count("*").alias("n"), F.count_if(F.col("id") % 3 != 0).alias("good")).collect():
        g = got[r.frame]
        assert g.n == r.n and r.good <= g.inliers <= r.good + 0.1 * r.n
        assert abs(g.x - 0.7) < 0.15 and abs(g.y + 0.4) < 0.15 and abs(g.yaw - (r.frame % 5 - 2) * 0.01) < 0.01


def test_a_pairs_task_is_flat_in_density(spark, sf, v):
    """Ten times the points of a frame are hardly more features: at most some for each landmark."""
    dense = Views(spark, "/root/testdata/sf0.01")
    few, many = (x.sql(registrations.LANDMARKS).groupBy("frame").count().agg(F.max("count")).first()[0] for x in (v, dense))
    of = lambda x: registrations.keyframes(x).groupBy("frame").count().agg(F.max("count")).first()[0]
    assert many > 7 * few and of(dense) <= 3 * 14 * 28 and of(dense) < 0.75 * many


def test_scan_updates_find_the_place(spark, sf):
    rows = QUERIES["EST4_gated_update"](spark, sf).collect()
    good = [r for r in rows if r.used >= 10 and r.directions == 6]
    assert len(good) > 30
    miss = sorted(max(abs(r.px - (r.frame % 3) * 0.2), abs(r.py - (r.frame % 4) * 0.15), abs(r.pz - 1.0)) for r in good)
    assert miss[len(miss) // 2] < 0.03 and miss[int(0.9 * len(miss))] < 0.09  # the guess is off by 0.1
    assert sum(r.converged for r in good) > 0.8 * len(good)  # with ten to thirty points a scan


def test_image_updates_decide_on_height(spark, sf):
    for r in QUERIES["EST6_observable_update"](spark, sf).collect():
        assert abs(r.x - (0.2 + 0.01 * r.frame)) < 0.02 and abs(r.y + 0.1) < 0.02
        use = r.frame % 2 == 1 and 0.05 * (r.frame % 9) <= 0.3
        if abs(0.05 * (r.frame % 9) - 0.3) > 0.02:
            assert r.use_z == use and abs(r.z - (0.05 * (r.frame % 9) if use else 0)) < 0.02


def test_propagation_equals_steps(spark, sf, v):
    """The fold against the same midpoint in plain loops, place and speed only."""
    rows = sorted(((r.run, r.t, r.id, r.w) for r in v.imu.collect()))
    want, state = {}, None
    for run, t, ident, w in rows:
        s = t / (100 * inertia.UNIT)
        gyro, accel = np.array([0, w / 50, w - 0.25]), np.array([w * 2 - 0.5, 0.1, 9.81])
        if state is None or state[0] != run:
            state = [run, s, np.eye(3), np.zeros(3), np.zeros(3), gyro, accel]
        else:
            _, last, rot, p, vel, g0, a0 = state
            dt = s - last
            if 0 < dt <= 5.0:
                g, a = (gyro + g0) / 2, (accel + a0) / 2
                world = rot @ lie.rotation(g * dt / 2) @ a - [0, 0, 9.81]
                p, vel, rot = p + vel * dt + world * dt * dt / 2, vel + world * dt, rot @ lie.rotation(g * dt)
            state = [run, max(s, last), rot, p, vel, gyro, accel]
        want[ident] = (*state[3], *state[4])
    for r in QUERIES["EST1_inertial_propagation"](spark, sf).collect():
        assert np.abs(np.array([r.px, r.py, r.pz, r.vx, r.vy, r.vz]) - want[r.id]).max() < 2e-5 and r.place_sigma > 0


# ---- graphs ----


def dense(vertices, factors, rounds, max_step=math.inf, window=None):
    """Gauss-Newton with dense matrices and derivatives by differences, one graph at a time."""
    ks = sorted(vertices)[-window:] if window else sorted(vertices)
    at = {k: n for n, k in enumerate(ks)}
    poses = np.stack([vertices[k] for k in ks])
    used = [f for f in factors if f["i"] in at and (f["j"] is None or f["j"] in at)]
    free = any(f["j"] is None and at[f["i"]] == 0 for f in used)

    def misses(p):
        return [lie.motion_vector(lie.inverse(f["m"]) @ (p[at[f["i"]]] if f["j"] is None else lie.inverse(p[at[f["i"]]]) @ p[at[f["j"]]])) for f in used]

    for _ in range(rounds):
        r = misses(poses)
        h, g = 1e-9 * np.eye(6 * len(ks)), np.zeros(6 * len(ks))
        jac = np.zeros((len(used), 6, 6 * len(ks)))
        for n in range(len(ks)):
            for c in range(6):
                bumped = poses.copy()
                bumped[n] = bumped[n] @ lie.motion(np.eye(6)[c] * 1e-6)
                for m, (a, b) in enumerate(zip(misses(bumped), r, strict=True)):
                    jac[m, :, 6 * n + c] = (a - b) / 1e-6
        for m, f in enumerate(used):
            info = np.diag(1 / np.array(f["s"]) ** 2)
            size = math.sqrt(float(r[m] @ info @ r[m]))
            w = f["c"] * (f["huber"] / size if f["huber"] and size > f["huber"] else 1)
            h += w * jac[m].T @ info @ jac[m]
            g += w * jac[m].T @ info @ r[m]
        lo = 0 if free else 6
        step = np.zeros(6 * len(ks))
        step[lo:] = np.linalg.solve(h[lo:, lo:], -g[lo:])
        step *= min(1, max_step / max(1e-12, np.linalg.norm(step)))
        poses = np.stack([p @ lie.motion(s) for p, s in zip(poses, step.reshape(-1, 6), strict=True)])
        if np.linalg.norm(step) < 1e-6:
            break
    return {k: poses[n] for k, n in at.items()}


@pytest.mark.parametrize("name, rounds, most, window", [("OPT13_graph_solution", 15, math.inf, None), ("OPT13_all_sensors", 15, math.inf, None), ("OPT12_window_solution", 6, 1.0, 12), ("OPT21_map_match_factor", 8, 2.0, 12)])
def test_smoothing_equals_dense(spark, sf, v, name, rounds, most, window):
    runs = [r.run for r in v.kf.groupBy("run").count().filter("count between 7 and 14").orderBy("run").limit(4).collect()]
    starts, links = {}, {}
    for r in graphs.vertices(v).filter(F.col("run").isin(runs)).collect():
        starts.setdefault(r.run, {})[r.k] = lie.compose(lie.from_quaternion(np.array([r.qw, r.qx, r.qy, r.qz])), np.array([r.x, r.y, r.z]))
    used = {"OPT21_map_match_factor": graphs.map_factors, "OPT13_all_sensors": graphs.sensor_factors}.get(name, graphs.factors)(v)
    for r in used.filter(F.col("run").isin(runs)).collect():
        m = lie.compose(lie.from_quaternion(np.array([r.m_qw, r.m_qx, r.m_qy, r.m_qz])), np.array([r.m_x, r.m_y, r.m_z]))
        links.setdefault(r.run, []).append({"i": r.i, "j": r.j, "m": m, "s": [r[f"s{k}"] for k in range(6)], "huber": r.huber, "c": r.confidence})
    got = {(r.run, r.k): r for r in QUERIES[name](spark, sf).filter(F.col("run").isin(runs)).collect()}
    assert any(f["j"] is None or f["j"] - f["i"] > 1 for run in runs for f in links[run])
    for run in runs:
        for k, p in dense(starts[run], links[run], rounds, most, window).items():
            g = got[(run, k)]
            assert np.abs(p[:3, 3] - [g.x, g.y, g.z]).max() < 2e-3 and abs(abs(g.qw) - abs(posegraph.quaternions(p[:3, :3])[0])) < 1e-3


def test_scans_at_any_density(spark):
    """A scan of floor and walls finds its known place; ten times the points make no larger task; nulls and scans without state don't count."""
    rng = np.random.default_rng(5)

    def room(n):
        a, b = rng.uniform(-6, 6, (2, n))
        return np.concatenate([np.c_[a, b, np.zeros(n)], np.c_[a, np.full(n, 6.0), abs(b)], np.c_[np.full(n, -6.0), a, abs(b)]])

    pose = lie.planar(0.3, -0.2, 0.02, 1.0)
    gates_ = inertial.PlaneGates(voxel=1.0, reach=1.9, nearest=8, least=4, least_points=1, least_width=0.01, max_flatness=0.1)
    states = spark.createDataFrame([(1, 0.4, -0.28, 1.06, 0.03, 0.0)], "frame long, px double, py double, pz double, yaw double, speed double")
    sizes = []
    for n in (1500, 15000):
        world = room(n)
        seen = (room(n) - pose[:3, 3]) @ pose[:3, :3]
        table = lambda p, *more: spark.createDataFrame([(1, *map(float, q)) for q in p] + list(more), "frame long, x double, y double, z double")
        scan, held = table(seen, (1, None, 1.0, 1.0), (1, math.nan, 1.0, 1.0), (2, 1.0, 1.0, 1.0)), table(world)
        sizes.append(inertial.scan_parts(scan, held, states, ["frame"], gates_, 0.3).filter("frame = 1").count())
        [got] = inertial.update_scans(scan, held, states, ["frame"], gates_, inertial.UpdateGates(least=5)).collect()
        assert got.frame == 1 and got.converged and np.abs(np.array([got.px, got.py, got.pz]) - pose[:3, 3]).max() < 0.03 and abs(got.yaw - 0.02) < 0.005
    cells = 40 * 40 * 3 * 4
    assert sizes[1] < cells and sizes[1] < 4 * sizes[0]


def test_scan_parts_work_out_a_place_once(spark):
    """What a point's place is made of stands once in the plan for the scan and once for the map, however many sums and checks use it."""
    points = spark.range(1000).select(F.lit(1).cast("long").alias("frame"), F.length(F.translate(F.md5(F.col("id").cast("string")), "0123456789", "")).alias("n"))
    points = points.select("frame", (F.col("n") * 0.3).alias("x"), (F.col("n") % 5 * 0.7).alias("y"), F.when(F.col("n") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("n") % 4).alias("z"))
    states = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0)], "frame long, px double, py double, pz double, yaw double, speed double")
    parts = inertial.scan_parts(points, points, states, ["frame"], inertial.PlaneGates(), 0.3)
    assert parts._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2
    kept = points.filter("not isnan(z)").count()
    assert 0 < kept < 1000
    assert [r.n for r in parts.filter("what < 2").groupBy("what").agg(F.sum("n").alias("n")).collect()] == [kept, kept]


# ---- admission ----


def proposals(spark, rows):
    base = {"run": 0, "t_ref": 0, "quality": 0.9, "verified": None, "ground_dz": None}
    for p in ("m", "a", "b", "ga", "gb", "l"):
        base |= {f"{p}{c}": 0.0 for c in ("x", "y", "z", "yaw")}
    made = [base | {"t_cur": 1_000_000 * r["j"], "t_ref": 1_000_000 * r["i"]} | r for r in rows]
    schema = ", ".join(["run long", "i long", "j long", "t_ref long", "t_cur long", "quality double", "verified boolean", "ground_dz double", *[f"{p}{c} double" for p in ("m", "a", "b", "ga", "gb", "l") for c in ("x", "y", "z", "yaw")]])
    names = [s.split()[0] for s in schema.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in made], schema), schema


def admitted(spark, rows, **limits):
    df, schema = proposals(spark, rows)
    return sorted(folds.fold(df, ["run"], ["j", "i"], gates.admit(gates.Admission(**limits)), f"{schema}, {gates.ADMITTED}").collect(), key=lambda r: (r.j, r.i))


def test_loop_admission_by_hand(spark):
    one = dict(min_time=5_000_000, min_gap=4, support=1, min_interval=3_000_000)
    rows = [
        {"i": 0, "j": 10, "quality": 0.2},
        {"i": 0, "j": 11, "quality": 0.4},
        {"i": 8, "j": 12},
        {"i": 5, "j": 13, "t_ref": 0},
        {"i": 5, "j": 14},
        {"i": 20, "j": 15, "t_ref": 0},
        {"i": 9, "j": 16, "mx": float("nan")},
        {"i": 9, "j": 17, "mx": 20.0},
        {"i": 9, "j": 18, "verified": False},
        {"i": 9, "j": 19, "verified": True, "lx": 3.0},
        {"i": 9, "j": 20, "verified": True, "quality": 0.35, "lx": 0.5, "ground_dz": -0.6},
        {"i": 15, "j": 25, "gbx": 9.0},
    ]
    got = admitted(spark, rows, **one)
    assert [r.reason for r in got] == ["quality", "quality", "time", "applied", "cooldown", "lookup", "invalid", "raw_disagreement", "scan_geometry", "image_disagreement", "applied", "graph_consistency"]
    last = got[10]
    assert (last.z_applied, last.z_clipped, last.fx, last.fz) == (-0.25, True, 0.5, -0.25) and abs(last.sigma_scale - (1 + 2 * 0.65)) < 1e-12
    assert admitted(spark, [rows[3], {"i": 9, "j": 20}], **one, max_factors=1)[1].reason == "budget"


def test_loops_need_support_from_several_frames(spark):
    rows = [{"i": 1, "j": 10}, {"i": 1, "j": 11, "mx": 0.2}, {"i": 2, "j": 12}, {"i": 3, "j": 20}, {"i": 4, "j": 21, "mx": 3.0}, {"i": 4, "j": 22, "mx": 3.0}, {"i": 20, "j": 40}]
    got = admitted(spark, rows, support=2, min_interval=0, reference_near=0, support_gap=3)
    assert [(r.reason, r.support) for r in got] == [("waiting", 1), ("applied", 2), ("waiting", 1), ("waiting", 1), ("support_disagreement", 1), ("applied", 2), ("waiting", 1)]


def test_reference_by_plane_then_score(spark):
    c = lambda i, xy, z, score, **more: {"i": i, "t": i * 10**6, "baseline": 5.0, "distance": 5.0, "xy_accepted": xy, "z_accepted": z, "score": score, "reason": "rmse", "off_xy": 0.0, "off_yaw": 0.0, "off_z": 0.0} | more
    names = ["i", "t", "baseline", "distance", "xy_accepted", "z_accepted", "score", "reason", "off_xy", "off_yaw", "off_z"]
    frames = [
        (10, [c(1, False, True, 99.0), c(2, True, False, 5.0), c(3, True, True, 5.0)]),
        (11, [c(2, True, True, 9.0), c(3, True, True, 8.0)]),
        (12, [c(2, True, True, 9.0), c(3, False, True, 8.0)]),
        (13, [c(5, True, True, 1.0, off_xy=99.0, off_z=9.0)]),
        (14, [c(6, False, False, 1.0), c(13, True, True, 50.0)]),
        (15, []),
    ]
    kind = ", ".join(f"{n}: {t}" for n, t in zip(names, ["bigint", "bigint", "double", "double", "boolean", "boolean", "double", "string", "double", "double", "double"], strict=True))
    df = spark.createDataFrame([(0, j, j * 10**6, [tuple(x[n] for n in names) for x in cs]) for j, cs in frames], f"run long, j long, t long, candidates array<struct<{kind}>>")
    got = sorted(folds.fold(df, ["run"], ["j"], gates.bind_reference(gates.Reference()), "run long, j long, i long, kind string, reason string").collect(), key=lambda r: r.j)
    assert [(r.i, r.kind, r.reason) for r in got] == [(2, "xy", "bound"), (2, "xy", "bound"), (3, "z", "bound"), (5, None, "graph_consistency"), (6, None, "rmse"), (None, None, "no_reference")]


def test_discovery_by_hand(spark):
    rows = [(10, 1, 9.0, 8.9, True, True), (11, 1, 9.0, 2.0, True, True), (12, 2, 9.0, None, True, False), (13, 2, 9.0, 1.0, False, True), (14, 3, 9.0, 1.0, True, True), (15, 3, 9.0, 1.0, True, True), (20, 9, 9.0, 1.0, True, True), (21, 9, 9.0, 1.0, True, True), (22, None, None, None, None, None)]
    df = spark.createDataFrame([(0, j, j * 10**6, i, None if i is None else i * 10**6, s, s2, xy, z, 0.0, 0.0, 0.0) for j, i, s, s2, xy, z in rows], "run long, j long, t long, i long, t_ref long, score double, second double, xy_accepted boolean, z_accepted boolean, off_xy double, off_yaw double, off_z double")
    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", support long, kind string, reason string"
    got = sorted(folds.fold(df, ["run"], ["j"], gates.discover(), schema).collect(), key=lambda r: r.j)
    assert [r.reason for r in got] == ["ambiguous", "waiting", "applied", "z_requires_xy", "waiting", "cooldown", "waiting", "applied", "no_candidate"]


# ---- planes, labels ----


def test_local_planes_equal_brute_force(spark, sf, v):
    points, voxels = registrations.plane_points(v)
    cells = [(np.array([r.mx, r.my, r.mz]), r.n, np.array([[r.cxx, r.cxy, r.cxz], [r.cxy, r.cyy, r.cyz], [r.cxz, r.cyz, r.czz]]), (r.vx, r.vy, r.vz)) for r in voxels.collect()]
    want = {}
    for q in points.filter("id % 20 = 0").collect():
        p = np.array([q.x, q.y, q.z])
        near = sorted(((float(np.linalg.norm(m - p)), k, n, m, c) for m, n, c, k in cells if np.linalg.norm(m - p) <= 1.8), key=lambda x: x[:2])[:8]
        if len(near) >= 4:
            w = np.array([n * math.exp(-d / 1.8) for d, _, n, _, _ in near])
            center = sum(x * m for x, (_, _, _, m, _) in zip(w, near, strict=True)) / w.sum()
            scatter = sum(x * (c + np.outer(m - center, m - center)) for x, (_, _, _, m, c) in zip(w, near, strict=True)) / w.sum()
            values, vectors = np.linalg.eigh(scatter)
            want[q.id] = (len(near), vectors[:, 0], abs(float(vectors[:, 0] @ (p - center))), max(values[0], 0) / max(values[1], 1e-12))
    got = {r.id: r for r in QUERIES["JN20_local_planes"](spark, sf).collect()}
    assert got.keys() == want.keys() and len(want) > 100
    for i, (used, normal, distance, flat) in want.items():
        g = got[i]
        assert g.used == used and abs(g.flatness - flat) < 1e-4
        if flat < 0.5:
            assert abs(abs(float(normal @ [g.nx, g.ny, g.nz])) - 1) < 1e-4 and abs(abs(g.distance) - distance) < 1e-4
    strategies = Counter(r.strategy for r in QUERIES["JN21_plane_strategies"](spark, sf).collect())
    assert strategies["voxels"] > 100 and sum(strategies.values()) == points.filter("id % 20 = 0").count()


def test_degeneracy_of_normal_equations(spark, sf, v):
    got = {r.frame: r for r in QUERIES["AG25_degeneracy"](spark, sf).collect()}
    rows = {}
    for r in v.sql(registrations.PLANE).collect():
        rows.setdefault(r.frame, []).append(r)
    for frame, points in rows.items():
        h = np.zeros((6, 6))
        for r in points:
            if r.r**2 / (r.variance + 0.02) <= 1:
                n, p = np.array([r.nx, r.ny, r.nz]), np.array([r.x, r.y, r.z])
                j = np.concatenate([np.cross(p, n), n])
                size = abs(r.r) / math.sqrt(r.variance)
                h += min(1, 1 / max(size, 1e-12)) / r.variance * np.outer(j, j)
        values = np.linalg.eigvalsh(h)
        assert got[frame].directions == int((values >= 1e-4 * values.max()).sum())


def test_label_pairs(spark):
    df = spark.createDataFrame([(0,), (40,), (2,), (3,), (5,), (6,), (None,)], "raw int")
    c = F.col("raw")
    got = df.select(labels.convert(c, "semantic_kitti"), labels.convert(c, "sam3"), labels.convert(c, "internal")).collect()
    assert [r[0] for r in got][:2] == [0, 1] and [r[1] for r in got][2:5] == [3, 4, 5] and got[5][2] == 6 and tuple(got[6]) == (None, None, None)
    with pytest.raises(ValueError):
        labels.convert(c, "other")


def test_image_update_tasks_hold_sums(spark, sf):
    """Python gets a row a frame, the sums of its rays, and not the frame's points."""
    plan = QUERIES["EST6_observable_update"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroups" not in plan and plan.index("MapInPandas") < plan.index("Aggregate [frame")
