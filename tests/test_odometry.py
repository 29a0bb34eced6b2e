"""The stateful run from readings and scans against known motions, plain loops and its stream."""

import math
import pickle

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.catalog import QUERIES
from waymark.functions import lie
from waymark.operators import estimate, folds, gates, inertial, odometry
from waymark.plans import inertia
from waymark.plans.views import Views
from waymark.streaming import ordered

FIRST = inertial.State(place=np.array([0.0, 0, 1]), velocity=np.array([3.0, 0, 0]))
RATE, SPEED = 0.5, 3.0
NONE = dict.fromkeys(("wx", "wy", "wz", "ax", "ay", "az", "forward", "yaw_rate", "points"))


def pose(t):
    a = RATE * t
    return np.array([SPEED / RATE * math.sin(a), SPEED / RATE * (1 - math.cos(a)), 1.0]), lie.rotation(np.array([0, 0, a]))


def made_run(n_scans, points=1800, lost=(), seed=1):
    """Readings at 100 Hz and scans at 10 Hz in a room of 30 metres; scans of lost numbers see nothing."""
    rng = np.random.default_rng(seed)
    n = 6000
    room = [np.c_[rng.uniform(-15, 15, (4 * n, 2)) + [0, 6], np.zeros(4 * n)]]
    room += [np.c_[rng.uniform(-15, 15, n), np.full(n, y), rng.uniform(0, 5, n)] for y in (-9.0, 21.0)]
    room += [np.c_[np.full(n, x), rng.uniform(-9, 21, n), rng.uniform(0, 5, n)] for x in (-15.0, 15.0)]
    room = np.concatenate(room)
    rows, truth = [], {}
    for k in range(n_scans * 10 + 1):
        t = k * 10_000
        w, a = rng.normal(0, 0.002, 3) + [0, 0, RATE], rng.normal(0, 0.02, 3) + [0, SPEED * RATE, 9.81]
        rows.append({**NONE, "run": 1, "t": t, "kind": "imu", **dict(zip(("wx", "wy", "wz", "ax", "ay", "az"), map(float, (*w, *a)), strict=True))})
        if k and k % 10 == 0:
            pick, before = rng.choice(len(room), points, replace=False), rng.uniform(0, 0.09, points)
            when = np.array([pose(t / 1e6 - b)[1] for b in before])
            where = np.array([pose(t / 1e6 - b)[0] for b in before])
            body = np.einsum("mji,mj->mi", when, room[pick] - where) + rng.normal(0, 0.01, (points, 3))
            held = [] if k // 10 in lost else [dict(zip(("x", "y", "z", "before"), map(float, (*p, b)), strict=True)) for p, b in zip(body, before, strict=True)]
            rows.append({**NONE, "run": 1, "t": t, "kind": "scan", "points": held})
            truth[t] = pose(t / 1e6)[0]
    return rows, truth


HOW = odometry.Odometry(update=inertial.UpdateGates(noise=0.05), accept=gates.Registration(least=40, strong=200), insert=gates.Insertion(max_normalised=4.0, yaw_share=0.3), scan_cell=0.4, map_cell=2.0)


def walk(rows, how=HOW, first=FIRST, each=None):
    run, step = odometry.follow(how, first=first)()
    out = []
    for r in rows:
        run, made = step(run, r)
        out += made
        if each and made:
            each(run)
    return run, out


def test_a_run_of_200_scans_is_followed_in_flat_memory():
    rows, truth = made_run(200)
    sizes = []
    _, out = walk(rows, each=lambda run: sizes.append(len(pickle.dumps(run))))
    assert len(out) == 200 and out[0]["reason"] == "initialized"
    off = [np.linalg.norm(np.array([o["px"], o["py"], o["pz"]]) - truth[o["t"]]) for o in out]
    assert max(off) < 0.1
    assert sum(o["accepted"] for o in out) > 190 and sum(o["map_reason"] == "updated" for o in out) > 50
    assert {o["directions"] for o in out[1:] if o["accepted"]} == {6}
    assert max(sizes[100:]) < 1.1 * max(sizes[50:100]) and max(o["readings"] for o in out) <= 2


def test_the_map_is_bounded():
    rows, truth = made_run(60)
    near = odometry.Odometry(**{**HOW.__dict__, "max_cells": 380, "radius": 25.0})
    run, out = walk(rows, near)
    assert max(o["cells"] for o in out) <= 380
    assert np.linalg.norm(run.map.mean - run.state.place, axis=1).max() <= 25.0 + 0.5
    assert max(np.linalg.norm(np.array([o["px"], o["py"], o["pz"]]) - truth[o["t"]]) for o in out) < 0.3


def test_skewed_points_are_moved_to_the_end():
    path = [inertial.State(time=t, rotation=pose(t)[1], place=pose(t)[0]) for t in np.linspace(1, 1.1, 11)]
    before = np.array([0.0, 0.033, 0.1, 0.5])
    world = np.array([[5.0, 2, 1], [-3, 8, 2], [1, 1, 0], [4, 4, 4]])
    body = np.array([pose(max(1.0, 1.1 - b))[1].T @ (w - pose(max(1.0, 1.1 - b))[0]) for w, b in zip(world, before, strict=True)])
    end = path[-1]
    assert np.abs(odometry.deskew(body, before, path) @ end.rotation.T + end.place - world).max() < 1e-3


def test_voxels_are_those_of_the_fold():
    """Many cells at once give what points one by one give."""
    rng = np.random.default_rng(4)
    for how in (estimate.Voxel(full=8, least=4), estimate.Voxel(full=6, least=5, freeze=False, gain=0.5)):
        cells = odometry.VoxelMap(1.0, how)
        states, start = {}, estimate.voxel_update(how)
        for _ in range(12):
            points = np.c_[rng.uniform(-3, 3, (150, 2)), rng.normal(0.5, 0.05, 150)]
            cells.insert(points)
            for p in points:
                key = tuple(np.floor(p).astype(int))
                state, step = states.get(key) or start()
                states[key] = step(state, dict(zip("xyz", p, strict=True)))[0], step
        assert len(states) == len(cells.key)
        for key, ((n, mean, scatter, normal, width, plane), _) in states.items():
            k = int(cells._find(cells._keys(np.array([key])))[0])
            assert (n, plane) == (cells.n[k], cells.plane[k])
            assert np.abs(mean - cells.mean[k]).max() < 1e-9 and np.abs(scatter - cells.scatter[k]).max() < 1e-9
            if plane:
                assert abs(abs(normal @ cells.normal[k]) - 1) < 1e-9


def test_outages_waits_and_odd_rows():
    rows, truth = made_run(60, lost=range(20, 24))
    scan = next(r for r in rows if r["kind"] == "scan")
    bad = [{**rows[0], "t": 5, "wx": None}, {**rows[0], "t": 6, "wx": math.inf}, {**scan, "t": 1}, {**rows[0], "kind": "wheel", "t": 7, "forward": None}]
    rows[1:1] = bad
    at = next(k for k, r in enumerate(rows) if r["kind"] == "scan" and r["t"] == 300_000)
    rows[at]["points"] = [*rows[at]["points"], None, {"x": None, "y": 1.0, "z": 1.0, "before": 0.0}, {"x": math.nan, "y": 1.0, "z": 1.0, "before": 0.0}]
    rows.insert(at + 1, {**scan, "t": 200_000})
    _, out = walk(rows)
    assert [o["reason"] for o in out[:1]] == ["insufficient_points"] or out[0]["reason"] == "insufficient_readings"
    assert [o["reason"] for o in out if o["t"] == 200_000] == ["accepted", "scan_before_state"]
    lost = [o for o in out if 2_000_000 <= o["t"] < 2_400_000]
    assert {o["reason"] for o in lost} == {"insufficient_points"} and {o["map_reason"] for o in lost} == {"registration_rejected"}
    assert [o["mode"] for o in lost] == ["predicted", "held", "held", "held"]
    off = {o["t"]: np.linalg.norm(np.array([o["px"], o["py"], o["pz"]]) - truth[o["t"]]) for o in out if o["t"] in truth}
    assert off[6_000_000] < 0.1  # found again
    quiet = odometry.follow(HOW)()
    run, step = quiet
    assert step(run, scan)[1][0]["reason"] == "waiting_for_start"
    for k in range(5000):  # readings alone don't gather
        run, _ = step(run, {**rows[0], "t": k * 10_000})
    assert len(run.readings) < 1100


def test_start_from_rest():
    """A tilted body at rest: its turn comes from gravity."""
    tilt = lie.rotation(np.array([0.2, -0.1, 0.0]))
    rest = dict(zip(("ax", "ay", "az"), map(float, tilt.T @ [0, 0, 9.8]), strict=True))
    rows = [{**NONE, "run": 1, "kind": "imu", "t": k * 10_000, "wx": 0.01, "wy": 0.0, "wz": -0.02, **rest} for k in range(30)]
    rows.append({**NONE, "run": 1, "kind": "scan", "t": 290_000, "points": []})
    run, out = walk(rows, first=None)
    up = run.state.rotation @ np.array(list(rest.values()))
    assert np.abs(up / np.linalg.norm(up) - [0, 0, 1]).max() < 1e-6
    assert np.abs(run.state.gyro_bias - [0.01, 0, -0.02]).max() < 1e-9


@pytest.mark.parametrize("seed", [1, 2])
def test_ladders_say_the_same_of_rows_and_columns(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(300):
        near = lambda a, b: float(rng.choice([a, b, (a + b) / 2]))
        rows.append({"id": k, "used": int(rng.choice([50, 150, 900])), "linearised": bool(rng.random() < 0.95), "converged": bool(rng.random() < 0.9), "ratio": near(0.2, 0.6), "rmse": float(rng.choice([0.05, 0.14, 0.2, 0.3, math.nan])), "normalised": near(1.0, 3.5),
            "directions": int(rng.choice([4, 5, 6])), "turn_directions": int(rng.choice([2, 3])), "yaw_share": near(0.3, 0.9), "shift": near(0.5, 2.5), "turn": near(1, 20), "turn_nis": near(1, 20), "yaw_total": float(rng.choice([-4, 0, 2, 4])), "correction_shift": near(0.1, 1.2),
            "correction_turn": near(1, 6), "degenerate": bool(rng.random() < 0.3), "yaw_limited": bool(rng.random() < 0.1), "trusted": bool(rng.random() < 0.9), "keyframe": bool(rng.random() < 0.7)})
    rows[0]["rmse"] = None
    df = spark.createDataFrame(rows)
    easy = gates.Registration(least=10, max_rmse=0.29, max_shift=9, max_turn=99, max_turn_nis=99, max_yaw_total=9, max_correction_shift=9)
    for g in (gates.Registration(), easy):
        want = {r.id: r.reason for r in df.select("id", gates.registration_reason(g).alias("reason")).collect()}
        assert {r["id"]: gates.reason_of(gates.registration_rules(g), r, "accepted") for r in rows} == want and len(set(want.values())) > 4
    for g in (gates.Insertion(), gates.Insertion(directions=0, turn_directions=0, yaw_share=0, max_normalised=0, converged=False, max_shift=0, max_turn=0)):
        want = {r.id: r.reason for r in df.select("id", gates.insertion_reason(g).alias("reason")).collect()}
        assert {r["id"]: gates.reason_of(gates.insertion_rules(g), r, "updated") for r in rows} == want and len(set(want.values())) > 2


def test_query_batch_and_stream(spark, sf, tmp_path):
    """The registered runs stay near their known motion; a stream of shuffled files gives the same rows as the batch."""
    v = Views(spark, sf)
    rows, known = inertia.drive(v)
    rows = rows.filter("run < 4").persist()
    schema = f"run long, id long, t long, rank int, {odometry.OUTPUT}"
    fold = odometry.follow(inertia.DRIVE, first=inertia.DRIVE_START)
    batch = folds.fold(rows, ["run"], ["t", "rank", "id"], fold, schema).collect()
    off = known.filter("run < 4").collect()
    off = {(r.run, r.id): (r.gx, r.gy) for r in off}
    assert len(batch) > 20 and sum(r.accepted for r in batch) > 0.9 * len(batch)
    assert max(math.dist((r.px, r.py, r.pz), (*off[r.run, r.id], 1.0)) for r in batch) < 0.1
    times = [r.t for r in rows.select("t").distinct().orderBy("t").collect()]
    for k in range(3):
        lo, hi = times[k * len(times) // 3], times[min(len(times), (k + 1) * len(times) // 3) - 1]
        rows.filter((F.col("t") >= lo) & (F.col("t") <= hi)).orderBy(F.xxhash64("id", "rank")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = rows.filter("kind = 'imu'").dropDuplicates(["run"]).withColumns({"t": F.lit(10**12), "id": F.lit(-1).cast("long")})
    last.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ordered.read_files(spark, f"{tmp_path}/in", rows, 1)
    got = ordered.run_to_end(ordered.ordered_fold(stream, ["run"], "t", ["t", "rank", "id"], fold, schema, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state").collect()
    key = lambda r: (r.run, r.t, r.reason, r.map_reason, r.cells, r.used, round(r.px, 9), round(r.py, 9), round(r.pz, 9))
    assert sorted(map(key, got)) == sorted(map(key, batch))
    rows.unpersist()


def test_scan_points_are_never_shuffled(spark, sf):
    """Points of scans are made after the shuffle and sort by run; their means of cells and slices are those of scan_rows()."""

    def shuffled(plan):
        own = [plan.output().mkString(",")] if plan.nodeName() in ("RepartitionByExpression", "Sort", "Aggregate") else []
        return own + [o for k in range(plan.children().size()) for o in shuffled(plan.children().apply(k))]

    outputs = shuffled(QUERIES["EST4_scan_run"](spark, sf)._jdf.queryExecution().optimizedPlan())
    assert len(outputs) > 1 and not any("points" in o or "before" in o for o in outputs)
    rng = np.random.default_rng(8)
    raw = np.c_[rng.uniform(-1, 1, (400, 3)), rng.uniform(0, 0.05, 400)]
    df = spark.createDataFrame([(1, *map(float, p)) for p in raw], "scan int, x double, y double, z double, before double").coalesce(1)
    [row] = odometry.scan_rows(df, ["scan"], 0.5, 0.01).collect()
    means = odometry.slice_means(raw, 0.5, 0.01)
    assert 100 < len(means) < 350 and np.allclose(means, [tuple(p) for p in row.points], atol=1e-12)


def test_scans_come_as_records(spark):
    """Points made late reach the step as NumPy records, with rows of none, and give what a list of them gives; lists with nulls stay lists."""
    point = pa.struct([(c, pa.float64()) for c in ("x", "y", "z", "before")])
    lists = [[{"x": 1.0, "y": 2.0, "z": 3.0, "before": 0.1}, {"x": -1.0, "y": 0.5, "z": math.nan, "before": 0.0}], None, [], [{"x": 4.0, "y": 5.0, "z": 6.0, "before": 0.2}]]
    batch = pa.RecordBatch.from_arrays([pa.array(lists, pa.list_(point))], ["points"]).slice(0)
    for some, want in ((batch, lists), (batch.slice(1), lists[1:]), (batch.slice(0, 1), lists[:1])):
        got = [r["points"] for r in folds._rows(some, ["points"])]
        assert [g if g is None else [repr(tuple(p)) for p in g.tolist()] for g in got] == [w if w is None else [repr(tuple(p.values())) for p in w] for w in want]
        assert all(g is None or g.dtype.names == ("x", "y", "z", "before") for g in got)
    holed = pa.RecordBatch.from_arrays([pa.array([[None, lists[0][0]], [lists[0][0] | {"z": None}]], pa.list_(point))], ["points"])
    assert [r["points"] for r in folds._rows(holed, ["points"])] == [[None, lists[0][0]], [lists[0][0] | {"z": None}]]


def test_planes_are_looked_up_once_a_cell(monkeypatch):
    """Points get the plane with the nearest mean of the 27 cells around theirs; the keys searched are those of the cells, not of the points."""
    rng = np.random.default_rng(5)
    held = odometry.VoxelMap(1.0, odometry.Voxel())
    for _ in range(30):
        held.insert(rng.uniform(-4, 4, (300, 3)) * [1, 1, 0.02] + rng.integers(-2, 3, (300, 1)) * [0, 0, 1.0])
    points = rng.uniform(-5, 5, (2000, 3))
    looked = []
    plain = np.searchsorted
    with monkeypatch.context() as m:
        m.setattr(np, "searchsorted", lambda a, v, *more: looked.append(np.size(v)) or plain(a, v, *more))
        found, normal, mean, variance = held.planes(points)
    cells = {tuple(c) for c in np.floor(points).astype(int)}
    assert max(looked) <= max(27 * len(cells), len(points)) < 27 * len(points)
    places = {int(k): n for n, k in enumerate(held.key)}
    for row, p in enumerate(points):
        c = np.floor(p).astype(np.int64)
        around = [places.get(int(held._keys(c + [i, j, k])), -1) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
        best = min(((float(np.linalg.norm(held.mean[n] - p)), n) for n in around if n >= 0 and held.plane[n]), default=None)
        assert found[row] == (best is not None)
        if best:
            assert np.array_equal(normal[row], held.normal[best[1]]) and np.array_equal(mean[row], held.mean[best[1]]) and variance[row] == held.thin[best[1]] / held.n[best[1]]
    assert 100 < found.sum() < len(points)
