"""Invariants and small cases of operators against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import pose, scalars
from waymark.operators import asof, backend, folds, graph, grid, near, raster, search, select, stats, windows
from waymark.sources import clouds, sinks, text


def test_results_do_not_depend_on_partitions(spark, sf):
    from waymark.catalog import QUERIES

    name = "AG4_vote_fusion"
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(tuple, QUERIES[name](spark, sf).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows[0] == rows[1] and rows[0]


def test_nearest_equals_brute_force(spark):
    rng = random.Random(1)
    left = [(k % 3, k, rng.randrange(1000)) for k in range(120)]
    right = [(k % 3, k, rng.randrange(1000), float(k)) for k in range(80)]
    got = asof.nearest(spark.createDataFrame(left, "run long, id long, t long"), spark.createDataFrame(right, "run long, id long, t long, v double"), ["run"], "t", 25, "id", "id", ["v"])
    for r in got.collect():
        best = min(((abs(t - r.t), t, i, v) for k, i, t, v in right if k == r.run and abs(t - r.t) <= 25), default=None)
        assert (r.match_dt, r.match_time, r.match_id, r.match_v) == (best or (None, None, None, None))


def test_interpolation_edges(spark):
    right = spark.createDataFrame([(1, 1, 10, 1.0), (1, 2, 20, 3.0), (1, 3, 100, 5.0)], "run long, id long, t long, x double")
    left = spark.createDataFrame([(1, k, t) for k, t in enumerate([5, 7, 10, 15, 20, 60, 103, 120])], "run long, id long, t long")
    got = {r.t: r.x for r in asof.interpolate(left, right, ["run"], "t", "id", "x", 30, 4, "id").collect()}
    assert got == {5: None, 7: 1.0, 10: 1.0, 15: 2.0, 20: 3.0, 60: None, 103: 5.0, 120: None}


def test_grid_nearest_equals_brute_force(spark):
    rng = random.Random(2)
    a, b = ([(k, rng.uniform(-50, 50), rng.uniform(-50, 50)) for k in range(150)] for _ in range(2))
    got = {r.a: (r.b, round(r.distance, 9)) for r in near.grid_nearest(spark.createDataFrame(a, "a long, x double, y double"), spark.createDataFrame(b, "b long, x double, y double"), 9.0, "a", "b").collect()}
    want = {}
    for i, x, y in a:
        d, j = min((math.hypot(x - u, y - w), j) for j, u, w in b)
        if d < 9:
            want[i] = (j, round(d, 9))
    assert got == want


def test_fold_order_and_empty(spark):
    rows = [(1, 3, 0.0), (1, 1, 0.0), (1, 2, 0.0), (2, 1, 0.0)]
    df = spark.createDataFrame(rows, "k long, t long, x double").repartition(3)
    step = lambda: ([], lambda s, r: ([*s, r["t"]], [{"k": r["k"], "seen": str([*s, r["t"]])}]))
    got = sorted((r.k, r.seen) for r in folds.fold(df, ["k"], ["t"], step, "k long, seen string").collect())
    assert got == [(1, "[1, 2, 3]"), (1, "[1, 2]"), (1, "[1]"), (2, "[1]")]
    assert folds.fold(df.limit(0), ["k"], ["t"], step, "k long, seen string").count() == 0


@pytest.mark.parametrize("n", [1, 7, 40, 100])
def test_even_subsample_is_exact(spark, n):
    df = spark.range(100).select(F.lit(1).alias("k"), "id")
    for keys in (["k"], []):
        got = sorted(r.id for r in select.even_subsample(df, n, keys, ["id"]).collect())
        assert got == ([i * 100 // n for i in range(n)] if n < 100 else list(range(100)))


def test_components_of_chain_and_lone_nodes(spark):
    nodes = spark.range(40).withColumnRenamed("id", "node")
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 20)] + [(30, 35), (35, 38)], "a long, b long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert all(got[k] == 0 for k in range(21)) and got[38] == 30 and got[25] == 25


def test_pose_algebra(spark):
    rng = np.random.default_rng(3)
    rows = [[float(x) for x in rng.normal(size=6)] for _ in range(30)]
    df = spark.createDataFrame(rows, "a double, b double, c double, x double, y double, z double")
    w, v = tuple(F.col(c) for c in "abc"), tuple(F.col(c) for c in "xyz")
    q = pose.exp(w)
    back, turned = pose.log(q), pose.rotate(pose.conjugate(q), pose.rotate(q, v))
    for r in df.select("*", *[c.alias(f"l{k}") for k, c in enumerate(back)], *[c.alias(f"t{k}") for k, c in enumerate(turned)]).collect():
        angle = math.sqrt(r.a**2 + r.b**2 + r.c**2)
        if angle < math.pi:
            assert np.allclose([r.l0, r.l1, r.l2], [r.a, r.b, r.c], atol=1e-9)
        assert np.allclose([r.t0, r.t1, r.t2], [r.x, r.y, r.z], atol=1e-9)


def test_kabsch_recovers_motion(spark):
    rng = np.random.default_rng(5)
    a = rng.normal(size=(50, 3))
    c, s = math.cos(0.7), math.sin(0.7)
    rot = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]])
    b = a @ rot.T + [1, -2, 3]
    df = spark.createDataFrame([[1, *map(float, p), *map(float, q)] for p, q in zip(a, b)], "k long, ax double, ay double, az double, bx double, by double, bz double")
    r = graph.kabsch(graph.cross_sums(df, ["k"]), ["k"]).first()
    assert np.allclose([r.yaw, r.angle, r.tx, r.ty, r.tz], [0.7, 0.7, 1, -2, 3], atol=1e-9)


def test_planar_fit_and_registration(spark):
    rng = random.Random(6)
    points = [(1, k, rng.uniform(-30, 30), rng.uniform(-30, 30), 1) for k in range(80)]
    c, s = math.cos(0.03), math.sin(0.03)
    moved = [(1, k, c * x - s * y + 0.4, s * x + c * y - 0.2, 1) for _, k, x, y, _ in points]
    a = spark.createDataFrame(points, "pair long, id long, x double, y double, label int")
    b = spark.createDataFrame(moved, "pair long, other long, x double, y double, label int")
    start = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "pair long, yaw double, dx double, dy double")
    r = search.match_keyframes(a, b, ["pair"], start, 3.0, 10, 0.5).first()
    assert np.allclose([r.yaw, r.dx, r.dy], [0.03, 0.4, -0.2], atol=1e-6) and r.reason == "accepted"


def test_solved_chain_meets_consistent_edges(spark):
    edges = spark.createDataFrame([(1, k, k + 1, 0.5, False) for k in range(1, 10)] + [(1, 1, 6, 2.5, True)], "run long, i long, j long, dx double, loop boolean")
    got = {r.k: r.x for r in graph.solve_chain(edges, ["run"]).collect()}
    assert all(abs(got[k] - 0.5 * (k - 1)) < 1e-9 for k in range(1, 11))


def test_morphology_and_distance(spark):
    cells = [(x, y, float(x == 5 and y == 5)) for x in range(10) for y in range(10)]
    df = spark.createDataFrame(cells, "ix long, iy long, v double")
    k = raster.kernel(1)
    assert raster.dilate(df, k, "v", df).filter("v = 1").count() == 9
    assert raster.closed(df, k, "v").filter("v = 1").count() == 1 and raster.opened(df, k, "v").filter("v = 1").count() == 0
    d = {(r.ix, r.iy): r.distance for r in raster.distance_to(df, df.filter("v = 1"), 3).collect()}
    assert d[5, 5] == 0 and abs(d[7, 6] - math.hypot(2, 1)) < 1e-12 and d[0, 0] == 3


def test_windows(spark):
    df = spark.createDataFrame([(1, k, k * 10, float(v)) for k, v in enumerate([1, 9, 2, 8, 3])], "run long, id long, t long, v double")
    got = {r.id: (r.bias, r.mad) for r in windows.trailing_robust(df, ["run"], "t", "v", 20, 2, 0.0).collect()}
    for k, (bias, mad) in got.items():
        own = [[1, 9, 2, 8, 3][j] for j in range(max(0, k - 2), k + 1)]
        assert bias == np.median(own) and mad == np.median(np.abs(np.array(own) - bias))
    assert windows.count_windows(df, ["run"], ["t"], 2).count() == 4


def test_saturation_and_votes(spark):
    df = spark.createDataFrame([(k, 1.0, -1.0, 0.2, 3, 1.0) for k in range(3)], "id long, x double, y double, z double, label int, conf double")
    r = grid.saturating_occupancy(df, 0.5, 0.2).first()
    assert r.occ > 0.35 and r.label == 3
    v = grid.vote_fusion(df, 0.5, [1, 2, 3], 2.0, 0.0).first()
    assert v.label == 3 and v.n == 3


def test_decoding(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 300, 1.5), (2, float("nan"), 0.0, 0.0, 1, 0.5), (3, 1.0, None, 0.0, 1, 0.5)], "id long, x double, y double, z double, semantic int, score double")
    assert [tuple(r) for r in clouds.decode(df, ["id"]).collect()] == [(1, 1.0, 2.0, 3.0, 255, 1.0)]
    assert clouds.decode(df.drop("z"), ["id"]).count() == 0
    assert backend._normal({"labels": [1, 2]}, 2)[1].tolist() == [1, 1]
    with pytest.raises(ValueError):
        backend._normal([1], 2)


def test_files(spark, tmp_path):
    poses = spark.createDataFrame([(float(k), k / 3, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for k in range(20)], ", ".join(f"{c} double" for c in ("t", "x", "y", "z", "qx", "qy", "qz", "qw")))
    sinks.write_trajectory(poses, f"{tmp_path}/tum")
    back = text.read_tum(spark, f"{tmp_path}/tum")
    assert back.count() == 20 and abs(back.agg(F.max("x")).first()[0] - 19 / 3) < 1e-9
    with pytest.raises(ValueError):
        spark.createDataFrame([("# nothing",)], "value string").write.text(f"{tmp_path}/none")
        text.read_tum(spark, f"{tmp_path}/none")
    points = spark.createDataFrame([(1.0, 2.0, 3.0, 3, 0.5)] * 10, "x double, y double, z double, label int, conf double").coalesce(1)
    (name,) = sinks.write_ply(points, f"file://{tmp_path}/ply")
    raw = open(f"{tmp_path}/ply/{name}", "rb").read()
    assert b"element vertex 10\n" in raw and len(raw.split(b"end_header\n", 1)[1]) == 10 * 20


def test_statistics(spark):
    df = spark.createDataFrame([(1, float(v), 1.0) for v in (1, 2, 3, 4)] + [(2, 5.0, 0.34)], "k long, v double, w double")
    got = {r.k: (r.median, r.mad) for r in stats.median_mad(df, ["k"], "v").collect()}
    assert got == {1: (2.5, 1.0), 2: (5.0, 0.0)}
    assert {r.k: r.median for r in stats.replicated_median(df, ["k"], "v", "w", 3).collect()} == {1: 2.5, 2: 5.0}
    assert [r.a for r in spark.createDataFrame([(7.0,), (-7.0,), (3.0,)], "v double").select(F.round(scalars.wrap_angle(F.col("v")), 6).alias("a")).collect()] == [round(math.remainder(v, 2 * math.pi), 6) for v in (7.0, -7.0, 3.0)]


def test_optimised_map_does_not_depend_on_partitions(spark):
    """Sums of a voxel run in the order of frame and id: those of a plain loop, to the last bit."""
    import random

    rng = random.Random(5)
    rows = [(k % 4, k, rng.uniform(0, 6), rng.uniform(0, 6), 10.0 ** rng.randint(-9, 0), 1 + k % 2, rng.uniform(0.1, 1)) for k in range(300)]
    poses = spark.createDataFrame([(f, 0.0, 0.0, 0.0, 0.0) for f in range(4)], "frame long, px double, py double, pz double, yaw double")
    w = z = 0.0
    for r in sorted(rows):
        w, z = w + r[6], z + r[4] * r[6]
    for parts in (1, 7, 23):
        df = spark.createDataFrame(rows, "frame long, id long, x double, y double, z double, label int, conf double").repartition(parts, "id")
        got = grid.optimised_map(df, poses, "frame", "id", 6, 2000).collect()
        assert [(r.n, r.z) for r in got] == [(300, z / w)]
