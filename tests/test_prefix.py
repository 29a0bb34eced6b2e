"""Runs folded in chunks against the sequential fold."""

import math
import random

import numpy as np
import pytest

from waymark.functions import lie
from waymark.operators import folds, inertial, prefix

INERTIAL = ["wx", "wy", "wz", "ax", "ay", "az"]
SCHEMA = "run long, id long, t long, v double"


def rows_of(rng, runs):
    out = []
    for run, n in runs:
        t = 10**15
        for k in range(n):
            t += rng.choice([20_000, 20_000, 20_000, 0, 900_000])
            out.append((run, k, t, rng.uniform(-2, 2)))
    return out


def close(a, b, keys, digits=8):
    assert len(a) == len(b)
    for x, y in zip(sorted(a, key=keys), sorted(b, key=keys), strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == q or (isinstance(p, float) and (math.isclose(p, q, rel_tol=10**-digits, abs_tol=10**-digits))), (x, y)


@pytest.mark.parametrize("runs", [[(1, 6400)], [(None, 700), (1, 1), (2, 5), (3, 2000), (4, 3)], [(k, 7) for k in range(60)], []])
def test_chunks_equal_the_sequential_fold(spark, runs):
    df = spark.createDataFrame(rows_of(random.Random(1), runs), SCHEMA).repartition(5)
    key = lambda r: (r.run is not None, r.run or 0, r.id)
    for how, plain, more in ((prefix.running_mean("v", 20, "m"), folds.running_mean("v", 20, "m"), "m double, n long"), (prefix.preintegrate("t", "v", 500_000), folds.preintegrate("t", "v", 500_000), "dv double, dp double")):
        got = prefix.fold(df, ["run"], ["t", "id"], how, f"{SCHEMA}, {more}", parts=64)
        assert not runs or got.rdd.getNumPartitions() == 64
        close(got.collect(), folds.fold(df, ["run"], ["t", "id"], plain, f"{SCHEMA}, {more}").collect(), key)


def test_one_run_over_64_tasks(spark):
    df = spark.createDataFrame(rows_of(random.Random(2), [(1, 6400)]), SCHEMA)
    got = prefix.fold(df, ["run"], ["t", "id"], prefix.running_mean("v", 20, "m"), f"{SCHEMA}, m double, n long", parts=64)
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 6400 and sum(n > 0 for n in sizes) >= 60 and max(sizes) < 400


def test_propagation_in_chunks(spark):
    """Places, turns and covariances of an inertial run with gaps and missing readings."""
    rng = random.Random(3)
    rows, t = [], 0
    for k in range(1500):
        t += rng.choice([10_000, 10_000, 10_000, 10_000, 0, 300_000])
        reading = [rng.uniform(-1, 1) for _ in range(3)] + [rng.uniform(-2, 2), rng.uniform(-2, 2), 9.81 + rng.uniform(-2, 2)]
        if rng.random() < 0.03:
            reading[rng.randrange(6)] = rng.choice([None, math.inf, math.nan])
        rows.append((1 if k < 1300 else 2, k, t, *reading))
    schema = "run long, id long, t long, " + ", ".join(f"{c} double" for c in INERTIAL)
    more = "mode string, " + ", ".join(f"{c} double" for c in ("px", "py", "pz", "vx", "vy", "vz", "rx", "ry", "rz", "turn_sigma", "place_sigma", "velocity_sigma"))
    df = spark.createDataFrame(rows, schema)
    start = inertial.State(rotation=lie.rotation([0.1, -0.3, 0.5]), velocity=np.array([1.0, -2, 0.5]), gyro_bias=np.array([0.01, 0.0, -0.02]))
    how, plain = (f("t", 1e6, inertial.Noise(), start) for f in (prefix.inertial_propagation, inertial.inertial_fold))
    got = prefix.fold(df, ["run"], ["t", "id"], how, f"{schema}, {more}", parts=40).select("run", "id", *[x.split()[0] for x in more.split(", ")]).collect()
    want = folds.fold(df, ["run"], ["t", "id"], plain, f"{schema}, {more}").select("run", "id", *[x.split()[0] for x in more.split(", ")]).collect()
    close(got, want, lambda r: (r.run, r.id), digits=6)
    assert {r.mode for r in got} == {"start", "gap", "propagated"}


@pytest.mark.parametrize("how", [prefix.running_mean("v", 9, "m"), prefix.preintegrate("t", "v", 500_000)])
def test_summaries_are_associative(how):
    rng = random.Random(4)
    rows = [dict(zip(("run", "id", "t", "v"), r, strict=True)) for r in rows_of(rng, [(1, 60)])]
    cuts = [0, 13, 14, 40, 60]
    parts = [how.summarise(iter(rows[a:b]), rows[a - 1] if a else None, a) for a, b in zip(cuts, cuts[1:])]
    a, b, c, d = parts
    left, right = how.compose(how.compose(how.compose(a, b), c), d), how.compose(a, how.compose(b, how.compose(c, d)))
    state, step = how.start()
    for r in rows:
        state, _ = step(state, r)
    for summary in (left, right, how.summarise(iter(rows), None, 0)):
        assert all(math.isclose(x, y, abs_tol=1e-9) for x, y in zip(how.advance(how.start()[0], summary), state, strict=True))
