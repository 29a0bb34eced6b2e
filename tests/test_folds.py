"""Queries that no SQL expresses, each against plain Python of its own."""

import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from waymark.catalog import QUERIES
from waymark.operators import folds, near
from waymark.plans import composites, streams
from waymark.plans.views import Views

H = 3_600_000_000


@pytest.fixture(scope="module")
def v(spark, sf):
    return Views(spark, sf)


def by_key(rows, key):
    out = {}
    for r in rows:
        out.setdefault(r[key], []).append(r)
    return out


def events(v):
    return by_key(sorted(streams.kinds(v).collect(), key=lambda r: (r.run, r.t, r.id)), "run")


def test_priority_drop(spark, sf, v):
    """A queue of five; over it the oldest view goes, else the oldest; every third row takes one out."""
    want = []
    for run, rows in events(v).items():
        queue = []
        for n, r in enumerate(rows, 1):
            queue.append(r)
            if len(queue) == 6:
                views = [q for q in queue if q.kind == "view"]
                gone = views[0] if views else queue[0]
                want.append((run, gone.id, 5))
                queue.remove(gone)
            if not n % 3:
                del queue[:1]
    assert sorted(map(tuple, QUERIES["ST4_priority_drop"](spark, sf).collect())) == sorted(want)


def test_state_eviction(spark, sf, v):
    want = []
    for run, rows in events(v).items():
        seen = {}
        for r in rows:
            old = sorted(k for k in seen if r.t - seen[k] > 200 * H)
            want += [(run, r.id, k, "ttl") for k in old]
            seen = {k: t for k, t in seen.items() if k not in old} | {r.id % 13: r.t}
            if len(seen) > 6:
                gone = sorted(seen, key=lambda k: (seen[k], k))[: len(seen) - 5]
                want += [(run, r.id, k, "size") for k in gone]
                seen = {k: t for k, t in seen.items() if k not in gone}
    assert sorted(map(tuple, QUERIES["ST9_state_eviction"](spark, sf).collect())) == sorted(want)


def test_pending_requests(spark, sf, v):
    want = []
    for rows in events(v).values():
        waiting = []
        for r in rows:
            want += [(q.id, "expired", None) for q in waiting if r.t - q.t > 40 * H]
            waiting = [q for q in waiting if r.t - q.t <= 40 * H]
            if r.kind == "click" and len(waiting) == 3:
                want.append((r.id, "refused", None))
            elif r.kind == "click":
                waiting.append(r)
            elif waiting:
                want.append((waiting.pop(0).id, "applied", r.id))
    assert sorted(map(tuple, QUERIES["ST13_pending_requests"](spark, sf).collect()), key=str) == sorted(want, key=str)


def test_head_pairing(spark, sf, v):
    """Two queues whose heads pair or lose the older one; looked at after every arrival."""
    rows = [(r.run, r.t, 0, r.id) for r in v.est.collect()] + [(r.run, r.t, 1, r.id) for r in v.gt.collect()]
    want = []
    for run in {r[0] for r in rows}:
        sides = ([], [])
        for _, t, side, ident in sorted(r for r in rows if r[0] == run):
            sides[side].append((t, ident))
            while sides[0] and sides[1]:
                (ta, a), (tb, b) = sides[0][0], sides[1][0]
                if abs(ta - tb) <= 8 * H:
                    want.append((a, 0, b, False))
                    sides[0].pop(0), sides[1].pop(0)
                else:
                    late = int(tb < ta)
                    want.append((sides[late].pop(0)[1], late, None, True))
    assert sorted(map(tuple, QUERIES["JN8_head_pairing"](spark, sf).collect()), key=str) == sorted(want, key=str)


def test_object_association(spark, sf, v):
    got = {r.id: r.object for r in QUERIES["EST12_object_association"](spark, sf).collect()}
    for rows in by_key(sorted(v.pts.filter("label <> 0").select("frame", "id", "label", "x", "y").collect(), key=lambda r: (r.frame, r.id)), "frame").values():
        objects = []  # label, x, y, observations
        for r in rows:
            d = [(math.hypot(o[1] - r.x, o[2] - r.y), k) for k, o in enumerate(objects) if o[0] == r.label]
            best = min(((x, k) for x, k in d if x < 12), default=None)
            if best is None and len(objects) < 60:
                objects.append([r.label, r.x, r.y, 0])
                best = (0, len(objects) - 1)
            assert got[r.id] == (None if best is None else best[1])
            if best is not None:
                o = objects[best[1]]
                o[3] += 1
                o[1], o[2] = o[1] + (r.x - o[1]) / min(20, o[3]), o[2] + (r.y - o[2]) / min(20, o[3])


def test_weighted_sample(spark, sf, v):
    def key(r):
        h = 42
        for raw in (struct.pack("<i", 1), struct.pack("<q", r.id)):
            h = xxhash.xxh64_intdigest(raw, seed=h)
        u = ((h - 2**64 if h >= 2**63 else h) % 2**30 + 1) / (2**30 + 1)
        return (-(u ** (1 / r.conf)), r.id)

    want = {(f, r.id) for f, rows in by_key(v.pts.select("frame", "id", "conf").collect(), "frame").items() for r in sorted(rows, key=key)[:10]}
    assert {(r.frame, r.id) for r in QUERIES["LIM12_weighted_sample"](spark, sf).collect()} == want


def test_diverse_top_k(spark, sf, v):
    """Cells grow, three times at most, until few enough are taken; the best point of each, then an even pick by id."""
    got = QUERIES["LIM3_diverse_top_k"](spark, sf).collect()
    points = v.pts.select("id", "x", "y", "z", "conf").collect()
    size = 4.0
    cells = lambda: by_key([{"cell": tuple(math.floor(a / size) for a in (r.x, r.y, r.z)), "r": r} for r in points], "cell")
    for _ in range(3):
        if len(cells()) <= 100:
            break
        size *= 1.35
    best = sorted(min((x["r"] for x in rows), key=lambda r: (-r.conf, r.id)).id for rows in cells().values())
    want = best if len(best) <= 100 else [best[i * len(best) // 100] for i in range(100)]
    assert sorted(r.id for r in got) == want


def test_voxel_planes(spark, sf, v):
    """Mean, scatter, exponential mean and plane of each voxel, from all points so far."""
    got = {r.id: r for r in QUERIES["EST7_voxel_update"](spark, sf).collect()}
    rows = v.sql("select id, x / 4 as x, y / 8 as y, case when id % 3 = 0 then 0.002 * label else z end as z from pts").collect()
    cells = by_key(sorted(({"c": tuple(math.floor(a / 4) for a in (r.x, r.y, r.z)), "id": r.id, "p": np.array([r.x, r.y, r.z])} for r in rows), key=lambda r: r["id"]), "c")
    planes = 0
    for points in cells.values():
        mean = cov = None
        plane = False
        for n, q in enumerate(points, 1):
            if not (plane and n > 20):
                if n <= 20:
                    batch = np.stack([x["p"] for x in points[:n]])
                    mean, cov = batch.mean(axis=0), np.cov(batch.T) if n > 1 else np.zeros((3, 3))
                else:
                    mean = mean + (q["p"] - mean) / 20
                    cov = 0.95 * cov + 0.05 * np.outer(q["p"] - mean, q["p"] - mean)
                values = np.linalg.eigvalsh(cov)
                plane = n >= 5 and values[1] >= 1e-3 and max(0, values[0]) <= 0.1 * values[1]
            g = got[q["id"]]
            assert g.n == min(n, 20) and np.abs(mean - [g.mx, g.my, g.mz]).max() < 2e-5 and g.plane == plane
            planes += plane
            if plane:
                normal = np.array([g.nx, g.ny, g.nz])
                assert abs(normal @ cov @ normal - values[0]) < 1e-4 and abs(np.linalg.norm(normal) - 1) < 1e-4
    assert planes > 100


def test_planar_controller_makes_its_features_once(spark, sf, v, monkeypatch):
    """Consensus, join and rounds read stored features; none of them makes them from the points again."""
    made, real = spark.sparkContext.accumulator(0), composites.false_matches

    def seen(w):
        made.add(1)
        return w

    monkeypatch.setattr(composites, "false_matches", lambda *a: real(*a).withColumn("w", F.udf(seen, "double")("w")))
    assert QUERIES["EST14_planar_controller"](spark, sf).count() == 64
    assert made.value == real(v, F.lit(0.0), F.lit(0.0), F.lit(0.0)).count()


def test_plane_controller(spark, sf, v):
    """The corrections follow each frame's true motion, where frames agree, by limited steps."""
    rows = {r.id: r for r in QUERIES["EST14_planar_controller"](spark, sf).collect()}
    for run in range(4):
        c, last, streak = np.zeros(3), None, 0
        for frame in range(run, 64, 4):
            truth = np.array([0.5 + (frame % 8) * 0.1, -0.4, (frame % 16) * 0.002])
            near_ = last is not None and np.hypot(*(truth - last)[:2]) <= 0.5 and abs(truth[2] - last[2]) <= 0.02
            streak, last = streak + 1 if near_ else 1, truth
            if streak >= 2:
                step = 0.4 * (truth - c)
                step[:2] *= min(1, 0.3 / max(1e-12, np.hypot(*step[:2])))
                c = c + [step[0], step[1], max(-0.01, min(0.01, step[2]))]
            r = rows[frame]
            assert r.reason == ("applied" if streak >= 2 else "streak") and r.streak == streak
            assert np.abs(np.array([r.cx, r.cy]) - c[:2]).max() < 0.1 and abs(r.ca - c[2]) < 0.005


def test_codes_in_blocks(spark, monkeypatch):
    """A code that many rows share is paired in blocks with the same result, and queries meet all items."""
    df = spark.createDataFrame([(k, 0 if k % 3 else k * 7919) for k in range(200)], "id long, w long")
    want = sorted(map(tuple, near.lsh_candidates(df, "id", F.col("w"), 3, 8, 2).collect()))
    monkeypatch.setattr(near, "BLOCK", 7)
    assert sorted(map(tuple, near.lsh_candidates(df, "id", F.col("w"), 3, 8, 2).collect())) == want and len(want) > 8000
    q, items = df.filter("id < 9").selectExpr("id as q", "id % 2 as k"), df.selectExpr("id as item", "id % 2 as k")
    assert sorted((r.q, r.item) for r in near.pairs_in_blocks(q, items, ["k"], 5).collect()) == [(a, b) for a in range(9) for b in range(200) if a % 2 == b % 2]


def test_association_looks_at_its_own_label_once(monkeypatch):
    """An observation measures its distance to each object of its label once; rows are numbers and nulls as Arrow has them."""
    looked = []
    hypot = math.hypot
    monkeypatch.setattr(folds.math, "hypot", lambda *a: looked.append(a) or hypot(*a))
    state, step = folds.associate(1.0, 60)()
    for k in range(60):
        state, [out] = step(state, {"id": k, "label": k % 6, "x": 10.0 * k, "y": 0.0})
        assert out["object"] == k
    looked.clear()
    state, [out] = step(state, {"id": 60, "label": 3, "x": 90.5, "y": 0.0})
    assert out["object"] == 9 and len(looked) == 10
    assert step(state, {"id": 61, "label": 3, "x": 95.0, "y": 0.0})[1][0]["object"] is None
    rows = [{"a": 1, "b": None, "c": 0.5, "d": "x", "e": True}, {"a": -(2**62) - 1, "b": 7, "c": math.inf, "d": None, "e": None}]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.float64()), ("d", pa.string()), ("e", pa.bool_())]))
    assert list(folds._rows(batch)) == rows and folds._batch(rows, batch.schema).equals(batch)


def test_association_leaves_no_observation_out():
    """Every observation gets an object, however many there are, the one that a plain look at all of them gives."""
    rng = random.Random(12)
    rows = [{"id": k, "label": rng.randint(1, 2), "x": rng.uniform(-40, 40), "y": float(rng.randint(-20, 20))} for k in range(3000)]
    rows += [{"id": 3000 + k, "label": 3, "x": x, "y": 0.0} for k, x in enumerate([0.0, 6.0, 3.0])]  # as far from one as from the other
    state, step = folds.associate(4.0)()
    objects: list[list] = []
    for row in rows:
        own = [(math.hypot(o[0] - row["x"], o[1] - row["y"]), k) for k, o in enumerate(objects) if o[3] == row["label"]]
        distance, k = min(own, default=(4.0, None))
        if distance >= 4.0:
            k = len(objects)
            objects.append([row["x"], row["y"], 0, row["label"]])
        o = objects[k]
        o[2] += 1
        for axis, name in enumerate("xy"):
            o[axis] += (row[name] - o[axis]) / min(20, o[2])
        state, [out] = step(state, row)
        assert out["object"] == k
    assert len(objects) > 200


def test_association_query_gives_all_an_object(spark, sf):
    """Observations that find the first 60 objects taken have one among all."""
    rows = QUERIES["EST12_object_association"](spark, sf).collect()
    assert any(r.object is None for r in rows) and all(r.object_all is not None for r in rows) and max(r.object_all for r in rows) >= 60
