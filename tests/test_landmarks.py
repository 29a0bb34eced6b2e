"""The landmark map against plain loops over dictionaries, and on the fixture's image."""

import math

import numpy as np
import pytest

from waymark.operators import landmarks
from waymark.operators.landmarks import Landmarks
from waymark.plans import composites
from waymark.plans.views import Views


def at(image, x, y):
    """Between four pixels of a dictionary by (v, u); NaN where one isn't there."""
    i, j = math.floor(x), math.floor(y)
    a, b = x - i, y - j
    four = [image.get((j + q, i + p), math.nan) for q in (0, 1) for p in (0, 1)]
    return (1 - b) * ((1 - a) * four[0] + a * four[1]) + b * ((1 - a) * four[2] + a * four[3])


def plain(rows, how, time):
    """One run by loops: rows of the frames and the landmarks at the end."""
    kept, out, count = {}, [], 0
    for row in rows:
        image = {divmod(a, how.width): float(x) for a, x in zip(row["at"], row["values"], strict=True)}
        names = {divmod(a, how.width): x for a, x in zip(row["at"], row["labels"], strict=True)}
        mask = {divmod(a, how.width) for a, x in zip(row["at"], row["masked"], strict=True) if x}
        t, here = float(row[time]), row["p"]

        def see(p):
            q = [p[i] - here[i] for i in range(3)]  # the camera's axes are the body's and the world's
            if not how.min_depth <= q[2] <= how.max_depth:
                return None
            return how.fx * q[0] / q[2] + how.cx, how.fy * q[1] / q[2] + how.cy, q[2]

        def nearest(x, y):
            r = lambda w: int(math.copysign(math.floor(abs(w) + 0.5), w))
            return r(y), r(x)

        def worth(label):
            return how.weights[label] if label < len(how.weights) else how.weights[0]

        def inner(x, y):
            b = how.half + 2
            return b <= x < how.width - b and b <= y < how.height - b

        def patch(x, y):
            if not inner(x, y):
                return None
            raw = [at(image, x + i, y + j) for j in range(-how.half, how.half + 1) for i in range(-how.half, how.half + 1)]
            mean = sum(raw) / len(raw)
            s = math.sqrt(sum((r - mean) ** 2 for r in raw) / len(raw))
            return [(r - mean) / s for r in raw] if s >= how.min_deviation else None

        def slope(x, y):
            def sobel(v, u, du, dv):
                m = lambda w, n: -w if w < 0 else 2 * (n - 1) - w if w >= n else w
                g = lambda v, u: image.get((m(v, how.height), m(u, how.width)), math.nan)
                return sum(w * (g(v + dv + k * du, u + du + k * dv) - g(v - dv + k * du, u - du + k * dv)) for k, w in ((-1, 1), (0, 2), (1, 1))) / 8

            corners = [(math.floor(y) + q, math.floor(x) + p) for q in (0, 1) for p in (0, 1)]
            gx = at({c: sobel(*c, 1, 0) for c in corners}, x, y)
            gy = at({c: sobel(*c, 0, 1) for c in corners}, x, y)
            return math.hypot(gx, gy)

        def cell(x, y):
            return int(y / how.grid) * (how.width // how.grid) + int(x / how.grid)

        def voxel(p):
            return tuple(math.floor(c / how.voxel) for c in p)

        grid, hidden = {}, 0
        for i, m in kept.items():
            s = see(m["p"])
            if s and inner(*s[:2]):
                spot = nearest(*s[:2])
                if spot in mask or worth(names.get(spot, 0)) <= 0 or m["w"] <= 0:
                    hidden += 1
                elif cell(*s[:2]) not in grid or (s[2], i) < grid[cell(*s[:2])]:
                    grid[cell(*s[:2])] = (s[2], i)
        active = sorted((i for _, i in grid.values()), key=lambda i: (-kept[i]["w"] * (1 + min(10, kept[i]["n"])), i))[: how.max_active]
        confirmed, total = set(), 0.0
        for i in active:
            now = patch(*see(kept[i]["p"])[:2])
            ncc = sum(a * b for a, b in zip(now, kept[i]["patch"], strict=True)) / len(now) if now else -1
            if ncc >= how.min_ncc:
                confirmed.add(i)
                total += ncc
        reason = "compared" if kept else "map_empty"
        for i, m in kept.items():
            s = see(m["p"])
            spot = s and nearest(*s[:2])
            if s and (spot in mask or worth(names.get(spot, 0)) <= 0):
                m["w"], m["missed"] = 0.0, how.max_missed + 1
            elif s and i in confirmed:
                m["missed"], m["n"], m["seen"] = 0, m["n"] + 1, t
                if names.get(spot, 0):
                    m["label"], m["w"] = names[spot], worth(names[spot])
                if row["accepted"] and m["n"] % how.refresh == 0:
                    m["patch"] = patch(*s[:2]) or m["patch"]
            else:
                m["missed"] += 1
        stay = {i: m for i, m in kept.items() if m["missed"] <= how.max_missed and math.dist(m["p"], here) <= how.radius}
        best = sorted(stay, key=lambda i: (-stay[i]["n"], -stay[i]["seen"], i))[: how.max_landmarks]
        culled, kept = len(kept) - len(best), {i: stay[i] for i in sorted(best)}
        voxels, cells = {voxel(m["p"]) for m in kept.values()}, {cell(*s[:2]) for m in kept.values() if (s := see(m["p"]))}
        offers, known = [], set()
        for k, g in enumerate(row["points"] or []):
            p = (g["x"], g["y"], g["z"])
            if voxel(p) in known:
                continue
            known.add(voxel(p))
            w = min(2.0, max(0.0, g["weight"])) if g["weight"] is not None else 1.0
            s = see(p)
            if w <= 0 or voxel(p) in voxels or not s or not inner(*s[:2]):
                continue
            spot = nearest(*s[:2])
            image_w = worth(names.get(spot, 0))
            if spot in mask or image_w <= 0 or cell(*s[:2]) in cells:
                continue
            if (d := slope(*s[:2])) >= how.min_gradient:
                offers.append((-d * w * image_w / math.sqrt(max(1.0, s[2])), k, p, s, w, names.get(spot, 0) or g["label"] or 0))
        new = 0
        for _, _, p, s, w, label in sorted(offers):
            if new >= how.max_new or len(kept) >= how.max_landmarks:
                break
            if cell(*s[:2]) in cells:
                continue
            cells.add(cell(*s[:2]))
            if voxel(p) in voxels:
                continue
            voxels.add(voxel(p))
            if (texture := patch(*s[:2])) is None:
                continue
            kept[count] = {"p": p, "patch": texture, "label": label, "w": w * worth(label), "n": 1, "seen": t, "missed": 0}
            count, new = count + 1, new + 1
        out.append({"reason": reason, "landmarks": len(kept), "compared": len(active), "confirmed": len(confirmed), "hidden": hidden, "seeded": new, "culled": culled, "ncc": total / len(confirmed) if confirmed else None})
    return out, kept


def walk(rows, how, time="k"):
    state, step = landmarks.keep_map(time, how)()
    out = []
    for row in rows:
        state, made = step(state, row)
        out += made
    return state, out


def check(rows, how, time="k"):
    state, got = walk(rows, how, time)
    want, kept = plain(rows, how, time)
    for g, w in zip(got, want, strict=True):
        assert {c: g[c] for c in w if c != "ncc"} == {c: x for c, x in w.items() if c != "ncc"}
        assert g["ncc"] == w["ncc"] or abs(g["ncc"] - w["ncc"]) < 1e-6
    assert state.ids.tolist() == list(kept)
    for k, m in enumerate(kept.values()):
        assert (state.labels[k], state.observations[k], state.missed[k]) == (m["label"], m["n"], m["missed"])
        assert abs(state.weights[k] - m["w"]) < 1e-9 and np.abs(state.patches[k] - m["patch"]).max() < 1e-6
    return got


def test_queries_against_loops(spark, sf):
    v = Views(spark, sf)
    rows = [r.asDict(recursive=True) for r in composites.wall_frames(v).collect()]
    got = {(r["run"], r["k"]): r for r in composites.vis3_map(v).collect()}
    ends = [(r["run"], r["landmark"], r["observations"]) for r in composites.vis3_landmarks(v).collect()]
    assert len(got) == len(rows) == 64
    for run in range(4):
        of = sorted((r for r in rows if r["run"] == run), key=lambda r: r["k"])
        want, kept = plain(of, composites.WALL, "k")
        for r, w in zip(of, want, strict=True):
            g = got[run, r["k"]]
            assert {c: g[c] for c in w if c != "ncc"} == {c: x for c, x in w.items() if c != "ncc"}
        assert sorted(e[1:] for e in ends if e[0] == run) == [(i, m["n"]) for i, m in kept.items()]
    total = {c: sum(r[c] for r in got.values()) for c in ("seeded", "culled", "confirmed", "hidden")}
    assert all(n > 20 for n in total.values()), total


@pytest.mark.parametrize("seed", range(3))
def test_limits_and_holes(seed):
    """Tight limits, an image with holes, points at several depths, a camera that moves through the scene."""
    rng = np.random.default_rng(seed)
    how = Landmarks(width=60, height=44, fx=40.0, fy=40.0, cx=30.0, cy=22.0, half=2, grid=5, max_landmarks=25, max_active=12, max_new=9, max_missed=2, refresh=2, min_ncc=0.3, voxel=0.3, radius=9.0)
    texture = rng.uniform(0, 255, (44, 60))
    rows = []
    for k in range(10):
        image = np.clip(texture + rng.normal(0, 25, texture.shape), 0, 255)
        there = np.flatnonzero(rng.random(texture.size) > 0.01)
        points = [dict(zip(("x", "y", "z"), map(float, p), strict=True)) | {"label": int(rng.integers(0, 9)), "weight": [None, 0.5, 1.0, 3.0, -1.0][int(rng.integers(5))]} for p in np.c_[rng.uniform(-3, 3, (120, 2)), rng.uniform(1, 8, 120)]]
        rows.append({"k": k, "q": [1.0, 0, 0, 0], "p": [0.02 * k, 0.0, 0.3 * (k // 4)], "accepted": bool(k % 2), "at": there.tolist(), "values": image.ravel()[there].tolist(), "labels": rng.choice([0, 1, 2, 5, 6, 8], len(there), p=[0.5, 0.2, 0.1, 0.05, 0.1, 0.05]).tolist(), "masked": (rng.random(len(there)) < 0.03).tolist(), "points": points})
    got = check(rows, how)
    assert max(g["landmarks"] for g in got) == 25 and sum(g["culled"] for g in got) > 10


def test_the_fixture_image():
    """A textured image whose grid of points is seeded, confirmed by the same image and hidden by a whole mask."""
    how = Landmarks(width=320, height=240, fx=220.0, fy=220.0, cx=160.0, cy=120.0, half=2, grid=12, min_gradient=1.0, min_deviation=2.0, min_ncc=0.95, voxel=0.05, radius=100.0)
    v, u = np.mgrid[:240, :320]
    values = ((37 * u + 17 * v + (u * v) % 251) % 256).ravel().tolist()
    points = [{"x": (c - 160) * 5 / 220, "y": (r - 120) * 5 / 220, "z": 5.0, "label": 0, "weight": None} for r in range(18, 222, 12) for c in range(18, 302, 12)]
    row = {"k": 0, "q": [1.0, 0, 0, 0], "p": [0.0, 0, 0], "accepted": False, "at": list(range(len(values))), "values": values, "labels": [0] * len(values), "masked": [False] * len(values), "points": points}
    state, out = walk([row, {**row, "k": 1, "points": None}, {**row, "k": 2, "masked": [True] * len(values)}], how)
    assert out[0]["reason"] == "map_empty" and out[0]["seeded"] > 100
    assert out[1]["confirmed"] == out[1]["compared"] == out[0]["seeded"] and out[1]["ncc"] > 0.999
    assert out[2]["compared"] == 0 and out[2]["hidden"] == out[0]["seeded"] == out[2]["culled"] and not len(state.ids)


def test_a_turned_camera_on_a_lever():
    """Pixels of points do not depend on whether the body or the camera is turned."""
    points = np.random.default_rng(1).uniform(-2, 2, (20, 3)) + [0, 0, 6]
    turned = ((0.0, -1.0, 0.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0))
    body = np.array(turned).T @ np.eye(3)
    a = landmarks.project(points, np.eye(3), np.zeros(3), Landmarks())
    b = landmarks.project(points @ body.T + [0.3, 0.1, 0.0], np.eye(3), np.zeros(3), Landmarks(rotation=turned, lever=(0.3, 0.1, 0.0)))
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def test_odd_frames(spark):
    """Frames without pixels, pose or points change nothing; nulls, repeated and outside pixels and clashing names are defined; empty tables give none."""
    how = Landmarks(width=16, height=12, fx=10.0, fy=10.0, cx=8.0, cy=6.0, half=1, grid=4)
    good = {"q": [1.0, 0, 0, 0], "p": [0.0, 0, 0], "accepted": None, "at": [0, 1], "values": [1.0, 2.0], "labels": [0, 0], "masked": [False, False], "points": None}
    rows = [{"k": 0, **good, "at": None}, {"k": 1, **good, "q": None}, {"k": 2, **good, "p": [math.nan, 0, 0]}, {"k": 3, **good, "q": [0.0] * 4}, {"k": 4, **good}, {"k": 5, **good, "points": [None, {"x": None, "y": 1.0, "z": 2.0, "label": 1, "weight": 1.0}, {"x": math.inf, "y": 1.0, "z": 2.0, "label": None, "weight": math.nan}]}]
    state, out = walk(rows, how)
    assert [o["reason"] for o in out] == ["invalid_frame"] * 4 + ["map_empty"] * 2 and not len(state.ids)
    frames = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "run long, k long, values string")
    pixels = spark.createDataFrame([(1, 0, 0, 0, 5.0, None, None), (1, 0, 0, 0, 7.0, 1, True), (1, 0, 16, 0, 9.0, 1, True), (1, 0, 1, 0, None, 1, True), (1, 0, 3, 2, 4.0, 2, None)], "run long, k long, u int, v int, value double, label int, masked boolean")
    points = spark.createDataFrame([(1, 0, 9, 0.1, 0.1, 0.1, 3, 1.0), (1, 0, 4, 0.15, 0.1, 0.1, None, None), (1, 0, 5, None, 0.1, 0.1, 3, 1.0)], "run long, k long, id long, x double, y double, z double, label int, weight double")
    got = {r["run"]: r for r in landmarks.frame_rows(frames, pixels, points, ["run", "k"], how).collect()}
    assert (got[1]["at"], got[1]["values"], got[1]["labels"], got[1]["masked"]) == ([0, 35], [7.0, 4.0], [1, 2], [True, False])
    assert [tuple(p) for p in got[1]["points"]] == [(0.15, 0.1, 0.1, None, None)] and got[2]["at"] is None and got[2]["points"] is None
    assert landmarks.frame_rows(frames.limit(0), pixels, points, ["run", "k"], how).count() == 0
