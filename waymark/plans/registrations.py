"""Queries on the registration of keyframes and on normal equations.

Keyframe f is registered on itself seen from elsewhere: the second of a pair are the same
frame's points but for every fifth, moved by a motion that differs from frame to frame. What is
registered are features, means of cells, so a pair's task doesn't grow with the density of points.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.functions import scalars
from waymark.operators import equations, grid, registration
from waymark.plans.clouds import rounded
from waymark.plans.registry import query
from waymark.plans.views import Views

OTHER = 1000
GATES = registration.with_gates(lattice_xy=0.6, lattice_step=0.6, lattice_yaw=math.radians(1), lattice_turn=math.radians(1), coarse_points=200, reach=1.2, max_xy=4.0, max_yaw=math.radians(6))


#: Points of landmarks: one in each cell of four metres, at a place, height and label of its own, its points a centimetre around it.
LANDMARKS = """select frame, id, conf, floor(x / 4) * 4 + 0.7 + ((cix * 73 + ciy * 151) % 97) / 97.0 * 2.5 + (id % 21 - 10) / 1000.0 as x, floor(y / 4) * 4 + 0.7 + ((cix * 59 + ciy * 113) % 89) / 89.0 * 2.5 + (id % 19 - 9) / 1000.0 as y,
  ((cix * 31 + ciy * 17) % 29) / 10.0 as z, cast((cix * 5 + ciy * 3) % 7 as int) as label from (select *, cast(floor(x / 4) as bigint) as cix, cast(floor(y / 4) as bigint) as ciy from pts) p"""
#: Cells that a frame's points become features in.
FEATURE_CELL = 1.0


def features_of(points):
    """(frame, id, x, y, z, label, structural, conf) of each occupied cell of a frame: as many as the frame's extent has cells, however dense its points are."""
    cells = grid.keyframe_features(points, FEATURE_CELL, structural=(3, 4, 6), keys=["frame"])
    return cells.select("frame", (F.col("ix") * 1_000_000 + F.col("iy")).alias("id"), "x", "y", "z", "label", "structural", F.least(F.lit(1.0), F.col("n") / 10).alias("conf"))


def keyframes(v: Views):
    """Features (frame, id, x, y, z, label, structural, conf) of every frame and of its moved copy, each in cells of its own."""
    one = v.sql(LANDMARKS).withColumn("frame", F.col("frame").cast("long"))
    turn = (F.col("frame") % 5 - 2) * 0.01
    x, y = F.col("x") - (F.col("frame") % 3) * 0.3, F.col("y") + (F.col("frame") % 4) * 0.2
    moved = one.filter("id % 5 <> 0").select((F.col("frame") + OTHER).alias("frame"), "id", "conf", (F.cos(turn) * x + F.sin(turn) * y).alias("x"), (F.cos(turn) * y - F.sin(turn) * x).alias("y"), (F.col("z") - (F.col("frame") % 2) * 0.1).alias("z"), "label")
    return features_of(one.select(*moved.columns)).unionByName(features_of(moved))


def false_matches(v: Views, turn, dx, dy):
    """(frame, id, sx, sy, tx, ty, w): each frame's features and where a motion takes them; every third one is taken elsewhere."""
    rows = features_of(v.sql(LANDMARKS).withColumn("frame", F.col("frame").cast("long")))
    x, y = F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y") + dx, F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y") + dy
    return rows.select("frame", "id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.when(F.col("id") % 3 == 0, x + 3 + F.col("z")).otherwise(x).alias("tx"), y.alias("ty"), F.col("conf").alias("w"))


def pairs(v: Views):
    """Each frame and its copy, with a first guess that is off by some tenths of a metre."""
    frames = v.pts.select(F.col("frame").cast("long").alias("a")).distinct()
    return frames.select("a", (F.col("a") + OTHER).alias("b"), ((F.col("a") % 3) * 0.3 + 0.2).alias("x"), (-(F.col("a") % 4) * 0.2 - 0.1).alias("y"), F.lit(0.0).alias("z"), ((F.col("a") % 5 - 2) * 0.01).alias("yaw"))


def registered(v: Views, method: str):
    return registration.register_pairs(keyframes(v), pairs(v), method, GATES)


@query("OPT2_feature_alignment")
def opt2(v: Views):
    return rounded(registered(v, "align"), 4)


@query("OPT3_coarse_relative")
def opt3(v: Views):
    return rounded(registered(v, "regrid"), 4)


@query("OPT6_ransac")
def opt6(v: Views):
    """Consensus of mutual matches and its robust fit."""
    return rounded(registered(v, "consensus"), 4)


@query("OPT7_weighted_inliers")
def opt7(v: Views):
    """Which features of a frame follow its best-weighted motion; every third pair is a false one."""
    rows = false_matches(v, (F.col("frame") % 5 - 2) * 0.01, F.lit(0.7), F.lit(-0.4))
    out = registration.weighted_consensus(rows, ["frame"], "id", registration.with_gates(hypotheses=200, inlier=0.3, max_yaw=0.2))
    return rounded(out.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("inlier").alias("inliers"), F.max("yaw").alias("yaw"), F.max("x").alias("x"), F.max("y").alias("y")), 4)


@query("OPT8_keyframe_match")
def opt8(v: Views):
    return rounded(registered(v, "match"), 4)


@query("OPT10_registration_rounds")
def opt10(v: Views):
    return rounded(registered(v, "rounds"), 4)


# normal equations


def moved_pairs(v: Views):
    """Points of a frame and where they are seen: turned by 0.02 and shifted, with misses that grow in every seventh."""
    x, y = math.cos(0.02) * F.col("x") - math.sin(0.02) * F.col("y") + 0.5, math.sin(0.02) * F.col("x") + math.cos(0.02) * F.col("y") - 0.3
    miss = F.when(F.col("id") % 7 == 0, F.col("z")).otherwise(0.0)
    return v.pts.select("frame", "id", F.col("x").alias("sx"), F.col("y").alias("sy"), (x + miss).alias("tx"), (y - miss).alias("ty"), F.col("conf").alias("w"))


def _irls(rounds: int) -> str:
    """SQL of rounds of linearised planar fits with Huber weights, solved by Cramer's rule."""
    sql = """with p as (select frame, id, x as sx, y as sy, cos(0.02) * x - sin(0.02) * y + 0.5 + case when id % 7 = 0 then z else 0 end as tx, sin(0.02) * x + cos(0.02) * y - 0.3 - case when id % 7 = 0 then z else 0 end as ty, conf as w from pts),
      s0 as (select distinct frame, cast(0 as double) as yaw, cast(0 as double) as x, cast(0 as double) as y from p)"""
    for t in range(rounds):
        sql += f""",
  m{t} as (select p.frame, p.w, cos(yaw) * sx - sin(yaw) * sy + s.x as px, sin(yaw) * sx + cos(yaw) * sy + s.y as py, p.tx, p.ty from p join s{t} s using (frame)),
  e{t} as (select *, tx - px as ex, ty - py as ey, w * case when sqrt((tx - px) * (tx - px) + (ty - py) * (ty - py)) <= 0.3 then 1 else 0.3 / sqrt((tx - px) * (tx - px) + (ty - py) * (ty - py)) end as u from m{t}),
  c{t} as (select frame, sum(u) as h00, -sum(u * py) as h02, sum(u * px) as h12, sum(u * (px * px + py * py)) as h22, sum(u * ex) as g0, sum(u * ey) as g1, sum(u * (px * ey - py * ex)) as g2 from e{t} group by frame),
  d{t} as (select frame, (h00 * g2 - h02 * g0 - h12 * g1) / (h00 * h22 - h02 * h02 - h12 * h12) as a, h00, h02, h12, g0, g1 from c{t}),
  s{t + 1} as (select s.frame, s.yaw + a as yaw, cos(a) * s.x - sin(a) * s.y + (g0 - h02 * a) / h00 as x, sin(a) * s.x + cos(a) * s.y + (g1 - h12 * a) / h00 as y from s{t} s join d{t} using (frame))"""
    return f"{sql} select frame, round(yaw, 5) + 0.0 as yaw, round(x, 4) + 0.0 as x, round(y, 4) + 0.0 as y from s{rounds}"


@query("AG23_huber_rounds", _irls(3))
def ag23(v: Views):
    """Planar motion of each frame by rounds of linearised normal equations with Huber weights."""
    out = equations.planar_rounds(moved_pairs(v), ["frame"], 0.3, 3)
    return out.select("frame", (F.round("yaw", 5) + 0.0).alias("yaw"), (F.round("x", 4) + 0.0).alias("x"), (F.round("y", 4) + 0.0).alias("y"))


PLANE = """select id, frame, x, y, z, case when label % 3 = 0 then 0.0 when label % 3 = 1 then 1.0 else 0.0 end as nx, case when label % 3 = 2 then 1.0 else 0.0 end as ny, case when label % 3 = 0 then 1.0 else 0.0 end as nz,
  (id % 41 - 20) / 100.0 as r, 0.01 + conf / 50 as variance from pts"""
NAMES = ["rx", "ry", "rz", "tx", "ty", "tz"]


def _point_plane() -> str:
    j = {"rx": "y * nz - z * ny", "ry": "z * nx - x * nz", "rz": "x * ny - y * nx", "tx": "nx", "ty": "ny", "tz": "nz"}
    weighted = "case when abs(r) / sqrt(variance) <= 1 then 1 else sqrt(variance) / abs(r) end / variance"
    h = ", ".join(f"round(sum(u * ({j[a]}) * ({j[b]})), 2) + 0.0 as h_{a}_{b}" for k, a in enumerate(NAMES) for b in NAMES[k:])
    g = ", ".join(f"round(sum(u * ({j[a]}) * r), 3) + 0.0 as g_{a}" for a in NAMES)
    return f"""with p as ({PLANE}), q as (select *, {weighted} as u, r * r / (variance + 0.02) <= 1 as inside from p)
  select frame, {h}, {g}, count(*) as used, round(sum(r * r), 4) as square, count(distinct cast(floor((atan2(y, x) + pi()) / (pi() / 6)) as bigint)) as sectors, (select count(*) from q b where b.frame = q.frame and not inside) as rejected from q where inside group by frame"""


@query("AG25_normal_equations", _point_plane())
def ag25(v: Views):
    """The 21 + 6 sums of point-to-plane misses of each frame, with robust weights and the innovation gate."""
    rows = v.sql(PLANE)
    out = equations.point_plane(rows, ["frame"], huber=1.0, gate=1.0, prior_variance=0.02, sectors=12)
    places = {"h": 2, "g": 3, "s": 4}
    return out.select(*[(F.round(c, places[c[0]]) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query("AG25_degeneracy")
def ag25_degeneracy(v: Views):
    """What the normal equations see: directions, condition, turns alone."""
    out = equations.point_plane(v.sql(PLANE), ["frame"], huber=1.0, gate=1.0, prior_variance=0.02, sectors=12)
    return rounded(equations.degeneracy(out, ["frame"]), 4)


PATCH = """select a.ix as frame, a.iy as point, n.ix - a.ix as u, n.iy - a.iy as v, n.occ as reference, 0.9 * n.occ + 0.05 + 0.1 * (coalesce(e.occ, n.occ) - coalesce(w.occ, n.occ)) / 2 as current, (coalesce(e.occ, n.occ) - coalesce(w.occ, n.occ)) / 2 as gx, (coalesce(s.occ, n.occ) - coalesce(t.occ, n.occ)) / 2 as gy,
    10.0 + a.ix as depth from raster a join raster n on n.ix between a.ix - 1 and a.ix + 1 and n.iy between a.iy - 1 and a.iy + 1
    left join raster e on e.ix = n.ix + 1 and e.iy = n.iy left join raster w on w.ix = n.ix - 1 and w.iy = n.iy left join raster s on s.ix = n.ix and s.iy = n.iy + 1 left join raster t on t.ix = n.ix and t.iy = n.iy - 1 where a.occ > 0.3"""


def _photometric() -> str:
    return f"""with p as ({PATCH}),
  c as (select frame, point, count(*) as n, corr(reference, current) as ncc, avg(reference) as mr, avg(current) as mc from p group by frame, point),
  k as (select p.*, c.n as patch, (current - mc) - (reference - mr) as r from p join c using (frame, point) where c.n = 9 and c.ncc >= 0.6),
  j as (select *, -(gx * 300 / depth) as jx, -(gy * 300 / depth) as jy, (gx * 300 * u + gy * 300 * v) / (depth * 300) as jz, case when abs(r) <= 0.1 then 1 else 0.1 / abs(r) end as q from k)
  select frame, count(distinct point) as points, count(*) as pixels, round(sum(q * jx * jx), 3) + 0.0 as h_x_x, round(sum(q * jx * jy), 3) + 0.0 as h_x_y, round(sum(q * jx * jz), 4) + 0.0 as h_x_z, round(sum(q * jy * jy), 3) + 0.0 as h_y_y, round(sum(q * jy * jz), 4) + 0.0 as h_y_z, round(sum(q * jz * jz), 5) + 0.0 as h_z_z,
    round(sum(q * jx * r), 4) + 0.0 as g_x, round(sum(q * jy * r), 4) + 0.0 as g_y, round(sum(q * jz * r), 5) + 0.0 as g_z, round(sum(q * r * r), 5) + 0.0 as cost from j group by frame"""


@query("AG26_photometric_equations", _photometric())
def ag26(v: Views):
    """Shift of the camera from brightness misses over patches that look alike."""
    out = equations.photometric(v.sql(PATCH), ["frame"], "point", 9, focal=300.0, least_ncc=0.6, huber=0.1)
    places = {"h_x_z": 4, "h_y_z": 4, "h_z_z": 5, "g_x": 4, "g_y": 4, "g_z": 5, "cost": 5}
    return out.select(*[(F.round(c, places.get(c, 3)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


# planes


def plane_points(v: Views):
    """Cell means of a cloud on a floor and two walls: what a local-plane lookup reads."""
    rows = v.sql("select id, case when id % 3 = 1 then cast(0 as double) else x / 4 end as x, case when id % 3 = 2 then cast(0 as double) else y / 8 end as y, case when id % 3 = 0 then cast(0 as double) else (x * 7 + y) / 100 end as z from pts")
    voxel = [scalars.cell(F.col(c), 1.0).alias(f"v{c}") for c in "xyz"]
    return rows, rows.groupBy(*voxel).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in equations.AXES])


@query("JN20_local_planes")
def jn20(v: Views):
    """The plane around every twentieth point: nearest voxels within reach, weighted, with its gates."""
    points, voxels = plane_points(v)
    queries = points.filter("id % 20 = 0")
    out = equations.local_planes(queries, voxels, "id", size=1.0, reach=1.8, nearest=8, least=4, least_points=1, max_flatness=0.1)
    return rounded(out.select("id", "used", "nx", "ny", "nz", "distance", "flatness", "valid"), 5)


@query("JN21_plane_strategies")
def jn21(v: Views):
    """Voxels that agree, else the nearest points themselves, else finer voxels."""
    points, voxels = plane_points(v)
    queries = points.filter("id % 20 = 0")
    return rounded(equations.plane_by_strategies(queries, points, voxels, "id", size=1.0, reach=1.8), 5)
