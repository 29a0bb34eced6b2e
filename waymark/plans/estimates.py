"""Queries on sequential estimation."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import asof, estimate, folds, grid, prefix, stats
from waymark.plans.clouds import rounded
from waymark.plans.registry import query
from waymark.plans.views import Views

H = 3_600_000_000
FOLD = """with recursive s as (select *, row_number() over (partition by run order by t, id) as n from ({src}) q),
  f as (select run, n, id, {init} from s where n = 1 union all select s.run, s.n, s.id, {step} from f join s on s.run = f.run and s.n = f.n + 1)
  select {out} from f"""


PREDICTED = """with l as (select run, id, t, x, y, lag(t) over w as t1, lag(x) over w as x1, lag(y) over w as y1, lag(t, 2) over w as t0, lag(x, 2) over w as x0, lag(y, 2) over w as y0 from track window w as (partition by run order by t, id)),
  p as (select *, case when t0 is not null and t1 > t0 then x1 + (t - t1) / cast(t1 - t0 as double) * (x1 - x0) end as vx, case when t0 is not null and t1 > t0 then y1 + (t - t1) / cast(t1 - t0 as double) * (y1 - y0) end as vy from l),
  u as (select *, case when t1 is null then 'first' when vx is null then 'hold' when sqrt((vx - x) * (vx - x) + (vy - y) * (vy - y)) > {reset} then 'reset' else 'velocity' end as used from p)"""


@query("EST2_constant_velocity", PREDICTED.format(reset=500) + " select id, round(case used when 'first' then x when 'velocity' then vx else x1 end, 5) + 0.0 as px, round(case used when 'first' then y when 'velocity' then vy else y1 end, 5) + 0.0 as py, used from u")
def est2(v: Views):
    out = folds.fold(v.track.select("run", "id", "t", "x", "y"), ["run"], ["t", "id"], estimate.constant_velocity("t", 500), "run long, id long, t long, x double, y double, px double, py double, used string")
    return rounded(out.select("id", "px", "py", "used"), 5)


@query("EST3_deskew", """with q as (select run, id, t + 1000000 as t, v from track where id % 3 = 0), k as (select * from track where id % 3 <> 0),
  b as (select q.run, q.id, q.t, q.v, k.t as t0, k.x as x0 from q join k on q.run = k.run and k.t <= q.t qualify row_number() over (partition by q.id order by k.t desc, k.id desc) = 1),
  a as (select q.id, k.t as t1, k.x as x1 from q join k on q.run = k.run and k.t > q.t qualify row_number() over (partition by q.id order by k.t, k.id) = 1),
  e as (select run, arg_max(x, (t, id)) as xe from k group by run)
  select b.id, round(v + x0 + (t - t0) / cast(t1 - t0 as double) * (x1 - x0) - xe, 5) as x from b join a using (id) join e using (run)""")
def est3(v: Views):
    poses = v.track.filter("id % 3 <> 0")
    points = v.track.filter("id % 3 = 0").select("run", "id", (F.col("t") + 1_000_000).alias("t"), "v")
    at = asof.around(points.select("run", "id", "t"), poses, ["run"], "t", "id", ["x"], "id").filter("before is not null and after is not null")
    at = at.select("id", (F.col("before.x") + asof.interpolation_share() * (F.col("after.x") - F.col("before.x"))).alias("px"))
    ends = poses.groupBy("run").agg(F.max_by("x", F.struct("t", "id")).alias("xe"))
    rows = points.join(at, "id").join(ends, "run")
    return rounded(rows.select("id", (F.col("v") + F.col("px") - F.col("xe")).alias("x")), 5)


@query("EST7_voxel_update")
def est7(v: Views):
    """Voxels of a floor and two walls, point by point."""
    rows = v.sql("select id, x / 4 as x, y / 8 as y, case when id % 3 = 0 then 0.002 * label else z end as z from pts")
    rows = grid.with_cells(rows, 4).select("ix", "iy", "iz", "id", "x", "y", "z")
    columns = ", ".join(f"{c} double" for c in ("mx", "my", "mz", "nx", "ny", "nz", "width"))
    out = folds.fold(rows, ["ix", "iy", "iz"], ["id"], estimate.voxel_update(), f"ix long, iy long, iz long, id long, x double, y double, z double, n long, {columns}, plane boolean")
    return rounded(out.select("id", "n", "mx", "my", "mz", "nx", "ny", "nz", "width", "plane"), 5)


#: Scans of a run as accepted or not, with what was propagated and, now and then, a wheel speed.
SCANS = "select run, id, t, id % 4 <> 0 and id % 3 <> 1 as accepted, x, y, v / 30 as z, v / 100 as vx, v / 150 as vy, (id % 60) / 30.0 as heading, case when id % 5 < 3 then v / 80 end as wheel from track"
HOUR = 3.6e9


@query("EST8_outage_guard", FOLD.format(src=SCANS, init="t as tt, x as ex, y as ey, z as ez, vx as svx, vy as svy, case when accepted then 'tracked' else 'predicted' end as mode, case when accepted then 0 else 1 end as cnt, case when accepted then x end as ax, case when accepted then y end as ay, case when accepted then z end as az",
    step="""s.t, case m.mode when 'frozen' then f.ax when 'held' then f.ex + q.vx * w.dt * w.cut when 'reckoned' then f.ex + q.vx * w.dt * w.cut else s.x end,
    case m.mode when 'frozen' then f.ay when 'held' then f.ey + q.vy * w.dt * w.cut when 'reckoned' then f.ey + q.vy * w.dt * w.cut else s.y end,
    case when m.mode = 'frozen' then f.az when m.mode in ('held', 'reckoned') then f.az + greatest(-0.5, least(0.5, s.z - f.az)) else s.z end,
    case when m.mode = 'frozen' then 0 when m.mode = 'held' then 0.8 * q.vx when m.mode = 'reckoned' then q.vx else s.vx end, case when m.mode = 'frozen' then 0 when m.mode = 'held' then 0.8 * q.vy when m.mode = 'reckoned' then q.vy else s.vy end,
    m.mode, m.cnt, case when s.accepted then s.x else f.ax end, case when s.accepted then s.y else f.ay end, case when s.accepted then s.z else f.az end""",
    out="id, round(ex, 4) + 0.0 as ex, round(ey, 4) + 0.0 as ey, round(ez, 4) + 0.0 as ez, round(sqrt(svx * svx + svy * svy), 4) + 0.0 as speed, mode").replace(
    "and s.n = f.n + 1)", """and s.n = f.n + 1,
    lateral (select case when s.accepted then 0 else f.cnt + 1 end as cnt, case when s.accepted then 'tracked' when f.ax is null or f.cnt + 1 < 2 then 'predicted' when s.wheel is null and f.cnt + 1 >= 5 then 'frozen' when s.wheel is null then 'held' else 'reckoned' end as mode) m,
    lateral (select case when s.wheel is null then f.svx else s.wheel * cos(s.heading) end as rx, case when s.wheel is null then f.svy else s.wheel * sin(s.heading) end as ry) r,
    lateral (select rx * case when sqrt(rx * rx + ry * ry) > 1 then 1 / sqrt(rx * rx + ry * ry) else 1 end as vx, ry * case when sqrt(rx * rx + ry * ry) > 1 then 1 / sqrt(rx * rx + ry * ry) else 1 end as vy) q,
    lateral (select greatest(0, (s.t - f.tt) / 3600000000.0) as dt, case when sqrt(q.vx * q.vx + q.vy * q.vy) * greatest(0, (s.t - f.tt) / 3600000000.0) > 10 then 10 / (sqrt(q.vx * q.vx + q.vy * q.vy) * greatest(0, (s.t - f.tt) / 3600000000.0)) else 1 end as cut) w)"""))  # fmt: skip
def est8(v: Views):
    names = ", ".join(f"{c} double" for c in ("x", "y", "z", "vx", "vy", "heading", "wheel", "ex", "ey", "ez", "speed"))
    schema = f"run long, id long, t long, accepted boolean, {names}, mode string"
    out = folds.fold(v.sql(SCANS), ["run"], ["t", "id"], estimate.outage_guard("t", HOUR, estimate.Outage(max_speed=1.0, max_step=10.0)), schema)
    return rounded(out.select("id", "ex", "ey", "ez", "speed", "mode"), 4)


@query("EST9_preintegration", FOLD.format(src="select run, id, t, w / 1e6 as a from imu", init="t as last, cast(0 as double) as v, cast(0 as double) as p",
    step=f"s.t, case when s.t - f.last between 1 and {100 * H} then f.v + s.a * (s.t - f.last) / 1e6 else f.v end, case when s.t - f.last between 1 and {100 * H} then f.p + f.v * (s.t - f.last) / 1e6 + 0.5 * s.a * ((s.t - f.last) / 1e6) * ((s.t - f.last) / 1e6) else f.p end",
    out="id, round(v, 6) as dv, round(p / 1e6, 6) as dp"))
def est9(v: Views):
    rows = v.imu.select("run", "id", "t", (F.col("w") / 1e6).alias("a"))
    out = prefix.fold(rows, ["run"], ["t", "id"], prefix.preintegrate("t", "a", 100 * H), "run long, id long, t long, a double, dv double, dp double")
    return rounded(out.select("id", "dv", (F.col("dp") / 1e6).alias("dp")))


FIXES = "select run, id, t, v / 10 as ds, (id % 11 - 5) / 50.0 as da, case when id % 5 = 0 then x end as fx, case when id % 5 = 0 then y end as fy from track"


def _ekf_step() -> str:
    """SQL of one step of the planar filter: m, p (predicted) and g (gain) in the selected columns."""
    moved = lambda u: f"case when s.fx is null then m.{u} else m.{u} + p.{u}x * g.kx + p.{u}y * g.ky end"
    less = lambda u, w: f"case when s.fx is null then p.{u}{w} else p.{u}{w} - (g.syy * p.{u}x * p.{w}x - g.sxy * (p.{u}x * p.{w}y + p.{u}y * p.{w}x) + g.sxx * p.{u}y * p.{w}y) / g.det end"
    return ", ".join([*map(moved, "xya"), less("x", "x"), less("x", "y"), less("a", "x"), less("y", "y"), less("a", "y"), less("a", "a")])


_EKF_JOIN = """and s.n = f.n + 1,
    lateral (select f.x + s.ds * cos(f.a + s.da / 2) as x, f.y + s.ds * sin(f.a + s.da / 2) as y, f.a + s.da as a, -s.ds * sin(f.a + s.da / 2) as jx, s.ds * cos(f.a + s.da / 2) as jy) m,
    lateral (select f.pxx + 2 * m.jx * f.pxa + m.jx * m.jx * f.paa + 0.5 as xx, f.pxy + m.jx * f.pya + m.jy * f.pxa + m.jx * m.jy * f.paa as xy, f.pxy + m.jx * f.pya + m.jy * f.pxa + m.jx * m.jy * f.paa as yx,
      f.pxa + m.jx * f.paa as ax, f.pyy + 2 * m.jy * f.pya + m.jy * m.jy * f.paa + 0.5 as yy, f.pya + m.jy * f.paa as ay, f.paa + 0.01 as aa) p,
    lateral (select p.xx + 4 as sxx, p.xy as sxy, p.yy + 4 as syy, (p.xx + 4) * (p.yy + 4) - p.xy * p.xy as det, ((p.yy + 4) * (s.fx - m.x) - p.xy * (s.fy - m.y)) / ((p.xx + 4) * (p.yy + 4) - p.xy * p.xy) as kx, ((p.xx + 4) * (s.fy - m.y) - p.xy * (s.fx - m.x)) / ((p.xx + 4) * (p.yy + 4) - p.xy * p.xy) as ky) g)"""
_EKF = FOLD.format(src=f"select * from ({FIXES}) q union all select distinct run, cast(-1 as bigint), cast(-9000000000000000000 as bigint), 0, 0, null, null from track",
    init="cast(0 as double) as x, cast(0 as double) as y, cast(0 as double) as a, cast(1 as double) as pxx, cast(0 as double) as pxy, cast(0 as double) as pxa, cast(1 as double) as pyy, cast(0 as double) as pya, cast(1 as double) as paa",
    step=_ekf_step(), out="id, round(x, 3) + 0.0 as ex, round(y, 3) + 0.0 as ey, round(a, 4) + 0.0 as ea, round((pxx + pyy) / 2, 3) as var_xy, round(paa, 4) as var_a").replace("and s.n = f.n + 1)", _EKF_JOIN)


@query("EST10_planar_filter", _EKF + " where id >= 0")
def est10(v: Views):
    """Place and heading with their covariance: odometry steps, now and then a fix."""
    out = folds.fold(v.sql(FIXES), ["run"], ["t", "id"], estimate.planar_filter(0.5, 0.01, 2.0), "run long, id long, t long, ds double, da double, fx double, fy double, ex double, ey double, ea double, var_xy double, var_a double")
    places = {"ex": 3, "ey": 3, "ea": 4, "var_xy": 3, "var_a": 4}
    return out.select("id", *[(F.round(c, n) + 0.0).alias(c) for c, n in places.items()])


@query("EST11_prediction_reset", PREDICTED.format(reset=60) + " select used, count(*) as n from u group by used")
def est11(v: Views):
    out = folds.fold(v.track.select("run", "id", "t", "x", "y"), ["run"], ["t", "id"], estimate.constant_velocity("t", 60), "run long, id long, t long, x double, y double, px double, py double, used string")
    return out.groupBy("used").agg(F.count("*").alias("n"))


@query("EST12_object_association")
def est12(v: Views):
    """Objects of each frame: of the first 60 at most (object, null beyond), and of all there are (object_all)."""
    rows = v.pts.select("frame", "id", "label", "x", "y").filter("label <> 0")
    both = folds.together(folds.associate(12, 60), folds.associate(12, out="object_all"))
    return folds.fold(rows, ["frame"], ["id"], both, "frame long, id long, label int, x double, y double, object long, object_all long").select("frame", "id", "object", "object_all")


HEIGHTS = """with r as (select frame, frame % 4 as run, case when id % 10 < 3 + frame % 7 then z / 10 + (frame % 16) / 40.0 - 0.3 end as r from pts), m as (select frame, run, median(r) as median, count(r) as n from r group by frame, run)
  select m.run, m.frame as id, m.frame as t, m.n as cnt, m.median, median(abs(r.r - m.median)) as mad from m join r using (frame, run) group by m.run, m.frame, m.n, m.median"""


@query("EST13_height_controller", FOLD.format(src=HEIGHTS, init="case when cnt < 30 then 'few' when mad > 0.14 then 'spread' when abs(median) <= 0.05 then 'dead_band' else 'streak' end as reason, cast(0 as double) as c, case when cnt < 30 or mad > 0.14 or abs(median) <= 0.05 then 0 when median > 0 then 1 else -1 end as side, case when cnt < 30 or mad > 0.14 or abs(median) <= 0.05 then 0 else 1 end as streak, case when cnt < 30 or mad > 0.14 then 1 else 0 end as missed, cast(1 as double) as trust",
    step="""case when g.bad is not null then g.bad when g.flat then 'dead_band' when k.streak >= 2 then 'applied' else 'streak' end, case when g.bad is null and not g.flat and k.streak >= 2 then greatest(-2, least(2, f.c + greatest(-0.1, least(0.1, 0.5 * g.trust * (s.median - f.c))))) else f.c end,
    case when g.bad is not null or g.flat then 0 else k.side end, case when g.bad is not null or g.flat then 0 else k.streak end, case when g.bad is not null then f.missed + 1 else 0 end, g.trust""",
    out="id, round(c, 6) + 0.0 as correction, cast(streak as bigint) as streak, round(trust, 6) as trust, reason").replace("and s.n = f.n + 1)", """and s.n = f.n + 1,
    lateral (select case when s.cnt < 30 then 'few' when s.mad > 0.14 then 'spread' end as bad, abs(s.median - f.c) <= 0.05 as flat, greatest(0, 1 - f.missed / 8.0) as trust, case when s.median - f.c > 0 then 1 else -1 end as now) g,
    lateral (select g.now as side, case when g.now = f.side then f.streak + 1 else 1 end as streak) k)"""))  # fmt: skip
def est13(v: Views):
    """Height corrections of four runs by their frames' medians."""
    rows = v.pts.select("frame", F.when(F.col("id") % 10 < 3 + F.col("frame") % 7, F.col("z") / 10 + (F.col("frame") % 16) / 40.0 - 0.3).alias("r"))
    found = stats.median_mad(rows, ["frame"], "r").join(rows.groupBy("frame").agg(F.count("r").alias("n")), "frame")
    rows = found.select((F.col("frame") % 4).alias("run"), F.col("frame").alias("id"), F.col("frame").alias("t"), "n", "median", "mad")
    out = folds.fold(rows, ["run"], ["t", "id"], estimate.height_controller(estimate.HeightControl(least=30, max_mad=0.14)), "run long, id long, t long, n long, median double, mad double, correction double, streak long, trust double, reason string")
    return rounded(out.select("id", "correction", "streak", "trust", "reason"))
