"""Queries on pose graphs and on the admission of loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.operators import folds, gates, posegraph
from waymark.plans.clouds import rounded
from waymark.plans.registry import query
from waymark.plans.views import Views

WRAP = "atan2(sin({0}), cos({0}))"
POSE4 = ("x", "y", "z", "yaw")


def odometry(v: Views):
    """Raw motion from each keyframe to the next: (run, i, j, dx, dy, dz, dyaw)."""
    a, b = (v.kf.select("run", F.col("k").cast("long").alias(n), *[F.col(c).alias(f"{n}{c}") for c in POSE4]) for n in "ij")
    rows = a.join(b.withColumn("i", F.col("j") - 1), ["run", "i"])
    return rows.select("run", "i", "j", *[c.alias(f"d{n}") for n, c in zip(POSE4, posegraph.relative4(posegraph.pose4("i"), posegraph.pose4("j")), strict=True)])


def measured_loops(v: Views):
    """Loops as measured, of the better half: (run, i, j, dx, dy, dz, dyaw, quality)."""
    return v.loops.filter("quality >= 0.5").select("run", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *[F.col(f"m{c}").alias(f"d{c}") for c in POSE4], "quality")


def all_edges(v: Views):
    odo = odometry(v).withColumns({"loop": F.lit(False), "w_xy": F.lit(1.0), "w_z": F.lit(1.0), "w_yaw": F.lit(2.0)})
    loops = measured_loops(v).drop("quality").withColumns({"loop": F.lit(True), "w_xy": F.lit(0.5), "w_z": F.lit(0.3), "w_yaw": F.lit(0.5)})
    return odo.unionByName(loops)


EDGES_SQL = f"""odo as (select a.run, a.k as i, b.k as j, cos(a.yaw) * (b.x - a.x) + sin(a.yaw) * (b.y - a.y) as dx, cos(a.yaw) * (b.y - a.y) - sin(a.yaw) * (b.x - a.x) as dy, b.z - a.z as dz, {WRAP.format('b.yaw - a.yaw')} as dyaw,
    false as loop, 1.0 as wp, 1.0 as wz, 2.0 as wa from kf a join kf b on a.run = b.run and b.k = a.k + 1),
  e as (select * from odo union all select run, i, j, mx, my, mz, myaw, true, 0.5, 0.3, 0.5 from loops where quality >= 0.5)"""


def _relaxed(rounds: int) -> str:
    """SQL of that many rounds; no key is done within them unless its step is under the stop."""
    sql = f"with {EDGES_SQL}, v0 as (select run, k, x, y, z, yaw, min(k) over (partition by run) = k as fixed, false as done from kf)"
    for t in range(rounds):
        sql += f""",
  b{t} as (select e.*, a.x + cos(a.yaw) * dx - sin(a.yaw) * dy - b.x as ex, a.y + sin(a.yaw) * dx + cos(a.yaw) * dy - b.y as ey, a.z + dz - b.z as ez, {WRAP.format('a.yaw + dyaw - b.yaw')} as ea
    from e join v{t} a on a.run = e.run and a.k = e.i join v{t} b on b.run = e.run and b.k = e.j where not a.done),
  r{t} as (select *, case when loop then least(1, 1 / greatest(1, sqrt(ex * ex + ey * ey))) else 1 end as rob from b{t}),
  p{t} as (select run, k, sum(ex * wp) / sum(wp) as mx, sum(ey * wp) / sum(wp) as m_y, sum(ez * wz) / sum(wz) as mz, sum(ea * wa) / sum(wa) as ma from (
    select run, j as k, ex, ey, ez, ea, rob * wp as wp, rob * wz as wz, rob * wa as wa from r{t} union all select run, i, -ex, -ey, -ez, -ea, rob * wp, rob * wz, rob * wa from r{t}) u group by run, k),
  g{t} as (select v.*, case when fixed then 0 else 0.4 * coalesce(mx, 0) end as gx, case when fixed then 0 else 0.4 * coalesce(m_y, 0) end as gy, case when fixed then 0 else greatest(-0.2, least(0.2, 0.4 * coalesce(mz, 0))) end as sz, case when fixed then 0 else greatest(-0.05, least(0.05, 0.4 * coalesce(ma, 0))) end as sa
    from v{t} v left join p{t} p on p.run = v.run and p.k = v.k),
  c{t} as (select *, case when sqrt(gx * gx + gy * gy) > 0.5 then 0.5 / sqrt(gx * gx + gy * gy) else 1 end as cut from g{t}),
  v{t + 1} as (select run, k, x + gx * cut as x, y + gy * cut as y, z + sz as z, {WRAP.format('yaw + sa')} as yaw, fixed, max(greatest(sqrt(gx * gx + gy * gy) * cut, abs(sz), abs(sa))) over (partition by run) < 0.0001 as done from c{t})"""
    return f"{sql} select run, k, round(x, 5) + 0.0 as x, round(y, 5) + 0.0 as y, round(z, 5) + 0.0 as z, round(yaw, 5) + 0.0 as yaw from v{rounds}"


@query("OPT11_relaxation", _relaxed(3))
def opt11(v: Views):
    vertices = v.kf.select("run", F.col("k").cast("long").alias("k"), *POSE4)
    return rounded(posegraph.relax_poses(vertices, all_edges(v), ["run"], 3), 5)


SIGMAS = """with l as (select run, i, j, quality, sqrt(mx * mx + my * my) as d, 1 + 2 * (1 - quality) as g from loops)
  select run, i, j, 'loop_xy' as kind, 1000.0 as s0, 1000.0 as s1, round(0.02 * g, 6) as s2, round(0.2 * g, 6) as s3, round(0.2 * g, 6) as s4, 1000.0 as s5, 1.5 as huber from l
  union all select run, i, j, 'loop_z', 1000.0, 1000.0, 1000.0, 1000.0, 1000.0, round(0.1 * g, 6), 1.5 from l
  union all select run, i, j, 'visual', round(0.02 * g, 6), round(0.02 * g, 6), round(0.01 * g, 6), round((0.1 + 0.05 * d) * g, 6), round((0.1 + 0.05 * d) * g, 6), round((0.2 + 0.05 * d) * g, 6), 1.5 from l
  union all select run, i, j, 'rotation', round(0.02 * g, 6), round(0.02 * g, 6), round(0.01 * g, 6), 1000.0, 1000.0, 1000.0, 1.5 from l
  union all select run, i, j, 'odometry', 0.01, 0.01, 0.01, round(0.05 + 0.02 * d, 6), round(0.05 + 0.02 * d, 6), round(0.05 + 0.02 * d, 6), 0.0 from l
  union all select run, i, j, 'wheel', 1000.0, 1000.0, 1000.0, round(greatest(0.02, 0.05 + 0.03 * d), 6), 0.1, 1000.0, 1.5 from l"""


@query("OPT14_factors", SIGMAS)
def opt14(v: Views):
    kinds = F.explode(F.array(*map(F.lit, ["loop_xy", "loop_z", "visual", "rotation", "odometry", "wheel"]))).alias("kind")
    rows = v.loops.select("run", "i", "j", "quality", F.hypot("mx", "my").alias("distance"), kinds)
    return rounded(posegraph.with_sigmas(rows).select("run", "i", "j", "kind", *[f"s{k}" for k in range(6)], "huber"))


def factors(v: Views):
    """Odometry and loops as factors of the solver: plane and heading, and height, of a loop are factors of their own."""
    distance = F.hypot("dx", "dy").alias("distance")
    odo = odometry(v).select("run", "i", "j", "dx", "dy", "dz", "dyaw", F.lit("odometry").alias("kind"), distance, F.lit(1.0).alias("quality"))
    kinds = F.explode(F.array(F.lit("loop_xy"), F.lit("loop_z"))).alias("kind")
    loops = measured_loops(v).select("run", "i", "j", "dx", "dy", "dz", "dyaw", kinds, distance, "quality")
    rows = posegraph.with_sigmas(odo.unionByName(loops.select(*odo.columns)))
    return rows.select("run", "i", "j", *[F.col(f"d{c}").alias(f"m_{c}") for c in "xyz"], *[c.alias(f"m_q{n}") for c, n in zip(posegraph.yaw_quaternion(F.col("dyaw")), "wxyz", strict=True)], *[f"s{k}" for k in range(6)], "huber", "confidence")


def vertices(v: Views):
    return v.kf.select("run", F.col("k").cast("long").alias("k"), "x", "y", "z", *posegraph.yaw_quaternion(F.col("yaw")))


@query("OPT13_graph_solution")
def opt13(v: Views):
    """Whole runs smoothed: odometry, loops in plane and height, robust."""
    return rounded(posegraph.smooth(vertices(v), factors(v), ["run"], 15).select("run", "k", "x", "y", "z", "qw", "qz"), 4)


def sensor_factors(v: Views):
    """Beside odometry and loops what other sensors say about each step: wheels (distance, sidewise), a visual turn and shift, a visual turn alone, the ground's height."""
    a, b = (v.kf.select("run", F.col("k").cast("long").alias(n), *[F.col(f"g{c}").alias(f"{n}{c}") for c in POSE4]) for n in "ij")
    rows = a.join(b.withColumn("i", F.col("j") - 1), ["run", "i"])
    true = dict(zip(POSE4, posegraph.relative4(posegraph.pose4("i"), posegraph.pose4("j")), strict=True))
    off = lambda n, size: (F.pmod(F.col("run") * 7 + F.col("i") * n, F.lit(21)) - 10) / 10.0 * size
    rows = rows.select("run", "i", "j", (true["x"] + off(5, 0.03)).alias("dx"), (true["y"] + off(3, 0.03)).alias("dy"), (true["z"] + off(11, 0.04)).alias("dz"), (true["yaw"] + off(2, 0.004)).alias("dyaw"), F.explode(F.array(*map(F.lit, ("wheel", "rotation", "visual", "ground")))).alias("kind"))
    # images serve some steps only, and with a quality
    rows = rows.withColumn("quality", F.when(F.col("kind").isin("rotation", "visual"), 0.4 + F.pmod(F.col("run") + F.col("i"), F.lit(6)) / 10.0).otherwise(1.0))
    rows = rows.filter((F.col("kind") != "visual") | (F.col("quality") >= 0.6)).withColumn("distance", F.hypot("dx", "dy"))
    rows = posegraph.with_sigmas(rows)
    more = rows.select("run", "i", "j", *[F.col(f"d{c}").alias(f"m_{c}") for c in "xyz"], *[c.alias(f"m_q{n}") for c, n in zip(posegraph.yaw_quaternion(F.col("dyaw")), "wxyz", strict=True)], *[f"s{k}" for k in range(6)], "huber", "confidence")
    return factors(v).unionByName(more)


@query("OPT13_all_sensors")
def opt13_sensors(v: Views):
    """Whole runs smoothed from odometry, wheels, visual turns and shifts, the ground and loops."""
    return rounded(posegraph.smooth(vertices(v), sensor_factors(v), ["run"], 15).select("run", "k", "x", "y", "z", "qw", "qz"), 4)


@query("OPT12_window_solution")
def opt12(v: Views):
    """The last twelve keyframes of each run, with capped steps."""
    return rounded(posegraph.smooth(vertices(v), factors(v), ["run"], 6, 1.0, 12).select("run", "k", "x", "y", "z", "qw", "qz"), 4)


def map_factors(v: Views):
    """Odometry, and every fourth keyframe as matched on the map with a confidence: absolute factors in plane and heading."""
    sigmas = (posegraph.FREE, posegraph.FREE, 0.05, 0.5, 0.5, posegraph.FREE)
    at = v.kf.filter("k % 4 = 0").select("run", F.col("k").cast("long").alias("i"), F.lit(None).cast("long").alias("j"), *[F.col(f"g{c}").alias(f"m_{c}") for c in "xyz"], *[c.alias(f"m_q{n}") for c, n in zip(posegraph.yaw_quaternion(F.col("gyaw")), "wxyz", strict=True)], *[F.lit(s).alias(f"s{k}") for k, s in enumerate(sigmas)], F.lit(1.0).alias("huber"), (0.2 + 0.1 * (F.col("k") % 8)).alias("confidence"))
    return factors(v).filter("j = i + 1").unionByName(at)


@query("OPT21_map_match_factor")
def opt21(v: Views):
    """The last twelve keyframes of each run, solved with their matches on the map."""
    return rounded(posegraph.smooth(vertices(v), map_factors(v), ["run"], 8, 2.0, 12).select("run", "k", "x", "y", "z", "qw", "qz"), 4)


CONSISTENT = f"""with p as (select *, cos(gayaw) * (gbx - gax) + sin(gayaw) * (gby - gay) as px, cos(gayaw) * (gby - gay) - sin(gayaw) * (gbx - gax) as py, gbz - gaz as pz, {WRAP.format('gbyaw - gayaw')} as pa from loops),
  o as (select *, sqrt((mx - px) * (mx - px) + (my - py) * (my - py)) > 0.607 as xy, abs({WRAP.format('myaw - pa')}) > 0.063 as a, abs(mz - pz) > 0.157 as h from p)
  select run, i, j, not xy and not a and quality >= 0.3 as xy_consistent, not h as z_consistent,
    case when h and not (not xy and not a and quality >= 0.3) then 'graph_z' when a then 'graph_yaw' when xy then 'graph_xy' end as reason from o"""


@query("OPT18_consistency", CONSISTENT)
def opt18(v: Views):
    predicted = posegraph.relative4(posegraph.pose4("ga"), posegraph.pose4("gb"))
    out = posegraph.consistency(predicted, posegraph.pose4("m"), F.col("quality") >= 0.3, F.lit(True), posegraph.ConsistencyGates(0.607, 0.063, 0.157))
    return v.loops.select("run", "i", "j", *[c.alias(n) for n, c in out.items()])


MODES = ["full", "safe", "blend", "z_only"]
CORRECTED = f"""with l as (select run, max(k) - 2 as k from kf group by run having max(k) > 2), q as (select kf.* from kf join l on l.run = kf.run and l.k = kf.k), n as (select run, count(*) as loops from loops where quality >= 0.5 group by run),
  r as (select f.run, f.k, f.x, f.y, f.z, f.yaw, q.gx + cos(q.gyaw - q.yaw) * (f.x - q.x) - sin(q.gyaw - q.yaw) * (f.y - q.y) as tx, q.gy + sin(q.gyaw - q.yaw) * (f.x - q.x) + cos(q.gyaw - q.yaw) * (f.y - q.y) as ty, q.gz + f.z - q.z as tz, {WRAP.format('q.gyaw + f.yaw - q.yaw')} as ta, coalesce(n.loops, 0) as loops
    from kf f join q on q.run = f.run and f.k > q.k left join n on n.run = f.run),
  d as (select *, tx - x as dx, ty - y as dy, sqrt((tx - x) * (tx - x) + (ty - y) * (ty - y)) as size, {WRAP.format('ta - yaw')} as turn from r),
  m as (select d.*, mode, mode = 'blend' or (mode = 'safe' and loops >= 3 and size <= 0.4 and abs(turn) <= 0.05) as follows from d, (select unnest(['full', 'safe', 'blend', 'z_only']) as mode) modes)
  select run, k, mode, round(case when mode = 'full' then tx when follows then x + dx * least(1, 0.4 / greatest(size, 1e-9)) else x end, 5) + 0.0 as x, round(case when mode = 'full' then ty when follows then y + dy * least(1, 0.4 / greatest(size, 1e-9)) else y end, 5) + 0.0 as y,
    round(case when mode = 'full' then tz else z + greatest(-0.1, least(0.1, 0.5 * (tz - z))) end, 5) + 0.0 as z, round({WRAP.format("case when mode = 'full' then ta when follows then yaw + greatest(-0.05, least(0.05, turn)) else yaw end")}, 5) + 0.0 as yaw from m"""


@query("OPT20_correction", CORRECTED)
def opt20(v: Views):
    """Poses after a run's third-last keyframe, carried along with it in each output mode."""
    last = v.kf.groupBy("run").agg((F.max("k") - 2).alias("k")).filter("k > 0")
    known = v.kf.join(last, ["run", "k"]).select("run", F.col("k").alias("last"), *[F.col(c).alias(f"r{c}") for c in POSE4], *[F.col(f"g{c}").alias(f"s{c}") for c in POSE4])
    loops = measured_loops(v).groupBy("run").agg(F.count("*").alias("loops"))
    rows = v.kf.select("run", "k", *POSE4).join(known, "run").filter("k > last").join(loops, "run", "left").withColumn("loops", F.coalesce("loops", F.lit(0)))
    out = None
    for mode in MODES:
        how = posegraph.Output(mode, z_share=0.5, max_xy=0.4, max_z=0.1, max_yaw=0.05)
        pose = posegraph.corrected(posegraph.pose4(), posegraph.pose4("r"), posegraph.pose4("s"), F.col("loops"), F.lit(0.1), how)
        one = rows.select("run", "k", F.lit(mode).alias("mode"), *posegraph.named4(pose))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 5)


# admission of loops


@query("OPT15_loop_admission")
def opt15(v: Views):
    """Proposals with every gate; every third has scans that agree or not, every second ground."""
    rows = v.loops.withColumnRenamed("b_y", "by")
    verified = F.when((F.col("run") + F.col("i")) % 3 == 0, F.col("quality") > 0.2)
    rows = rows.withColumns({"verified": verified, "ground_dz": F.when((F.col("run") + F.col("j")) % 2 == 0, (F.col("i") % 7 - 3) / 8.0), **{f"l{c}": F.col(f"m{c}") + s for c, s in (("x", 0.1), ("y", -0.1), ("z", 0.0), ("yaw", 0.01))}})
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    out = folds.fold(rows, ["run"], ["j", "i"], gates.admit(gates.Admission(min_gap=2, support_gap=5, min_time=4_000_000)), f"{schema}, {gates.ADMITTED}")
    return rounded(out.select("run", "i", "j", "reason", "support", "z_applied", "z_clipped", "sigma_scale", "fx", "fy", "fz", "fyaw"), 5)


def scored(v: Views):
    """Proposals as candidates with what a registration would say of them."""
    predicted = posegraph.relative4(posegraph.pose4("ga"), posegraph.pose4("gb"))
    off = posegraph.relative4(predicted, posegraph.pose4("m"))
    return v.loops.withColumns({"xy_accepted": F.col("quality") >= 0.45, "z_accepted": F.col("quality") >= 0.25, "score": 100 * F.col("quality") - F.hypot("mx", "my"), "off_xy": F.hypot(off[0], off[1]), "off_yaw": F.abs(off[3]), "off_z": F.abs(off[2])})


@query("OPT16_best_reference")
def opt16(v: Views):
    """Keyframes bound to their best labelled reference."""
    one = F.struct("i", F.col("t_ref").alias("t"), F.hypot("mx", "my").alias("baseline"), F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("b_y")).alias("distance"), "xy_accepted", "z_accepted", "score", F.when(~F.col("xy_accepted"), "rmse").alias("reason"), "off_xy", "off_yaw", "off_z")
    rows = scored(v).groupBy("run", "j", F.col("t_cur").alias("t")).agg(F.sort_array(F.collect_list(one)).alias("candidates"))  # as many as keyframes within reach
    out = folds.fold(rows, ["run"], ["j"], gates.bind_reference(gates.Reference()), "run long, j long, i long, kind string, reason string")
    return out


@query("OPT17_loop_discovery")
def opt17(v: Views):
    """Loops by each keyframe's best candidate, with its lead over the second."""
    best = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "i", "t_ref", "xy_accepted", "z_accepted", "off_xy", "off_yaw", "off_z")))
    rows = scored(v).groupBy("run", "j", F.col("t_cur").alias("t")).agg(best.alias("c"))
    first, second = F.get("c", F.lit(0)), F.get("c", F.lit(1))
    rows = rows.select("run", "j", "t", *[first[n].alias(n) for n in ("i", "t_ref", "xy_accepted", "z_accepted", "off_xy", "off_yaw", "off_z")], (-first["minus"]).alias("score"), (-second["minus"]).alias("second"))
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    out = folds.fold(rows, ["run"], ["j"], gates.discover(gates.Discovery(support_gap=5)), f"{schema}, support long, kind string, reason string")
    return out.select("run", "i", "j", "reason", "kind", "support")
