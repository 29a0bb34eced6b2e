"""Queries on ordered rows: windows, folds, subsampling and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import scalars
from waymark.operators import folds, grid, prefix, select, windows
from waymark.plans.clouds import r, rounded
from waymark.plans.registry import query
from waymark.plans.views import Views

H = 3_600_000_000
W = "(partition by run order by t, id)"


@query("WN1_pose_deltas", f"""with l as (select *, lag(x) over w as ax, lag(y) over w as ay, lag(z) over w as az, lag(qw) over w as aw, lag(qx) over w as bx, lag(qz) over w as bz from poses window w as {W})
  , d as (select id, aw as w, -bx as p, -bz as q, x - ax as dx, y - ay as dy, z - az as dz, aw*qw + bx*qx + bz*qz as dqw from l where aw is not null),
  t as (select *, 2*(-q*dy) as tx, 2*(q*dx - p*dz) as ty, 2*(p*dy) as tz from d)
  select id, round(dqw, 5) + 0.0 as dqw, round(dx + w*tx - q*ty, 4) as dx, round(dy + w*ty + q*tx - p*tz, 4) as dy, round(dz + w*tz + p*ty, 4) as dz from t""")
def wn1(v: Views):
    out = windows.pose_deltas(v.poses, ["run"], ["t", "id"])
    return rounded(out.select("id", "dx", "dy", "dz"), 4).join(out.select("id", r("dqw", 5).alias("dqw")), "id").select("id", "dqw", "dx", "dy", "dz")


@query("WN2_trapezoid", f"""with l as (select run, t, v, lag(t) over w as t0, lag(v) over w as v0 from track window w as {W})
  select run, round(coalesce(sum((t - t0) / 1e6 * (v + v0) / 2), 0), 3) as distance, count(*) as n, coalesce(max(t - t0), 0) <= {30 * H} and count(*) >= 5 as valid from l group by run""")
def wn2(v: Views):
    return rounded(windows.trapezoid(v.track, ["run"], "t", "v", ["t", "id"], 30 * H, 5), 3)


@query("WN3_trailing_sum", f"select id, round(sum(v) over (partition by run order by t range between {24 * H} preceding and current row), 5) as trailing from track")
def wn3(v: Views):
    return rounded(windows.trailing_sum(v.track, ["run"], "t", "v", 24 * H).select("id", "trailing"), 5)


@query("WN4_trailing_robust", f"""with w as (select a.id, any_value(a.v) as v, list(b.v) as l, median(b.v) as m from track a join track b on a.run = b.run and b.t between a.t - {48 * H} and a.t group by a.id having count(*) >= 4),
  d as (select id, any_value(v) as v, any_value(m) as m, median(abs(x - m)) as mad from w, unnest(l) as u(x) group by id)
  select id, round(m, 5) as bias, round(mad, 5) as mad, abs(v - m) > greatest(2, 1.4826 * mad) as stands_out from d""")
def wn4(v: Views):
    return rounded(windows.trailing_robust(v.track, ["run"], "t", "v", 48 * H, 4, 2).select("id", "bias", "mad", "stands_out"), 5)


@query("WN5_points_window", "select run, id from (select run, id, sum(cast(floor(v) as bigint) + 1) over w as s, row_number() over w as n from track window w as (partition by run order by t desc, id desc)) where s <= 400 or n = 1")
def wn5(v: Views):
    rows = v.track.withColumn("points", F.floor("v").cast("long") + 1)
    return windows.last_frames_by_points(rows, ["run"], ["t", "id"], "points", 400).select("run", "id")


TRACK = "run long, id long, t long, x double, y double, v double"
T = ["run", "id", "t", "x", "y", "v"]


def track(v: Views, columns: list[str] = T):
    return v.track.select(*columns)


FOLD = """with recursive s as (select run, id, t, {cols}, row_number() over (partition by run order by t, id) as n from track),
  f as (select run, n, id, {init} from s where n = 1 union all select s.run, s.n, s.id, {step} from f join s on s.run = f.run and s.n = f.n + 1)
  select {out} from f {where}"""


@query("FIL21_rate_gate", FOLD.format(cols="v", init="t as last, true as keep", step=f"case when s.t - f.last >= {20 * H} then s.t else f.last end, s.t - f.last >= {20 * H}", out="run, id", where="where keep"))
def fil21(v: Views):
    return folds.fold(track(v), ["run"], ["t", "id"], folds.rate_gate("t", 20 * H), TRACK).select("run", "id")


FAR = "sqrt((s.x - f.lx)*(s.x - f.lx) + (s.y - f.ly)*(s.y - f.ly)) >= 150"


def _keyed(op: str) -> str:
    hit = f"({FAR} {op} s.t - f.lt >= {50 * H})"
    return FOLD.format(cols="x, y", init="x as lx, y as ly, t as lt, true as keep", step=f"case when {hit} then s.x else f.lx end, case when {hit} then s.y else f.ly end, case when {hit} then s.t else f.lt end, {hit}", out="run, id", where="where keep")


@query("WN6_keyframes_or", _keyed("or"))
def wn6(v: Views):
    return folds.fold(track(v), ["run"], ["t", "id"], folds.keyframes("t", 150, 50 * H), TRACK).select("run", "id")


@query("WN7_keyframes_and", _keyed("and"))
def wn7(v: Views):
    return folds.fold(track(v), ["run"], ["t", "id"], folds.keyframes("t", 150, 50 * H, True), TRACK).select("run", "id")


@query("WN8_monotonic", "select run, id from (select run, id, t, max(t) over (partition by run order by id desc rows between unbounded preceding and 1 preceding) as seen from track) where seen is null or t > seen")
def wn8(v: Views):
    return windows.monotonic(v.track.withColumn("arrival", -F.col("id")), ["run"], ["arrival"], "t").select("run", "id")


@query("WN9_dedupe", f"""with recursive s as (select run, id, t, row_number() over (partition by run order by t, id) as n from track),
  f as (select run, n, id, t as last, cast(0 as bigint) as dropped, true as kept, cast(0 as bigint) as before from s where n = 1 union all
    select s.run, s.n, s.id, case when s.t - f.last > {H} then s.t else f.last end, case when s.t - f.last > {H} then 0 else f.dropped + 1 end, s.t - f.last > {H}, f.dropped from f join s on s.run = f.run and s.n = f.n + 1)
  select run, id, before as dropped from f where kept""")
def wn9(v: Views):
    return windows.dedupe_by_time(v.track.select("run", "id", "t"), ["run"], ["t", "id"], "t", H).select("run", "id", "dropped")


@query("WN10_voxel_ring", "select id from (select id, row_number() over (partition by cast(floor(x / 8) as bigint), cast(floor(y / 8) as bigint) order by id desc) as n from pts) where n <= 3")
def wn10(v: Views):
    return select.top_k(grid.with_cells(v.pts, 8, ("x", "y")), 3, ["ix", "iy"], [F.desc("id")]).select("id")


@query("WN11_first_last", "select run, arg_min(id, t) as first, arg_max(id, t) as last from track group by run")
def wn11(v: Views):
    return v.track.groupBy("run").agg(F.min_by("id", "t").alias("first"), F.max_by("id", "t").alias("last"))


@query("WN12_running_mean", FOLD.format(cols="v", init="v as m, 1 as c", step="f.m + (s.v - f.m) / least(20, f.c + 1), f.c + 1", out="id, round(m, 6) as m, cast(c as bigint) as n", where=""))
def wn12(v: Views):
    return rounded(prefix.fold(track(v), ["run"], ["t", "id"], prefix.running_mean("v", 20, "m"), TRACK + ", m double, n long").select("id", "m", "n"))


@query("WN13_anchor_mean", FOLD.format(cols="v", init="v as m, 1 as c, false as sk", step="case when f.c >= 5 and abs(s.v - f.m) > 30 then f.m else f.m + 0.2 * (s.v - f.m) end, case when f.c >= 5 and abs(s.v - f.m) > 30 then f.c else f.c + 1 end, f.c >= 5 and abs(s.v - f.m) > 30", out="id, round(m, 6) as m, sk as skipped", where=""))
def wn13(v: Views):
    return rounded(folds.fold(track(v), ["run"], ["t", "id"], folds.anchors("v", 0.2, 5, 30, "m"), TRACK + ", m double, n long, skipped boolean").select("id", "m", "skipped"))


@query("WN14_agreement", FOLD.format(cols="v", init="v as b, 1 as c", step="case when abs(s.v - f.b) <= 40 then f.b else s.v end, case when abs(s.v - f.b) <= 40 then f.c + 1 else 1 end", out="id, cast(c as bigint) as support, c >= 3 as confirmed", where=""))
def wn14(v: Views):
    return folds.fold(track(v), ["run"], ["t", "id"], folds.agreement("v", 40, 3), TRACK + ", support long, confirmed boolean").select("id", "support", "confirmed")


@query("WN15_streak", FOLD.format(cols="v", init="v as m, 1 as c", step="case when abs(s.v - f.m) > 50 then s.v else 0.75 * f.m + 0.25 * s.v end, case when abs(s.v - f.m) > 50 then 1 else f.c + 1 end", out="id, round(m, 6) as smooth, c >= 3 as accepted", where=""))
def wn15(v: Views):
    return rounded(folds.fold(track(v), ["run"], ["t", "id"], folds.streak("v", 50, 3), TRACK + ", smooth double, streak long, accepted boolean").select("id", "smooth", "accepted"))


@query("WN16_cooldown", FOLD.format(cols="v", init="t as last, 1 as c, true as keep", step=f"case when f.c < 6 and s.t - f.last >= {20 * H} then s.t else f.last end, case when f.c < 6 and s.t - f.last >= {20 * H} then f.c + 1 else f.c end, f.c < 6 and s.t - f.last >= {20 * H}", out="run, id", where="where keep"))
def wn16(v: Views):
    return folds.fold(track(v), ["run"], ["t", "id"], folds.cooldown("t", 20 * H, 6), TRACK).select("run", "id")


LIM = "0.0001 * (s.t - f.last) / 1e6"


@query("WN17_rate_limited", FOLD.format(cols="v", init="t as last, v as m", step=f"s.t, case when s.t - f.last > {100 * H} then s.v else f.m + greatest(-{LIM}, least({LIM}, s.v - f.m)) end", out="id, round(m, 5) as applied", where=""))
def wn17(v: Views):
    return rounded(folds.fold(track(v), ["run"], ["t", "id"], folds.rate_limited("t", "v", 0.0001, 100 * H, "applied"), TRACK + ", applied double").select("id", "applied"), 5)


@query("WN18_grade_limited", """with recursive s as (select *, row_number() over (partition by run order by t, id) as n from track),
  f as (select run, n, id, x, y, v as z, cast(0 as double) as c from s where n = 1 union all select s.run, s.n, s.id, s.x, s.y, p.prior, case when abs(p.prior - s.v - f.c) > 0.5 then greatest(-25, least(25, f.c + greatest(-2, least(2, 0.3 * (p.prior - s.v - f.c))))) else f.c end from f join s on s.run = f.run and s.n = f.n + 1,
    lateral (select 0.1 * sqrt((s.x - f.x) * (s.x - f.x) + (s.y - f.y) * (s.y - f.y)) as reach) r, lateral (select f.z + greatest(-r.reach, least(r.reach, s.v + f.c - f.z)) as prior) p)
  select id, round(c, 5) + 0.0 as correction from f""")
def wn18(v: Views):
    return rounded(folds.fold(track(v), ["run"], ["t", "id"], folds.grade_limited("v", 0.1, 0.5, 0.3, 2, 25, "correction"), TRACK + ", correction double").select("id", "correction"), 5)


@query("WN20_yaw_integral", f"""with l as (select id, run, t, w, t - lag(t) over {W} as dt from imu), s as (select id, sum(case when dt > 0 and dt <= {100 * H} then w * dt / 1e6 else 0 end) over (partition by run order by t, id rows between unbounded preceding and current row) / 1000 as a from l)
  select id, round(a - 2 * pi() * round(a / (2 * pi())), 5) as yaw from s where abs(abs(a / pi()) % 2 - 1) > 1e-6""")
def wn20(v: Views):
    rows = v.imu.withColumn("w", F.col("w") / 1000)
    return rounded(windows.integrate_yaw(rows, ["run"], ["t", "id"], "t", "w", 100 * H).filter("abs(abs(yaw) / pi() - 1) > 1e-6").select("id", "yaw"), 5)


@query("WN21_running_metrics", """select id, round(max(v) over w, 6) as running_max, round(avg(v) over w, 6) as running_mean, round(sqrt(avg(v * v) over w), 6) as running_rmse from track window w as (partition by run order by t, id rows between unbounded preceding and current row)""")
def wn21(v: Views):
    return rounded(windows.running_metrics(v.track, ["run"], ["t", "id"], "v").select("id", "running_max", "running_mean", "running_rmse"))


@query("SNK4_running_evaluation", """select run, id, round(v, 6) as error, round(sqrt(avg(v * v) over (partition by run order by t, id rows between unbounded preceding and current row)), 6) as rmse from track""")
def snk4(v: Views):
    out = windows.running_metrics(v.track, ["run"], ["t", "id"], "v")
    return rounded(out.select("run", "id", F.col("v").alias("error"), F.col("running_rmse").alias("rmse")))


@query("AG17_trajectory_errors", f"""with p as (select a.run, a.id, a.t, a.x - b.x as ex, a.y - b.y as ey from (select *, row_number() over {W} as k from est) a join (select *, row_number() over {W} as k from gt) b using (run, k)),
  l as (select *, ex - lag(ex) over {W} as dx, ey - lag(ey) over {W} as dy, first_value(ex) over w as fx, first_value(ey) over w as fy, last_value(ex) over w as lx, last_value(ey) over w as ly from p window w as (partition by run order by t, id rows between unbounded preceding and unbounded following))
  select run, round(sqrt(avg(ex*ex + ey*ey)), 5) as ate, round(sqrt(avg(dx*dx + dy*dy)), 5) as rpe, round(max(sqrt(ex*ex + ey*ey)), 5) as max_error, round(sqrt((any_value(lx) - any_value(fx))*(any_value(lx) - any_value(fx)) + (any_value(ly) - any_value(fy))*(any_value(ly) - any_value(fy))), 5) as drift from l group by run""")
def ag17(v: Views):
    a, b = (select.numbered(x, ["run"], ["t", "id"], "k") for x in (v.est, v.gt))
    pairs = a.join(b.select("run", "k", F.col("x").alias("gx"), F.col("y").alias("gy")), ["run", "k"])
    return rounded(windows.consecutive_errors(pairs, ["run"], ["t", "id"]), 5)


@query("AG34_path_length", f"""select run, min(t) as first, max(t) as last, round(min(x), 5) as x_min, round(max(x), 5) as x_max, round(coalesce(sum(sqrt(dx*dx + dy*dy)), 0), 4) as length from (select *, x - lag(x) over {W} as dx, y - lag(y) over {W} as dy from track) group by run""")
def ag34(v: Views):
    out = windows.path_stats(v.track, ["run"], ["t", "id"], "t")
    return out.select("run", "first", "last", r("x_min", 5).alias("x_min"), r("x_max", 5).alias("x_max"), r("length", 4).alias("length"))


@query("AG35_stationarity", """select id, round(m, 5) as mean, round(s, 4) as variance, s < 600 as stationary from (select id, count(*) over w as n, avg(v) over w as m, var_samp(v) over w as s from track window w as (partition by run order by t, id rows between 4 preceding and current row)) where n = 5""")
def ag35(v: Views):
    out = windows.stationarity(v.track, ["run"], ["t", "id"], "v", 5, 600)
    return out.select("id", r("mean", 5).alias("mean"), r("variance", 4).alias("variance"), "stationary")


@query("SC27_time_normalize", "select id, round((t - min(t) over (partition by run)) / 1e6 + 0.5, 6) as t from track")
def sc27(v: Views):
    first = v.track.groupBy("run").agg(F.min("t").alias("t0"))
    return rounded(v.track.join(first, "run").select("id", ((F.col("t") - F.col("t0")) / 1e6 + 0.5).alias("t")))


@query("ST16_segments", f"select run, segment, count(*) as n, min(t) as first from (select *, sum(cast(coalesce(d > {30 * H}, false) as int)) over (partition by run order by t, id rows between unbounded preceding and current row) as segment from (select *, t - lag(t) over {W} as d from track)) group by run, segment".replace("select run, segment,", "select run, cast(segment as bigint) as segment,"))
def st16(v: Views):
    return windows.segments(v.track, ["run"], ["t", "id"], "t", 30 * H).groupBy("run", "segment").agg(F.count("*").alias("n"), F.min("t").alias("first"))


@query("ST10_count_windows", f"select run, w as window, min(t) as first, round(sum(v), 5) as v from (select *, (row_number() over {W} - 1) // 4 as w from track) group by run, w having count(*) = 4")
def st10(v: Views):
    return rounded(windows.count_windows(v.track, ["run"], ["t", "id"], 4).groupBy("run", "window").agg(F.min("t").alias("first"), F.sum("v").alias("v")), 5)


@query("ST11_sliding_windows", f"select run, w as start, count(*) as n from (select run, unnest([t // {6 * H}, t // {6 * H} - 1]) * {6 * H} as w from track) group by run, w")
def st11(v: Views):
    slots = F.explode(F.array(F.expr(f"(t div {6 * H}) * {6 * H}"), F.expr(f"(t div {6 * H} - 1) * {6 * H}")))
    return v.track.select("run", slots.alias("start")).groupBy("run", "start").agg(F.count("*").alias("n"))


# limits and samples

@query("LIM1_even_subsample", """with n as (select frame, id, row_number() over (partition by frame order by id) - 1 as rn, count(*) over (partition by frame) as c from pts)
  select frame, id from n where c <= 20 or rn in (select floor(i * c / 20) from range(20) t(i))""".replace("rn in (select floor(i * c / 20) from range(20) t(i))", "list_contains(list_transform(range(20), lambda i: (i * c) // 20), rn)"))
def lim1(v: Views):
    return select.even_subsample(v.pts.select("frame", "id"), 20, ["frame"], ["id"])


@query("LIM2_stride_subsample", "select frame, id from (select frame, id, row_number() over (partition by frame order by id) - 1 as rn, greatest(1, cast(ceil(count(*) over (partition by frame) / 15) as bigint)) as s from pts) where rn % s = 0 and rn // s < 15")
def lim2(v: Views):
    return select.stride_subsample(v.pts.select("frame", "id"), 15, ["frame"], ["id"])


@query("LIM3_diverse_top_k")
def lim3(v: Views):
    return grid.diverse_top_k(v.pts.select("id", "x", "y", "z", "conf"), 100, 4, "conf", "id")


@query("LIM4_nearest_voxels", "select ix, iy, n from (select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, count(*) as n from pts group by all) where (ix - 5)*(ix - 5) + (iy - 6)*(iy - 6) <= 64 order by (ix - 5)*(ix - 5) + (iy - 6)*(iy - 6), ix, iy limit 40")
def lim4(v: Views):
    cells = grid.cell_stats(v.pts, 4).select("ix", "iy", "n").withColumn("d2", F.expr("(ix - 5)*(ix - 5) + (iy - 6)*(iy - 6)"))
    return select.top_k(cells.filter("d2 <= 64"), 40, [], ["d2", "ix", "iy"]).select("ix", "iy", "n")


@query("LIM5_top_landmarks", "select instance, count(*) as observations, max(stamp) as last_seen from pts group by instance order by observations desc, last_seen desc, instance limit 50")
def lim5(v: Views):
    seen = v.pts.groupBy("instance").agg(F.count("*").alias("observations"), F.max("stamp").alias("last_seen"))
    return select.top_k(seen, 50, [], [F.desc("observations"), F.desc("last_seen"), "instance"])


GREEDY = """with recursive s as (select run, id, {value} as w, row_number() over (partition by run order by v desc, id) as n from track),
  f as (select run, n, id, [w] as kept, true as took from s where n = 1 union all select s.run, s.n, s.id, case when g.ok then list_append(f.kept, s.w) else f.kept end, g.ok from f join s on s.run = f.run and s.n = f.n + 1,
    lateral (select len(f.kept) < {cap} and list_min(list_transform(f.kept, lambda k: abs(k - s.w))) >= {apart} as ok) g) select run, id from f where took"""


@query("LIM6_suppression", GREEDY.format(value="id", cap=6, apart=80))
def lim6(v: Views):
    rows = v.track.select(F.col("run"), "id", (-F.col("v")).alias("rank"))
    return folds.fold(rows, ["run"], ["rank", "id"], folds.suppressed("id", 80, 6), "run long, id long, rank double").select("run", "id")


@query("LIM7_time_diverse", GREEDY.format(value="t", cap=8, apart=20 * H))
def lim7(v: Views):
    rows = v.track.select("run", "id", "t", (-F.col("v")).alias("rank"))
    return folds.fold(rows, ["run"], ["rank", "id"], folds.suppressed("t", 20 * H, 8), "run long, id long, t long, rank double").select("run", "id")


@query("LIM8_grid_greedy", """with recursive c as (select frame, id, conf, cast(floor(x / 10) as bigint) as ix, cast(floor(y / 20) as bigint) as iy, label from pts),
  s as (select frame, id, 'p' || ix || ',' || iy as a, 'l' || label || ',' || ix as b, row_number() over (partition by frame order by conf desc, id) as n from c),
  f as (select frame, n, id, [a, b] as taken, true as took from s where n = 1 union all select s.frame, s.n, s.id, case when g.ok then list_concat(f.taken, [s.a, s.b]) else f.taken end, g.ok from f join s on s.frame = f.frame and s.n = f.n + 1,
    lateral (select len(f.taken) < 24 and not list_contains(f.taken, s.a) and not list_contains(f.taken, s.b) as ok) g) select frame, id from f where took""")
def lim8(v: Views):
    rows = v.pts.select("frame", "id", scalars.cell(F.col("x"), 10).alias("ix"), scalars.cell(F.col("y"), 20).alias("iy"), "label", (-F.col("conf")).alias("rank"))
    return folds.fold(rows, ["frame"], ["rank", "id"], folds.one_per_cell([["ix", "iy"], ["label", "ix"]], 12), "frame long, id long, ix long, iy long, label int, rank double").select("frame", "id")


@query("LIM9_closest_per_cell", """with c as (select frame, cast(floor(x / 10) as bigint) as ix, cast(floor(y / 20) as bigint) as iy, id, conf, y, row_number() over (partition by frame, cast(floor(x / 10) as bigint), cast(floor(y / 20) as bigint) order by y, id) as rn from pts),
  k as (select *, row_number() over (partition by frame order by conf * (1 + least(10, id % 13)) desc, id) as k from c where rn = 1) select frame, id from k where k <= 8""")
def lim9(v: Views):
    rows = v.pts.select("frame", "id", "conf", "y", scalars.cell(F.col("x"), 10).alias("ix"), scalars.cell(F.col("y"), 20).alias("iy"))
    one = rows.groupBy("frame", "ix", "iy").agg(F.min_by(F.struct("id", "conf"), F.struct("y", "id")).alias("m")).select("frame", "m.*")
    return select.top_k(one, 8, ["frame"], [F.desc(F.col("conf") * (1 + F.least(F.lit(10), F.col("id") % 13))), "id"]).select("frame", "id")


@query("LIM10_strongest", "select frame, id from (select frame, id, row_number() over (partition by frame order by conf desc, id) as rn from pts) where rn <= 10")
def lim10(v: Views):
    return select.top_k(v.pts, 10, ["frame"], [F.desc("conf"), "id"]).select("frame", "id")


@query("LIM11_best_second", """select frame, arg_max(id, 3 - rn) as best, round(max(case when rn = 1 then y end), 6) as best_score, round(max(case when rn = 2 then y end), 6) as second_score, round(max(case when rn = 1 then y end) - max(case when rn = 2 then y end), 6) as gap, round(max(case when rn = 2 then y end) / max(case when rn = 1 then y end), 6) as ratio
  from (select frame, id, y, row_number() over (partition by frame order by y desc, id) as rn from pts) where rn <= 2 group by frame""")
def lim11(v: Views):
    return rounded(select.best_and_second(v.pts.select("frame", "id", "y"), ["frame"], "y", "id"))


@query("LIM12_weighted_sample")
def lim12(v: Views):
    return select.weighted_sample(v.pts.select("frame", "id", "conf"), 10, ["frame"], "conf", "id")


@query("LIM13_event_order", "select id, row_number() over (partition by run order by t, kind, id) as place from (select user_id as run, event_id as id, MICROS[ts] // 86400000000 as t, event_type as kind from events)")
def lim13(v: Views):
    rows = v.sql("select user_id as run, event_id as id, MICROS[ts] div 86400000000 as t, event_type as kind from events")
    return select.numbered(rows, ["run"], ["t", "kind", "id"]).select("id", (F.col("rn") + 1).alias("place"))


@query("LIM14_mode_cluster", f"with b as (select run, id, t // {72 * H} as b from track), c as (select run, b, row_number() over (partition by run order by count(*) desc, b) as rn from b group by run, b) select b.run, b.id from b join c on b.run = c.run and b.b = c.b and c.rn = 1")
def lim14(v: Views):
    return select.mode_cluster(v.track, 72 * H, ["run"], "t").select("run", "id")


@query("LIM15_time_crop", "select id from track where t between 1704500000000000 and 1705500000000000")
def lim15(v: Views):
    return v.track.filter(F.col("t").between(1704500000000000, 1705500000000000)).select("id")
