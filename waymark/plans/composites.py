"""Queries that compose operators: registration, controllers, back-ends, landmark upkeep."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from waymark.operators import asof, backend, equations, estimate, folds, landmarks, raster, registration, select
from waymark.plans.clouds import r, rounded
from waymark.plans.registrations import false_matches
from waymark.plans.registry import query
from waymark.plans.views import Views
from waymark.sources import sinks

H = 3_600_000_000


@query("FIL23_ground_truth", f"""with o as (select run, arg_min(x, (t, id)) as x0, arg_min(y, (t, id)) as y0 from est group by run),
  n as (select e.id, g.w from est e left join imu g on e.run = g.run and abs(e.t - g.t) <= {10 * H} qualify row_number() over (partition by e.id order by abs(e.t - g.t), g.t, g.id) = 1)
  select e.id, round(e.x - x0, 6) as east, round(e.y - y0, 6) as north, round(w, 6) as yaw, case when e.id % 5 = 0 then 100.0 else 0.04 end as variance from est e join o using (run) join n on n.id = e.id where e.id % 7 <> 0""")
def fil23(v: Views):
    origin = v.est.groupBy("run").agg(F.min_by("x", F.struct("t", "id")).alias("x0"), F.min_by("y", F.struct("t", "id")).alias("y0"))
    fixes = v.est.withColumn("status", F.col("id") % 7).filter("status > 0").select("run", "id", "t", "x", "y")  # 0: no fix
    near = asof.nearest(fixes, v.imu, ["run"], "t", 10 * H, "id", "id", ["w"]).join(origin, "run")
    return rounded(near.select("id", (F.col("x") - F.col("x0")).alias("east"), (F.col("y") - F.col("y0")).alias("north"), F.col("match_w").alias("yaw"), F.when(F.col("id") % 5 == 0, 100.0).otherwise(0.04).alias("variance")))


@query("SNK6_pose_recorder", f"""with recursive s as (select *, row_number() over (partition by run order by t, id) as n from track),
  f as (select run, n, id, t as last, true as kept, t, x, y from s where n = 1 union all select s.run, s.n, s.id, case when s.t - f.last >= {20 * H} then s.t else f.last end, s.t - f.last >= {20 * H}, s.t, s.x, s.y from f join s on s.run = f.run and s.n = f.n + 1)
  select run, id, printf('%.3f', (t // 1000) / 1000.0) || chr(9) || printf('%.4f', x) || chr(9) || printf('%.4f', y) as line from f where kept""")
def snk6(v: Views):
    kept = folds.fold(v.track.select("run", "id", "t", "x", "y"), ["run"], ["t", "id"], folds.rate_gate("t", 20 * H), "run long, id long, t long, x double, y double")
    return kept.select("run", "id", F.concat_ws("\t", F.format_string("%.3f", F.expr("t div 1000") / 1e3), F.format_string("%.4f", "x"), F.format_string("%.4f", "y")).alias("line"))


@query("SNK7_queue_export", """select event_id as id, '{"id":"' || printf('%06d', event_id) || '","session":"s' || user_id || '","stamp":{"secs":' || epoch_us(ts) // 1000000 || ',"nsecs":' || (epoch_us(ts) % 1000000) * 1000 || '}}' as document from events""")
def snk7(v: Views):
    rows = v.sql("select event_id as id, user_id, MICROS[ts] as t from events")
    stamp = F.struct(F.expr("t div 1000000").alias("secs"), (F.col("t") % 1000000 * 1000).alias("nsecs"))
    return rows.select("id", F.to_json(F.struct(F.format_string("%06d", "id").alias("id"), F.concat(F.lit("s"), "user_id").alias("session"), stamp.alias("stamp"))).alias("document"))


@query("SC35_information", """with s as (select frame, var_pop(x) + 0.1 as a, covar_pop(x, y) as b, var_pop(y) + 0.1 as c from pts group by frame) select frame, round(case when a*c - b*b > 1e-6 then c / (a*c - b*b) else 1 end, 6) as i00, round(case when a*c - b*b > 1e-6 then -b / (a*c - b*b) else 0 end, 6) + 0.0 as i01, round(case when a*c - b*b > 1e-6 then a / (a*c - b*b) else 1 end, 6) as i11 from s""")
def sc35(v: Views):
    s = v.pts.groupBy("frame").agg((F.var_pop("x") + 0.1).alias("a"), F.covar_pop("x", "y").alias("b"), (F.var_pop("y") + 0.1).alias("c"))
    det = F.col("a") * F.col("c") - F.col("b") ** 2
    inverse = lambda top, otherwise: F.when(det > 1e-6, F.col(top) / det).otherwise(otherwise)
    return rounded(s.select("frame", inverse("c", 1.0).alias("i00"), (-inverse("b", 0.0)).alias("i01"), inverse("a", 1.0).alias("i11")))


@query("GRF10_sobel", """select c.ix, c.iy, round(sum(n.occ * (n.ix - c.ix) * (2 - abs(n.iy - c.iy))), 6) + 0.0 as gx, round(sum(n.occ * (n.iy - c.iy) * (2 - abs(n.ix - c.ix))), 6) + 0.0 as gy from raster c join raster n on abs(n.ix - c.ix) <= 1 and abs(n.iy - c.iy) <= 1 group by c.ix, c.iy""")
def grf10(v: Views):
    return rounded(raster.sobel(v.raster, "occ"))


@query("UDF1_labelling_backend", "select id, cast(case when z < 1 then 0 when z < 2 then 1 when z < 4 then 2 else 3 end as int) as label, round(greatest(0, least(1, 1 - abs(z - 2) / 10)), 6) as conf from pts")
def udf1(v: Views):
    return rounded(backend.label_points(v.pts.select("id", "x", "y", "z"), "waymark.operators.backend:HeightBands", ["id"]))


@query("UDF2_request_result", "select event_id as id, cast(json_extract_string(props, '$.k') as bigint) * 2 as result from events")
def udf2(v: Views):
    """Requests go out as documents, results come back as documents and meet by id."""
    requests = sinks.request_document(v.events.select(F.col("event_id").alias("id"), F.get_json_object("props", "$.k").cast("double").alias("k")), "id", ["k"])
    results = requests.select(F.to_json(F.struct(F.get_json_object("document", "$.request_id").cast("long").alias("id"), (F.get_json_object("document", "$.meta[0]").cast("double") * 2).cast("long").alias("result"))).alias("document"))
    back = results.select(F.from_json("document", "id bigint, result bigint").alias("r")).select("r.*")
    return requests.select("id").join(back, "id")


@query("EST14_planar_controller")
def est14(v: Views):
    """Corrections of four runs: the consensus of each frame's features, its robust fit over the inliers, then the controller."""
    # a frame's features are as many as it has cells, so they are stored and the points looked at once
    rows = select.checkpointed(false_matches(v, (F.col("frame") % 16) * 0.002, 0.5 + (F.col("frame") % 8) * 0.1, F.lit(-0.4)))
    marked = select.checkpointed(registration.weighted_consensus(rows, ["frame"], "id", registration.with_gates(hypotheses=150, inlier=0.3, max_yaw=0.2)))
    counts = marked.groupBy("frame").agg(F.count("*").alias("n"), F.count_if("inlier").alias("inliers"))
    inliers = rows.join(marked.filter("inlier").select("frame", "id"), ["frame", "id"])
    fits = equations.planar_rounds(inliers, ["frame"], 0.3, 3)
    frames = counts.join(fits, "frame", "left").select((F.col("frame") % 4).alias("run"), F.col("frame").alias("id"), "n", "inliers", *[F.round(c, 6).alias(c) for c in ("yaw", "x", "y")])
    out = folds.fold(frames, ["run"], ["id"], estimate.plane_controller(), "run long, id long, n long, inliers long, yaw double, x double, y double, cx double, cy double, ca double, streak long, reason string")
    return rounded(out.select("id", "cx", "cy", "ca", "streak", "reason"), 4)


def landmark_upkeep(missed_most: int) -> Callable:
    """Observed landmarks gain weight, others that should have been seen miss; too many misses in a row remove them. Returns a row's outcome."""

    def start():
        def step(state, row):
            weight, missed = state
            if row["seen"]:
                weight, missed = min(10, weight + 1), 0
            else:
                missed += 1
                if missed > missed_most:
                    return (0, 0), [{**row, "weight": 0, "culled": True}]
            return (weight, missed), [{**row, "weight": weight, "culled": False}]

        return (0, 0), step

    return start


@query("VIS3_landmark_upkeep", """with recursive s as (select instance as landmark, id, label > 2 as seen, row_number() over (partition by instance order by stamp, id) as n from pts),
  f as (select landmark, n, id, case when seen then 1 else 0 end as weight, case when seen then 0 else 1 end as missed, false as culled from s where n = 1 union all
    select s.landmark, s.n, s.id, case when s.seen then least(10, f.weight + 1) when f.missed + 1 > 2 then 0 else f.weight end, case when s.seen or f.missed + 1 > 2 then 0 else f.missed + 1 end, not s.seen and f.missed + 1 > 2 from f join s on s.landmark = f.landmark and s.n = f.n + 1)
  select id, cast(weight as bigint) as weight, culled from f""")
def vis3(v: Views):
    rows = v.pts.select(F.col("instance").alias("landmark"), "stamp", "id", (F.col("label") > 2).alias("seen"))
    return folds.fold(rows, ["landmark"], ["stamp", "id"], landmark_upkeep(2), "landmark long, stamp long, id long, seen boolean, weight long, culled boolean").select("id", "weight", "culled")


WALL = landmarks.Landmarks(width=96, height=64, fx=60.0, fy=60.0, cx=48.0, cy=32.0, grid=6, max_missed=3, refresh=3)


def wall_frames(v: Views):
    """Sixteen frames of each of four runs along a wall five metres off, with their pixels and points; four frames believe to be elsewhere. Rows for landmarks.keep_map()."""
    frames = v.pts.select("frame").distinct().select((F.col("frame") % 4).alias("run"), F.floor(F.col("frame") / 4).cast("long").alias("k"))
    true = F.col("k") * 0.12
    believed = true + F.when(F.col("k").between(6, 9), 0.3).otherwise(0.0)
    posed = frames.select("run", "k", F.array(*[F.lit(c) for c in (1.0, 0.0, 0.0, 0.0)]).alias("q"), F.array(believed, F.lit(0.0), F.lit(0.0)).alias("p"), (F.col("k") % 3 != 1).alias("accepted"))
    places = frames.withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(WALL.width - 1)))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(WALL.height - 1))))
    x, y = (F.col("u") - WALL.cx) / 12 + true, (F.col("v") - WALL.cy) / 12
    value = 120 + 50 * F.sin(9 * x + F.col("run") * 0.7) + 40 * F.cos(8 * y) + 20 * F.sin(5 * (x + y))
    masked = F.col("u").between(F.col("k") * 6, F.col("k") * 6 + 8) & (F.col("v") < 32)
    pixels = places.select("run", "k", "u", "v", value.alias("value"), F.pmod(F.floor(x + 10), F.lit(7)).alias("label"), masked.alias("masked"))
    points = v.pts.select((F.col("frame") % 4).alias("run"), F.floor(F.col("frame") / 4).cast("long").alias("k"), "id", (F.col("x") / 7 - 3.2).alias("x"), (F.col("y") / 25 - 2.1).alias("y"), F.lit(5.0).alias("z"), "label", F.col("conf").alias("weight"))
    return landmarks.frame_rows(posed, pixels, points, ["run", "k"], WALL)


@query("VIS3_landmark_map")
def vis3_map(v: Views):
    """What each frame does to its run's landmark map: compared, confirmed, hidden, seeded, culled."""
    out = folds.fold(wall_frames(v), ["run"], ["k"], landmarks.keep_map("k", WALL), f"run long, k long, {landmarks.FRAME_OUTPUT}")
    return rounded(out, 4)


@query("VIS3_landmarks")
def vis3_landmarks(v: Views):
    """The landmarks that each run ends with."""
    out = folds.fold(wall_frames(v), ["run"], ["k"], landmarks.keep_map("k", WALL, ["run"]), f"run long, {landmarks.LANDMARK_OUTPUT}")
    return rounded(out, 5)
