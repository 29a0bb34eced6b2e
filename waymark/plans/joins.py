"""Queries on joins in time and space."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from waymark.functions import pose, scalars
from waymark.operators import asof, near, retrieval, select, stats
from waymark.plans.clouds import r, rounded
from waymark.plans.registry import query
from waymark.plans.views import Views

H = 3_600_000_000
NEAREST = """select e.run, e.id, e.t, g.t as match_time, g.id as match_id, abs(e.t - g.t) as match_dt, {more} from est e left join gt g on e.run = g.run and abs(e.t - g.t) <= {tol}
  qualify row_number() over (partition by e.id order by abs(e.t - g.t), g.t, g.id) = 1"""


@query("JN1_asof_nearest", NEAREST.format(more="round(g.x, 6) as match_x", tol=6 * H))
def jn1(v: Views):
    return rounded(asof.nearest(v.est.select("run", "id", "t"), v.gt, ["run"], "t", 6 * H, "id", "id", ["x"]))


@query("JN2_asof_reverse", f"""select e.id, g.id as match_id from est e join gt g on e.run = g.run and abs(e.t - g.t) <= {H * 12} qualify row_number() over (partition by e.id order by abs(e.t - g.t), g.t, g.id) = 1""")
def jn2(v: Views):
    return asof.nearest(v.est.select("run", "id", "t"), v.gt, ["run"], "t", 12 * H, "id", "id", []).filter("match_id is not null").select("id", "match_id")


@query("JN3_nearest_keyframe", f"""with k as (select * from (select *, row_number() over (partition by run order by t, id) - 1 as rn from track) where rn % 10 = 0)
  select e.id, k.id as keyframe from track e left join k on e.run = k.run and abs(e.t - k.t) <= {24 * H} qualify row_number() over (partition by e.id order by abs(e.t - k.t), k.t, k.id) = 1""")
def jn3(v: Views):
    keys = select.every_nth(v.track, 10, ["run"], ["t", "id"])
    return asof.nearest(v.track.select("run", "id", "t"), keys, ["run"], "t", 24 * H, "id", "id", []).select("id", F.col("match_id").alias("keyframe"))


BACK = "select e.run, e.id, g.t as match_time, round(g.x, 6) as match_x from est e left join gt g on e.run = g.run and g.t <= e.t + {d} qualify row_number() over (partition by e.id order by g.t desc, g.id desc) = 1"


@query("JN4_asof_modes", BACK.format(d=2 * H))
def jn4(v: Views):
    late = v.est.select("run", "id", (F.col("t") + 2 * H).alias("t"))
    return rounded(asof.backward(late, v.gt, ["run"], "t", "id", ["x"], "id").select("run", "id", "match_time", "match_x"))


@query("JN5_stamp_or_latest", f"""with n as (select e.run, e.id, g.id as m from est e left join gt g on e.run = g.run and abs(e.t - g.t) <= {3 * H} qualify row_number() over (partition by e.id order by abs(e.t - g.t), g.t, g.id) = 1),
  l as (select run, arg_max(id, t) as latest from gt group by run) select n.id, coalesce(m, latest) as match_id, m is null and latest is not null as used_latest from n left join l using (run)""")
def jn5(v: Views):
    near_ = asof.nearest(v.est.select("run", "id", "t"), v.gt, ["run"], "t", 3 * H, "id", "id", [])
    latest = v.gt.groupBy("run").agg(F.max_by("id", "t").alias("latest"))
    return near_.join(latest, "run", "left").select("id", F.coalesce("match_id", "latest").alias("match_id"), (F.col("match_id").isNull() & F.col("latest").isNotNull()).alias("used_latest"))


@query("JN6_associate", f"""select g.id as gt_id, e.id as est_id from gt g join est e on e.run = g.run and abs(e.t - g.t) <= {8 * H} qualify row_number() over (partition by g.id order by abs(e.t - g.t), e.t, e.id) = 1""")
def jn6(v: Views):
    return asof.nearest(v.gt.select("run", "id", "t"), v.est, ["run"], "t", 8 * H, "id", "id", []).filter("match_id is not null").select(F.col("id").alias("gt_id"), F.col("match_id").alias("est_id"))


@query("JN7_gps_optional", f"""select e.id, g.id as match_id, coalesce(abs(e.t - g.t) <= {H}, false) as synchronised from est e left join gt g on e.run = g.run and abs(e.t - g.t) <= {30 * H} qualify row_number() over (partition by e.id order by abs(e.t - g.t), g.t, g.id) = 1""")
def jn7(v: Views):
    m = asof.nearest(v.est.select("run", "id", "t"), v.gt, ["run"], "t", 30 * H, "id", "id", [])
    return m.select("id", "match_id", F.coalesce(F.col("match_dt") <= H, F.lit(False)).alias("synchronised"))


@query("JN11_interpolate", f"""with b as (select e.run, e.id, e.t, g.t as t0, g.x as x0 from est e left join gt g on e.run = g.run and g.t <= e.t qualify row_number() over (partition by e.id order by g.t desc, g.id desc) = 1),
  a as (select e.id, g.t as t1, g.x as x1 from est e left join gt g on e.run = g.run and g.t > e.t qualify row_number() over (partition by e.id order by g.t, g.id) = 1)
  select run, b.id, t, round(case when t0 is not null and t1 is not null then case when t1 - t0 <= {200 * H} then x0 + (t - t0) / cast(t1 - t0 as double) * (x1 - x0) when t0 = t then x0 end when t0 is not null and t - t0 <= {5 * H} then x0 when t1 is not null and t1 - t <= {5 * H} then x1 end, 6) as x from b join a using (id)""")
def jn11(v: Views):
    return rounded(asof.interpolate(v.est.select("run", "id", "t"), v.gt, ["run"], "t", "id", "x", 200 * H, 5 * H, "id"))


@query("JN12_pose_interpolate", """with q as (select run, id, t + 1000000 as t from poses where id % 3 = 0), k as (select * from poses where id % 3 <> 0),
  b as (select q.run, q.id, q.t, k.t as t0, k.x as x0, k.y as y0, k.qw as w0, k.qz / 0.8 as s0 from q join k on q.run = k.run and k.t <= q.t qualify row_number() over (partition by q.id order by k.t desc, k.id desc) = 1),
  a as (select q.id, k.t as t1, k.x as x1, k.y as y1, k.qw as w1, k.qz / 0.8 as s1 from q join k on q.run = k.run and k.t > q.t qualify row_number() over (partition by q.id order by k.t, k.id) = 1),
  j as (select *, (t - t0) / cast(t1 - t0 as double) as f, w0*w1 + s0*s1 as d from b join a using (id)),
  k2 as (select *, least(1, abs(d)) as c, case when d < 0 then -1 else 1 end as sg from j),
  k3 as (select *, acos(case when c > 0.9995 then 0.5 else c end) as th from k2),
  k4 as (select *, case when c > 0.9995 then 1 - f else sin((1 - f) * th) / sin(th) end as p, sg * case when c > 0.9995 then f else sin(f * th) / sin(th) end as q from k3),
  k5 as (select *, p*w0 + q*w1 as w, p*s0 + q*s1 as s from k4)
  select id, round(x0 + f * (x1 - x0), 5) as x, round(y0 + f * (y1 - y0), 5) as y, round(w / sqrt(w*w + s*s), 5) as qw, round(0.8 * s / sqrt(w*w + s*s), 5) as qz from k5""")
def jn12(v: Views):
    left = v.poses.filter("id % 3 = 0").select("run", "id", (F.col("t") + 1_000_000).alias("t"))
    rows = asof.around(left, v.poses.filter("id % 3 <> 0"), ["run"], "t", "id", ["x", "y", "qw", "qx", "qy", "qz"], "id").filter("before is not null and after is not null")
    share = asof.interpolation_share()
    names = ("qw", "qx", "qy", "qz")
    q = pose.slerp(tuple(F.col(f"before.{n}") for n in names), tuple(F.col(f"after.{n}") for n in names), share)
    lerp = lambda c: F.col(f"before.{c}") + share * (F.col(f"after.{c}") - F.col(f"before.{c}"))
    return rounded(rows.select("id", lerp("x").alias("x"), lerp("y").alias("y"), q[0].alias("qw"), q[3].alias("qz")), 5)


@query("JN13_correction_interpolate", """with k as (select * from (select *, row_number() over (partition by run order by t, id) - 1 as rn from track) where rn % 10 = 0), n as (select run, t as t0, v as c0, lead(t) over w as t1, lead(v) over w as c1 from k window w as (partition by run order by t, id))
  select s.id, round(s.x + c0 + coalesce((s.t - t0) / cast(t1 - t0 as double) * (c1 - c0), 0), 5) as x from track s join n on s.run = n.run and s.t >= t0 and (t1 is null or s.t < t1)""")
def jn13(v: Views):
    keys = select.every_nth(v.track, 10, ["run"], ["t", "id"]).select("run", "id", "t", F.col("v").alias("c"))
    rows = asof.around(v.track.select("run", "id", "t"), keys, ["run"], "t", "id", ["c"], "id").withColumn("f", asof.interpolation_share())
    c = F.coalesce(F.col("before.c"), F.col("after.c")) + F.coalesce(F.col("f") * (F.col("after.c") - F.col("before.c")), F.lit(0.0))
    return rounded(rows.select("id", c.alias("c")).join(v.track.select("id", "x"), "id").select("id", (F.col("x") + F.col("c")).alias("x")), 5)


#: Points of each frame, and those of the next one, by the number of the pair.
A, B = "(select *, frame as pair from pts)", "(select *, frame - 1 as pair from pts where frame > 0)"
NN = "select pair, id, other, d from (select a.pair, a.id, b.id as other, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) as d, row_number() over (partition by a.pair, a.id order by sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), b.id) as rn from {a} a join {b} b on a.pair = b.pair and a.label = b.label and sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) < 15) k where rn = 1"


def frames(v: Views, later: int, name: str = "id"):
    """Points by pair of frames: of the earlier (0) or the later one (1)."""
    return v.pts.filter(F.col("frame") >= later).select((F.col("frame") - later).alias("pair"), F.col("id").alias(name), "x", "y", "z", "label", "conf")


@query("JN14_grid_nearest", f"select id, other, round(d, 6) as distance from ({NN.format(a=A, b=B)})")
def jn14(v: Views):
    return rounded(near.grid_nearest(frames(v, 0), frames(v, 1, "other"), 15, "id", "other", ["pair"], ["label"]))


MNN = f"select p.pair, p.id, p.other, p.d from ({NN.format(a=A, b=B)}) p join ({NN.format(a=B, b=A)}) q on p.pair = q.pair and p.id = q.other and p.other = q.id"


def mutual(v: Views):
    return near.mutual_nearest(frames(v, 0), frames(v, 1, "other"), 15, "id", "other", ["pair"], ["label"])


@query("JN15_mutual_nearest", f"select id, other, round(d, 6) as distance from ({MNN})")
def jn15(v: Views):
    return rounded(mutual(v))


@query("JN16_anchor_match", f"select id, other, round(d, 6) as distance from (select *, row_number() over (partition by other order by d, id) as rn from ({MNN})) where rn = 1 and d < 10")
def jn16(v: Views):
    return rounded(select.top_k(mutual(v).filter("distance < 10"), 1, ["other"], ["distance", "id"]))


LC = "select pair, label, cast(floor(x / 10) as bigint) as ix, cast(floor(y / 10) as bigint) as iy, count(*) as n from {f} f group by all"


@query("JN17_labelled_cell", f"""select a.pair, a.label, a.ix, a.iy, b.ix as bx, b.iy as b_y from ({LC.format(f=A)}) a join ({LC.format(f=B)}) b on a.pair = b.pair and a.label = b.label and abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1
  qualify row_number() over (partition by a.pair, a.label, a.ix, a.iy order by (a.ix-b.ix)*(a.ix-b.ix) + (a.iy-b.iy)*(a.iy-b.iy), b.iy, b.ix) = 1""")
def jn17(v: Views):
    from waymark.operators.grid import neighbours, with_cells

    cells = lambda k: with_cells(frames(v, k), 10, ("x", "y")).groupBy("pair", "label", "ix", "iy").agg(F.count("*").alias("n"))
    a = neighbours(cells(0).select("pair", "label", "ix", "iy", F.col("ix").alias("ax"), F.col("iy").alias("ay")), 1)
    pairs = a.join(cells(1).select("pair", "label", "ix", "iy"), ["pair", "label", "ix", "iy"])
    d2 = (F.col("ax") - F.col("ix")) ** 2 + (F.col("ay") - F.col("iy")) ** 2
    best = pairs.groupBy("pair", "label", "ax", "ay").agg(F.min(F.struct(d2.alias("d2"), "iy", "ix")).alias("m"))
    return best.select("pair", "label", F.col("ax").alias("ix"), F.col("ay").alias("iy"), F.col("m.ix").alias("bx"), F.col("m.iy").alias("b_y"))


@query("JN18_mature_anchor", f"""with b as (select *, row_number() over (partition by pair, label order by id) as age from {B} f) select a.id, b.id as anchor from {A} a join b on a.pair = b.pair and a.label = b.label and b.age >= 2 and b.conf >= 0.06 and sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) < 25
  qualify row_number() over (partition by a.id order by sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), b.id) = 1""")
def jn18(v: Views):
    anchors = select.numbered(frames(v, 1, "anchor"), ["pair", "label"], ["anchor"]).filter("rn >= 1 and conf >= 0.06")
    return near.grid_nearest(frames(v, 0), anchors, 25, "id", "anchor", ["pair"], ["label"]).select("id", "anchor")


@query("JN19_nearest_cell", """select p.id, r.ix, r.iy, (r.ix-p.ix)*(r.ix-p.ix) + (r.iy-p.iy)*(r.iy-p.iy) as d2 from (select id, cast(floor(x) as bigint) as ix, cast(floor(y / 5) as bigint) as iy from pts) p join (select * from raster where occ > 0.5) r on abs(r.ix-p.ix) <= 2 and abs(r.iy-p.iy) <= 2
  qualify row_number() over (partition by p.id order by d2, r.iy, r.ix) = 1""")
def jn19(v: Views):
    points = v.pts.select("id", scalars.cell(F.col("x"), 1).alias("ix"), scalars.cell(F.col("y"), 5).alias("iy"))
    return near.nearest_cell(points, v.raster.filter("occ > 0.5"), 2, "id")


WORDS = "select vec_id, label, list_reduce(list_transform(embedding[2:64], lambda x: cast(x > 0 as bigint)), lambda a, x: (a << 1) | x) as w from embeddings"


def words(v: Views):
    return v.embeddings.select("vec_id", "label", scalars.sign_bits(F.slice("embedding", 2, 63)).alias("w"))


def words_nearest(v: Views, most: int):
    """The nearest vectors of its label, by their signs, of every twentieth."""
    w = words(v)
    q = w.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "label", F.col("w").alias("wq"))
    return near.nearest_words(q, w.select(F.col("vec_id").alias("item"), "label", "w"), ["label"], "q", "item", most)


@query("JN22_hamming_ratio", f"""with w as ({WORDS}), p as (select a.vec_id as q, b.vec_id as item, bit_count(xor(a.w, b.w)) as d from w a join w b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
  k as (select *, row_number() over (partition by q order by d, item) as rn from p)
  select a.q, a.item, cast(a.d as int) as d, cast(b.d as int) as second from k a join k b on a.q = b.q and a.rn = 1 and b.rn = 2 where a.d < 0.85 * b.d""")
def jn22(v: Views):
    return near.clear_nearest(words_nearest(v, 2), "q", "item", "d", 0.85).select("q", "item", "d", "second")


_GREEDY = f"""with recursive w as ({WORDS}), p as (select a.label, a.vec_id as q, b.vec_id as item, cast(bit_count(xor(a.w, b.w)) as int) as d from w a join w b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
  k as (select * from p qualify row_number() over (partition by q order by d, item) <= 4), n as (select *, row_number() over (partition by label order by d, q, item) as rn from k where item % 3 <> 0),
  walk as (select label, cast(0 as bigint) as rn, cast([] as bigint[]) as lefts, cast([] as bigint[]) as rights, false as hit from n group by label
    union all select n.label, n.rn, case when f.free then list_append(walk.lefts, n.q) else walk.lefts end, case when f.free then list_append(walk.rights, n.item) else walk.rights end, f.free from walk join n on n.label = walk.label and n.rn = walk.rn + 1,
    lateral (select not list_contains(walk.lefts, n.q) and not list_contains(walk.rights, n.item) as free) f)
  select n.label, n.q, n.item, n.d from n join walk on walk.label = n.label and walk.rn = n.rn where walk.hit"""


@query("JN22_one_to_one", _GREEDY)
def jn22_one_to_one(v: Views):
    """Of each query's four nearest items those with depth, matched one to one within a label, nearest first."""
    nearest = words_nearest(v, 4).filter("item % 3 <> 0")
    return retrieval.greedy_matching(nearest, ["label"], "q", "item", ["d"])


@query("JN23_keypoint_depth", """with z as (select ix, iy, min(z) as depth from (select cast(floor(x) as bigint) as ix, cast(floor(y / 5) as bigint) as iy, z from pts) group by ix, iy)
  select r.ix, r.iy, round(arg_min(depth, ((z.ix-r.ix)*(z.ix-r.ix) + (z.iy-r.iy)*(z.iy-r.iy)) * 1000000.0 + depth), 6) as depth from raster r join z on abs(z.ix-r.ix) <= 2 and abs(z.iy-r.iy) <= 2 where r.occ > 0.8 and (z.ix-r.ix)*(z.ix-r.ix) + (z.iy-r.iy)*(z.iy-r.iy) <= 4 group by r.ix, r.iy""")
def jn23(v: Views):
    from waymark.operators.grid import neighbours

    buffer = v.pts.select(scalars.cell(F.col("x"), 1).alias("ix"), scalars.cell(F.col("y"), 5).alias("iy"), "z").groupBy("ix", "iy").agg(F.min("z").alias("depth"))
    keys = neighbours(v.raster.filter("occ > 0.8").select("ix", "iy", F.col("ix").alias("u"), F.col("iy").alias("w")), 2)
    d2 = (F.col("u") - F.col("ix")) ** 2 + (F.col("w") - F.col("iy")) ** 2
    pairs = keys.join(buffer, ["ix", "iy"]).withColumn("d2", d2).filter("d2 <= 4")
    return rounded(pairs.groupBy("u", "w").agg(F.min_by("depth", F.struct("d2", "depth")).alias("depth")).select(F.col("u").alias("ix"), F.col("w").alias("iy"), "depth"))


@query("JN24_loop_candidates", f"select a.run, a.id as later, b.id as earlier, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)), 5) as distance from track a join track b on a.run = b.run and a.t - b.t >= {24 * H} and a.id - b.id >= 20 and sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) <= 40")
def jn24(v: Views):
    return rounded(near.space_time_candidates(v.track, ["run"], "id", "t", 40, 24 * H, 20), 5)


GATED = f"""with s as (select run, id, t, x, y, radians(id % 360) as yaw, v, cast(id % 7 as double) as d1, cast(id % 5 + 1 as double) as d2 from track),
  p as (select a.run, a.id as later, b.id as earlier, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)) as distance, (a.v * b.v + a.d1 * b.d1 + a.d2 * b.d2) / sqrt((a.v * a.v + a.d1 * a.d1 + a.d2 * a.d2) * (b.v * b.v + b.d1 * b.d1 + b.d2 * b.d2)) as similarity,
    abs(atan2(sin(a.yaw - b.yaw), cos(a.yaw - b.yaw))) as turn from s a join s b on a.run = b.run and a.t - b.t >= {24 * H} and a.id - b.id >= 20)
  select run, later, earlier, round(distance, 5) as distance, round(similarity, 5) as similarity, cast(row_number() over (partition by run, later order by round(similarity, 6) desc, distance, earlier) as int) as rank from p
  where distance <= 150 and turn <= 1.2 and similarity >= 0.99 qualify rank <= 5"""


@query("JN24_gated_candidates", GATED)
def jn24_gated(v: Views):
    """Loop candidates near in space, far in time, alike in heading and descriptor, the five most similar of each row."""
    rows = v.track.select("run", "id", "t", "x", "y", F.radians(F.col("id") % 360).alias("yaw"), F.array("v", (F.col("id") % 7).cast("double"), (F.col("id") % 5 + 1).cast("double")).alias("d"))
    return rounded(near.gated_candidates(rows, ["run"], "id", "t", 150, 24 * H, 20, "yaw", 1.2, "d", 0.99, 5), 5)


#: Thresholds whose signs make 256 bits of 64 numbers, and features of a keyframe.
LEVELS, FEATURES = (0.0, 0.08, -0.08, 0.16), 10
_CODED = " union all ".join(f"select k, vec_id, {t} as t, " + " + ".join(f"(bits[{(17 + 37 * t + 11 * b) % 256 + 1}] << {b})" for b in range(17)) + " as code from f" for t in range(6))


def features(v: Views):
    """Ten vectors of one label are a keyframe's features, their order within the label its time."""
    bits = [F.col("embedding")[d % 64].cast("double") > LEVELS[d // 64] for d in range(256)]
    n = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    rows = v.embeddings.withColumn("n", F.floor(n / FEATURES).cast("long"))
    return rows.select((F.col("n") * 1000 + F.col("label")).alias("keyframe"), F.col("n").alias("t"), retrieval.descriptor_of(bits).alias("descriptor"))


@query("JN25_keyframe_votes", f"""with f as (select n * 1000 + label as k, vec_id, n, list_concat({", ".join(f"list_transform(embedding, lambda x: cast(cast(x as double) > {x} as bigint))" for x in LEVELS)}) as bits from (select *, (row_number() over (partition by label order by vec_id) - 1) // {FEATURES} as n from embeddings) e),
  c as ({_CODED}), asked as (select distinct k, vec_id, t, code from c), kept as (select distinct k, t, code from c),
  votes as (select a.k as keyframe, b.k as candidate, cast(count(*) as bigint) as votes, cast(count(distinct a.t) as bigint) as tables from asked a join kept b on a.t = b.t and a.code = b.code and a.k - b.k >= 500 group by a.k, b.k)
  select *, cast(row_number() over (partition by keyframe order by votes desc, tables desc, candidate) as int) as rank from votes where votes >= 2 and tables >= 2 qualify rank <= 5""")
def jn25_votes(v: Views):
    """Each keyframe's five best earlier ones by votes of its features in an index to which three parts were appended."""
    rows = features(v)
    name = f"keyframes_{uuid.uuid4().hex}"
    index = retrieval.KeyframeIndex(v.spark, name, f"{select.shared_folder(v.spark)}/{name}")
    for part in range(3):
        index.append(rows.filter(F.col("keyframe") % 3 == part))
    return index.candidates(rows, 500, 1, 2, 2, 5)


CODES = " union all ".join(f"select vec_id, {t} as t, " + " | ".join(f"(((w >> {(17 + 37 * t + 11 * b) % 64}) & 1) << {b})" for b in range(17)) + " as code from w" for t in range(6))


@query("JN25_lsh_candidates", f"with w as ({WORDS}), c as ({CODES}) select a.vec_id as a, b.vec_id as b, count(distinct a.t) as tables from c a join c b on a.t = b.t and a.code = b.code and a.vec_id < b.vec_id group by all")
def jn25(v: Views):
    return near.lsh_candidates(words(v), "vec_id", F.col("w"), 6, 17, 1)


@query("JN26_used_pairs", "select run, i, j from edges where not exists (select 1 from (select run, i, j from edges where not loop) u where u.run = edges.run and u.j = edges.j and u.i % 2 = 0) and loop")
def jn26(v: Views):
    used = v.edges.filter("not loop and i % 2 = 0").select("run", "j").distinct()
    return v.edges.filter("loop").join(used, ["run", "j"], "left_anti").select("run", "i", "j")


@query("JN27_candidate_union", """with n as (select run, i, j, dx from edges where not loop), g as (select run, i, j, dx from edges where (loop or i % 3 = 0)), m as (select * from g anti join n using (run, i, j)),
  k as (select *, row_number() over (partition by run order by dx desc, run, i, j) as rn from m)
  select run, i, j, round(dx, 8) as dx, 'near' as source from n union all select run, i, j, round(dx, 8), 'global' from k where rn <= 3""")
def jn27(v: Views):
    near_, wide = v.edges.filter("not loop").drop("loop"), v.edges.filter("loop or i % 3 = 0").drop("loop")
    return rounded(near.union_with_priority(near_, wide, ["run", "i", "j"], "run", "dx", 3), 8)


@query("JN28_grid_lookup", "select p.id, round(coalesce(r.occ, 0), 6) as occ from pts p left join raster r on r.ix = cast(floor(x) as bigint) and r.iy = cast(floor(y / 5) as bigint)")
def jn28(v: Views):
    points = v.pts.select("id", scalars.cell(F.col("x"), 1).alias("ix"), scalars.cell(F.col("y"), 5).alias("iy"))
    return rounded(points.join(v.raster.select("ix", "iy", "occ"), ["ix", "iy"], "left").select("id", F.coalesce("occ", F.lit(0.0)).alias("occ")))


@query("JN29_raster_sampling", "select frame, round(avg(cast(r.ix is not null as int)), 6) as coverage, round(avg(case when r.label > 0 then 1 else 0 end), 6) as known from pts p left join raster r on r.ix = cast(floor((x + 10) / 80 * 64) as bigint) and r.iy = cast(floor((110 - y) / 120 * 64) as bigint) group by frame")
def jn29(v: Views):
    u, w = F.floor((F.col("x") + 10) / 80 * 64).cast("long"), F.floor((110 - F.col("y")) / 120 * 64).cast("long")
    rows = v.pts.select("frame", u.alias("ix"), w.alias("iy")).join(v.raster.select("ix", "iy", "label", F.lit(1).alias("hit")), ["ix", "iy"], "left")
    return rounded(rows.groupBy("frame").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("coverage"), F.avg(F.coalesce((F.col("label") > 0).cast("int"), F.lit(0))).alias("known")))


@query("OPT9_height_consensus", f"""with m as ({MNN}), h as (select m.pair, a.z - b.z as dz from m join pts a on a.id = m.id and a.frame = m.pair join pts b on b.id = m.other and b.frame = m.pair + 1), c as (select pair, median(dz) as m from h where abs(dz) < 4 group by pair),
  i as (select h.pair, dz from h join c using (pair) where abs(dz) < 4 and abs(dz - m) < 1.5), f as (select pair, median(dz) as f, count(*) as n from i group by pair), d as (select pair, median(abs(dz - f)) as mad from i join f using (pair) group by pair)
  select pair, round(f, 6) as dz, round(mad, 6) as mad, n, n >= 5 and abs(f) <= 1 and mad <= 1 as accepted from f join d using (pair)""")
def opt9(v: Views):
    """Height between each frame and the next: median of the mutual matches near the median of all."""
    a, b = frames(v, 0).withColumnRenamed("z", "za"), frames(v, 1, "other").withColumnRenamed("z", "zb")
    z = near.mutual_nearest(a, b, 15, "id", "other", ["pair"], ["label"], ["pair", "za"], ["zb"]).select("pair", (F.col("za") - F.col("zb")).alias("dz"))
    broad = z.filter("abs(dz) < 4")
    inner = broad.join(broad.groupBy("pair").agg(F.median("dz").alias("m")), "pair").filter("abs(dz - m) < 1.5").select("pair", "dz")
    out = stats.median_mad(inner, ["pair"], "dz").join(inner.groupBy("pair").agg(F.count("*").alias("n")), "pair")
    return out.select("pair", r("median").alias("dz"), r("mad").alias("mad"), "n", ((F.col("n") >= 5) & (F.abs("median") <= 1) & (F.col("mad") <= 1)).alias("accepted"))
