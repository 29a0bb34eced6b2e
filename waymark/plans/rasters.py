"""Queries on rasters, graphs and exhaustive searches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from waymark.functions import pose, scalars
from waymark.operators import filters, graph, grid, raster, search, select, stats
from waymark.plans.clouds import PAIRS, r, rounded
from waymark.plans.registry import query
from waymark.plans.views import Views

OCC = "select ix, iy from raster where occ > 0.8"
COMPONENTS = """n as (select ix * 100 + iy as node, ix, iy from c), e as (select a.node as a, b.node as b from n a join n b on abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1),
  f as (select node, node as root from n union select e.b, f.root from f join e on e.a = f.node), m as (select node, min(root) as component from f group by node)"""


def cells(v: Views, df):
    return df.select("ix", "iy", (F.col("ix") * 100 + F.col("iy")).alias("node"))


@query("GRF1_components", f"with recursive c as ({OCC}), {COMPONENTS} select node, component, count(*) over (partition by component) as size from m qualify size >= 2")
def grf1(v: Views):
    nodes = cells(v, v.raster.filter("occ > 0.8"))
    return graph.large_components(nodes, raster.neighbour_pairs(nodes), 2)


@query("GRF2_label_components", """with recursive n as (select ix * 100 + iy as node, ix, iy, label from raster where label in (1, 2, 3)), e as (select a.node as a, b.node as b from n a join n b on a.label = b.label and abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1),
  f as (select node, node as root from n union select e.b, f.root from f join e on e.a = f.node) select node, min(root) as instance from f group by node""")
def grf2(v: Views):
    nodes = v.raster.filter("label in (1, 2, 3)").select("ix", "iy", "label", (F.col("ix") * 100 + F.col("iy")).alias("node"))
    return graph.components(nodes, raster.neighbour_pairs(nodes, ["label"])).withColumnRenamed("component", "instance")


@query("GRF3_small_components", f"with recursive c as ({OCC}), {COMPONENTS} select node from m qualify count(*) over (partition by component) >= 3")
def grf3(v: Views):
    nodes = cells(v, v.raster.filter("occ > 0.8"))
    return graph.large_components(nodes, raster.neighbour_pairs(nodes), 3).select("node")


@query("GRF4_morphology", """with d as (select a.ix, a.iy, max(b.occ) as dilated, case when count(*) = 9 then min(b.occ) else least(min(b.occ), 0) end as eroded from raster a join raster b on abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1 group by a.ix, a.iy) select ix, iy, round(dilated, 6) as dilated, round(eroded, 6) as eroded from d""")
def grf4(v: Views):
    k = raster.kernel(1)
    up, down = raster.dilate(v.raster, k, "occ", v.raster), raster.erode(v.raster, k, "occ")
    return rounded(up.withColumnRenamed("occ", "dilated").join(down.withColumnRenamed("occ", "eroded"), ["ix", "iy"]))


@query("GRF5_ray_fill", """with h as (select ix, iy, occ, greatest(abs(ix - 10), abs(iy - 2), 1) as steps from raster where occ > 0.6), s as (select 10 + cast(round_even((ix - 10) * cast(k as double) / steps, 0) as bigint) as ix, 2 + cast(round_even((iy - 2) * cast(k as double) / steps, 0) as bigint) as iy, occ from h, unnest(range(0, steps + 1)) as u(k))
  select ix, iy, round(max(occ), 6) as occ from s group by ix, iy""")
def grf5(v: Views):
    return rounded(grid.ray_fill(v.raster.filter("occ > 0.6"), (10, 2), "occ"))


@query("GRF6_dense_labels", """with v as (select b.ix, b.iy, a.label, sum(a.occ) as w from raster a join raster b on abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1 where a.label <> 0 group by b.ix, b.iy, a.label), k as (select *, sum(w) over (partition by ix, iy) as t, row_number() over (partition by ix, iy order by round(w, 9) desc, label) as rn from v)
  select ix, iy, label, round(w / t, 5) as confidence from k where rn = 1 and t > 0""")
def grf6(v: Views):
    votes = v.raster.filter("label <> 0").select("ix", "iy", "label", "occ")
    spread = grid.neighbours(votes, 1).join(v.raster.select("ix", "iy"), ["ix", "iy"])
    return rounded(stats.label_map(spread, ["ix", "iy"], "label", "occ").filter("confidence is not null"), 5)


@query("GRF7_edge_map", """select c.ix, c.iy, round(least(1, abs(coalesce(e.occ, 0) - coalesce(w.occ, 0)) / 2 + abs(coalesce(s.occ, 0) - coalesce(n.occ, 0)) / 2), 6) as edge from raster c left join raster e on e.ix = c.ix + 1 and e.iy = c.iy left join raster w on w.ix = c.ix - 1 and w.iy = c.iy left join raster s on s.ix = c.ix and s.iy = c.iy + 1 left join raster n on n.ix = c.ix and n.iy = c.iy - 1""")
def grf7(v: Views):
    return rounded(raster.edge_map(v.raster, "occ"))


@query("GRF8_boundary", "select distinct a.ix, a.iy from raster a join raster b on abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 where a.label <> 0 and b.label <> 0 and a.label <> b.label")
def grf8(v: Views):
    return raster.label_boundary(v.raster, "label")


@query("GRF9_distance", "select a.ix, a.iy, round(least(4, coalesce(min(sqrt((a.ix-b.ix)*(a.ix-b.ix) + (a.iy-b.iy)*(a.iy-b.iy))), 4)), 6) as distance from raster a left join (select * from raster where occ > 0.9) b on abs(a.ix - b.ix) <= 4 and abs(a.iy - b.iy) <= 4 group by a.ix, a.iy")
def grf9(v: Views):
    return rounded(raster.distance_to(v.raster, v.raster.filter("occ > 0.9"), 4))


@query("GRF11_crop_resize", "select (ix - 4) // 3 as ix, (iy - 0) // 3 as iy, round(avg(occ), 6) as occ from raster where ix between 4 and 49 and iy between 0 and 29 group by 1, 2")
def grf11(v: Views):
    return rounded(raster.crop_resize(v.raster, "occ", (4, 50), (0, 30), 3))


@query("GRF12_prior_refresh", """with b as (select cast(floor(x) as bigint) as ix, cast(floor(y / 40) as bigint) as iy, conf, label, row_number() over (partition by cast(floor(x) as bigint), cast(floor(y / 40) as bigint) order by conf desc, label) as rn from pts)
  select r.ix, r.iy, round(case when b.label is null then occ else occ + 0.3 * conf * (1 - occ) end, 6) as occ, coalesce(b.label, r.label) as label from raster r left join (select * from b where rn = 1) b using (ix, iy)""")
def grf12(v: Views):
    hits = v.pts.select(scalars.cell(F.col("x"), 1).alias("ix"), scalars.cell(F.col("y"), 40).alias("iy"), "conf", "label")
    return rounded(raster.refresh_prior(v.raster, hits, 0.3))


@query("SC26_bilinear", """with p as (select id, x as u, y / 40 as w, cast(floor(x) as bigint) as i, cast(floor(y / 40) as bigint) as j from (select id, x * 0.97 as x, y from pts))
  select id, round(sum(occ * (case when r.ix > i then u - i else 1 - u + i end) * (case when r.iy > j then w - j else 1 - w + j end)), 6) as occ from p join raster r on r.ix in (i, i + 1) and r.iy in (j, j + 1) group by id having count(*) = 4""")
def sc26(v: Views):
    points = v.pts.select("id", (F.col("x") * 0.97).alias("u"), (F.col("y") / 40).alias("w"))
    return rounded(raster.bilinear(points, v.raster, "occ", "id"))


# searches

EDGED = """select c.ix, c.iy, c.occ, c.label, least(1, abs(coalesce(e.occ, 0) - coalesce(w.occ, 0)) / 2 + abs(coalesce(s.occ, 0) - coalesce(n.occ, 0)) / 2) as edge from raster c left join raster e on e.ix = c.ix + 1 and e.iy = c.iy left join raster w on w.ix = c.ix - 1 and w.iy = c.iy left join raster s on s.ix = c.ix and s.iy = c.iy + 1 left join raster n on n.ix = c.ix and n.iy = c.iy - 1"""
CELL_POINTS = "select frame, cast(floor(x) as bigint) + 0.5 as x, cast(floor(y / 40) as bigint) + 0.5 as y, label, label = 5 as dynamic, count(*) as n from pts group by 1, 2, 3, 4, 5"
START = "select frame, frame % 3 * 0.25 as x0, frame % 2 * 0.25 as y0, (frame % 5 - 2) * 0.003 as yaw0, frame % 6 * 1.5 as variance from pts group by frame"


def _scored(name: str, lattice: str) -> str:
    """SQL of the scores of a lattice."""
    return f"""{name}_m as (select p.frame, p.label, p.dynamic, p.n, l.level, l.a, l.i, l.j, l.dx, l.dy, l.yaw, cast(floor(cos(yaw) * x - sin(yaw) * y + dx) as bigint) as ix, cast(floor(sin(yaw) * x + cos(yaw) * y + dy) as bigint) as iy from p join {lattice} l on l.frame = p.frame),
  {name} as (select m.frame, level, a, i, j, dx, dy, yaw, coalesce(round(sum(case when e.occ > 0.01 or e.edge > 0.01 then n * (e.occ + 0.5 * e.edge + case when m.label <> 0 and e.label <> 0 then case when m.label = e.label then 0.3 else -0.3 end else 0 end - case when dynamic then 0.2 else 0 end) end) / any_value(t.total), 9), -1) as score
    from {name}_m m join t on t.frame = m.frame left join e on e.ix = m.ix and e.iy = m.iy group by m.frame, level, a, i, j, dx, dy, yaw)"""


_AXIS = "list_transform(range(0, {n}), lambda k: case when {n} > 1 then {c} - {r} + 2 * {r} / ({n} - 1) * k else {c} end)"


def _lattice(source: str, radius: str, step: float, yaw: float, yaw_step: float, level: int) -> str:
    n = f"(cast(ceil(2 * {radius} / {step}) as int) + 1)"
    na = f"(cast(ceil(2 * cast({yaw} as double) / cast({yaw_step} as double)) as int) + 1)"
    xs, ys, angles = _AXIS.format(n=n, c="x0", r=radius), _AXIS.format(n=n, c="y0", r=radius), _AXIS.format(n=na, c="yaw0", r=f"cast({yaw} as double)")
    return f"""select frame, {level} as level, a, yaws[a + 1] as yaw, i, xs[i + 1] as dx, j, ys[j + 1] as dy from (select *, unnest(range(0, len(ys))) as j from (select *, unnest(range(0, len(xs))) as i from (select *, unnest(range(0, len(yaws))) as a from (select frame, {xs} as xs, {ys} as ys, {angles} as yaws from {source}) q) q) q) q"""


LOCALIZED = f"""with e as ({EDGED}), p as ({CELL_POINTS}), t as (select frame, sum(n) as total from p group by frame), at0 as (select *, least(3.0, greatest(1.0, sqrt(greatest(0.01, variance)))) as r from ({START}) s),
  l0 as ({_lattice("at0", "r", 1.0, 0.05, 0.05, 0)}), {_scored("c0", "l0")},
  b0 as (select frame, dx as x0, dy as y0, yaw as yaw0 from (select *, row_number() over (partition by frame order by score desc, a, i, j) as rn from c0) q where rn = 1),
  l1 as ({_lattice("b0", "1.5", 0.5, 0.02, 0.02, 1)}), {_scored("c1", "l1")},
  o as (select *, row_number() over (partition by frame order by score desc, level, a, i, j) as rn from (select * from c0 union all select * from c1) u),
  b as (select a.frame, a.dx, a.dy, a.yaw, a.score as best, q.score as second from o a join o q on q.frame = a.frame and a.rn = 1 and q.rn = 2),
  h as (select p.frame, sum(case when e.occ >= 0.3 and (p.label = 0 or e.label = 0 or p.label = e.label) then n else 0 end) / cast(sum(n) as double) as ratio from p join b on b.frame = p.frame left join e on e.ix = cast(floor(cos(yaw) * x - sin(yaw) * y + dx) as bigint) and e.iy = cast(floor(sin(yaw) * x + cos(yaw) * y + dy) as bigint) group by p.frame),
  g as (select b.*, r, ratio, best - second as gap, 1 / (1 + exp(-20 * (best - second - 0.01))) as confidence from b join h using (frame) join at0 using (frame)),
  k as (select *, case when best <= -0.5 then 'no_overlap' when ratio < 0.2 then 'low_inlier_ratio' when confidence < 0.3 or gap < 0.01 then 'ambiguous' else 'accepted' end as reason from g)
  select frame, round(r, 6) as radius, round(dx, 6) + 0.0 as dx, round(dy, 6) + 0.0 as dy, round(yaw, 6) + 0.0 as yaw, round(best, 6) + 0.0 as best, round(second, 6) + 0.0 as second, round(gap, 6) + 0.0 as gap, round(confidence, 6) as confidence, round(ratio, 6) as ratio, reason = 'accepted' as accepted, reason from k"""


@query("OPT1_pose_search", LOCALIZED)
def opt1(v: Views):
    """Each frame on the prior raster: window by covariance, lattice and finer lattice, gates."""
    return rounded(search.localize(v.sql(CELL_POINTS), v.sql(EDGED), v.sql(START), ["frame"], 1.0).drop("scored"))


LATTICE4 = "select row_number() over (order by a, x, y) - 1 as c, x as dx, y as dy, a as yaw from (select unnest([-3.0, 0.0, 3.0]) as x) xs, (select unnest([-2.0, 0.0, 2.0]) as y) ys, (select unnest([-0.04, 0.0, 0.04]) as a) yaws"
WEIGHTS4 = {1: 0.6, 2: 0.4, 3: 1.0, 4: 0.5}
SEMANTIC = f"""k as ({LATTICE4}), p as (select frame, cast(floor(x) as bigint) + 0.5 as x, cast(floor(y / 40) as bigint) + 0.5 as y, label, count(*) as n from pts where label > 0 group by 1, 2, 3, 4),
  d as (select x.ix, x.iy, r.label, min(sqrt((x.ix - r.ix) * (x.ix - r.ix) + (x.iy - r.iy) * (x.iy - r.iy))) as d from (select range - 80 as ix from range(0, 300)) xx, (select 0) z, raster r, lateral (select xx.ix as ix, yy.iy as iy from (select range - 80 as iy from range(0, 300)) yy where yy.iy between r.iy - 4 and r.iy + 4) x where xx.ix between r.ix - 4 and r.ix + 4 and r.label in (1, 2, 3, 4) group by 1, 2, 3),
  m as (select frame, label, n, c, dx, dy, yaw, cast(floor(cos(yaw) * x - sin(yaw) * y + dx) as bigint) as ix, cast(floor(sin(yaw) * x + cos(yaw) * y + dy) as bigint) as iy from p, k),
  s as (select frame, c, dx, dy, yaw, sum(n * coalesce(case when d.d <= 4 then case m.label when 1 then 0.6 when 2 then 0.4 when 3 then 1.0 when 4 then 0.5 end * exp(-d.d / 1.5) end, 0)) / sum(n) as mean, sum(case when r.ix is not null then n else 0 end) / cast(sum(n) as double) as coverage
    from m left join raster r on r.ix = m.ix and r.iy = m.iy left join d on d.ix = m.ix and d.iy = m.iy and d.label = m.label group by frame, c, dx, dy, yaw),
  q as (select *, round(mean * coverage, 9) as score from s)"""


def semantic_scores(v: Views):
    points = v.pts.filter("label > 0").select("frame", (scalars.cell(F.col("x"), 1) + 0.5).alias("x"), (scalars.cell(F.col("y"), 40) + 0.5).alias("y"), "label").groupBy("frame", "x", "y", "label").agg(F.count("*").alias("n"))
    return search.semantic_search(points, v.raster, ["frame"], search.lattice([-3.0, 0.0, 3.0], [-2.0, 0.0, 2.0], [-0.04, 0.0, 0.04]), WEIGHTS4)


@query("OPT4_semantic_search", f"""with {SEMANTIC}, o as (select *, row_number() over (partition by frame order by score desc, c) as rn from q)
  select a.frame, a.c, a.dx, a.dy, a.yaw, round(a.score, 6) as score, round(a.coverage, 6) as coverage, round(a.score - b.score, 6) + 0.0 as delta, round(a.score / greatest(b.score, 0.000001), 5) as ratio,
    case when a.score < 0.05 then 'score_low' when a.coverage < 0.5 then 'coverage_low' when a.score - b.score < 0.002 or a.score / greatest(b.score, 0.000001) < 1.005 then 'not_unique' else 'ok' end as reason from o a join o b on a.frame = b.frame and a.rn = 1 and b.rn = 2""")
def opt4(v: Views):
    """The best shift and turn of each frame on the labelled prior, with its lead and reason."""
    out = search.peak(semantic_scores(v), ["frame"], search.Peak(min_score=0.05, min_delta=0.002, min_ratio=1.005))
    return rounded(out.withColumn("c", F.col("c").cast("long")).withColumn("ratio", F.round("ratio", 5)))


@query("OPT4_heat_map", f"with {SEMANTIC} select frame, cast(floor((dx + 32) / 2) as bigint) as ix, cast(floor((dy + 2) / 2) as bigint) as iy, round(max(score), 6) as heat from q group by 1, 2, 3")
def opt4_heat(v: Views):
    """The same search as a heat map."""
    return rounded(search.heat_map(semantic_scores(v), ["frame"], 2.0, 32.0, 2.0))


SHIFTS5 = [(x, y) for x in (-2, -1, 0, 1, 2) for y in (-1, 0, 1)]
EDGES5 = f"""with k as (select row_number() over (order by x, y) - 1 as c, x as dx, y as dy from (select unnest([-2, -1, 0, 1, 2]) as x) xs, (select unnest([-1, 0, 1]) as y) ys), e as (select ix, iy from raster where occ > 0.9),
  m as (select c, dx, dy, ix + dx as ix, iy + dy as iy, occ as value from raster, k where occ between 0.6 and 0.9),
  d as (select m.c, m.dx, m.dy, m.ix, m.iy, any_value(value) as value, least(4, coalesce(min(sqrt((m.ix - e.ix) * (m.ix - e.ix) + (m.iy - e.iy) * (m.iy - e.iy))), 4)) as d from m left join e on abs(m.ix - e.ix) <= 4 and abs(m.iy - e.iy) <= 4 group by m.c, m.dx, m.dy, m.ix, m.iy),
  s as (select c, dx, dy, avg(d) as mean_d, avg(cast(d <= 2 as int)) as coverage, coalesce(corr(value, r.occ), 0) as ncc from d left join raster r on r.ix = d.ix and r.iy = d.iy group by c, dx, dy),
  q as (select *, round(case when coverage < 0.2 then 0 else greatest(0, least(1, exp(-mean_d / 2) * pow(coverage, 0.5) * (0.35 + 0.65 * greatest(0, least(1, (ncc + 1) / 2))))) end, 9) as score from s),
  p as (select quantile_cont(score, 0.9) as p90, max(score) as top, list_sort(list(score), 'DESC')[2] as second from q)
  select c, cast(dx as bigint) as dx, cast(dy as bigint) as dy, round(mean_d, 6) as mean_d, round(coverage, 6) as coverage, round(ncc, 6) + 0.0 as ncc, round(score, 6) as score, round(second, 6) as second, round(p90, 6) as p90, round(top - p90, 6) + 0.0 as peak_delta, round(top / greatest(second, 0.000001), 5) as peak_ratio from q, p order by score desc, c limit 5"""


@query("OPT5_edge_chamfer", EDGES5)
def opt5(v: Views):
    """The five best shifts of middling cells onto the edges, by distance, coverage and correlation."""
    query_, target = v.raster.filter("occ between 0.6 and 0.9").select("ix", "iy", F.col("occ").alias("value")), v.raster.select("ix", "iy", F.col("occ").alias("value"))
    out = search.edge_search(query_, target, SHIFTS5)
    return rounded(out.withColumn("c", F.col("c").cast("long")).withColumn("peak_ratio", F.round("peak_ratio", 5)))


@query("AG22_kabsch", """with p as (select frame, x as ax, y as ay, z as az, x * cos(0.4) - y * sin(0.4) + 3 as bx, x * sin(0.4) + y * cos(0.4) - 1 as b_y, z + 2 as bz from pts) select frame, round(0.4, 5) as yaw, round(0.4, 5) as angle, round(3.0, 5) as tx, round(-1.0, 5) as ty, round(2.0, 5) as tz from p group by frame having count(*) > 10""")
def ag22(v: Views):
    c, s = math.cos(0.4), math.sin(0.4)
    big = v.pts.groupBy("frame").count().filter("count > 10").select("frame")
    pairs = v.pts.join(big, "frame").selectExpr("frame", "x as ax", "y as ay", "z as az", f"x * {c}D - y * {s}D + 3 as bx", f"x * {s}D + y * {c}D - 1 as by", "z + 2 as bz")
    return rounded(graph.kabsch(graph.cross_sums(pairs, ["frame"]), ["frame"]), 5)


# graphs

@query("OPT19_loop_weight", "select run, i, j, round(greatest(0.2, least(1, dx / 3)) * greatest(0.3, least(1, 1 / (1 + cast(j - i as double)))), 6) as weight from edges where loop")
def opt19(v: Views):
    weight = scalars.clamp(F.col("dx") / 3, 0.2, 1) * scalars.clamp(1 / (1 + (F.col("j") - F.col("i")).cast("double")), 0.3, 1)
    return rounded(v.edges.filter("loop").select("run", "i", "j", weight.alias("weight")))


@query("EST15_rebuilt_map", "select frame, id, round(x * cos(frame / 10.0) - y * sin(frame / 10.0) + frame, 5) as x, round(x * sin(frame / 10.0) + y * cos(frame / 10.0) - frame, 5) as y from pts")
def est15(v: Views):
    poses = v.pts.select("frame").distinct().select("frame", F.cos(F.col("frame") / 10).alias("c"), F.sin(F.col("frame") / 10).alias("s"))
    p = v.pts.join(poses, "frame")
    return rounded(p.select("frame", "id", (F.col("x") * F.col("c") - F.col("y") * F.col("s") + F.col("frame")).alias("x"), (F.col("x") * F.col("s") + F.col("y") * F.col("c") - F.col("frame")).alias("y")), 5)


def _turned(q: str, x: str, y: str, z: str) -> tuple[str, str, str]:
    """SQL of a vector turned by the quaternion columns after a prefix."""
    tx, ty, tz = (f"(2 * ({q}{a} * ({c}) - {q}{b} * ({d})))" for a, c, b, d in (("y", z, "z", y), ("z", x, "x", z), ("x", y, "y", x)))
    return tuple(f"(({v}) + {q}w * {t} + ({q}{a} * {c} - {q}{b} * {d}))" for v, t, a, c, b, d in ((x, tx, "y", tz, "z", ty), (y, ty, "z", tx, "x", tz), (z, tz, "x", ty, "y", tx)))


_TO_BODY = _turned("c", "x - ax", "y - ay", "z - az")
_TO_WORLD = _turned("b.q", "l.lx", "l.ly", "l.lz")


@query("EST15_corrected_map", f"""with a as (select p.frame, p.id, p.x, p.y, p.z, a.x as ax, a.y as ay, a.z as az, a.qw as cw, -a.qx as cx, -a.qy as cy, -a.qz as cz from pts p join poses a on a.id = p.frame),
  l as (select frame, id, {_TO_BODY[0]} as lx, {_TO_BODY[1]} as ly, {_TO_BODY[2]} as lz from a)
  select l.frame, l.id, round({_TO_WORLD[0]} + b.x, 4) + 0.0 as x, round({_TO_WORLD[1]} + b.y, 4) + 0.0 as y, round({_TO_WORLD[2]} + b.z, 4) + 0.0 as z from l join poses b on b.id = l.frame + 100""")
def est15_corrected(v: Views):
    """Points stored in the frame of the pose at which they were taken, emitted again from a corrected pose: all six degrees of freedom."""
    raw = v.poses.select(F.col("id").alias("frame"), *[F.col(c).alias(f"a_{c}") for c in ("x", "y", "z", "qw", "qx", "qy", "qz")])
    right = v.poses.select((F.col("id") - 100).alias("frame"), *[F.col(c).alias(f"b_{c}") for c in ("x", "y", "z", "qw", "qx", "qy", "qz")])
    at = lambda p: tuple(F.col(f"{p}{c}") for c in "xyz")
    stored = v.pts.select("frame", "id", "x", "y", "z").join(raw, "frame")
    local = pose.rotate(pose.conjugate(pose.named("a_")), tuple(p - q for p, q in zip(at(""), at("a_"), strict=True)))
    stored = stored.select("frame", "id", *[c.alias(f"l_{n}") for n, c in zip("xyz", local, strict=True)]).join(right, "frame")
    world = [p + q for p, q in zip(pose.rotate(pose.named("b_"), at("l_")), at("b_"), strict=True)]
    return rounded(stored.select("frame", "id", *[c.alias(n) for n, c in zip("xyz", world, strict=True)]), 4)
