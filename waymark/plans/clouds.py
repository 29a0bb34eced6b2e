"""Queries on clouds: decoding, filters, voxels, aggregates and scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions import pose, scalars
from waymark.operators import filters, grid, select, stats
from waymark.plans.registry import query
from waymark.plans.views import Views
from waymark.sources import clouds


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded, so that both engines give the same digits."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df, digits: int = 6):
    """All floating columns rounded; -0 becomes 0."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


# sources

@query("SRC1_cloud_decode", """select id, frame, x, y, z, least(255, greatest(0, label * 50 - 20)) as label, round(least(1, greatest(0, conf * 2 - 0.3)), 6) as conf from pts""")
def src1(v: Views):
    raw = v.pts.selectExpr("id", "frame", "x", "y", "z", "label * 50 - 20 as class_id", "conf * 2 - 0.3 as probability")
    return clouds.decode(raw, keep=["id", "frame"]).withColumn("conf", r("conf"))


@query("SRC2_binary_decode", "select id, x, round(y, 4) as y, round(z, 4) as z from pts")
def src2(v: Views):
    packed = clouds.encode_binary(v.pts.select("id", "x", "y", "z"), "id", [("x", "<f8"), ("y", "<f8"), ("z", "<f8")])
    return rounded(clouds.decode_binary(packed, "id", "data", {"x": ("<f8", 0), "y": ("<f8", 8), "z": ("<f8", 16)}, 24), 4)


@query("SRC3_packed_points", """select id, x, y, z, round(conf * 255, 4) as intensity, line, offset_time, stamp + cast(floor(offset_time / 1000.0) as bigint) as t from (select *, row_number() over (partition by frame order by id) - 1 as rn, label as line, id % 100000000 as offset_time from pts) where rn % 3 = 0 and x*x + y*y + z*z between 4 and 10000""")
def src3(v: Views):
    packets = v.pts.selectExpr("frame", "id", "x", "y", "z", "conf * 255 as reflectivity", "label as line", "id % 100000000 as offset_time", "stamp")
    return clouds.packed_points(packets, ["frame"], ["id"], 3, 2.0, 100.0).select("id", "x", "y", "z", (F.round("intensity", 4) + 0.0).alias("intensity"), "line", "offset_time", "t")


@query("SRC4_cloud_reader", """select id, x, y, z, coalesce(case when label > 2 then conf end, 0) as intensity from (select *, row_number() over (partition by frame order by id) - 1 as rn from pts where z between 0.5 and 4 and x*x + y*y < 10000) where rn % 2 = 0""")
def src4(v: Views):
    rows = select.numbered(v.pts.filter("z between 0.5 and 4 and x*x + y*y < 10000"), ["frame"], ["id"]).filter("rn % 2 = 0")
    return rows.selectExpr("id", "x", "y", "z", "coalesce(case when label > 2 then conf end, 0D) as intensity")


@query("SRC11_occupancy_grid", """select iy, i - 1 as ix, case when cell < 0 then 0 else cell / 100.0 end as occ from (select o_custkey as iy, list(cast(floor(o_totalprice) as bigint) % 102 - 1 order by o_orderkey) as cells from orders group by o_custkey) t, unnest(cells) with ordinality as u(cell, i)""")
def src11(v: Views):
    rows = v.orders.groupBy(F.col("o_custkey").alias("iy")).agg(F.sort_array(F.collect_list(F.struct("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("p")))).alias("c"))
    return clouds.occupancy_cells(rows.select("iy", F.transform("c", lambda x: x["p"] % 102 - 1).alias("cells")), ["iy"], "cells")


@query("SRC13_probe", "select event_type as topic, count(*) as messages, epoch_us(min(ts)) as first_stamp, epoch_us(max(ts)) as last_stamp from events group by 1")
def src13(v: Views):
    rows = v.sql("select event_type as topic, MICROS[ts] as stamp from events")
    return clouds.probe(rows, "topic", "stamp")


# filters

@query("FIL1_range_band", "select id, x, z from pts where sqrt(x*x + y*y) between 5 and 60 and z between 0.5 and 4.5")
def fil1(v: Views):
    return filters.range_band(v.pts, 5, 60, 0.5, 4.5).select("id", "x", "z")


@query("FIL2_body_gate", """with p as (select id as frame, x, y, z from geo_pose) select q.id from pts q join p using (frame) where sqrt((q.x - p.x)*(q.x - p.x) + (q.y - p.y)*(q.y - p.y)) < 40 and q.z - p.z between -1 and 3""".replace("geo_pose", "(select s_suppkey % 64 as id, cast(avg(s_nationkey) as double) as x, cast(2 * avg(s_nationkey) as double) as y, cast(0.1 * avg(s_nationkey) as double) as z from supplier group by 1)"))
def fil2(v: Views):
    poses = v.sql("select s_suppkey % 64 as frame, cast(avg(s_nationkey) as double) as px, cast(2 * avg(s_nationkey) as double) as py, cast(0.1 * avg(s_nationkey) as double) as pz from supplier group by 1")
    rows = v.pts.join(poses, "frame")
    return rows.filter("sqrt((x - px)*(x - px) + (y - py)*(y - py)) < 40 and z - pz between -1 and 3").select("id")


@query("FIL3_vertical_view", "select id, round(e, 6) as elevation, e between -5 and 4 as in_view from (select id, degrees(asin(z / sqrt(x*x + y*y + z*z))) as e from pts)")
def fil3(v: Views):
    return rounded(filters.vertical_view(v.pts, -5, 4).select("id", "elevation", "in_view"))


CLASS_WEIGHTS = {1: 0.5, 2: 0.6, 3: 1.0, 4: 0.7, 6: 0.3}


@query("FIL4_weighted_labels", "select id, label, round(0.8 * least(1, conf) * case label when 1 then 0.5 when 2 then 0.6 when 3 then 1.0 when 4 then 0.7 else 0.3 end, 6) as weight from pts where label not in (0, 5)")
def fil4(v: Views):
    table = v.spark.createDataFrame(list(CLASS_WEIGHTS.items()), "label int, class_weight double")
    return rounded(filters.weighted_labels(v.pts, 0.8, table).select("id", "label", "weight"))


@query("FIL5_dynamic_pixel_gate", """select p.id, round(avg(cast(coalesce(r.label, 0) = 5 as int)), 6) as share, avg(cast(coalesce(r.label, 0) = 5 as int)) >= 0.15 as dynamic
  from (select id, cast(floor(x) as bigint) as ix, cast(floor(y / 5) as bigint) as iy from pts) p join raster r on r.ix between p.ix - 1 and p.ix + 1 and r.iy between p.iy - 1 and p.iy + 1 group by p.id""")
def fil5(v: Views):
    points = v.pts.select("id", scalars.cell(F.col("x"), 1).alias("ix"), scalars.cell(F.col("y"), 5).alias("iy"))
    near = grid.neighbours(points, 1).join(v.raster.select("ix", "iy", "label"), ["ix", "iy"])
    out = near.groupBy("id").agg(F.avg((F.col("label") == 5).cast("int")).alias("share"))
    return rounded(out.withColumn("dynamic", F.col("share") >= 0.15))


@query("FIL6_label_freshness", "select id, abs(t - (t // 7000000) * 7000000) <= 3000000 and (t % 11000000) - 5000000 between -1000000 + 1 and 4000000 as fresh from track")
def fil6(v: Views):
    scan, propagated, age = F.col("t"), F.expr("(t div 7000000) * 7000000"), F.expr("(t % 11000000) - 5000000")
    return v.track.select("id", ((F.abs(scan - propagated) <= 3000000) & (age > -1000000) & (age <= 4000000)).alias("fresh"))


@query("FIL7_label_smoothing", """with votes as (select a.ix, a.iy, b.label as near, count(*) as n from raster a join raster b on b.ix between a.ix - 1 and a.ix + 1 and b.iy between a.iy - 1 and a.iy + 1 and b.label <> 0 group by all),
  best as (select ix, iy, near, n, sum(n) over (partition by ix, iy) as total, row_number() over (partition by ix, iy order by n desc, near) as rn from votes)
  select r.ix, r.iy, case when coalesce(n / total, 0) >= 0.3 then near else 0 end as label, round(coalesce(n / total, 0), 6) as support from raster r left join (select * from best where rn = 1) b using (ix, iy)""")
def fil7(v: Views):
    return rounded(grid.box_blur_labels(v.raster, 1, 0.3))


@query("FIL8_depth_buffer", """select id, round(1 - 0.6 * least(1, d / 1.5), 6) as score from (select id, z - min(z) over (partition by frame, cast(floor(x / 2) as bigint), cast(floor(y / 10) as bigint)) as d from pts) where d <= 1.5""")
def fil8(v: Views):
    rows = v.pts.select("id", "z", "frame", scalars.cell(F.col("x"), 2).alias("u"), scalars.cell(F.col("y"), 10).alias("w"))
    return rounded(filters.depth_consistent(rows, ["frame", "u", "w"], "z", 1.5).select("id", "score"))


CELLS = "select cast(floor(x / 5) as bigint) as ix, cast(floor(y / 10) as bigint) as iy, min(z) as z_min, max(z) as z_max, count(*) as n from pts group by all"


@query("FIL9_edge_scores", f"""with c as ({CELLS}) select a.ix, a.iy, round(1 - 0.75 * least(1, (max(b.z_max) - min(b.z_min)) / 6), 6) as score from c a join c b on b.ix between a.ix - 1 and a.ix + 1 and b.iy between a.iy - 1 and a.iy + 1 group by all""")
def fil9(v: Views):
    cells = v.pts.select(scalars.cell(F.col("x"), 5).alias("ix"), scalars.cell(F.col("y"), 10).alias("iy"), "z").groupBy("ix", "iy").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))
    return rounded(filters.edge_scores(cells, 1, 6))


@query("FIL10_geometry_scores", """with c as (select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, min(z) as z_min, max(z) as z_max from pts group by all)
  select p.id, round(case when label in (1, 2) then 1 - least(1, (z - z_min) / 2) when label = 3 then least(1, (z_max - z_min) / 3) else 1 end, 6) as score,
  case when label in (1, 2) then 1 - least(1, (z - z_min) / 2) when label = 3 then least(1, (z_max - z_min) / 3) else 1 end > 0.2 as keep from pts p join c on c.ix = cast(floor(x / 4) as bigint) and c.iy = cast(floor(y / 4) as bigint)""")
def fil10(v: Views):
    cells = grid.cell_stats(v.pts, 4)
    return rounded(filters.geometry_scores(grid.with_cells(v.pts, 4, ("x", "y")), cells, 2, 3).select("id", "score", "keep"))


@query("FIL11_ground_filter", """with c as (select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, min(z) as z_min, count(*) as n from pts group by all),
  g as (select a.ix, a.iy, min(b.z_min) as f, sum(b.n) as s from c a join c b on b.ix between a.ix - 1 and a.ix + 1 and b.iy between a.iy - 1 and a.iy + 1 group by all)
  select p.id, s >= 12 and z - f <= 0.6 as is_ground from pts p join g on g.ix = cast(floor(x / 4) as bigint) and g.iy = cast(floor(y / 4) as bigint)""")
def fil11(v: Views):
    return filters.ground_filter(v.pts, 4, 12, 0.6).select("id", "is_ground")


CELL4 = "with c as (select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, min(z) as z_min, max(z) as z_max, count(*) as n from pts group by all)"
ON4 = "pts p join c on c.ix = cast(floor(x / 4) as bigint) and c.iy = cast(floor(y / 4) as bigint)"


@query("FIL12_geometry_relabel", f"{CELL4} select p.id, case when label = 5 and conf > 0.8 then label when z - z_min < 0.4 then 1 when z_max - z_min > 2 and n >= 6 then 3 else label end as label from {ON4}")
def fil12(v: Views):
    rows = grid.with_cells(v.pts, 4, ("x", "y")).join(grid.cell_stats(v.pts, 4), ["ix", "iy"])
    return rows.select("id", filters.relabel_by_geometry(rows, 0.4, 2, 6).alias("label"))


@query("FIL13_rule_classes", f"""{CELL4} select p.id, case when z - z_min < 0.2 and z_max - z_min < 0.3 then 1 when z - z_min < 0.35 and z_max - z_min < 0.6 then 2 when z_max - z_min > 2.5 and n >= 8 then 3 when z_max - z_min > 1 then 4 else 6 end as label,
  cast(case when z - z_min < 0.2 and z_max - z_min < 0.3 then 0.8 when z - z_min < 0.35 and z_max - z_min < 0.6 then 0.6 when z_max - z_min > 2.5 and n >= 8 then 0.75 when z_max - z_min > 1 then 0.6 else 0.4 end as double) as conf from {ON4}""")
def fil13(v: Views):
    rows = grid.with_cells(v.pts, 4, ("x", "y")).join(grid.cell_stats(v.pts, 4), ["ix", "iy"])
    label, conf = filters.classify_cell()
    return rows.select("id", label.alias("label"), conf.alias("conf"))


@query("FIL14_cell_evidence", f"""{CELL4} select ix, iy, case when z_max - z_min > 3 then 3 when z_max - z_min > 1.5 and n > 4 then 4 when z_max > 2 then 6 else 1 end as label,
  round(least(0.95, 0.4 + 0.1 * (z_max - z_min) + 0.02 * n), 6) as conf from c""")
def fil14(v: Views):
    cells, span = grid.cell_stats(v.pts, 4), F.col("z_max") - F.col("z_min")
    label = filters.first_reason([(span > 3, "3"), ((span > 1.5) & (F.col("n") > 4), "4"), (F.col("z_max") > 2, "6")], "1").cast("int")
    return rounded(cells.select("ix", "iy", label.alias("label"), F.least(F.lit(0.95), 0.4 + 0.1 * span + 0.02 * F.col("n")).alias("conf")))


@query("FIL15_matching_layers", f"""{CELL4}, l as (select ix, iy, case when z_max - z_min > 3 then 'building' when z_max - z_min < 1 then 'road' else 'other' end as layer from c)
  select a.ix, a.iy, case when a.layer = 'road' and bool_or(b.layer <> 'road') then 'road_edge' else a.layer end as layer from l a join l b on abs(a.ix - b.ix) <= 1 and abs(a.iy - b.iy) <= 1 group by a.ix, a.iy, a.layer""")
def fil15(v: Views):
    span = F.col("z_max") - F.col("z_min")
    layers = grid.cell_stats(v.pts, 4).select("ix", "iy", F.when(span > 3, "building").when(span < 1, "road").otherwise("other").alias("layer"))
    near = grid.neighbours(layers.select("ix", "iy", (F.col("layer") != "road").alias("off")), 1).groupBy("ix", "iy").agg(F.bool_or("off").alias("off"))
    return layers.join(near, ["ix", "iy"]).select("ix", "iy", F.when((F.col("layer") == "road") & F.col("off"), "road_edge").otherwise(F.col("layer")).alias("layer"))


@query("FIL19_projection", """select id, cast(floor(300 * (a * d + 2 * 0.001 * a * b + 0.002 * (r2 + 2 * a * a)) + 160.5) as bigint) as u, cast(floor(310 * (b * d + 0.001 * (r2 + 2 * b * b) + 2 * 0.002 * a * b) + 120.5) as bigint) as w from
  (select id, a, b, a*a + b*b as r2, 1 - 0.01 * (a*a + b*b) + 0.002 * (a*a + b*b) * (a*a + b*b) + 0.0001 * (a*a + b*b) * (a*a + b*b) * (a*a + b*b) as d from (select id, x / (z * 10) as a, y / (z * 10) as b from pts where z > 0.05))""")
def fil19(v: Views):
    u, w = filters.project_pinhole(300, 310, 160, 120, (-0.01, 0.002, 0.0001), (0.001, 0.002))
    return v.pts.filter("z > 0.05").selectExpr("id", "x", "y", "z * 10 as z").select("id", u.alias("u"), w.alias("w"))


@query("FIL20_dynamic_instances", """select instance, avg(cast(label = 5 as int)) > 0.3 or ((max(x) - min(x) < 45) and (max(y) - min(y) < 100) and avg(cast(label = 3 as int)) < 0.65) as dynamic from pts group by instance""")
def fil20(v: Views):
    box = stats.instance_clusters(v.pts, "instance")
    return box.select("instance", ((F.col("share5") > 0.3) | ((F.col("dx") < 45) & (F.col("dy") < 100) & (F.col("share3") < 0.65))).alias("dynamic"))


@query("FIL22_every_nth", "select id, run from (select *, row_number() over (partition by run order by t, id) - 1 as rn from track) where rn % 5 = 0")
def fil22(v: Views):
    return select.every_nth(v.track, 5, ["run"], ["t", "id"]).select("id", "run")


@query("FIL24_labelled_features", """with f as (select frame, cast(floor(x / 10) as bigint) as ix, cast(floor(y / 20) as bigint) as iy, avg(x) as x, avg(y) as y, max(label) as label, max(z) - min(z) > 1.5 as structural, max(z) - min(z) <= 0.5 as ground from pts group by 1, 2, 3)
  select frame, ring, round(avg(cast(structural as int)), 6) as structural_share, round(avg(cast(ground as int)), 6) as ground_share, round(avg(cast(label > 0 as int)), 6) as labelled_share from (select *, cast(floor(sqrt(x*x + y*y) / 25) as int) as ring from f where label <> 0) where ring < 4 group by frame, ring""")
def fil24(v: Views):
    rows = v.pts.select("frame", scalars.cell(F.col("x"), 10).alias("ix"), scalars.cell(F.col("y"), 20).alias("iy"), "x", "y", "z", "label").groupBy("frame", "ix", "iy").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("label").alias("label"), (F.max("z") - F.min("z") > 1.5).alias("structural"), (F.max("z") - F.min("z") <= 0.5).alias("ground"))
    return rounded(grid.ring_descriptor(rows.filter("label <> 0"), 4, 25, ["frame"]))


# aggregates

V3 = "cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, cast(floor(z / 4) as bigint) as iz"


@query("AG1_voxel_centroid", f"select ix, iy, iz, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z, count(*) as n from (select {V3}, x, y, z from pts) group by ix, iy, iz")
def ag1(v: Views):
    return rounded(grid.voxel_centroid(v.pts, 4).select("ix", "iy", "iz", "x", "y", "z", "n"))


@query("AG2_first_per_voxel", f"select id, ix, iy, iz from (select *, row_number() over (partition by ix, iy, iz order by id) as rn from (select {V3}, id from pts)) where rn = 1")
def ag2(v: Views):
    return grid.first_per_voxel(v.pts, 4, "id").select("id", "ix", "iy", "iz")


@query("AG3_strongest_per_cell", f"select id, label, ix, iy, iz, round(conf, 6) as conf from (select *, row_number() over (partition by ix, iy, iz, label order by conf desc, id) as rn from (select {V3}, id, label, conf from pts)) where rn = 1")
def ag3(v: Views):
    return rounded(grid.strongest_per_cell(v.pts, 4, "label", "conf", "id").select("id", "label", "ix", "iy", "iz", "conf"))


FUSE = """with s as (select * from (select *, row_number() over (partition by ix, iy, iz, label order by conf desc, id) as rn from (select {v3}, id, x, y, z, label, conf from pts where label not in (0, 5) and sqrt(x*x + y*y) <= 90)) where rn = 1),
  l as (select ix, iy, iz, label, sum(conf) as v from s group by all),
  t as (select ix, iy, iz, sum(conf) as votes, count(*) as n, sum(x * conf) / sum(conf) as x, sum(y * conf) / sum(conf) as y, sum(z * conf) / sum(conf) as z from s group by all),
  b as (select ix, iy, iz, label, v, row_number() over (partition by ix, iy, iz order by round(v, 9) desc, label) as rn from l),
  c as (select t.*, b.label, b.v as best, coalesce(b2.v, 0) as second from t join b using (ix, iy, iz) left join (select * from b where rn = 2) b2 using (ix, iy, iz) where b.rn = 1),
  d as (select *, least(1, greatest(0, (0.65 * best / votes + 0.35 * (best - second) / votes) * (0.45 + 0.55 * (1 - exp(-votes / 2))))) as confidence from c)
  select ix, iy, iz, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, n, round(votes, 6) as votes, label, round(confidence, 6) as confidence from d where confidence >= 0.2"""


@query("AG4_vote_fusion", FUSE.replace("{v3}", V3))
def ag4(v: Views):
    points = filters.range_band(v.pts, 0, 90, -10, 100).filter("label not in (0, 5)")
    strong = grid.strongest_per_cell(points, 4, "label", "conf", "id").drop("ix", "iy", "iz")
    return rounded(grid.vote_fusion(strong, 4, [1, 2, 3, 4, 6], 2, 0.2))


@query("AG5_keyframe_features", """with c as (select frame, cast(floor(x / 8) as bigint) as ix, cast(floor(y / 8) as bigint) as iy, x, y, z, label, conf from pts),
  t as (select frame, ix, iy, sum(x * conf) / sum(conf) as x, sum(y * conf) / sum(conf) as y, sum(z * conf) / sum(conf) as z, min(z) as z_min, max(z) as z_max, count(*) as n from c group by frame, ix, iy),
  b as (select frame, ix, iy, label, sum(conf) as v from c where label not in (0, 5) group by frame, ix, iy, label),
  w as (select *, row_number() over (partition by frame, ix, iy order by round(v, 9) desc, label) as rn from b),
  f as (select t.*, case when w.v > 0.5 then w.label else 0 end as label from t left join (select * from w where rn = 1) w using (frame, ix, iy))
  select frame, ix, iy, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(z_min, 6) as z_min, round(z_max, 6) as z_max, n, coalesce(label, 0) as label, coalesce(label, 0) in (3, 4) or z_max - z_min > 1.5 as structural, coalesce(label, 0) = 1 and z_max - z_min <= 0.5 as ground from f""")
def ag5(v: Views):
    return rounded(grid.keyframe_features(v.pts, 8, keys=["frame"]))


@query("AG6_ring_descriptor", """select frame, ring, round(avg(cast(label in (3, 4) as int)), 6) as structural_share, round(avg(cast(label = 1 as int)), 6) as ground_share, round(avg(cast(label > 0 as int)), 6) as labelled_share
  from (select *, cast(floor(sqrt(x*x + y*y) / 20) as int) as ring from pts) where ring < 5 group by frame, ring""")
def ag6(v: Views):
    rows = v.pts.withColumn("structural", F.col("label").isin(3, 4)).withColumn("ground", F.col("label") == 1)
    return rounded(grid.ring_descriptor(rows, 5, 20, ["frame"]))


@query("AG7_semantic_map", """with m as (select cast(floor((x + frame) / 6) as bigint) as ix, cast(floor((y - frame) / 6) as bigint) as iy, label, conf from pts),
  t as (select ix, iy, sum(conf) as w from m group by ix, iy), l as (select ix, iy, label, sum(conf) as v from m group by ix, iy, label),
  b as (select *, row_number() over (partition by ix, iy order by round(v, 9) desc, label) as rn from l)
  select ix, iy, label, round(v / w, 10) as confidence from t join b using (ix, iy) where rn = 1""")
def ag7(v: Views):
    poses = v.pts.select("frame").distinct().withColumn("tx", F.col("frame").cast("double")).withColumn("ty", -F.col("frame").cast("double"))
    moved = v.pts.join(poses, "frame").withColumn("x", F.col("x") + F.col("tx")).withColumn("y", F.col("y") + F.col("ty"))
    return rounded(stats.label_map(grid.with_cells(moved, 6, ("x", "y")), ["ix", "iy"], "label", "conf"), 10)


@query("AG7_optimised_map", """with f as (select p.frame, p.id, p.label, greatest(0.1, conf) as w, k.x + cos(k.yaw) * p.x - sin(k.yaw) * p.y as x, k.y + sin(k.yaw) * p.x + cos(k.yaw) * p.y as y, k.z + p.z as z from pts p join kf k on k.run = p.frame + 1 and k.k = 2 where p.label <> 0),
  n as (select *, row_number() over (order by frame, id) - 1 as rn, count(*) over () as total from f), m as (select *, cast(floor(x / 6) as bigint) as ix, cast(floor(y / 6) as bigint) as iy, cast(floor(z / 6) as bigint) as iz from n where rn % greatest(1, (total + 1999) // 2000) = 0),
  t as (select ix, iy, iz, sum(w) as w, count(*) as n, sum(x * w) / sum(w) as x, sum(y * w) / sum(w) as y, sum(z * w) / sum(w) as z from m group by ix, iy, iz),
  b as (select ix, iy, iz, label, sum(w) as v, row_number() over (partition by ix, iy, iz order by round(sum(w), 9) desc, label) as rn from m group by ix, iy, iz, label)
  select t.ix, t.iy, t.iz, round(x, 5) + 0.0 as x, round(y, 5) + 0.0 as y, round(z, 5) + 0.0 as z, label, round(v / w, 5) + 0.0 as confidence, cast(n as bigint) as n from t join b using (ix, iy, iz) where rn = 1""")
def ag7_map(v: Views):
    """Labelled points in keyframes' drifting poses, strided to two thousand, as voxels with weighted means."""
    poses = v.kf.filter("k = 2").select((F.col("run") - 1).alias("frame"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"), "yaw")
    return rounded(grid.optimised_map(v.pts.select("frame", "id", "x", "y", "z", "label", "conf"), poses, "frame", "id", 6, 2000), 5)


@query("AG8_cell_stats", "select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, min(z) as z_min, max(z) as z_max, count(*) as n from pts group by all")
def ag8(v: Views):
    return grid.cell_stats(v.pts, 4)


@query("AG9_grouped_min", "select instance, min(z) as z_min, max(z) as z_max, count(*) as n, count(distinct frame) as frames from pts group by instance")
def ag9(v: Views):
    return v.pts.groupBy("instance").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count("*").alias("n"), F.countDistinct("frame").alias("frames"))


@query("AG10_cell_features", """select ix, iy, count(*) as n, round(avg(z), 6) as z_mean, round(sqrt(greatest(0, avg(z*z) - avg(z)*avg(z))), 4) as z_std, min(z) as z_min, max(z) as z_max, max(z) - min(z) as z_range,
  round(avg(conf), 6) as i_mean, round(sqrt(greatest(0, avg(conf*conf) - avg(conf)*avg(conf))), 4) as i_std, round(ln(1 + count(*)), 6) as density from (select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, z, conf from pts) group by ix, iy""")
def ag10(v: Views):
    out = grid.cell_features(v.pts, 4, "conf")
    return out.withColumns({"z_std": r("z_std", 4), "i_std": r("i_std", 4), "z_mean": r("z_mean"), "i_mean": r("i_mean"), "density": r("density")})


@query("AG11_percentiles", "select frame, round(quantile_cont(z, 0.05), 6) as p5, round(quantile_cont(z, 0.5), 6) as p50, round(quantile_cont(z, 0.95), 6) as p95, round(quantile_cont(y, 0.98), 6) as y98 from pts group by frame")
def ag11(v: Views):
    return rounded(v.pts.groupBy("frame").agg(*[F.percentile("z", p).alias(n) for p, n in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))], F.percentile("y", 0.98).alias("y98")))


@query("AG12_order_statistic", "select frame, (list(z order by z))[cast(floor(0.2 * count(*)) as bigint) + 1] as z20 from pts group by frame")
def ag12(v: Views):
    return stats.order_statistic(v.pts, ["frame"], "z", 0.2, "z20")


@query("AG13_median_mad", "with m as (select instance, median(y) as m from pts group by instance) select p.instance, round(any_value(m), 6) as median, round(median(abs(y - m)), 6) as mad from pts p join m using (instance) group by p.instance")
def ag13(v: Views):
    return rounded(stats.median_mad(v.pts, ["instance"], "y"))


@query("AG14_replicated_median", "select frame, round(median(y), 6) as median from pts, unnest(range(0, greatest(1, cast(floor(conf * 3 + 0.5) as bigint)))) group by frame")
def ag14(v: Views):
    return rounded(stats.replicated_median(v.pts, ["frame"], "y", "conf", 3))


ERR = "select a.run, a.x - b.x as ex, a.y - b.y as ey, a.z - b.z as ez from (select *, row_number() over (partition by run order by t, id) as k from est) a join (select *, row_number() over (partition by run order by t, id) as k from gt) b using (run, k)"


def errors(v: Views):
    a, b = (select.numbered(x, ["run"], ["t", "id"], "k") for x in (v.est, v.gt))
    b = b.select("run", "k", *[F.col(c).alias(f"g{c}") for c in "xyz"])
    return a.join(b, ["run", "k"]).select("run", *[(F.col(c) - F.col(f"g{c}")).alias(f"e{c}") for c in "xyz"])


@query("AG15_rmse", f"select run, round(sqrt(avg(ex*ex + ey*ey)), 6) as rmse_2d, round(sqrt(avg(ex*ex + ey*ey + ez*ez)), 6) as rmse_3d, round(avg(abs(ez)), 6) as mean_abs_z, round(max(sqrt(ex*ex + ey*ey + ez*ez)), 6) as max_3d from ({ERR}) e group by run")
def ag15(v: Views):
    return rounded(stats.error_metrics(errors(v), ["run"]).select("run", "rmse_2d", "rmse_3d", "mean_abs_z", "max_3d"))


@query("AG16_component_metrics", f"select run, count(*) as n, round(sqrt(avg(ex*ex)), 6) as rmse_x, round(sqrt(avg(ey*ey)), 6) as rmse_y, round(sqrt(avg(ez*ez)), 6) as rmse_z, round(max(abs(ez)), 6) as max_abs_z from ({ERR}) e group by run")
def ag16(v: Views):
    return rounded(stats.error_metrics(errors(v), ["run"]).select("run", "n", "rmse_x", "rmse_y", "rmse_z", "max_abs_z"))


@query("AG18_metric_text", """select doc_id, cast(regexp_extract(line, 'rmse\\s+([0-9.]+)', 1) as double) as rmse, cast(regexp_extract(line, 'max\\s+([0-9.]+)', 1) as double) as max from (select doc_id, 'max ' || n_chars || '.5 mean 1 rmse ' || (n_chars % 97) || '.25' as line from documents)""")
def ag18(v: Views):
    rows = v.documents.selectExpr("doc_id", "concat('max ', n_chars, '.5 mean 1 rmse ', n_chars % 97, '.25') as line")
    return stats.metrics_from_text(rows, "line", ["rmse", "max"]).select("doc_id", "rmse", "max")


@query("AG19_inlier_spread", """with s as (select frame, count(*) as n, avg(cast(conf > 0.08 as int)) as ratio, var_pop(x) as a, covar_pop(x, y) as b, var_pop(y) as c from pts group by frame)
  select frame, n, round(ratio, 6) as ratio, round(sqrt(greatest(0, a + c)), 5) as spread, round(sqrt(greatest(0, ((a + c) - sqrt((a - c)*(a - c) + 4*b*b)) / ((a + c) + sqrt((a - c)*(a - c) + 4*b*b)))), 5) as spread_ratio from s where n > 2""")
def ag19(v: Views):
    out = stats.spread(v.pts.withColumn("inlier", F.col("conf") > 0.08), ["frame"], "x", "y", "inlier").filter("n > 2")
    return out.select("frame", "n", r("ratio").alias("ratio"), r("spread", 5).alias("spread"), r("spread_ratio", 5).alias("spread_ratio"))


PAIRS = "select frame, conf as w, x as sx, y as sy, x * cos(0.3) - y * sin(0.3) + 5 as tx, x * sin(0.3) + y * cos(0.3) - 2 + z / 50 as ty, z as dz from pts"


@query("AG20_planar_fit", f"""with p as ({PAIRS}), m as (select frame, sum(w*sx)/sum(w) as a, sum(w*sy)/sum(w) as b, sum(w*tx)/sum(w) as c, sum(w*ty)/sum(w) as d from p group by frame),
  y as (select frame, any_value(a) as a, any_value(b) as b, any_value(c) as c, any_value(d) as d, atan2(sum(w*((sx-a)*(ty-d) - (sy-b)*(tx-c))), sum(w*((sx-a)*(tx-c) + (sy-b)*(ty-d)))) as yaw from p join m using (frame) group by frame)
  select frame, round(yaw, 5) as yaw, round(c - (cos(yaw)*a - sin(yaw)*b), 3) as dx, round(d - (sin(yaw)*a + cos(yaw)*b), 3) as dy from y""")
def ag20(v: Views):
    out = stats.planar_fit(v.sql(PAIRS), ["frame"])
    return out.select("frame", r("yaw", 5).alias("yaw"), r("dx", 3).alias("dx"), r("dy", 3).alias("dy"))


@query("AG21_window_alignment", f"""with p as ({PAIRS}), m as (select frame, count(*) as n, avg(sx) as a, avg(sy) as b, avg(tx) as c, avg(ty) as d, avg(dz) as mdz, max(sx) - min(sx) + max(sy) - min(sy) as reach from p group by frame having count(*) >= 10),
  y as (select frame, any_value(a) as a, any_value(b) as b, any_value(c) as c, any_value(d) as d, any_value(mdz) as dz, atan2(sum((sx-a)*(ty-d) - (sy-b)*(tx-c)), sum((sx-a)*(tx-c) + (sy-b)*(ty-d))) as yaw from p join m using (frame) where reach >= 20 group by frame)
  select frame, round(yaw, 5) as yaw, round(c - (cos(yaw)*a - sin(yaw)*b), 3) as dx, round(d - (sin(yaw)*a + cos(yaw)*b), 3) as dy, round(dz, 6) as dz from y""")
def ag21(v: Views):
    rows = v.sql(PAIRS)
    big = rows.groupBy("frame").agg(F.count("*").alias("n"), (F.max("sx") - F.min("sx") + F.max("sy") - F.min("sy")).alias("reach"), F.avg("dz").alias("mean_dz")).filter("n >= 10 and reach >= 20")
    out = stats.planar_fit(rows.withColumn("w", F.lit(1.0)), ["frame"]).join(big, "frame")
    return out.select("frame", r("yaw", 5).alias("yaw"), r("dx", 3).alias("dx"), r("dy", 3).alias("dy"), r("mean_dz").alias("dz"))


@query("AG24_slope_fit", """with s as (select frame, count(*) as n, var_pop(x) as xx, covar_pop(x, y) as xy, var_pop(y) as yy, covar_pop(x, z) as xz, covar_pop(y, z) as yz from pts group by frame)
  select frame, round((xz*yy - yz*xy) / (xx*yy - xy*xy), 6) as slope_x, round((yz*xx - xz*xy) / (xx*yy - xy*xy), 6) as slope_y from s where n >= 10 and xx + yy > 4""")
def ag24(v: Views):
    return rounded(stats.slope_fit(v.pts, ["frame"], "x", "y", "z", 10, 4))


@query("AG27_class_counts", "select frame, label, count(*) as n, round(count(*) / sum(count(*)) over (partition by frame), 6) as share from pts group by frame, label")
def ag27(v: Views):
    return rounded(stats.class_counts(v.pts, ["frame"], "label"))


@query("AG28_object_observations", """select label, ix, iy, round(w, 6) as weight, round(sx / w, 6) as x, round(greatest(0.01, sxx / w - (sx / w)*(sx / w)), 4) as var_x from (select label, cast(floor(x / 10) as bigint) as ix, cast(floor(y / 10) as bigint) as iy, sum(conf) as w, sum(conf*x) as sx, sum(conf*x*x) as sxx from pts where label <> 0 group by all) where w >= 1""")
def ag28(v: Views):
    out = stats.weighted_moments(grid.with_cells(v.pts.filter("label <> 0"), 10, ("x", "y")), ["label", "ix", "iy"], "conf", ["x"], 0.01).filter("weight >= 1")
    return out.select("label", "ix", "iy", r("weight").alias("weight"), r("x").alias("x"), r("var_x", 4).alias("var_x"))


@query("AG29_anchor_accumulation", "select label, cast(floor(x / 10) as bigint) as ix, cast(floor(y / 10) as bigint) as iy, count(*) as n, round(sum(z * conf) / sum(conf), 6) as z from pts where conf >= 0.05 group by all having count(*) >= 8")
def ag29(v: Views):
    cells = grid.with_cells(v.pts.filter("conf >= 0.05"), 10, ("x", "y")).groupBy("label", "ix", "iy").agg(F.count("*").alias("n"), (F.sum(F.col("z") * F.col("conf")) / F.sum("conf")).alias("z"))
    return rounded(cells.filter("n >= 8"))


@query("AG30_instance_clusters", "select instance, count(*) as n, round(avg(cast(label = 3 as int)), 6) as share3, round(avg(cast(label = 5 as int)), 6) as share5, max(x) - min(x) as dx, round(max(y) - min(y), 6) as dy, max(z) - min(z) as dz from pts group by instance")
def ag30(v: Views):
    return rounded(stats.instance_clusters(v.pts, "instance"))


@query("AG31_saturating_occupancy", """select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, round(least(1, sum(0.2 * conf)), 6) as occ, round(min(z), 6) as z_min, round(max(z), 6) as z_max, round(max(conf), 6) as quality, arg_max(label, id) filter (label <> 0) as label from pts group by all""")
def ag31(v: Views):
    return rounded(grid.saturating_occupancy(v.pts, 4, 0.2))


@query("AG32_prior_occupancy", "select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, round(least(1, 0.12 * count(*)), 6) as occ, coalesce(arg_max(label, id) filter (label <> 0), 0) as label from pts group by all")
def ag32(v: Views):
    cells = grid.with_cells(v.pts, 4, ("x", "y")).groupBy("ix", "iy").agg(F.least(F.lit(1.0), 0.12 * F.count("*")).alias("occ"), F.coalesce(F.max_by("label", F.when(F.col("label") != 0, F.col("id"))), F.lit(0)).alias("label"))
    return rounded(cells)


@query("AG33_density_layers", """with c as (select cast(floor(x / 4) as bigint) as ix, cast(floor(y / 4) as bigint) as iy, count(*) as n, sum(cast(z > 1 as bigint)) as o, sum(cast(z <= 1 as bigint)) as g, max(least(z, 3)) as h from pts group by all)
  select ix, iy, round(ln(1 + n) / max(ln(1 + n)) over (), 6) as n, round(ln(1 + o) / max(ln(1 + o)) over (), 6) as obstacle, round(ln(1 + g) / max(ln(1 + g)) over (), 6) as ground, round(h / max(h) over (), 6) as height from c""")
def ag33(v: Views):
    return rounded(grid.density_layers(v.pts, 4, 1, 3))


@query("AG36_wheel_speed", "select run, id, round((list_sort([v, v * 1.1, v * 0.9 + 1, 3 * v])[2] + list_sort([v, v * 1.1, v * 0.9 + 1, 3 * v])[3]) / 2, 6) as speed, round(abs((v + v * 1.1) / 2 - (v * 0.9 + 1 + 3 * v) / 2), 6) as disagreement from track")
def ag36(v: Views):
    four = [F.col("v"), F.col("v") * 1.1, F.col("v") * 0.9 + 1, 3 * F.col("v")]
    return rounded(v.track.select("run", "id", scalars.middle_two_mean(*four).alias("speed"), F.abs((four[0] + four[1]) / 2 - (four[2] + four[3]) / 2).alias("disagreement")))


@query("AG37_label_support", "select iy, count(*) as n, round(avg(cast(label > 0 as int)), 6) as foreground, round(avg(occ), 6) as mean_conf from raster group by iy")
def ag37(v: Views):
    return rounded(v.raster.groupBy("iy").agg(F.count("*").alias("n"), F.avg((F.col("label") > 0).cast("int")).alias("foreground"), F.avg("occ").alias("mean_conf")))


@query("AG38_score_confidence", """with s as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings) select vec_id, round(case when list_min(e) >= 0 and list_max(e) <= 1 and list_sum(e) > 0.5 and list_sum(e) < 1.5 then list_max(e) else 1 / list_sum(list_transform(e, lambda x: exp(x - list_max(e)))) end, 6) as conf from s""")
def ag38(v: Views):
    return rounded(v.embeddings.select("vec_id", scalars.confidence_of_scores(F.transform("embedding", lambda x: x.cast("double"))).alias("conf")))


@query("AG39_argmax_label", "select vec_id, cast((list_position(embedding, list_max(embedding)) - 1) % 7 as bigint) as label from embeddings")
def ag39(v: Views):
    return v.embeddings.select("vec_id", ((F.array_position("embedding", F.array_max("embedding")) - 1) % 7).alias("label"))


# scalar functions

@query("SC1_wrap_angle", "select id, round(v - 2 * pi() * round(v / (2 * pi())), 6) as a from track")
def sc1(v: Views):
    return rounded(v.track.select("id", scalars.wrap_angle(F.col("v")).alias("a")))


@query("SC2_yaw", "select id, round(atan2(2 * (qw*qz + qx*qy), 1 - 2 * (qy*qy + qz*qz)), 6) as yaw from poses")
def sc2(v: Views):
    return rounded(v.poses.select("id", pose.yaw(pose.named()).alias("yaw")))


@query("SC3_rotation_angle", "select id, round(2 * acos(least(1, abs(qw))), 5) as a from poses where abs(qw) < 0.99")
def sc3(v: Views):
    return rounded(v.poses.filter("abs(qw) < 0.99").select("id", pose.angle(pose.named()).alias("a")), 5)


@query("SC4_quaternion_product", """with p as (select id, qw*v as a, qx*v as b, qy*v as c, qz*v as d from (select id, qw, qx, qy, qz, z * 7 as v from poses) where v > 1e-6), n as (select id, a/s as a, b/s as b, c/s as c, d/s as d from (select *, sqrt(a*a+b*b+c*c+d*d) as s from p))
  select id, round(a*a - b*b - c*c - d*d, 6) as w, round(2*a*b, 6) as x, round(2*a*c, 6) as y, round(2*a*d, 6) as z from n""")
def sc4(v: Views):
    q = pose.normalize(tuple(c * F.col("z") * 7 for c in pose.named()))
    rows = v.poses.filter("z * 7 > 1e-6").select("id", *[c.alias(n) for c, n in zip(q, ("w", "x", "y", "z"), strict=True)])
    own = tuple(F.col(n) for n in ("w", "x", "y", "z"))
    return rounded(rows.select("id", *[c.alias(n) for c, n in zip(pose.multiply(own, own), ("w", "x", "y", "z"), strict=True)]))


@query("SC5_axis_convention", "select id, round(y, 6) as north, round(x, 6) as east, round(-z, 6) as down, round(qw, 6) as qw, round(qy, 6) as qx, round(qx, 6) as qy, round(-qz, 6) as qz from poses")
def sc5(v: Views):
    return rounded(v.poses.selectExpr("id", "y as north", "x as east", "-z as down", "qw", "qy as qx", "qx as qy", "-qz as qz"))


@query("SC6_enu", "select id, round(radians(lon - 0.01) * 6378137 * cos(radians(10)), 4) as e, round(radians(lat - 10) * 6378137, 4) as n, round(lat, 6) as lat, round(lon, 6) as lon from geo where lat between -80 and 80")
def sc6(v: Views):
    e, n = scalars.enu_from_lat_lon(F.col("lat"), F.col("lon"), 10, 0.01)
    rows = v.geo.filter("lat between -80 and 80").select("id", e.alias("e"), n.alias("n"))
    lat, lon = scalars.lat_lon_from_enu(F.col("e"), F.col("n"), 10, 0.01)
    return rows.select("id", r("e", 4).alias("e"), r("n", 4).alias("n"), r(lat).alias("lat"), r(lon).alias("lon"))


@query("SC7_tiles", "select id, cast(floor((lon + 180) / 360 * 65536) as bigint) as tx, cast(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 65536) as bigint) as ty, round(cos(radians(lat)) * 2 * pi() * 6378137 / (256 * 65536), 6) as mpp from geo where lat between -80 and 80")
def sc7(v: Views):
    x, y = scalars.tile_xy(F.col("lat"), F.col("lon"), 16)
    return rounded(v.geo.filter("lat between -80 and 80").select("id", x.alias("tx"), y.alias("ty"), scalars.metres_per_pixel(F.col("lat"), 16).alias("mpp")))


_E2 = scalars.WGS84_F * (2 - scalars.WGS84_F)
_N = f"(6378137.0 / sqrt(1 - {_E2!r} * pow(sin(radians(lat)), 2)))"


@query("SC8_geodetic_enu", f"""with e as (select id, ({_N} + alt) * cos(radians(lat)) * cos(radians(lon)) as x, ({_N} + alt) * cos(radians(lat)) * sin(radians(lon)) as y, ({_N} * (1 - {_E2!r}) + alt) * sin(radians(lat)) as z from geo where id > 0
  union all select -1, ({_N} + alt) * cos(radians(lat)) * cos(radians(lon)), ({_N} + alt) * cos(radians(lat)) * sin(radians(lon)), ({_N} * (1 - {_E2!r}) + alt) * sin(radians(lat)) from (select 10.0 as lat, 0.01 as lon, 5.0 as alt)),
  d as (select a.id, a.x - o.x as x, a.y - o.y as y, a.z - o.z as z from e a, (select * from e where id = -1) o where a.id > 0)
  select id, round(-sin(radians(0.01))*x + cos(radians(0.01))*y, 3) as e, round(-sin(radians(10))*cos(radians(0.01))*x - sin(radians(10))*sin(radians(0.01))*y + cos(radians(10))*z, 3) as n, round(cos(radians(10))*cos(radians(0.01))*x + cos(radians(10))*sin(radians(0.01))*y + sin(radians(10))*z, 3) as u from d""")
def sc8(v: Views):
    e, n, u = scalars.enu_from_lla(F.col("lat"), F.col("lon"), F.col("alt"), 10.0, 0.01, 5.0)
    return rounded(v.geo.filter("id > 0").select("id", e.alias("e"), n.alias("n"), u.alias("u")), 3)


@query("SC9_exp_log", "select id, round(v / 500, 6) as x, round(v / 700, 6) as y, round(-v / 900, 6) as z from track where v < 900")
def sc9(v: Views):
    w = (F.col("v") / 500, F.col("v") / 700, -F.col("v") / 900)
    rows = v.track.filter("v < 900").select("id", *[c.alias(n) for c, n in zip(pose.exp(w), ("qw", "qx", "qy", "qz"), strict=True)])
    return rounded(rows.select("id", *[c.alias(n) for c, n in zip(pose.log(pose.named()), "xyz", strict=True)]))


@query("SC10_project_rotation", "select id, round(qw, 6) as w, round(qx, 6) as x, round(qy, 6) as y, round(qz, 6) as z from poses")
def sc10(v: Views):
    q = pose.normalize(tuple(c * 1.7 for c in pose.named()))
    return rounded(v.poses.select("id", *[c.alias(n) for c, n in zip(q, ("w", "x", "y", "z"), strict=True)]))


@query("SC11_robust_weights", "select id, round(case when abs(v - 50) <= 3 then 1 else 3 / abs(v - 50) end, 6) as huber, round(least(1, pow(2.0 * 4 / (4 + v), 2)), 6) as dcs from track")
def sc11(v: Views):
    return rounded(v.track.select("id", scalars.huber_weight(F.col("v") - 50, 3).alias("huber"), scalars.dcs_weight(F.col("v"), 4).alias("dcs")))


@query("SC12_clamp", "select id, greatest(10, least(60, v)) as a from track")
def sc12(v: Views):
    return v.track.select("id", scalars.clamp(F.col("v"), 10, 60).alias("a"))


@query("SC13_cosine", "select a.vec_id, round(list_cosine_similarity(list_transform(a.embedding, lambda x: cast(x as double)), list_transform(b.embedding, lambda x: cast(x as double))), 6) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1")
def sc13(v: Views):
    b = v.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(v.embeddings.join(b, "vec_id").select("vec_id", scalars.cosine(F.col("embedding"), F.col("other")).alias("c")))


BITS = "select vec_id, list_reduce(list_transform(embedding, lambda x: cast(x > 0 as bigint)), lambda a, x: (a << 1) | x) as w from (select vec_id, embedding[2:64] as embedding from embeddings)"


@query("SC14_hamming", f"with w as ({BITS}) select a.vec_id, cast(bit_count(xor(a.w, b.w)) as int) as d from w a join w b on b.vec_id = a.vec_id + 1")
def sc14(v: Views):
    w = v.embeddings.select("vec_id", scalars.sign_bits(F.slice("embedding", 2, 63)).alias("w"))
    b = w.select((F.col("vec_id") - 1).alias("vec_id"), F.col("w").alias("other"))
    return w.join(b, "vec_id").select("vec_id", scalars.hamming(F.col("w"), F.col("other")).alias("d"))


@query("SC15_lsh_code", f"with w as ({BITS}) select vec_id, t, {' | '.join(f'(((w >> cast((17 + 37 * t + 11 * {b}) % 64 as int)) & 1) << {b})' for b in range(8))} as code from w, (select unnest([0, 1, 2]) as t)")
def sc15(v: Views):
    w = v.embeddings.select("vec_id", scalars.sign_bits(F.slice("embedding", 2, 63)).alias("w"))
    tables = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), scalars.lsh_code(F.col("w"), t).alias("code")) for t in range(3)])).alias("c")
    return w.select("vec_id", tables).select("vec_id", "c.t", "c.code")


@query("SC16_cells", "select id, cast(floor(x / 3) as bigint) as ix, (cast(floor(x / 3) as bigint) + 0.5) * 3 as cx, cast(floor(x / 3) as bigint) between 2 and 12 as inside from pts")
def sc16(v: Views):
    ix = scalars.cell(F.col("x"), 3)
    return v.pts.select("id", ix.alias("ix"), scalars.cell_center(ix, 3).alias("cx"), ix.between(2, 12).alias("inside"))


@query("SC17_composite_key", "select label, cast(floor(x / 10) as bigint) as ix, cast(floor(y / 20) as bigint) as iy, count(*) as n from pts group by all")
def sc17(v: Views):
    return v.pts.groupBy("label", scalars.cell(F.col("x"), 10).alias("ix"), scalars.cell(F.col("y"), 20).alias("iy")).agg(F.count("*").alias("n"))


@query("SC18_packed_rgb", "select id, cast(((label * 30) << 16) | ((label * 20) << 8) | cast(floor(conf * 100) as int) as int) as rgb from pts")
def sc18(v: Views):
    return v.pts.select("id", scalars.packed_rgb(F.col("label") * 30, F.col("label") * 20, F.floor(F.col("conf") * 100)).alias("rgb"))


@query("SC19_arc", "select id, round(case when abs(a) < 1e-5 then v else v * sin(a) / a end, 6) as dx, round(case when abs(a) < 1e-5 then 0 else v * (1 - cos(a)) / a end, 6) as dy from (select id, v, (id % 41 - 20) / 7.0 as a from track)")
def sc19(v: Views):
    dx, dy = scalars.arc_step(F.col("v"), F.col("a"))
    return rounded(v.track.selectExpr("id", "v", "(id % 41 - 20) / 7D as a").select("id", dx.alias("dx"), dy.alias("dy")))


@query("SC20_pose_quality", "select id, round(least(1, greatest(0, 0.25 * conf + 0.35 * z / 5 + 0.2 * x / 50 + 0.2 * exp(-y / 40))), 6) as q from pts")
def sc20(v: Views):
    return rounded(v.pts.select("id", scalars.pose_quality(F.col("conf"), F.col("z") / 5, F.col("x") / 50, F.col("y"), 40).alias("q")))


@query("SC21_gap_confidence", "select id, round(1 / (1 + exp(-20 * (conf - 0.07))), 6) as c from pts")
def sc21(v: Views):
    return rounded(v.pts.select("id", scalars.gap_confidence(F.col("conf"), 0.07).alias("c")))


COMPAT = {(a, b): (1.0 if a == b else 0.4 if {a, b} in ({1, 2}, {3, 4}) else -0.5 if 5 in (a, b) else 0.1) for a in range(7) for b in range(7)}


@query("SC22_compatibility", """select p.id, round(case when p.label = r.label then 1 when (p.label, r.label) in ((1, 2), (2, 1), (3, 4), (4, 3)) then 0.4 when p.label = 5 or r.label = 5 then -0.5 else 0.1 end, 6) as score from pts p join raster r on r.ix = cast(floor(x) as bigint) and r.iy = cast(floor(y / 5) as bigint)""")
def sc22(v: Views):
    table = v.spark.createDataFrame([(a, b, s) for (a, b), s in COMPAT.items()], "label int, prior int, score double")  # 49 rows
    rows = v.pts.select("id", "label", scalars.cell(F.col("x"), 1).alias("ix"), scalars.cell(F.col("y"), 5).alias("iy")).join(v.raster.select("ix", "iy", F.col("label").alias("prior")), ["ix", "iy"])
    return rows.join(F.broadcast(table), ["label", "prior"]).select("id", "score")


@query("SC23_distance_kernel", "select id, round(exp(-least(30, y) / 12), 6) as k from pts")
def sc23(v: Views):
    return rounded(v.pts.select("id", scalars.distance_kernel(F.col("y"), 12, 30).alias("k")))


@query("SC24_correlation", "select frame, count(*) as n, round(corr(x, y), 6) as ncc from pts group by frame having count(*) >= 50 and stddev_pop(x) > 0")
def sc24(v: Views):
    return rounded(v.pts.groupBy("frame").agg(F.count("*").alias("n"), F.corr("x", "y").alias("ncc")).filter("n >= 50"))


@query("SC25_patch_normalize", "with s as (select vec_id, list_avg(e) as m, list_stddev_pop(e) as s, e from (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings)) select vec_id, round(s, 6) as sigma, round((e[1] - m) / s, 5) as first, round((e[64] - m) / s, 5) as last from s where s >= 0.01".replace("list_stddev_pop(e)", "sqrt(list_sum(list_transform(e, lambda x: (x - list_avg(e)) * (x - list_avg(e)))) / len(e))"))
def sc25(v: Views):
    out = stats.normalize_patch(v.embeddings, "embedding", 0.01)
    return out.select("vec_id", r("sigma").alias("sigma"), r(F.col("patch")[0], 5).alias("first"), r(F.col("patch")[63], 5).alias("last"))


@query("SC28_scan_end", "select frame, case when max(stamp) / 1e6 > 1e8 and abs(max(stamp) / 1e6 - 883612800) <= 1e9 then max(stamp) else 883612800000000 + max(stamp) end as stamp from pts group by frame")
def sc28(v: Views):
    top = F.max("stamp")
    return v.pts.groupBy("frame").agg(F.when((top / 1e6 > 1e8) & (F.abs(top / 1e6 - 883612800) <= 1e9), top).otherwise(F.lit(883612800000000) + top).alias("stamp"))


@query("SC29_clock_offset", "select event_id as id, MICROS[ts] + case event_type when 'view' then 1500 when 'click' then -700 else 0 end as t from events")
def sc29(v: Views):
    rows = v.sql("select event_id as id, event_type as sensor, MICROS[ts] as t from events")
    return rows.select("id", scalars.with_clock_offset(F.col("t"), F.col("sensor"), {"view": 1500, "click": -700}).alias("t"))


@query("SC34_colour_rules", "select id, 2 * g - r - b > 40 as green, greatest(r, g, b) - least(r, g, b) < 20 as grey from (select id, label * 30 as r, cast(floor(z * 40) as bigint) as g, cast(x as bigint) * 4 as b from pts)")
def sc34(v: Views):
    rows = v.pts.selectExpr("id", "label * 30 as r", "floor(z * 40) as g", "cast(x as bigint) * 4 as b")
    return rows.selectExpr("id", "2 * g - r - b > 40 as green", "greatest(r, g, b) - least(r, g, b) < 20 as grey")


@query("SC36_scaled_intrinsics", "select id, round(500.0 * w / 640, 6) as fx, round(510.0 * h / 480, 6) as fy, round(320.0 * w / 640, 6) as cx, round(240.0 * h / 480, 6) as cy from (select id, 320 + id % 640 as w, 240 + id % 480 as h from geo)")
def sc36(v: Views):
    scaled = scalars.scaled_intrinsics((500.0, 510.0, 320.0, 240.0), (640, 480), 320 + F.col("id") % 640, 240 + F.col("id") % 480)
    return rounded(v.geo.select("id", *[c.alias(n) for c, n in zip(scaled, ("fx", "fy", "cx", "cy"), strict=True)]))


@query("SC37_rigid_check", "select id, abs(qw*qw + qx*qx + qy*qy + qz*qz - 1) < 1e-3 and isfinite(x + y + z) as ok from (select id, x, y, z, qw * (1 + case when id % 5 = 0 then 0.1 else 0 end) as qw, qx, qy, qz from poses)")
def sc37(v: Views):
    rows = v.poses.withColumn("qw", F.col("qw") * (1 + F.when(F.col("id") % 5 == 0, 0.1).otherwise(0.0)))
    return rows.select("id", pose.is_rigid(pose.named(), tuple(F.col(c) for c in "xyz")).alias("ok"))


@query("SC38_pixel_position", "select ix, iy, round(-100 + (greatest(0, least(63, ix)) + 0.5) / 64 * 300, 6) as e, round(200 - (greatest(0, least(63, iy)) + 0.5) / 64 * 250, 6) as n from raster")
def sc38(v: Views):
    e, n = clouds.pixel_position(F.col("ix"), F.col("iy"), 64, 64, (-100, 200), (-50, 200))
    return rounded(v.raster.select("ix", "iy", e.alias("e"), n.alias("n")))


@query("WN19_stale_trust", "select id, round(0.2 + 0.8 * greatest(0, least(1, 1 - (id % 30) / 20.0)), 6) as trust from track")
def wn19(v: Views):
    return rounded(v.track.select("id", scalars.trust(F.col("id") % 30, 0.2, 20).alias("trust")))
