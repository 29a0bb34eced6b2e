"""Queries on ordered gates with named limits, and on label spaces."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import labels
from waymark.operators import folds, gates, vision
from waymark.plans.clouds import rounded
from waymark.plans.registrations import LANDMARKS, features_of
from waymark.plans.registry import query
from waymark.plans.views import Views

#: What a registration would report, from the orders: one SQL for both engines.
STATS = """select o_orderkey as id, o_custkey as run, o_orderkey % 1200 as used, o_orderkey % 13 <> 0 as linearised, o_orderkey % 11 <> 0 as converged, (o_orderkey % 10) / 10.0 as ratio, (o_custkey % 40) / 100.0 as rmse, (o_orderkey % 50) / 10.0 as normalised,
  3 + o_orderkey % 4 as directions, o_orderkey % 4 as turn_directions, (o_custkey % 20) / 20.0 as yaw_share, (o_custkey % 30) / 10.0 as shift, cast(o_orderkey % 20 as double) as turn, (o_custkey % 25) / 1.25 as turn_nis, ((o_custkey + o_orderkey) % 80 - 40) / 10.0 as yaw_total, (o_orderkey % 14) / 10.0 as correction_shift, cast(o_custkey % 7 as double) as correction_turn,
  o_orderkey % 5 = 0 as degenerate, o_orderkey % 17 = 0 as yaw_limited, o_custkey % 9 <> 0 as trusted, o_orderkey % 3 <> 0 as keyframe from orders"""


@query("FIL16_acceptance_cascade", f"""with s as ({STATS}), g as (select *, used >= 800 and rmse <= 0.1 as strong from s)
  select id, case when used < 100 then 'too_few_planes' when not linearised then 'not_linearised' when not converged then 'not_converged' when ratio < 0.3 and not strong then 'low_support' when rmse > 0.25 then 'high_residual' when normalised > 3 then 'high_normalised_residual'
    when directions < 5 and not strong then 'unobservable' when shift > 2 or turn > 15 then 'implausible_motion' when turn_nis > 16 then 'turn_innovation' when abs(yaw_total) > 3 then 'persistent_yaw' when correction_shift > 1 or correction_turn > 5 then 'implausible_correction'
    when degenerate and not strong and (ratio < 0.5 or rmse > 0.15) then 'weak_degenerate' else 'accepted' end as reason from g""")
def fil16(v: Views):
    return v.sql(STATS).select("id", gates.registration_reason().alias("reason"))


@query("FIL17_insertion_gate", f"""with s as ({STATS}), r as (select id, case when directions < 6 then 'insufficient_observability' when turn_directions < 2 then 'insufficient_turn_observability' when yaw_share < 0.3 then 'insufficient_yaw_observability' when normalised > 4 then 'high_normalised_residual'
    when not converged then 'not_converged' when yaw_limited then 'limited_yaw' when correction_shift > 1 then 'large_correction' when not trusted then 'recovery' when not keyframe then 'not_keyframe' else 'updated' end as reason from s) select id, reason = 'updated' as insert, reason from r""")
def fil17(v: Views):
    reason = gates.insertion_reason(gates.Insertion(turn_directions=2, yaw_share=0.3, max_normalised=4.0, max_shift=1.0, max_turn=0.0))
    return v.sql(STATS).select("id", (reason == "updated").alias("insert"), reason.alias("reason"))


@query("FIL17_recovery_trust", """with recursive s as (select o_custkey as run, o_orderkey as id, o_orderkey % 6 = 0 as outage, o_orderkey % 4 <> 1 as strong, row_number() over (partition by o_custkey order by o_orderkey) as n from orders),
  f as (select run, n, id, outage as guarded, cast(0 as bigint) as streak from s where n = 1 union all
    select s.run, s.n, s.id, case when s.outage then true when f.guarded then case when s.strong then f.streak + 1 else 0 end < 2 else false end, case when s.outage then 0 when f.guarded and s.strong then f.streak + 1 when f.guarded then 0 else f.streak end from f join s on s.run = f.run and s.n = f.n + 1)
  select id, not guarded as trusted from f""")
def fil17_trust(v: Views):
    """After an outage a run is trusted again once two strong scans came in a row."""
    rows = v.orders.select(F.col("o_custkey").alias("run"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 6 == 0).alias("outage"), (F.col("o_orderkey") % 4 != 1).alias("strong"))
    return folds.fold(rows, ["run"], ["id"], gates.recovery_trust(2), "run long, id long, outage boolean, strong boolean, trusted boolean").select("id", "trusted")


MATCHES = "select id, x as e, y as n, conf * 2 as confidence, z / 5 as ratio, label * 6 as inliers, x + label * 4 - 12 as state_e, y - label as state_n, case when label > 1 then x + z * 3 end as gps_e, case when label > 1 then y - 8 end as gps_n from pts"


@query("FIL18_match_gate", f"""select id, confidence >= 0.4 and ratio >= 0.25 and inliers >= 15 and sqrt((e - state_e) * (e - state_e) + (n - state_n) * (n - state_n)) <= 10 and (gps_e is null or sqrt((e - gps_e) * (e - gps_e) + (n - gps_n) * (n - gps_n)) <= 12) as accepted from ({MATCHES}) m""")
def fil18(v: Views):
    return v.sql(MATCHES).select("id", gates.map_match_accepted(gates.MapMatch(max_correction=10, max_gps=12)).alias("accepted"))


@query("FIL25_fix_quality", """select id, round(deviation, 6) as deviation, status >= 1 and deviation <= 3 as accepted from (select id, id % 4 - 1 as status, case when id % 5 = 0 then 999 when greatest(0, alt / 50) + greatest(0, lat / 3) > 1e-12 then sqrt((greatest(0, alt / 50) + greatest(0, lat / 3)) / 2) else 0 end as deviation from geo) f""")
def fil25(v: Views):
    deviation = gates.fix_deviation(F.col("id") % 5, F.col("alt") / 50, F.col("lat") / 3)
    return rounded(v.geo.select("id", deviation.alias("deviation"), gates.fix_accepted(F.col("id") % 4 - 1, deviation, 1, 3.0).alias("accepted")))


TRACKED = "select id, 40 + label * 15 as tracked, label * 12 + cast(floor(z * 6) as bigint) as inliers, y / 20 as parallax, z / 2 as reprojection, x / 2 as turn, conf * 40 as shift from pts"


@query("VIS1_tracking_gates", f"""select id, case when tracked < 60 then 'few_features' when parallax < 1 then 'parallax' when inliers < 25 then 'few_inliers' when inliers / cast(tracked as double) < 0.4 then 'inlier_ratio' when reprojection > 2 then 'reprojection' when turn > 20 or shift > 3 then 'implausible_motion' else 'accepted' end as reason,
  round(greatest(0, least(1, inliers / cast(tracked as double))) / 2 + greatest(0, least(1, inliers / 50.0)) / 3 + greatest(0, least(1, 1 - reprojection / 2)) / 6, 6) as quality from ({TRACKED}) t""")
def vis1(v: Views):
    return rounded(v.sql(TRACKED).select("id", gates.tracking_reason().alias("reason"), gates.tracking_quality().alias("quality")))


VERIFIED = "select run, i, j, 30 + (run * 7 + i) % 60 as matches, 10 + (run * 5 + j) % 45 as inliers, ((run + i * 3) % 40) / 10.0 as reprojection, sqrt(mx * mx + my * my) as distance, (run + j) % 14 as cells from loops"


@query("VIS2_loop_verification", f"""select run, i, j, case when matches < 40 then 'few_matches' when inliers < 20 then 'few_inliers' when inliers / cast(matches as double) < 0.35 then 'inlier_ratio' when reprojection > 3 then 'reprojection' when cells < 6 then 'coverage' when distance > 15 then 'distance' else 'verified' end as reason,
  round(0.5 * least(1, inliers / cast(matches as double)) + 0.3 * least(1, inliers / 60.0) + 0.2 * greatest(0, least(1, 1 - reprojection / 3)), 6) as quality from ({VERIFIED}) t""")
def vis2(v: Views):
    reason, quality = gates.loop_verified()
    return rounded(v.sql(VERIFIED).select("run", "i", "j", reason.alias("reason"), quality.alias("quality")))


ABOVE = "select id, label * 4 as matches, cast(floor(z * 5) as bigint) as inliers, x - 25.3 as dx, y - 50.7 as dy, 0.4 + conf * 3 as scale from pts"


@query("VIS6_match_gates", f"""select id, case when matches < 12 then 'few_matches' when inliers < 8 then 'few_inliers' when inliers / cast(matches as double) < 0.3 then 'inlier_ratio' when scale < 0.6 or scale > 1.6 then 'scale' when sqrt(dx * dx + dy * dy) > 40 then 'offset' else 'accepted' end as reason,
  round(case when matches = 0 then 0 else greatest(0, least(1, inliers / cast(matches as double) * (1 - exp(-inliers / 16.0)))) end, 6) as confidence from ({ABOVE}) t""")
def vis6(v: Views):
    reason, confidence = gates.overhead_match(gates.Overhead(max_offset=40))
    return rounded(v.sql(ABOVE).select("id", reason.alias("reason"), confidence.alias("confidence")))


#: A frame's landmarks, ten times as high, and the camera that sees them, above their middle and looking down.
FOCAL = 500.0


def correspondences(v: Views, method: str):
    """(frame, id, x, y, z, u, v) of each frame: what a camera, a second view or an overhead image sees of its features, half a pixel off at most; two of five matches are false."""
    rows = features_of(v.sql(LANDMARKS)).withColumn("z", F.col("z") * 10)
    frame = F.col("frame")
    noise = lambda k: (F.pmod(F.xxhash64("frame", "id", F.lit(k)), F.lit(2001)) - 1000) / 1000.0
    wrong = F.pmod(F.xxhash64("frame", "id", F.lit(9)), F.lit(5)) < 2
    turn, px, py, pz = _view(frame)
    x, y, z = F.col("x") - 25, F.col("y") - 50, F.col("z") + 60
    if method == "affine":
        scale = 0.9 + (frame % 4) * 0.1
        rows = rows.withColumns({"u": scale * (F.cos(turn) * F.col("x") - F.sin(turn) * F.col("y")) + px, "v": scale * (F.sin(turn) * F.col("x") + F.cos(turn) * F.col("y")) + py})
        far, small = 20.0, 0.1
    else:
        dx, dy, dz = x - px, y - py, z - pz
        rows = rows.withColumns({"u": (F.cos(turn) * dx + F.sin(turn) * dy) / dz, "v": (F.cos(turn) * dy - F.sin(turn) * dx) / dz})
        # the first view is what a camera at the origin sees
        rows = rows.withColumns({"x": x / z, "y": y / z} if method == "turn" else {"x": x, "y": y, "z": z})
        far, small = 0.5, (0.2 if method == "turn" else 0.5) / FOCAL
    seen = {"u": F.when(wrong, far * noise(1)).otherwise(F.col("u") + small * noise(2)), "v": F.when(wrong, far * noise(3)).otherwise(F.col("v") + small * noise(4))}
    return rows.withColumns(seen).select("frame", "id", "x", "y", "z", "u", "v")


def _view(frame) -> tuple:
    """Turn and place of a frame's second view, as columns or numbers."""
    return (frame % 7 - 3) * 0.02, (frame % 5) * 2.0 + 1, (frame % 3) * 1.5, (frame % 4) * -1.0


@query("VIS2_loop_pose")
def vis2_pose(v: Views):
    """The camera of each frame's second view by consensus, what the gates say of it, and how far it is from the true one."""
    reason, quality = gates.loop_verified()
    found = vision.motions(correspondences(v, "pose"), ["frame"], "id", "pose", vision.Consensus(focal=FOCAL))
    turn, px, py, pz = _view(F.col("frame"))
    off = F.sqrt((F.col("px") - px) ** 2 + (F.col("py") - py) ** 2 + (F.col("pz") - pz) ** 2)
    return found.select("frame", "matches", reason.alias("reason"), F.round(quality, 2).alias("quality"), F.round(off, 1).alias("off"), F.round("turn", 0).alias("turn"))


@query("VIS1_two_view_turn")
def vis1_turn(v: Views):
    """The turn between each frame's two views by an essential matrix, and what the gates say of it; a direction has no length."""
    found = vision.motions(correspondences(v, "turn"), ["frame"], "id", "turn", vision.Consensus(focal=FOCAL, hypotheses=800))
    rows = found.withColumnRenamed("matches", "tracked").withColumn("shift", F.lit(0.0))
    return rows.select("frame", "tracked", gates.tracking_reason().alias("reason"), F.round(gates.tracking_quality(), 2).alias("quality"), F.round("turn", 0).alias("turn"))


@query("VIS6_plane_map")
def vis6_map(v: Views):
    """The affine map of each frame's features onto an overhead image by consensus, and what the gates say of it."""
    reason, confidence = gates.overhead_match(gates.Overhead(max_offset=40))
    found = vision.motions(correspondences(v, "affine"), ["frame"], "id", "affine", vision.Consensus(reach=0.3))
    return found.select("frame", "matches", reason.alias("reason"), F.round(confidence, 2).alias("confidence"), F.round("dx", 1).alias("dx"), F.round("dy", 1).alias("dy"), F.round("scale", 2).alias("scale"))


@query("SNK13_pair_stages", """with p as (select run, i, quality >= 0.5 as applied, sqrt((mx - gbx + gax) * (mx - gbx + gax) + my * my) as r from loops)
  select run, stage, count(*) as n from (select run, case when r > 3 then 'outlier' when r > 1 then 'candidate' when applied then 'applied' else 'inlier' end as stage from p) s group by run, stage""")
def snk13(v: Views):
    """Pairs of each run by stage."""
    rows = v.loops.select("run", F.hypot(F.col("mx") - F.col("gbx") + F.col("gax"), F.col("my")).alias("r"), (F.col("quality") >= 0.5).alias("applied"))
    return gates.pair_stages(rows, "r", 3.0, 1.0, F.col("applied")).groupBy("run", "stage").agg(F.count("*").alias("n"))


# label spaces

RAW = "select id, cast(case instance % 28 when 0 then 0 when 1 then 10 when 2 then 11 when 3 then 13 when 4 then 15 when 5 then 16 when 6 then 18 when 7 then 20 when 8 then 30 when 9 then 31 when 10 then 32 when 11 then 40 when 12 then 44 when 13 then 48 when 14 then 49 when 15 then 50 when 16 then 51 when 17 then 52 when 18 then 60 when 19 then 70 when 20 then 71 when 21 then 72 when 22 then 80 when 23 then 81 when 24 then 99 when 25 then 252 when 26 then 259 else 7 end as int) as raw, label from pts"


@query("JN30_label_remap", f"""select id, raw,
  case when raw = 0 then 0 when raw in (40, 44) then 1 when raw in (48, 49) then 2 when raw = 50 then 3 when raw in (70, 71, 72, 80, 81) then 4 when raw in (10, 11, 13, 15, 18, 20, 30, 31, 32) then 5 else 6 end as core,
  case when raw in (40, 44, 49) then 1 when raw in (48, 72) then 2 when raw in (50, 51, 52) then 3 when raw in (70, 71, 80, 81) then 4 when raw in (10, 11, 13, 15, 16, 18, 20, 30, 31, 32) or raw between 252 and 259 then 5 when raw = 99 then 6 else 0 end as voxel,
  case when raw = 0 then 0 when raw in (40, 44) then 1 when raw in (48, 49) then 2 when raw in (50, 51, 52) then 3 when raw in (70, 71, 72, 80, 81) then 4 when raw between 10 and 18 or raw between 252 and 259 then 5 else 6 end as graph,
  case when raw in (40, 44, 60) then 1 when raw in (48, 49, 72) then 2 when raw in (50, 51, 52) then 3 when raw in (70, 71, 80, 81) then 4 when raw in (10, 11, 13, 15, 16, 18, 20, 30, 31, 32) or raw between 252 and 259 then 5 when raw = 99 then 6 else 0 end as bridge,
  case when label in (0, 1, 5) then label when label = 2 then 3 when label in (3, 4) then 4 else 6 end as camera, greatest(0, least(6, label * 2 - 2)) as held,
  case label when 0 then 0 when 1 then 40 when 2 then 48 when 3 then 50 when 4 then 70 when 5 then 10 when 6 then 99 else 0 end as back,
  case label when 0 then 0 when 1 then 10 when 2 then 11 when 3 then 15 when 4 then 18 when 5 then 20 when 6 then 30 else 0 end as learned from ({RAW}) r""")
def jn30(v: Views):
    """Raw ids in each component's labels, camera and internal labels, and back."""
    raw, own = F.col("raw"), F.col("label")
    by = {"core": (raw, "semantic_kitti"), "voxel": (raw, "voxel"), "graph": (raw, "graph"), "bridge": (raw, "bridge"), "camera": (own, "sam3"), "held": (own * 2 - 2, "internal"), "back": (own, "internal_to_raw"), "learned": (own, "learning_to_raw")}
    return v.sql(RAW).select("id", "raw", *[labels.convert(c, mode).alias(name) for name, (c, mode) in by.items()])
