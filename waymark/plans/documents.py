"""Queries on text sources, JSON documents and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import pose
from waymark.plans.clouds import rounded
from waymark.plans.registry import query
from waymark.plans.views import Views
from waymark.sources import sinks, text

LINES = """select doc_id as id, case when doc_id % 11 = 0 then '# comment' when doc_id % 7 = 0 then 'bad line 1 2' when doc_id % 2 = 0 then concat_ws(',', doc_id, n_chars, 2, 3, 0, 0, 1, 1) else concat_ws(' ', doc_id, n_chars, 5, 6, 0, 0, 0, 2) end as value from documents"""


@query("SRC6_tum_reader", f"""with l as ({LINES}), p as (select id, string_split(trim(regexp_replace(value, '[,\\s]+', ' ', 'g')), ' ') as p from l where value not like '#%'), n as (select id, try_cast(p[1] as double) as t, try_cast(p[2] as double) as x, try_cast(p[7] as double) as z, try_cast(p[8] as double) as w from p)
  select id, t, x, round(z / sqrt(z*z + w*w), 6) as qz, round(w / sqrt(z*z + w*w), 6) as qw, w is null as bad from n""")
def src6(v: Views):
    return rounded(text.parse_tum(v.sql(LINES), keep=["id"]).select("id", "t", "x", F.when(~F.col("bad"), F.col("qz")).alias("qz"), F.when(~F.col("bad"), F.col("qw")).alias("qw"), "bad").withColumn("t", F.when(F.col("t").isNotNull(), F.col("t"))))


PCD = "select doc_id % 20 as file, doc_id as line, case when doc_id < 20 then 'VERSION 0.7' when doc_id < 40 then case when doc_id % 20 = 3 then 'DATA binary' else 'DATA ascii' end else concat_ws(' ', n_chars, doc_id % 9, doc_id % 4, 77) end as value from documents"


@query("SRC5_pcd_reader", "select doc_id % 20 as file, doc_id as line, cast(n_chars as double) as x, cast(doc_id % 9 as double) as y, cast(doc_id % 4 as double) as z from documents where doc_id >= 40 and doc_id % 20 <> 3")
def src5(v: Views):
    return text.parse_pcd(v.sql(PCD), "line", keys=["file"]).select("file", "line", "x", "y", "z")


YAML = "select doc_id as id, case when doc_id % 5 = 0 then '# only a comment' when doc_id % 3 = 0 then concat('zoom: ', n_chars, '  # note') else concat('image_path: \"', source, '.png\"') end as value from documents"


@query("SRC7_flat_yaml", "select doc_id as id, case when doc_id % 3 = 0 then 'zoom' else 'image_path' end as key, case when doc_id % 3 = 0 then cast(n_chars as varchar) else source || '.png' end as value from documents where doc_id % 5 <> 0")
def src7(v: Views):
    return text.parse_flat_yaml(v.sql(YAML), keys=["id"])


@query("SRC8_queue_requests", "select id, name from (select event_id as id, case when event_id % 3 = 0 then 'ready_' when event_id % 3 = 1 then 'result_' else 'image_' end || lpad(cast(event_id as varchar), 6, '0') || '.json' as name, user_id % 2 as session, row_number() over (order by case when event_id % 3 = 0 then 'ready_' else 'z' end, event_id) as rn from events where event_id % 3 = 0 and user_id % 2 = 1) order by name limit 25")
def src8(v: Views):
    kind = F.when(F.col("event_id") % 3 == 0, "ready_").when(F.col("event_id") % 3 == 1, "result_").otherwise("image_")
    rows = v.events.select(F.col("event_id").alias("id"), F.concat(kind, F.lpad(F.col("event_id").cast("string"), 6, "0"), F.lit(".json")).alias("name"), (F.col("user_id") % 2).alias("session"))
    return rows.filter(F.col("name").startswith("ready_") & (F.col("session") == 1)).orderBy("name").limit(25).select("id", "name")


@query("SRC9_entrances", "select id, round(case when id % 2 = 0 then id * 1.5 else radians(lon - 0.02) * 6378137 * cos(radians(5)) end, 4) as east, round(case when id % 2 = 0 then id * 2.5 else radians(lat - 5) * 6378137 end, 4) as north from geo where id % 3 <> 0")
def src9(v: Views):
    even, some = F.col("id") % 2 == 0, F.col("id") % 3 != 0
    rows = v.geo.select("id", F.when(even & some, F.col("id") * 1.5).alias("east"), F.when(even & some, F.col("id") * 2.5).alias("north"), F.when(~even & some, F.col("lat")).alias("lat"), F.when(~even & some, F.col("lon")).alias("lon"))
    return rounded(text.entrances(rows, 5, 0.02), 4)


@query("SC30_text_functions", "select doc_id, regexp_replace(regexp_replace(lower(trim(source || ' A-' || lang)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as name, cast(2 as int) as n, cast(n_chars as double) as first from documents")
def sc30(v: Views):
    numbers = text.number_list(F.concat_ws(", ", F.col("n_chars").cast("string"), F.lit("x"), F.lit("3.5")))
    return v.documents.select("doc_id", text.clean_name(F.concat("source", F.lit(" A-"), "lang")).alias("name"), F.size(numbers).alias("n"), numbers[0].alias("first"))


@query("SC31_json_lookup", "select event_id, coalesce(json_extract_string(props, '$.k'), '?') as k, coalesce(json_extract_string(props, '$.none'), 'default') as other from events")
def sc31(v: Views):
    return v.events.select("event_id", text.json_value(F.col("props"), "k", "?").alias("k"), text.json_value(F.col("props"), "none", "default").alias("other"))


@query("SC32_metric_lines", "select doc_id, cast(regexp_extract('rmse ' || n_chars || '.25 max 3', 'rmse\\s+([0-9.]+)', 1) as double) as rmse from documents")
def sc32(v: Views):
    return v.documents.select("doc_id", F.expr("try_cast(regexp_extract(concat('rmse ', n_chars, '.25 max 3'), 'rmse\\\\s+([0-9.]+)', 1) as double)").alias("rmse"))


@query("SC33_message_ids", "select event_id, printf('%d_%s_%06d', epoch_us(ts), 's' || user_id, event_id) as id from events")
def sc33(v: Views):
    rows = v.sql("select event_id, MICROS[ts] as t, concat('s', user_id) as s from events")
    return rows.select("event_id", text.message_id(F.col("t"), F.col("s"), F.col("event_id")).alias("id"))


@query("SNK1_trajectory_lines", "select id, printf('%.6f', round(t / 1e6, 6)) || ',' || printf('%.4f', round(x, 4) + 0.0) as line from track")
def snk1(v: Views):
    return v.track.select("id", F.concat_ws(",", F.format_string("%.6f", F.round(F.col("t") / 1e6, 6)), F.format_string("%.4f", F.round("x", 4) + F.lit(0.0))).alias("line"))


@query("SNK2_object_table", "select instance, label, round(avg(x), 4) as x, round(avg(y), 4) as y, count(*) as observations from pts group by instance, label")
def snk2(v: Views):
    return rounded(v.pts.groupBy("instance", "label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("observations")), 4)


@query("SNK2_object_file", """select instance as id, label, round(avg(x), 4) + 0.0 as x, round(avg(y), 4) + 0.0 as y, round(avg(z), 4) + 0.0 as z, round(var_pop(x), 3) + 0.0 as cov_x, round(var_pop(y), 3) + 0.0 as cov_y, round(var_pop(z), 3) + 0.0 as cov_z, count(*) as observations,
  round(least(1, count(*) / 20.0), 4) + 0.0 as reliability, cast(avg(z) <= 1.5 as int) as reachable from pts group by instance, label""")
def snk2_file(v: Views):
    """All columns of the object file; an object is reachable if its mean height is."""
    spread = [F.round(F.var_pop(c), 3).alias(f"cov_{c}") for c in "xyz"]
    found = v.pts.groupBy(F.col("instance").alias("id"), "label").agg(*[F.round(F.avg(c), 4).alias(c) for c in "xyz"], *spread, F.count("*").alias("observations"), F.round(F.least(F.lit(1.0), F.count("*") / 20.0), 4).alias("reliability"), (F.avg("z") <= 1.5).cast("int").alias("reachable"))
    return sinks.object_rows(found)


_HALF = "0.7071067811865476"


@query("SNK2_trajectory_modes", f"""with n as (select id, t, x, y, z, qw, qx, qy, qz, {_HALF} * (-qx - qy) as w, {_HALF} * (qw + qz) as i, {_HALF} * (qw - qz) as j, {_HALF} * (qy - qx) as k from poses)
  select id, t, round(y, 5) + 0.0 as x, round(x, 5) + 0.0 as y, round(-z, 5) + 0.0 as z, round(-i, 5) + 0.0 as qw, round(w, 5) + 0.0 as qx, round(k, 5) + 0.0 as qy, round(-j, 5) + 0.0 as qz, round(w, 5) + 0.0 as ned_qw, round(i, 5) + 0.0 as ned_qx, round(j, 5) + 0.0 as ned_qy, round(k, 5) + 0.0 as ned_qz from n""")
def snk2_modes(v: Views):
    """The trajectory in north-east-down with the body forward-right-down, and its turns with the body left as it is."""
    q, place = pose.named(), tuple(F.col(c) for c in "xyz")
    whole, there = pose.in_mode(q, place, "enu_flu_to_ned_frd")
    half, _ = pose.in_mode(q, place, "enu_to_ned")
    names = ("qw", "qx", "qy", "qz")
    return rounded(v.poses.select("id", "t", *[c.alias(n) for n, c in zip("xyz", there, strict=True)], *[c.alias(n) for n, c in zip(names, whole, strict=True)], *[c.alias(f"ned_{n}") for n, c in zip(names, half, strict=True)]), 5)


@query("SNK3_coloured_points", "select id, [128, 128, 244, 70, 107, 220, 250][label + 1] as red, [128, 64, 35, 70, 142, 20, 170][label + 1] as green from pts")
def snk3(v: Views):
    table = v.spark.createDataFrame([(k, *c) for k, c in enumerate(sinks.PALETTE)], "label int, red int, green int, blue int")  # seven rows
    return v.pts.join(F.broadcast(table), "label").select("id", "red", "green")


@query("SNK5_match_table", "select run, i, j, round(dx, 8) as error from edges where loop")
def snk5(v: Views):
    return rounded(v.edges.filter("loop").select("run", "i", "j", F.col("dx").alias("error")), 8)


@query("SNK8_request_documents", """select id, '{"request_id":' || id || ',"meta":[' || cast(cast(id as double) as varchar) || ',' || cast(id * 0.5 as varchar) || '],"meta_layout":["a","b"]}' as document from (select s_suppkey as id from supplier)""".replace("id * 0.5", "cast(id * 0.5 as double)"))
def snk8(v: Views):
    rows = v.supplier.selectExpr("s_suppkey as id", "cast(s_suppkey as double) as a", "s_suppkey * 0.5D as b")
    return sinks.request_document(rows, "id", ["a", "b"])


@query("SNK9_result_documents", "select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, cast(json_extract_string(props, '$.k') as bigint) >= 50 as accepted from events")
def snk9(v: Views):
    rows = v.events.select("event_id", F.from_json("props", "k bigint").alias("j"))
    return rows.select("event_id", "j.k", (F.col("j.k") >= 50).alias("accepted"))


@query("SNK10_stats_documents", """select frame, '{"points":' || count(*) || ',"labels":' || count(distinct label) || ',"dynamic":' || sum(cast(label = 5 as bigint)) || '}' as document from pts group by frame""")
def snk10(v: Views):
    return sinks.status_document(v.pts, ["frame"], {"points": "count(*)", "labels": "count(distinct label)", "dynamic": "count_if(label = 5)"})


@query("SNK11_summary_rows", "select o_orderstatus as status, '| ' || o_orderstatus || ' | ' || printf('%.3f', max(o_orderkey) / 8.0) || ' | - |' as line from orders group by o_orderstatus")
def snk11(v: Views):
    rows = v.orders.groupBy(F.col("o_orderstatus").alias("status")).agg((F.max("o_orderkey") / 8).alias("a")).withColumn("b", F.lit(None).cast("double"))
    return sinks.markdown_row(rows, "status", ["a", "b"])


@query("SNK14_status_document", """select '{"events":' || count(*) || ',"users":' || count(distinct user_id) || ',"clicks":' || count(*) filter (event_type = 'click') || '}' as document from events""")
def snk14(v: Views):
    return sinks.status_document(v.events, [], {"events": "count(*)", "users": "count(distinct user_id)", "clicks": "count_if(event_type = 'click')"})
