"""Queries on streaming semantics: folds of queues and drops in batch form, and streams run to their end."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from waymark.operators import asof, folds, select
from waymark.plans.registry import query
from waymark.plans.views import Views
from waymark.streaming import ordered, queues, release

H = 3_600_000_000
EVENT = "run long, id long, t long, kind string"
KINDS = "select user_id as run, event_id as id, MICROS[ts] as t, event_type as kind from events"


def kinds(v: Views):
    return v.sql(KINDS)


#: Events of four sources as they arrive, each up to six times 20 hours late.
ARRIVALS = "select user_id as run, event_id as id, MICROS[ts] as t, MICROS[ts] + (event_id % 7) * 72000000000 as wall, event_type as source from events"
ARRIVAL = "run long, id long, t long, wall long, source string"
OUT = f"{ARRIVAL}, why string, by long"
#: Latest time of each source after each arrival; then, for each event, the first arrival that lets it go.
MARKS = f"""a as ({ARRIVALS}), n as (select *, row_number() over (partition by run order by wall, id) as n from a),
  m as (select *, max(case source when 'view' then t end) over w as v, max(case source when 'click' then t end) over w as c, max(case source when 'signup' then t end) over w as s, max(case source when 'purchase' then t end) over w as p, lag(wall) over (partition by run order by n) as before
    from n window w as (partition by run order by n rows between unbounded preceding and current row))"""
LET_GO = """, g as (select e.run, e.id, e.t, e.n, min(m.n) as at from m e join m on m.run = e.run and m.n >= e.n and {ready} where e.source in {events} group by e.run, e.id, e.t, e.n),
  x as (select g.*, exists (select 1 from g l where l.run = g.run and l.t > g.t and l.at < g.n) as stale from g)"""


def release_rows(v: Views, how: release.Release):
    """Events of a batch of arrivals as they are let go."""
    return folds.fold(v.sql(ARRIVALS), ["run"], ["wall", "id"], release.releasing(how), OUT)


@query("ST1_ordered_release", f"with {MARKS}" + LET_GO.format(events="('view', 'click')", ready=f"m.v >= e.t + {24 * H} and m.c >= e.t + {24 * H}") + " select x.run, x.id, m.id as by, case when x.stale then 'stale' else 'watermark' end as why from x join m on m.run = x.run and m.n = x.at")
def st1(v: Views):
    """Events of two sources, in order once both have come a day past them: the stream, run to its end."""
    base = f"{select.shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"
    events = ordered.read_files(v.spark, v.sf_dir, v.events, pattern="events.parquet")
    t = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)"
    rows = events.selectExpr("user_id as run", "event_id as id", f"{t} as t", f"{t} + (event_id % 7) * 72000000000 as wall", "event_type as source")
    released = release.release_stream(rows, ["run"], ["wall", "id"], release.Release(("view", "click"), 24 * H), OUT)
    return ordered.run_to_end(released, f"{base}/out", f"{base}/state").select("run", "id", "by", "why")


@query("ST3_side_coverage", f"with {MARKS}" + LET_GO.format(events="('view')", ready=f"m.v >= e.t + {10 * H} and m.s >= e.t + {30 * H} and (m.p >= e.t + {20 * H} or m.v >= e.t + {200 * H})") + f""" select x.run, x.id, m.id as by, case when x.stale then 'stale' when m.p >= x.t + {20 * H} then 'watermark' else 'timeout' end as why from x join m on m.run = x.run and m.n = x.at""")
def st3(v: Views):
    """Events of one source that wait for two side streams, for one of them only so long."""
    how = release.Release(("view",), 10 * H, (("signup", 30 * H), ("purchase", 20 * H)), (("purchase", 200 * H),))
    return release_rows(v, how).select("run", "id", "by", "why")


@query("ST2_idle_flush", f"""with {MARKS}, e as (select * from m where source in ('view', 'click')),
  w as (select e.run, e.id, min(m.n) as at from e join m on m.run = e.run and m.n >= e.n and m.v >= e.t + {24 * H} and m.c >= e.t + {24 * H} group by e.run, e.id), i as (select e.run, e.id, min(m.n) as at from e join m on m.run = e.run and m.n > e.n and m.wall - m.before > {40 * H} group by e.run, e.id),
  g as (select e.run, e.id, e.t, e.n, least(coalesce(w.at, i.at), coalesce(i.at, w.at)) as at, coalesce(i.at <= w.at, i.at is not null) as idle from e left join w using (run, id) left join i using (run, id) where coalesce(w.at, i.at) is not null),
  x as (select g.*, exists (select 1 from g l where l.run = g.run and l.t > g.t and (l.at < g.n or (l.at = g.n and l.idle))) as stale from g)
  select x.run, x.id, m.id as by, case when x.stale then 'stale' when x.idle then 'idle' else 'watermark' end as why from x join m on m.run = x.run and m.n = x.at""")
def st2(v: Views):
    """As ST1, but a silence of 40 hours counts as the end of the input and lets all waiting events go."""
    return release_rows(v, release.Release(("view", "click"), 24 * H, idle=40 * H)).select("run", "id", "by", "why")


@query("ST4_priority_drop")
def st4(v: Views):
    return folds.fold(kinds(v), ["run"], ["t", "id"], queues.bounded_queue("kind", "view", 5, 3), EVENT + ", queued long").select("run", "id", "queued")


@query("ST5_lag_drop", f"""with r as ({KINDS}), l as (select *, coalesce(greatest(0, max(t) over (partition by run order by id % 7, id rows between unbounded preceding and 1 preceding) - t), 0) as lag from r) select id, lag, lag <= case kind when 'view' then {20 * H} else {60 * H} end as kept from l""")
def st5(v: Views):
    rows = queues.lag_budget(kinds(v).withColumn("arrival", F.col("id") % 7), ["run"], ["arrival", "id"], "t", "kind", {"view": 20 * H}, 60 * H)
    return rows.select("id", "lag", "kept")


@query("ST6_stale_drop", f"with r as ({KINDS}) select id from (select id, t, max(t) over (partition by run order by id % 7, id rows between unbounded preceding and 1 preceding) as seen from r) where seen is null or t > seen")
def st6(v: Views):
    from waymark.operators.windows import monotonic

    return monotonic(kinds(v).withColumn("arrival", F.col("id") % 7), ["run"], ["arrival", "id"], "t").select("id")


@query("ST8_admission", f"""with recursive r as ({KINDS}), s as (select *, row_number() over (partition by run order by t, id) as n from r),
  f as (select run, n, id, kind, case when kind = 'view' then 1 else 0 end as pending, cast(0 as bigint) as before, true as admitted from s where n = 1 union all
    select s.run, s.n, s.id, s.kind, case when s.kind = 'click' then greatest(0, f.pending - 1) when s.kind = 'view' and f.pending < 3 then f.pending + 1 else f.pending end, f.pending, f.pending < 3 from f join s on s.run = f.run and s.n = f.n + 1)
  select id, admitted, before as pending from f where kind = 'view'""")
def st8(v: Views):
    """Requests under back-pressure: three may be pending, results take one off."""
    return folds.fold(kinds(v), ["run"], ["t", "id"], queues.back_pressure("kind", "view", "click", 3), EVENT + ", admitted boolean, pending long").select("id", "admitted", "pending")


@query("ST9_state_eviction")
def st9(v: Views):
    rows = kinds(v).withColumn("cell", F.col("id") % 13)
    return folds.fold(rows, ["run"], ["t", "id"], queues.evicting_state("t", "cell", 200 * H, 6), EVENT + ", cell long, evicted long, why string").select("run", "id", "evicted", "why")


@query("ST12_clock_rewind", f"""with recursive r as ({KINDS}), s as (select run, id, t, row_number() over (partition by run order by id % 7, id) as n from r),
  f as (select run, n, id, t as last, false as reset, true as kept from s where n = 1 union all select s.run, s.n, s.id, case when s.t < f.last or s.t - f.last >= {20 * H} then s.t else f.last end, s.t < f.last, s.t < f.last or s.t - f.last >= {20 * H} from f join s on s.run = f.run and s.n = f.n + 1)
  select id, reset from f where kept""")
def st12(v: Views):
    rows = kinds(v).withColumn("arrival", F.col("id") % 7)
    return folds.fold(rows, ["run"], ["arrival", "id"], queues.rewind_gate("t", 20 * H), EVENT + ", arrival long, reset boolean").select("id", "reset")


@query("ST13_pending_requests")
def st13(v: Views):
    return folds.fold(kinds(v), ["run"], ["t", "id"], queues.pending("t", "kind", "click", 40 * H, 3), EVENT + ", outcome string, by long").select("id", "outcome", "by")


@query("JN8_head_pairing")
def jn8(v: Views):
    rows = v.est.select("run", "id", "t", F.lit(0).alias("side")).unionByName(v.gt.select("run", "id", "t", F.lit(1).alias("side")))
    return folds.fold(rows, ["run"], ["t", "side", "id"], queues.pair_heads("t", "side", 8 * H), "run long, id long, t long, side int, partner long, dropped boolean").select("id", "side", "partner", "dropped")


@query("JN9_interval_pairs", f"select e.id, g.id as other from est e join gt g on e.run = g.run and abs(e.t - g.t) <= {4 * H}")
def jn9(v: Views):
    """Two streams over the same files, joined within an interval, run to their end."""
    base = f"{select.shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"
    one = ordered.read_files(v.spark, v.sf_dir, v.events, pattern="events.parquet")
    left, right = (one.filter(F.col("event_type") == kind).select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t")) for kind in ("view", "click"))
    joined = ordered.interval_join(left, right, ["run"], "t", 4 * H, "1 hour").select("id", F.col("r_id").alias("other"))
    return ordered.run_to_end(joined, f"{base}/out", f"{base}/state")


@query("JN10_deferred_match", f"select e.id, min(g.t) as matched from est e left join gt g on e.run = g.run and g.t between e.t and e.t + {6 * H} group by e.id")
def jn10(v: Views):
    rows = asof.around(v.est.select("run", "id", (F.col("t") - 1).alias("t")), v.gt, ["run"], "t", "id", [], "id")
    return rows.select("id", F.when(F.col("after.t") <= F.col("t") + 1 + 6 * H, F.col("after.t")).alias("matched"))


@query("SRC12_stream_source", f"with r as ({KINDS}) select run, id, t from r where kind = 'view'")
def src12(v: Views):
    """One kind of events as a stream of its own, run to its end."""
    base = f"{select.shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"
    events = ordered.read_files(v.spark, v.sf_dir, v.events, pattern="events.parquet").filter("event_type = 'view'")
    rows = events.select(F.col("user_id").alias("run"), F.col("event_id").alias("id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("t"))
    return ordered.run_to_end(rows, f"{base}/out", f"{base}/state")


@query("ST7_bounded_batches", "select o_orderkey as id from orders where o_orderstatus = 'F' union all select l_orderkey from lineitem where false")
def st7(v: Views):
    """A stream that takes one file at a time, run to its end."""
    base = f"{select.shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"
    rows = ordered.read_files(v.spark, v.sf_dir, v.orders, 1, "orders.parquet").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return ordered.run_to_end(rows, f"{base}/out", f"{base}/state")


@query("ST14_session_fence", f"""with r as ({KINDS}), s as (select run, id as session, t from r where kind = 'signup'), q as (select run, id, t, t - {30 * H} as asked from r where kind in ('view', 'click')),
  a as (select q.id, max(s.t) as now_t, max(case when s.t <= asked then s.t end) as then_t from q left join s on s.run = q.run and s.t <= q.t group by q.id) select id from a where now_t is not distinct from then_t""")
def st14(v: Views):
    """Results whose session is still the one in which they were asked for, 30 hours before."""
    sessions = kinds(v).filter("kind = 'signup'").select("run", F.col("id").alias("session"), "t")
    results = kinds(v).filter("kind in ('view', 'click')").select("run", "id", "t")
    return select.fenced(results, sessions, ["run"], "t", "session", "id", 30 * H).select("id")


@query("ST15_periodic_checkpoint", """select run, id, n, round(length, 4) + 0.0 as length from (select run, id, row_number() over w as n, sum(coalesce(sqrt(dx * dx + dy * dy), 0)) over (partition by run order by t, id rows between unbounded preceding and current row) as length
  from (select *, x - lag(x) over (partition by run order by t, id) as dx, y - lag(y) over (partition by run order by t, id) as dy from track) d window w as (partition by run order by t, id)) where n % 8 = 0""")
def st15(v: Views):
    """What is published at every eighth keyframe: the stream, run to its end in its checkpoint."""
    base = f"{select.shared_folder(v.spark)}/stream-{uuid.uuid4().hex}"
    rows = v.track.select("run", "id", "t", "x", "y")
    rows.write.parquet(f"{base}/in")
    end = rows.groupBy("run").agg(F.max("t").alias("t")).select("run", F.lit(-1).cast("long").alias("id"), (F.lit(v.track.agg(F.max("t")).first()[0]) + 10**12).alias("t"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    end.write.mode("append").parquet(f"{base}/in")  # moves the watermark past the last rows
    stream = ordered.read_files(v.spark, f"{base}/in", rows)
    out = ordered.ordered_fold(stream, ["run"], "t", ["t", "id"], queues.published("t", 8), "run long, id long, t long, x double, y double, n long, length double", "1 hour")
    return ordered.run_to_end(out, f"{base}/out", f"{base}/state").filter("id >= 0").select("run", "id", "n", (F.round("length", 4) + 0.0).alias("length"))
