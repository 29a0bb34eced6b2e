import random
import time
import uuid

from pyspark.sql import functions as F

from waymark.operators import folds, select
from waymark.plans.views import Views
from waymark.streaming import ordered, queues, release


def test_stream_equals_batch(spark, sf, tmp_path):
    track = Views(spark, sf).track.select("run", "id", "t", "v").filter("run < 6")
    rows = track.orderBy("t").collect()
    last = rows[-1].t
    for k in range(4):  # four files, each shuffled inside
        part = rows[k * len(rows) // 4 : (k + 1) * len(rows) // 4]
        spark.createDataFrame(part, track.schema).orderBy(F.xxhash64("id")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.createDataFrame([(r, -1, last + 10**12, 0.0) for r in range(6)], track.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ordered.read_files(spark, f"{tmp_path}/in", track, 1)
    schema = "run long, id long, t long, v double, m double, n long"
    step = folds.running_mean("v", 20, "m")
    got = ordered.run_to_end(ordered.ordered_fold(stream, ["run"], "t", ["t", "id"], step, schema, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = {(r.run, r.id): (round(r.m, 9), r.n) for r in got.filter("id >= 0").collect()}
    want = {(r.run, r.id): (round(r.m, 9), r.n) for r in folds.fold(track, ["run"], ["t", "id"], step, schema).collect()}
    assert got == want


def test_outer_interval_join(spark, tmp_path):
    a = spark.createDataFrame([(1, k, 10**15 + k * 10_000_000) for k in range(20)] + [(1, 99, 2 * 10**15)], "run long, id long, t long")
    b = spark.createDataFrame([(1, k, 10**15 + k * 10_000_000 + 1_000_000) for k in range(0, 20, 2)] + [(1, 99, 2 * 10**15)], "run long, id long, t long")
    a.write.parquet(f"{tmp_path}/a")
    b.write.parquet(f"{tmp_path}/b")
    joined = ordered.interval_join(ordered.read_files(spark, f"{tmp_path}/a", a), ordered.read_files(spark, f"{tmp_path}/b", b), ["run"], "t", 2_000_000, "1 second", "leftOuter")
    got = ordered.run_to_end(joined.select("id", "r_id"), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.id, r.r_id) for r in got.collect() if r.id != 99) == [(k, k if k % 2 == 0 else None) for k in range(20)]


def test_numbering_without_keys(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("a"), F.lit(uuid.uuid4().hex).alias("b"))
    got = select.numbered(df, [], ["a"]).collect()
    assert sorted((r.rn, r.a) for r in got) == [(k, k) for k in range(1000)]


HOW = release.Release(("a", "b"), 10_000_000, (("side", 30_000_000),), (("side", 20_000_000),))
SCHEMA = "run long, id long, t long, arrival long, source string, why string, by long"


def arrivals(seed=3, n=240):
    """Rows of three sources, some late, of two runs."""
    rng = random.Random(seed)
    rows = [(k % 2, k, 10**15 + 1_000_000 * k + rng.choice([0, 0, 0, -20_000_000, -40_000_000]), rng.choice(["a", "a", "b", "side", "other"])) for k in range(n)]
    return [(run, k, t, k, source) for run, k, t, source in rows]


def brute_release(rows):
    """Releases in plain loops: after each arrival, heads go while both event sources and the side stream are far enough."""
    out = []
    for run in (0, 1):
        latest, waiting, last = {}, [], None
        for r in [x for x in rows if x[0] == run]:
            _, ident, t, _, source = r
            latest[source] = max(t, latest.get(source, t))
            if source in ("a", "b"):
                waiting.append(r)
            waiting.sort(key=lambda x: (x[2], x[1]))
            while waiting and "a" in latest and "b" in latest:
                head, mark = waiting[0], min(latest["a"], latest["b"])
                side = latest.get("side", 0) >= head[2] + 30_000_000
                if mark < head[2] + 10_000_000 or not (side or mark >= head[2] + 20_000_000):
                    break
                waiting.pop(0)
                stale = last is not None and head[2] < last
                last = last if stale else head[2]
                out.append((run, head[1], "stale" if stale else "watermark" if side else "timeout", ident))
    return sorted(out)


def test_release_over_several_sources(spark, tmp_path):
    """Batch fold and stream, in several micro-batches, equal plain loops."""
    rows = arrivals()
    df = spark.createDataFrame(rows, "run long, id long, t long, arrival long, source string")
    got = folds.fold(df, ["run"], ["arrival"], release.releasing(HOW, wall=None), SCHEMA)
    want = brute_release(rows)
    assert sorted((r.run, r.id, r.why, r.by) for r in got.collect()) == want and {w[2] for w in want} == {"watermark", "stale", "timeout"}
    for k in range(6):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], df.schema).coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
        time.sleep(0.02)  # files count by their time
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(*[f"{tmp_path}/in/*"])
    out = ordered.run_to_end(release.release_stream(stream, ["run"], ["arrival"], HOW, SCHEMA), f"{tmp_path}/out", f"{tmp_path}/state")
    assert sorted((r.run, r.id, r.why, r.by) for r in out.collect()) == want


def test_silence_lets_waiting_events_go(spark, tmp_path):
    """No row comes any more: the timer lets go what the watermark hasn't passed."""
    rows = [(0, k, 10**15 + k, k, "a") for k in range(5)]
    df = spark.createDataFrame(rows, "run long, id long, t long, arrival long, source string")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = ordered.read_files(spark, f"{tmp_path}/in", df)
    how = release.Release(("a", "b"), 10_000_000, idle=300_000)
    q = release.release_stream(stream, ["run"], ["arrival"], how, SCHEMA).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + 40
        while time.time() < end and spark.table("idle").count() < 5:
            time.sleep(0.5)
        assert sorted((r.id, r.why, r.by) for r in spark.table("idle").collect()) == [(k, "idle", None) for k in range(5)]
    finally:
        q.stop()


def test_a_tick_takes_one_file(spark, tmp_path):
    df = spark.createDataFrame([(k,) for k in range(40)], "id long")
    for k in range(4):
        df.filter(f"id % 4 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ordered.read_files(spark, f"{tmp_path}/in", df, 1)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]] == [10] * 4


def test_late_rows_as_step_and_window(spark):
    rows = [(0, k, (k * 37) % 50, "x" if k % 3 else "y") for k in range(60)]
    df = spark.createDataFrame(rows, "run long, arrival long, t long, kind string")
    step = folds.fold(df, ["run"], ["arrival"], queues.late_drop("t", "kind", {"x": 10}, 25), "run long, arrival long, t long, kind string, lag long, kept boolean")
    assert sorted(map(tuple, step.collect())) == sorted(map(tuple, queues.lag_budget(df, ["run"], ["arrival"], "t", "kind", {"x": 10}, 25).select(step.columns).collect()))
