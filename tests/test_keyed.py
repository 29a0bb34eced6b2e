"""Keyed state in a state store against the batch fold."""

import random

from waymark.operators import folds
from waymark.streaming import keyed, ordered, queues


def test_evictions_of_stream_and_batch(spark, tmp_path):
    rng = random.Random(1)
    rows, t = [], 0
    for k in range(600):
        t += rng.choice([1, 1, 5, 60])
        rows.append((rng.randrange(3), k, t, rng.randrange(40)))
    df = spark.createDataFrame(rows, "run long, id long, t long, e long")
    schema = "run long, id long, t long, e long, evicted long, why string"
    want = sorted(map(tuple, folds.fold(df, ["run"], ["t", "id"], queues.evicting_state("t", "e", 300, 10), schema).collect()))
    for k in range(4):
        spark.createDataFrame(rows[k * 150 : (k + 1) * 150], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ordered.read_files(spark, f"{tmp_path}/in", df, 1)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        got = ordered.run_to_end(keyed.evicting_stream(stream, ["run"], "t", "e", ["t", "id"], 300, 10, schema), f"{tmp_path}/out", f"{tmp_path}/state")
        assert sorted(map(tuple, got.collect())) == want
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert {r[5] for r in want} == {"ttl", "size"} and len(want) > 50


def _in_files(spark, rows, schema, path, parts=4):
    for k in range(parts):
        part = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


def test_queues_of_stream_and_batch(spark, tmp_path):
    """Drops of a bounded queue and outcomes of pending requests: lists of waiting rows in the store."""
    rng = random.Random(2)
    rows, t = [], 0
    for k in range(500):
        t += rng.choice([1, 2, 30])
        rows.append((rng.randrange(3), k, t, rng.choice(["image", "scan", "key", "ask", "ask"])))
    rows_schema = "run long, id long, t long, kind string"
    df = spark.createDataFrame(rows, rows_schema)
    _in_files(spark, rows, rows_schema, f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for name, start, counted, more in (("queue", queues.bounded_queue("kind", "image", 6, 3), True, "queued long"), ("pending", queues.pending("t", "kind", "ask", 40, 5), False, "outcome string, by long")):
            schema = f"{rows_schema}, {more}"
            want = sorted(map(str, folds.fold(df, ["run"], ["t", "id"], start, schema).collect()))
            stream = ordered.read_files(spark, f"{tmp_path}/in", df, 1)
            got = ordered.run_to_end(keyed.queue_stream(stream, ["run"], ["t", "id"], start, schema, counted), f"{tmp_path}/out-{name}", f"{tmp_path}/state-{name}")
            assert sorted(map(str, got.collect())) == want and len(want) > 50
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
