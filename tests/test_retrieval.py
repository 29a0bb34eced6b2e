"""Retrieval by votes and one-to-one matches against plain loops."""

import random

from pyspark.sql import functions as F

from waymark.operators import retrieval, select


def code(word, table):
    return sum((word[d // 8] >> (d % 8) & 1) << b for b in range(17) for d in [(17 + 37 * table + 11 * b) % 256])


def loops(rows, min_index, min_time, min_votes, min_tables, most):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and len(r[2]) == 32]
    kept = {(k, t, table, code(w, table)) for k, t, w in rows for table in range(6)}
    out = []
    for k, t in sorted({(k, t) for k, t, _ in rows}):
        votes = {}
        for kk, _, w in rows:
            for table in range(6) if kk == k else ():
                for c, tc, tb, co in kept:
                    if tb == table and co == code(w, table) and k - c >= min_index and t - tc >= min_time:
                        votes.setdefault(c, []).append(table)
        found = sorted((-len(v), -len(set(v)), c) for c, v in votes.items() if len(v) >= min_votes and len(set(v)) >= min_tables)
        out += [(k, c, -n, -m, rank) for rank, (n, m, c) in enumerate(found[:most], 1)]
    return sorted(out)


def scene(rng, n, features=5, flips=6):
    """Keyframes that see the places of earlier ones again, some bits changed."""
    places = [[bytes(rng.randrange(256) for _ in range(32)) for _ in range(features)] for _ in range(n // 3)]
    rows = []
    for k in range(n):
        for w in places[k % len(places)]:
            w = bytearray(w)
            for d in rng.sample(range(256), rng.randint(0, flips)):
                w[d // 8] ^= 1 << (d % 8)
            rows.append((k, k * 10, bytes(w)))
    return rows


def test_votes_equal_plain_loops(spark, tmp_path):
    rng = random.Random(1)
    rows = scene(rng, 18)
    rows += [(17, 170, bytes(32))] * 3 + [(3, 30, bytes(32)), (4, 40, bytes(32)), (5, 50, None), (5, 50, b"short"), (None, 0, bytes(32))]
    df = spark.createDataFrame(rows, "keyframe long, t long, descriptor binary")
    limits = dict(min_index=3, min_time=40, min_votes=2, min_tables=2, most=4)
    whole = retrieval.KeyframeIndex(spark, "whole_index", f"file://{tmp_path}/whole", 8).append(df)
    got = sorted(map(tuple, whole.candidates(df, **limits).collect()))
    assert got == loops(rows, **limits) and len(got) > 15
    parts = retrieval.KeyframeIndex(spark, "parts_index", f"file://{tmp_path}/parts", 8)
    for lo, hi in ((0, 5), (5, 12), (12, 99)):
        parts.append(df.filter((F.col("keyframe") >= lo) & (F.col("keyframe") < hi)))
    assert sorted(map(tuple, parts.table().collect())) == sorted(map(tuple, whole.table().collect()))
    assert sorted(map(tuple, parts.candidates(df, **limits).collect())) == got
    assert parts.candidates(df.limit(0), **limits).collect() == []


def test_recall_against_brute_force(spark, tmp_path):
    """Of the earlier keyframes that see a place again, with up to six bits of 256 changed in every feature, nine tenths at least are found (some 99 in a hundred here)."""
    rows = scene(random.Random(2), 90, features=8)
    df = spark.createDataFrame(rows, "keyframe long, t long, descriptor binary")
    index = retrieval.KeyframeIndex(spark, "recall_index", f"file://{tmp_path}/recall", 8).append(df)
    got = {(r.keyframe, r.candidate) for r in index.candidates(df, 1, 1, 4, 2, 5).collect()}
    want = {(k, c) for k in range(90) for c in range(k) if k % 30 == c % 30}
    assert len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.02 * len(got)


def test_descriptors_and_distances(spark):
    rng = random.Random(3)
    words = [bytes(rng.randrange(256) for _ in range(32)) for _ in range(20)]
    bits = [[bool(w[d // 8] >> (d % 8) & 1) for d in range(256)] for w in words]
    df = spark.createDataFrame(list(zip(words, bits, words[1:] + words[:1], strict=True)), "w binary, bits array<boolean>, v binary")
    got = df.select(retrieval.descriptor_of([F.col("bits")[d] for d in range(256)]).alias("made"), "w", "v", retrieval.descriptor_distance(F.col("w"), F.col("v")).alias("d"), retrieval.codes_of(F.array(*retrieval._words(F.col("w")))).alias("c")).collect()
    for r in got:
        assert r.made == r.w
        assert r.d == sum((a ^ b).bit_count() for a, b in zip(r.w, r.v, strict=True))
        assert [(c.tbl, c.code) for c in r.c] == [(t, code(r.w, t)) for t in range(6)]


def walk(pairs):
    out, used = [], set()
    for g, d, a, b in sorted({(g, d, a, b) for g, a, b, d in pairs if None not in (a, b, d)}, key=lambda p: (p[0] is not None, p)):
        if (g, 0, a) not in used and (g, 1, b) not in used:
            used |= {(g, 0, a), (g, 1, b)}
            out.append((g, a, b, d))
    return sorted(out, key=repr)


def test_rounds_equal_the_walk(spark):
    rng = random.Random(4)
    pairs = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(25), rng.randrange(25), rng.randrange(6)) for _ in range(400)]  # many ties and repeats
    pairs += [(9, k, k, 2 * k) for k in range(12)] + [(9, k + 1, k, 2 * k + 1) for k in range(12)]  # a chain
    pairs += [(1, None, 3, 0), (1, 3, None, 0), (1, 30, 30, None), (7, 1, 1, 1)]
    df = spark.createDataFrame(pairs, "g long, a long, b long, d long")
    got = sorted(map(tuple, retrieval.greedy_matching(df, ["g"], "a", "b", ["d"]).collect()), key=repr)
    assert got == walk(pairs)
    assert retrieval.greedy_matching(df.limit(0), ["g"], "a", "b", ["d"]).collect() == []


def test_candidates_of_unlike_descriptors(spark):
    from waymark.operators import near

    rows = [(1, 0, 0, 0.0, 0.0, 0.0, [1.0, 0.0]), (1, 1, 100, 1.0, 0.0, 6.2, [2.0, 0.1]), (1, 2, 200, 1.0, 1.0, 3.0, [1.0, 0.0]), (1, 3, 300, 0.5, 0.0, 0.1, [0.0, 0.0]), (1, 4, 400, 0.0, 0.5, -0.1, [1.0]), (1, 5, 500, 0.2, 0.2, 0.0, [1.0, 0.2])]
    df = spark.createDataFrame(rows, "run long, id long, t long, x double, y double, yaw double, d array<double>")
    got = near.gated_candidates(df, ["run"], "id", "t", 5.0, 50, 1, "yaw", 0.5, "d", 0.9, 5)
    assert sorted((r.later, r.earlier, r["rank"]) for r in got.collect()) == [(1, 0, 1), (5, 0, 2), (5, 1, 1)]
    assert select.shared_folder(spark)
