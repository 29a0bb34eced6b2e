import random
import re

import duckdb

from waymark.llm import dedup, queries


def shingles(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, percent=85, words=3):
    sets = [(i, shingles(t, words)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    index = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    for k, (i, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in index[x]:
                if j < k:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                top[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_sets():
    texts = ["", None, "a", "a b", "A  b\tc\x0bd", "a b c d", "É é\x85x", "a b c a b c a b c", "x y z " * 500]
    for t, s in zip(texts, dedup.shingle_sets(texts), strict=True):
        assert len(s) == len(shingles(t))
    a, b = dedup.shingle_sets(["A b C d", "a B c D"])
    assert (a == b).all()


def test_parts_of_long_texts(monkeypatch):
    texts = ["a b c d " * 3 + "x" * 50 + " e f  g", "one two", "z" * 90]
    want = [s.tolist() for s in dedup.shingle_sets(texts)]
    monkeypatch.setattr(dedup, "PART_BYTES", 10)
    assert [s.tolist() for s in dedup.shingle_sets(texts)] == want


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"n{rng.random()}"
        out.append(" ".join(w))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([6, 40, 150]))]
        texts += variants(rng, base, rng.choice([1, 3, 25]), rng.choice([0, 1, 2, 4]))
    # a chain of links without a center, and many pairs near the threshold
    chain = [f"c{k}" for k in range(120)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 20, 4)]
    texts += variants(rng, [f"q{k}" for k in range(120)], 60, 3)
    texts += ["same text here"] * 40 + ["", "  ", "one", "one", "one two", "ONE TWO"]
    rng.shuffle(texts)
    rows = [(7 * k - 50, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(df, 85, 3).collect())
    assert got == brute(rows)
    kept = dedup.keep_one_of_each(df, 85, 3).collect()
    assert sorted(r.doc_id for r in kept) == [g[0] for g in got if g[3]] and kept[0].kept == 1


def test_blocks_find_what_hubs_miss(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 8)
    rng = random.Random(9)
    rows = list(enumerate(variants(rng, [f"q{k}" for k in range(200)], 50, 4)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    members = df.selectExpr("1L as key", "doc_id as node", "doc_id as label")
    labels = {r.node: r.label for r in dedup.components(dedup.verify_blocks(df, members, 85, 3)).collect()}
    assert [labels.get(i, i) for i, _ in rows] == [b[2] for b in brute(rows)]


def test_edge_rows(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (None, "lonely text of its own"), (6, None), (6, None), (3, ""), (9, "a b c d"), (9, "a b c d")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, key string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in dedup.near_duplicates(df, 85, 3).collect()), key=str)
    want = [(None, 2, 5, False), (None, 3, None, True), (3, 0, 3, True), (5, 2, 5, True), (6, 0, 6, True), (6, 0, 6, True), (9, 2, 5, False), (9, 2, 5, False)]
    assert got == sorted(want, key=str)
    assert dedup.near_duplicates(df.limit(0)).count() == 0
    # one document of each group: the copy of 5 without an id goes too
    assert sorted(str(r.doc_id) for r in dedup.keep_one_of_each(df, 85, 3).collect()) == ["3", "5", "6", "None"]


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in queries.op1_minhash_dedup(spark, sf).collect())
    assert got == brute(rows)


def test_one_id_with_several_texts(spark):
    """No unlike text goes with a copy under its id; clashing column names don't matter."""
    t, u = " ".join(f"t{k}" for k in range(40)), " ".join(f"u{k}" for k in range(40))
    rows = [(3, t), (7, u), (7, t), (8, u + " x"), (9, t), (9, u), (None, t), (None, "only without an id"), (None, "only without an id"), (5, "v " * 9), (5, "w x y z"), (5, "w x y z"), (4, None), (4, "")]
    names = ["gone", "key_id", "own0", "node"]
    df = spark.createDataFrame([(*r, k, "x", None, k) for k, r in enumerate(rows)], "doc_id long, text string, gone long, key_id string, own0 string, node long")
    kept = dedup.keep_one_of_each(df, 85, 3)
    assert kept.columns == df.columns and set(names) <= set(kept.columns)
    assert sorted(((r.doc_id, r.text, r.gone) for r in kept.collect()), key=lambda r: r[2]) == [(*rows[k], k) for k in (0, 1, 7, 9, 10, 13)]
    found = sorted((r.doc_id, r.n_shingles, r.component_id) for r in dedup.near_duplicates(df, 85, 3).collect() if r.doc_id is not None)
    assert [x for x in found if x[0] in (7, 8, 9)] == [(7, 38, 3), (7, 38, 7), (8, 39, 7), (9, 38, 3), (9, 38, 7)]


def test_hot_keys_change_nothing(spark, monkeypatch):
    """With a few rows counted as hot, all joins take the way of hot keys; results are the same."""
    monkeypatch.setattr(dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(dedup, "HUB_SHARE", 4)
    monkeypatch.setattr(dedup, "BLOCK", 8)
    rng = random.Random(12)
    texts = variants(rng, [f"q{k}" for k in range(120)], 40, 3) + variants(rng, [f"r{k}" for k in range(200)], 20, 1) + ["a b c d e f"] * 30 + ["lone text number one", ""]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, dedup.near_duplicates(df, 85, 3).collect())) == brute(rows)
    monkeypatch.setattr(dedup, "MAX_BROADCAST_BYTES", 0)
    assert sorted(map(tuple, dedup.near_duplicates(df, 85, 3).collect())) == brute(rows)
    assert sorted(r.doc_id for r in dedup.keep_one_of_each(df, 85, 3).collect()) == [r[0] for r in brute(rows) if r[3]]


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op1_minhash_dedup"])
    got = queries.op1_minhash_dedup(spark, sf)
    assert rel.columns == got.columns and sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
