import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from waymark.llm import merkle, queries


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def _levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([_h(out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def _siblings(levels, k):
    out = []
    for level in levels[:-1]:
        start = k - k % 3
        out.append((level[start:k], level[k + 1 : start + 3]))
        k //= 3
    return out


def brute(rows):
    """rows of (doc_id, source, lang, n_chars, text), by plain loops."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, _leaf(r)))
    trees = [_levels([_leaf(r) for r in groups[s]]) for s in names]
    top = _levels([t[-1][0] for t in trees])
    out = []
    for g, s in enumerate(names):
        for k, r in enumerate(groups[s]):
            way = _siblings(trees[g], k) + _siblings(top, g)
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            value = _leaf((*r[:4], r[4].replace("\n", ""))) if bad else _leaf(r)
            for left, right in way:
                value = _h([*left, value, *right])
            out.append((r[0], _leaf(r), trees[g][-1][0], top[-1][0], _h([x for a, b in way for x in (*a, *b)]), value, value == top[-1][0]))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def _run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("hash", F.lit("x")).withColumn("grp", F.lit(1))
    return sorted((tuple(r) for r in merkle.verify_documents(df).select(*COLUMNS).collect()), key=repr)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, "", "en", 0, ""), (5, None, "de", 3, "a\nb"), (5, None, "de", 3, "a\nb"), (5, None, "de", 4, "b"), (-(2**63), None, None, 1, "\n"), (2**63 - 1, "b", None, 1, "\n\n"), (-1, "b", "-", -1, "é\n漢"), (0, "ä", "x", 9, "long\n" * 50_000)]
    rows += [(k, "b", "en", 1, f"{k}\n") for k in range(-9, 30)] + [(7, s, "en", 1, "t") for s in ("B", "a", "ab", "\U0001f600", "～", "0", "1")]
    assert _run(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28])
def test_sizes_of_one_group(spark, n):
    rows = [(k * 3, "s", "en", 1, f"{k}\nx") for k in range(n)]
    assert _run(spark, rows) == brute(rows)


def test_rounds_hot_ids_and_copies(spark, monkeypatch):
    """Small blocks, prefixes that are full and grow, an id with many texts, and rows that are repeated many times."""
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "FULL", 5)
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3, 70_000, -5, 2**40 + rng.randrange(9)]), rng.choice(["hot", "hot", None, "x"]), "en", rng.randrange(3), f"t{rng.randrange(40)}\n") for _ in range(400)]
    rows += [(4, "hot", "en", 1, "same\n")] * 150 + [(9, "hot", "en", 1, f"text {k}") for k in range(150)]
    rows += [(k, f"https://a-long-common-beginning.example/{k:03d}", "en", 1, "x\n") for k in range(120)]
    assert _run(spark, rows) == brute(rows)


def test_ranks_without_a_sort(spark):
    rng = random.Random(6)
    ids = sorted(rng.sample(range(-(2**40), 2**40), 3000)) + list(range(2**41, 2**41 + 3000))
    rows = spark.createDataFrame([(i, rng.choice("aab"), "x", 1, "") for i in ids], SCHEMA).repartition(7)
    ranked = merkle.radix_ranks(merkle.stored(merkle.document_leaves(rows), "test"))
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    for g in ("1a", "1b"):
        got = sorted((r.rank, r.doc_id, r.n) for r in ranked.filter(F.col("grp") == g).collect())
        assert [r[0] for r in got] == list(range(len(got))) and [r[1] for r in got] == sorted(r[1] for r in got)
        assert {r[2] for r in got} == {len(got)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.verify_documents(df).collect() == []


def test_query_against_brute_force_and_sql(spark, sf):
    got = sorted((tuple(r) for r in queries.op12_merkle_manifest(spark, sf).select(*COLUMNS).collect()), key=repr)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == brute(rows)
    assert {r[6] for r in got} == {True, False}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(queries.ORACLE_SQL["op12_merkle_manifest"]).project(", ".join(COLUMNS)).fetchall()
    assert got == sorted(want, key=repr)
