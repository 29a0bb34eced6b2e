import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from waymark.llm import queries, ranked

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return _TERM.findall((text or "").translate(_LOWER))


def brute(docs, items, k=10):
    """Every document scored for every item."""
    counts = [(i, Counter(terms_of(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms_of(t))
    out = []
    for item, words in wanted.items():
        found = []
        for i, c, n in counts:
            m = 100 - 90 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in words if t in c)
            if s > 0:
                found.append((-s, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def _run(spark, docs, items, **more):
    docs = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, rank int")
    return sorted(map(tuple, ranked.top_documents(docs, items, **more).collect()), key=repr)


def _texts(rng, n, most=60):
    words = ["alpha", "Beta", "gamma-ray", "δέλτα", "x1", "É", "the", "of", "and", *[f"w{k}" for k in range(60)]]
    return [" ".join(rng.choice(words[: rng.choice([9, 20, 69])]) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_odd_rows(spark):
    docs = [(None, "the alpha"), (None, None), (1, ""), (2, "!?. --"), (3, "The ALPHA"), (3, "the alpha"), (4, "é É Ünder_score"), (5, "w1 " * 200_000 + "x" * 50_000), (6, "the"), (-1, "the alpha"), (7, "K KK")]
    docs += [(100 + k, "other words") for k in range(30)]
    items = [(1, "alpha the THE"), (None, "É under"), (2, None), (3, ""), (4, "nowhere"), (1, "w1"), (5, "other"), (6, "K k")]
    assert _run(spark, docs, items) == brute(docs, items)


def test_small_ranges_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(ranked, "FAN", 3)
    monkeypatch.setattr(ranked, "RANGE", 27)
    monkeypatch.setattr(ranked, "RANGE_PAIRS", 300)
    monkeypatch.setattr(ranked, "BLOCK_TERMS", 40)  # several blocks of items
    monkeypatch.setattr(ranked, "STEP_BYTES", 50)
    monkeypatch.setattr(ranked, "MERGE_GROUPS", 2)
    rng = random.Random(1)
    texts = _texts(rng, 400)
    docs = [(rng.randrange(600), t) for t in texts] + [(1000 - k, "the alpha of w1 w2") for k in range(200)]
    items = [(k, t) for k, t in enumerate(_texts(rng, 25))]
    assert _run(spark, docs, items) == brute(docs, items)
    assert _run(spark, docs, items, k=3) == brute(docs, items, k=3)


def test_bounds_leave_documents_closed():
    """One range: the best are those of all documents, and most documents are never scored for a rare passage."""
    rng = random.Random(2)
    rows = [[rng.randrange(1500) for _ in range(rng.randint(5, 80))] for _ in range(ranked.RANGE)]
    item = np.arange(1500, 1512)
    for k in range(10):
        rows[k * 7] = rows[k * 7] + [1500 + j for j in range(12) if j != k]
    counts = [Counter(r) for r in rows]
    df = np.bincount([t for c in counts for t in c], minlength=1512)
    stats = ranked.Stats(len(rows), sum(map(len, rows)), df)
    arrays = [np.array(x, np.int64) for x in (range(len(rows)), [len(r) for r in rows], [len(c) for c in counts], [t for c in counts for t in c], [v for c in counts for v in c.values()])]
    query = np.sort(np.concatenate([item, [1, 2, 3]]))
    tree, best = ranked.RangeTree(stats, *arrays), ranked.Best(10)
    tree.search(query, best)
    parts = np.zeros(len(rows), np.int64)
    doc = np.repeat(np.arange(len(rows)), arrays[2])
    np.add.at(parts, doc, np.where(np.isin(arrays[3], query), stats.parts(arrays[1][doc], arrays[3], arrays[4]), 0))
    want = sorted(((-int(s), i) for i, s in enumerate(parts)))[:10]
    assert sorted((-s, -d) for s, d in best.kept) == want
    assert tree.scored < len(rows) // 4


def test_equal_bounds_are_opened():
    """Documents of one text score alike: the smallest ids win, wherever they lie."""
    n = ranked.RANGE
    ids = np.random.default_rng(3).permutation(n)
    stats = ranked.Stats(n, 2 * n, np.array([n // 2, 3]))
    tree, best = ranked.RangeTree(stats, ids, np.full(n, 2), np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64)), ranked.Best(5)
    tree.search(np.array([0, 1]), best)
    assert sorted(-d for _, d in best.kept) == [0, 1, 2, 3, 4]


def test_empty(spark):
    assert _run(spark, [], [(1, "a")]) == []
    assert _run(spark, [(1, "a")], []) == []
    assert _run(spark, [(1, None)], [(1, "a")]) == []


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_against_brute_force_and_sql(spark, folder):
    sf = f"/root/testdata/{folder}"
    got = sorted(map(tuple, queries.op11_ranked_search(spark, sf).select("item_id", "rank", "doc_id", "score").collect()), key=repr)
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert got == brute(docs, items)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    assert got == sorted(con.sql(queries.ORACLE_SQL["op11_ranked_search"]).fetchall(), key=repr)
