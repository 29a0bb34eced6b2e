from collections import defaultdict

import duckdb

from waymark.llm import mixing, queries


def fill(budget, children):
    """children: name -> (weight, capacity); shares by repeated rounds."""
    out, left, open_ = dict.fromkeys(children, 0.0), float(budget), dict(children)
    while open_ and left > 1e-9:
        weights = sum(w for w, _ in open_.values())
        full = {n for n, (w, c) in open_.items() if c - out[n] <= left * w / weights + 1e-12}
        if not full:
            for n, (w, _) in open_.items():
                out[n] += left * w / weights
            break
        for n in full:
            left -= open_[n][1] - out[n]
            out[n] = open_.pop(n)[1]
    return out


def test_budgets(spark):
    tokens = {("a", "en", "s1"): 100, ("a", "en", "s2"): 1000, ("a", "de", "s1"): 50, ("b", "en", "s1"): 10, ("b", "fr", "s9"): 5000, ("c", "en", "s1"): 0, ("b", "fr", "s8"): 700}
    weights = {"domain": {"a": 2.0}, "lang": {"en": 3.0, "fr": 1.0}, "source": {"s2": 5.0, "s8": 0.0}}
    df = spark.createDataFrame([(*k, v) for k, v in tokens.items()], "domain string, lang string, source string, tokens long")
    w = lambda level, n: weights[level].get(n, 1.0)
    for budget in (0, 90, 2000, 4200, 6000, 100000):
        got = {(r.domain, r.lang, r.source): r.budget for r in mixing.leaf_budgets(df, budget, 2, weights).collect()}
        live = {k: 2 * v for k, v in tokens.items() if v and w("source", k[2]) > 0}
        tree = defaultdict(lambda: defaultdict(dict))
        for (d, la, s), c in live.items():
            tree[d][la][s] = c
        want = {}
        top = fill(budget, {d: (w("domain", d), sum(sum(x.values()) for x in tree[d].values())) for d in tree})
        for d in tree:
            mid = fill(top[d], {la: (w("lang", la), sum(tree[d][la].values())) for la in tree[d]})
            for la in tree[d]:
                want |= {(d, la, s): b for s, b in fill(mid[la], {s: (w("source", s), c) for s, c in tree[d][la].items()}).items()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) <= 1 for k in want), (budget, got, want)


def test_edge_rows(spark):
    rows = [(None, "a b", None, None), (1, None, "en", "src1"), (2, "", "en", "src1"), (3, "x " * 30, "en", "src1"), (3, "x " * 30, "en", "src1"), (4, "y " * 10, "de", "other")]
    rows += [(10 + k, "z " * (k % 7), "en", "src0") for k in range(50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, copies int")
    size = mixing.sizes(df, queries.mix_domain())
    for share, epochs in ((0.5, 1), (1.7, 3), (0.0, 1)):
        plan = mixing.mix_plan(size, share, epochs, queries.MIX_WEIGHTS)
        got = mixing.mix_documents(size, plan).collect()
        back = mixing.mixed_rows(df, plan, domain=queries.mix_domain()).collect()
        assert sum(r.copies for r in got) == len(back)
        assert sorted(str(r.doc_id) for r in got for _ in range(r.copies)) == sorted(str(r.doc_id) for r in back)
        assert max((r.copies for r in got), default=0) <= epochs
    assert back == []
    none = mixing.sizes(df.limit(0), queries.mix_domain())
    assert mixing.mix_documents(none, mixing.mix_plan(none, 0.5, 1, {})).count() == 0


def test_a_very_long_text(spark):
    """A text of half a million words is one document: taken whole, as often as its epochs, or left."""
    rows = [(1, "word " * 500_000, "en", "src1"), *[(k, "some words " * 20, "en", "src1") for k in range(2, 60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    size = mixing.sizes(df, queries.mix_domain())
    assert {r.n_tokens for r in size.collect()} == {500_000, 40}
    for share, copies in ((1.0, 1), (2.0, 2)):
        got = {r.doc_id: r.copies for r in mixing.mix_documents(size, mixing.mix_plan(size, share, 2, {})).collect()}
        assert got == {k: copies for k in range(1, 60)}
    some = {r.doc_id for r in mixing.mix_documents(size, mixing.mix_plan(size, 0.5, 1, {})).collect()}
    assert some and some <= set(range(1, 60))


def test_query_equals_sql(spark, sf):
    got = sorted(map(tuple, queries.op7_source_mix(spark, sf).select("doc_id", "domain", "lang", "source", "n_tokens", "copies", "in_prefix").collect()))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(con.sql(queries.ORACLE_SQL["op7_source_mix"]).fetchall())
    assert {r[5] for r in got} == {1, 2}
