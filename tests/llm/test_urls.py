import random
import re

import duckdb

from waymark.llm import queries, urls


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.DOTALL)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def written(host, path):
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(rows, mined):
    out = []
    for i, url, tokens in rows:
        host, path = parts(url)
        rule, verdict = written(host, path)
        hit = [c for t, c, _ in mined.rules if t <= set(tokens)]
        out.append((i, host, path, rule, verdict or ("block" if hit else "allow"), max(hit, default=None)))
    return sorted(out, key=str)


def run(spark, pages, mined):
    rows = [(r.page_id, r.url, r.t) for r in pages.select("page_id", "url", urls.url_tokens(pages.url).alias("t")).collect()]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.confidence) for r in urls.judge(pages, mined).collect()), key=str)
    assert got == brute(rows, mined)
    return got


def test_edge_rows(spark):
    some = [None, "", "no scheme", "://", "http://", "HTTP://A.Example.COM/en/7x?y#z", "http://com/en/", "https://b.example.net/de/8?q=1", "https://net/de/8", "http://xorg/es/1", "http://x.org/es/1#f", "http://É.org/ES/", "a://b://c/d", "http://user@h.com:80/en/\n1"]
    pages = spark.createDataFrame([(k, u, "x") for k, u in enumerate(some)] + [(None, some[5], None), (5, some[5], "x")], "page_id long, url string, host string")
    got = run(spark, pages, urls.MinedRules())
    by = {r[0]: r for r in got}
    assert by[5][1:5] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by[6][3:5] == ("com/en/", "block") and by[7][3:5] == ("example.net/de/8", "block") and by[9][3:5] == (None, "allow")
    assert urls.judge(pages.limit(0), urls.MinedRules()).count() == 0


def test_mining(spark):
    pages = spark.createDataFrame([(k, f"http://{'cheap-pills' if k % 3 == 0 else 'fine'}.example.fr/a/{k}{'?buy=1' if k % 2 else ''}", None) for k in range(300)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(240)] + [(0, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    mined = urls.mine(pages, labels)
    assert frozenset({"host:pills"}) in {t for t, _, _ in mined.rules}
    assert all(c >= urls.MIN_CONFIDENCE for _, c, _ in mined.rules)
    got = run(spark, pages, mined)
    assert {r[0] for r in got if r[4] == "block"} == set(range(0, 300, 3))
    assert urls.mine(pages.limit(0), labels).rules == [] and urls.mine(pages, labels.limit(0)).rules == []


def test_query(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    mined = urls.mine(pages, spark.read.parquet(f"{sf}/labels.parquet"))
    want = run(spark, pages, mined)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.confidence) for r in queries.op9_url_rules(spark, sf).collect()), key=str)
    assert got == want


def test_mining_uses_all_tokens(spark):
    """Query keys behind 20 path segments are mined, on their own and together, with support and confidence over whole URLs."""
    deep = "/".join(f"s{chr(97 + k)}" for k in range(20))
    url = lambda k: f"http://www.example.fr/{deep}/x?{'&'.join(n + '=1' for n, d in (('buy', 2), ('now', 2), ('pills', 3), ('lang', 5)) if k % d == 0)}"
    pages = spark.createDataFrame([(k, url(k), None) for k in range(300)], "page_id long, url string, html string")
    labels = spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(240)], "doc_id long, quality int, toxic int")
    mined = urls.mine(pages, labels)
    by = {t: (c, round(s, 6)) for t, c, s in mined.rules}
    assert by == {frozenset({"key:buy", "key:pills"}): (1.0, round(1 / 6, 6)), frozenset({"key:now", "key:pills"}): (1.0, round(1 / 6, 6))}
    got = run(spark, pages, mined)
    assert {r[0] for r in got if r[4] == "block"} == set(range(0, 300, 6))


def by_sql(pages, labels):
    """What DuckDB finds with the query's SQL, which enumerates frequent combinations."""
    con = duckdb.connect()
    con.register("p", pages.toPandas())
    con.register("l", labels.toPandas())
    con.sql("create view pages as select * from p")
    con.sql("create view labels as select doc_id, cast(quality as int) as quality, cast(toxic as int) as toxic from l")
    rel = con.sql(queries.ORACLE_SQL["op9_url_rules"])
    return rel.columns, sorted(rel.fetchall(), key=str)


def test_mining_equals_enumeration(spark):
    """Labels that depend on the URLs: rules of one to four tokens, ties, twins, repeated pages, null and long URLs."""
    rng = random.Random(5)
    words = ["buy", "now", "pills", "free", "news", "shop"]

    def url(k):
        own = [w for w in words if rng.random() < 0.5]
        bad = {"buy", "now", "pills"} <= set(own) or ("free" in own and rng.random() < 0.9) or rng.random() < 0.03
        return f"http://{'-'.join(['w', *own])}.example.{rng.choice(['com', 'org'])}/a/{'/'.join(rng.sample(own, len(own)))}/{k}?{'&'.join(w + '=1' for w in own[:2])}", bad

    made = [url(k) for k in range(400)]
    rows = [(k, u) for k, (u, _) in enumerate(made)] + [(3, made[3][0]), (900, None), (901, "x"), (902, "http://long.example.com/" + "/".join(f"s{k}" for k in range(3000)) + "?buy=1&now=2"), (None, made[5][0])]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows], "page_id long, url string, tokens string")
    labels = spark.createDataFrame([(k, int(not b), 0) for k, (_, b) in enumerate(made[:320])] + [(900, 0, 0), (901, 0, 1), (902, 1, 0), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    mined = urls.mine(pages, labels)
    assert {len(t) for t, _, _ in mined.rules} >= {1, 2, 3} and len(mined.rules) > 20
    got = urls.judge(pages, mined)
    columns, want = by_sql(pages.select("page_id", "url"), labels)
    assert got.columns == columns
    rounded_ = lambda rows: sorted(((*r[:6], None if r[6] is None or r[6] != r[6] else round(r[6], 12)) for r in rows), key=str)
    assert rounded_(map(tuple, got.collect())) == rounded_(tuple(int(x) if k == 0 and x == x and x is not None else None if x != x else x for k, x in enumerate(r)) for r in want)
    assert 100 < sum(r.verdict == "block" for r in got.collect()) < 300


def test_many_rules_change_nothing(spark, monkeypatch):
    """More rules than may be sent to executors: the same rules, joined as a table, give the same verdicts."""
    rng = random.Random(8)
    url = lambda k: f"http://www.example.fr/{'wide' if k < 200 else 'w' + chr(97 + k % 10)}/{k}?{'&'.join(rng.sample(['a', 'b', 'c'], 2))}"
    rows = [(k, url(k)) for k in range(400)]
    pages = spark.createDataFrame([*rows, (5, rows[5][1]), (None, None), (600, "x"), (601, "http://")], "page_id long, url string")
    labels = spark.createDataFrame([(k, 1, 1) for k in range(200)] + [(k, 1, int(k % 10 < 8)) for k in range(200, 400)], "doc_id long, quality int, toxic int")
    mined = urls.mine(pages, labels)
    few = urls.judge(pages, mined)
    assert len(mined.rules) >= mined.n > 9 and frozenset({"path:wide"}) in {t for t, _, _ in mined.rules}
    monkeypatch.setattr(urls, "MAX_BROADCAST_RULES", mined.n - 1)
    again = urls.mine(pages, labels)
    assert again.rules == mined.rules
    many = urls.judge(pages, again)
    assert many.columns == few.columns
    assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, few.collect()), key=str)


def test_query_equals_sql(spark, sf):
    pages, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("pages", "labels"))
    con = duckdb.connect()
    for n in ("pages", "labels"):
        con.sql(f"create view {n} as select * from '{sf}/{n}.parquet'")
    rel = con.sql(queries.ORACLE_SQL["op9_url_rules"])
    got = queries.op9_url_rules(spark, sf)
    assert rel.columns == got.columns and sorted(map(tuple, got.collect()), key=str) == sorted(rel.fetchall(), key=str)
