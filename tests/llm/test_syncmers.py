import hashlib
import random
import struct

import regex
import xxhash

from waymark.llm import queries, syncmers
from waymark.llm.syncmers import K, S


def xx(*values):
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else struct.pack("<q", v)
        seed = xxhash.xxh64_intdigest(raw, seed=seed % 2**64)
    return seed - 2**64 if seed >= 2**63 else seed


def words_of(text):
    unspaced = "".join(rf"\p{{Script={n}}}" for n in ("Han", "Hiragana", "Katakana", "Bopomofo", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan", "Yi"))
    return regex.findall(rf"[{unspaced}]|[^\x20\x09-\x0d{unspaced}]+", text)


def anchors(text):
    w = [xx(x) for x in words_of(text)]
    if not w:
        return []
    h = 0
    for x in w:
        h = xx(h, x)
    r = [xx(a, b) for a, b in zip(w, w[1:])]
    out = []
    for i in range(len(w) - K + 1):
        inner = r[i : i + K - S + 1]
        if min(inner) in (inner[0], inner[-1]):
            out.append((xx(*r[i : i + K - 1 : S]), i))
    return sorted(out) or [(h, 0)]


def likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    places = [{}, {}]
    for side, x in zip(places, (a, b), strict=True):
        for h, p in x:
            side.setdefault(h, []).append(p)
    pairs = [(p, q - p) for h, own in places[0].items() for p, q in zip(own, places[1].get(h, []), strict=False)]
    shifts = [d for _, d in sorted(pairs)]
    near = [None, *shifts, None]
    chained = sum(x in (near[k], near[k + 2]) for k, x in enumerate(shifts))
    return max(chained, 1) / (len(a) + len(b) - len(shifts)) if shifts else 0.0


def shown(a):
    return " ".join(f"{h % 2**64:x}:{p}" for h, p in a)


def brute(rows):
    """rows: (doc_id, text) with the ids in any order."""
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), xx(r[1] or ""), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        a, e = anchors(t), anchors(edited)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), shown(a), shown(e), likeness(a, e), likeness(a, anchors(nxt))))
    return sorted(out, key=str)


def test_edge_rows(spark):
    long = " ".join(f"w{k % 700} v{k * 7 % 311}" for k in range(3000))
    rows = [(5, "a b c d e f g h i j"), (None, None), (-3, ""), (7, "a b c d e f g h i j"), (2**40, long), (2**40 + 1, long[:9000]), (2**62, "漢字" * 200), (-(2**61), "x"), (9, " \n\t "), (300, "\U0001f600 a" * 40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, anchors string")
    assert sorted(map(tuple, syncmers.compare_edited(df).collect()), key=str) == brute(rows)
    assert syncmers.compare_edited(df.limit(0)).count() == 0
    one = df.filter("doc_id = 5")
    assert sorted(map(tuple, syncmers.compare_edited(one).collect()), key=str) == brute(rows[:1])
    twice = df.filter("doc_id = 5").unionAll(one)
    assert syncmers.compare_edited(twice).count() == 2


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op6_syncmer_fingerprints(spark, sf)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    rows_got = sorted(map(tuple, got.collect()), key=str)
    assert rows_got == brute(rows)
    long = [r for r in rows_got if r[1] > 1500]
    assert sum(r[5] > r[6] for r in long) > 0.95 * len(long)


def test_long_texts_keep_all_anchors(spark):
    """A passage and a short document inside a long one are found, as no anchor is dropped by its hash."""
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    short = words("s", 50)
    rows = [(1, short), (2, f"{words('a', 9000)} {short} {words('b', 9000)}")]
    got = {r.doc_id: r.anchors for r in syncmers.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 0.3 < len(got[2]) / 18_045 < 0.5
    assert len(got[1]) > 5 and {x.h for x in got[1]} <= {x.h for x in got[2]}
    near = {r.doc_id: r.near_next for r in syncmers.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near[1] == near[2] == len(got[1]) / len(got[2])


def whole(text):
    h = 0
    for x in text.split():
        h = xx(h, xx(x))
    return h


def test_texts_without_syncmers(spark):
    """Of texts of K to K + 2 words, those without a closed syncmer have the hash of all words."""
    texts = [" ".join(f"{a}{k}" for k in range(n)) for a in "abcdefghijklmnopqrstuvwxyz" for n in (K, K + 1, K + 2)]
    bare = [t for t in texts if len(anchors(t)) == 1 and anchors(t)[0][0] == whole(t)]
    assert len(bare) > 3
    df = spark.createDataFrame([*enumerate(texts), (-1, " "), (-2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.fingerprints(df).collect()}
    assert got[-1].fingerprint == got[-2].fingerprint == ""
    assert all(got[k].fingerprint for k in range(len(texts)))
    for k, t in enumerate(texts):
        if t in bare:
            assert [tuple(a) for a in got[k].anchors] == [(whole(t), 0)]
    pair = spark.createDataFrame([(1, bare[0]), (2, bare[1])], "doc_id long, text string")
    assert [r.near_next for r in syncmers.compare_edited(pair).collect()] == [0.0, 0.0]


def test_short_unrelated_texts_differ(spark):
    """Of random texts of six to eight words no two are alike, and none is like its edited text unless that is the same."""
    rng = random.Random(6)
    rows = [(k, " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 7, 8])))) for k in range(300)]
    got = syncmers.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.fingerprint for r in got)
    assert [r.doc_id for r in got if r.near_next > 0] == []
    texts = dict(rows)
    assert [r.doc_id for r in got if r.near_edited == 1 and r.edited_sha256 != hashlib.sha256(texts[r.doc_id].encode()).hexdigest()] == []


def test_copies_with_insertions(spark):
    """A character put into a text without white space, or words into prose, changes only the anchors there."""
    rng = random.Random(7)
    signs = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(2000))
    prose = [f"w{rng.randrange(3000)}" for _ in range(1500)]
    edited = prose[:300] + ["new", "words"] + prose[300:900] + prose[910:]
    link = "http://example.org/" + "".join(rng.choice("abcdefgh/") for _ in range(80))
    rows = [(6, signs), (5, signs[:3] + "\u4e00" + signs[3:]), (4, " ".join(prose)), (3, " ".join(edited)), (2, " ".join([*prose[:50], link, *prose[50:]])), (1, " ".join([*prose[:50], link + "x", *prose[50:]]))]
    got = {r.doc_id: r for r in syncmers.compare_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[6].near_next > 0.98 and got[4].near_next > 0.95 and got[2].near_next > 0.95
    assert got[5].near_next == 0 and len(got[6].fingerprint.split()) > 500


def test_repeated_passages(spark):
    """A passage written 3 and 50 times, and one of which a piece stands earlier by chance."""
    rng = random.Random(8)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(40))
    filler = [" ".join(f"f{rng.randrange(10**6)}" for _ in range(60)) for _ in range(2)]
    piece = " ".join(passage.split()[10:22])
    rows = [(9, " ".join([passage] * 3)), (8, " ".join([passage] * 50)), (7, " ".join([passage] * 50)), (6, f"{piece} {filler[0]} {passage} {filler[1]}"), (5, passage), (4, f"{filler[0]} {passage}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in syncmers.compare_edited(df).collect()}
    assert sorted(map(tuple, got.values()), key=str) == brute(rows)
    assert got[9].fingerprint != got[8].fingerprint and 0.04 < got[9].near_next < 0.08
    assert got[8].near_next == 1 and got[8].fingerprint == got[7].fingerprint
    assert len(got[8].fingerprint.split()) > 16 * len(got[5].fingerprint.split())
    own = len(got[5].fingerprint.split())
    assert got[6].near_next >= (own - 6) / len(got[6].fingerprint.split())


def test_long_runs_are_words(spark):
    """A URL is one word, however long; characters of scripts without spaces are words among others."""
    link = "http://example.org/" + "a" * 40
    df = spark.createDataFrame([(link,), ("see " + link + " now",), ("漢字kana カナ、x",), ("สวัสดี ok",), (" \n",)], "t string")
    got = [r.w for r in df.selectExpr(f"{syncmers.words_of('t')} as w").collect()]
    assert got == [[link], ["see", link, "now"], ["漢", "字", "kana", "カ", "ナ", "、x"], [*"สวัสดี", "ok"], []]


def test_hot_ids(spark, monkeypatch):
    """Ids that very many rows share, none among them, are cut into groups with the same result; equal rows too."""
    rng = random.Random(9)
    text = lambda: " ".join(f"w{rng.randrange(40)}" for _ in range(rng.choice([0, 3, 9, 30])))
    rows = [(rng.choice([None, None, 5, 6, 700, 701, 10_000, k]), text()) for k in range(150)] + [(5, "one and the same text of many rows")] * 40 + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(map(tuple, syncmers.compare_edited(df).collect()), key=str) == want
    monkeypatch.setattr(syncmers, "HOT_ROWS", 3)
    assert sorted(map(tuple, syncmers.compare_edited(df).collect()), key=str) == want
    monkeypatch.setattr(syncmers, "MAX_BROADCAST_GROUPS", 0)
    assert sorted(map(tuple, syncmers.compare_edited(df).collect()), key=str) == want
    one = spark.createDataFrame([(1, f"t {k % 7}") for k in range(40)], "doc_id long, text string")
    assert sorted(map(tuple, syncmers.compare_edited(one).collect()), key=str) == brute([tuple(r) for r in one.collect()])
