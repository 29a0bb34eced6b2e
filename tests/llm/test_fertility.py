import base64
import math
import random
import re
from collections import Counter

import public_tokenizers as P
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from waymark.llm import fertility, queries

MODEL, RANKS = P.path("piece_bpe_32k.model"), P.path("byte_bpe_multi_50k.tiktoken")


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def check(rows, got):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    key = lambda r: (str(r[0]), *r[1:])
    want = sorted((((i, *base(t)), t or "") for i, t in rows), key=lambda x: key(x[0]))
    assert [w for w, _ in want] == sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key)
    by = {r.doc_id: r for r in got}
    for w, t in want[:60]:
        ids = [i for x in re.findall(r"[^\x20\x09-\x0D]+", t) for i in sp.encode(x)]
        r, c = by[w[0]], Counter(ids)
        if list(x[0][0] for x in want).count(w[0]) == 1:
            assert r.n_tokens == len(ids)
            assert math.isclose(r.token_entropy, -sum(v / len(ids) * math.log2(v / len(ids)) for v in c.values()), abs_tol=1e-9)
            assert math.isclose(r.byte_share, sum(sp.is_byte(i) for i in ids) / len(ids) if ids else 0, abs_tol=1e-9)
            assert r.kept == (r.reason is None) and (not r.base_failed or not r.kept)


def test_edge_rows(spark):
    rng = random.Random(3)
    rows = [(None, None), (1, ""), (2, "a b c a b c"), (2, "a b c a b c"), (3, "x\n\nx\n \nx \nx\x0b"), (4, "é\x85b\xa0c\x1cd e #*<>"), (5, "\U0001f600 " * 80), (6, "word " * 3000)]
    rows += [(100 + k, "".join(rng.choice("ab #\n\té\x0c") for _ in range(rng.randint(0, 400)))) for k in range(60)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int")
    got = fertility.measure_documents(df, MODEL).collect()
    check(rows, got)
    kept = {r.doc_id for r in got if r.kept}
    assert {r.doc_id for r in fertility.keep_fertile(df, MODEL).collect()} == kept
    assert fertility.measure_documents(df.limit(0), MODEL).count() == 0


def test_bands_reject(spark):
    prose = " ".join(random.Random(5).choices("the of and engine reads tables while another one writes rows into its files slowly but surely every day".split(), k=120))
    noise = " ".join("".join(random.Random(k).choices("ᚠᚡᚁᐃ", k=6)) for k in range(90))
    runs = " ".join(f"{'-' * 60}{k}" for k in range(80))
    made = dict(zip(("prose", "noise", "runs"), zip(*fertility.measure([prose, noise, runs], fertility.word_tokens(MODEL))), strict=True))
    reason = list(fertility.COLUMNS).index("reason")
    assert made["prose"][reason] is None and made["runs"][reason] in ("chars_per_token", "token_entropy")
    assert made["noise"][reason] is not None or made["noise"][list(fertility.COLUMNS).index("script")] == "Other"
    assert fertility.script_of("Привет мир") == "Cyrillic" and fertility.script_of("漢字です漢字") == "Han"


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op4_fertility_rules(spark, sf).collect())


PROSE = {
    "Latin": "Wszyscy ludzie rodzą się wolni i równi w swojej godności i prawach Są obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
    "Vietnamese": "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền lợi Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình anh em",
    "Cyrillic": "Все люди рождаются свободными и равными в своем достоинстве и правах Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства",
    "Greek": "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα Είναι προικισμένοι με λογική και συνείδηση και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης",
    "Hangul": "모든 인간은 태어날 때부터 자유로우며 그 존엄과 권리에 있어 동등하다 인간은 천부적으로 이성과 양심을 부여받았으며 서로 형제애의 정신으로 행동하여야 한다",
    "Hebrew": "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם כולם חוננו בתבונה ובמצפון לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחוה",
    "Other": "የሰው ልጅ ሁሉ ሲወለድ ነጻና በክብርና በመብትም እኩልነት ያለው ነው የተፈጥሮ ማስተዋልና ሕሊና ስላለው አንዱ ሌላውን በወንድማማችነት መንፈስ መመልከት ይገባዋል",
}


def test_bands_tell_junk_from_prose():
    rng = random.Random(11)
    prose = {k: " ".join(rng.choices(t.split(), k=90)) for k, t in PROSE.items()}
    junk = {
        "base64": " ".join(base64.b64encode(rng.randbytes(30)).decode() for _ in range(100)),
        "hex": " ".join(rng.randbytes(20).hex() for _ in range(100)),
        "mojibake": prose["Cyrillic"].encode().decode("latin-1").replace("\x85", "?"),
        "mojibake 2": prose["Greek"].encode().decode("latin-1").replace("\x85", "?"),
        "noise": " ".join("".join(rng.choices("ᚠᚡᚁᐃ", k=6)) for _ in range(90)),
        "more noise": " ".join("".join(chr(rng.randrange(0x10000, 0x10300)) for _ in range(6)) for _ in range(90)),
    }
    vocabulary = fertility.word_tokens(MODEL)
    verdict = lambda t: {k: v[0] for k, v in zip(fertility.COLUMNS, fertility.measure([t], vocabulary), strict=True)}
    for script, t in prose.items():
        assert (verdict(t)["script"], verdict(t)["reason"]) == (script, None), verdict(t)
    for name, t in junk.items():
        assert verdict(t)["reason"] in ("chars_per_token", "byte_share", "token_entropy"), (name, verdict(t))
    assert all(b.byte_share < 1 for b in fertility.BANDS.values())


def test_second_vocabulary():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*PROSE.values(), "", "one", "\U0001f600 \U0001f680 " * 40, "a" * 3000]
    made = fertility.measure(texts, fertility.word_tokens(MODEL), second=fertility.WordTokens(RANKS))
    by = dict(zip(fertility.COLUMNS, made, strict=True))
    for k, t in enumerate(texts):
        ids = [i for w in t.split() for i in enc.encode_ordinary(" " + w)]
        n, c = max(1, len(ids)), Counter(ids)
        part = sum("\ufffd" in enc.decode_single_token_bytes(i).decode("utf-8", "replace") for i in ids)
        assert math.isclose(by["chars_per_token2"][k], sum(map(len, t.split())) / n) and math.isclose(by["byte_share2"][k], part / n)
        assert math.isclose(by["token_entropy2"][k], -sum(v / n * math.log2(v / n) for v in c.values()), abs_tol=1e-9)


def limits_by_hand(rows, labels):
    """rows: dicts with doc_id, lang and measures; labels: (doc_id, quality, toxic). The learned limits by group."""
    of = {}
    for i, q, t in labels:
        of.setdefault(i, []).append((q, t))
    good = {i for i, x in of.items() if i is not None and min((q for q, _ in x if q is not None), default=None) == 1 and max(t or 0 for _, t in x) == 0}
    values = {}
    for r in rows:
        if r["doc_id"] in good and not r["base_failed"]:
            for group in [f"{r['lang']}/{r['script']}", r["script"]] if r["lang"] else [r["script"]]:
                for c in fertility.LIMITED:
                    values.setdefault(group, {}).setdefault(c, []).append(math.floor(r[c] * 1000))
    out = {}
    for group, columns in values.items():
        if len(columns["byte_share"]) >= fertility.LEAST_LABELLED:
            for c, v in columns.items():
                v.sort()
                low, middle, high = (next(x for k, x in enumerate(v, 1) if k >= len(v) * share) / 1000 for share in (0.01, 0.5, 0.99))
                slack = fertility.LIMITED[c]
                out.setdefault(group, {})[c] = (low - max(middle - low, slack), high + max(high - middle, slack))
    return out


def kept_by_hand(docs, labels):
    """docs: (doc_id, text, lang). Ids with the verdict of bands and learned limits."""
    made = fertility.measure([t or "" for _, t, _ in docs], fertility.word_tokens(MODEL), second=fertility.WordTokens(RANKS))
    rows = [dict(zip(fertility.COLUMNS, m, strict=True), doc_id=d[0], lang=d[2]) for d, m in zip(docs, zip(*made, strict=True), strict=True)]
    limits, out = limits_by_hand(rows, labels), []
    for r in rows:
        own = limits.get(f"{r['lang']}/{r['script']}") if r["lang"] else None
        own = own or limits.get(r["script"]) or {}
        out.append((r["doc_id"], r["kept"] and all(lo <= r[c] <= hi for c, (lo, hi) in own.items())))
    return out


def test_learned_limits_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(None, 1, 0), (5, 1, None), (5, None, None), (6, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    labels = labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).unionAll(odd)
    docs = [(r.doc_id, r.text, r.lang) for r in rows.collect()] + [(10**6, None, "en"), (None, "w " * 60, None), (10**6 + 1, PROSE["Cyrillic"] * 4, "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    got = fertility.measure_documents(df, MODEL, second=RANKS, labels=labels, lang_col="lang").collect()
    want = kept_by_hand(docs, [tuple(r) for r in labels.collect()])
    assert sorted(((r.doc_id, r.kept) for r in got), key=str) == sorted(want, key=str)
    assert {r.group for r in got} >= {"en/Latin", "de/Latin", "Latin"} and all(r.kept == (r.reason is None) for r in got)
    clash = df.withColumnsRenamed({"lang": "kept"}).withColumn("own", F.lit(1)).withColumn("n_words", F.lit("x"))
    kept = fertility.keep_fertile(clash, MODEL, second=RANKS, labels=labels, lang_col="kept")
    assert kept.columns == clash.columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, k in want if k), key=str)
    empty = df.limit(0)
    assert fertility.measure_documents(empty, MODEL, second=RANKS, labels=labels, lang_col="lang").count() == 0
    assert fertility.keep_fertile(df, MODEL, second=RANKS, labels=labels.limit(0), lang_col="lang").count() >= len([1 for _, k in want if k])


def test_learned_limits_reject_junk_and_keep_clean_texts(spark):
    """Junk made of clean texts goes, and of the clean texts themselves nearly none."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("quality = 1 and toxic = 0")
    rng, clean = random.Random(8), [(r.doc_id, r.text, r.lang) for r in docs.collect() if not base(r.text)[5]]
    long = [(t, lang) for _, t, lang in clean if len(t.split()) > 150]
    junk = {
        "symbols": [" ".join(w + rng.choice(["%%%", "***", "&&&", "$$$"]) if rng.random() < 0.6 else w for w in t.split()) for t, _ in long],
        "shouting": ["!! ".join(w.upper() for w in t.split()) for t, _ in long],
        "spelled": [" ".join("-".join(w) for w in t.split()) for t, _ in long],
        "base64": [base64.b64encode(t.encode()).decode() for t, _ in long],
        "few words": [" ".join(rng.choices(t.split()[:9], k=200)) for t, _ in long],
        "mojibake": [" ".join("".join(chr(ord(c) + 128) if rng.random() < 0.4 else c for c in w) for w in t.split()) for t, _ in long],
    }
    junk["base64"] = [" ".join(t[k : k + 40] for k in range(0, len(t), 40)) for t in junk["base64"]]
    rows, what = list(clean), {}
    for kind, texts in junk.items():
        for t, (_, lang) in zip(texts, long, strict=True):
            what[10**7 + len(rows)] = kind
            rows.append((10**7 + len(rows), t, lang))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in fertility.measure_documents(df, MODEL, second=RANKS, labels=docs.select("doc_id", "quality", "toxic"), lang_col="lang").collect()}
    assert sum(got[i].kept for i, _, _ in clean) >= 0.99 * len(clean)
    passed = Counter(what[i] for i in what if got[i].kept)
    # capitals with exclamation marks, and words with a few signs, look much like words to both vocabularies: a part of them stays
    most = {"shouting": 0.7, "symbols": 0.25}
    assert all(passed[kind] <= most.get(kind, 0.02) * len(long) for kind in junk), (passed, Counter((what[i], got[i].reason) for i in what), len(long))
