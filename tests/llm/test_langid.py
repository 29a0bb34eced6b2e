import math
import random
import zlib

from waymark.llm import langid, queries


def test_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = queries.op3_language_id(spark, sf).cache()
    assert got.count() == docs.count()
    assert langid.accuracy(got, docs) > 0.97
    assert got.filter("score < 0 or score > 1 or lang_pred is null or held_out is null").count() == 0
    assert got.filter("rejected").count() <= 0.02 * docs.count()


def test_only_text_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    texts = [r.text for r in docs.limit(50).collect()]
    assert langid.predict(texts, model)[0] == langid.predict(texts[::-1], model)[0][::-1]


def test_edge_rows(spark):
    schema = "doc_id long, text string, lang string, score string"
    rows = [(i, t, lang, "x") for i, (t, lang) in enumerate([("the cat and the dog went home together", "en"), ("der Hund und die Katze gehen nach Hause", "de")] * 20)]
    rows += [(None, "the dog", "en", None), (100, None, "en", None), (101, "", None, None), (102, "12 34 !!", "de", None), (103, "der Hund ist nach Hause gegangen", None, None)]
    df = spark.createDataFrame(rows, schema)
    got = langid.predict_languages(df, langid.fit(df)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (None, 100, 101, 102, 103)] == ["en", "und", "und", "und", "de"]
    assert by[None].held_out is False and by[100].rejected and by[101].score == 0
    assert {r.doc_id for r in langid.keep_identified(df, langid.fit(df)).collect()} == {*range(40), None, 103}
    empty = df.limit(0)
    assert langid.predict_languages(empty, langid.fit(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict_languages(df, langid.fit(empty)).collect()} == {"und"}


def near_by_hand(text, model):
    """Language and cosine by plain Python: n-grams counted in a dictionary, weighted, compared with each centroid."""
    folded = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in f" {text} ")
    count = {}
    for n in (2, 3):
        for i in range(len(folded) - n + 1):
            gram = folded[i : i + n]
            if "  " not in gram:
                key = 0
                for c in gram:
                    key = (key * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                key ^= key >> 29
                cell = (key * 0xBF58476D1CE4E5B9) % 2**64 >> 51
                count[cell] = count.get(cell, 0) + 1
    weight = {k: (1 + math.log(n)) * model.idf[k] for k, n in count.items()}
    norm = math.sqrt(sum(w * w for w in weight.values())) or 1
    cosines = [sum(w * float(c[k]) for k, w in weight.items()) / norm for c in model.centroids]
    best = max(range(len(cosines)), key=lambda k: (cosines[k], -k))
    return model.languages[model.of_centroid[best]], cosines[best]


def test_prediction_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in langid.predict_languages(docs, model).collect()}
    for i in sorted(rows)[:60]:
        if langid._LETTER.search(rows[i] or ""):
            lang, cosine = near_by_hand(rows[i], model)
            assert got[i].lang_pred == lang and math.isclose(got[i].score, cosine, abs_tol=1e-4)


def test_far_texts_are_rejected(spark, sf):
    """Texts in no learned language go, short ones too; sentences of the learned ones stay."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    rng = random.Random(4)
    noise = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))
    far = [noise("αβγδεζηθικλμν", n) for n in (2, 5, 20, 300)] + [noise("xqzjkwvy", n) for n in (5, 20, 300)] + ["汉字" * n for n in (3, 50)]
    assert langid.predict(far, model)[2].tolist() == [True] * len(far)
    own = [r.text for r in docs.filter("lang is not null and length(text) > 400").collect()]
    parts = [t[at : at + n] for t in own for n in (40, 120, 400) for at in (0, len(t) // 2)]
    assert langid.predict(own, model)[2].mean() < 0.01 and langid.predict([p for p in parts if len(p) > 30], model)[2].mean() < 0.02


def test_every_language_is_learned(spark):
    """More languages than a hundred, ties, repeated rows and a very long text."""
    rng = random.Random(5)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 520)]
    words = {f"l{k:03}": ["".join(rng.choice(letters[4 * k : 4 * k + 4]) for _ in range(3)) for _ in range(6)] for k in range(130)}
    rows = [(i, " ".join(rng.choices(words[lang], k=12)), lang) for i, lang in enumerate(sorted(words) * 4)]
    learned = sorted({lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 != 2})
    rows += [rows[0], rows[0], (9000, " ".join(words[learned[7]] * 30_000), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model.languages == learned and len(learned) > 110
    got = langid.predict_languages(df, model).collect()
    assert len(got) == len(rows) and all(r.lang_pred == lang for r, (_, _, lang) in zip(got, rows, strict=True) if lang in model.languages)
    assert {r.lang_pred for r in got if r.doc_id == 9000} == {learned[7]} and len({r[2:] for r in got if r.doc_id == 0}) == 1
