import os
import random

import duckdb
from test_dedup import brute
from test_fertility import kept_by_hand

import corpus_pipeline
from waymark.llm import _common, langid, queries


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    model = langid.fit(docs)
    far = dict(zip(rows, langid.predict([r.text for r in rows.values()], model)[2], strict=True))
    made = corpus_pipeline.identify_languages(spark, docs, sf).cache()
    assert made.columns == columns and {r.doc_id for r in made.collect()} == {i for i in rows if not far[i]}

    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    good = dict(kept_by_hand([(r.doc_id, r.text, r.lang) for r in made.collect()], labels))
    before = {r.doc_id for r in made.collect()}
    made = corpus_pipeline.check_quality(spark, made, sf).cache()
    assert made.columns == columns and {r.doc_id for r in made.collect()} == {i for i in before if good[i]}

    before = sorted((r.doc_id, r.text) for r in made.collect())
    made = corpus_pipeline.drop_near_duplicates(spark, made, sf).cache()
    assert made.columns == columns and sorted(r.doc_id for r in made.collect()) == [i for i, _, _, k in brute(before, 80, 5) if k]

    before = made.count()
    mixed = corpus_pipeline.mix_sources(spark, made, sf).cache()
    assert mixed.columns == columns and 0.8 * before < mixed.count() < before
    assert mixed.count() == mixed.select("doc_id").distinct().count()
    con = duckdb.connect()
    con.register("rows_in", made.toPandas())
    con.sql("create view documents as select * from rows_in")
    taken = con.sql(queries.mix_sql(corpus_pipeline.MIX_SHARE, corpus_pipeline.MIX_EPOCHS)).fetchall()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r[0] for r in taken) and {r[5] for r in taken} == {1}
    words = lambda df: df.selectExpr("sum(size(filter(split(text, '[ \\\\t-\\\\r]+'), w -> w <> ''))) as n").first().n
    assert abs(words(mixed) / words(made) - 0.9) < 0.08

    encoded = {r.doc_id: r for r in corpus_pipeline.encode(spark, mixed, sf).collect()}
    assert encoded.keys() == {r.doc_id for r in mixed.collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == encoded.keys()


def test_empty_table(spark, tmp_path, sf):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choices("the of and engine table reads writes rows files slowly surely every day while another one found nothing here at all so it went back home again".split(), k=n))
    rows = [(k, prose(80 + k), "en" if k % 3 else None, f"src{k % 4}" if k % 5 else None, k) for k in range(60)]
    rows += [rows[5], rows[5], (None, prose(90), "en", "src1", None), (None, None, None, None, None), (900, None, "en", "src1", 0), (901, "", "en", "src1", 0), (902, prose(20_000), "en", "odd", 1), (903, rows[7][1], "en", "src1", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1, 0) for k in range(40)] + [(None, None, None), (900, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path)).cache()
        ids = [r.doc_id for r in made.collect()]
        if name == "minhash_dedup":
            assert ids.count(5) == 1 and 903 not in ids and 900 in ids
        if name == "bpe":
            assert len(ids) == len(rows)
        else:
            assert made.columns == docs.columns and set(ids) <= {r[0] for r in rows}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert 0 < corpus_pipeline.run(spark, str(tmp_path)).count() < len(rows)


def test_run_leaves_one_copy(spark, sf):
    """Of what the stages store only the last one's input stays in the shared folder."""
    folder = _common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert [n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before] == ["pipeline-source_mix"]
