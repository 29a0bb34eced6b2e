"""The corpus pipeline: stages that each read what the one before kept.

Language ID and tokeniser fertility drop the documents that they reject, deduplication keeps
one document of each group, mixing takes documents of each source by its budget, and the last
stage encodes what is left.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from waymark.llm import bpe, dedup, fertility, langid, mixing, queries
from waymark.llm._common import delete, fresh_path, scratch, small_batches, table

#: Share of the tokens that reach the mixing stage, and how often it may take a document.
MIX_SHARE, MIX_EPOCHS = 0.9, 1


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is near the centroids of a language; the others go.

    Null, empty and letterless texts go; rows without an id or language are judged like others,
    repeated rows alike; an empty table gives an empty one.
    """
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def check_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, the fertility bands of their script and the limits learned from labels; the others go.

    Null, empty and short texts go; texts without a language are held to their script's limits.
    """
    small_batches(spark)
    first, second = map(public_tokenizers.path, queries.FERTILITY_VOCABULARIES)
    return fertility.keep_fertile(docs, first, second=second, labels=table(spark, sf_dir, "labels"), lang_col="lang")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, 80 per cent.

    That with the smallest id stays (none last); rows of one id with unlike texts are documents of
    their own, repeated rows are one, texts without words are like nothing.
    """
    small_batches(spark)
    return dedup.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents taken for nine tenths of the tokens, each once at most, at target weights.

    Texts without words are never taken; null languages and sources are nodes of their own; rows of
    one id are taken or left together.
    """
    small_batches(spark)
    rows = mixing.sizes(docs, queries.mix_domain())
    plan = mixing.mix_plan(rows, MIX_SHARE, MIX_EPOCHS, queries.MIX_WEIGHTS, queries.MIX_SEED)
    return mixing.mixed_rows(docs, plan, queries.MIX_SEED, queries.mix_domain())


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and decoded bytes; a null text has no tokens, every row one result."""
    small_batches(spark)
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_languages),
    ("quality", check_quality),
    ("minhash_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("bpe", encode),
]
#: SQL can't express the learned centroids and the tokenisers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read back by the next, whose input is then dropped."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        with scratch(spark):  # what a stage stored on its way goes once its result is written
            made = stage(spark, docs, sf_dir)
            made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            delete(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
