"""Language identification by nearest centroids of TF-IDF n-gram vectors.

A text's letters are lower-cased and its other characters become single spaces; character
n-grams of two and three are hashed into a fixed number of features, weighted by
1 + log(count) and inverse document frequency and normalised to length one. Every language
has several centroids from spherical k-means; a text gets the language of the nearest one by
cosine. A text that is far from every centroid, for a text of its length, is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import held, slices, texts, without_gc

#: Hashed features of a text.
FEATURES = 8192
#: Documents, over all languages, that the model is fitted on at most (expected number of a hash sample), and of each language at least, if it has as many.
SAMPLE_DOCUMENTS, SAMPLE_LEAST = 2000, 20
#: Centroids per language.
CENTROIDS = 4
#: A text is rejected if its cosine to the nearest centroid is under this share of the cosine that
#: the lowest hundredth of that language's sample reaches at the text's number of n-grams. Short
#: texts scatter, so the share is low; texts in other letters or of random ones lie far below it.
REJECT_SHARE = 0.4
#: Numbers of n-grams are told apart by powers of two up to this one; pieces of the sample's texts stand for the smaller ones.
LENGTHS = 12

_LETTER = regex.compile(r"\p{L}")
#: Texts whose feature rows are made at once.
ROWS = 64


def _fold_table() -> np.ndarray:
    """Of every code point the lower-case letter, or a space if it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        if chr(cp).isalpha():
            low = chr(cp).lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def vectors(docs: list[str], idf: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Normalised feature rows (not weighted by document frequency if idf is None) and n-gram counts of the texts."""
    # each text between two breaks of its own, so that no n-gram reaches into the next one
    codes = np.frombuffer("".join([f"\n{d}\n" for d in docs]).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = held(("langid", "fold"), _fold_table)[codes].astype(np.uint64)
    lengths = np.array([len(d) for d in docs], np.int64)
    owner = np.repeat(np.arange(len(docs)), lengths + 2)
    space = folded == 32
    n = len(docs)
    counts = np.zeros(n * FEATURES, np.float64)
    grams = np.zeros(n, np.int64)
    for size in (2, 3):
        if len(codes) < size:
            continue
        end = len(codes) - size + 1
        key = folded[:end].copy()
        ok = ~(space[:end] & space[1 : end + 1])
        for k in range(1, size):
            key = key * np.uint64(0x9E3779B97F4A7C15) + folded[k : k + end]
            if k + 1 < size:
                ok &= ~(space[k : k + end] & space[k + 1 : k + 1 + end])
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        cell = (key >> np.uint64(64 - 13)).astype(np.int64) + owner[:end] * FEATURES
        counts += np.bincount(cell[ok], minlength=n * FEATURES)
        grams += np.bincount(owner[:end][ok], minlength=n)
    rows = counts.reshape(n, FEATURES)
    out = np.zeros_like(rows)
    np.log(rows, out=out, where=rows > 0)
    out[rows > 0] += 1
    if idf is not None:
        out *= idf
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(norm > 0, norm, 1)).astype(np.float32), grams


@dataclass
class Model:
    """Centroids (rows), the language of each, its least accepted cosine by power of two of the n-grams, inverse document frequencies."""

    languages: list[str]
    of_centroid: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray


def _clusters(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means, started from the row farthest from those chosen before."""
    k = min(k, len(x))
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    while len(chosen) < k:
        chosen.append(int(np.argmin((x @ x[chosen].T).max(axis=1))))
    c = x[chosen]
    for _ in range(12):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].sum(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on documents that are not held out and have a language and a letter.

    The sample is bounded: at most SAMPLE_DOCUMENTS documents in expectation (SAMPLE_LEAST of each
    language, if that is more), the same number of each language, taken by a hash of id and text,
    so it does not depend on partitions. Every language that any such document has is learned.
    Only the hashed vectors of the sample, and the cosines of pieces of its texts, come to the driver.
    """
    known = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("out")).filter("lang is not null and not out")
    nothing = Model([], np.empty(0, np.int64), np.empty((0, FEATURES), np.float32), np.ones(FEATURES), np.empty((0, LENGTHS + 1)))
    counts = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy("lang").collect()}  # one row per language
    if not counts:
        return nothing
    per_language = max(SAMPLE_LEAST, SAMPLE_DOCUMENTS // len(counts))
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) / float(1 << 30)
    sample = known.filter(F.col("lang").isin(list(counts)) & F.col("text").isNotNull()).filter(draw < share[F.col("lang")]).select("id", "lang", "text")

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, rows=ROWS):
            rows, grams = vectors(texts(batch, 2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(grams, pa.int64()), pa.array([r.astype("<f2").tobytes() for r in rows], pa.binary())], ["id", "lang", "grams", "vector"])

    got = sorted((r.lang, r.id or "", bytes(r.vector)) for r in sample.mapInArrow(run, "id string, lang string, grams long, vector binary").collect() if r.grams)
    languages = sorted({lang for lang, _, _ in got})
    if not got:
        return nothing
    x = np.frombuffer(b"".join(v for _, _, v in got), "<f2").reshape(len(got), FEATURES).astype(np.float32)
    y = np.array([languages.index(lang) for lang, _, _ in got])
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centroids, owners = [], []
    for k in range(len(languages)):
        c = _clusters(x[y == k], CENTROIDS)
        centroids.append(c)
        owners += [k] * len(c)
    model = Model(languages, np.array(owners), np.concatenate(centroids).astype(np.float32), idf, np.empty(0))
    model.least = _least(sample, model)[model.of_centroid]
    return model


def pieces_of(text: str) -> list[str]:
    """The text, and up to four pieces of it of each length of 4, 8, 16 ... characters."""
    out, size = [text], 4
    while size < min(len(text), 1 << LENGTHS):
        out += [text[at : at + size] for at in np.linspace(0, len(text) - size, 4).astype(int).tolist()]
        size *= 2
    return out


def bins(grams: np.ndarray) -> np.ndarray:
    """The power of two of the numbers of n-grams, LENGTHS at most."""
    return np.minimum(np.log2(np.maximum(grams, 1)).astype(np.int64), LENGTHS)


def _least(sample: DataFrame, model: Model) -> np.ndarray:
    """For each language and power of two the least accepted cosine: a share of what the lowest hundredth of the sample's texts and pieces reach."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {lang: k for k, lang in enumerate(shared.value.languages)}
        for batch in slices(batches, 2, rows=ROWS):
            own, parts = [], []
            for lang, text in zip(batch.column(1).to_pylist(), texts(batch, 2), strict=True):
                made = pieces_of(text) if lang in of else []
                parts += made
                own += [of.get(lang)] * len(made)
            for at in range(0, len(parts), ROWS):
                rows, grams = vectors(parts[at : at + ROWS], shared.value.idf)
                near = (rows @ shared.value.centroids.T).max(axis=1)
                some = grams > 0
                yield pa.RecordBatch.from_arrays([pa.array(np.array(own[at : at + ROWS])[some], pa.int64()), pa.array(bins(grams)[some], pa.int64()), pa.array(near[some].astype(np.float64))], ["lang", "bin", "cosine"])

    out = np.zeros((len(model.languages), LENGTHS + 1))
    found = sample.mapInArrow(run, "lang long, bin long, cosine double").groupBy("lang", "bin").agg(F.percentile("cosine", 0.01).alias("low")).collect()
    for r in found:
        out[r.lang, r.bin] = REJECT_SHARE * r.low
    return np.maximum.accumulate(out, axis=1)  # lengths that no piece has take those of shorter ones


def predict(docs: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine to its nearest centroid and whether it is rejected, of each text."""
    letters = np.array([bool(_LETTER.search(d)) for d in docs], bool)
    if not len(model.languages):
        return ["und"] * len(docs), np.zeros(len(docs)), np.ones(len(docs), bool)
    rows, grams = vectors(docs, model.idf)
    cosine = rows @ model.centroids.T
    best = cosine.argmax(axis=1)
    score = np.clip(cosine[np.arange(len(docs)), best].astype(np.float64), 0, 1)
    far = score < model.least[best, bins(grams)]
    lang = [model.languages[model.of_centroid[b]] if ok else "und" for b, ok in zip(best, letters, strict=True)]
    return lang, np.where(letters, score, 0.0), far | ~letters


def predict_languages(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every document from its whole text alone.

    lang_pred is a learned language, or "und" if the text is null or has no letter or nothing
    could be learned; score is the cosine to the nearest centroid, 0 to 1 (0 for "und");
    rejected marks "und" and texts far from every centroid for their number of n-grams. Equal
    cosines go to the language first in order. One row per input row, repeated rows included; an
    empty table gives an empty result; other columns are ignored. Narrow: no shuffle; the model
    is CENTROIDS * FEATURES numbers per language.
    """
    model = _shared(df, model)

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, rows=ROWS):
            lang, score, rejected = predict(texts(batch, 2), model.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = df.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {df.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, whose text is not rejected; null, empty and letterless texts go.

    Repeated rows are judged each alike; an empty table gives an empty one; columns may have any
    names, as rows pass through whole. Narrow: no shuffle.
    """
    model, at = _shared(df, model), df.columns.index(text_col)

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, rows=ROWS):
            yield batch.filter(pa.array(~predict(texts(batch, at), model.value)[2]))

    return df.mapInArrow(run, df.schema)


def _shared(df: DataFrame, model: Model):
    """The model on every executor: as many centroids as languages ask for, whatever the table's rows."""
    assert len(model.centroids) <= CENTROIDS * len(model.languages)
    return df.sparkSession.sparkContext.broadcast(model)


def accuracy(predicted: DataFrame, truth: DataFrame, id_col: str = "doc_id", lang_col: str = "lang") -> float:
    """Share of held-out documents whose predicted language is theirs."""
    both = predicted.filter("held_out").join(truth.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("truth")).filter("truth is not null"), "doc_id")
    found = both.agg(F.avg((F.col("lang_pred") == F.col("truth")).cast("double"))).first()[0]
    return math.nan if found is None else found
