"""Quality rules on tokeniser fertility: how public vocabularies take a text apart.

A text's words are encoded one by one with one or two vocabularies; measured are characters
per token, the share of byte-fallback tokens (in a byte-level vocabulary: of tokens that hold
part of a character) and the entropy of the text's tokens. Each script has written bands for
the first vocabulary, for junk of any kind. Narrower limits are learned, for each language in
its script and for each script, from all texts that labels call good: beyond the lowest or
highest hundredth by as much again as it lies from the median. A text outside its bands or
limits is rejected. Before that stand two base rules on counts of words and repeated windows.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from waymark.llm._common import held, slices, stored, texts, without_gc
from waymark.llm.chunks import gather

#: Distinct words whose tokens a worker remembers, for each vocabulary, before it starts anew: few, as a worker shares an executor's memory with the JVM.
CACHE_SIZE = 80_000

_WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """What a script's texts may measure: characters per token, greatest byte share, token entropy in bits."""

    least_chars: float
    most_chars: float
    byte_share: float
    least_entropy: float
    most_entropy: float


#: Bands by script, for the 32,000-piece vocabulary with byte fallback; "Other" holds for all scripts not named.
#: Latin has its lower limits from the labelled clean texts of sf0.1 (2,872 that pass the base rules: 1.65 to 2.43
#: characters per token, no byte tokens, 5.55 to 7.04 bits), below their least; base64 measures 1.2, mojibake 0.9 to 1.0.
#: Other scripts have no labelled text there; their limits lie beyond samples of prose. Vietnamese, with one piece a
#: letter (1.15), would fall under Latin's limit. No limit of byte share is 1: without pieces of a script, nothing can
#: be told from noise.
BANDS = {
    "Latin": Band(1.5, 8.0, 0.15, 4.0, 13.0),
    "Cyrillic": Band(1.2, 8.0, 0.15, 3.0, 13.0),
    "Greek": Band(0.6, 6.0, 0.30, 3.0, 13.0),
    "Han": Band(0.3, 4.0, 0.60, 2.5, 13.0),
    "Kana": Band(0.3, 4.0, 0.60, 2.5, 13.0),
    "Hangul": Band(0.3, 4.0, 0.70, 2.5, 13.0),
    "Arabic": Band(0.5, 6.0, 0.40, 3.0, 13.0),
    "Hebrew": Band(0.5, 6.0, 0.40, 3.0, 13.0),
    "Devanagari": Band(0.3, 6.0, 0.70, 3.0, 13.0),
    "Thai": Band(0.3, 6.0, 0.70, 3.0, 13.0),
    "Other": Band(0.25, 8.0, 0.90, 2.5, 13.0),
    "Vietnamese": Band(0.9, 8.0, 0.15, 4.0, 13.0),
}

#: First words of Unicode letter names that stand for a script of BANDS.
_NAMES = {"LATIN": "Latin", "CYRILLIC": "Cyrillic", "GREEK": "Greek", "CJK": "Han", "HIRAGANA": "Kana", "KATAKANA": "Kana", "HANGUL": "Hangul", "ARABIC": "Arabic", "HEBREW": "Hebrew", "DEVANAGARI": "Devanagari", "THAI": "Thai"}
_SCRIPTS = list(BANDS)


def script_of(text: str) -> str:
    """The script of most of the text's letters; "Latin" for a text without letters, ties to the first in BANDS.

    A Latin text is "Vietnamese" if one of 20 letters at least carries that language's tone marks.
    """
    if text.isascii():
        return "Latin"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    count = np.bincount(held(("fertility", "scripts"), _script_table)[codes], minlength=len(_SCRIPTS) + 1)[: len(_SCRIPTS)]
    found = _SCRIPTS[int(count.argmax())]
    return "Vietnamese" if found == "Latin" and 20 * np.count_nonzero((codes >= 0x1EA0) & (codes <= 0x1EF9)) >= count[0] > 0 else found


def _script_table() -> np.ndarray:
    """Of every code point the number of its script, one past the last for those that are no letters."""
    of = np.full(0x110000, len(_SCRIPTS), np.uint8)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            of[cp] = _SCRIPTS.index(_NAMES.get(unicodedata.name(c, "").split(" ")[0].split("-")[0], "Other"))
    return of


def _sentencepiece(path: str):
    """Encoder of words, and which ids are byte fallbacks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda words: model.encode(words, num_threads=1), [model.is_byte(i) for i in range(model.vocab_size())]


def _ranks(path: str):
    """Encoder of words, each with the blank before it, by a file of ranks, and which ids hold part of a character."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    part = [False] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            part[rank] = True
    return lambda words: [encoding.encode_ordinary(f" {w}") for w in words], part


class WordTokens:
    """The ids of single words in the vocabulary of a file (sentencepiece model or tiktoken ranks), remembered."""

    def __init__(self, path: str):
        self.encode, is_byte = (_ranks if path.endswith(".tiktoken") else _sentencepiece)(path)
        self.is_byte = np.array(is_byte)
        self.cache: dict[bytes, bytes] = {}

    def learn(self, words: Iterable[bytes]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_SIZE:
            self.cache.clear()
            new = list(words)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            found = self.encode([w.decode("utf-8", "replace") for w in part])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            raw = np.fromiter((i for f in found for i in f), "<i4", int(sizes.sum())).tobytes()
            ends = (np.cumsum(sizes) * 4).tolist()
            self.cache.update(zip(part, [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))

    def table(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words one after another, where each word's start and how many they are."""
        self.learn(words)
        found = list(map(self.cache.__getitem__, words))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), "<i4"), np.cumsum(sizes) - sizes, sizes


def word_tokens(path: str) -> WordTokens:
    """A worker's own vocabulary for that file."""
    return held(("fertility", path), lambda: WordTokens(path))


def repeated_words(ids: np.ndarray) -> int:
    """Words that stand in a window of three found twice or more; ids: a number for each word, equal for equal words."""
    if len(ids) < 4:
        return 0
    base = np.int64(int(ids.max()) + 1)
    if int(base) ** 3 < 2**63:
        key = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        pair = np.unique(ids[:-2] * base + ids[1:-1], return_inverse=True)[1]
        key = pair * base + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= twice
    return int(covered.sum())


#: What measure() returns for a text; the last three are null without a second vocabulary.
COLUMNS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "script": pa.string(), "n_tokens": pa.int64(), "chars_per_token": pa.float64(), "byte_share": pa.float64(), "token_entropy": pa.float64(), "reason": pa.string(), "chars_per_token2": pa.float64(), "byte_share2": pa.float64(), "token_entropy2": pa.float64()}
_TYPES = {pa.int64(): "long", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}


def _fertility(vocabulary: WordTokens, table: tuple, words: np.ndarray, chars: int) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte share and entropy of a text, given as numbers of words in the table."""
    flat, starts, sizes = table
    ids = gather(flat, starts[words], sizes[words])
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    count = np.bincount(ids) if len(ids) > 4_000 else np.unique(ids, return_counts=True)[1]
    p = count[count > 0] / len(ids)
    return len(ids), chars / len(ids), float(vocabulary.is_byte[ids].mean()), float(-(p * np.log2(p)).sum()) + 0.0


def measure(docs: list[str], vocabulary: WordTokens, bands: dict[str, Band] = BANDS, second: WordTokens | None = None) -> list[list]:
    """The values of COLUMNS of each text, one list per column."""
    raws = [d.encode("utf-8", "surrogatepass") for d in docs]
    split = [r.split() for r in raws]  # exactly at the bytes 09-0D and 20
    every = list(set().union(*split))
    number_of = dict(zip(every, range(len(every)), strict=True)).__getitem__
    table, other = vocabulary.table(every), second and second.table(every)
    out: list[list] = [[] for _ in COLUMNS]
    for text, raw, words in zip(docs, raws, split, strict=True):
        n = len(words)
        chars = len(text) - (len(raw) - len(raw.translate(None, _WHITE)))
        symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
        lines = [x for x in raw.split(b"\n") if x.strip(_WHITE)]
        numbers = np.fromiter(map(number_of, words), np.int64, n)
        repeats = repeated_words(numbers)
        failed = n < 50 or 100 * repeats > 50 * n
        script = script_of(text)
        tokens, per_token, share, entropy = _fertility(vocabulary, table, numbers, chars)
        more = _fertility(second, other, numbers, chars)[1:] if second else (None, None, None)
        reason = "base" if failed else None
        if not failed:
            band = bands.get(script, bands["Other"])
            reason = (
                "chars_per_token" if not band.least_chars <= per_token <= band.most_chars
                else "byte_share" if share > band.byte_share
                else "token_entropy" if not band.least_entropy <= entropy <= band.most_entropy
                else None
            )
        for column, value in zip(out, (n, chars, symbols, len(lines) - len(set(lines)), repeats, failed, reason is None, script, tokens, per_token, share, entropy, reason, *more), strict=True):
            column.append(value)
    return out


# limits learned from labelled texts

#: What is limited: column, and how far a limit lies beyond the lowest or highest hundredth at least.
LIMITED = {"chars_per_token": 0.1, "byte_share": 0.1, "token_entropy": 0.4, "chars_per_token2": 0.1, "byte_share2": 0.1, "token_entropy2": 0.4}
#: Labelled good texts that a group needs for limits of its own.
LEAST_LABELLED = 30
#: Steps of one in which values are counted for their quantiles.
STEPS = 1000


def _groups(lang: Column, script: Column) -> Column:
    """A text's groups: its language in its script, its script."""
    return F.array_compact(F.array(F.concat(lang, F.lit("/"), script), script))


def fit_limits(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", label_id_col: str = "doc_id") -> DataFrame:
    """(group, <column>_lo, <column>_hi) for LIMITED, learned from all measured texts that labels call good (quality 1, never 0 and never toxic) and that pass the base rules.

    Quantiles come from counts of values in steps of a thousandth, so they are exact to that step
    and don't depend on partitions; a group has no more counts than steps. Groups with fewer than
    LEAST_LABELLED good texts have no row. Null ids, labels and measures don't count; a text that
    several label rows call good counts once.
    """
    good = labels.filter(F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("good_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t")).filter("q = 1 and t = 0").select("good_id")
    rows = measured.filter("not base_failed").join(good, F.col(id_col) == F.col("good_id"))
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.floor(F.col(c) * STEPS).alias("step")) for c in LIMITED])).alias("v")
    rows = rows.select(F.explode(_groups(F.col(lang_col), F.col("script"))).alias("group"), *LIMITED)
    counts = rows.select("group", values).select("group", "v.*").filter("step is not null").groupBy("group", "name", "step").agg(F.count("*").alias("n"))
    every = Window.partitionBy("group", "name")
    upto = every.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = counts.withColumn("all", F.sum("n").over(every)).withColumn("upto", F.sum("n").over(upto)).filter(F.col("all") >= LEAST_LABELLED)
    at = lambda share: F.min(F.when(F.col("upto") >= F.col("all") * share, F.col("step"))) / STEPS
    found = counts.groupBy("group", "name").agg(at(0.01).alias("low"), at(0.5).alias("middle"), at(0.99).alias("high"))
    slack = reduce(lambda c, x: F.when(F.col("name") == x[0], x[1]).otherwise(c), LIMITED.items(), F.lit(0.0))
    found = found.withColumn("lo", F.col("low") - F.greatest(F.col("middle") - F.col("low"), slack)).withColumn("hi", F.col("high") + F.greatest(F.col("high") - F.col("middle"), slack))
    wide = found.groupBy("group")
    return stored(wide.agg(*[F.max(F.when(F.col("name") == c, F.col(end))).alias(f"{c}_{end}") for c in LIMITED for end in ("lo", "hi")]), "fertility-limits")


def judge(measured: DataFrame, limits: DataFrame, lang_col: str = "lang") -> DataFrame:
    """measured with group, and with kept and reason by the limits too: those of the text's language in its script, else of its script, else none.

    reason names the first rule broken: a base rule, a band, then a limit (as "limit" and the
    column). limits has one row per language and script and is broadcast up to a fixed size.
    """
    few = limits.count() <= 20_000
    own = F.broadcast(limits) if few else limits
    first, then = (own.select(F.col("group").alias(name), F.struct(*[c for c in limits.columns]).alias(f"of_{name}")) for name in ("group1", "group2"))
    rows = measured.withColumn("group1", F.concat(F.col(lang_col), F.lit("/"), F.col("script"))).withColumn("group2", F.col("script"))
    rows = rows.join(first, "group1", "left").join(then, "group2", "left").withColumn("limits", F.coalesce("of_group1", "of_group2"))
    broken = [F.when((F.col(c) < F.col(f"limits.{c}_lo")) | (F.col(c) > F.col(f"limits.{c}_hi")), F.lit(f"limit {c}")) for c in LIMITED]
    reason = F.coalesce("reason", *broken)
    rows = rows.withColumn("reason", reason).withColumn("kept", reason.isNull()).withColumn("group", F.col("limits.group"))
    return rows.drop("group1", "group2", "of_group1", "of_group2", "limits")


def _measured(rows: DataFrame, vocabulary: str, bands: dict[str, Band], second: str | None, keep_text: bool = False) -> DataFrame:
    """The columns of rows, of which text is the last (and goes, unless it is kept), and COLUMNS."""
    at = len(rows.columns) - 1
    names = rows.columns[: at + keep_text]

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            made = measure(texts(batch, at), word_tokens(vocabulary), bands, word_tokens(second) if second else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: at + keep_text], *(pa.array(v, t) for v, t in zip(made, COLUMNS.values(), strict=True))], [*names, *COLUMNS])

    schema = StructType([rows.schema[n] for n in names])
    for name, kind in COLUMNS.items():
        schema = schema.add(name, _TYPES[kind])
    return rows.mapInArrow(run, schema)


def measure_documents(df: DataFrame, vocabulary: str, bands: dict[str, Band] = BANDS, id_col: str = "doc_id", text_col: str = "text", second: str | None = None, labels: DataFrame | None = None, lang_col: str | None = None) -> DataFrame:
    """Counts, fertility and verdict of every whole text: doc_id, COLUMNS and, with labels, group.

    Words are runs without 09-0D and 20 (hexadecimal). word_chars counts code points in words,
    n_symbols the characters #*$%&|<>, n_dup_lines the lines with a word that equal an earlier
    line, n_repeat_words the words in windows of three that the text has twice or more.
    base_failed: under 50 words, or more than half of them repeated so. kept: not base_failed,
    inside the bands of the text's script and, with labels, inside the limits of its language and
    script (see fit_limits); reason names the first rule broken, else null. A null text counts as
    empty: zeros, base_failed; a null language has the limits of the script. One row per input
    row; an empty table gives an empty result; other columns are ignored. Narrow: no shuffle but
    that of the labelled texts' measures; memory follows one slice of text.
    """
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    made = _measured(rows, vocabulary, bands, second)
    if labels is None:
        return made.drop("lang")
    made = stored(made, "fertility-measures")
    return judge(made, fit_limits(made, labels)).drop("lang")


def keep_fertile(df: DataFrame, vocabulary: str, bands: dict[str, Band] = BANDS, text_col: str = "text", second: str | None = None, labels: DataFrame | None = None, id_col: str = "doc_id", lang_col: str | None = None) -> DataFrame:
    """The rows of df, all columns, whose text is kept by measure_documents().

    Null, empty and short texts go with the base rules; repeated rows are judged alike; an empty
    table gives an empty one; columns may have any names. With labels rows are written to the
    shared folder with their measures, so that texts are measured once.
    """
    others = [c for c in df.columns if c != text_col]
    own = F.struct(*[F.col(c).alias(f"own{k}") for k, c in enumerate(others)], F.lit(0).alias("own"))  # names of df can't clash with the measures
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = df.select(own.alias("own"), (F.col(id_col) if labels is not None else F.lit(None).cast("long")).alias("doc_id"), lang.alias("lang"), F.col(text_col).alias("text"))
    made = _measured(rows, vocabulary, bands, second, keep_text=True)
    if labels is not None:
        made = stored(made, "fertility-rows")
        made = judge(made, fit_limits(made.drop("own", "text"), labels))
    place = {c: f"own.own{k}" for k, c in enumerate(others)} | {text_col: "text"}
    return made.filter("kept").select(*[F.col(place[c]).alias(c) for c in df.columns])
