import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from waymark.llm import bpe, chunks, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.BytePairEncoder(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def oracle():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_library(enc, oracle):
    rng = random.Random(1)
    some = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "x" * 5000, " " * 700, "ab" * 2000, "bé'll don't 中文 \U0001f600\n\n  \n x", "\x1c a \x85 b\xa0 c", "<|endoftext|>"]
    some += ["".join(rng.choice("ab \n\t'sé1中!\xa0\x1c") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    for text, raw in zip(some, enc.encode(some), strict=True):
        ids = np.concatenate([*raw, np.empty(0, "<u4")])
        assert ids.tolist() == oracle.encode_ordinary(text), text
        assert enc.decode(ids) == text.encode()


def test_long_rows_in_segments(enc, oracle):
    rng = random.Random(3)
    words = ["".join(rng.choice(letters) for _ in range(n)) for n in (257, 300, 301, 999, 4000, 20_000) for letters in ("ab", "etaoinshrdlu", "xyzéñ中文", "x")]
    for text, raw in zip(words, enc.encode(words), strict=True):
        assert np.concatenate(raw).tolist() == oracle.encode_ordinary(text), text[:20]


def test_parts_of_long_texts_keep_ids(enc, oracle):
    text = "Some words, and 12 more.\n " * 300 + "x" * 200
    got = [x for p in chunks.text_parts(text, 100) for a in next(enc.encode([p])) for x in a]
    assert got == oracle.encode_ordinary(text)


def test_long_texts(enc, oracle, monkeypatch):
    monkeypatch.setattr(enc.codec, "step_bytes", 400)
    some = ["Some words, and 12 more.\n " * 300 + "x" * 2000, "a\u00a0b c " * 90, "", "short one", "é " * 700]
    for text, found in zip(some, enc.encode(some), strict=True):
        assert [x for a in found for x in a] == oracle.encode_ordinary(text)


def test_rows(spark, oracle):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (2, "", "y"), (3, "é" * 40, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, bpe.encode_documents(df, PATH, P.PATTERN, keep_ids=True).collect()), key=str)
    want = []
    for i, t, _ in rows:
        ids = oracle.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), ids))
    assert got == sorted(want, key=str)
    assert bpe.encode_documents(df.limit(0), PATH, P.PATTERN).count() == 0


def test_query(spark, sf, oracle):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op2_bpe_round_trip(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = np.array(oracle.encode_ordinary(docs[r.doc_id] or ""), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
