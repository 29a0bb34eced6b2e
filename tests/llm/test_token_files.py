import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from waymark.llm import queries, token_files
from waymark.llm._common import fresh_path

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def oracle():
    t = Tokenizer.from_file(PATH)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 2]


def test_edge_rows(spark, oracle):
    rows = [(5, "b  c\n\n d", 1), (None, None, 2), (3, "", 3), (5, "b  c\n\n d", 4), (-7, "<|endoftext|> x" * 50, 5), (3, "é中", 6), (-9, "a <|endoftext|> b c<|endoftext|>d  <|endoftext|>", 7), (-8, "long words of text and " * 3000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    folder = fresh_path(spark, "tokens-test")
    token_files.write_token_files(df, folder, PATH, 2)
    got = sorted(token_files.read_token_files(spark, folder, True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -9, -8, -7, 3, 3, 5, 5]
    assert got[1].ids[:5] == [64, 220, 50256, 275, 269]
    assert sorted(tuple(r.ids) for r in got) == sorted(tuple(oracle(t)) for _, t, _ in rows)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    empty = fresh_path(spark, "tokens-test")
    assert sum(p["n_docs"] for p in token_files.write_token_files(df.limit(0), empty, PATH, 2)["parts"]) == 0
    assert token_files.read_token_files(spark, empty).count() == 0


def test_query(spark, sf, oracle):
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(map(tuple, queries.op5_token_files(spark, sf).collect()))
    at, want = 0, []
    for d in docs:
        ids = np.array(oracle(d.text), "<u4")
        want.append((d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want


def test_reading_by_range(spark, oracle, monkeypatch):
    """A store that can't be mapped is read a few documents at a time, with the same result."""
    rows = [(k, f"text number {k} " * (k % 7)) for k in range(50)]
    folder = fresh_path(spark, "tokens-test")
    token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), folder, PATH, 2)
    name = "tokens-000000"
    mapped = token_files.Numbers(folder, f"{name}.bin", "<u2")
    monkeypatch.setattr(token_files.pafs, "LocalFileSystem", type(None))
    read = token_files.Numbers(folder, f"{name}.bin", "<u2")
    assert read.mapped is None and read.size == mapped.size
    assert (read.part(3, 20) == mapped.part(3, 20)).all() and len(read.part(5, 10**9)) == mapped.size - 5
