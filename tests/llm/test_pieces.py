import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from waymark.llm import pieces, queries

PATH = P.path("piece_bpe_32k.model")
EMPTY = hashlib.sha256(b"").hexdigest()


@pytest.fixture(scope="module")
def enc():
    return pieces.PieceEncoder(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def _ids(enc, texts):
    return [np.concatenate([*parts, np.empty(0, "<u4")]).tolist() for parts in enc.encode(texts)]


def _same(enc, library, texts):
    for text, ids in zip(texts, _ids(enc, texts), strict=True):
        assert ids == library.encode(text), text[:80]
        assert enc.decode([np.array(ids, "<u4")]) == library.decode(ids).encode(), text[:80]


def test_ids_equal_the_library(enc, library):
    rng = random.Random(1)
    some = ["", " ", "  ", "a", " a", "a ", "a  b", "\n", "a\n b", "▁", "▁ a", "a ▁b", "a▁b", "\x00", "a\x00b", "\x1c a \x85 b\xa0 c", "<s> </s> <unk> <0x41>", "é́ ﬁ Ａ ﻿", "中文字 \U0001f600 漢", "x" * 5000, " " * 700, "ab" * 3000, "  " * 33 + "x", "the quick brown fox " * 50]
    some += [" " * k for k in range(1, 70)] + ["　" * k + "a" for k in range(4)]
    some += ["".join(rng.choice("ab \n\t'sé1中!\xa0\x1c▁") for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    some += ["".join(rng.choice("etaoinshrdlu ") for _ in range(rng.randint(1, 300))) for _ in range(1000)]
    some += ["".join(rng.choice("0123456789,.;:-_/()[]{}<>=+*&^%$#@!~`|\\\"' \n") for _ in range(60)) for _ in range(500)]
    _same(enc, library, some)


def test_texts_of_joined_pieces(enc, library):
    """Pieces in any order: neighbours that would merge across their border, and ways that have to be given up."""
    rng = random.Random(2)
    names = [p for p in enc.ids if not p.startswith("<")]
    _same(enc, library, ["".join(rng.choice(names) for _ in range(rng.randint(1, 12))).replace("▁", " ") for _ in range(5000)])
    few = [p for p in names if set(p) <= set("▁aeinst")]
    _same(enc, library, ["".join(rng.choice(few) for _ in range(rng.randint(1, 30))).replace("▁", rng.choice([" ", ""])) for _ in range(5000)])


def test_backtracking_happens(enc, library):
    """Longest matches alone give other ids in some of these texts, so the way back is walked."""
    rng, longest_only = random.Random(3), 0
    some = [" " + "".join(rng.choice("etaoinsh") for _ in range(60)) for _ in range(300)]
    for text, ids in zip(some, _ids(enc, some), strict=True):
        at, greedy, whole = 0, [], "▁" + text.replace(" ", "▁")
        while at < len(whole):
            piece = next(whole[at : at + n] for n in range(16, 0, -1) if whole[at : at + n] in enc.ids)
            greedy.append(enc.ids[piece])
            at += len(piece)
        longest_only += greedy != ids
        assert ids == library.encode(text)
    assert longest_only > 100


def test_decoding_of_any_ids(enc, library):
    rng = random.Random(4)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), rng.randrange(259, 300), 28705, 0, 1]) for _ in range(rng.randint(0, 8))]
        assert enc.decode([np.array(ids, "<u4")]) == library.decode(ids).encode(), ids


def test_long_texts_in_parts(enc, library, monkeypatch):
    monkeypatch.setattr(enc.codec, "step_bytes", 400)
    some = ["Some words, and 12 more.\n " * 300 + "x" * 2000, "a b c " * 90, "", "short one", "é " * 700, "▁ ▁a" * 300, "中" * 900 + " b"]
    _same(enc, library, some)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(PATH, "rb").read())
    spec.trainer_spec.byte_fallback = False
    (tmp_path / "other.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.PieceEncoder(str(tmp_path / "other.model"))


def test_rows(spark, library):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, None, None), (2, "", "y"), (3, "é漢" * 40, "z"), (4, "long words " * 20_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, pieces.encode_documents(df, PATH, keep_ids=True).collect()), key=str)
    want = []
    for i, text, _ in rows:
        ids = library.encode(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest() if ids else EMPTY, ids))
    assert got == sorted(want, key=str)
    assert pieces.encode_documents(df.limit(0), PATH).collect() == []


def test_query(spark, sf, library):
    got = {r.doc_id: r for r in queries.op13_piece_round_trip(spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, text in rows:
        ids = library.encode(text or "")
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
