"""SentencePiece BPE by backtracking over longest matches.

A sequence of pieces is the BPE encoding of a text exactly if every two neighbours, joined and
merged again, give these two: merges inside a region don't depend on what lies beyond its ends
until one crosses an end. So the encoder takes the longest piece that starts where the last one
ended (all longest matches come from one Aho-Corasick pass), checks it against the piece before
by re-merging the two, falls back to the piece's next shorter prefix, and gives a place up, in a
bitfield of failed places, when no piece is left. As the encoding of a prefix is unique, a place
that failed once fails for every way there. Characters without a piece become their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import held, slices, texts, without_gc
from waymark.llm.chunks import ChunkCodec, gather

#: What stands for a space inside pieces.
SPACE = "▁"
#: Chunks that a worker remembers, pairs of pieces whose check it remembers, and bytes of one step: small, as a worker shares an executor's memory with the JVM.
TABLE_SIZE, PAIRS, STEP_BYTES = 200_000, 500_000, 500_000

_NO_RANK = 1 << 60


class PieceEncoder:
    """Encoder and decoder for a sentencepiece model of type BPE with byte fallback and no user-defined pieces.

    Pairs whose concatenation is a piece merge, highest score first, of equal scores the leftmost.
    """

    def __init__(self, model_file: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(model_file, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = sentencepiece_model_pb2.ModelProto.SentencePiece
        kinds_of = [p.type for p in spec.pieces]
        if spec.trainer_spec.model_type != sentencepiece_model_pb2.TrainerSpec.BPE or kinds.USER_DEFINED in kinds_of or kinds.UNUSED in kinds_of or not spec.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback, without user-defined or unused pieces, is needed")
        norm = spec.normalizer_spec
        self.dummy = norm.add_dummy_prefix
        # other rules than a space in front are left to the library's own normaliser
        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not spec.trainer_spec.treat_whitespace_as_suffix
        self.strips = self.dummy or norm.remove_extra_whitespaces

        self.pieces = [p.piece for p in spec.pieces]
        self.ids = {p: k for k, p in enumerate(self.pieces) if kinds_of[k] == kinds.NORMAL}
        scores = sorted({spec.pieces[k].score for k in self.ids.values()}, reverse=True)
        rank_of = {s: r for r, s in enumerate(scores)}
        self.rank = {p: rank_of[spec.pieces[k].score] for p, k in self.ids.items()}
        self.of_byte = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if kinds_of[k] == kinds.BYTE}
        self.is_byte = np.array([k == kinds.BYTE for k in kinds_of])

        # pieces that the merges of their own characters lead to; no other can stand in an encoding
        self.size = [len(p) for p in self.pieces]
        reached = {p: k for p, k in self.ids.items() if len(p) == 1 or self._merge(p) == [p]}
        self.shorter = [-1] * len(self.pieces)
        for p, k in reached.items():
            self.shorter[k] = next((reached[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in reached), -1)
        self.matcher = ahocorasick.Automaton()
        for p, k in reached.items():
            self.matcher.add_word(p, k)
        self.matcher.make_automaton()
        self.agree: dict[tuple[int, int], bool] = {}

        def surface(k: int, p: str) -> bytes:
            if kinds_of[k] == kinds.BYTE:
                return bytes([int(p[3:5], 16)])
            if kinds_of[k] == kinds.UNKNOWN:
                return spec.trainer_spec.unk_surface.encode()
            return b"" if kinds_of[k] == kinds.CONTROL else p.replace(SPACE, " ").encode()

        surfaces = [surface(k, p) for k, p in enumerate(self.pieces)]
        self.decoded, self.decoded_start, self.decoded_size = self._flat(surfaces)
        self.blank_first = np.array([p.startswith(SPACE) for p in self.pieces])
        self.decimal, self.decimal_start, self.decimal_size = self._flat([f"{k},".encode() for k in range(len(self.pieces))])
        # where no piece holds a space after another character, no merge crosses a word's beginning
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.codec = ChunkCodec(self.encode_chunks, "<u4", TABLE_SIZE, STEP_BYTES)

    @staticmethod
    def _flat(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size, size

    # merging

    def _merge(self, text: str, wall: int = 0) -> list[str] | None:
        """What the merges of a short text's characters lead to; None as soon as one crosses the place wall (0: none)."""
        parts, rank = list(text), self.rank.get
        ranks = [rank(a + b, _NO_RANK) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == _NO_RANK:
                break
            i = ranks.index(low)
            if wall:  # characters before the pair, and with its left part
                before = sum(map(len, parts[: i + 1]))
                if before == wall:
                    return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], _NO_RANK)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], _NO_RANK)
        return parts

    def _agree(self, a: int, b: int) -> bool:
        """Whether the two pieces, joined and merged again, stay these two."""
        found = self.agree.get((a, b))
        if found is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            left, right = self.pieces[a], self.pieces[b]
            found = self.agree[a, b] = self._merge(left + right, len(left)) == [left, right]
        return found

    # chunks -> ids

    def encode_piecewise(self, text: str) -> list[int]:
        """Ids of a normalised text whose spaces are SPACE."""
        n = len(text)
        longest = [-1] * n
        size, shorter, agree = self.size, self.shorter, self._agree
        for end, k in self.matcher.iter(text):  # of the matches with one start the longest ends last
            longest[end + 1 - size[k]] = k
        failed = bytearray((n >> 3) + 1)
        out: list[int] = []  # ids; an unknown character as -1 less its code point
        at = 0
        token = longest[0] if n else -1
        while at < n:
            if token < 0 and longest[at] < 0:
                out.append(-1 - ord(text[at]))  # in no piece, so no merge reaches over it
                at += 1
                token = longest[at] if at < n else -1
                continue
            while token >= 0:
                end = at + size[token]
                if not failed[end >> 3] >> (end & 7) & 1 and (not out or out[-1] < 0 or agree(out[-1], token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                failed[at >> 3] |= 1 << (at & 7)
                token = out.pop()  # a shorter one in its place: this one's end has failed now
                at -= size[token]
        if not out or min(out) >= 0:
            return out
        of_byte = self.of_byte
        return [j for k in out for j in ((k,) if k >= 0 else [of_byte[b] for b in chr(-1 - k).encode()])]

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        return [np.array(self.encode_piecewise(c.replace(" ", SPACE)), "<u4").tobytes() for c in chunks]

    def encode(self, docs: list[str]) -> Iterator[list[np.ndarray]]:
        """For each text its ids, in arrays that follow each other."""
        if self.plain:
            ready = [(" " * self.dummy + t.replace(SPACE, " ")) if t else "" for t in docs]
        else:
            ready = [self.library.normalize(t).replace(SPACE, " ") for t in docs]
        if self.cuts:
            return self.codec.encode(ready)
        return ([np.frombuffer(x, "<u4")] for x in self.encode_chunks(ready))

    # ids -> text

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, a comma after each."""
        return gather(self.decimal, self.decimal_start[ids], self.decimal_size[ids]).tobytes()

    def decode(self, parts: list[np.ndarray]) -> bytes:
        """The text of ids, as UTF-8; bytes that form no character become U+FFFD, one each, as in the library."""
        ids = np.concatenate([*parts, np.empty(0, "<u4")])
        raw = gather(self.decoded, self.decoded_start[ids], self.decoded_size[ids]).tobytes()
        sized = np.flatnonzero(self.decoded_size[ids] > 0)
        if self.strips and len(sized) and self.blank_first[ids[sized[0]]]:
            raw = raw[1:]  # the space in front of the text
        if not self.is_byte[ids].any():
            return raw
        try:
            raw.decode()
            return raw if len(sized) == len(ids) else self._mended(ids)  # an id without text ends a run of bytes
        except UnicodeDecodeError:
            return self._mended(ids)

    def _mended(self, ids: np.ndarray) -> bytes:
        out, run, first = [], bytearray(), True

        def end_run() -> None:
            k = 0
            while k < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[k : k + n]).decode().encode())
                        k += n
                        break
                    except UnicodeDecodeError:
                        pass
                else:
                    out.append("�".encode())
                    k += 1
            run.clear()

        for k in ids.tolist():
            piece = self.decoded[self.decoded_start[k] : self.decoded_start[k] + self.decoded_size[k]].tobytes()
            if self.is_byte[k]:
                run += piece
            else:
                end_run()
                out.append(piece[1:] if first and self.strips and self.blank_first[k] else piece)
            first = first and not piece
        end_run()
        return b"".join(out)


def encoder(model_file: str) -> PieceEncoder:
    """A worker's own encoder for that model."""
    return held(("pieces", model_file), lambda: PieceEncoder(model_file))


def encode_documents(df: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    ids_sha256 is the digest of the decimal ids joined by commas, decoded_sha256 that of the text
    they decode to; with keep_ids the ids follow as an array. One row per input row, repeated rows
    and ids included, null ids kept; a null text counts as empty: no tokens, the digests of nothing.
    An empty table gives an empty result; other columns are ignored, whatever their names. Narrow:
    no shuffle; memory follows one slice of text (or the longest text), not the table.
    """
    columns = f"doc_id {df.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_file)
        for batch in slices(batches, 1):
            count, digest, back, kept = [], [], [], []
            for parts in enc.encode(texts(batch, 1)):
                decimal = b"".join(map(enc.decimals, parts))
                count.append(sum(map(len, parts)))
                digest.append(hashlib.sha256(decimal[:-1]).hexdigest())
                back.append(hashlib.sha256(enc.decode(parts)).hexdigest())
                if keep_ids:
                    kept.append(np.concatenate([*parts, np.empty(0, "<u4")]).astype(np.int32))
            arrays = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, columns)
