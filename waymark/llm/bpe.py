"""Byte-level BPE on length-bucketed padded matrices.

Words that the split pattern finds are made distinct and laid out by
byte length as rows of integer matrices. In each round every row looks up the ranks of its
adjacent pairs in a hashed table, merges its leftmost pair of the lowest rank and is
compacted by one column; rows without a mergeable pair leave the matrix. Long rows lie in
matrices of segments: a round looks for the pair among the segments' lowest ranks and then in
one segment, and a row is compacted when half of it is merged away. Decoding gathers the
tokens' bytes from one flat array.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm._common import held, slices, texts, without_gc
from waymark.llm.chunks import ChunkCodec

#: Rows of more bytes than this lie in matrices of segments: same order of merges, without the square of their length.
SEGMENTED_FROM = 256
#: Cells of one matrix.
MATRIX_CELLS = 400_000
#: Chunks that a worker's table knows at most, and bytes of one step: small, as a worker shares an executor's memory with the JVM.
TABLE_SIZE, STEP_BYTES = 200_000, 500_000

_NO_RANK = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from a pair of token ids to the id that they merge into."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, _NO_RANK, np.int32)
        self.probes = 0
        at, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # place the first of each slot's claimants, move the others on
            free = self.values[at] == _NO_RANK
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[todo[won]], merged[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged ids, in the shape of left; _NO_RANK where a pair doesn't merge."""
        shape = left.shape
        keys = ((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)).ravel()
        at = self._slot(keys)
        hit = self.keys[at] == keys
        out = np.where(hit, self.values[at], _NO_RANK)
        todo = np.flatnonzero(~hit & (self.values[at] != _NO_RANK))
        at = at[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at] == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            more = ~hit & (self.values[at] != _NO_RANK)
            todo, at = todo[more], at[more]
        return out.reshape(shape)


class BytePairEncoder:
    """Encoder and decoder for a file of ranks (base64 token, rank per line) and a split pattern.

    Ids are ranks. Any two tokens whose bytes together are a token merge, in the order of
    that token's rank, the leftmost first; a word that is itself a token is that token.
    """

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in self.ranks.items() for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        left, right, merged = np.array(pairs, np.int64).reshape(-1, 3).T
        self.table = PairTable(left, right, merged.astype(np.int32))
        self.whole = {t: r.to_bytes(4, "little") for t, r in self.ranks.items()} | {b"": b""}
        self.codec = ChunkCodec(self.encode_chunks, "<u4", TABLE_SIZE, STEP_BYTES)

    # words -> ids

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """For each word, in order, its ids as little-endian unsigned 32-bit integers."""
        whole = self.whole.get
        out: list[bytes | None] = [whole(w) for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        todo = np.array([i for i, x in enumerate(out) if x is None], np.int64)
        order = todo[np.argsort(lengths[todo], kind="stable")]
        start = 0
        while start < len(order):  # buckets: rows of like length, so that little is padding
            width = int(lengths[order[start]])
            limit = width if width < 24 else width + width // 8
            if width <= SEGMENTED_FROM:
                limit = min(limit, SEGMENTED_FROM)
            stop = int(np.searchsorted(lengths[order], limit, side="right"))
            width = int(lengths[order[stop - 1]])
            stop = min(stop, start + max(1, MATRIX_CELLS // width))
            merge = self._merge_matrix if width <= SEGMENTED_FROM else self._merge_segments
            merge([words[i] for i in order[start:stop]], lengths[order[start:stop]], width, out, order[start:stop])
            start = stop
        return out

    def _merge_matrix(self, words: list[bytes], lengths: np.ndarray, width: int, out: list, rows: np.ndarray) -> None:
        if int(lengths.min()) == width:
            raw = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), width)
        else:
            raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        ids, n = self.of_byte[raw], lengths.copy()
        columns = np.arange(width)
        ranks = self.table.find(ids[:, :-1], ids[:, 1:])
        ranks[columns[None, 1:] >= n[:, None]] = _NO_RANK
        while len(rows):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            low = ranks[np.arange(len(rows)), best] if ranks.shape[1] else np.full(len(rows), _NO_RANK)
            done = low == _NO_RANK
            if done.any():
                raw, row_bytes = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (row, size) in enumerate(zip(rows[done].tolist(), (4 * n[done]).tolist(), strict=True)):
                    out[row] = raw[k * row_bytes : k * row_bytes + size]
                keep = ~done
                rows, ids, n, ranks, best, low = rows[keep], ids[keep], n[keep], ranks[keep], best[keep], low[keep]
                if not len(rows):
                    return
                widest = int(n.max())
                ids, ranks = ids[:, :widest], ranks[:, : widest - 1]
            each, cols = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
            shift = cols[None, :] > best[:, None]  # compaction: what stands right of the merged pair moves left by one
            ids = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[each, best] = low
            ranks = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            n = n - 1
            for at in (best - 1, best):  # only the two pairs with the new token have new ranks
                ok = np.flatnonzero((at >= 0) & (at + 1 < n))
                if len(ok):
                    ranks[ok, at[ok]] = self.table.find(ids[ok, at[ok]], ids[ok, at[ok] + 1])
            last = np.flatnonzero(n - 1 < ranks.shape[1])
            ranks[last, n[last] - 1] = _NO_RANK

    def _merge_segments(self, words: list[bytes], lengths: np.ndarray, width: int, out: list, rows: np.ndarray) -> None:
        """The same merges for long rows: a round costs a row the number and the size of its segments."""
        n = lengths.copy()
        ids = self.of_byte[np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)]
        while len(rows):
            size = max(8, int(np.sqrt(width)))
            width = -(-width // size) * size
            ids = np.pad(ids, ((0, 0), (0, width - ids.shape[1])))
            ranks = np.full(ids.shape, _NO_RANK, np.int32)
            ranks[:, :-1] = self.table.find(ids[:, :-1], ids[:, 1:])
            ranks[np.arange(width)[None, :] + 1 >= n[:, None]] = _NO_RANK
            segments = ranks.reshape(len(rows), -1, size)
            lowest = segments.min(axis=2)
            live = np.arange(width)[None, :] < n[:, None]
            after = np.broadcast_to(np.arange(1, width + 1), ids.shape).copy()
            before = np.broadcast_to(np.arange(-1, width - 1), ids.shape).copy()
            every, end = np.arange(len(rows)), n
            for _ in range(max(1, width // 2)):  # then what is merged away is dropped
                k = lowest[every].argmin(axis=1)
                low = lowest[every, k]
                every, k, low = every[low != _NO_RANK], k[low != _NO_RANK], low[low != _NO_RANK]
                if not len(every):
                    break
                i = k * size + segments[every, k].argmin(axis=1)
                j = after[every, i]
                beyond, ahead = after[every, j], before[every, i]
                ids[every, i], after[every, i], live[every, j], ranks[every, j] = low, beyond, False, _NO_RANK
                on = beyond < end[every]
                before[every[on], beyond[on]] = i[on]
                ranks[every, i] = _NO_RANK
                ranks[every[on], i[on]] = self.table.find(low[on], ids[every[on], beyond[on]])
                off = ahead >= 0
                ranks[every[off], ahead[off]] = self.table.find(ids[every[off], ahead[off]], low[off])
                for e, at in ((every, i), (every, j), (every[off], ahead[off])):
                    lowest[e, at // size] = segments[e, at // size].min(axis=1)
            more = lowest.min(axis=1) != _NO_RANK
            for row in np.flatnonzero(~more):
                out[rows[row]] = ids[row][live[row]].astype("<u4").tobytes()
            rows, n = rows[more], live[more].sum(axis=1)
            if len(rows):
                width = int(n.max())
                packed = np.zeros((len(rows), width), ids.dtype)
                packed[np.arange(width)[None, :] < n[:, None]] = ids[more][live[more]]
                ids = packed

    # texts -> ids

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """For each chunk the ids of the words that the pattern finds in it, each distinct word merged once."""
        found = list(map(self.pattern.findall, chunks))
        words = list(set().union(*found))
        ids = dict(zip(words, self.encode_words([w.encode() for w in words]), strict=True))
        return [ids[f[0]] if len(f) == 1 else b"".join(map(ids.__getitem__, f)) for f in found]

    def encode(self, docs: list[str]) -> Iterator[list[np.ndarray]]:
        """For each text its ids, in arrays that follow each other."""
        return self.codec.encode(docs)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        n = self.lengths[ids]
        total = int(n.sum())
        shift = np.repeat(self.starts[ids] - (np.cumsum(n) - n), n)
        return self.flat[shift + np.arange(total)].tobytes()


def encoder(rank_file: str, pattern: str) -> BytePairEncoder:
    """A worker's own encoder for that file."""
    return held(("bpe", rank_file, pattern), lambda: BytePairEncoder(rank_file, pattern))


def encode_documents(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode every whole text and decode the ids again: (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]).

    ids_sha256 is the digest of the ids as little-endian unsigned 32-bit integers,
    decoded_sha256 that of the bytes they decode to. With keep_ids the ids follow as
    an array of integers. One row per input row, repeated rows and ids included, null ids
    kept; a null text counts as empty: no tokens, the digests of no bytes. An empty table
    gives an empty result. Other columns of the input are ignored, whatever their names.
    Narrow: no shuffle; memory follows one slice of text (or the longest text), not the table.
    """
    id_type = df.schema[id_col].dataType
    columns = f"doc_id {id_type.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(rank_file, pattern)
        for batch in slices(batches, 1):
            count, digest, back, kept = [], [], [], []
            for found in enc.encode(texts(batch, 1)):
                one, two, n = hashlib.sha256(), hashlib.sha256(), 0
                for part in found:
                    one.update(part.tobytes())
                    two.update(enc.decode(part))
                    n += len(part)
                count.append(n)
                digest.append(one.hexdigest())
                back.append(two.hexdigest())
                if keep_ids:
                    kept.append(np.concatenate([*found, np.empty(0, "<u4")]).astype(np.int32))
            arrays = [batch.column(0), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, columns)
