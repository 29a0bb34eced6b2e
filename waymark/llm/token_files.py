"""Token ids in flat binary files: unsigned integers, 64-bit document offsets, memory-mapped reading.

A folder holds, for each partition k of the documents in ascending order,
``tokens-k.bin`` (the ids one after another, 16 bits each if the vocabulary fits, else 32),
``tokens-k.idx`` (64-bit offsets into it, one more than documents) and ``tokens-k.ids``
(64-bit document ids), and one ``manifest.json`` with the widths and, from prefix sums of
the partitions' counts, the number of documents and ids that stand before each partition.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm._common import held, slices, texts, without_gc
from waymark.llm.chunks import ChunkCodec

#: Documents that are read at once.
READ_DOCUMENTS = 2_000
#: Stands for a null document id in the .ids files.
NO_ID = -(2**63)


class ChunkEncoder:
    """The tokenizers library's ids of whole texts (add_special_tokens=False, nothing else set), from its ids of chunks that no merge crosses."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # strings of added tokens in a text are those tokens, as the library has it; chunks that hold one go to it alone
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.added = [t.content for t in added]
        self.whole = any(t.lstrip or t.rstrip or any(c.isspace() for c in t.content) for t in added)  # such a token reaches over the places to cut
        self.size = self.tokenizer.get_vocab_size()
        self.dtype = "<u2" if self.size <= 2**16 else "<u4"
        self.token_bytes = np.zeros(self.size, np.int64)  # a byte-level token has one character for each byte
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.token_bytes[i] = len(token)
        self.codec = ChunkCodec(self._encode_new, self.dtype)

    def _encode_new(self, chunks: list[str]) -> list[bytes]:
        """Ids of single chunks. Those that start and end like words are encoded in runs and cut apart by bytes."""
        out: list[bytes | None] = [None] * len(chunks)
        words = [k for k, c in enumerate(chunks) if c[:1] == " " and c[1:2].isalpha() and c[-1].isprintable() and not c[-1].isspace() and not any(t in c for t in self.added)]
        width = int(self.dtype[-1])
        for start in range(0, len(words), 5_000):
            part = words[start : start + 5_000]
            joined = "".join([chunks[k] for k in part])
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.cumsum([len(chunks[k].encode()) for k in part])
            at = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="left") + 1
            raw, cuts = ids.tobytes(), (at * width).tolist()
            for k, a, b in zip(part, [0, *cuts], cuts, strict=False):
                out[k] = raw[a:b]
        rest = [k for k, x in enumerate(out) if x is None]
        if rest:
            for k, e in zip(rest, self.tokenizer.encode_batch_fast([chunks[k] for k in rest], add_special_tokens=False), strict=True):
                out[k] = np.array(e.ids, self.dtype).tobytes()
        return out

    def encode(self, docs: list[str]) -> Iterator[list[np.ndarray]]:
        """For each text its ids in the file's width, in arrays that follow each other."""
        if self.whole:
            return ([np.array(e.ids, self.dtype)] for e in self.tokenizer.encode_batch_fast(docs, add_special_tokens=False))
        return self.codec.encode(docs)


def chunk_encoder(path: str) -> ChunkEncoder:
    """A worker's own encoder for that file."""
    return held(("token_files", path), lambda: ChunkEncoder(path))


def _file(folder: str, name: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, f"{path.rstrip('/')}/{name}"


def _put(folder: str, name: str, data: bytes) -> None:
    fs, path = _file(folder, name)
    with fs.open_output_stream(tmp := f"{path}.{uuid.uuid4().hex}") as out:
        out.write(data)
    fs.move(tmp, path)


class Numbers:
    """A file's numbers by range: mapped into memory where the store is a file system, else read where they are asked for."""

    def __init__(self, folder: str, name: str, dtype: str):
        fs, path = _file(folder, name)
        self.dtype, self.mapped, self.file = np.dtype(dtype), None, None
        if isinstance(fs, pafs.LocalFileSystem):
            self.size = os.path.getsize(path) // self.dtype.itemsize
            self.mapped = np.memmap(path, dtype, "r") if self.size else np.empty(0, dtype)
        else:
            self.file = fs.open_input_file(path)
            self.size = self.file.size() // self.dtype.itemsize

    def part(self, start: int, stop: int) -> np.ndarray:
        if self.mapped is not None:
            return self.mapped[start:stop]
        stop = min(stop, self.size)
        return np.frombuffer(self.file.read_at((stop - start) * self.dtype.itemsize, start * self.dtype.itemsize), self.dtype)


def write_token_files(df: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Encode every whole text, append end_id to each and write the folder; returns the manifest.

    Documents stand in ascending order of id (null first; rows of one id in the order of a
    hash of their text, then of the text). The texts are dealt out by range, so partitions
    follow the order; a task writes its files under other names and renames them when they
    are whole, so a repeated or speculative task leaves the same files. Only one row of
    counts per partition comes to the driver. A null text is an empty document (end_id
    alone); an empty table gives a manifest without parts; other columns are ignored.
    The folder must be one that all executors reach, under a scheme that pyarrow's file systems know.
    """
    fs, path = pafs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("hash"))
    dealt = docs.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text")

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc = chunk_encoder(tokenizer_path)
        end = np.array([end_id], enc.dtype).tobytes()
        where, final = _file(folder, f"tokens-{part:06d}.bin")
        tmp, sizes, ids = f"{final}.{uuid.uuid4().hex}", [], []
        with where.open_output_stream(tmp) as out:
            for batch in slices(batches, 1):
                for ids_of in enc.encode(texts(batch, 1)):
                    for part_ids in ids_of:
                        out.write(part_ids.tobytes())
                    out.write(end)
                    sizes.append(sum(x.nbytes for x in ids_of) + len(end))
                ids.append(batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False))
        where.move(tmp, final)
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]) // int(enc.dtype[-1])
        _put(folder, f"tokens-{part:06d}.idx", offsets.astype("<i8").tobytes())
        _put(folder, f"tokens-{part:06d}.ids", np.concatenate([*ids, np.empty(0, np.int64)]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(sizes)], pa.int64()), pa.array([int(offsets[-1])], pa.int64())], ["part", "n_docs", "n_tokens"])

    counts = sorted(tuple(r) for r in dealt.select("doc_id", "text").mapInArrow(run, "part int, n_docs long, n_tokens long").collect())
    size = chunk_encoder(tokenizer_path).size
    manifest = {"dtype": "<u2" if size <= 2**16 else "<u4", "vocabulary": size, "end_id": end_id, "parts": []}
    docs_before = tokens_before = 0
    for part, n_docs, n_tokens in counts:
        manifest["parts"].append({"part": part, "n_docs": n_docs, "n_tokens": n_tokens, "docs_before": docs_before, "tokens_before": tokens_before})
        docs_before, tokens_before = docs_before + n_docs, tokens_before + n_tokens
    _put(folder, "manifest.json", json.dumps(manifest).encode())
    return manifest


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """The documents of a folder, one task per partition file: (doc_id, start, n_tokens, ids_crc32[, ids]).

    start counts the ids of all documents before it over the whole folder, ids_crc32 is the
    unsigned crc32 of the document's ids as little-endian unsigned 32-bit integers. Null ids
    and repeated ones come back as they were written, a null or empty text as its end id; a
    folder without parts gives no rows. Files in a store that can't be mapped are read a few
    thousand documents at a time.
    """
    fs, path = _file(folder, "manifest.json")
    with fs.open_input_file(path) as f:
        manifest = json.loads(f.read())
    parts, dtype = manifest["parts"], manifest["dtype"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name = f"tokens-{parts[k]['part']:06d}"
                tokens, offsets, ids = (Numbers(folder, f"{name}.{end}", kind) for end, kind in (("bin", dtype), ("idx", "<i8"), ("ids", "<i8")))
                for at in range(0, ids.size, READ_DOCUMENTS):
                    own = offsets.part(at, at + READ_DOCUMENTS + 1)
                    doc = np.asarray(ids.part(at, at + READ_DOCUMENTS))
                    here = tokens.part(int(own[0]), int(own[-1]))
                    bounds = list(zip((own[:-1] - own[0]).tolist(), (own[1:] - own[0]).tolist(), strict=True))
                    crc = [zlib.crc32(here[a:b].astype("<u4").tobytes()) for a, b in bounds]
                    arrays = [pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(own[:-1] + parts[k]["tokens_before"], pa.int64()), pa.array(np.diff(own), pa.int64()), pa.array(crc, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        arrays.append(pa.array([here[a:b].astype(np.int32) for a, b in bounds], pa.list_(pa.int32())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(arrays, names)

    one_each = spark.range(0, len(parts), 1, max(1, len(parts)))
    return one_each.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
