"""Token ids of whole texts from those of their distinct chunks, on arrays.

Texts are cut at single spaces that no match of a GPT-2-like split pattern crosses. All
chunks of a slice are hashed at once, looked up in a hashed table of known chunks, and
compared byte by byte with what was found, so a colliding hash can't pass; only chunks that
the table lacks are encoded, each distinct one once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import regex

#: Known chunks at most, unless an operator asks for another number; those met later are encoded in each step that has them.
TABLE_SIZE = 700_000
#: Bytes of text in one step; a part of a text without a place to cut may be longer and is encoded by itself.
STEP_BYTES = 1_500_000

#: A place between two characters that no match of a GPT-2-like pattern crosses: non-space, then a single space, then non-space.
_CUT = regex.compile(r"(?<=\S)(?= \S)")
_ODD_SPACE = regex.compile(r"[^\S ] | [^\S ]|  |[\x1c-\x1f\x85]")

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
# White space beyond ASCII; texts that hold one are cut by the slower pattern.
_WIDE_SPACE = [c.encode() for c in "\x85\xa0     　"] + [b"\xe2\x80" + bytes([k]) for k in range(0x80, 0x8B)]


def chunks_of(text: str) -> list[str]:
    """The text cut at spaces that no match of the pattern crosses."""
    if _ODD_SPACE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    if not first and rest:  # a leading space belongs to the first word
        first, *rest = " " + rest[0], *rest[1:]
    out = [" " + x for x in rest]
    out.insert(0, first)
    if out[-1] == " " and len(out) > 1:  # a trailing space stands alone
        out[-2:] = [out[-2] + " "]
    return out


def text_parts(text: str, most: int) -> Iterator[str]:
    """A long text in parts that end where no match of the pattern crosses; a text without such a place stays whole."""
    start = 0
    while len(text) - start > most:
        found = _CUT.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def _powers(base: int, n: int) -> np.ndarray:
    """base ** (0 ... n - 1) modulo 2 ** 64."""
    out = np.ones(n, np.uint64)
    out[1:] = np.uint64(base)
    return np.cumprod(out, dtype=np.uint64)


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of all, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]


class ChunkCodec:
    """Encodes texts; encode_new gives, for distinct chunks, their ids as bytes of dtype."""

    def __init__(self, encode_new: Callable[[list[str]], list[bytes]], dtype: str, table_size: int | None = None, step_bytes: int | None = None):
        self.encode_new, self.dtype = encode_new, np.dtype(dtype)
        self.table_size, self.step_bytes = table_size or TABLE_SIZE, step_bytes or STEP_BYTES
        self.bits = int(np.ceil(np.log2(2 * self.table_size)))
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.entry = np.full(1 << self.bits, -1, np.int32)
        self.probes = 0
        self.text, self.ids = np.empty(0, np.uint8), np.empty(0, self.dtype)
        self.text_start = self.text_size = self.ids_start = self.ids_size = np.empty(0, np.int64)
        self.up, self.down = _powers(_BASE, self.step_bytes), _powers(_INVERSE, self.step_bytes)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.entry[at].astype(np.int64)
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        out[todo] = -1
        at = at[todo]
        for _ in range(self.probes):
            if not len(todo):
                break
            at = (at + 1) & ((1 << self.bits) - 1)
            used = self.entry[at] >= 0
            hit = used & (self.keys[at] == keys[todo])
            out[todo[hit]] = self.entry[at[hit]]
            more = used & ~hit
            todo, at = todo[more], at[more]
        return out

    def _put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        todo, at, rounds = np.arange(len(keys)), (keys >> np.uint64(64 - self.bits)).astype(np.int64), 0
        while len(todo):
            free = self.entry[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.entry[slots] = keys[todo[won]], entries[todo[won]]
            rest = np.ones(len(todo), bool)
            rest[won] = False
            todo, at = todo[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            rounds += 1
        self.probes = max(self.probes, rounds)

    def _step(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after another, and the number of ids of each part."""
        raw = b"".join(parts)
        buf = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        space = _SPACE[buf]
        cut = np.zeros(len(buf), bool)
        if len(buf) > 2:
            cut[1:-1] = (buf[1:-1] == 32) & ~space[:-2] & ~space[2:]
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        cut[first] = True
        start = np.flatnonzero(cut)
        size = np.diff(np.append(start, len(buf)))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * self.up[: len(buf)], out=sums[1:])
        key = (sums[start + size] - sums[start]) * self.down[start]
        key ^= key >> np.uint64(32)  # the high bits choose the place
        key *= np.uint64(0xD6E8FEB86659FD93)

        entry = self._find(key)
        known = entry >= 0
        miss = np.flatnonzero(~known)
        new_keys, sample, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
        sample = miss[sample]
        n = len(self.text_start)
        entry[miss] = n + inverse
        new_text = gather(buf, start[sample], size[sample])
        text = np.concatenate([self.text, new_text])
        text_size = np.concatenate([self.text_size, size[sample]])
        text_start = np.cumsum(text_size) - text_size

        odd = text_size[entry] != size
        if not odd.any():
            same = gather(text, text_start[entry], size) == buf
            odd = np.add.reduceat(~same, start) > 0 if len(start) else odd
        chunks = [raw[a : a + b].decode() for a, b in zip(start[sample].tolist(), size[sample].tolist(), strict=True)]
        wrong = np.flatnonzero(odd)  # another chunk of the same hash: encoded by itself
        found = self.encode_new(chunks + [raw[start[k] : start[k] + size[k]].decode() for k in wrong])
        new_ids = np.frombuffer(b"".join(found), self.dtype)
        ids = np.concatenate([self.ids, new_ids])
        ids_size = np.concatenate([self.ids_size, np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize])
        ids_start = np.cumsum(ids_size) - ids_size
        entry[wrong] = n + len(chunks) + np.arange(len(wrong))
        out = gather(ids, ids_start[entry], ids_size[entry])
        counts = np.zeros(len(parts), np.int64)
        if len(start):
            counts[sizes > 0] = np.add.reduceat(ids_size[entry], np.searchsorted(start, first))

        if n < self.table_size and len(chunks):
            keep = n + min(len(chunks), self.table_size - n)
            # the most frequent of the new ones first, if not all fit
            order = np.argsort(-np.bincount(inverse, minlength=len(chunks)), kind="stable")[: keep - n]
            chosen = np.concatenate([np.arange(n), n + order])
            self.text, self.text_size = gather(text, text_start[chosen], text_size[chosen]), text_size[chosen]
            self.ids, self.ids_size = gather(ids, ids_start[chosen], ids_size[chosen]), ids_size[chosen]
            self.text_start, self.ids_start = np.cumsum(self.text_size) - self.text_size, np.cumsum(self.ids_size) - self.ids_size
            self._put(new_keys[order], np.arange(n, keep))
        return out, counts

    def _odd(self, part: str) -> np.ndarray:
        """A part that can't be cut on arrays."""
        chunks = chunks_of(part)
        new = list(dict.fromkeys(chunks))
        ids = dict(zip(new, self.encode_new(new), strict=True))
        return np.frombuffer(b"".join(map(ids.__getitem__, chunks)), self.dtype)

    def encode(self, docs: list[str]) -> Iterator[list[np.ndarray]]:
        """For each text its ids, in arrays that follow each other."""
        out: list[list[np.ndarray]] = [[] for _ in docs]
        parts, owners, total = [], [], 0

        def flush() -> None:
            nonlocal total
            if parts:
                ids, counts = self._step(parts)
                for owner, own in zip(owners, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
                    out[owner].append(own)
            parts.clear()
            owners.clear()
            total = 0

        for k, text in enumerate(docs):
            for part in text_parts(text, self.step_bytes // 8) if len(text) > self.step_bytes // 8 else (text,):
                raw = part.encode()
                if len(raw) > self.step_bytes or (len(raw) != len(part) and any(c in raw for c in _WIDE_SPACE)):
                    flush()  # keeps the order of a text's parts
                    out[k].append(self._odd(part))
                    continue
                if total + len(raw) > self.step_bytes:
                    flush()
                parts.append(raw)
                owners.append(k)
                total += len(raw)
        flush()
        yield from out
