"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document is the set of its distinct word shingles, hashed. One permutation spreads the
hashed universe, a second one, shifted circularly by k, gives coordinate k of the signature:
the row of all shifts for an element is one contiguous piece of the second permutation, so a
signature is the minimum over the rows of the set. Documents that agree in a band are
candidates. Exact copies of a set are one node from the start; every bucket's members are
verified against its most central one, and buckets that this leaves in several components are
verified in blocks of all pairs. Components come from the verified links alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import SLICE_BYTES, held, slices, stored, without_gc

#: Bands and rows of a signature: at a similarity of 0.85 a pair shares no band with probability 4e-7.
BANDS, ROWS = 25, 5
#: Elements of the hashed universe that the two permutations order.
UNIVERSE = 1 << 20
SEED = 11
#: Members of a bucket that one task verifies against its hub.
HUB_SHARE = 2_000
#: Members of a block in the verification of all pairs.
BLOCK = 256
#: Bytes up to which a table of counted rows is broadcast.
MAX_BROADCAST_BYTES = 32_000_000
#: Rows of one key from which they aren't sent to one task.
HOT_ROWS = 4_096

_WHITE = np.zeros(256, bool)
_WHITE[[*range(9, 14), 32]] = True
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64, one for each byte of a part."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        x = np.full(PART_BYTES + SLICE_BYTES, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    return out[0], out[1]


#: Bytes of text whose words are hashed at once; a longer text is cut at white space.
PART_BYTES = 1_000_000
_CUT = re.compile(rb"[\x20\x09-\x0d]")


def _words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word of some bytes that end in white space."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _WHITE[buf]]).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = held(("dedup", "powers"), _powers)
    if len(buf) > len(up):  # a single word longer than a part: its hash needs more powers
        up, down = (np.concatenate([x, np.cumprod(np.full(len(buf) - len(x), x[1]), dtype=np.uint64) * x[-1]]) for x in (up, down))
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return start, _mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def _set_of(word: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of that many words (of all, if there are fewer)."""
    n = min(words, len(word))
    if not n:
        return word
    key = word[: len(word) - n + 1] + np.uint64(n)
    for k in range(1, n):
        key = key * np.uint64(_BASE) + word[k : len(word) - n + 1 + k]
    key = np.sort(_mixed(key))
    return key[np.concatenate([[True], key[1:] != key[:-1]])]


def shingle_sets(texts: list[str | None], words: int = 3) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles.

    A-Z are lower-cased; words are runs without 09-0D and 20 (hexadecimal). A text with words,
    but fewer than asked for, has one shingle of all of them; one without words has none.
    Hashes have 64 bits over words and their lengths.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() changes A-Z alone
    out: list[np.ndarray | None] = [None] * len(raw)
    for k, long in enumerate(raw):
        if len(long) > PART_BYTES:
            hashes, at = [], 0
            while at < len(long):
                found = _CUT.search(long, at + PART_BYTES)
                stop = found.end() if found else len(long)
                hashes.append(_words(np.frombuffer(long[at:stop] + b"\n", np.uint8))[1])
                at = stop
            out[k], raw[k] = _set_of(np.concatenate(hashes), words), b""
    start, word = _words(np.frombuffer(b"\n".join(raw) + b"\n", np.uint8))
    ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    first = np.searchsorted(start, np.concatenate([[0], ends])).tolist()
    for k, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        if out[k] is None:
            out[k] = _set_of(word[a:b], words)
    return out


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The spreading permutation, and for each place the turned one's values under all shifts as one row of a view."""
    rng = np.random.default_rng(SEED)
    spread, turned = rng.permutation(UNIVERSE).astype(np.int32), rng.permutation(UNIVERSE).astype(np.uint32)
    size = BANDS * ROWS
    return spread, np.lib.stride_tricks.sliding_window_view(np.concatenate([turned, turned[: size - 1]]), size)


def signature(elements: np.ndarray) -> np.ndarray:
    """All coordinates of the circulant MinHash of a set that isn't empty."""
    spread, rows = held(("dedup", "permutations"), _permutations)
    at = spread[(elements & np.uint64(UNIVERSE - 1)).astype(np.int64)]
    out = rows[at[:2048]].min(axis=0)
    for k in range(2048, len(at), 2048):
        np.minimum(out, rows[at[k : k + 2048]].min(axis=0), out=out)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the signatures (rows)."""
    bands = coordinates.reshape(len(coordinates), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(coordinates), BANDS)).copy()
    for k in range(ROWS):
        key = _mixed(key * np.uint64(_BASE) + bands[:, :, k])
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum()) if len(b) else 0
    return 100 * both >= percent * (len(a) + len(b) - both)


def fits(df: DataFrame, most: int | None = None) -> bool:
    """Whether df, counted, surely stays under MAX_BROADCAST_BYTES (or most) as a broadcast table; its columns must be numbers or short keys."""
    return df.count() * (64 + 24 * len(df.columns)) <= (MAX_BROADCAST_BYTES if most is None else most)


def join_spread(rows: DataFrame, values: DataFrame, by: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with values, which has one row for each key.

    hot lists the keys of more than HOT_ROWS rows; there are few, so their values are broadcast
    and their rows stay where they are instead of meeting in one task. Beyond the size of a
    broadcast table all go by a plain join, whose large partitions adaptive execution splits.
    """
    keys = stored(hot.select(by).distinct(), "dedup-hot")
    if keys.isEmpty() or not fits(keys):
        return rows.join(values, by, how)
    few = F.broadcast(keys)
    theirs = stored(values.join(few, by, "left_semi"), "dedup-hot")
    return rows.join(few, by, "left_semi").join(F.broadcast(theirs), by, how).unionByName(rows.join(few, by, "left_anti").join(values, by, how))


def mark_of(text: Column) -> Column:
    """16 bytes that stand for a whole text (null as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def signatures(df: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark of the text, n_shingles, digest of the set, keys of the bands); no keys for an empty set."""

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2, rows=5_000):
            sets = shingle_sets(batch.column(2).to_pylist(), words)
            some = [s for s in sets if len(s)]
            keys = band_keys(np.stack([signature(s) for s in some])) if some else np.empty((0, BANDS), np.int64)
            offsets = np.concatenate([[0], np.cumsum([BANDS if len(s) else 0 for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel(), pa.int64()))],
                ["doc_id", "mark", "n_shingles", "digest", "keys"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), mark_of(F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    return stored(rows.mapInArrow(run, "doc_id long, mark binary, n_shingles long, digest binary, keys array<long>"), "dedup-signatures")


def number_sets(sig: DataFrame) -> DataFrame:
    """(node, id, mark, digest, n, copies) of every distinct set that isn't empty.

    id and mark are those of its first document (smallest id, null last, then smallest mark);
    nodes count the sets from 0 in the order of these, so a smaller node never has a larger id.
    Sets are dealt out by range and numbered from the sizes of the partitions before.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "mark"))
    sets = stored(sig.filter("n_shingles > 0").groupBy("digest").agg(least.alias("least"), F.first("n_shingles").alias("n"), F.count("*").alias("copies")), "dedup-sets")
    order = ["none", "id", "mark", "digest"]
    dealt = sets.select("least.*", "digest", "n", "copies").repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = stored(dealt.select("id", "mark", "digest", "n", "copies", F.spark_partition_id().alias("part"), place.alias("place")), "dedup-places")
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))  # one row per partition
    return stored(dealt.join(F.broadcast(bases), "part").select((F.col("base") + F.col("place")).alias("node"), "id", "mark", "digest", "n", "copies"), "dedup-numbered")


class Texts:
    """Where the text of a node is read: rows of df by id and mark of the text (or by id alone, if nodes are ids)."""

    def __init__(self, df: DataFrame, id_col: str, text_col: str, sets: DataFrame | None = None, repeated: bool = False):
        self.docs = df.select(F.col(id_col).cast("long").alias("own_id"), F.col(text_col).alias("text"))
        self.sets, self.repeated = sets, repeated

    def of(self, wanted: DataFrame) -> DataFrame:
        """wanted (a column node and others) with the text of each node: wanted is broadcast while it is small, else joined."""
        columns = wanted.columns
        wanted = stored(wanted if self.sets is None else wanted.join(self.sets.select("node", "id", "mark"), "node"), "dedup-wanted")
        if self.sets is None:
            on, docs = F.col("node") == F.col("own_id"), self.docs
        else:
            on = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_mark") == F.col("mark"))
            docs = self.docs.withColumn("own_mark", mark_of(F.col("text")))
        rows = docs.join(F.broadcast(wanted) if fits(wanted) else wanted, on).select(*columns, "text")
        return rows.dropDuplicates(columns) if self.repeated else rows


def verify_hubs(texts: Texts, pairs: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b) of those pairs (node, hub) that are similar enough. A hub with many members is met in several tasks."""
    counts = stored(pairs.groupBy("hub").agg(F.count("*").alias("members")), "dedup-shares")
    shares = counts.select("hub", F.ceil(F.col("members") / HUB_SHARE).alias("shares"))
    members = join_spread(pairs, shares, "hub", counts.filter(F.col("members") > HOT_ROWS)).select("node", "hub", F.pmod(F.xxhash64("node"), F.col("shares")).alias("share"), F.lit(1).alias("rank"))
    hubs = shares.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"), F.lit(0).alias("rank"))
    rows = texts.of(members.unionByName(hubs)).repartition("hub", "share").sortWithinPartitions("hub", "share", "rank").select("node", "hub", "share", "rank", "text")

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, center = None, None
        for batch in slices(batches, 4, rows=5_000):
            sets, links = shingle_sets(batch.column(4).to_pylist(), words), []
            for node, hub, share, rank, own in zip(*(batch.column(k).to_pylist() for k in range(4)), sets, strict=True):
                if (hub, share) != current:
                    current, center = (hub, share), None
                if rank == 0:
                    center = own
                elif center is not None and similar(own, center, percent):
                    links.append((node, hub))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def verify_blocks(texts: Texts | DataFrame, members: DataFrame, percent: int, words: int) -> DataFrame:
    """(a, b): links that join all nodes of a bucket that are connected by similar pairs in it; members are (key, node, label).

    Large buckets are cut into blocks by a hash, and every pair of blocks is a group of its own,
    so a group holds a few hundred documents; members of a large bucket don't meet in one task
    before that. Of the pairs found, those between nodes that others (or equal labels) already
    join are left out. For a DataFrame in place of Texts nodes are its doc_id.
    """
    texts = texts if isinstance(texts, Texts) else Texts(texts, "doc_id", "text")
    counts = stored(members.groupBy("key").agg(F.count("*").alias("members")), "dedup-sizes")
    sizes = counts.select("key", F.ceil(F.col("members") / BLOCK).alias("blocks"))
    own = join_spread(members, sizes, "key", counts.filter(F.col("members") > HOT_ROWS)).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    wanted = own.select("node", "label", "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = texts.of(wanted).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node").select("node", "label", "key", "lo", "hi", "text")

    def links_of(group: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        top: dict[int, int] = {}

        def find(x: int) -> int:
            while top.setdefault(x, x) != x:
                top[x] = x = top[top[x]]
            return x

        n = np.array([len(s) for _, _, s in group], np.int64)
        owner = np.repeat(np.arange(len(group)), n)
        _, number, often = np.unique(np.concatenate([s for _, _, s in group]), return_inverse=True, return_counts=True)
        shared = often[number] > 1
        new = np.cumsum(often > 1) - 1
        column, owner = new[number[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(group), len(group)), np.float32)
        for k in range(0, int((often > 1).sum()), 8192):
            a, b = np.searchsorted(column, [k, k + 8192])
            part = np.zeros((len(group), 8192), np.float32)
            part[owner[a:b], column[a:b] - k] = 1
            both += part @ part.T
        common = np.rint(both).astype(np.int64)
        i, j = np.nonzero(np.triu(100 * common >= percent * (n[:, None] + n[None, :] - common), 1) & (n[:, None] > 0))
        out = []
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(group[x][1]), find(group[y][1])
            if a != b:
                top[a] = b
                out.append((group[x][0], group[y][0]))
        return out

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, group = None, []

        def batch_of(links: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in slices(batches, 5, rows=5_000):
            sets = shingle_sets(batch.column(5).to_pylist(), words)
            for node, label, *place, own_set in zip(*(batch.column(k).to_pylist() for k in range(5)), sets, strict=True):
                if place != current:
                    if len(group) > 1:
                        yield batch_of(links_of(group))
                    current, group = place, []
                group.append((node, label, own_set))
        if len(group) > 1:
            yield batch_of(links_of(group))

    return rows.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) reaches.

    Labels move along links and then jump to their label's label, until none changes; every
    round is written to the shared folder. Neither the links of one node nor the nodes of one
    label meet in one task.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    both = stored(both.distinct(), "dedup-links")
    centers = stored(both.groupBy("b").agg(F.count("*").alias("links")).filter(F.col("links") > HOT_ROWS), "dedup-centers")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "dedup-labels")
    while True:
        near = join_spread(both, labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b", centers).groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        moved = stored(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "dedup-moved")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        common = moved.groupBy("label").agg(F.count("*").alias("nodes")).filter(F.col("nodes") > HOT_ROWS)
        new = stored(join_spread(moved, jump, "label", common, "left").select("node", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "dedup-labels")
        labels = new.select("node", "label")
        if new.filter("old <> label").isEmpty():
            return labels


@dataclass
class Found:
    """Signatures by row, sets with their component, and whether any row (id and text) occurs twice."""

    sig: DataFrame
    sets: DataFrame
    repeated: DataFrame


def find_components(df: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> Found:
    """Sets are (node, id, mark, digest, copies, label, component_id): label is the least node reached, component_id its id."""
    sig = signatures(df, words, id_col, text_col)
    repeated = stored(sig.groupBy("doc_id", "mark").agg(F.count("*").alias("times")).filter("times > 1"), "dedup-repeated")
    twice = not repeated.isEmpty()
    sets = number_sets(sig)
    texts = Texts(df, id_col, text_col, sets, twice)
    once = sig.select("doc_id", "mark", "digest", "keys")
    once = once.dropDuplicates(["doc_id", "mark"]) if twice else once
    firsts = sets.select("node", "n", "id", "mark", "digest")
    only = once.join(firsts, (once.digest == firsts.digest) & (once.mark == firsts.mark) & once.doc_id.eqNullSafe(firsts.id))
    bands = stored(only.select("node", "n", F.explode("keys").alias("key")), "dedup-bands")

    many = stored(bands.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1"), "dedup-many")
    hot = many.filter(F.col("members") > HOT_ROWS)
    buckets = stored(join_spread(bands, many, "key", hot), "dedup-buckets")
    weight = buckets.groupBy("node").agg(F.sum("members").alias("weight"))
    hubs = buckets.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("minus"), F.col("node").alias("hub"), F.col("n").alias("hub_n"))).alias("best")).select("key", "best.hub", "best.hub_n")
    near = (F.col("node") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    pairs = stored(join_spread(buckets, hubs, "key", hot).filter(near).select("node", "hub").distinct(), "dedup-hubs")
    links = stored(verify_hubs(texts, pairs, percent, words), "dedup-links")
    labels = components(links)

    # buckets of three and more that hubs left in several components: all their pairs, in blocks
    placed = buckets.filter("members > 2").join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label"))
    open_ = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sum"), F.expr("bit_xor(xxhash64(node, 7))").alias("mix")).filter("lo <> hi")
    open_ = open_.groupBy("size", "sum", "mix").agg(F.min("key").alias("key")).select("key")  # equal buckets once
    left = stored(join_spread(placed, open_, "key", hot).select("key", "node", "label"), "dedup-open")
    if not left.isEmpty():
        more = verify_blocks(texts, left, percent, words)
        labels = components(stored(links.unionByName(more), "dedup-links"))

    named = sets.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    roots = sets.select(F.col("node").alias("label"), F.col("id").alias("component_id"))
    sizes = named.groupBy("label").agg(F.count("*").alias("sets")).filter(F.col("sets") > HOT_ROWS)
    return Found(sig, stored(join_spread(named, roots, "label", sizes), "dedup-named"), repeated)


def near_duplicates(df: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct
    shingles of that many words; component_id is the smallest id that links reach, kept whether
    it is the document's own. Texts without words (null, empty) are linked with nothing. Rows
    that share an id are documents of their own, each with its text's component. Rows without
    an id are linked like others; their component has an id only if a row with one is in it
    (else null, and they are kept). One row per input row; an empty table gives an empty result;
    other columns are ignored.
    """
    found = find_components(df, percent, words, id_col, text_col)
    named = found.sets.select("digest", "component_id", "copies")
    out = join_spread(found.sig.select("doc_id", "n_shingles", "digest"), named.drop("copies"), "digest", named.filter(F.col("copies") > HOT_ROWS), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one_of_each(df: DataFrame, percent: int = 80, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, without near duplicates: of each component the document with the smallest id stays, once.

    A document is an id with a text: rows of one id with unlike texts are documents of their
    own and stay; of those of one id in one component the one of the least digest of its text
    stays. Of rows with the same id and the same text (null and empty too) the first by the
    other columns, as JSON, stays. Rows without an id come last in their component; texts
    without words are linked with nothing and stay. An empty table gives an empty one; columns
    may have any names.
    """
    found = find_components(df, percent, words, id_col, text_col)
    sets = found.sets.filter("copies > 1 or node <> label").select("digest", "copies", F.col("id").alias("first_id"), F.col("mark").alias("first_mark"), (F.col("node") == F.col("label")).alias("root"))
    rows = join_spread(found.sig.select("doc_id", "mark", "digest"), sets.drop("copies"), "digest", sets.filter(F.col("copies") > HOT_ROWS))
    first = F.col("root") & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    gone = stored(rows.filter(~first).select("doc_id", "mark").distinct(), "dedup-gone")

    # names of df can't clash with these
    named = df.select(*[F.struct(F.col(c)).alias(f"own{k}") for k, c in enumerate(df.columns)], F.col(id_col).cast("long").alias("key_id"), mark_of(F.col(text_col)).alias("key_mark"))

    def same(other: DataFrame) -> Column:
        return F.col("key_id").eqNullSafe(other.doc_id) & (F.col("key_mark") == other.mark)

    rows = named.join(F.broadcast(gone) if fits(gone) else gone, same(gone), "left_anti")
    if not found.repeated.isEmpty():
        few = F.broadcast(found.repeated) if fits(found.repeated) else found.repeated
        own = F.struct(*named.columns)
        one = rows.join(few, same(found.repeated), "left_semi").groupBy("key_id", "key_mark").agg(F.min_by(own, F.to_json(F.struct(*[c for c in named.columns if c.startswith("own")]))).alias("row")).select("row.*")
        rows = rows.join(few, same(found.repeated), "left_anti").unionByName(one)
    return rows.select(*[F.col(f"own{k}")[c].alias(c) for k, c in enumerate(df.columns)])
