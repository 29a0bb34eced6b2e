"""Ranked lexical search by branch and bound over a hierarchical max tree.

Documents lie in ranges, in the order of their length inside one. Over each range stands a tree
of sub-ranges, FAN children a node, that holds for every term the largest part of a score that
any of the node's documents has from it. The sum over an item's terms bounds what a node can
hold, so the node with the highest sum is opened first, down to single documents with exact
scores, until no open node reaches the item's last kept score; a node that just reaches it is
opened, as an equal score with a smaller id ranks before. One range for each item, that with the
highest bound, is searched first, so that every other range starts from that score.

Terms of documents are counted for the terms that the items hold; items are taken in blocks of a
bounded number of terms, each block against all documents.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.llm._common import slices, stored, without_gc

#: Children of a node, and documents of a range: three levels.
FAN, RANGE = 16, 4_096
#: Pairs of range and term that a range may have before it is closed.
RANGE_PAIRS = 1_000_000
#: Terms of a block of items in expectation (an item with more is a block of its own length).
BLOCK_TERMS = 16_384
#: Bytes of a text that are split into terms at once.
STEP_BYTES = 1_000_000
#: Groups of tasks whose results are cut to the best before all meet.
MERGE_GROUPS = 256

# Terms: ASCII letters (lower-cased) and digits, and every byte of characters beyond ASCII.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def term_runs(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, in order, in lists of bounded size."""
    if len(raw) <= STEP_BYTES:
        yield raw.translate(_TERM_BYTES).split()
        return
    start = 0
    while start < len(raw):
        stop = start + STEP_BYTES
        part = raw[start:stop].translate(_TERM_BYTES)
        while stop < len(raw) and part[-1] != 32:  # up to the end of a term
            more = raw[stop : stop + STEP_BYTES].translate(_TERM_BYTES)
            cut = more.find(b" ")
            part += more if cut < 0 else more[: cut + 1]
            stop += len(more) if cut < 0 else cut + 1
        yield part.split()
        start = stop


def weight(n_docs: int, df: int) -> int:
    """A term's weight."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Stats:
    """Counts over all documents: how many have terms, all their terms, and the weight of each of the block's terms."""

    def __init__(self, n_docs: int, n_terms: int, df: np.ndarray):
        self.n_docs, self.n_terms = n_docs, max(1, n_terms)
        self.weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)

    def parts(self, n: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What each pair of a document (of n terms) and a term that it holds tf times adds to a score."""
        m = 100 - 90 + (90 * n * self.n_docs) // self.n_terms
        return self.weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


class RangeTree:
    """The max tree over one range: ids, n, and for each document the number of its terms, the terms and their counts. Below its root it grows when it is first searched."""

    def __init__(self, stats: Stats, ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tf: np.ndarray):
        self.given = ids, n, np.repeat(np.arange(len(ids)), sizes), terms
        self.parts = stats.parts(n[self.given[2]], terms, tf)
        self.root = np.zeros(len(stats.weights), np.int64)  # of every term of the block
        np.maximum.at(self.root, terms, self.parts)
        self.levels, self.scored = None, 0

    def _grow(self) -> None:
        ids, n, doc, terms = self.given
        place = np.empty(len(ids), np.int64)
        by_length = np.lexsort((ids, n))
        place[by_length] = np.arange(len(ids))
        self.ids = ids[by_length]
        held = np.zeros(len(self.root), bool)
        held[terms] = True
        width = int(held.sum())
        self.local = np.where(held, np.cumsum(held) - 1, -1)
        key = (place[doc] // FAN) * width + self.local[terms]
        order = np.argsort(key, kind="stable")
        self.place, self.parts, key = place[doc][order], self.parts[order], key[order]
        self.start = np.flatnonzero(np.diff(key, prepend=-1))
        self.key, self.size = key[self.start], np.diff(np.append(self.start, len(key)))
        fans = -(-len(ids) // FAN**2)
        low = np.zeros((width, fans * FAN), np.int64)
        low[self.key % width, self.key // width] = np.maximum.reduceat(self.parts, self.start)
        self.width, self.levels, self.given = width, (low.reshape(width, fans, FAN).max(axis=2), low), None

    def _score(self, leaf: int, terms: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's documents."""
        keys = leaf * self.width + terms
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        at = at[self.key[at] == keys]
        size = self.size[at]
        ends = np.cumsum(size)
        pairs = np.repeat(self.start[at] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
        scores = np.zeros(FAN, np.int64)
        np.add.at(scores, self.place[pairs] - leaf * FAN, self.parts[pairs])
        return scores

    def search(self, terms: np.ndarray, best: Best) -> None:
        """Offer best what the range has for an item's terms."""
        nodes = [(-int(self.root[terms].sum()), 0, 0)]
        if -nodes[0][0] < best.least:
            return
        if self.levels is None:
            self._grow()
        terms = self.local[terms]
        terms = terms[terms >= 0]
        while nodes:
            bound, depth, node = heapq.heappop(nodes)
            if -bound < best.least:
                return
            if depth == 2:
                scores = self._score(node, terms)
                self.scored += FAN
                for k in np.flatnonzero(scores >= best.least):
                    best.offer(int(scores[k]), int(self.ids[node * FAN + k]))
                continue
            bounds = self.levels[depth][terms, node * FAN : (node + 1) * FAN] if depth else self.levels[0][terms]
            bounds = bounds.sum(axis=0)
            for k in np.flatnonzero(bounds >= best.least):
                heapq.heappush(nodes, (-int(bounds[k]), depth + 1, node * FAN + int(k)))


class Best:
    """The best k documents so far, by score, then by smaller id; none below least, which is 1 at the least."""

    def __init__(self, k: int, least: int = 1):
        self.k, self.least, self.kept = k, max(1, least), []

    def offer(self, score: int, doc: int) -> None:
        if len(self.kept) < self.k:
            heapq.heappush(self.kept, (score, -doc))
        elif (score, -doc) > self.kept[0]:
            heapq.heapreplace(self.kept, (score, -doc))
        if len(self.kept) == self.k:
            self.least = max(self.least, self.kept[0][0])


#: Stands for a null id, which ranks before others of equal score.
_NO_ID = -(2**63)


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(range, doc_id, n, terms, tf) of documents with at least one term: n all their terms with repeats, terms those in the vocabulary."""

    @without_gc
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        range_id, docs_in, pairs_in = TaskContext.get().partitionId() << 32, 0, 0
        for batch in slices(batches, 1):
            ranges, kept, counts, ends, terms, tfs = [], [], [], [0], [], []
            for k, raw in enumerate(batch.column(1).to_pylist()):
                n, found = 0, Counter()
                for run_ in term_runs(raw or b""):
                    n += len(run_)
                    found.update(map(get, run_))
                if not n:
                    continue
                found.pop(None, None)
                if docs_in == RANGE or pairs_in >= RANGE_PAIRS:
                    range_id, docs_in, pairs_in = range_id + 1, 0, 0
                docs_in, pairs_in = docs_in + 1, pairs_in + len(found)
                ranges.append(range_id)
                kept.append(k)
                counts.append(n)
                terms += found.keys()
                tfs += found.values()
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, t)) for x, t in ((terms, pa.int32()), (tfs, pa.int64()))]
            arrays = [pa.array(ranges, pa.int64()), batch.column(0).take(pa.array(kept, pa.int64())), pa.array(counts, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(arrays, ["range", "doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "range long, doc_id long, n long, terms array<int>, tf array<long>")


def _trees(batches: Iterable[pa.RecordBatch], stats: Stats) -> Iterator[tuple[int, RangeTree]]:
    """The tree of each run of rows with one range."""
    held: list[tuple[np.ndarray, ...]] = []
    now = None

    def made() -> RangeTree:
        return RangeTree(stats, *(np.concatenate(x) for x in zip(*held, strict=True)))

    for batch in batches:
        ranges = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and ranges[a] != now:
                yield now, made()
                held = []
            now, part = int(ranges[a]), batch.slice(a, b - a)
            sizes = np.diff(part.column(3).offsets.to_numpy())
            flat = [part.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4)]
            held.append((part.column(1).fill_null(_NO_ID).to_numpy(zero_copy_only=False), part.column(2).to_numpy(zero_copy_only=False), sizes, *flat))
    if held:
        yield now, made()


def _over_ranges(counted: DataFrame, work: Callable[[Iterator[tuple[int, RangeTree]]], Iterator[tuple[int, int, int]]], stats: Stats, names: tuple[str, str]) -> DataFrame:
    """(item, two numbers named by names, task) that work() makes of the trees of a task's ranges."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = list(work(_trees(batches, stats)))
        task = TaskContext.get().partitionId()
        columns = list(zip(*found, strict=True)) or [(), (), ()]
        arrays = [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[1:]), pa.array([task] * len(found), pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, ["item", *names, "task"])

    return counted.mapInArrow(run, f"item int, {names[0]} long, {names[1]} long, task int")


def _search_block(spark: SparkSession, docs: DataFrame, items: list[np.ndarray], vocabulary: dict[bytes, int], k: int, id_col: str, text_col: str) -> DataFrame:
    """(item, rank, doc_id, score) for items given as arrays of term numbers."""
    counted = stored(count_terms(docs, vocabulary, id_col, text_col), "ranked-terms")
    n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    for term, n in counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect():  # the block's terms
        df[term] = n
    stats = Stats(n_docs, n_terms, df)
    flat, starts = np.concatenate(items), np.cumsum([0, *map(len, items)])[:-1]

    def bounds(tree: RangeTree) -> list[int]:
        """Of every item, the most that a document of the range can score."""
        return np.add.reduceat(tree.root[flat], starts).tolist()

    def roots(trees: Iterator[tuple[int, RangeTree]]) -> Iterator[tuple[int, int, int]]:
        top: dict[int, tuple[int, int]] = {}
        for range_id, tree in trees:
            for i, bound in enumerate(bounds(tree)):
                if bound and (bound, range_id) > top.get(i, (0, 0)):
                    top[i] = (bound, range_id)
        return ((i, bound, range_id) for i, (bound, range_id) in top.items())

    highest = _over_ranges(counted, roots, stats, ("bound", "range")).groupBy("item").agg(F.max_by("range", F.struct("bound", "range")).alias("range"))
    first = {r.item: r.range for r in highest.collect()}  # one row an item of the block

    def search(least: dict[int, int], only: dict[int, int] | None = None) -> Callable:
        def work(trees: Iterator[tuple[int, RangeTree]]) -> Iterator[tuple[int, int, int]]:
            best = [Best(k, least.get(i, 1)) for i in range(len(items))]
            for range_id, tree in trees:
                for i, bound in enumerate(bounds(tree)):
                    if bound >= best[i].least and (only is None or only.get(i) == range_id):
                        tree.search(items[i], best[i])
            return ((i, -doc, score) for i, b in enumerate(best) for score, doc in b.kept)

        return work

    seeds = counted.filter(F.col("range").isin(sorted(set(first.values())))) if first else counted.limit(0)
    least = {r.item: r.least for r in _best(_over_ranges(seeds, search({}, first), stats, ("doc_id", "score")), k).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).filter(F.col("n") == k).collect()}
    return _best(_over_ranges(counted, search(least), stats, ("doc_id", "score")), k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(item, rank, doc_id, score): the best k of each item, first within groups of tasks, so that what meets in one task stays small."""
    order = [F.desc("score"), F.asc("doc_id")]
    found = found.withColumn("group", F.col("task") % MERGE_GROUPS)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "group").orderBy(*order))).filter(F.col("rank") <= k)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k).select("item", "rank", "doc_id", "score")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest score for each item, scores above 0 only, equal scores by ascending id (null first).

    A score sums, over the item's distinct terms, a weight by how few documents hold the term times
    a share that grows with its count in the document and falls with the document's length (see
    weight() and Stats.parts()). Rows of one item_id are one item with the terms of all of them; a
    null item_id is an item too; items without a term that any document holds have no rows. Every
    row of docs is a document of its own, repeated rows and ids included; null and empty texts and
    texts without terms are never found and not counted. Other columns are ignored. The result and
    all work but counting follow the ranges that bounds leave open.
    """
    spark = docs.sparkSession

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                own = set().union(*term_runs(raw or b""))
                at += [i] * len(own)
                found += own
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.binary())], ["item_id", "term"])

    kind = items.schema[item_col].dataType.simpleString()
    pairs = items.select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").cast("binary").alias("text")).mapInArrow(split, f"item_id {kind}, term binary").distinct()
    pairs = stored(pairs, "ranked-items")
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    out = None
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else pairs
        rows = own.groupBy("item_id").agg(F.collect_set("term").alias("terms")).collect()  # BLOCK_TERMS terms in expectation
        if not rows:
            continue
        vocabulary: dict[bytes, int] = {}
        numbered = [np.array(sorted(vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms), np.int64) for r in rows]
        found = _search_block(spark, docs, numbered, vocabulary, k, id_col, text_col)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {kind}")
        found = found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(F.col("doc_id") != _NO_ID, F.col("doc_id")).alias("doc_id"), "score")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
