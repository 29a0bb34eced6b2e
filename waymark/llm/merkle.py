"""Merkle manifest of a table: a hash for each row, a trie for each group, a root for all.

Rows of a group ascend by id. Their exact ranks come without a global sort: a row's path (its id
in order-preserving hexadecimal digits, then its hash) is cut to a prefix; a histogram of the
prefixes is rolled up digit by digit, and sums over preceding siblings, carried down again, give
each prefix the rank of its first row. Only rows of one prefix are sorted. A rank's digits in the
base of the fanout are a node's key in the trie: the node over some leaves is the prefix that
their ranks share. Nodes are reduced from the longest prefixes up, LEVELS digits at a time, so a
task holds FANOUT ** LEVELS hashes, and proofs are handed down the same way.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm._common import stored

#: Children of a node, and digits of the key that one task reduces.
FANOUT, LEVELS = 3, 6
#: Hexadecimal digits of a path's prefix (256 ids share one), digits of one level of histograms, and digits by which a full prefix grows.
WIDTH, DIGITS, STEP = 14, 4, 12
#: Rows of one prefix beyond which equal rows are counted and the prefix grows.
FULL = 16_384
#: Full prefixes up to which their list is broadcast (some 100 bytes each).
MAX_BROADCAST_PREFIXES = 100_000

#: Columns of a leaf in the order of its hash.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_KEYS = ["grp", "node"]


def leaf_sql(columns: dict[str, str]) -> str:
    """SQL of a leaf: the hash of its columns (name: SQL), each '-' if null, else its UTF-8 bytes' number, ':' and value."""
    return "sha2(concat(" + ", ".join(f"coalesce(concat(octet_length(cast({c} as string)), ':', cast({c} as string)), '-')" for c in columns.values()) + "), 256)"


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# ranks


def radix_ranks(rows: DataFrame) -> DataFrame:
    """rows(grp string, path string, ...) with rank (from 0, by path within grp) and n (rows of grp), both long.

    Rows of equal path follow each other in any order. A prefix with more than FULL rows first has
    its equal rows counted (by reader's partition, so that no count is large), then grows by STEP
    digits until it isn't full or its rows are of one path; so no task gets all rows of a hot id.
    """
    own = rows.columns
    rows = rows.withColumn("copies", F.lit(1).cast("long")).withColumn("node", F.substring("path", 1, WIDTH))
    hist, deepest, grouped = stored(_counted(rows, WIDTH), "merkle-counts"), WIDTH, False
    while True:
        full = hist.filter((F.col("depth") == deepest) & (F.col("k") > FULL) & (F.col("splits") | F.lit(not grouped))).select(*_KEYS)
        n_full = full.count()
        if not n_full:
            break
        few = F.broadcast(full) if n_full <= MAX_BROADCAST_PREFIXES else full
        hot = rows.join(few, _KEYS, "left_semi")
        if not grouped:
            hot = hot.groupBy(*own, F.spark_partition_id().alias("reader")).agg(F.sum("copies").alias("copies"))
        hot = stored(hot.withColumn("node", F.substring("path", 1, deepest + STEP)).select(*rows.columns), "merkle-rows")
        rows = rows.join(few, _KEYS, "left_anti").unionByName(hot)
        hist = stored(hist.join(full, _KEYS, "left_anti").unionByName(_counted(hot, deepest + STEP)), "merkle-counts")
        deepest, grouped = deepest + STEP, True

    inside = Window.partitionBy(*_KEYS).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    placed = placed.join(_first_ranks(hist, deepest), _KEYS).withColumn("rank", F.col("base") + F.col("inside"))
    if grouped:
        placed = placed.withColumn("rank", F.explode(F.sequence("rank", F.col("rank") + F.col("copies") - 1)))
    return placed.select(*own, "rank", "n")


def _counted(rows: DataFrame, depth: int) -> DataFrame:
    """(grp, node, n, k, splits, depth): rows of each prefix with and without copies, and whether they are of several paths."""
    found = rows.groupBy(*_KEYS).agg(F.sum("copies").alias("n"), F.count("*").alias("k"), (F.min("path") < F.max("path")).alias("splits"))
    return found.withColumn("depth", F.lit(depth))


def _first_ranks(hist: DataFrame, deepest: int) -> DataFrame:
    """(grp, node, base, n): the rank of each prefix's first row, and the rows of its group.

    Counts are summed up to shorter and shorter prefixes, then ranks are handed down: a prefix
    begins where its parent does, after the siblings before it.
    """
    depths = [0, *range(WIDTH % DIGITS, deepest + 1, DIGITS)]
    every = hist.select("grp", "node", "n", F.explode(F.array(*map(F.lit, depths))).alias("at"), "depth").filter("at <= depth")
    every = every.groupBy("grp", "at", F.expr("substring(node, 1, at)").alias("node")).agg(F.sum("n").alias("n"))
    counts = stored(every, "merkle-counts")
    sizes = counts.filter(F.col("at") == 0).select("grp", "n")
    above = sizes.select("grp", F.lit("").alias("up"), F.lit(0).cast("long").alias("base"))
    siblings = Window.partitionBy("grp", "up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)  # of 16 ** DIGITS rows at most
    bases = None
    for shorter, depth in zip(depths, depths[1:], strict=False):
        here = counts.filter(F.col("at") == depth).withColumn("up", F.substring("node", 1, shorter)).withColumn("before", F.coalesce(F.sum("n").over(siblings), F.lit(0)))
        here = here.join(above, ["grp", "up"]).select("grp", "node", (F.col("base") + F.col("before")).alias("base"))
        if depth >= WIDTH and (depth - WIDTH) % STEP == 0:  # prefixes may end here
            ends = here.join(hist.filter(F.col("depth") == depth).select(*_KEYS), _KEYS) if deepest > WIDTH else here
            bases = ends if bases is None else bases.unionByName(ends)
        above = here.withColumnRenamed("node", "up")
    return stored(bases.join(sizes, "grp"), "merkle-bases")


# the trie


def _height(n: int) -> int:
    """Levels from n leaves up to one node."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def _reduced(hashes: list[str], levels: int) -> list[list[str]]:
    """The hashes and the nodes of each level above them."""
    out = [hashes]
    for _ in range(levels):
        out.append([digest(out[-1][k : k + FANOUT]) for k in range(0, len(out[-1]), FANOUT)])
    return out


def _run_of(level: list[str], k: int) -> tuple[str, str]:
    """The siblings left and right of a node, each side as one string."""
    start = k - k % FANOUT
    return "".join(level[start:k]), "".join(level[k + 1 : start + FANOUT])


def _sorted(t: pa.Table) -> pa.Table:
    return t.sort_by("rank")


@dataclass
class Trie:
    """The rounds of one or more trees: in rounds[k] (grp, rank, n, hash, ...) rank is the digits that are left of a leaf's after k times LEVELS are cut off."""

    rounds: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        """(grp, hash) of each tree's root."""
        return self.rounds[-1].select("grp", "hash")


def build(leaves: DataFrame) -> Trie:
    """The trie over leaves(grp string, rank long, n long, hash string, ...), ranks from 0 to n - 1 in each grp.

    A task holds the nodes that share a prefix, FANOUT ** LEVELS of them; a node without siblings
    becomes its parent alone. Rounds follow the logarithm of the largest group.
    """
    block = FANOUT**LEVELS

    def up(t: pa.Table) -> pa.Table:
        t = _sorted(t)
        n = t["n"][0].as_py()
        top = _reduced(t["hash"].to_pylist(), min(LEVELS, _height(n)))[-1]
        return pa.table({"grp": t["grp"][:1], "rank": pa.array([t["rank"][0].as_py() // block], pa.int64()), "n": pa.array([-(-n // block)], pa.int64()), "hash": pa.array(top, pa.string())})

    rounds = [leaves]
    largest = leaves.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        nodes = rounds[-1].select("grp", "rank", "n", "hash").groupBy("grp", F.expr(f"rank div {block}").alias("block"))
        rounds.append(stored(nodes.applyInArrow(up, "grp string, rank long, n long, hash string"), "merkle-nodes"))
        largest = -(-largest // block)
    return Trie(rounds)


def _downward(trie: Trie, top: DataFrame, carried: list[str]) -> DataFrame:
    """(grp, block, chain, carried...) for the blocks of the leaves: the siblings above each, from top(grp, chain, carried...)."""
    block = FANOUT**LEVELS

    def down(t: pa.Table, above: pa.Table) -> pa.Table:
        t = _sorted(t)
        if not above.num_rows:
            return pa.table({"grp": t["grp"][:0], "block": t["rank"][:0], "chain": pa.array([], pa.list_(pa.string())), **{c: pa.array([], pa.string()) for c in carried}})
        levels = _reduced(t["hash"].to_pylist(), min(LEVELS, _height(t["n"][0].as_py())))
        rest = above["chain"][0].as_py()
        chains = []
        for k in range(t.num_rows):
            own = []
            for level in levels[:-1]:
                own += _run_of(level, k)
                k //= FANOUT
            chains.append(own + rest)
        same = {c: pa.array([above[c][0].as_py()] * t.num_rows, pa.string()) for c in carried}
        return pa.table({"grp": t["grp"], "block": t["rank"], "chain": pa.array(chains, pa.list_(pa.string())), **same})

    schema = "grp string, block long, chain array<string>" + "".join(f", {c} string" for c in carried)
    chains = top.select("grp", F.lit(0).cast("long").alias("block"), "chain", *carried)
    for nodes in trie.rounds[:0:-1]:
        left = nodes.select("grp", "rank", "n", "hash").withColumn("block", F.expr(f"rank div {block}"))
        chains = left.groupBy("grp", "block").cogroup(chains.groupBy("grp", "block")).applyInArrow(down, schema)
    return chains


def verify(leaves: DataFrame, trees: Trie, forest: Trie) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of leaves(grp, rank, n, hash, doc_id, tampered).

    trees are the groups' trees over these leaves, forest the tree over their roots. A proof is
    the leaf's siblings level by level up to the root, left to right. folded_root is what the
    tampered hash (the leaf's own where it is null) and the proof lead to. Each task holds one
    block of leaves and the siblings above it.
    """
    block = FANOUT**LEVELS
    root = forest.roots.select(F.lit("").alias("grp"), F.array().cast("array<string>").alias("chain"), F.col("hash").alias("root"))
    above = _chains_of_leaves(forest, root, ["root"]).select(F.col("name").alias("grp"), "chain", F.col("hash").alias("subroot"), "root")
    chains = _downward(trees, above, ["subroot", "root"])

    def fold(value: str, chain: list[str]) -> str:
        for k in range(0, len(chain), 2):
            value = digest([chain[k], value, chain[k + 1]])
        return value

    def prove(t: pa.Table, above: pa.Table) -> pa.Table:
        t = _sorted(t)
        hashes, tampered = t["hash"].to_pylist(), t["tampered"].to_pylist()
        levels = _reduced(hashes, min(LEVELS, _height(t["n"][0].as_py())))
        rest, subroot, root = (above[c][0].as_py() for c in ("chain", "subroot", "root"))
        tail, folded_from = "".join(rest), {}
        proofs, folded = [], []
        for k, (own, other) in enumerate(zip(hashes, tampered, strict=True)):
            chain = []
            for level in levels[:-1]:
                chain += _run_of(level, k)
                k //= FANOUT
            proofs.append(digest([*chain, tail]))
            value = fold(other or own, chain)
            if value not in folded_from:  # most rows of a block fold to its own node
                folded_from[value] = fold(value, rest)
            folded.append(folded_from[value])
            if len(folded_from) > 1_000:
                folded_from.clear()
        same = lambda x: pa.array([x] * t.num_rows, pa.string())
        ok = pa.array([f == root for f in folded], pa.bool_())
        return pa.table({"doc_id": t["doc_id"], "leaf": t["hash"], "subroot": same(subroot), "root": same(root), "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()), "verified": ok})

    left = leaves.withColumn("block", F.expr(f"rank div {block}")).groupBy("grp", "block")
    return left.cogroup(chains.groupBy("grp", "block")).applyInArrow(prove, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _chains_of_leaves(trie: Trie, top: DataFrame, carried: list[str]) -> DataFrame:
    """trie's leaves (with all their columns but n) with chain, the siblings up to the root, and carried."""
    leaves = trie.rounds[0]
    # one more round than the blocks' chains: each leaf as a block of its own
    whole = Trie([leaves, *trie.rounds])
    chains = _downward(whole, top, carried).withColumnRenamed("block", "rank")
    return leaves.drop("n").join(chains, ["grp", "rank"])


# documents


def document_leaves(df: DataFrame, group_col: str = "source", id_col: str = "doc_id", text_col: str = "text", columns: tuple[str, ...] = LEAF_COLUMNS) -> DataFrame:
    """(grp, path, doc_id, hash, tampered) of each row: its leaf, and the leaf of the row without line feeds where 2 divides its id's crc32.

    grp orders groups (null first, then bytewise), path rows of one (null ids first, then by id, then by leaf).
    """
    whole = {c: f"`{c}`" for c in columns}
    cut = whole | {text_col: f"replace(`{text_col}`, '\n', '')"}
    i = f"cast(`{id_col}` as bigint)"
    digits = f"lpad(hex(coalesce({i}, cast('-9223372036854775808' as bigint)) ^ cast('-9223372036854775808' as bigint)), 16, '0')"
    rows = df.selectExpr(
        f"if(`{group_col}` is null, '0', concat('1', `{group_col}`)) as grp",
        f"concat({digits}, if({i} is null, '0', '1')) as path",
        f"{i} as doc_id",
        f"{leaf_sql(whole)} as hash",
        f"case when crc32(cast(cast({i} as string) as binary)) % 2 = 0 and contains(`{text_col}`, '\n') then {leaf_sql(cut)} end as tampered",
    )
    return rows.withColumn("path", F.concat("path", "hash"))


def manifest(leaves: DataFrame) -> tuple[DataFrame, Trie, Trie]:
    """Ranked leaves, the groups' tries, and the trie over their roots, in order of grp. leaves are rows of document_leaves()."""
    ranked = stored(radix_ranks(leaves).drop("path"), "merkle-leaves")
    trees = build(ranked)
    roots = trees.roots.select(F.lit("").alias("grp"), F.hex(F.encode("grp", "UTF-8")).alias("path"), F.col("grp").alias("name"), "hash")
    forest = build(stored(radix_ranks(stored(roots, "merkle-roots")).drop("path"), "merkle-forest"))
    return ranked, trees, forest


def verify_documents(df: DataFrame, group_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The manifest of a table and each row's proof, checked against tampered rows (see verify() for the columns).

    Where 2 divides the crc32 of an id in decimal, line feeds are deleted from the text before the
    row is hashed again: rows without any stay as they are and verify. Null ids come first and
    aren't tampered with; null groups are a group of their own, before the others; repeated rows
    are leaves of their own with equal hashes, next to each other, so their proofs differ by place;
    rows of one id follow by hash. Null and empty texts differ. An empty table gives no rows. Other
    columns are ignored. The texts are read once; what is shuffled are hashes.
    """
    leaves = stored(document_leaves(df, group_col, id_col, text_col), "merkle-documents")
    ranked, trees, forest = manifest(leaves)
    return verify(ranked, trees, forest)
