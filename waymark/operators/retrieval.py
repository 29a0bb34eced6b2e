"""Retrieval of keyframes by votes in a kept index, and one-to-one matches.

Descriptors are 256-bit words as 32 bytes, bit d in byte d / 8 from its low end. A table's code
samples some of the bits, so like descriptors share codes in several tables. The index keeps which
keyframe has which code, bucketed by table and code, and grows by appending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.operators.select import checkpointed

# Tables, bits of a code, and which bit of a descriptor is bit b of table t's code: 17 + 37 t + 11 b modulo 256.
TABLES, CODE_BITS, WIDTH = 6, 17, 256


def descriptor_of(bits: list[Column]) -> Column:
    """The 32 bytes of 256 conditions; a null condition is 0."""
    one = lambda c, k: F.when(c, 1 << k).otherwise(0)
    byte = lambda k: F.lpad(F.hex(sum((one(c, i) for i, c in enumerate(bits[8 * k : 8 * k + 8])), F.lit(0)).cast("long")), 2, "0")
    return F.unhex(F.concat(*[byte(k) for k in range(WIDTH // 8)]))


def _words(descriptor: Column) -> list[Column]:
    """The 32 bytes as eight integers of 32 bits."""
    return [F.conv(F.hex(F.substring(descriptor, 4 * k + 1, 4)), 16, 10).cast("long") for k in range(WIDTH // 32)]


def codes_of(words: Column) -> Column:
    """array<struct<tbl, code>> of a descriptor's words (an array)."""

    def bit(d: int) -> Column:
        byte = d // 8
        return F.shiftright(words[byte // 4], (3 - byte % 4) * 8 + d % 8).bitwiseAND(F.lit(1).cast("long"))

    code = lambda t: sum((F.shiftleft(bit((17 + 37 * t + 11 * b) % WIDTH), b) for b in range(CODE_BITS)), F.lit(0).cast("long"))
    return F.array(*[F.struct(F.lit(t).alias("tbl"), code(t).alias("code")) for t in range(TABLES)])


def descriptor_distance(a: Column, b: Column) -> Column:
    """Differing bits of two descriptors."""
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(_words(a), _words(b), strict=True)), F.lit(0))


def _coded(features: DataFrame, *columns: str) -> DataFrame:
    """(columns, tbl, code) of features (keyframe, t, descriptor, ...) with a descriptor of 32 bytes; others don't count."""
    rows = features.filter((F.octet_length("descriptor") == WIDTH // 8) & F.col("keyframe").isNotNull()).withColumn("_words", F.array(*_words(F.col("descriptor"))))
    return rows.select(*columns, F.explode(codes_of(F.col("_words"))).alias("_c")).select(*columns, "_c.tbl", "_c.code")


class KeyframeIndex:
    """Which keyframes hold which code of which table: a table of the session's catalogue, bucketed by table and code, in a folder that executors share.

    A keyframe stands once under a code however many of its features have it, as it gets one vote
    from a feature and table. All features of a keyframe are appended together.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, buckets: int = 64):
        self.spark, self.name, self.folder, self.buckets = spark, name, folder, buckets

    def append(self, features: DataFrame) -> KeyframeIndex:
        """Add the features (keyframe, t, descriptor) of new keyframes."""
        rows = _coded(features, "keyframe", "t").distinct()
        rows.repartition(self.buckets, "tbl", "code").write.bucketBy(self.buckets, "tbl", "code").sortBy("tbl", "code").option("path", self.folder).mode("append").format("parquet").saveAsTable(self.name)
        return self

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def candidates(self, current: DataFrame, min_index: int, min_time: int, min_votes: int, min_tables: int, most: int) -> DataFrame:
        """(keyframe, candidate, votes, tables, rank): the earlier keyframes with the most votes of each current one.

        current is (keyframe, t, descriptor), a row a feature. A candidate is min_index in number
        and min_time in time before; it needs votes and tables, and ranks by votes, then tables,
        then the smaller number. Features of one keyframe with the same code are counted first, so
        a code that many share is met once a keyframe.
        """
        asked = _coded(current, "keyframe", "t").groupBy("keyframe", "t", "tbl", "code").agg(F.count("*").alias("features"))
        known = self.table().select(F.col("keyframe").alias("candidate"), F.col("t").alias("_t"), "tbl", "code")
        pairs = asked.join(known, ["tbl", "code"]).filter((F.col("keyframe") - F.col("candidate") >= min_index) & (F.col("t") - F.col("_t") >= min_time))
        votes = pairs.groupBy("keyframe", "candidate").agg(F.sum("features").alias("votes"), F.count_distinct("tbl").alias("tables"))
        votes = votes.filter((F.col("votes") >= min_votes) & (F.col("tables") >= min_tables))
        order = Window.partitionBy("keyframe").orderBy(F.desc("votes"), F.desc("tables"), "candidate")
        return votes.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def greedy_matching(pairs: DataFrame, keys: list[str], left: str, right: str, order: list[str]) -> DataFrame:
    """The pairs that a walk in the order of (order, left, right) keeps, when it takes each pair whose two sides are still free.

    Rounds instead of a walk: a pair that is the least of both its sides is kept, as nothing before
    it can take either; pairs that share a side with it go. A round's rows are checkpointed; rounds
    end when no pair is left, after one more than the longest chain of pairs that wait for each
    other. A repeated pair is one; pairs with a null side or order don't match.
    """
    columns = [*keys, left, right, *order]
    live = checkpointed(pairs.select(*columns).dropna(subset=[left, right, *order]).distinct())
    rank = F.struct(*order, left, right)
    kept = None
    while not live.isEmpty():
        ranked = live.withColumn("_rank", rank)
        firsts = [ranked.groupBy(*keys, side).agg(F.min("_rank").alias("_rank")) for side in (left, right)]
        both = firsts[0].withColumns({left: F.col("_rank")[left], right: F.col("_rank")[right]}).select(*keys, left, right, "_rank")
        other = firsts[1].select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(right).alias("_right"), F.col("_rank").alias("_other"))
        on = (F.col(right) == F.col("_right")) & (F.col("_rank") == F.col("_other"))
        for k in keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
        chosen = checkpointed(both.join(other, on).select(*keys, left, right, *[F.col("_rank")[c].alias(c) for c in order]))
        kept = chosen if kept is None else kept.unionByName(chosen)
        for side in (left, right):
            taken = chosen.select(*keys, side).alias("taken")
            live = live.alias("live").join(taken, [F.col(f"live.{c}").eqNullSafe(F.col(f"taken.{c}")) for c in [*keys, side]], "left_anti")
        live = checkpointed(live)
    return kept if kept is not None else live
