"""Subsampling, top-k and ordered selection."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """Rows numbered from 0 within keys; without keys by a range sort and the sizes of its partitions, not in one task."""
    if keys:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"))
    ranges = ranges.withColumn("_place", F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)))
    return _with_base(ranges, name)


def _with_base(ranges: DataFrame, name: str) -> DataFrame:
    """Adds to each row's place in its partition the rows of the partitions before; ranges must give the same partitions twice, so it is checkpointed."""
    ranges = checkpointed(ranges)
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))  # one row per partition
    return ranges.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_place")).drop("_part", "_place", "_base")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="waymark-shared-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def in_tasks(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by its keys in a given number of partitions: for groups whose tasks are long for their few bytes, which would be merged by size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def broadcast_small(df: DataFrame, most: int = 200_000) -> DataFrame:
    """df to be broadcast if it has no more rows than that (of numbers and short strings: some 30 MB), else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def even_subsample(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The rows number floor(i * N / n), i under n, of each key (all rows if there are no more than n)."""
    rows = numbered(df, keys, order)
    if keys:
        rows = rows.withColumn("_all", F.count("*").over(Window.partitionBy(*keys)))
    else:
        rows = rows.withColumn("_all", F.lit(df.count()))
    i = F.ceil(F.col("rn") * n / F.col("_all")).cast("long")
    hit = F.floor(i * F.col("_all") / n).cast("long") == F.col("rn")
    return rows.filter((F.col("_all") <= n) | (hit & (i < n))).drop("rn", "_all")


def stride_subsample(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Every ceil(N / n)-th row of each key, n at most."""
    every = Window.partitionBy(*keys)
    rows = numbered(df, keys, order).withColumn("_stride", F.greatest(F.lit(1), F.ceil(F.count("*").over(every) / n)))
    return rows.filter((F.col("rn") % F.col("_stride") == 0) & (F.floor(F.col("rn") / F.col("_stride")) < n)).drop("rn", "_stride")


def every_nth(df: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """Rows 0, n, 2n ... of each key."""
    return numbered(df, keys, order).filter(F.col("rn") % n == 0).drop("rn")


def top_k(df: DataFrame, k: int, keys: list[str], order: list) -> DataFrame:
    """The first k rows of each key by an order (Spark cuts every task's rows to k first)."""
    if not keys:
        return df.orderBy(*order).limit(k)
    return df.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rn") <= k).drop("rn")


def best_and_second(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """Best and second-best score of each key, the best row's tie column, their gap and ratio."""
    two = top_k(df, 2, keys, [F.desc(score), tie]).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie)))
    out = two.groupBy(*keys).agg(F.max(F.when(F.col("rn") == 1, F.col(tie))).alias("best"), F.max(F.when(F.col("rn") == 1, F.col(score))).alias("best_score"), F.max(F.when(F.col("rn") == 2, F.col(score))).alias("second_score"))
    return out.withColumn("gap", F.col("best_score") - F.col("second_score")).withColumn("ratio", F.try_divide(F.col("second_score"), F.col("best_score")))


def mode_cluster(df: DataFrame, width: int, keys: list[str], time: str) -> DataFrame:
    """Rows in each key's most frequent bucket of time (ties to the earlier bucket)."""
    rows = df.withColumn("bucket", F.floor(F.col(time) / width).cast("long"))
    counts = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n"))
    best = counts.groupBy(*keys).agg(F.max_by("bucket", F.struct("n", -F.col("bucket"))).alias("bucket"))
    return rows.join(best, [*keys, "bucket"])


def weighted_sample(df: DataFrame, n: int, keys: list[str], weight: str, order: str, seed: int = 1) -> DataFrame:
    """n rows of each key without replacement by weight: largest u ** (1 / weight), u from a hash of seed and order."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col(order)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    return top_k(df.withColumn("_key", F.pow(u, 1 / F.col(weight))), n, keys, [F.desc("_key"), order]).drop("_key")


def fenced(results: DataFrame, sessions: DataFrame, keys: list[str], time: str, session: str, ident: str, age: int) -> DataFrame:
    """Results whose key's session, at their time, is still the one of age before, when they were asked for; a key before its first session has none, which counts as one.

    sessions are (keys, session, time of their start).
    """
    from waymark.operators import asof

    begun = sessions.select(*keys, F.col(session).alias(ident), time)
    then = results.withColumn("_now", F.col(time)).withColumn(time, F.col(time) - age)
    asked = asof.backward(then.select(*keys, ident, time), begun, keys, time, ident, [], ident).select(ident, F.col("match_time").alias("_asked"))
    now = asof.backward(results.select(*keys, ident, time), begun, keys, time, ident, [], ident).select(ident, F.col("match_time").alias("_begun"))
    both = results.join(asked, ident, "left").join(now, ident, "left")
    return both.filter(F.col("_asked").eqNullSafe(F.col("_begun"))).drop("_asked", "_begun")
