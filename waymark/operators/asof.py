"""As-of, nearest and interpolating joins on time, by buckets instead of range joins.

Right rows carry their time bucket, left rows are offered the buckets that a tolerance
reaches, so the join is an equi-join on key and bucket; one aggregate then keeps the best
match. Interpolating joins merge both sides into one ordered sequence and look back and ahead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, tolerance: int, left_id: str, right_id: str, values: list[str]) -> DataFrame:
    """left with the values, time and id of the right row nearest in time within tolerance (ties: earlier, then smaller id); null without one.

    Two buckets of twice the tolerance hold all matches of a row. left_id is unique in left.
    """
    width = 2 * tolerance
    r = right.select(*keys, (F.floor(F.col(time) / width)).cast("long").alias("_b"), F.struct(F.col(time).alias("t"), F.col(right_id).alias("id"), *values).alias("_r"))
    lo, hi = (F.floor((F.col(time) + d) / width).cast("long") for d in (-tolerance, tolerance))
    offered = left.select(*keys, left_id, F.col(time).alias("_t"), F.explode(F.array_distinct(F.array(lo, hi))).alias("_b"))
    pairs = offered.join(r, [*keys, "_b"]).withColumn("_d", F.abs(F.col("_t") - F.col("_r.t"))).filter(F.col("_d") <= tolerance)
    best = pairs.groupBy(*keys, left_id).agg(F.min(F.struct("_d", "_r")).alias("_m"))
    out = left.join(best, [*keys, left_id], "left")
    return out.select(*left.columns, F.col("_m._r.t").alias("match_time"), F.col("_m._r.id").alias("match_id"), F.col("_m._d").alias("match_dt"), *[F.col(f"_m._r.{v}").alias(f"match_{v}") for v in values])


def _merged(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, values: list[str], order: str) -> DataFrame:
    sides = right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.col(order).cast("long").alias("_o"), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.struct(F.col(time).alias("t"), *values).alias("_r"))
    return sides.unionByName(left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.col(left_id).cast("long").alias("_o"), left_id, F.lit(None).cast(sides.schema["_r"].dataType).alias("_r")))


def backward(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, values: list[str], order: str) -> DataFrame:
    """left with the values and time of the last right row at or before its time; null without one."""
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "_o").rowsBetween(Window.unboundedPreceding, 0)
    rows = _merged(left, right, keys, time, left_id, values, order).withColumn("_m", F.last("_r", True).over(w)).filter("_side = 1")
    return rows.select(*keys, left_id, F.col("_t").alias(time), F.col("_m.t").alias("match_time"), *[F.col(f"_m.{v}").alias(f"match_{v}") for v in values])


def around(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, values: list[str], order: str) -> DataFrame:
    """left with structs before and after: the right rows around its time (before may be at it)."""
    base = Window.partitionBy(*keys).orderBy("_t", "_side", "_o")
    rows = _merged(left, right, keys, time, left_id, values, order)
    rows = rows.withColumn("before", F.last("_r", True).over(base.rowsBetween(Window.unboundedPreceding, 0))).withColumn("after", F.first("_r", True).over(base.rowsBetween(0, Window.unboundedFollowing)))
    return rows.filter("_side = 1").select(*keys, left_id, F.col("_t").alias(time), "before", "after")


def interpolate(left: DataFrame, right: DataFrame, keys: list[str], time: str, left_id: str, value: str, max_gap: int, edge: int, order: str) -> DataFrame:
    """left with the value interpolated between the right rows around it.

    Null if those lie further apart than max_gap; beyond the first or last row its own value
    holds for as long as edge.
    """
    rows = around(left, right, keys, time, left_id, [value], order)
    a, b, t = F.col("before"), F.col("after"), F.col(time)
    share = F.coalesce(F.try_divide(t - a["t"], b["t"] - a["t"]), F.lit(0.0))
    inside = F.when(b["t"] - a["t"] <= max_gap, a[value] + share * (b[value] - a[value])).when(a["t"] == t, a[value])
    out = F.when(a.isNotNull() & b.isNotNull(), inside).when(a.isNotNull() & (t - a["t"] <= edge), a[value]).when(b.isNotNull() & (b["t"] - t <= edge), b[value])
    return rows.select(*keys, left_id, time, out.alias(value))


def interpolation_share(time: str = "t") -> Column:
    """Place of a row between before and after, 0 to 1, held at the ends."""
    a, b, t = F.col("before"), F.col("after"), F.col(time)
    return F.when(a.isNull(), 1.0).when(b.isNull(), 0.0).otherwise(F.coalesce(F.try_divide(t - a["t"], b["t"] - a["t"]), F.lit(0.0)))
