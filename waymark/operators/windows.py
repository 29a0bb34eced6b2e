"""Trailing windows, integrals, guards and the like over ordered rows of a key."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import pose, scalars


def by(keys: list[str], order: list[str]):
    """Window of a key in an order."""
    return Window.partitionBy(*keys).orderBy(*order)


def pose_deltas(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each pose (x, y, z, qw ... qz) seen from the one before it; the first of a key is left out."""
    w = by(keys, order)
    names = ["x", "y", "z", "qw", "qx", "qy", "qz"]
    rows = df.withColumns({f"_{n}": F.lag(n).over(w) for n in names}).filter("_qw is not null")
    q, t = pose.relative((pose.named("_"), tuple(F.col(f"_{c}") for c in "xyz")), (pose.named(), tuple(F.col(c) for c in "xyz")))
    return rows.withColumns({f"d{n}": c for n, c in zip(["qw", "qx", "qy", "qz", "x", "y", "z"], [*q, *t], strict=True)}).drop(*[f"_{n}" for n in names])


def trapezoid(df: DataFrame, keys: list[str], time: str, value: str, order: list[str], max_gap: int, least: int) -> DataFrame:
    """Per key the trapezoid integral of value over time in seconds, its samples, and whether no gap is too long and there are enough."""
    w = by(keys, order)
    rows = df.withColumn("_dt", F.col(time) - F.lag(time).over(w)).withColumn("_v", F.lag(value).over(w))
    area = F.sum(F.col("_dt") / 1e6 * (F.col(value) + F.col("_v")) / 2)
    return rows.groupBy(*keys).agg(F.coalesce(area, F.lit(0.0)).alias("distance"), F.count("*").alias("n"), (F.coalesce(F.max("_dt"), F.lit(0)) <= max_gap).alias("_ok")).withColumn("valid", F.col("_ok") & (F.col("n") >= least)).drop("_ok")


def trailing_sum(df: DataFrame, keys: list[str], time: str, value: str, span: int) -> DataFrame:
    """Sum of a value over the time span up to each row."""
    return df.withColumn("trailing", F.sum(value).over(Window.partitionBy(*keys).orderBy(time).rangeBetween(-span, 0)))


def trailing_robust(df: DataFrame, keys: list[str], time: str, value: str, span: int, least: int, floor: float) -> DataFrame:
    """Median and MAD over the time span up to each row (rows of its own time too) where it holds enough rows, and whether the value stands out of the noise 1.4826 MAD (floor at least).

    An ordered fold with a sorted buffer of the values in the span: a row costs a search in it, and
    the spread a walk outwards from its middle, with no list per row. Null values don't count.
    """
    from waymark.operators.folds import fold

    def middle(a: list) -> float:
        return (a[(len(a) - 1) // 2] + a[len(a) // 2]) / 2

    def spread(a: list, m: float) -> float:
        """The median of the distances from m: the sorted values are taken from the middle outwards."""
        hi = bisect_left(a, m)
        lo, out, need = hi - 1, 0.0, (len(a) - 1) // 2
        kept = 0.0
        for k in range(len(a) // 2 + 1):
            if hi >= len(a) or (lo >= 0 and m - a[lo] <= a[hi] - m):
                out, lo = m - a[lo], lo - 1
            else:
                out, hi = a[hi] - m, hi + 1
            if k == need:
                kept = out
        return (kept + out) / 2

    def start():
        def finish(state):
            window, ordered, now = state
            if len(ordered) < least or not now:
                return []
            m = middle(ordered)
            mad = spread(ordered, m)
            return [{**row, "bias": m, "mad": mad, "stands_out": None if row[value] is None else abs(row[value] - m) > max(floor, 1.4826 * mad)} for row in now]

        def step(state, row):
            window, ordered, now = state
            out = []
            if now and row[time] != now[0][time]:
                out, now = finish(state), []
            while window and window[0][0] < row[time] - span:
                ordered.pop(bisect_left(ordered, window.popleft()[1]))
            if row[value] is not None:
                window.append((row[time], row[value]))
                insort(ordered, row[value])
            return (window, ordered, [*now, row]), out

        return (deque(), [], []), step, finish

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return fold(df, keys, [time], start, f"{schema}, bias double, mad double, stands_out boolean")


def last_frames_by_points(df: DataFrame, keys: list[str], order: list[str], points: str, most: int) -> DataFrame:
    """The newest rows of each key whose points together stay within most (the newest always)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]).rowsBetween(Window.unboundedPreceding, 0)
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))
    return df.withColumn("_s", F.sum(points).over(w)).withColumn("_n", newest).filter((F.col("_s") <= most) | (F.col("_n") == 1)).drop("_s", "_n")


def monotonic(df: DataFrame, keys: list[str], arrival: list[str], stamp: str) -> DataFrame:
    """Rows, in order of arrival, whose stamp is over all before it."""
    seen = F.max(stamp).over(by(keys, arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_seen", seen).filter(F.col("_seen").isNull() | (F.col(stamp) > F.col("_seen"))).drop("_seen")


def dedupe_by_time(df: DataFrame, keys: list[str], order: list[str], time: str, tolerance: int) -> DataFrame:
    """Rows, in order, later than the last kept one by more than tolerance, with how many of the key were dropped since then (dropped).

    What is kept depends on all kept before, so this is an ordered fold, one task per key.
    """
    from waymark.operators.folds import fold

    def start():
        def step(state, row):
            last, dropped = state
            if last is None or row[time] - last > tolerance:
                return (row[time], 0), [{**row, "dropped": dropped}]
            return (last, dropped + 1), []

        return (None, 0), step

    schema = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    return fold(df, keys, order, start, f"{schema}, dropped long")


def segments(df: DataFrame, keys: list[str], order: list[str], time: str, gap: int) -> DataFrame:
    """Rows with the number of their segment: a new one begins after a gap longer than that."""
    w = by(keys, order)
    new = (F.col(time) - F.lag(time).over(w) > gap).cast("long")
    return df.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def integrate_yaw(df: DataFrame, keys: list[str], order: list[str], time: str, rate: str, max_dt: int) -> DataFrame:
    """Running heading from a turn rate, steps longer than max_dt left out, in [-pi, pi]."""
    w = by(keys, order)
    dt = F.col(time) - F.lag(time).over(w)
    rows = df.withColumn("_step", F.when((dt > 0) & (dt <= max_dt), F.col(rate) * dt / 1e6).otherwise(0.0))
    return rows.withColumn("yaw", scalars.wrap_angle(F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_step")


def running_metrics(df: DataFrame, keys: list[str], order: list[str], error: str) -> DataFrame:
    """Running largest, mean and root mean square of an error."""
    w = by(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({"running_max": F.max(error).over(w), "running_mean": F.avg(error).over(w), "running_rmse": F.sqrt(F.avg(F.col(error) ** 2).over(w))})


def count_windows(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """Rows with the number of their window of k rows; an unfinished last window is left out."""
    rows = df.withColumn("_rn", F.row_number().over(by(keys, order)) - 1).withColumn("window", F.floor(F.col("_rn") / k).cast("long"))
    full = F.count("*").over(Window.partitionBy(*keys, "window"))
    return rows.withColumn("_full", full).filter(F.col("_full") == k).drop("_rn", "_full")


def stationarity(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, most: float) -> DataFrame:
    """Mean and sample variance of the last rows, and whether the variance is small, once that many are there."""
    w = by(keys, order).rowsBetween(-(rows - 1), 0)
    out = df.withColumns({"n": F.count("*").over(w), "mean": F.avg(value).over(w), "variance": F.var_samp(value).over(w)}).filter(F.col("n") == rows)
    return out.withColumn("stationary", F.col("variance") < most)


def path_stats(df: DataFrame, keys: list[str], order: list[str], time: str) -> DataFrame:
    """First and last stamp, bounds and path length of each key."""
    w = by(keys, order)
    step = F.sqrt((F.col("x") - F.lag("x").over(w)) ** 2 + (F.col("y") - F.lag("y").over(w)) ** 2)
    return df.withColumn("_step", step).groupBy(*keys).agg(F.min(time).alias("first"), F.max(time).alias("last"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.coalesce(F.sum("_step"), F.lit(0.0)).alias("length"))


def consecutive_errors(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the absolute and the consecutive relative root mean square error, the largest error and the end-to-end drift of pairs (x, y) and (gx, gy)."""
    w = by(keys, order)
    e = lambda c: F.col(c) - F.col(f"g{c}")
    rows = df.withColumns({"_ex": e("x"), "_ey": e("y")}).withColumns({"_dx": F.col("_ex") - F.lag("_ex").over(w), "_dy": F.col("_ey") - F.lag("_ey").over(w)})
    err = F.sqrt(F.col("_ex") ** 2 + F.col("_ey") ** 2)
    ends = [f(F.struct("_ex", "_ey"), F.struct(*order)) for f in (F.min_by, F.max_by)]
    out = rows.groupBy(*keys).agg(F.sqrt(F.avg(err**2)).alias("ate"), F.sqrt(F.avg(F.col("_dx") ** 2 + F.col("_dy") ** 2)).alias("rpe"), F.max(err).alias("max_error"), ends[0].alias("_a"), ends[1].alias("_b"))
    drift: Column = F.sqrt((F.col("_b._ex") - F.col("_a._ex")) ** 2 + (F.col("_b._ey") - F.col("_a._ey")) ** 2)
    return out.withColumn("drift", drift).drop("_a", "_b")
