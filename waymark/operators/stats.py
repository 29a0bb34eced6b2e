"""Robust statistics, error metrics and closed-form fits as aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def median_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Median (mean of the middle two) and unscaled median absolute deviation of each key."""
    middle = df.groupBy(*keys).agg(F.median(value).alias("median"))
    return df.join(middle, keys).groupBy(*keys, "median").agg(F.median(F.abs(F.col(value) - F.col("median"))).alias("mad"))


def order_statistic(df: DataFrame, keys: list[str], value: str, share: float, name: str) -> DataFrame:
    """The element number floor(share * n) of each key's sorted values; counted by value, so no list is gathered."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*keys).orderBy(value)
    ranked = counts.withColumn("_upto", F.sum("_n").over(upto)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    return ranked.filter(F.col("_upto") > F.floor(share * F.col("_all"))).groupBy(*keys).agg(F.min(value).alias(name))


def replicated_median(df: DataFrame, keys: list[str], value: str, weight: str, most: int) -> DataFrame:
    """Median with each value repeated round(weight * most) times, once at least, as a percentile with frequencies."""
    times = F.greatest(F.lit(1), F.floor(F.col(weight) * most + 0.5).cast("long"))
    return df.withColumn("_times", times).groupBy(*keys).agg(F.expr(f"percentile({value}, 0.5, _times)").alias("median"))


def error_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Root mean squares, means and largest of errors ex, ey, ez."""
    rms = lambda *c: F.sqrt(F.avg(sum(F.col(x) ** 2 for x in c)))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), rms("ex").alias("rmse_x"), rms("ey").alias("rmse_y"), rms("ez").alias("rmse_z"), rms("ex", "ey").alias("rmse_2d"), rms("ex", "ey", "ez").alias("rmse_3d"),
        F.avg(F.abs("ez")).alias("mean_abs_z"), F.max(F.abs("ez")).alias("max_abs_z"), F.max(F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2 + F.col("ez") ** 2)).alias("max_3d"),
    )


def metrics_from_text(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """One number column per name, from "name number" in a text; null where it isn't there."""
    return df.select("*", *[F.expr(f"try_cast(regexp_extract({text}, '{n}\\\\s+([0-9.]+)', 1) as double)").alias(n) for n in names])


def spread(df: DataFrame, keys: list[str], x: str, y: str, inlier: str) -> DataFrame:
    """Count, inlier ratio, and root sum and root ratio of the eigenvalues of the planar covariance."""
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.col(inlier).cast("int")).alias("ratio"), F.var_pop(x).alias("a"), F.covar_pop(x, y).alias("b"), F.var_pop(y).alias("c"))
    total, root = F.col("a") + F.col("c"), F.sqrt((F.col("a") - F.col("c")) ** 2 + 4 * F.col("b") ** 2)
    low = F.greatest(F.lit(0.0), total - root)
    return s.select(*keys, "n", "ratio", F.sqrt(F.greatest(F.lit(0.0), total)).alias("spread"), F.sqrt(F.try_divide(low, total + root)).alias("spread_ratio"))


def planar_fit(df: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted rotation and shift that take (sx, sy) to (tx, ty), weight w: closed form from ten sums."""
    w = F.col("w")
    s = df.groupBy(*keys).agg(
        F.sum(w).alias("n"), *[(F.sum(w * F.col(c)) / F.sum(w)).alias(f"m{c}") for c in ("sx", "sy", "tx", "ty")],
        F.sum(w * (F.col("sx") * F.col("ty") - F.col("sy") * F.col("tx"))).alias("cross"), F.sum(w * (F.col("sx") * F.col("tx") + F.col("sy") * F.col("ty"))).alias("dot"),
    )
    cross = F.col("cross") - F.col("n") * (F.col("msx") * F.col("mty") - F.col("msy") * F.col("mtx"))
    dot = F.col("dot") - F.col("n") * (F.col("msx") * F.col("mtx") + F.col("msy") * F.col("mty"))
    s = s.withColumn("yaw", F.atan2(cross, dot))
    return s.select(*keys, "yaw", (F.col("mtx") - (F.cos("yaw") * F.col("msx") - F.sin("yaw") * F.col("msy"))).alias("dx"), (F.col("mty") - (F.sin("yaw") * F.col("msx") + F.cos("yaw") * F.col("msy"))).alias("dy"))


def slope_fit(df: DataFrame, keys: list[str], x: str, y: str, z: str, least: int, spread_least: float) -> DataFrame:
    """Least-squares slopes of z over x and y where enough points spread enough."""
    s = df.groupBy(*keys).agg(F.count("*").alias("n"), F.var_pop(x).alias("xx"), F.covar_pop(x, y).alias("xy"), F.var_pop(y).alias("yy"), F.covar_pop(x, z).alias("xz"), F.covar_pop(y, z).alias("yz"))
    det = F.col("xx") * F.col("yy") - F.col("xy") ** 2
    good = s.filter((F.col("n") >= least) & (F.col("xx") + F.col("yy") > spread_least))
    return good.select(*keys, F.try_divide(F.col("xz") * F.col("yy") - F.col("yz") * F.col("xy"), det).alias("slope_x"), F.try_divide(F.col("yz") * F.col("xx") - F.col("xz") * F.col("xy"), det).alias("slope_y"))


def class_counts(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Count and share of each label within a key."""
    n = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def weighted_moments(df: DataFrame, keys: list[str], weight: str, axes: list[str], floor: float) -> DataFrame:
    """Weight, weighted mean and variance (floor at least) of each axis."""
    w = F.col(weight)
    s = df.groupBy(*keys).agg(F.sum(w).alias("weight"), *[(F.sum(w * F.col(a)) / F.sum(w)).alias(a) for a in axes], *[(F.sum(w * F.col(a) ** 2) / F.sum(w)).alias(f"_{a}") for a in axes])
    return s.select(*keys, "weight", *axes, *[F.greatest(F.lit(floor), F.col(f"_{a}") - F.col(a) ** 2).alias(f"var_{a}") for a in axes])


def instance_clusters(df: DataFrame, key: str) -> DataFrame:
    """Count, building and dynamic shares and extents of each instance."""
    share = lambda k: F.avg((F.col("label") == k).cast("int")).alias(f"share{k}")
    return df.groupBy(key).agg(F.count("*").alias("n"), share(3), share(5), *[(F.max(a) - F.min(a)).alias(f"d{a}") for a in "xyz"])


def label_map(df: DataFrame, keys: list[str], label: str, weight: str) -> DataFrame:
    """The label with most weight of each key (ties to the smaller) and its share of all weight."""
    votes = df.groupBy(*keys, label).agg(F.sum(weight).alias("v"))
    return votes.groupBy(*keys).agg(F.max_by(label, F.struct(F.round("v", 9), -F.col(label))).alias(label), (F.max("v") / F.sum("v")).alias("confidence"))


def normalize_patch(df: DataFrame, patch: str, least: float) -> DataFrame:
    """df with the patch less its mean over its deviation, and that deviation; flat patches are left out."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    rows = df.withColumn("_p", F.transform(patch, lambda x: x.cast("double"))).withColumn("_m", total(F.col("_p")) / F.size("_p"))
    rows = rows.withColumn("sigma", F.sqrt(total(F.transform("_p", lambda x: (x - F.col("_m")) * (x - F.col("_m")))) / F.size("_p"))).filter(F.col("sigma") >= least)
    return rows.withColumn("patch", F.transform("_p", lambda x: (x - F.col("_m")) / F.col("sigma"))).drop("_p", "_m")
