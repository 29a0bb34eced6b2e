"""Row filters, gates and rule classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalars import clamp, finite


def range_band(df: DataFrame, least: float, most: float, z_min: float, z_max: float) -> DataFrame:
    """Finite points with a planar range and a height inside the bands."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2)
    return df.filter(finite(F.col("x"), F.col("y"), F.col("z")) & (r >= least) & (r <= most) & F.col("z").between(z_min, z_max))


def weighted_labels(df: DataFrame, source_weight: float, class_weights: DataFrame, dynamic: int = 5) -> DataFrame:
    """Points of known, static labels with confidence, and their weight source * class * clamp(conf); class_weights is (label, class_weight), of a row per label; it is broadcast while it is small."""
    from waymark.operators.select import broadcast_small

    rows = df.filter((F.col("label") != 0) & (F.col("label") != dynamic) & (F.col("conf") > 0))
    return rows.join(broadcast_small(class_weights), "label").withColumn("weight", source_weight * F.col("class_weight") * clamp(F.col("conf"), 0, 1)).drop("class_weight")


def vertical_view(df: DataFrame, low: float, high: float) -> DataFrame:
    """df with elevation asin(z / r) in degrees and whether it lies in the field of view."""
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    up = F.degrees(F.asin(clamp(F.coalesce(F.try_divide(F.col("z"), r), F.lit(0.0)), -1, 1)))
    return df.withColumn("elevation", up).withColumn("in_view", up.between(low, high))


def depth_consistent(df: DataFrame, keys: list[str], depth: str, tolerance: float) -> DataFrame:
    """Points no deeper than the nearest of their pixel plus tolerance, with score 1 - 0.6 clip(excess / tolerance); the minima are joined back."""
    nearest = df.groupBy(*keys).agg(F.min(depth).alias("_near"))
    rows = df.join(nearest, keys).withColumn("_over", F.col(depth) - F.col("_near"))
    return rows.filter(F.col("_over") <= tolerance).withColumn("score", 1 - 0.6 * clamp(F.col("_over") / tolerance, 0, 1)).drop("_near", "_over")


def edge_scores(cells: DataFrame, radius: int, span: float) -> DataFrame:
    """(ix, iy, score): 1 down to 0.25 as the depth span of a cell's neighbourhood grows to span; cells hold z_min, z_max."""
    from waymark.operators.grid import neighbours

    near = neighbours(cells.select("ix", "iy", F.col("z_min").alias("lo"), F.col("z_max").alias("hi")), radius)
    spans = cells.select("ix", "iy").join(near, ["ix", "iy"]).groupBy("ix", "iy").agg((F.max("hi") - F.min("lo")).alias("span"))
    return spans.select("ix", "iy", (1 - 0.75 * clamp(F.col("span") / span, 0, 1)).alias("score"))


def geometry_scores(points: DataFrame, cells: DataFrame, most_road: float, least_building: float) -> DataFrame:
    """Score and verdict of each point from its label, its height over the cell's ground and the cell's span; points and cells hold ix, iy."""
    rows = points.join(cells.select("ix", "iy", "z_min", "z_max"), ["ix", "iy"])
    above, span = F.col("z") - F.col("z_min"), F.col("z_max") - F.col("z_min")
    score = F.when(F.col("label").isin(1, 2), 1 - clamp(above / most_road, 0, 1)).when(F.col("label") == 3, clamp(span / least_building, 0, 1)).otherwise(F.lit(1.0))
    return rows.withColumn("score", score).withColumn("keep", F.col("score") > 0.2).drop("z_min", "z_max")


def ground_filter(points: DataFrame, size: float, least: int, tolerance: float) -> DataFrame:
    """Points with whether they lie near the lowest height of the 3 by 3 cells around them, if those hold enough points."""
    from waymark.operators.grid import cell_stats, neighbours, with_cells

    cells = cell_stats(points, size)
    near = neighbours(cells.select("ix", "iy", "z_min", "n"), 1).groupBy("ix", "iy").agg(F.min("z_min").alias("floor"), F.sum("n").alias("support"))
    rows = with_cells(points, size, ("x", "y")).join(near, ["ix", "iy"])
    return rows.withColumn("is_ground", (F.col("support") >= least) & (F.col("z") - F.col("floor") <= tolerance)).drop("floor", "support")


def relabel_by_geometry(df: DataFrame, low: float, tall: float, support: int) -> Column:
    """Road near the ground, building where tall and supported, unless confidently dynamic."""
    fixed = (F.col("label") == 5) & (F.col("conf") > 0.8)
    return F.when(fixed, F.col("label")).when(F.col("z") - F.col("z_min") < low, 1).when((F.col("z_max") - F.col("z_min") > tall) & (F.col("n") >= support), 3).otherwise(F.col("label"))


def classify_cell() -> tuple[Column, Column]:
    """Label and confidence of a point by the rules on its cell: road, sidewalk, building, vegetation, other."""
    above, span = F.col("z") - F.col("z_min"), F.col("z_max") - F.col("z_min")
    label = F.when((above < 0.2) & (span < 0.3), 1).when((above < 0.35) & (span < 0.6), 2).when((span > 2.5) & (F.col("n") >= 8), 3).when(span > 1.0, 4).otherwise(6)
    conf = F.when((above < 0.2) & (span < 0.3), 0.8).when((above < 0.35) & (span < 0.6), 0.6).when((span > 2.5) & (F.col("n") >= 8), 0.75).when(span > 1.0, 0.6).otherwise(0.4)
    return label, conf


def first_reason(rules: list[tuple[Column, str]], otherwise: str = "accepted") -> Column:
    """The name of the first rule that holds: an ordered cascade of reasons."""
    out = None
    for condition, reason in rules:
        out = F.when(condition, reason) if out is None else out.when(condition, reason)
    return out.otherwise(otherwise) if out is not None else F.lit(otherwise)


def project_pinhole(fx: float, fy: float, cx: float, cy: float, k: tuple[float, float, float] = (0, 0, 0), p: tuple[float, float] = (0, 0)) -> tuple[Column, Column]:
    """Rounded pixel of a point ahead of a camera with radial and tangential distortion; null behind it."""
    z = F.when(F.col("z") > 0.05, F.col("z"))
    a, b = F.col("x") / z, F.col("y") / z
    r2 = a * a + b * b
    radial = 1 + k[0] * r2 + k[1] * r2 * r2 + k[2] * r2 * r2 * r2
    u = a * radial + 2 * p[0] * a * b + p[1] * (r2 + 2 * a * a)
    v = b * radial + p[0] * (r2 + 2 * b * b) + 2 * p[1] * a * b
    return F.floor(fx * u + cx + 0.5).cast("long"), F.floor(fy * v + cy + 0.5).cast("long")
