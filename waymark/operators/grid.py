"""Cells, voxels and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.scalars import cell, clamp, finite

CELL3 = ["ix", "iy", "iz"]


def with_cells(df: DataFrame, size: float, axes: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """df with the integer cell of each axis, ix, iy[, iz]."""
    return df.withColumns({f"i{a}": cell(F.col(a), size) for a in axes})


def voxel_centroid(df: DataFrame, size: float, keys: list[str] = ()) -> DataFrame:
    """Centroid and count of the points of each voxel (and key)."""
    return with_cells(df, size).groupBy(*keys, *CELL3).agg(*[F.avg(a).alias(a) for a in "xyz"], F.count("*").alias("n"))


def first_per_voxel(df: DataFrame, size: float, order: str) -> DataFrame:
    """The first point of each voxel by an order column; an aggregate, so no voxel is sorted in one task."""
    columns = [F.col(c) for c in df.columns]
    return with_cells(df, size).groupBy(*CELL3).agg(F.min_by(F.struct(*columns), order).alias("p")).select("p.*", *CELL3)


def strongest_per_cell(df: DataFrame, size: float, label: str, weight: str, order: str) -> DataFrame:
    """The heaviest point of each voxel and label, ties to the smallest order value.

    The largest weights are one number per voxel and label, so they are hashed, not sorted; the
    points that have them, few, are joined back and the ties among them settled.
    """
    rows = with_cells(df, size)
    top = rows.groupBy(*CELL3, label).agg(F.max(weight).alias("_top"))
    same = F.col(label).eqNullSafe(F.col("_label")) & F.col(weight).eqNullSafe(F.col("_top"))
    for c in CELL3:
        same = same & (F.col(c) == F.col(f"_{c}"))
    heavy = rows.join(top.select(*[F.col(c).alias(f"_{c}") for c in CELL3], F.col(label).alias("_label"), "_top").hint("shuffle_hash"), same).select(*df.columns, *CELL3)
    pick = F.min_by(F.struct(*df.columns), F.col(order))
    return heavy.groupBy(*CELL3, label).agg(pick.alias("p")).select("p.*", *CELL3)


def vote_fusion(df: DataFrame, size: float, labels: list[int], scale: float, min_confidence: float, label: str = "label", weight: str = "conf") -> DataFrame:
    """Labelled voxels from weighted votes.

    Each voxel gets the weighted mean of its points, the label with most votes (ties to the
    smaller label) and the confidence (0.65 purity + 0.35 margin) * (0.45 + 0.55 (1 - exp(-votes / scale)));
    voxels under min_confidence are left out. One aggregate with a sum per label.
    """
    w = F.col(weight)
    votes = [F.sum(F.when(F.col(label) == k, w).otherwise(0.0)).alias(f"v{k}") for k in labels]
    cells = with_cells(df, size).groupBy(*CELL3).agg(F.sum(w).alias("votes"), F.count("*").alias("n"), *[(F.sum(F.col(a) * w) / F.sum(w)).alias(a) for a in "xyz"], *votes)
    ranked = F.array_sort(F.array(*[F.struct((-F.round(F.col(f"v{k}"), 9)).alias("minus"), F.lit(k).alias("k")) for k in labels]))
    cells = cells.withColumn("r", ranked).withColumn("best", -F.col("r")[0]["minus"]).withColumn("second", -F.col("r")[1]["minus"] if len(labels) > 1 else F.lit(0.0))
    purity, margin = F.col("best") / F.col("votes"), (F.col("best") - F.col("second")) / F.col("votes")
    cells = cells.withColumn("confidence", clamp((0.65 * purity + 0.35 * margin) * (0.45 + 0.55 * (1 - F.exp(-F.col("votes") / scale))), 0, 1))
    return cells.filter(F.col("confidence") >= min_confidence).select(*CELL3, "x", "y", "z", "n", "votes", F.col("r")[0]["k"].alias("label"), "confidence")


def keyframe_features(df: DataFrame, size: float, label: str = "label", weight: str = "conf", excluded: int = 5, structural: tuple[int, ...] = (3, 4), ground: int = 1, keys: list[str] = ()) -> DataFrame:
    """One feature per cell: weighted mean, height range, count, label (of those with votes over 0.5, never 0 or the excluded) and flags."""
    some = [k for k in range(1, 7) if k != excluded]
    w = F.col(weight)
    cells = with_cells(df, size, ("x", "y")).groupBy(*keys, "ix", "iy").agg(
        *[(F.sum(F.col(a) * w) / F.sum(w)).alias(a) for a in "xyz"], F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count("*").alias("n"),
        *[F.sum(F.when(F.col(label) == k, w).otherwise(0.0)).alias(f"v{k}") for k in some],
    )
    best = F.array_sort(F.array(*[F.struct((-F.round(F.col(f"v{k}"), 9)).alias("minus"), F.lit(k).alias("k")) for k in some]))[0]
    cells = cells.withColumn("label", F.when(-best["minus"] > 0.5, best["k"]).otherwise(0)).drop(*[f"v{k}" for k in some])
    return cells.withColumn("structural", F.col("label").isin(*structural) | (F.col("z_max") - F.col("z_min") > 1.5)).withColumn("ground", (F.col("label") == ground) & (F.col("z_max") - F.col("z_min") <= 0.5))


def optimised_map(features: DataFrame, poses: DataFrame, frame: str, order: str, size: float, most: int) -> DataFrame:
    """(ix, iy, iz, x, y, z, label, confidence, n): labelled features (frame, order, x, y, z, label, conf) carried by their frames' poses (px, py, pz, yaw) into voxels.

    Every stride-th labelled feature of a frame with a pose counts, in the order of frame and order
    column, so that most are left; a feature weighs its conf, 0.1 at least. A voxel has the weighted
    mean, the label of the largest weight (ties: the smaller) and that weight's share. Label 0 and
    null labels, and features that don't come out finite, don't count. Sums run in the order of
    frame and order column, so that they are the same however the rows are partitioned.
    """
    from waymark.operators.select import numbered

    rows = features.filter("label <> 0").join(poses.select(frame, "px", "py", "pz", "yaw"), frame)
    stride = max(1, -(-rows.count() // max(1, most)))
    if stride > 1:
        rows = numbered(rows, [], [frame, order]).filter(F.col("rn") % stride == 0)
    c, s = F.cos("yaw"), F.sin("yaw")
    there = {"x": F.col("px") + c * F.col("x") - s * F.col("y"), "y": F.col("py") + s * F.col("x") + c * F.col("y"), "z": F.col("pz") + F.col("z")}
    rows = rows.withColumns(there).filter(finite(F.col("x"), F.col("y"), F.col("z"))).withColumn("w", F.greatest(F.lit(0.1), F.coalesce("conf", F.lit(0.0))))
    members = F.sort_array(F.collect_list(F.struct(F.col(frame).alias("_f"), F.col(order).alias("_o"), "label", "w", *"xyz")))  # few, as most features are left
    cells = with_cells(rows, size).groupBy(*CELL3).agg(members.alias("m"))
    total = lambda rows, value: F.aggregate(rows, F.lit(0.0), lambda s, p: s + value(p))
    votes = F.transform(F.array_distinct("m.label"), lambda k: F.struct(k.alias("label"), total(F.filter("m", lambda p: p["label"] == k), lambda p: p["w"]).alias("w")))
    best = F.array_min(F.transform(votes, lambda p: F.struct((-F.round(p["w"], 9)).alias("_m"), p["label"].alias("label"), p["w"].alias("w"))))
    w = total("m", lambda p: p["w"])
    cells = cells.withColumns({"w": w, "best": best, **{a: total("m", lambda p, a=a: p[a] * p["w"]) for a in "xyz"}})
    return cells.select(*CELL3, *[(F.col(a) / F.col("w")).alias(a) for a in "xyz"], "best.label", clamp(F.col("best.w") / F.col("w"), 0, 1).alias("confidence"), F.size("m").cast("long").alias("n"))


def ring_descriptor(df: DataFrame, rings: int, width: float, keys: list[str]) -> DataFrame:
    """Per key and ring around the origin the shares of structural, ground and labelled features."""
    ring = F.floor(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) / width).cast("int")
    return df.withColumn("ring", ring).filter(F.col("ring") < rings).groupBy(*keys, "ring").agg(
        F.avg(F.col("structural").cast("double")).alias("structural_share"), F.avg(F.col("ground").cast("double")).alias("ground_share"), F.avg((F.col("label") > 0).cast("double")).alias("labelled_share"),
    )


def cell_stats(df: DataFrame, size: float) -> DataFrame:
    """Height range and count of each planar cell."""
    return with_cells(df, size, ("x", "y")).groupBy("ix", "iy").agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count("*").alias("n"))


def cell_features(df: DataFrame, size: float, intensity: str) -> DataFrame:
    """Full feature set of each planar cell: heights, population deviations (from sums, clipped at 0), intensity, density."""
    std = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.avg(F.col(c) ** 2) - F.avg(c) ** 2))
    return with_cells(df, size, ("x", "y")).groupBy("ix", "iy").agg(
        F.count("*").alias("n"), F.avg("z").alias("z_mean"), std("z").alias("z_std"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), (F.max("z") - F.min("z")).alias("z_range"),
        F.avg(intensity).alias("i_mean"), std(intensity).alias("i_std"), F.ln(1 + F.count("*")).alias("density"),
    )


def neighbours(df: DataFrame, radius: int, axes: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """df once for every cell within radius: the cell columns become those of the neighbour, an equi-join key."""
    out = df
    for a in axes:
        out = out.withColumn(a, F.explode(F.sequence(F.col(a) - radius, F.col(a) + radius)))
    return out


def diverse_top_k(df: DataFrame, k: int, size: float, score: str, order: str, growth: float = 1.35, tries: int = 3) -> DataFrame:
    """At most k rows spread in space: the cell grows until few enough are occupied, the best row of each counts, then an even pick."""
    from waymark.operators.select import even_subsample

    for _ in range(tries):
        if with_cells(df, size).select(*CELL3).distinct().count() <= k:
            break
        size *= growth
    best = F.max_by(F.struct(*df.columns), F.struct(F.col(score), -F.col(order)))
    rows = with_cells(df, size).groupBy(*CELL3).agg(best.alias("p")).select("p.*")
    return even_subsample(rows, k, [], [order])


def ray_fill(df: DataFrame, center: tuple[int, int], weight: str) -> DataFrame:
    """Cells on the segments from a centre to the hit cells, with the largest weight that crosses each."""
    dx, dy = F.col("ix") - center[0], F.col("iy") - center[1]
    steps = F.greatest(F.abs(dx), F.abs(dy), F.lit(1))
    rays = df.select(dx.alias("dx"), dy.alias("dy"), steps.alias("steps"), weight, F.explode(F.sequence(F.lit(0).cast("long"), steps.cast("long"))).alias("s"))
    at = lambda d, c: (F.lit(c) + F.rint(F.col(d) * F.col("s") / F.col("steps"))).cast("long")
    return rays.select(at("dx", center[0]).alias("ix"), at("dy", center[1]).alias("iy"), weight).groupBy("ix", "iy").agg(F.max(weight).alias(weight))


def saturating_occupancy(df: DataFrame, size: float, gain: float, weight: str = "conf") -> DataFrame:
    """Occupancy min(1, gain * weights), height range and quality of each cell, and the label of its last point by id."""
    return with_cells(df, size, ("x", "y")).groupBy("ix", "iy").agg(
        F.least(F.lit(1.0), F.sum(gain * F.col(weight))).alias("occ"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.max(weight).alias("quality"),
        F.max_by("label", F.when(F.col("label") != 0, F.col("id"))).alias("label"),
    )


def density_layers(df: DataFrame, size: float, ground_z: float, clip: float) -> DataFrame:
    """Counts of obstacles and ground and clipped height of each cell, log-compressed and scaled to the largest of all cells."""
    cells = with_cells(df, size, ("x", "y")).groupBy("ix", "iy").agg(
        F.count("*").alias("n"), F.sum((F.col("z") > ground_z).cast("long")).alias("obstacle"), F.sum((F.col("z") <= ground_z).cast("long")).alias("ground"), F.max(F.least(F.col("z"), F.lit(clip))).alias("height"),
    )
    top = cells.agg(*[F.max(F.log1p(F.col(c))).alias(f"top_{c}") for c in ("n", "obstacle", "ground")], F.max("height").alias("top_height"))
    out = cells.join(F.broadcast(top))  # one row
    scaled = [F.coalesce(F.try_divide(F.log1p(F.col(c)), F.col(f"top_{c}")), F.lit(0.0)).alias(c) for c in ("n", "obstacle", "ground")]
    return out.select("ix", "iy", *scaled, F.coalesce(F.try_divide(F.col("height"), F.col("top_height")), F.lit(0.0)).alias("height"))


def box_blur_labels(df: DataFrame, radius: int, min_share: float) -> DataFrame:
    """Label of each cell by majority in its window, if its share of known labels is large enough; else 0."""
    votes = neighbours(df.filter("label <> 0").select("ix", "iy", F.col("label").alias("near")), radius)
    counts = df.select("ix", "iy").join(votes, ["ix", "iy"]).groupBy("ix", "iy", "near").agg(F.count("*").alias("n"))
    best = counts.groupBy("ix", "iy").agg(F.max_by("near", F.struct("n", -F.col("near"))).alias("near"), (F.max("n") / F.sum("n")).alias("support"))
    out = df.select("ix", "iy").join(best, ["ix", "iy"], "left")
    return out.select("ix", "iy", F.when(F.col("support") >= min_share, F.col("near")).otherwise(0).alias("label"), F.coalesce("support", F.lit(0.0)).alias("support"))


def weight_of(label: Column, weights: dict[int, float]) -> Column:
    """Class weight of a label; 1 for labels not named."""
    out = F.lit(1.0)
    for k, w in weights.items():
        out = F.when(label == k, float(w)).otherwise(out)
    return out


def window_rank(keys: list[str], order: list[Column]) -> Column:
    """Row number within keys by an order."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
