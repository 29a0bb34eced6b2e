"""Rasters as sparse rows (ix, iy, value): morphology, edges, boundaries, distances, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.grid import neighbours


def kernel(radius: int, ellipse: bool = False) -> list[tuple[int, int]]:
    """Offsets of a square or elliptic kernel."""
    span = range(-radius, radius + 1)
    return [(dx, dy) for dx in span for dy in span if not ellipse or dx * dx + dy * dy <= radius * radius]


def _spread(df: DataFrame, offsets: list[tuple[int, int]], value: str) -> DataFrame:
    """Every row once per offset, at the cell it reaches; the offsets are a literal of fixed size."""
    at = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets]))
    return df.select("ix", "iy", F.col(value).alias("v"), at.alias("o")).select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), "v")


def dilate(df: DataFrame, offsets: list[tuple[int, int]], value: str, inside: DataFrame | None = None) -> DataFrame:
    """Largest value under the kernel, for every cell it reaches (of inside, if given)."""
    out = _spread(df, offsets, value).groupBy("ix", "iy").agg(F.max("v").alias(value))
    return out if inside is None else out.join(inside.select("ix", "iy"), ["ix", "iy"], "left_semi")


def erode(df: DataFrame, offsets: list[tuple[int, int]], value: str) -> DataFrame:
    """Smallest value under the kernel for every cell of df; missing neighbours count as 0."""
    near = _spread(df, offsets, value).groupBy("ix", "iy").agg(F.min("v").alias("v"), F.count("*").alias("n"))
    out = df.select("ix", "iy").join(near, ["ix", "iy"])
    return out.select("ix", "iy", F.when(F.col("n") == len(offsets), F.col("v")).otherwise(F.least(F.col("v"), F.lit(0))).cast(df.schema[value].dataType).alias(value))


def opened(df: DataFrame, offsets: list[tuple[int, int]], value: str) -> DataFrame:
    """Erosion, then dilation, on the cells of df."""
    return dilate(erode(df, offsets, value), offsets, value, df)


def closed(df: DataFrame, offsets: list[tuple[int, int]], value: str) -> DataFrame:
    """Dilation, then erosion, on the cells of df."""
    return erode(dilate(df, offsets, value), offsets, value).join(df.select("ix", "iy"), ["ix", "iy"], "left_semi")


def edge_map(df: DataFrame, value: str) -> DataFrame:
    """min(1, |dx| + |dy|) of central differences; missing neighbours count as 0."""
    sides = {"e": (-1, 0), "w": (1, 0), "s": (0, -1), "n": (0, 1)}
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for k, (dx, dy) in sides.items()]))
    moved = df.select("ix", "iy", F.col(value).alias("v"), parts.alias("o")).select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), F.col("o.k").alias("k"), "v")
    side = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("v"))), F.lit(0.0))
    near = moved.groupBy("ix", "iy").agg((F.abs(side("e") - side("w")) / 2 + F.abs(side("s") - side("n")) / 2).alias("edge"))
    return df.select("ix", "iy").join(near, ["ix", "iy"], "left").select("ix", "iy", F.least(F.lit(1.0), F.coalesce("edge", F.lit(0.0))).alias("edge"))


def label_boundary(df: DataFrame, label: str) -> DataFrame:
    """Known cells with a known neighbour (left, right, above, below) of another label."""
    known = df.filter(F.col(label) != 0).select("ix", "iy", F.col(label).alias("own"))
    near = _spread(known, [(-1, 0), (1, 0), (0, -1), (0, 1)], "own")
    return known.join(near, ["ix", "iy"]).filter("v <> own").select("ix", "iy").distinct()


def distance_to(df: DataFrame, targets: DataFrame, clip: int) -> DataFrame:
    """Euclidean distance of each cell to the nearest target cell, clip at most."""
    near = _spread(targets.select("ix", "iy", F.lit(0).alias("z"), F.col("ix").alias("tx"), F.col("iy").alias("ty")).withColumn("t", F.struct("tx", "ty")), kernel(clip), "t")
    d = F.min(F.sqrt((F.col("ix") - F.col("v.tx")) ** 2 + (F.col("iy") - F.col("v.ty")) ** 2))
    best = near.join(df.select("ix", "iy"), ["ix", "iy"]).groupBy("ix", "iy").agg(d.alias("d"))
    return df.select("ix", "iy").join(best, ["ix", "iy"], "left").select("ix", "iy", F.least(F.coalesce("d", F.lit(float(clip))), F.lit(float(clip))).alias("distance"))


def crop_resize(df: DataFrame, value: str, x: tuple[int, int], y: tuple[int, int], factor: int) -> DataFrame:
    """The cells inside the bounds, factor by factor cells as their mean, counted from the corner."""
    inside = df.filter(F.col("ix").between(x[0], x[1] - 1) & F.col("iy").between(y[0], y[1] - 1))
    at = lambda c, lo: F.floor((F.col(c) - lo) / factor).cast("long").alias(c)
    return inside.groupBy(at("ix", x[0]), at("iy", y[0])).agg(F.avg(value).alias(value))


def refresh_prior(prior: DataFrame, hits: DataFrame, alpha: float) -> DataFrame:
    """Prior cells (occ, label) moved towards 1 by alpha times the confidence of their best hit, and given its label."""
    best = hits.groupBy("ix", "iy").agg(F.max("conf").alias("conf"), F.max_by("label", F.struct("conf", -F.col("label"))).alias("hit"))
    rows = prior.join(best, ["ix", "iy"], "left")
    return rows.select("ix", "iy", F.when(F.col("hit").isNull(), F.col("occ")).otherwise(F.col("occ") + alpha * F.col("conf") * (1 - F.col("occ"))).alias("occ"), F.coalesce("hit", "label").alias("label"))


def bilinear(points: DataFrame, raster: DataFrame, value: str, ident: str) -> DataFrame:
    """(ident, value): values between four cells at points (u, w); null unless all four are there."""
    corners = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)]))
    rows = points.select(ident, "u", "w", F.floor("u").cast("long").alias("i"), F.floor("w").cast("long").alias("j"), corners.alias("c"))
    fu, fw = F.col("u") - F.col("i"), F.col("w") - F.col("j")
    weight = F.when(F.col("c.dx") == 1, fu).otherwise(1 - fu) * F.when(F.col("c.dy") == 1, fw).otherwise(1 - fw)
    rows = rows.select(ident, weight.alias("weight"), (F.col("i") + F.col("c.dx")).alias("ix"), (F.col("j") + F.col("c.dy")).alias("iy"))
    hit = rows.join(raster.select("ix", "iy", value), ["ix", "iy"])
    return hit.groupBy(ident).agg(F.sum(F.col("weight") * F.col(value)).alias(value), F.count("*").alias("n")).filter("n = 4").drop("n")


def neighbour_pairs(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Edges (a, b) between the node ids of cells (ix, iy, node[, keys]) that touch, also by corner."""
    left = neighbours(df.select(*keys, "ix", "iy", F.col("node").alias("a")), 1)
    return left.join(df.select(*keys, "ix", "iy", F.col("node").alias("b")), [*keys, "ix", "iy"]).filter("a <> b").select("a", "b")


def node_id(ix: Column, iy: Column) -> Column:
    """One integer for a cell with coordinates of at most 31 bits."""
    return F.shiftleft(ix.cast("long"), 32).bitwiseXOR(iy.cast("long").bitwiseAND(F.lit((1 << 32) - 1)))


def sobel(df: DataFrame, value: str) -> DataFrame:
    """Horizontal and vertical Sobel sums of each cell; missing neighbours count as 0."""
    weights = {(dx, dy): (-dx * (2 - abs(dy)), -dy * (2 - abs(dx))) for dx in (-1, 0, 1) for dy in (-1, 0, 1)}
    at = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for (dx, dy), (a, b) in weights.items()])).alias("o")
    parts = df.select("ix", "iy", F.col(value).alias("v"), at).select((F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"), (F.col("v") * F.col("o.a")).alias("gx"), (F.col("v") * F.col("o.b")).alias("gy"))
    return df.select("ix", "iy").join(parts.groupBy("ix", "iy").agg(F.sum("gx").alias("gx"), F.sum("gy").alias("gy")), ["ix", "iy"])
