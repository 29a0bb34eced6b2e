"""Pose scoring on lattices and robust fitting by hypotheses.

Small lattices of candidates are a literal of checked size that is exploded onto points already
summed to cells; scoring is an equi-join with the raster and one aggregate. Poses on a prior map
are searched by branch and bound, a key in a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators import branch
from waymark.operators.select import checkpointed, in_tasks

#: Candidates that one search may have.
MAX_CANDIDATES = 20_000


def lattice(dx: list[float], dy: list[float], yaw: list[float]) -> Column:
    """Candidates (c, dx, dy, yaw), numbered in the order yaw, x, y. More than MAX_CANDIDATES are refused; search such a lattice in levels."""
    all_ = [(a, x, y) for a in yaw for x in dx for y in dy]
    if len(all_) > MAX_CANDIDATES:
        raise ValueError(f"{len(all_)} candidates, {MAX_CANDIDATES} at most")
    return F.array(*[F.struct(F.lit(k).alias("c"), F.lit(float(x)).alias("dx"), F.lit(float(y)).alias("dy"), F.lit(math.cos(a)).alias("cos"), F.lit(math.sin(a)).alias("sin"), F.lit(float(a)).alias("yaw")) for k, (a, x, y) in enumerate(all_)])


@dataclass(frozen=True)
class Localization:
    """Weights of a point's score, search window and steps, and the gates of a match on a prior map."""

    occupancy: float = 1.0
    edge: float = 0.5
    semantic: float = 0.3
    dynamic: float = 0.2
    min_radius: float = 1.0
    max_radius: float = 3.0
    gamma: float = 1.0
    step: float = 1.0
    yaw: float = 0.05
    yaw_step: float = 0.05
    fine_step: float = 0.5
    fine_yaw: float = 0.02
    fine_yaw_step: float = 0.02
    inlier: float = 0.3
    min_ratio: float = 0.2
    min_gap: float = 0.01
    min_confidence: float = 0.3


def _axis(center: float, radius: float, step: float) -> np.ndarray:
    """Samples from center - radius to center + radius, no farther apart than step."""
    n = max(1, math.ceil(2 * radius / step) + 1)
    return center - radius + 2 * radius / (n - 1) * np.arange(n) if n > 1 else np.array([center])


#: Cells of the map are dealt out in tiles of this many a side.
TILE = 32


def _on_map(points: pd.DataFrame, cells: pd.DataFrame, size: float, how: Localization) -> dict:
    """One key's search: points with the key's start, and the cells of the map within reach."""
    label, dynamic = points["label"].fillna(0).astype(int).to_numpy(), points["dynamic"].fillna(False).astype(bool).to_numpy()
    n = points["n"].fillna(0).to_numpy(float)
    cells = cells.sort_values(["ix", "iy", "occ", "edge", "there"], ascending=[True, True, False, False, False], na_position="last").drop_duplicates(["ix", "iy"])
    cells = cells[(cells["ix"].abs() < branch.FAR) & (cells["iy"].abs() < branch.FAR)]
    ix, iy, there = cells["ix"].to_numpy(np.int64), cells["iy"].to_numpy(np.int64), cells["there"].fillna(0).astype(int).to_numpy()
    occ, edge = cells["occ"].to_numpy(float), cells["edge"].to_numpy(float)
    kinds, classes = np.unique(np.c_[label, dynamic], axis=0, return_inverse=True)
    meets = ((occ > 0.01) | (edge > 0.01)) & ~np.isnan(occ + edge)
    values = np.zeros((len(cells), len(kinds) + 1))
    for k, (of, moving) in enumerate(kinds):
        semantic = np.where((there != 0) & (of != 0), np.where(there == of, how.semantic, -how.semantic), 0.0)
        values[:, k] = np.where(meets, how.occupancy * occ + how.edge * edge + semantic - (how.dynamic if moving else 0.0), 0.0)
    values[:, -1] = meets
    scores = branch.Scores(branch.Maxima(ix, iy, values), points["x"].to_numpy(float), points["y"].to_numpy(float), classes.reshape(-1), n, size)
    x0, y0, yaw0, radius = (float(points[c].iloc[0]) for c in ("x0", "y0", "yaw0", "radius"))
    coarse = branch.best_two(scores, 0, _axis(yaw0, how.yaw, how.yaw_step), _axis(x0, radius, how.step), _axis(y0, radius, how.step), [])
    _, _, dx, dy, yaw = coarse[0]
    around = max(2 * how.fine_step, 1.5 * how.step)
    two = branch.best_two(scores, 1, _axis(yaw, how.fine_yaw, how.fine_yaw_step), _axis(dx, around, how.fine_step), _axis(dy, around, how.fine_step), coarse)
    minus, _, dx, dy, yaw = two[0]
    hits = branch.Maxima(ix, iy, np.column_stack([(np.nan_to_num(occ) >= how.inlier) & ((of == 0) | (there == 0) | (there == of)) for of, _ in kinds]).astype(float))
    hit = hits.at(0, *scores.cells(scores.turned(yaw), dx, dy), scores.classes)
    ratio = float(n @ hit) / scores.total if scores.total else math.nan
    return {"radius": radius, "dx": dx, "dy": dy, "yaw": yaw, "best": -minus, "second": -two[1][0] if len(two) > 1 else math.nan, "ratio": ratio, "scored": scores.scored}


def localize(points: DataFrame, prior: DataFrame, at: DataFrame, keys: list[str], size: float, how: Localization = Localization()) -> DataFrame:
    """Pose of each key's points on a prior map: (keys, radius, dx, dy, yaw, best, second, gap, confidence, ratio, scored, accepted, reason).

    points are (keys, x, y, label, dynamic, n: points in that cell), the prior's cells (ix, iy, occ,
    edge, label), at is (keys, x0, y0, yaw0, variance: trace of the planar covariance). The window's
    radius follows the variance; a lattice is searched, then a finer one around its best. A point
    scores occupancy and edge of its cell, more or less by its label, less if dynamic; a score is
    the mean over all points, -1 if none meets the map. Best and second are over both levels, ties
    by level, yaw, x, y. ratio is the share of points on occupied cells of no other label, scored
    the number of poses that branch and bound had to score; the result is that of scoring all.

    A key is one task of its points, summed to cells, and the tiles of the map within their reach,
    so it grows with the area that a key covers and not with points, poses or the map. Points
    without cells count in the mean; a key without points or start has no row, nor has a null key.
    Null labels are no labels, cells with a null score nothing, places that are no numbers meet
    nothing; of repeated cells the most occupied counts.
    """
    radius = F.least(F.lit(how.max_radius), F.greatest(F.lit(how.min_radius), F.sqrt(F.greatest(F.lit(0.01), F.col("variance") * how.gamma))))
    start = at.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "yaw0")], radius.alias("radius"))
    placed = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "label", "dynamic", "n").join(start, keys)
    reach = F.col("radius") + max(2 * how.fine_step, 1.5 * how.step) + size + F.hypot("x", "y") * (how.yaw + how.fine_yaw)
    u = F.cos("yaw0") * F.col("x") - F.sin("yaw0") * F.col("y") + F.col("x0")
    v = F.sin("yaw0") * F.col("x") + F.cos("yaw0") * F.col("y") + F.col("y0")
    near = placed.select(*keys, u.alias("u"), v.alias("v"), reach.alias("reach")).filter((F.abs("u") < branch.FAR * size) & (F.abs("v") < branch.FAR * size))
    tiles = lambda c: F.explode(F.sequence(*[F.floor((F.col(c) + s * F.col("reach")) / (size * TILE)).cast("long") for s in (-1, 1)]))
    wanted = near.select(*keys, tiles("u").alias("_tx"), "v", "reach").select(*keys, "_tx", tiles("v").alias("_ty")).distinct()
    tile = lambda c: F.floor(F.col(c) / TILE).cast("long")
    cells = prior.select(tile("ix").alias("_tx"), tile("iy").alias("_ty"), "ix", "iy", F.col("occ").cast("double").alias("occ"), F.col("edge").cast("double").alias("edge"), F.col("label").alias("there"))
    theirs = [f"_key{i}" for i in range(len(keys))]  # names of their own: both sides stem from the same points
    maps = wanted.join(cells, ["_tx", "_ty"]).select(*[F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)], "ix", "iy", "occ", "edge", "there")
    of = placed.schema

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{**dict(zip(keys, key, strict=True)), **_on_map(left, right, size, how)}])

    schema = ", ".join([*[f"`{k}` {of[k].dataType.simpleString()}" for k in keys], *[f"{c} double" for c in ("radius", "dx", "dy", "yaw", "best", "second", "ratio")], "scored long"])
    best = in_tasks(placed, keys).groupBy(*keys).cogroup(in_tasks(maps, theirs).groupBy(*theirs)).applyInPandas(search, schema)
    gap = F.coalesce(F.col("best") - F.col("second"), F.lit(0.0))
    out = best.withColumns({"gap": gap, "confidence": 1 / (1 + F.exp(-20 * (gap - how.min_gap)))})
    from waymark.operators.filters import first_reason

    reason = first_reason([(F.col("best") <= -0.5, "no_overlap"), (F.col("ratio") < how.min_ratio, "low_inlier_ratio"), ((F.col("confidence") < how.min_confidence) | (F.col("gap") < how.min_gap), "ambiguous")])
    return out.select(*keys, "radius", "dx", "dy", "yaw", "best", "second", "gap", "confidence", "ratio", "scored", (reason == "accepted").alias("accepted"), reason.alias("reason"))


@dataclass(frozen=True)
class Peak:
    """Gates of a raster search: least score and coverage, lead of the best over the second."""

    min_score: float = 0.2
    min_coverage: float = 0.5
    min_delta: float = 0.01
    min_ratio: float = 1.02
    sigma: float = 1.5
    reach: int = 4


def semantic_search(points: DataFrame, prior: DataFrame, keys: list[str], candidates: Column, weights: dict[int, float], how: Peak = Peak()) -> DataFrame:
    """Scores of a lattice of shifts and turns by how near points come to prior cells of their own label: (keys, c, dx, dy, yaw, score, coverage).

    points are (keys, x, y, label, n) in cells, prior cells (ix, iy, label). A point scores its
    label's weight times exp(-d / sigma), d the distance to the nearest cell of its label, up to
    reach cells; the mean is scaled by coverage, the share of points that lie on the prior at all.
    Distances are found once per label and cell, not per candidate. Labels without a weight count 0.
    """
    from waymark.operators.grid import neighbours

    near = neighbours(prior.filter(F.col("label").isin(*weights)).select("ix", "iy", "label", F.col("ix").alias("cx"), F.col("iy").alias("cy")), how.reach)
    d = F.sqrt((F.col("ix") - F.col("cx")) ** 2 + (F.col("iy") - F.col("cy")) ** 2)
    distances = near.groupBy("ix", "iy", "label").agg(F.min(d).alias("d")).filter(F.col("d") <= how.reach)
    weight = F.lit(0.0)
    for label, w in weights.items():
        weight = F.when(F.col("label") == label, w).otherwise(weight)
    moved = points.select(*keys, "x", "y", "label", "n", F.explode(candidates).alias("k")).select(
        *keys, "label", "n", "k.c", "k.dx", "k.dy", "k.yaw",
        F.floor(F.col("k.cos") * F.col("x") - F.col("k.sin") * F.col("y") + F.col("k.dx")).cast("long").alias("ix"),
        F.floor(F.col("k.sin") * F.col("x") + F.col("k.cos") * F.col("y") + F.col("k.dy")).cast("long").alias("iy"),
    )
    hits = moved.join(prior.select("ix", "iy", F.lit(1).alias("on")), ["ix", "iy"], "left").join(distances, ["ix", "iy", "label"], "left")
    kernel = F.coalesce(weight * F.exp(-F.col("d") / how.sigma), F.lit(0.0))
    sums = hits.groupBy(*keys, "c", "dx", "dy", "yaw").agg((F.sum(F.col("n") * kernel) / F.sum("n")).alias("mean"), (F.sum(F.when(F.col("on").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("coverage"))
    return sums.select(*keys, "c", "dx", "dy", "yaw", F.round(F.col("mean") * F.col("coverage"), 9).alias("score"), "coverage")


def peak(scores: DataFrame, keys: list[str], how: Peak = Peak()) -> DataFrame:
    """The best of each key's scores with its lead: (keys, c, dx, dy, yaw, score, coverage, delta, ratio, reason); ties to the smaller c."""
    from waymark.operators.filters import first_reason

    first = F.min_by(F.struct("c", "dx", "dy", "yaw", "score", "coverage"), F.struct(-F.col("score"), F.col("c"))).alias("b")
    two = scores.groupBy(*keys).agg(first, F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"))  # as many as candidates
    second = F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    rows = two.select(*keys, "b.*", (F.col("b.score") - second).alias("delta"), (F.col("b.score") / F.greatest(second, F.lit(1e-6))).alias("ratio"))
    return rows.withColumn("reason", first_reason([(F.col("score") < how.min_score, "score_low"), (F.col("coverage") < how.min_coverage, "coverage_low"), ((F.col("delta") < how.min_delta) | (F.col("ratio") < how.min_ratio), "not_unique")], "ok"))


def heat_map(scores: DataFrame, keys: list[str], size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """The best score of each key's candidates by the cell that they put the origin in: (keys, ix, iy, heat)."""
    cell = lambda c, at: F.floor((F.col(c) + at) / size).cast("long")
    return scores.groupBy(*keys, cell("dx", x0).alias("ix"), cell("dy", y0).alias("iy")).agg(F.max("score").alias("heat"))


@dataclass(frozen=True)
class EdgeSearch:
    """Edge threshold, distance scale and reach, least coverage and score, exponents of the parts, and how many candidates are kept."""

    edge: float = 0.9
    reach: int = 4
    near: float = 2.0
    sigma: float = 2.0
    min_coverage: float = 0.2
    min_score: float = 0.0
    chamfer: float = 1.0
    coverage: float = 0.5
    keep: int = 5


def edge_search(query: DataFrame, target: DataFrame, shifts: list[tuple[int, int]], how: EdgeSearch = EdgeSearch()) -> DataFrame:
    """The best shifts of edge cells onto another raster: (c, dx, dy, score, mean_d, coverage, ncc, second, p90, peak_delta, peak_ratio), by score, ties to the smaller c.

    query and target are cells (ix, iy, value). A shift scores exp(-mean distance to the nearest
    target edge / sigma), times the share of cells near one, times how values correlate where both
    are; one with too little coverage scores 0. second, p90 and the peak's lead are over all shifts.
    """
    from waymark.operators import raster

    table = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), F.lit(x).cast("long").alias("dx"), F.lit(y).cast("long").alias("dy")) for k, (x, y) in enumerate(shifts)])).alias("k")
    moved = query.select(F.col("ix").alias("qx"), F.col("iy").alias("qy"), "value", table).select("k.c", "k.dx", "k.dy", (F.col("qx") + F.col("k.dx")).alias("ix"), (F.col("qy") + F.col("k.dy")).alias("iy"), "value")
    d = raster.distance_to(moved.select("ix", "iy").distinct(), target.filter(F.col("value") > how.edge), how.reach)
    rows = moved.join(d, ["ix", "iy"]).join(target.select("ix", "iy", F.col("value").alias("other")), ["ix", "iy"], "left")
    ncc = F.coalesce(F.corr(F.when(F.col("other").isNotNull(), F.col("value")), F.col("other")), F.lit(0.0))
    sums = rows.groupBy("c", "dx", "dy").agg(F.avg("distance").alias("mean_d"), F.avg((F.col("distance") <= how.near).cast("int")).alias("coverage"), F.when(F.isnan(ncc), 0.0).otherwise(ncc).alias("ncc"))
    likeness = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("ncc") + 1) / 2))
    score = F.pow(F.exp(-F.col("mean_d") / how.sigma), how.chamfer) * F.pow("coverage", how.coverage) * (0.35 + 0.65 * likeness)
    scored = checkpointed(sums.withColumn("score", F.round(F.when(F.col("coverage") < how.min_coverage, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))), 9)))
    stats = scored.agg(F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("s"), F.percentile("score", 0.9).alias("p90"))  # one row per shift
    stats = stats.select(F.coalesce(F.get("s", F.lit(0)), F.lit(0.0)).alias("first"), F.coalesce(F.get("s", F.lit(1)), F.lit(0.0)).alias("second"), "p90")
    rows = scored.crossJoin(F.broadcast(stats)).withColumns({"peak_delta": F.col("first") - F.col("p90"), "peak_ratio": F.col("first") / F.greatest(F.col("second"), F.lit(1e-6))}).drop("first")
    return rows.filter(F.col("score") >= how.min_score).orderBy(F.desc("score"), "c").limit(how.keep)


def _apply(points: DataFrame, at: DataFrame, keys: list[str]) -> DataFrame:
    """Points moved by their key's yaw, dx, dy."""
    rows = points.join(at.select(*keys, F.col("yaw").alias("_a"), F.col("dx").alias("_dx"), F.col("dy").alias("_dy")), keys)
    moved = rows.withColumns({"_x": F.cos("_a") * F.col("x") - F.sin("_a") * F.col("y") + F.col("_dx"), "_y": F.sin("_a") * F.col("x") + F.cos("_a") * F.col("y") + F.col("_dy")})
    return moved.drop("x", "y", "_a", "_dx", "_dy").withColumnsRenamed({"_x": "x", "_y": "y"})


def register_rounds(a: DataFrame, b: DataFrame, keys: list[str], start: DataFrame, radius: float, rounds: int, max_turn: float, max_shift: float) -> DataFrame:
    """(keys, yaw, dx, dy, matched, rmse): points a (id, x, y, label) moved onto points b (other, x, y, label) by rounds of mutual matches and closed-form fits.

    start gives each key's first yaw, dx, dy; a round's step is cut at max_turn and max_shift.
    Each round is two nearest joins and one aggregate and is checkpointed, as the next one reads it more than once.
    """
    from waymark.operators import near, stats

    at = start.select(*keys, "yaw", "dx", "dy")
    for _ in range(rounds):
        moved = _apply(a, at, keys)
        pairs = near.mutual_nearest(moved, b, radius, "id", "other", keys, ["label"])
        both = pairs.join(moved.select("id", *keys, F.col("x").alias("sx"), F.col("y").alias("sy")), "id").join(b.select("other", F.col("x").alias("tx"), F.col("y").alias("ty")), "other")
        quality = both.groupBy(*keys).agg(F.count("*").alias("matched"), F.sqrt(F.avg(F.col("distance") ** 2)).alias("rmse"))
        step = stats.planar_fit(both.withColumn("w", F.lit(1.0)), keys).select(*keys, *[F.greatest(F.lit(-m), F.least(F.lit(m), F.col(c))).alias(f"_{c}") for c, m in (("yaw", max_turn), ("dx", max_shift), ("dy", max_shift))])
        joined = at.select(*keys, "yaw", "dx", "dy").join(step, keys).join(quality, keys)
        at = checkpointed(joined.select(
            *keys, (F.col("yaw") + F.col("_yaw")).alias("yaw"), (F.cos("_yaw") * F.col("dx") - F.sin("_yaw") * F.col("dy") + F.col("_dx")).alias("dx"),
            (F.sin("_yaw") * F.col("dx") + F.cos("_yaw") * F.col("dy") + F.col("_dy")).alias("dy"), "matched", "rmse",
        ))
    return at


def match_keyframes(a: DataFrame, b: DataFrame, keys: list[str], start: DataFrame, radius: float, least: int, most_rmse: float) -> DataFrame:
    """Registration of keyframes with its gates: (keys, yaw, dx, dy, matched, rmse, score, reason)."""
    from waymark.operators.filters import first_reason

    at = register_rounds(a, b, keys, start, radius, 2, 0.2, 5.0)
    reason = first_reason([(F.col("matched") < least, "few_pairs"), (F.col("rmse") > most_rmse, "residual"), (F.abs("yaw") > 0.3, "rotation")])
    return at.withColumn("score", F.col("matched") / (F.col("matched") + least) * F.exp(-F.col("rmse") / most_rmse)).withColumn("reason", reason)
