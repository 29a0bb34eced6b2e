"""Normal equations as sums, and planes around points, over all frames at once.

Sums are plain aggregates with map-side partials; only what takes a small eigen-decomposition or
solution per key goes through NumPy, a batch of keys at a time.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import pose, scalars
from waymark.operators.inertial import observable_part, rotation_information
from waymark.operators.near import CROWDED, HALVINGS
from waymark.operators.select import broadcast_small, checkpointed

AXES = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
POSE6 = ["rx", "ry", "rz", "tx", "ty", "tz"]


def huber(miss: Column, delta: float) -> Column:
    """Weight of a miss: 1 up to delta, then delta over it."""
    return F.when(F.abs(miss) <= delta, 1.0).otherwise(delta / F.abs(miss))


def planar_rounds(pairs: DataFrame, keys: list[str], delta: float, rounds: int) -> DataFrame:
    """(keys, yaw, x, y): the planar motion that takes points (sx, sy) onto (tx, ty), by rounds of linearised, Huber-weighted normal equations.

    Pairs have a weight w. A round is one join with the motions so far, nine sums per key and the
    solution of three equations, in expressions; a key whose points all coincide keeps its turn.
    """
    at = pairs.select(*keys).distinct().select(*keys, *[F.lit(0.0).alias(c) for c in ("yaw", "x", "y")])
    for _ in range(rounds):
        rows = pairs.join(at, keys).withColumns({"px": F.cos("yaw") * F.col("sx") - F.sin("yaw") * F.col("sy") + F.col("x"), "py": F.sin("yaw") * F.col("sx") + F.cos("yaw") * F.col("sy") + F.col("y")})
        rows = rows.withColumns({"ex": F.col("tx") - F.col("px"), "ey": F.col("ty") - F.col("py")})
        rows = rows.withColumn("u", F.col("w") * huber(F.sqrt(F.col("ex") ** 2 + F.col("ey") ** 2), delta))
        s = lambda c: F.sum(F.col("u") * c)
        sums = rows.groupBy(*keys).agg(
            F.sum("u").alias("h00"), (-s(F.col("py"))).alias("h02"), s(F.col("px")).alias("h12"), s(F.col("px") ** 2 + F.col("py") ** 2).alias("h22"),
            s(F.col("ex")).alias("g0"), s(F.col("ey")).alias("g1"), s(F.col("px") * F.col("ey") - F.col("py") * F.col("ex")).alias("g2"),
        )
        det = F.col("h00") * F.col("h22") - F.col("h02") ** 2 - F.col("h12") ** 2
        sums = sums.withColumn("a", F.when(det > 1e-12, (F.col("h00") * F.col("g2") - F.col("h02") * F.col("g0") - F.col("h12") * F.col("g1")) / det).otherwise(0.0))
        new = at.join(sums, keys).select(
            *keys, (F.col("yaw") + F.col("a")).alias("yaw"),
            (F.cos("a") * F.col("x") - F.sin("a") * F.col("y") + F.coalesce(F.try_divide(F.col("g0") - F.col("h02") * F.col("a"), F.col("h00")), F.lit(0.0))).alias("x"),
            (F.sin("a") * F.col("x") + F.cos("a") * F.col("y") + F.coalesce(F.try_divide(F.col("g1") - F.col("h12") * F.col("a"), F.col("h00")), F.lit(0.0))).alias("y"),
        )
        at = checkpointed(new)
    return at


def point_plane(rows: DataFrame, keys: list[str], huber: float, gate: float, prior_variance: float, sectors: int) -> DataFrame:
    """Normal equations of point-to-plane misses: h_<a>_<b> (21), g_<a> (6), square, used, rejected and sectors of each key.

    Rows are points x, y, z in the body's frame, normals nx, ny, nz, misses r and variances. The
    weight is Huber's of the normalised miss over the variance; misses whose square passes gate
    times variance and prior variance are rejected and only counted; sectors are the directions
    in the plane that used points lie in. Null misses don't count; a key all of whose misses are
    rejected has no row. One aggregate.
    """
    size = F.abs("r") / F.sqrt("variance")
    jacobian = {"rx": F.col("y") * F.col("nz") - F.col("z") * F.col("ny"), "ry": F.col("z") * F.col("nx") - F.col("x") * F.col("nz"), "rz": F.col("x") * F.col("ny") - F.col("y") * F.col("nx"), "tx": F.col("nx"), "ty": F.col("ny"), "tz": F.col("nz")}
    rows = rows.filter("r is not null and variance > 0").withColumns({f"j_{a}": c for a, c in jacobian.items()})
    rows = rows.withColumn("inside", F.col("r") ** 2 / (F.col("variance") + prior_variance) <= gate).withColumn("u", F.when(F.col("inside"), F.when(size <= huber, 1.0).otherwise(huber / size) / F.col("variance")))
    h = [F.sum(F.col("u") * F.col(f"j_{a}") * F.col(f"j_{b}")).alias(f"h_{a}_{b}") for k, a in enumerate(POSE6) for b in POSE6[k:]]
    g = [F.sum(F.col("u") * F.col(f"j_{a}") * F.col("r")).alias(f"g_{a}") for a in POSE6]
    sector = F.floor((F.atan2("y", "x") + math.pi) / (2 * math.pi / sectors))
    out = rows.groupBy(*keys).agg(*h, *g, F.count_if("inside").alias("used"), F.sum(F.when(F.col("inside"), F.col("r") ** 2)).alias("square"), F.countDistinct(F.when(F.col("inside"), sector)).alias("sectors"), F.count_if(~F.col("inside")).alias("rejected"))
    return out.filter("used > 0")


def degeneracy(sums: DataFrame, keys: list[str], ratio: float = 1e-4, turn_ratio: float = 1e-3) -> DataFrame:
    """What point_plane() sums see: observable directions of the pose and of the turn alone, condition, share of the heading, and the step they ask for."""
    names = [f"h_{a}_{b}" for k, a in enumerate(POSE6) for b in POSE6[k:]]

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        upper = np.triu_indices(6)
        for p in parts:
            out = []
            for h, g in zip(p[names].to_numpy(float), p[[f"g_{a}" for a in POSE6]].to_numpy(float), strict=True):
                m = np.zeros((6, 6))
                m[upper] = h
                m = m + np.triu(m, 1).T
                part, directions, condition = observable_part(m, ratio)
                turn, turns, _ = observable_part(rotation_information(m), turn_ratio)
                step = part @ np.linalg.pinv(m, rcond=ratio, hermitian=True) @ -g
                out.append((directions, turns, condition, float(turn[2, 2]), float(np.linalg.norm(step[:3])), float(np.linalg.norm(step[3:]))))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            yield p[keys].assign(directions=np.array(cols[0], "int32"), turn_directions=np.array(cols[1], "int32"), condition=cols[2], yaw_share=cols[3], turn=cols[4], shift=cols[5])

    kinds = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{kinds}, directions int, turn_directions int, condition double, yaw_share double, turn double, shift double")


def _correlation(a: str, b: str) -> Column:
    """Correlation of two columns of a group; NaN, which stands above every limit, where one of them doesn't vary."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread == 0, float("nan")).otherwise(F.try_divide(F.covar_pop(a, b), spread))


def photometric(pixels: DataFrame, keys: list[str], point: str, patch: int, focal: float, least_ncc: float, huber: float) -> DataFrame:
    """Normal equations of brightness misses for a camera's shift: points, pixels, h (6), g (3) and cost of each key.

    Rows are pixels of patches: u, v (pixels from the image's middle or the patch's), reference and
    current brightness, gradients gx, gy of the current image, depth. A patch counts if it is whole
    and its two sides correlate enough; misses are those of brightness about each side's mean, with
    Huber weights. Null pixels make a patch incomplete; one that is flat on a side has no
    correlation to fail by, so it counts.
    """
    known = pixels.filter("reference is not null and current is not null and gx is not null and gy is not null and depth > 0")
    by = [*keys, point]
    stats = known.groupBy(*by).agg(F.count("*").alias("_n"), _correlation("reference", "current").alias("_ncc"), F.avg("reference").alias("_mr"), F.avg("current").alias("_mc"))
    rows = known.join(stats.filter((F.col("_n") == patch) & (F.col("_ncc") >= least_ncc)), by)
    r = (F.col("current") - F.col("_mc")) - (F.col("reference") - F.col("_mr"))
    j = {"x": -(F.col("gx") * focal / F.col("depth")), "y": -(F.col("gy") * focal / F.col("depth")), "z": (F.col("gx") * focal * F.col("u") + F.col("gy") * focal * F.col("v")) / (F.col("depth") * focal)}
    rows = rows.withColumns({f"j_{a}": c for a, c in j.items()} | {"r": r}).withColumn("q", F.when(F.abs("r") <= huber, 1.0).otherwise(huber / F.abs("r")))
    h = [F.sum(F.col("q") * F.col(f"j_{a}") * F.col(f"j_{b}")).alias(f"h_{a}_{b}") for a, b in AXES]
    g = [F.sum(F.col("q") * F.col(f"j_{a}") * F.col("r")).alias(f"g_{a}") for a in "xyz"]
    return rows.groupBy(*keys).agg(F.countDistinct(point).alias("points"), F.count("*").alias("pixels"), *h, *g, F.sum(F.col("q") * F.col("r") ** 2).alias("cost"))


@dataclass(frozen=True)
class Camera:
    """Focal lengths in pixels, the rows of the rotation from the body to the camera, and the camera's place in the body."""

    fx: float = 300.0
    fy: float = 300.0
    rotation: tuple = ((0.0, -1.0, 0.0), (0.0, 0.0, -1.0), (1.0, 0.0, 0.0))
    lever: tuple = (0.0, 0.0, 0.0)

    def turned(self, v: tuple) -> tuple:
        """A vector of columns in the body's axes, in the camera's."""
        return tuple(sum((r * c for r, c in zip(row, v, strict=True) if r), F.lit(0.0)) for row in self.rotation)

    def seen(self, body: tuple) -> tuple:
        """A point of the body's frame in the camera's."""
        return self.turned(tuple(b - t for b, t in zip(body, self.lever, strict=True)))


#: The six unknowns of a pose: a turn in the body's axes, then a shift in the world's.
SIX = ("rx", "ry", "rz", "px", "py", "pz")


def photometric_pose(pixels: DataFrame, keys: list[str], point: str, patch: int, camera: Camera, least_ncc: float, huber: float, noise: float, least_depth: float = 0.1) -> DataFrame:
    """Normal equations of brightness misses for a pose: (keys, landmarks, pixels, ncc, h of SIX by SIX, g of SIX, cost).

    Rows are pixels of landmarks' patches: the landmark in the body's frame (bx, by, bz), the body's
    turn (qw, qx, qy, qz), reference and current brightness, and the current image's gradients gx,
    gy. Patches are brought to mean 0 and deviation 1; one counts if it is whole, ahead of the
    camera, not flat, and its two sides correlate enough. A pixel's miss moves with the landmark's
    projection, which moves with the turn (through the camera's lever) and the shift; weights are
    Huber's over the noise's square. Null pixels make a patch incomplete. Sums only: no list of a
    frame's pixels stands anywhere.
    """
    names = ["reference", "current", "gx", "gy", "bx", "by", "bz", "qw", "qx", "qy", "qz"]
    body = tuple(F.col(f"b{a}") for a in "xyz")
    known = pixels.dropna(subset=names).withColumns(dict(zip(("_x", "_y", "_z"), camera.seen(body), strict=True))).filter(F.col("_z") > least_depth)
    by = [*keys, point]
    stats = known.groupBy(*by).agg(F.count("*").alias("_n"), _correlation("reference", "current").alias("_ncc"), *[f(c).alias(f"_{m}{c[0]}") for c in ("reference", "current") for m, f in (("m", F.avg), ("s", F.stddev_pop))])
    good = (F.col("_n") == patch) & (F.col("_ncc") >= least_ncc) & (F.col("_sr") > 1e-6) & (F.col("_sc") > 1e-6)
    rows = known.join(stats.filter(good), by)
    gx, gy, z = F.col("gx") * camera.fx / F.col("_sc"), F.col("gy") * camera.fy / F.col("_sc"), F.col("_z")
    w = (gx / z, gy / z, -(gx * F.col("_x") + gy * F.col("_y")) / (z * z))  # of the miss by the landmark's place in the camera
    bx, by_, bz = body
    zero = F.lit(0.0)
    turns = [camera.turned(c) for c in ((zero, bz, -by_), (-bz, zero, bx), (by_, -bx, zero))]
    shifts = [camera.turned(pose.rotate(pose.conjugate(pose.named()), tuple(F.lit(1.0 if a == b else 0.0) for b in range(3)))) for a in range(3)]
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    j = [dot(w, c) for c in turns] + [-dot(w, c) for c in shifts]
    r = (F.col("current") - F.col("_mc")) / F.col("_sc") - (F.col("reference") - F.col("_mr")) / F.col("_sr")
    rows = rows.withColumns({f"_j{k}": c for k, c in enumerate(j)} | {"_r": r})
    q = F.when(F.abs("_r") <= huber, 1.0).otherwise(huber / F.abs("_r")) / noise**2
    rows = rows.withColumn("_q", q)
    h = [F.sum(F.col("_q") * F.col(f"_j{a}") * F.col(f"_j{b}")).alias(f"h_{SIX[a]}_{SIX[b]}") for a in range(6) for b in range(a, 6)]
    g = [F.sum(F.col("_q") * F.col(f"_j{a}") * F.col("_r")).alias(f"g_{SIX[a]}") for a in range(6)]
    landmarks = F.round(F.count("*") / patch).cast("long")  # patches that count are whole
    return rows.groupBy(*keys).agg(landmarks.alias("landmarks"), F.count("*").alias("pixels"), F.avg("_ncc").alias("ncc"), *h, *g, F.sum(F.col("_q") * F.col("_r") ** 2).alias("cost"))


# ---- planes around points ----


def _around(queries: DataFrame, ident: str, size: float, reach: float) -> DataFrame:
    """Queries offered to every voxel within reach of theirs: (ident, x, y, z, vx, vy, vz)."""
    return _steps(queries.select(ident, "x", "y", "z", *[scalars.cell(F.col(c), size).alias(f"v{c}") for c in "xyz"]), math.ceil(reach / size))


def _steps(rows: DataFrame, span: int) -> DataFrame:
    """Rows once for every voxel within span of theirs (vx, vy, vz)."""
    for c in "xyz":
        rows = rows.withColumn("_s", F.explode(F.sequence(F.lit(-span), F.lit(span)))).withColumn(f"v{c}", F.col(f"v{c}") + F.col("_s")).drop("_s")
    return rows


def _planes(rows: DataFrame, ident: str, max_flatness: float) -> DataFrame:
    """The weighted plane of each ident's parts (n, mx ... mz, cxx ... czz, w): normal up, distance of x, y, z from it, flatness, validity.

    Sums of parts are taken in SQL; a 3 by 3 eigen-decomposition follows for each ident.
    """
    w = F.col("w")
    sums = rows.groupBy(ident, "x", "y", "z").agg(F.count("*").alias("used"), F.sum(w).alias("sw"), *[F.sum(w * F.col(f"m{a}")).alias(f"s{a}") for a in "xyz"], *[F.sum(w * (F.col(f"c{a}{b}") + F.col(f"m{a}") * F.col(f"m{b}"))).alias(f"q{a}{b}") for a, b in AXES])

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            total = p["sw"].to_numpy(float)[:, None]
            center = p[["sx", "sy", "sz"]].to_numpy(float) / total
            m = np.empty((len(p), 3, 3))
            for a, b in AXES:
                i, j = "xyz".index(a), "xyz".index(b)
                m[:, i, j] = m[:, j, i] = p[f"q{a}{b}"].to_numpy(float) / total[:, 0] - center[:, i] * center[:, j]
            values, vectors = np.linalg.eigh(m)
            normal = vectors[:, :, 0]
            big = np.take_along_axis(normal, np.abs(normal).argmax(axis=1)[:, None], axis=1)
            normal = normal * np.where(big < 0, -1, 1)  # the largest part points forward
            flat = np.maximum(values[:, 0], 0) / np.maximum(values[:, 1], 1e-12)
            distance = np.einsum("ni,ni->n", normal, p[["x", "y", "z"]].to_numpy(float) - center)
            yield p[[ident, "used"]].assign(nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2], distance=distance, flatness=flat, valid=(flat <= max_flatness) & (values[:, 1] > 1e-9))

    return sums.mapInPandas(run, f"{ident} {rows.schema[ident].dataType.simpleString()}, used long, nx double, ny double, nz double, distance double, flatness double, valid boolean")


def _nearest(found: DataFrame, ident: str, order: list[str], most: int, least: int) -> DataFrame:
    """Of each query's rows the first most in an order, if it has least of them; rows beyond are dropped as they are read, so no list of all stands anywhere."""
    rows = found.withColumn("_rn", F.row_number().over(Window.partitionBy(ident).orderBy(*order))).filter(F.col("_rn") <= most)
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy(ident))).filter(F.col("_n") >= least).drop("_rn", "_n")


def local_planes(queries: DataFrame, voxels: DataFrame, ident: str, size: float, reach: float, nearest: int, least: int, least_points: int, max_flatness: float) -> DataFrame:
    """The plane around each query point (ident, x, y, z): (ident, used, nx, ny, nz, distance, flatness, valid).

    Voxels are (vx, vy, vz, n, mx ... mz, cxx ... czz). Those with enough points whose mean is within
    reach are candidates; the nearest of them (ties by voxel) are weighted by their points and
    nearness. A query with fewer than least has no row. The voxels around each voxel that holds
    queries are one list, which its queries share; what is kept of each is bounded by nearest.
    """
    cell, axes = ["vx", "vy", "vz"], [f"{m}{c}" for m, c in [*(("m", c) for c in "xyz"), *(("c", a + b) for a, b in AXES)]]
    known = checkpointed(voxels.filter(F.col("n") >= least_points).select(*cell, "n", *axes))
    left = queries.select(ident, "x", "y", "z", *[scalars.cell(F.col(c), size).alias(f"v{c}") for c in "xyz"])
    home = _steps(left.select(*cell).distinct().select(*[F.col(c).alias(f"_{c}") for c in cell], *cell), math.ceil(reach / size))
    lists = home.join(known, cell).groupBy(*[f"_{c}" for c in cell]).agg(F.collect_list(F.struct(*cell, "n", *axes)).alias("_voxels"))
    lists = broadcast_small(checkpointed(lists.withColumnsRenamed({f"_{c}": c for c in cell})), 2_000)
    d = lambda p: F.sqrt(sum((p[f"m{c}"] - F.col(c)) ** 2 for c in "xyz"))
    near = F.filter(F.transform("_voxels", lambda p: F.struct(d(p).alias("d"), *[p[c].alias(c) for c in [*cell, "n", *axes]])), lambda p: p["d"] <= reach)
    found = left.join(lists, cell).select(ident, "x", "y", "z", F.slice(F.array_sort(near), 1, nearest).alias("_near")).filter(F.size("_near") >= least)
    rows = found.select(ident, "x", "y", "z", F.explode("_near").alias("p")).select(ident, "x", "y", "z", "p.*")
    return _planes(rows.withColumn("w", F.col("n") * F.exp(-F.col("d") / reach)), ident, max_flatness)


def point_planes(queries: DataFrame, points: DataFrame, ident: str, size: float, reach: float, nearest: int, max_flatness: float) -> DataFrame:
    """As local_planes(), of the nearest points themselves.

    Rings of cells, as in near.grid_nearest(): a query that has enough points within a small cell's
    size is done, as its nearest are among them; the others look at cells of twice the size, up to
    reach. Points of one place are one row with their number.
    """
    place = [f"m{c}" for c in "xyz"]
    known = checkpointed(points.groupBy(*[F.col(c).alias(f"m{c}") for c in "xyz"]).agg(F.least(F.count("*"), F.lit(nearest)).alias("_copies")))
    crowd = known.groupBy(*[scalars.cell(F.col(c), reach) for c in place]).count().agg(F.max("count")).first()[0] or 0
    halvings = next((k for k in range(HALVINGS) if crowd <= CROWDED * 4**k), HALVINGS)  # a surface is what is looked for
    by_place = Window.partitionBy(ident).orderBy("d", *place)
    rest, out = checkpointed(queries.select(ident, "x", "y", "z")), None
    for k in range(halvings, -1, -1):
        cell = reach / 2**k
        found = _around(rest, ident, cell, cell).join(known.withColumns({f"v{c}": scalars.cell(F.col(f"m{c}"), cell) for c in "xyz"}), ["vx", "vy", "vz"])
        d = F.sqrt(sum((F.col(f"m{c}") - F.col(c)) ** 2 for c in "xyz"))
        found = found.withColumn("d", d).filter(F.col("d") <= cell).withColumn("_rn", F.row_number().over(by_place)).filter(F.col("_rn") <= nearest)
        found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).drop("_rn", "_copy", "_copies")
        found = checkpointed(_nearest(found, ident, ["d", *place], nearest, nearest))
        out = found if out is None else out.unionByName(found)
        rest = checkpointed(rest.join(found.select(ident), ident, "left_anti"))
        if rest.isEmpty():
            break
    return _planes(out.withColumns({"w": F.lit(1.0), **{f"c{a}{b}": F.lit(0.0) for a, b in AXES}}), ident, max_flatness)


def plane_by_strategies(queries: DataFrame, points: DataFrame, voxels: DataFrame, ident: str, size: float, reach: float, nearest: int = 5, max_flatness: float = 0.1) -> DataFrame:
    """The first valid plane of each query by voxels around it that agree, by its nearest points, by voxels of half the size: (ident, strategy, nx, ny, nz, distance).

    strategy is "voxels", "points", "finer" or "none".
    """
    half = points.groupBy(*[scalars.cell(F.col(c), size / 2).alias(f"v{c}") for c in "xyz"]).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in AXES])
    plans: list[tuple[str, Callable]] = [
        ("voxels", lambda left: local_planes(left, voxels, ident, size, reach, 8, 4, 1, max_flatness / 2)),
        ("points", lambda left: point_planes(left, points, ident, size, reach, nearest, max_flatness)),
        ("finer", lambda left: local_planes(left, half, ident, size / 2, reach / 2, 8, 4, 1, 2 * max_flatness)),
    ]
    out, left = None, queries
    for name, find in plans:  # what one strategy finds, the next one isn't asked for
        found = checkpointed(find(left).filter("valid").select(ident, F.lit(name).alias("strategy"), "nx", "ny", "nz", "distance"))
        out = found if out is None else out.unionByName(found)
        left = left.join(found.select(ident), ident, "left_anti")
    none = [F.lit(None).cast("double").alias(c) for c in ("nx", "ny", "nz", "distance")]
    return out.unionByName(left.select(ident, F.lit("none").alias("strategy"), *none))
