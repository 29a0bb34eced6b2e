"""Pose graphs: relaxation by joins, windows and whole runs by Gauss-Newton, factors, gates, corrections.

Relaxation is relational: one round is two joins and one aggregate over all graphs at once. The
solvers keep only a graph's blocks: normal equations of long graphs are never a dense matrix, and
are solved by conjugate gradients whose preconditioner is the exact solution of the chain, so that
loops, which are few, cost few rounds. Small graphs are solved many at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions import lie
from waymark.operators.select import checkpointed, in_tasks

#: Standard deviation of an axis that a factor says nothing about.
FREE = 1e3

# ---- relaxation ----


def wrapped(angle: Column) -> Column:
    """An angle into (-pi, pi]."""
    return F.atan2(F.sin(angle), F.cos(angle))


@dataclass(frozen=True)
class Relaxation:
    """Gain of a round, most it may move a pose, size of a loop's miss from which it loses weight, and the step at which a graph is done."""

    gain: float = 0.4
    max_shift: float = 0.5
    max_climb: float = 0.2
    max_turn: float = 0.05
    kernel: float = 1.0
    stop: float = 1e-4


def relax_poses(vertices: DataFrame, edges: DataFrame, keys: list[str], rounds: int, how: Relaxation = Relaxation()) -> DataFrame:
    """Vertices (keys, k, x, y, z, yaw) moved towards what their edges predict.

    Edges are (keys, i, j, dx, dy, dz, dyaw, loop, w_xy, w_z, w_yaw): pose j seen from pose i. In a
    round each pose moves, in plane, height and heading, by gain times the weighted mean of its
    edges' misses, at most by the caps; a loop's weights shrink as its planar miss passes the
    kernel. The least k of a key stays. A key whose largest step is under stop moves no more. A
    pose without edges stays; edges of unknown vertices don't count; null weights are 0.
    """
    # made once: each round would make them anew from the tables
    edges = checkpointed(edges.select(*keys, "i", "j", "dx", "dy", "dz", "dyaw", "loop", "w_xy", "w_z", "w_yaw"))
    first = vertices.groupBy(*keys).agg(F.min("k").alias("anchor"))
    at = vertices.join(first, keys).select(*keys, "k", "x", "y", "z", "yaw", (F.col("k") == F.col("anchor")).alias("fixed"), F.lit(False).alias("done"))
    for number in range(1, rounds + 1):
        ends = [at.select(*keys, F.col("k").alias(n), F.struct("x", "y", "z", "yaw").alias(f"p{n}"), *([F.col("done")] if n == "i" else [])) for n in "ij"]
        both = edges.join(ends[0], [*keys, "i"]).join(ends[1], [*keys, "j"]).filter(~F.col("done"))
        cos, sin = F.cos("pi.yaw"), F.sin("pi.yaw")
        ex = F.col("pi.x") + cos * F.col("dx") - sin * F.col("dy") - F.col("pj.x")
        ey = F.col("pi.y") + sin * F.col("dx") + cos * F.col("dy") - F.col("pj.y")
        both = both.withColumns({"ex": ex, "ey": ey, "ez": F.col("pi.z") + F.col("dz") - F.col("pj.z"), "ea": wrapped(F.col("pi.yaw") + F.col("dyaw") - F.col("pj.yaw"))})
        robust = F.when(F.col("loop"), F.least(F.lit(1.0), how.kernel / F.greatest(F.lit(how.kernel), F.hypot("ex", "ey")))).otherwise(1.0)
        both = both.withColumns({w: robust * F.greatest(F.lit(0.0), F.coalesce(F.col(w), F.lit(0.0))) for w in ("w_xy", "w_z", "w_yaw")})
        pulls = F.explode(F.array(*[F.struct(F.col(end).alias("k"), F.lit(sign).alias("s")) for end, sign in (("j", 1.0), ("i", -1.0))])).alias("e")
        rows = both.select(*keys, pulls, "ex", "ey", "ez", "ea", "w_xy", "w_z", "w_yaw").select(*keys, "e.k", *[(F.col("e.s") * F.col(c)).alias(c) for c in ("ex", "ey", "ez", "ea")], "w_xy", "w_z", "w_yaw")
        mean = lambda c, w: F.when(F.sum(w) > 1e-9, F.sum(F.col(c) * F.col(w)) / F.sum(w)).otherwise(0.0)
        pull = rows.groupBy(*keys, "k").agg(mean("ex", "w_xy").alias("mx"), mean("ey", "w_xy").alias("my"), mean("ez", "w_z").alias("mz"), mean("ea", "w_yaw").alias("ma"))
        moved = at.join(pull, [*keys, "k"], "left")
        gain = lambda c: F.when(F.col("fixed"), 0.0).otherwise(how.gain * F.coalesce(c, F.lit(0.0)))
        length = F.hypot(gain("mx"), gain("my"))
        cut = F.when(length > how.max_shift, how.max_shift / length).otherwise(1.0)
        clip = lambda c, most: F.greatest(F.lit(-most), F.least(F.lit(most), c))
        moved = moved.withColumns({"sx": gain("mx") * cut, "sy": gain("my") * cut, "sz": clip(gain("mz"), how.max_climb), "sa": clip(gain("ma"), how.max_turn)})
        moved = moved.withColumn("step", F.greatest(F.hypot("sx", "sy"), F.abs("sz"), F.abs("sa")))
        moved = moved.select(*keys, "k", (F.col("x") + F.col("sx")).alias("x"), (F.col("y") + F.col("sy")).alias("y"), (F.col("z") + F.col("sz")).alias("z"), wrapped(F.col("yaw") + F.col("sa")).alias("yaw"), "fixed", "step")
        if number == rounds:
            at = moved
            continue
        done = F.max("step").over(Window.partitionBy(*keys)) < how.stop
        at = checkpointed(moved.withColumn("done", done).drop("step"))
    return at.select(*keys, "k", "x", "y", "z", "yaw")


# ---- solvers ----


def _chain_factors(diagonal: np.ndarray, below: np.ndarray) -> list:
    """The block elimination of a chain's matrix: inverses of the pivots and the multipliers."""
    pivots, left = [np.linalg.inv(diagonal[0])], []
    for k in range(1, len(diagonal)):
        m = below[k - 1] @ pivots[-1]
        left.append(m)
        pivots.append(np.linalg.inv(diagonal[k] - m @ below[k - 1].T))
    return [pivots, left, below]


def _chain_solve(factors: list, b: np.ndarray) -> np.ndarray:
    pivots, left, below = factors
    y = [b[0]]
    for k in range(1, len(b)):
        y.append(b[k] - left[k - 1] @ y[-1])
    x = [pivots[-1] @ y[-1]]
    for k in range(len(b) - 2, -1, -1):
        x.append(pivots[k] @ (y[k] - below[k].T @ x[-1]))
    return np.stack(x[::-1])


#: Unknowns of a system up to which it is solved as one dense matrix.
SMALL = 400


def solve_blocks(diagonal: np.ndarray, i: np.ndarray, j: np.ndarray, off: np.ndarray, b: np.ndarray, tolerance: float = 1e-12) -> np.ndarray:
    """x of the symmetric positive system with those blocks: diagonal (n, d, d), off (m, d, d) at (i, j) with i < j, and transposed at (j, i).

    Memory is that of the blocks. Blocks next to the diagonal are solved exactly as a chain; the
    others by conjugate gradients on top, which end when the residual is tolerance times that of b.
    A system of no more than SMALL numbers is solved as one matrix, which is faster there.
    """
    n, d = b.shape
    if n * d <= SMALL:
        whole = np.zeros((n, d, n, d))
        np.add.at(whole, (i, slice(None), j), off)
        whole = whole + np.transpose(whole, (2, 3, 0, 1))
        whole[np.arange(n), :, np.arange(n)] += diagonal
        return np.linalg.solve(whole.reshape(n * d, n * d), b.ravel()).reshape(n, d)
    below = np.zeros((max(0, n - 1), d, d))
    near = j - i == 1
    np.add.at(below, i[near], np.swapaxes(off[near], 1, 2))
    i, j, off = i[~near], j[~near], off[~near]
    factors = _chain_factors(diagonal, below)
    x = _chain_solve(factors, b)
    if not len(i):
        return x

    def times(v: np.ndarray) -> np.ndarray:
        out = np.einsum("nab,nb->na", diagonal, v)
        out[1:] += np.einsum("nab,nb->na", below, v[:-1])
        out[:-1] += np.einsum("nba,nb->na", below, v[1:])
        np.add.at(out, i, np.einsum("nab,nb->na", off, v[j]))
        np.add.at(out, j, np.einsum("nba,nb->na", off, v[i]))
        return out

    r = b - times(x)
    z = _chain_solve(factors, r)
    p, rz, least = z, float((r * z).sum()), tolerance**2 * float((b * b).sum())
    for _ in range(10 * n * d):
        if float((r * r).sum()) <= least or rz <= 0:
            break
        ap = times(p)
        alpha = rz / float((p * ap).sum())
        x, r = x + alpha * p, r - alpha * ap
        z = _chain_solve(factors, r)
        new = float((r * z).sum())
        p, rz = z + new / rz * p, new
    return x


def _summed(n: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values at each of n places."""
    out = np.zeros((n, *values.shape[1:]))
    if len(at):
        order = np.argsort(at, kind="stable")
        places, start = np.unique(at[order], return_index=True)
        out[places] = np.add.reduceat(values[order], start, axis=0)
    return out


def normal_blocks(n: int, i: np.ndarray, j: np.ndarray, ji: np.ndarray, jj: np.ndarray, r: np.ndarray, information: np.ndarray) -> tuple:
    """Blocks and right side of the normal equations of factors between vertices i and j (j < 0: on i alone)."""
    two = j >= 0
    wi = np.swapaxes(ji, 1, 2) @ information
    wj = (np.swapaxes(jj, 1, 2) @ information)[two]
    ends = np.concatenate([i, j[two]])
    diagonal = _summed(n, ends, np.concatenate([wi @ ji, wj @ jj[two]]))
    b = _summed(n, ends, -np.concatenate([wi @ r[:, :, None], wj @ r[two][:, :, None]])[:, :, 0])
    off = wi[two] @ jj[two]
    lo, hi = np.minimum(i[two], j[two]), np.maximum(i[two], j[two])
    return diagonal, lo, hi, np.where((i[two] <= j[two])[:, None, None], off, np.swapaxes(off, 1, 2)), b


def _logarithm(m: np.ndarray) -> np.ndarray:
    """lie.motion_vector() of motions that lie.rotation_vector() needs no care for, by the closed form of the shift; others go there."""
    skew = [(m[..., 2, 1] - m[..., 1, 2]) / 2, (m[..., 0, 2] - m[..., 2, 0]) / 2, (m[..., 1, 0] - m[..., 0, 1]) / 2]
    sine = np.sqrt(skew[0] * skew[0] + skew[1] * skew[1] + skew[2] * skew[2])
    cosine = (m[..., 0, 0] + m[..., 1, 1] + m[..., 2, 2] - 1) / 2
    angle = np.arctan2(sine, cosine)
    scale = np.where(sine > 1e-9, angle / np.where(sine > 1e-9, sine, 1), 1.0)
    x, y, z = (c * scale for c in skew)
    near = angle < 1e-3
    a = np.where(near, 1.0, angle)
    share = np.where(near, 1 / 12 + angle * angle / 720, (1 - a / 2 / np.tan(a / 2)) / (a * a))
    tx, ty, tz = m[..., 0, 3], m[..., 1, 3], m[..., 2, 3]
    cx, cy, cz = y * tz - z * ty, z * tx - x * tz, x * ty - y * tx
    out = np.empty((*angle.shape, 6))
    out[..., 0], out[..., 1], out[..., 2] = x, y, z
    out[..., 3] = tx - cx / 2 + share * (y * cz - z * cy)
    out[..., 4] = ty - cy / 2 + share * (z * cx - x * cz)
    out[..., 5] = tz - cz / 2 + share * (x * cy - y * cx)
    odd = (sine <= 1e-6) & (cosine < 0)
    if odd.any():
        out[odd] = lie.motion_vector(m[odd])
    return out


def _solve_graphs(n: int, first: np.ndarray, count: np.ndarray, diagonal: np.ndarray, lo: np.ndarray, hi: np.ndarray, off: np.ndarray, b: np.ndarray) -> np.ndarray:
    """solve_blocks() of graphs that lie one after the other, each count vertices from first; small graphs of one size are solved at once."""
    d = b.shape[1]
    x = np.zeros((n, d))
    graph = np.searchsorted(first, lo, "right") - 1
    for size in np.unique(count):
        chosen = np.flatnonzero(count == size)
        if size * d > SMALL:
            for g in chosen:
                own, at = graph == g, slice(first[g], first[g] + size)
                x[at] = solve_blocks(diagonal[at], lo[own] - first[g], hi[own] - first[g], off[own], b[at])
            continue
        place = np.full(len(count), -1)
        place[chosen] = np.arange(len(chosen))
        own = place[graph] >= 0
        g, i, j = place[graph[own]], lo[own] - first[graph[own]], hi[own] - first[graph[own]]
        whole = _summed(len(chosen) * size * size, (g * size + i) * size + j, off[own]).reshape(len(chosen), size, size, d, d).transpose(0, 1, 3, 2, 4)
        whole = whole + np.transpose(whole, (0, 3, 4, 1, 2))
        at = first[chosen][:, None] + np.arange(size)
        k = np.arange(size)
        whole[:, k, :, k] += np.swapaxes(diagonal[at], 0, 1)
        x[at] = np.linalg.solve(whole.reshape(len(chosen), size * d, size * d), b[at].reshape(len(chosen), size * d, 1)).reshape(len(chosen), size, d)
    return x


def solve_many(start: np.ndarray, count: np.ndarray, i: np.ndarray, j: np.ndarray, measured: np.ndarray, information: np.ndarray, huber: np.ndarray, confidence: np.ndarray, rounds: int, max_step: float, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """solve_poses() of many graphs at once, which lie one after the other in start, count vertices each; fixed says whose first pose stays.

    i and j count over all graphs. A graph that is done takes no part in further rounds.
    """
    poses = np.array(start, float)
    first = np.cumsum(count) - count
    owner = np.repeat(np.arange(len(count)), count)
    back = lie.inverse(measured)
    bumps = lie.motion(np.eye(6) * 1e-6)
    done, error = np.zeros(len(count), int), np.zeros(len(count))
    active = np.ones(len(count), bool)
    for number in range(1, rounds + 1):
        if not active.any():
            break
        done[active] = number
        held = np.flatnonzero(active[owner])  # the vertices of graphs that go on, numbered anew
        anew = np.cumsum(active[owner]) - 1
        f = np.flatnonzero(active[owner[i]])
        fi, fj, two = i[f], np.maximum(j[f], 0), j[f] >= 0
        pj = np.where(two[:, None, None], poses[fj], np.eye(4))
        seen = np.where(two[:, None, None], lie.inverse(poses[fi]) @ pj, poses[fi])
        missed = back[f] @ seen
        r = _logarithm(missed)
        # a bump of j comes after what is seen; one of i before it, or, without a j, after it
        after = np.moveaxis((_logarithm(missed @ bumps[:, None]) - r) / 1e-6, 0, 2)
        before = np.moveaxis((_logarithm((back[f] @ lie.inverse(bumps)[:, None]) @ seen) - r) / 1e-6, 0, 2)
        ji, jj = np.where(two[:, None, None], before, after), np.where(two[:, None, None], after, 0.0)
        square = np.maximum((r[:, None, :] @ information[f] @ r[:, :, None])[:, 0, 0], 0)
        size = np.sqrt(square)
        weight = confidence[f] * np.where((huber[f] > 0) & (size > huber[f]), huber[f] / np.maximum(size, 1e-12), 1.0)
        error = np.where(active, np.bincount(owner[fi], weight * square, len(count)), error)
        diagonal, lo, hi, off, b = normal_blocks(len(held), anew[fi], np.where(two, anew[fj], -1), ji, jj, r, weight[:, None, None] * information[f])
        diagonal += 1e-9 * np.eye(6)
        chosen = np.flatnonzero(active)
        starts = anew[first[chosen]]
        stays = np.zeros(len(held), bool)
        stays[starts[fixed[chosen]]] = True
        keep = ~stays[lo]
        diagonal[stays], b[stays] = np.eye(6), 0
        step = _solve_graphs(len(held), starts, count[chosen], diagonal, lo[keep], hi[keep], off[keep], b)
        norm = np.sqrt(np.bincount(owner[held], (step * step).sum(axis=1), len(count)))
        active &= np.isfinite(norm)
        goes = active[owner[held]]
        cut = np.minimum(1.0, max_step / np.maximum(norm, 1e-12))[owner[held]][:, None]
        poses[held[goes]] = lie.orthonormal(poses[held[goes]] @ lie.motion((step * cut)[goes]))
        active &= ~((norm < 1e-6) | (error < 1e-14))
    return poses, done, error


def solve_poses(start: np.ndarray, i: np.ndarray, j: np.ndarray, measured: np.ndarray, information: np.ndarray, huber: np.ndarray, confidence: np.ndarray, rounds: int = 20, max_step: float = math.inf, fix_first: bool = True) -> tuple[np.ndarray, int, float]:
    """Poses that best meet the factors: Gauss-Newton on motions, with the rounds it took and the last weighted error.

    A factor says where pose j is seen from pose i, or, with j under 0, where pose i is; its
    residual is the logarithm of what the measurement misses. information (m, 6, 6) is in the order
    turn, shift; huber bounds the square root of the weighted square (0: none); confidence scales
    it. max_step bounds the norm of a whole step. The first pose stays unless fix_first is false,
    which needs an absolute factor.
    """
    poses, done, error = solve_many(start, np.array([len(start)]), i, j, measured, information, huber, confidence, rounds, max_step, np.array([fix_first]))
    return poses, int(done[0]), float(error[0])


#: Columns of a pose, and of the factors that the solvers take.
POSE = ["x", "y", "z", "qw", "qx", "qy", "qz"]
FACTOR = [f"m_{c}" for c in POSE] + [f"s{k}" for k in range(6)]


def _motions(pdf: pd.DataFrame, prefix: str = "") -> np.ndarray:
    q = pdf[[f"{prefix}{c}" for c in POSE[3:]]].to_numpy(float)
    return lie.compose(lie.from_quaternion(q), pdf[[f"{prefix}{c}" for c in POSE[:3]]].to_numpy(float))


def quaternions(r: np.ndarray) -> np.ndarray:
    """Unit quaternions (w, x, y, z), w not negative, of rotations."""
    v = lie.rotation_vector(r)
    angle = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.concatenate([np.cos(angle / 2), v * np.where(angle > 1e-12, np.sin(angle / 2) / np.maximum(angle, 1e-12), 0.5)], axis=-1)


#: Rows of vertices and factors from which whole graphs are solved together.
TOGETHER = 8_000


def _changes(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Whether a row's keys differ from those of the row before; the first row's do."""
    codes = np.stack([pd.factorize(pdf[c])[0] for c in keys], axis=1)
    return np.r_[True, (codes[1:] != codes[:-1]).any(axis=1)]


def smooth(vertices: DataFrame, factors: DataFrame, keys: list[str], rounds: int = 20, max_step: float = math.inf, window: int | None = None) -> DataFrame:
    """Vertices (keys, k, pose) that best meet the factors of their key, with rounds and error.

    Factors are (keys, i, j, m_<pose>, s0 ... s5, huber, confidence): a measured pose of j seen from
    i (of i itself, if j is null), standard deviations in the order turn, shift (FREE: not
    constrained). The first vertex stays where it is, unless an absolute factor on it says
    otherwise. With a window only the last so many vertices of a key and the factors between them
    count; older ones are dropped, as in a sliding window. A task takes many graphs, each whole,
    and solves them at once; its memory grows with the largest graph's vertices and edges only.
    Factors of unknown vertices don't count; a key without factors keeps its vertices.
    """
    kinds = [f"{c} {vertices.schema[c].dataType.simpleString()}" for c in keys]
    columns = [*keys, "k", *POSE, "rounds", "error"]

    def solved(pdf: pd.DataFrame) -> pd.DataFrame:
        graph = np.cumsum(_changes(pdf, keys)) - 1
        vertex = (pdf["what"] == 0).to_numpy()
        left, of_left = pdf[vertex], graph[vertex]
        if window:
            last = np.searchsorted(of_left, of_left, "right") - np.arange(len(left)) <= window
            left, of_left = left[last], of_left[last]
        right, of_right = pdf[~vertex], graph[~vertex]
        place = pd.MultiIndex.from_arrays([of_left, left["i"].to_numpy()])
        i, j = (place.get_indexer(pd.MultiIndex.from_arrays([of_right, right[c].fillna(-1).astype("int64").to_numpy()])) for c in "ij")
        alone = right["j"].isna().to_numpy()
        known = right["i"].notna().to_numpy() & (i >= 0) & (alone | (j >= 0))
        right, of_right, i, j = right[known], of_right[known], i[known], np.where(alone, -1, j)[known]
        poses = _motions(left, "m_") if len(left) else np.zeros((0, 4, 4))
        done, error = np.zeros(len(left), int), np.zeros(len(left))
        # graphs to solve: with factors, and with more than one vertex or an absolute factor on the first
        some, first, n = np.unique(of_left, return_index=True, return_counts=True)
        at = np.searchsorted(some, of_right)
        absolute = np.zeros(len(some), bool)
        absolute[at[(j < 0) & (i == first[at])]] = True
        live = np.isin(some, of_right) & ((n > 1) | absolute)
        if live.any():
            held, used = np.repeat(live, n), live[at]
            anew = np.cumsum(held) - 1
            right, i, j = right[used], i[used], j[used]
            sigma = right[[f"s{k}" for k in range(6)]].to_numpy(float)
            information = (1 / sigma**2)[:, :, None] * np.eye(6)
            found, rounds_, error_ = solve_many(poses[held], n[live], anew[i], np.where(j < 0, -1, anew[j]), _motions(right, "m_"), information, right["huber"].fillna(0).to_numpy(float), right["confidence"].fillna(1).to_numpy(float).clip(0, 1), rounds, max_step, ~absolute[live])
            poses[held], done[held], error[held] = found, np.repeat(rounds_, n[live]), np.repeat(error_, n[live])
        q = quaternions(poses[:, :3, :3]) if len(left) else np.zeros((0, 4))
        out = {c: left[c].to_numpy() for c in keys} | {"k": left["i"].astype("int64").to_numpy()}
        out |= {c: poses[:, a, 3] for a, c in enumerate(POSE[:3])} | {c: q[:, a] for a, c in enumerate(POSE[3:])}
        return pd.DataFrame(out | {"rounds": done, "error": error}, columns=columns)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, most = [], 0, TOGETHER
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n < most:
                continue
            joint = pd.concat(held, ignore_index=True)
            cut = int(np.flatnonzero(_changes(joint, keys))[-1])
            if cut:
                yield solved(joint[:cut])
            # the last graph waits for the rest of it, a long one ever longer, so that its rows are seldom joined
            held, n = [joint[cut:]], len(joint) - cut
            most = max(TOGETHER, 2 * n)
        if n:
            yield solved(pd.concat(held, ignore_index=True))

    schema = ", ".join([*kinds, "k long", *[f"{c} double" for c in POSE], "rounds int", "error double"])
    left = vertices.select(*keys, F.lit(0).alias("what"), F.col("k").cast("long").alias("i"), *[F.col(c).cast("double").alias(f"m_{c}") for c in POSE])
    right = factors.select(*keys, F.lit(1).alias("what"), F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), *[F.col(c).cast("double").alias(c) for c in [*FACTOR, "huber", "confidence"]])
    rows = in_tasks(left.unionByName(right, allowMissingColumns=True), keys).sortWithinPartitions(*keys, "what", "i", "j")
    return rows.mapInPandas(run, schema)


# ---- factors ----


@dataclass(frozen=True)
class Sigmas:
    """Standard deviations of the kinds of factors: radians, metres, and growth by distance and missing quality."""

    odometry_turn: float = 0.01
    odometry_shift: float = 0.05
    odometry_per_metre: float = 0.02
    wheel_shift: float = 0.05
    wheel_per_metre: float = 0.03
    wheel_lateral: float = 0.1
    visual_tilt: float = 0.02
    visual_yaw: float = 0.01
    visual_xy: float = 0.1
    visual_z: float = 0.2
    visual_per_metre: float = 0.05
    quality_growth: float = 2.0
    loop_yaw: float = 0.02
    loop_xy: float = 0.2
    loop_z: float = 0.1
    ground_z: float = 0.05
    huber: float = 1.5


def with_sigmas(factors: DataFrame, kind: str = "kind", distance: str = "distance", quality: str = "quality", s: Sigmas = Sigmas()) -> DataFrame:
    """Rows with s0 ... s5 (tilt, tilt, yaw, x, y, z), huber and confidence by their kind.

    Kinds: odometry (all axes, growing with distance), wheel (forward and sideways), rotation (a
    visual turn), visual (a visual turn and shift), loop_xy (heading and plane), loop_z (height), ground (height
    between neighbours).
    Axes that a kind says nothing about are FREE; loops and visual factors are robust; sigmas of
    visual factors and loops grow as quality (0 to 1, null as 1) falls. Other kinds give nulls.
    """
    grown = 1 + s.quality_growth * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.col(quality), F.lit(1.0)))))
    d = F.abs(F.coalesce(F.col(distance), F.lit(0.0)))
    free = F.lit(FREE)
    odometry = s.odometry_shift + s.odometry_per_metre * d
    tilt, yaw = s.visual_tilt * grown, s.visual_yaw * grown
    axes = {
        "odometry": [F.lit(s.odometry_turn)] * 3 + [odometry] * 3,
        "wheel": [free, free, free, F.greatest(F.lit(0.02), s.wheel_shift + s.wheel_per_metre * d), F.greatest(F.lit(0.02), F.lit(s.wheel_lateral)), free],
        "rotation": [tilt, tilt, yaw, free, free, free],
        "visual": [tilt, tilt, yaw, *[(s.visual_xy + s.visual_per_metre * d) * grown] * 2, (s.visual_z + s.visual_per_metre * d) * grown],
        "loop_xy": [free, free, s.loop_yaw * grown, s.loop_xy * grown, s.loop_xy * grown, free],
        "loop_z": [free] * 5 + [s.loop_z * grown],
        "ground": [free] * 5 + [F.lit(s.ground_z)],
    }
    out = {}
    for k in range(6):
        column = F.lit(None).cast("double")
        for name, sigma in axes.items():
            column = F.when(F.col(kind) == name, sigma[k]).otherwise(column)
        out[f"s{k}"] = column
    robust = F.when(F.col(kind) == "odometry", 0.0).when(F.col(kind).isin(*list(axes)), s.huber)
    return factors.withColumns(out | {"huber": robust, "confidence": F.lit(1.0)})


def yaw_quaternion(yaw: Column) -> list[Column]:
    """qw, qx, qy, qz of a heading."""
    return [F.cos(yaw / 2).alias("qw"), F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(yaw / 2).alias("qz")]


# ---- planar pose algebra with height, in columns ----

Pose4 = tuple[Column, Column, Column, Column]


def pose4(prefix: str = "") -> Pose4:
    """The columns x, y, z, yaw after a prefix."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x", "y", "z", "yaw"))


def compose4(a: Pose4, b: Pose4) -> Pose4:
    """Pose a, then b within it."""
    c, s = F.cos(a[3]), F.sin(a[3])
    return a[0] + c * b[0] - s * b[1], a[1] + s * b[0] + c * b[1], a[2] + b[2], wrapped(a[3] + b[3])


def relative4(a: Pose4, b: Pose4) -> Pose4:
    """Pose b seen from pose a."""
    c, s, dx, dy = F.cos(a[3]), F.sin(a[3]), b[0] - a[0], b[1] - a[1]
    return c * dx + s * dy, -s * dx + c * dy, b[2] - a[2], wrapped(b[3] - a[3])


def named4(p: Pose4, prefix: str = "") -> list[Column]:
    return [c.alias(f"{prefix}{n}") for c, n in zip(p, ("x", "y", "z", "yaw"), strict=True)]


@dataclass(frozen=True)
class ConsistencyGates:
    """How far a measurement may be from what the graph predicts."""

    max_xy: float = 2.0
    max_yaw: float = 0.2
    max_z: float = 0.5


def consistency(predicted: Pose4, measured: Pose4, xy_accepted: Column, z_accepted: Column, gates: ConsistencyGates = ConsistencyGates()) -> dict[str, Column]:
    """xy_consistent, z_consistent and reason of a measured relative pose against the predicted one.

    Plane and heading fail together, height on its own; the reason is the last gate that failed,
    that of height only if the plane is out as well. Null or infinite parts fail.
    """
    xy = F.hypot(measured[0] - predicted[0], measured[1] - predicted[1])
    yaw = F.abs(wrapped(measured[3] - predicted[3]))
    z = F.abs(measured[2] - predicted[2])
    off = lambda c, most: F.coalesce(F.isnan(c) | (c > most), F.lit(True))
    xy_ok = xy_accepted & ~off(xy, gates.max_xy) & ~off(yaw, gates.max_yaw)
    z_ok = z_accepted & ~off(z, gates.max_z)
    reason = F.when(off(z, gates.max_z) & ~xy_ok, "graph_z").when(off(yaw, gates.max_yaw), "graph_yaw").when(off(xy, gates.max_xy), "graph_xy")
    return {"xy_consistent": xy_ok, "z_consistent": z_ok, "reason": reason}


@dataclass(frozen=True)
class Output:
    """How much of the graph's correction a pose takes: mode (full, safe, blend, z_only), shares, caps, and what the plane needs in safe mode."""

    mode: str = "safe"
    xy_share: float = 1.0
    z_share: float = 1.0
    yaw_share: float = 1.0
    max_xy: float = 3.0
    max_z: float = 1.0
    max_yaw: float = 0.2
    min_loops: int = 3
    max_residual: float = 0.5


def corrected(raw: Pose4, last_raw: Pose4, last_solved: Pose4, loops: Column, residual: Column, how: Output = Output()) -> Pose4:
    """A raw pose carried along with its last keyframe from where it was to where the graph has it.

    full gives that pose. Else height always follows, by its share up to its cap, and plane and
    heading follow in blend, and in safe if there are enough loops, the residual is small and the
    correction is within the caps; z_only leaves them.
    """
    graph = compose4(last_solved, relative4(last_raw, raw))
    if how.mode == "full":
        return graph
    if how.mode not in ("safe", "blend", "z_only"):
        raise ValueError(f"no output mode {how.mode}")
    dx, dy, dz, turn = graph[0] - raw[0], graph[1] - raw[1], graph[2] - raw[2], wrapped(graph[3] - raw[3])
    size = F.hypot(dx, dy)
    safe = (loops >= how.min_loops) & (residual <= how.max_residual) & (size <= how.max_xy) & (F.abs(turn) <= how.max_yaw)
    follows = {"blend": F.lit(True), "safe": F.coalesce(safe, F.lit(False)), "z_only": F.lit(False)}[how.mode]
    share = F.when(follows, how.xy_share * F.least(F.lit(1.0), how.max_xy / F.greatest(how.xy_share * size, F.lit(1e-9)))).otherwise(0.0)
    clip = lambda c, most: F.greatest(F.lit(-most), F.least(F.lit(most), c))
    return raw[0] + share * dx, raw[1] + share * dy, raw[2] + clip(how.z_share * dz, how.max_z), wrapped(raw[3] + F.when(follows, clip(how.yaw_share * turn, how.max_yaw)).otherwise(0.0))
