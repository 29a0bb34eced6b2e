"""Connected components by rounds of joins, chains, rigid fits and planes from sums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.operators.select import checkpointed


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node reaches over edges (a, b), taken in both directions.

    In every round a node takes the smallest component of itself and its neighbours and then
    that component's own; the rounds are checkpointed and end when nothing changes.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = checkpointed(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        moved = labels.join(near, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("c", "component")).alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("far"))
        new = checkpointed(moved.join(jump, "component", "left").select("node", "old", F.least("component", F.coalesce("far", "component")).alias("component")))
        labels = new.select("node", "component")
        if new.filter("old <> component").isEmpty():
            return labels


def large_components(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    """(node, component, size) of components with enough nodes."""
    found = components(nodes, edges)
    sizes = found.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    return found.join(sizes, "component").select("node", "component", "size")


def solve_chain(edges: DataFrame, keys: list[str], loop_weight: float = 4.0) -> DataFrame:
    """(keys, k, x): weighted least-squares positions of each key's vertices from its edges, the first at 0; one key is one task.

    The system is kept as its blocks (here numbers) and solved as a chain with loops, so memory
    grows with the key's vertices and edges only. Vertices that no edge ties to others stay at 0.
    """
    from waymark.operators.posegraph import solve_blocks

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        ks = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
        i, j = np.searchsorted(ks, pdf["i"]), np.searchsorted(ks, pdf["j"])
        w, d = np.where(pdf["loop"], loop_weight, 1.0), pdf["dx"].to_numpy(float)
        diagonal, g = np.full(len(ks), 1e-12), np.zeros(len(ks))
        for at, sign in ((i, -1), (j, 1)):
            np.add.at(diagonal, at, w)
            np.add.at(g, at, sign * w * d)
        diagonal[0], g[0] = 1, 0  # the first stays
        lo, hi = np.minimum(i, j), np.maximum(i, j)
        tied = lo > 0
        x = solve_blocks(diagonal[:, None, None], lo[tied], hi[tied], -w[tied, None, None], g[:, None])[:, 0]
        out = pd.DataFrame({k: pdf[k].iloc[0] for k in keys}, index=range(len(ks)))
        return out.assign(k=ks, x=x)

    kinds = ", ".join(f"{k} {edges.schema[k].dataType.simpleString()}" for k in keys)
    return edges.groupBy(*keys).applyInPandas(solve, f"{kinds}, k long, x double")


def kabsch(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Rotation (yaw, angle) and shift of each key from its nine cross sums s00 ... s22 and means ax ... bz: a 3 by 3 decomposition per row."""

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            h = p[[f"s{a}{b}" for a in range(3) for b in range(3)]].to_numpy().reshape(-1, 3, 3)
            u, _, vt = np.linalg.svd(h)
            flip = np.repeat(np.eye(3)[None], len(p), 0)
            flip[:, 2, 2] = np.linalg.det(vt.transpose(0, 2, 1) @ u.transpose(0, 2, 1))
            rot = vt.transpose(0, 2, 1) @ flip @ u.transpose(0, 2, 1)
            a, b = p[["ax", "ay", "az"]].to_numpy(), p[["bx", "by", "bz"]].to_numpy()
            t = b - np.einsum("nij,nj->ni", rot, a)
            angle = np.arccos(np.clip((np.trace(rot, axis1=1, axis2=2) - 1) / 2, -1, 1))
            yield p[keys].assign(yaw=np.arctan2(rot[:, 1, 0], rot[:, 0, 0]), angle=angle, tx=t[:, 0], ty=t[:, 1], tz=t[:, 2])

    kinds = ", ".join(f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{kinds}, yaw double, angle double, tx double, ty double, tz double")


def cross_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """The means and centred cross sums that kabsch() takes, of points (ax, ay, az) and (bx, by, bz)."""
    a, b = ("ax", "ay", "az"), ("bx", "by", "bz")
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in (*a, *b)], *[(F.covar_pop(p, q) * F.count("*")).alias(f"s{i}{j}") for i, p in enumerate(a) for j, q in enumerate(b)])


def planes(df: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Normal, eigenvalue shares and validity of the plane through each key's points: sums in SQL, a 3 by 3 eigen-decomposition per key."""
    c = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    sums = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m{a}") for a in "xyz"], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in c]).filter(F.col("n") >= least)

    def run(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            m = np.empty((len(p), 3, 3))
            for a, b in c:
                i, j = "xyz".index(a), "xyz".index(b)
                m[:, i, j] = m[:, j, i] = p[f"c{a}{b}"]
            values, vectors = np.linalg.eigh(m)
            normal = vectors[:, :, 0] * np.where(vectors[:, 2:3, 0] < 0, -1, 1)
            flat = values[:, 0] <= 0.2 * np.maximum(values[:, 1], 1e-12)
            yield p[[*keys, "n"]].assign(nx=normal[:, 0], ny=normal[:, 1], nz=normal[:, 2], l0=values[:, 0], l1=values[:, 1], l2=values[:, 2], valid=flat)

    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{kinds}, n long, nx double, ny double, nz double, l0 double, l1 double, l2 double, valid boolean")
