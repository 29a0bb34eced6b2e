"""The best poses of a lattice of shifts and turns by branch and bound over running maxima of a map.

What a point scores in a cell depends on the cell and on the point's class (label, dynamic or
not). A block of shifts moves a point over a window of cells; the largest value of its class in
a window of at least that size bounds its score for the whole block. Blocks are split in four,
best bound first, until none can hold one of the two best poses. A task holds one key's points,
summed to cells, and the cells of the map within its reach.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

#: Cells lie within this of the origin, along an axis; points farther out meet no cell.
FAR = 1 << 30


def _packed(ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    return (ix << 32) + (iy + (1 << 31))


def _floor(x: np.ndarray) -> np.ndarray:
    """Cells of coordinates; FAR for what is no number or too far."""
    with np.errstate(invalid="ignore"):
        return np.where(np.abs(x) < FAR, np.floor(x), FAR).astype(np.int64)


class Maxima:
    """Values (cells, classes) of map cells and their maxima over windows of 2**k cells a side, named by the least cell; a cell that isn't there counts zero."""

    def __init__(self, ix: np.ndarray, iy: np.ndarray, values: np.ndarray):
        order = np.argsort(_packed(ix, iy), kind="stable")
        self.levels = [(_packed(ix, iy)[order], np.vstack([values[order], np.zeros(values.shape[1])]))]

    def places(self, k: int, ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
        """Rows of a level's values; the last, of zeros, for windows without a cell."""
        while len(self.levels) <= k:
            self._double()
        keys = self.levels[k][0]
        wanted = _packed(ix, iy)
        place = np.searchsorted(keys, wanted)
        return np.where(keys.take(place, mode="clip") == wanted, place, len(keys)) if len(keys) else np.zeros(len(ix), np.int64)

    def at(self, k: int, ix: np.ndarray, iy: np.ndarray, classes: np.ndarray | slice) -> np.ndarray:
        place = self.places(k, ix, iy)
        return self.levels[k][1][place, classes]

    def _double(self) -> None:
        k = len(self.levels) - 1
        keys, values = self.levels[k]
        ix, iy = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)
        parts = [(a << k, b << k) for a in (0, 1) for b in (0, 1)]
        new = np.unique(np.concatenate([_packed(ix - a, iy - b) for a, b in parts]))
        nx, ny = new >> 32, (new & 0xFFFFFFFF) - (1 << 31)
        most = np.full((len(new), values.shape[1]), -np.inf)
        for a, b in parts:
            most = np.maximum(most, self.at(k, nx + a, ny + b, slice(None)))
        self.levels.append((new, np.vstack([most, np.zeros(values.shape[1])])))


class Scores:
    """Points (x, y, class, count) on maxima: exact scores of poses and bounds of blocks. The last class of the maxima says whether a cell counts as met."""

    def __init__(self, maxima: Maxima, x: np.ndarray, y: np.ndarray, classes: np.ndarray, n: np.ndarray, size: float):
        self.maxima, self.x, self.y, self.classes, self.n, self.size = maxima, x, y, classes, n, size
        self.total, self.scored = float(n.sum()), 0

    def turned(self, yaw: float) -> tuple[np.ndarray, np.ndarray]:
        c, s = math.cos(yaw), math.sin(yaw)
        return c * self.x - s * self.y, s * self.x + c * self.y

    def cells(self, turned: tuple[np.ndarray, np.ndarray], dx: float, dy: float) -> tuple[np.ndarray, np.ndarray]:
        return _floor((turned[0] + dx) / self.size), _floor((turned[1] + dy) / self.size)

    def exact(self, turned: tuple[np.ndarray, np.ndarray], dx: float, dy: float) -> float:
        """The mean over all points, nine decimals; -1 if none meets the map."""
        self.scored += 1
        ix, iy = self.cells(turned, dx, dy)
        place, values = self.maxima.places(0, ix, iy), self.maxima.levels[0][1]
        return round(float(self.n @ values[place, self.classes]) / self.total, 9) if values[place, -1].any() and self.total else -1.0

    def bound(self, turned: tuple[np.ndarray, np.ndarray], xs: np.ndarray, ys: np.ndarray) -> float:
        """No pose with a shift in xs by ys scores more."""
        (ax, ay), (bx, by) = self.cells(turned, xs[0], ys[0]), self.cells(turned, xs[-1], ys[-1])
        inside = (ax < FAR) & (bx < FAR) & (ay < FAR) & (by < FAR)
        widest = int(max(np.where(inside, np.maximum(bx - ax, by - ay), 0).max(initial=0), 0)) + 1
        k = (widest - 1).bit_length()
        most = np.where(inside, self.maxima.at(k, ax, ay, self.classes), 0.0)
        return float(self.n @ most) / self.total if self.total else -1.0


Found = tuple[float, tuple[int, int, int, int], float, float, float]


def best_two(scores: Scores, level: int, yaws: np.ndarray, xs: np.ndarray, ys: np.ndarray, known: list[Found]) -> list[Found]:
    """The two best of known and the lattice, as (minus score, (level, yaw, x and y as numbers), dx, dy, yaw): ties to the smaller numbers.

    Equal to scoring the whole lattice: a block is dropped only if its bound lies below the second
    of the two by more than rounding, so blocks that may tie are opened.
    """
    found, heap = sorted(known)[:2], []
    turned = [scores.turned(yaw) for yaw in yaws]

    def offer(a: int, i0: int, i1: int, j0: int, j1: int) -> None:
        nonlocal found
        if i1 - i0 == 1 and j1 - j0 == 1:
            one = (-scores.exact(turned[a], xs[i0], ys[j0]), (level, a, i0, j0), float(xs[i0]), float(ys[j0]), float(yaws[a]))
            found = sorted([*found, one])[:2]
        else:
            # a hair above the sum, whose rounding may differ from that of the exact score
            heapq.heappush(heap, (-max(scores.bound(turned[a], xs[i0:i1], ys[j0:j1]), -1.0) - 2e-9, a, i0, i1, j0, j1))

    for a in range(len(yaws)):
        offer(a, 0, len(xs), 0, len(ys))
    while heap:
        minus, a, i0, i1, j0, j1 = heapq.heappop(heap)
        if len(found) == 2 and minus > found[1][0]:
            break
        im, jm = (i0 + i1 + 1) // 2, (j0 + j1 + 1) // 2
        for p, q in ((i0, im), (im, i1)):
            for s, t in ((j0, jm), (jm, j1)):
                if p < q and s < t:
                    offer(a, p, q, s, t)
    return found
