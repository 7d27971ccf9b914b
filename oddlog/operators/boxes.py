"""Boxes of space that hold about as many points each, by halving a drawn part of the points at their medians."""

from __future__ import annotations

import numpy as np


class Boxes:
    """Every point of space lies in one box; ``low`` and ``high`` are its walls, infinite outside."""

    def __init__(self, drawn: np.ndarray, count: int):
        width = drawn.shape[1]
        self.dim, self.wall, self.below, self.low, self.high = [], [], [], [], []

        def part(points: np.ndarray, left: int, low: np.ndarray, high: np.ndarray) -> int:
            node = len(self.dim)
            self.dim.append(-1)
            self.wall.append(0.0)
            self.below.append((0, 0))
            dim = _widest(points) if left > 1 and len(points) > 1 else None
            if dim is None:
                self.below[node] = (len(self.low), 0)
                self.low.append(low)
                self.high.append(high)
                return node
            wall = float(_middle(points[:, dim]))
            side = points[:, dim] < wall
            less, more = low.copy(), high.copy()
            less[dim] = more[dim] = wall
            self.dim[node], self.wall[node] = dim, wall
            self.below[node] = part(points[side], left // 2, low, more), part(points[~side], left - left // 2, less, high)
            return node

        part(drawn, count, np.full(width, -np.inf), np.full(width, np.inf))
        self.dim, self.wall, self.below = np.array(self.dim), np.array(self.wall), np.array(self.below)
        self.low, self.high = np.array(self.low), np.array(self.high)

    def __len__(self) -> int:
        return len(self.low)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The box of each point."""
        node, rows = np.zeros(len(x), "int64"), np.arange(len(x))
        while True:
            inner = self.dim[node] >= 0
            if not inner.any():
                return self.below[node, 0]
            at = node[inner]
            node[inner] = self.below[at, (x[rows[inner], self.dim[at]] >= self.wall[at]).astype(int)]

    def inside(self, x: np.ndarray, box: int) -> np.ndarray:
        """How far each point of a box is from its nearest wall."""
        return np.minimum(x - self.low[box], self.high[box] - x).min(axis=1)


def _middle(values: np.ndarray) -> float:
    """The value that parts the points into those below and the others most evenly."""
    names, counts = np.unique(values, return_counts=True)
    below = np.cumsum(counts) - counts
    return names[np.argmin(np.abs(2 * below - len(values)))]


def _widest(points: np.ndarray) -> int | None:
    """The widest dimension that a wall halves about evenly, else the one it halves best; none if all points are one."""
    extent = points.max(axis=0) - points.min(axis=0)
    best, most = None, 0
    for dim in np.argsort(-extent, kind="stable").tolist():
        less = int((points[:, dim] < _middle(points[:, dim])).sum())
        share = min(less, len(points) - less)
        if 4 * share >= len(points):
            return dim
        if share > most:
            best, most = dim, share
    return best


def reached(x: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray, held: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, box) for the boxes from ``low`` to ``high`` no farther than ``reach`` from the points."""
    out = [(np.zeros(0, "int64"), np.zeros(0, "int64"))]
    step = max(1, held // max(len(low), 1))
    for at in range(0, len(x), step):
        square = np.zeros((len(x[at : at + step]), len(low)))
        for dim in range(x.shape[1]):
            value = x[at : at + step, dim, None]
            gap = np.maximum(np.maximum(low[:, dim] - value, value - high[:, dim]), 0.0)
            square += gap * gap
        limit = reach[at : at + step] * (1 + 1e-9)
        point, box = np.nonzero(np.sqrt(square) <= limit[:, None])
        out.append((at + point, box))
    return tuple(np.concatenate(c) for c in zip(*out))
