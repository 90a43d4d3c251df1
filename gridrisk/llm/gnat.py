"""A geometric near-neighbour access tree over a few whole-number points, searched for many queries at once.

A node has split points; each other point belongs to the split point nearest to it. For every pair of a split point and a
child the node stores the range of distances between that split point and what the child holds. A query that lies at
distance d from the split point has nothing nearer than d - high or low - d in the child, so a child goes where that is
strictly more than the best distance so far. Ranges and distances are rounded outwards; what is compared in the end are
squared distances as whole numbers, equal ones going to the lower index.
"""

from __future__ import annotations

import numpy as np

#: Of a distance's float and the few roundings on the way to a bound, far more than they can be wrong by.
SLACK = 2.0**-48
FARTHEST = np.iinfo(np.int64).max


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b, as longs."""
    out = np.zeros((len(a), len(b)), np.int64)
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        out += gap * gap
    return out


class Gnat:
    """points: long (n, dims), n at least 1. Points not chosen as split points lie in the children."""

    def __init__(self, points: np.ndarray, degree: int = 8, members: np.ndarray | None = None):
        self.members = np.arange(len(points)) if members is None else members
        own = points[self.members]
        picked, gap = [0], squared(own, own[:1])[:, 0]
        while len(picked) < min(degree, len(own)):  # each the farthest from those before; repeated points come last
            gap[picked] = -1
            picked.append(int(gap.argmax()))
            gap = np.minimum(gap, squared(own, own[picked[-1:]])[:, 0])
        self.splits, self.corners = self.members[picked], own[picked]
        rest = np.setdiff1d(np.arange(len(own)), picked)
        self.children, self.low, self.high = [], [], []
        if len(rest):
            far = squared(own[rest], self.corners)
            root, nearest = np.sqrt(far.astype(np.float64)), far.argmin(axis=1)
            for j in np.unique(nearest):
                inside = nearest == j
                self.low.append(root[inside].min(axis=0) * (1 - SLACK))
                self.high.append(root[inside].max(axis=0) * (1 + SLACK))
                self.children.append((int(j), Gnat(points, degree, self.members[rest[inside]])))

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the index of its nearest point and their squared distance."""
        best, index = np.full(len(queries), FARTHEST), np.full(len(queries), FARTHEST)
        self._visit(queries, np.arange(len(queries)), best, index)
        return index, best

    def _visit(self, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        far = squared(queries[rows], self.corners)
        order = np.argsort(self.splits)  # so that the first of equal distances has the lowest index
        at = order[far[:, order].argmin(axis=1)]
        near, name = far[np.arange(len(rows)), at], self.splits[at]
        won = (near < best[rows]) | ((near == best[rows]) & (name < index[rows]))
        best[rows[won]], index[rows[won]] = near[won], name[won]
        if not self.children:
            return
        root, home = np.sqrt(far.astype(np.float64)), far.argmin(axis=1)
        for j, child in self.children:  # first the child that the query itself would be in
            if (own := home == j).any():
                child._visit(queries, rows[own], best, index)
        for (j, child), low, high in zip(self.children, self.low, self.high, strict=True):
            reach = np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK)
            bound = np.maximum(root * (1 - SLACK) - high, low - root * (1 + SLACK)).max(axis=1) * (1 - SLACK)
            if (left := (home != j) & (bound <= reach)).any():
                child._visit(queries, rows[left], best, index)
