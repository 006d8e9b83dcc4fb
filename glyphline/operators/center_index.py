"""Nearest centers of many points by a k-d tree: exact, ties to the lowest label."""

from __future__ import annotations

import numpy as np

#: Centers of a leaf.
LEAF = 32


class CenterTree:
    """Halves of the centers along the wider side, down to leaves; points are led down together and only those that may find better are led to the other half."""

    def __init__(self, centers: np.ndarray, labels: np.ndarray):
        order = np.lexsort((labels, centers[:, 1], centers[:, 0]))
        self.centers, self.labels = centers[order], labels[order]
        self.root = self._split(np.arange(len(order)))

    def _split(self, at: np.ndarray):
        c = self.centers[at]
        low, high = c.min(axis=0), c.max(axis=0)
        axis = int(np.argmax(high - low))
        if len(at) <= LEAF or low[axis] == high[axis]:
            # of equal centers the lowest label alone can be found
            first = np.unique(c, axis=0, return_index=True)[1] if low[axis] == high[axis] else slice(None)
            return at[first]
        order = at[np.argsort(c[:, axis], kind="stable")]
        half = len(order) // 2
        value = self.centers[order[half], axis]
        return axis, float(value), self._split(order[:half]), self._split(order[half:])

    def nearest(self, points: np.ndarray, distance: np.ndarray | None = None, label: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and label of each point's nearest center, or what is given where that is nearer."""
        d = np.full(len(points), np.inf) if distance is None else distance.astype(float)
        best = np.full(len(points), np.iinfo(np.int64).max) if label is None else label.astype(np.int64)

        def visit(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if isinstance(node, np.ndarray):
                p, c = points[at], self.centers[node]
                x, y = p[:, :1] - c[None, :, 0], p[:, 1:] - c[None, :, 1]
                far = x * x + y * y
                least = far.min(axis=1)
                own = np.where(far == least[:, None], self.labels[node][None, :], np.iinfo(np.int64).max).min(axis=1)
                better = (least < d[at]) | (least == d[at]) & (own < best[at])
                d[at[better]], best[at[better]] = least[better], own[better]
                return
            axis, value, low, high = node
            off = points[at, axis] - value
            for side, near, other in ((off < 0, low, high), (off >= 0, high, low)):
                visit(near, at[side])
                # rounding keeps order: no center beyond the plane is nearer than the plane
                visit(other, at[side][off[side] * off[side] <= d[at[side]]])

        visit(self.root, np.arange(len(points)))
        return d, best
