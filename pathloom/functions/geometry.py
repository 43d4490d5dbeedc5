"""Vector and hyperbolic-ball functions as column expressions over arrays of doubles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BORDER = 13.0


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)


def norm(a: Column) -> Column:
    return F.sqrt(squared(a))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def poincare(a: Column, b: Column) -> Column:
    """Distance in the unit ball of curvature -1."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.acosh(F.greatest(F.lit(1.0), 1 + 2 * gap / ((1 - squared(a)) * (1 - squared(b)))))


def clamp(d: Column, border: float = BORDER) -> Column:
    return F.least(d, F.lit(border))


def radius(a: Column) -> Column:
    return 2 * F.atanh(norm(a))


def head_distance(heads: Column, a: Column, distance=poincare) -> Column:
    """Least distance from a profile's heads to a vector, clamped."""
    return clamp(F.array_min(F.transform(heads, lambda h: distance(h, a))))


def chamfer(p: Column, q: Column, distance=poincare) -> Column:
    """Mean of the two directed means of nearest-head distances."""
    near = lambda a, b: F.aggregate(F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: clamp(distance(x, y))))), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return (near(p, q) + near(q, p)) / 2


def min_linkage(p: Column, q: Column, distance=poincare) -> Column:
    return F.array_min(F.transform(p, lambda x: F.array_min(F.transform(q, lambda y: clamp(distance(x, y))))))


def head_spread(heads: Column, distance=poincare) -> Column:
    """The diversity term: mean of exp(-d) over pairs of different heads; 0 for a single head."""
    pairs = F.flatten(F.transform(heads, lambda x, i: F.transform(F.filter(heads, lambda y, j: j > i), lambda y: F.exp(-distance(x, y)))))
    return F.when(F.size(pairs) > 0, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / F.size(pairs)).otherwise(0.0)


def threshold_scale(as_norm: Column) -> Column:
    """0.8 near the centre, 1 near the border, linear between norms 0.8 and 0.95."""
    return F.when(as_norm < 0.8, 0.8).when(as_norm > 0.95, 1.0).otherwise(0.8 + (as_norm - 0.8) * (4.0 / 3.0))


def coverage(level: Column, up: Column, down: Column) -> Column:
    return F.log2(level + 1) * F.pow(up, 3) * F.pow(down, 2)


DISTANCES = {"hyperbolic": poincare, "euclidean": euclidean}


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows and rows, summed in the order of the dimensions as the columns above are."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        gap = a[:, k, None] - b[None, :, k]
        out += gap * gap
    return out


class Rows:
    """A distance of all rows of one matrix to rows of another: it rises with the ratio of their squared gap to the product of
    both rows' weights. ``nearest`` and ``near`` work out all ratios by one matrix product, with a bound on its error, and
    measure as the columns above do what the bound leaves open."""

    def __init__(self, weight, of_ratio, to_ratio):
        self.weight, self.of_ratio, self.to_ratio = weight, of_ratio, to_ratio

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return self.of_ratio(_squares(a, b) / (self.weight(a)[:, None] * self.weight(b)[None, :]))

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of each row and the other's row in its place."""
        out = np.zeros(len(a))
        for k in range(a.shape[1]):
            gap = a[:, k] - b[:, k]
            out += gap * gap
        return self.of_ratio(out / (self.weight(a) * self.weight(b)))

    def _ratios(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """All ratios, and for each row of ``a`` how far off they may be; None where rows have no place in the space."""
        wa, wb = self.weight(a), self.weight(b)
        sa, sb = (a * a).sum(1), (b * b).sum(1)
        if not (np.isfinite(sa).all() and np.isfinite(sb).all() and (wa > 0).all() and (wb > 0).all()):
            return None
        left, right = np.column_stack([a * -2, sa, np.ones(len(a))]) / wa[:, None], np.column_stack([b, np.ones(len(b)), sb]) / wb[:, None]
        off = 16 * (a.shape[1] + 2) * np.finfo(float).eps * (sa + sb.max())
        return left @ right.T, off / (wa * wb.min())

    def nearest(self, a: np.ndarray, b: np.ndarray, same: tuple[np.ndarray, np.ndarray], close: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, j, distance) with every j that is at most ``close`` farther from i than the nearest one; pairs of ``same`` don't count."""
        if (found := self._ratios(a, b)) is None:
            d = self(a, b)
            d[same] = np.inf
            i, j = np.nonzero((d <= d.min(1, keepdims=True) + close) & (d < np.inf))
            return i, j, d[i, j]
        q, off = found
        q[same] = np.inf
        most = self.to_ratio(self.of_ratio(np.maximum(q.min(1), 0) + off) + close)
        i, j = np.nonzero((q <= (most + off + 1e-12 * (1 + most))[:, None]) & (q < np.inf))
        return i, j, self.pairs(a[i], b[j])

    def near(self, a: np.ndarray, b: np.ndarray, most: float) -> np.ndarray:
        """Which are at most ``most`` apart."""
        if most < 0 or (found := self._ratios(a, b)) is None:
            return self(a, b) <= most
        q, off = found
        edge = self.to_ratio(most)
        off = (off + 1e-12 * (1 + edge))[:, None]
        out = q <= edge + off
        i, j = np.nonzero(out & (q >= edge - off))
        out[i, j] = self.pairs(a[i], b[j]) <= most
        return out


#: The distances of many rows to many, for tasks that have both.
ROWS = {
    poincare: Rows(lambda x: 1 - _squares(np.zeros((1, x.shape[1])), x)[0], lambda q: np.arccosh(np.maximum(1.0, 1 + 2 * q)), lambda d: np.sinh(d / 2) ** 2),
    euclidean: Rows(lambda x: np.ones(len(x)), np.sqrt, np.square),
}
