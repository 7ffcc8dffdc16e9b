"""Interpolating splines of order 1 to 3 and root finding, on numpy alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


class Spline:
    """Interpolates (x, y) by a spline of order k. ext: 'extrapolate', 'zeros', 'clip' or 'raise' outside of x.

    k=3 is the not-a-knot cubic, k=2 has its knots midway between nodes, k=1 is piecewise linear.
    """

    def __init__(self, x, y, k: int = 3, ext: str = "extrapolate"):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        self.k, self.ext = min(k, len(self.x) - 1), ext
        if np.any(np.diff(self.x) <= 0):
            raise ValueError("nodes must increase")
        k, x = self.k, self.x
        inner = x[2:-2] if k == 3 else (x[1:-2] + x[2:-1]) / 2 if k == 2 else x[1:-1]
        self.t = np.concatenate([[x[0]] * (k + 1), inner, [x[-1]] * (k + 1)])
        self.c = np.linalg.solve(self._basis(x), self.y) if len(x) <= 400 else self._banded(x)

    def _span(self, v):
        return np.clip(np.searchsorted(self.t, v, "right") - 1, self.k, len(self.t) - self.k - 2)

    def _local(self, v):
        """Span and the k+1 basis functions that are not zero there."""
        i = self._span(v)
        n = np.ones((len(v), 1))
        for d in range(1, self.k + 1):
            new = np.zeros((len(v), d + 1))
            for r in range(d):
                left, right = self.t[i + 1 + r - d], self.t[i + 1 + r]
                w = n[:, r] / (right - left)
                new[:, r] += w * (right - v)
                new[:, r + 1] += w * (v - left)
            n = new
        return i, n

    def _basis(self, v):
        i, n = self._local(np.asarray(v, float))
        out = np.zeros((len(i), len(self.x)))
        for r in range(self.k + 1):
            out[np.arange(len(i)), i - self.k + r] += n[:, r]
        return out

    def _banded(self, x):
        """Gaussian elimination without pivots inside the band: a collocation matrix of B-splines is totally positive."""
        i, n = self._local(x)
        k, size = self.k, len(x)
        rows = [dict(zip(range(a - k, a + 1), b)) for a, b in zip(i.tolist(), n.tolist())]
        y = self.y.astype(float).tolist()
        for p in range(size):
            for q in range(p + 1, min(size, p + k + 2)):
                if f := rows[q].get(p, 0.0) / rows[p][p]:
                    for c, v in rows[p].items():
                        rows[q][c] = rows[q].get(c, 0.0) - f * v
                    y[q] -= f * y[p]
        out = [0.0] * size
        for p in range(size - 1, -1, -1):
            out[p] = (y[p] - sum(v * out[c] for c, v in rows[p].items() if c > p)) / rows[p][p]
        return np.array(out)

    def __call__(self, v):
        v = np.asarray(v, float)
        flat = np.atleast_1d(v).ravel()
        outside = ~((flat >= self.x[0]) & (flat <= self.x[-1])) & ~np.isnan(flat)
        if self.ext == "raise" and outside.any():
            raise ValueError("value outside of the interpolation range")
        w = np.clip(flat, self.x[0], self.x[-1]) if self.ext == "clip" else flat
        i, n = self._local(w)
        out = sum(n[:, r] * self.c[i - self.k + r] for r in range(self.k + 1))
        if self.ext == "zeros":
            out = np.where(outside, 0.0, out)
        return out.reshape(v.shape)

    def integral(self, a: float, b: float) -> float:
        """By Gauss-Legendre on each knot interval: exact for the order."""
        lo, hi = max(a, self.x[0]), min(b, self.x[-1])
        if hi <= lo:
            return 0.0
        knots = np.unique(np.concatenate([[lo, hi], self.t[(self.t > lo) & (self.t < hi)]]))
        p, w = np.polynomial.legendre.leggauss(3)
        mid, half = (knots[1:] + knots[:-1]) / 2, np.diff(knots) / 2
        return float((self(mid[:, None] + half[:, None] * p) * w * half[:, None]).sum())

    def column(self, v: Column) -> Column:
        """As a column: native for order 1, a vectorised function for the others."""
        return linear_column(v, self.x, self.y, self.ext) if self.k == 1 else numpy_column(self)(v)


def numpy_column(f):
    """A numpy function of arrays as a function of columns (Arrow batches)."""

    def call(*columns: Column) -> Column:
        if len(columns) == 1:

            @F.pandas_udf(DoubleType())
            def one(a: pd.Series) -> pd.Series:
                return pd.Series(np.asarray(f(a.to_numpy(float)), float))

            return one(*columns)
        if len(columns) == 2:

            @F.pandas_udf(DoubleType())
            def two(a: pd.Series, b: pd.Series) -> pd.Series:
                return pd.Series(np.asarray(f(a.to_numpy(float), b.to_numpy(float)), float))

            return two(*columns)

        @F.pandas_udf(DoubleType())
        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(np.asarray(f(a.to_numpy(float), b.to_numpy(float), c.to_numpy(float)), float))

        return three(*columns)

    return call


def linear_column(v: Column, x, y, ext: str = "extrapolate") -> Column:
    """Piecewise linear interpolation as a native expression: a binary search by nested conditionals (up to 64 nodes)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    if len(x) > 64:
        return numpy_column(Spline(x, y, 1, ext))(v)
    xs, ys = F.array(*[F.lit(float(a)) for a in x]), F.array(*[F.lit(float(a)) for a in y])
    i = F.least(F.greatest(_place(v, x), F.lit(1)), F.lit(len(x) - 1)).cast("int")
    x0, x1, y0, y1 = F.element_at(xs, i), F.element_at(xs, i + 1), F.element_at(ys, i), F.element_at(ys, i + 1)
    inside = y0 + (y1 - y0) * (v - x0) / (x1 - x0)
    if ext == "zeros":
        return F.when((v >= float(x[0])) & (v <= float(x[-1])), inside).otherwise(0.0)
    if ext == "clip":
        return F.when(v <= float(x[0]), float(y[0])).when(v >= float(x[-1]), float(y[-1])).otherwise(inside)
    if ext == "raise":
        return F.when((v >= float(x[0])) & (v <= float(x[-1])), inside).otherwise(F.raise_error(F.lit("value outside of the interpolation range")).cast("double"))
    return inside


def _place(v: Column, x: np.ndarray) -> Column:
    """How many nodes are at or below v: nested conditionals, log2(n) comparisons deep."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < float(x[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(x))


def bisect(f, lo: float, hi: float, rounds: int = 200) -> float:
    """Root of a function that changes sign between lo and hi."""
    flo = f(lo)
    for _ in range(rounds):
        mid = (lo + hi) / 2
        if (f(mid) > 0) == (flo > 0):
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2
