"""Truncated Cauchy and normal, Laplace and normal distributions, with supports in the units of the data."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_erf = np.vectorize(math.erf, otypes=[float])
_inv = np.vectorize(NormalDist().inv_cdf, otypes=[float])


def _phi(x):
    return 0.5 * (1 + _erf(np.asarray(x, float) / math.sqrt(2)))


class Distribution:
    """Base: subclasses give the unbounded pdf, cdf and ppf of (x - loc) / scale."""

    def __init__(self, loc: float = 0.0, scale: float = 1.0, a: float = -np.inf, b: float = np.inf):
        self.loc, self.scale, self.a, self.b = float(loc), float(scale), float(a), float(b)
        lo, hi = (self.a - self.loc) / self.scale, (self.b - self.loc) / self.scale
        self.low, self.high = float(self._cdf(lo)), float(self._cdf(hi))

    def support(self) -> tuple[float, float]:
        return self.a, self.b

    def pdf(self, x):
        x = np.asarray(x, float)
        inside = (x >= self.a) & (x <= self.b)
        return np.where(inside, self._pdf((x - self.loc) / self.scale) / self.scale / (self.high - self.low), 0.0)

    def cdf(self, x):
        x = np.clip(np.asarray(x, float), self.a, self.b)
        return np.clip((self._cdf((x - self.loc) / self.scale) - self.low) / (self.high - self.low), 0.0, 1.0)

    def ppf(self, q):
        q = np.asarray(q, float)
        out = self.loc + self.scale * self._ppf(self.low + q * (self.high - self.low))
        return np.where(q <= 0, self.a, np.where(q >= 1, self.b, np.clip(out, self.a, self.b)))


class TruncatedCauchy(Distribution):
    _pdf = staticmethod(lambda x: 1 / (np.pi * (1 + np.asarray(x) ** 2)))
    _cdf = staticmethod(lambda x: 0.5 + np.arctan(x) / np.pi)
    _ppf = staticmethod(lambda q: np.tan(np.pi * (np.asarray(q) - 0.5)))


class TruncatedNormal(Distribution):
    _pdf = staticmethod(lambda x: np.exp(-np.asarray(x) ** 2 / 2) / np.sqrt(2 * np.pi))
    _cdf = staticmethod(_phi)
    _ppf = staticmethod(lambda q: _inv(np.clip(q, 1e-300, 1 - 1e-16)))


class Laplace(Distribution):
    _pdf = staticmethod(lambda x: np.exp(-np.abs(x)) / 2)
    _cdf = staticmethod(lambda x: np.where(np.asarray(x) < 0, np.exp(np.minimum(x, 0)) / 2, 1 - np.exp(-np.maximum(x, 0)) / 2))
    _ppf = staticmethod(lambda q: np.where(np.asarray(q) < 0.5, np.log(np.maximum(2 * np.asarray(q), 1e-300)), -np.log(np.maximum(2 * (1 - np.asarray(q)), 1e-300))))


def Normal(loc: float = 0.0, scale: float = 1.0) -> TruncatedNormal:  # noqa: N802
    return TruncatedNormal(loc, scale)
