"""Cuboid remapping: a periodic box seen as a cuboid of other proportions.

For integer vectors u1, u2, u3 of determinant 1, each point has exactly one integer shift that brings it inside the
cuboid spanned by their Gram-Schmidt vectors. The shift is found axis by axis from the last: the fractional
coordinates in the basis u tell it in closed form, without a search over cells.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions.geometry import Vector, gram_schmidt, triple


class CuboidError(ValueError):
    pass


class Plane:
    """n . x + d through three points."""

    def __init__(self, p0, p1, p2):
        n = np.cross(np.subtract(p1, p0), np.subtract(p2, p0))
        self.normal = n / np.sqrt(n @ n)
        self.offset = -float(self.normal @ np.asarray(p0, float))

    def side(self, points):
        return np.asarray(points, float) @ self.normal + self.offset

    def cuts_unit_cube(self) -> int:
        """+1 or -1 when the unit cube lies on one side, 0 when the plane cuts it."""
        s = self.side(list(itertools.product((0, 1), repeat=3)))
        return 1 if (s >= 0).all() else -1 if (s <= 0).all() else 0


class Cell:
    """Points on the positive side of all faces."""

    def __init__(self, shift=(0, 0, 0), faces=()):
        self.shift, self.faces = np.asarray(shift), list(faces)

    def contains(self, points):
        return np.all([f.side(points) >= 0 for f in self.faces], axis=0) if self.faces else np.ones(len(points), bool)


class Cuboid:
    def __init__(self, u, boxsize=1.0):
        self.u, self.boxsize = np.asarray(u, int), triple(boxsize)
        if round(np.linalg.det(self.u)) != 1:
            raise CuboidError("the lattice vectors must have determinant 1")
        self.e = gram_schmidt(self.u)
        self.length = np.sqrt((self.e**2).sum(1))
        self.n = self.e / self.length[:, None]
        self.resize = np.sqrt(((self.boxsize * self.n) ** 2).sum(1))
        self.size = self.resize * self.length
        # u = upper @ e with ones on the diagonal: row i of u has component upper[j, i] along e[j]
        self.upper = np.array([[self.u[i] @ self.e[j] / (self.e[j] @ self.e[j]) for i in range(3)] for j in range(3)])

    def transform(self, x):
        """Unit coordinates of points inside the cuboid, times its resize. x: points in [0, boxsize)."""
        p = np.asarray(x, float) / self.boxsize
        q = p @ (self.e / (self.length**2)[:, None]).T
        for j in (2, 1, 0):  # subtract whole lattice vectors, the last axis first
            m = np.floor(q[..., j])
            q = q - m[..., None] * self.upper[:, j]
        return np.clip(q, 0, None) * self.length * self.resize

    def columns(self, x: Vector, velocity: bool = False) -> Vector:
        """transform() as column expressions; velocities are only rotated."""
        if velocity:
            return tuple(sum((F.lit(float(self.n[j, a] * self.resize[j] / self.boxsize[a])) * x[a] for a in (1, 2)), F.lit(float(self.n[j, 0] * self.resize[j] / self.boxsize[0])) * x[0]) for j in range(3))
        q = [sum((F.lit(float(self.e[j, a] / self.length[j] ** 2 / self.boxsize[a])) * x[a] for a in (1, 2)), F.lit(float(self.e[j, 0] / self.length[j] ** 2 / self.boxsize[0])) * x[0]) for j in range(3)]
        m2 = F.floor(q[2])
        q = [c - m2 * F.lit(float(self.upper[j, 2])) for j, c in enumerate(q)]
        m1 = F.floor(q[1])
        q = [c - m1 * F.lit(float(self.upper[j, 1])) if j < 2 else c for j, c in enumerate(q)]
        q[0] = q[0] - F.floor(q[0])
        return tuple(F.greatest(c, F.lit(0.0)) * F.lit(float(k)) for c, k in zip(q, self.size))

    def inverse(self, x):
        p = (np.asarray(x, float) / self.resize) @ self.n
        return p % 1.0 * self.boxsize

    def inverse_columns(self, x: Vector) -> Vector:
        out = []
        for a in range(3):
            p = sum((F.lit(float(self.n[j, a] / self.resize[j])) * x[j] for j in (1, 2)), F.lit(float(self.n[0, a] / self.resize[0])) * x[0])
            out.append(F.pmod(p, F.lit(1.0)) * F.lit(float(self.boxsize[a])))
        return tuple(out)

    @staticmethod
    def lattices(boxsize=1.0, maxint: int = 1, maxcomb: int | None = 1, sort: bool = True, ranges=None) -> dict[tuple, list]:
        """Cuboid sizes (rounded to 9 digits) and the vectors that give them, by brute force over coprime triples."""
        box = triple(boxsize)
        triples = [np.array(t) for t in coprime_triples(maxint)]
        ok = lambda i, s: ranges is None or ranges[i] is None or ranges[i][0] <= s <= ranges[i][1]
        found: dict[tuple, list] = defaultdict(list)
        for a in triples:
            na = np.sqrt(((box * a / np.sqrt(a @ a)) ** 2).sum()) * np.sqrt(a @ a)
            if not ok(0, na):
                continue
            for b in triples:
                c = np.cross(a, b)
                if not c.any():
                    continue
                for d in triples:
                    if c @ d == 1:
                        size = Cuboid((a, b, d), box).size
                        key = tuple(float(round(s, 9)) for s in size)
                        if all(ok(i, s) for i, s in enumerate(key)) and (not sort or key[0] >= key[1] >= key[2]) and (maxcomb is None or len(found[key]) < maxcomb):
                            found[key].append((a.tolist(), b.tolist(), d.tolist()))
        return dict(sorted((k, v) for k, v in found.items() if v))


def coprime_triples(maxint: int) -> list[tuple[int, int, int]]:
    r = range(-maxint, maxint + 1)
    return [t for t in itertools.product(r, repeat=3) if math.gcd(*t) == 1]
