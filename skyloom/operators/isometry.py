"""Rotations and translations of space, composed on the driver and applied as one projection."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions.geometry import Vector, line_of_sight, rotation_about


class IsometryError(ValueError):
    pass


class Isometry:
    """x -> R x + t. Methods return a new isometry."""

    def __init__(self, rotation=None, translation=None):
        self.rotation_matrix = np.eye(3) if rotation is None else np.asarray(rotation, float)
        self.shift = np.zeros(3) if translation is None else np.asarray(translation, float)

    @property
    def is_identity(self) -> bool:
        return bool((self.rotation_matrix == np.eye(3)).all() and (self.shift == 0).all())

    def dot(self, matrix, frame: str = "origin") -> "Isometry":
        """Rotate further: about the origin, or ('current') about the place the translation has led to."""
        if frame not in ("origin", "current"):
            raise IsometryError(f"unknown frame {frame}")
        m = np.asarray(matrix, float)
        return Isometry(m @ self.rotation_matrix, m @ self.shift if frame == "origin" else self.shift)

    def rotation(self, angle: float = 0.0, axis="x", degree: bool = True, frame: str = "origin") -> "Isometry":
        return self.dot(rotation_about(axis, angle, degree), frame)

    def translation(self, shift, axis=None, frame: str = "origin") -> "Isometry":
        """Add a vector, or a length along an axis; in the current frame the vector is rotated first."""
        v = float(shift) * line_of_sight(axis) if axis is not None else np.ones(3) * np.asarray(shift, float)
        if frame == "current":
            v = self.rotation_matrix @ v
        elif frame != "origin":
            raise IsometryError(f"unknown frame {frame}")
        return Isometry(self.rotation_matrix, self.shift + v)

    def reset_rotation(self, frame: str = "origin") -> "Isometry":
        return self.dot(self.rotation_matrix.T, frame)

    def reset_translation(self) -> "Isometry":
        return Isometry(self.rotation_matrix)

    def __add__(self, other: "Isometry") -> "Isometry":
        """self, then other."""
        return Isometry(other.rotation_matrix @ self.rotation_matrix, other.rotation_matrix @ self.shift + other.shift)

    def __radd__(self, other):
        return self if other == 0 else NotImplemented

    @classmethod
    def concatenate(cls, *others: "Isometry") -> "Isometry":
        return sum(others[0] if len(others) == 1 and not isinstance(others[0], Isometry) else others)

    def apply(self, v: Vector, invariant: bool = False) -> Vector:
        """Column expressions; translational invariants (velocities) are only rotated."""
        if self.is_identity:
            return v
        out = []
        for row, t in zip(self.rotation_matrix, self.shift):
            terms = [F.lit(float(r)) * c for r, c in zip(row, v) if r]
            e = sum(terms[1:], terms[0]) if terms else F.lit(0.0)
            out.append(e if invariant or not t else e + F.lit(float(t)))
        return tuple(out)

    def __call__(self, points, invariant: bool = False):
        """On a numpy array of points."""
        return np.asarray(points, float) @ self.rotation_matrix.T + (0 if invariant else self.shift)


def box_to_cutsky(boxsize, dmax: float, dmin: float = 0.0):
    """Largest (distance, RA, Dec) ranges of a survey to dmax that a box can hold."""
    lx, ly, lz = np.ones(3) * np.asarray(boxsize, float)
    swap = ly < lz
    if swap:
        ly, lz = lz, ly
    asin = lambda v: math.degrees(math.asin(v))
    dx = dmax - lx
    if dx <= 0:  # the observer is in the box
        dmin = 0.0
        if ly / 2 < dmax:
            half = asin(ly / 2 / dmax), asin(lz / 2 / dmax)
        else:
            half = (180.0 if -dx >= dmax else asin(-dx / dmax) + 90), (asin(lz / 2 / dmax) if lz / 2 < dmax else 90.0)
    elif math.hypot(dx, ly / 2) < dmax:  # the far sphere leaves through the sides
        ra = asin(ly / 2 / dmax)
        dmin = max(dmin, dx / math.cos(math.radians(ra)))
        half = ra, (asin(lz / 2 / dmax) if lz / 2 < dmax else 90.0)
    else:  # the near sphere meets the front
        if dmin < dx:
            raise IsometryError(f"the box needs a smallest distance of {dx} at least")
        edge = math.degrees(math.acos(dx / dmin))
        half = edge, min(asin(lz / 2 / dmax) if lz / 2 < dmax else 90.0, edge)
    ra, dec = reversed(half) if swap else half
    return (dmin, dmax), (-ra, ra), (-dec, dec)


def cutsky_to_box(drange, rarange, decrange):
    """Smallest box that holds a survey, and the isometry that brings a box at the origin to it."""
    dmin, dmax = drange
    lo, hi = (a % 360.0 for a in rarange)
    if lo > hi:
        lo -= 360.0
    a, b = math.radians(abs(hi - lo) / 2), math.radians(abs(decrange[1] - decrange[0]) / 2)
    size = np.array([dmax - dmin * min(math.cos(a), math.cos(b)), 2 * dmax * math.sin(a), 2 * dmax * math.sin(b)])
    way = Isometry().translation(dmax - size[0] / 2, "x").rotation(-(decrange[0] + decrange[1]) / 2, "y").rotation((lo + hi) / 2, "z")
    return size, way
