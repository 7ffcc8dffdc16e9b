"""Vector and sky functions: column expressions for rows, numpy for the few numbers on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = "xyz"
Vector = tuple[Column, Column, Column]


def vector(name: str) -> Vector:
    """The three columns <name>_x, <name>_y, <name>_z."""
    return tuple(F.col(f"{name}_{a}") for a in AXES)


def is_sequence(x) -> bool:
    return isinstance(x, (list, tuple, set, frozenset))


def triple(x) -> np.ndarray:
    """A number or a vector as three doubles."""
    return np.ones(3) * np.asarray(x, float)


def line_of_sight(los) -> np.ndarray:
    """Unit vector of 'x', 'y', 'z', 0, 1, 2 or any 3-vector."""
    if isinstance(los, str):
        los = AXES.index(los)
    if np.ndim(los) == 0:
        return np.eye(3)[int(los)]
    v = np.asarray(los, float)
    return v / np.sqrt((v**2).sum())


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])


def dot(v: Vector, w) -> Column:
    w = [x if isinstance(x, Column) else F.lit(float(x)) for x in w]
    return v[0] * w[0] + v[1] * w[1] + v[2] * w[2]


def wrap_angle(a: Column, degree: bool = True) -> Column:
    full = F.lit(360.0) if degree else F.lit(2 * math.pi)
    return F.pmod(a, full)


def cartesian_to_sky(v: Vector, degree: bool = True) -> tuple[Column, Column, Column]:
    """(distance, ra in [0, 360), dec)."""
    d = norm(v)
    ra, dec = F.atan2(v[1], v[0]), F.asin(v[2] / d)
    return d, wrap_angle(F.degrees(ra) if degree else ra, degree), F.degrees(dec) if degree else dec


def sky_to_cartesian(distance: Column, ra: Column, dec: Column, degree: bool = True) -> Vector:
    if degree:
        ra, dec = F.radians(ra), F.radians(dec)
    return distance * F.cos(dec) * F.cos(ra), distance * F.cos(dec) * F.sin(ra), distance * F.sin(dec)


def radec_area(rarange, decrange) -> float | np.ndarray:
    """Area in square degrees between right ascensions and declinations; ranges may be arrays."""
    ra, dec = np.asarray(rarange, float), np.radians(np.asarray(decrange, float))
    width = np.where(ra[0] <= ra[1], ra[1] - ra[0], ra[1] - ra[0] + 360.0)
    area = width * np.degrees(np.sin(dec[1]) - np.sin(dec[0]))
    return float(area) if np.ndim(area) == 0 else area


def vector_projection(v: Vector, direction) -> Vector:
    """(v . n) n for the unit vector n of direction: fixed numbers or three columns."""
    if all(isinstance(x, Column) for x in direction):
        size = norm(direction)
        n = tuple(x / size for x in direction)
    else:
        n = tuple(F.lit(float(x)) for x in line_of_sight(direction))
    along = dot(v, n)
    return tuple(along * x for x in n)


def array_projection(v: Column, direction: Column) -> Column:
    """The same for arrays of any length."""
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    k = total(v, direction) / total(direction, direction)
    return F.transform(direction, lambda x: k * x.cast("double"))


def bits_clear(mask: Column, bits) -> Column:
    """No bit of the list is set."""
    return mask.bitwiseAND(F.lit(sum(1 << b for b in set(bits)))) == 0


def rotation_between(start, end) -> np.ndarray:
    """Rotation that takes one direction to another; opposite directions turn about any axis across them."""
    a, b = line_of_sight(start), line_of_sight(end)
    v, c = np.cross(a, b), float(a @ b)
    s = float(v @ v)
    if s < 1e-24:
        if c > 0:
            return np.eye(3)
        across = np.cross(a, np.eye(3)[np.abs(a).argmin()])
        across /= np.sqrt(across @ across)
        return 2 * np.outer(across, across) - np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + k + k @ k * (1 - c) / s


def rotation_about(axis, angle: float, degree: bool = True) -> np.ndarray:
    """Right-handed rotation by angle about axis."""
    n, t = line_of_sight(axis), math.radians(angle) if degree else angle
    k = np.array([[0, -n[2], n[1]], [n[2], 0, -n[0]], [-n[1], n[0], 0]])
    return np.eye(3) + math.sin(t) * k + (1 - math.cos(t)) * k @ k


def gram_schmidt(rows) -> np.ndarray:
    """Orthogonal vectors spanning the same flags; they keep their lengths across."""
    out = []
    for u in np.asarray(rows, float):
        for e in out:
            u = u - (u @ e) / (e @ e) * e
        out.append(u)
    return np.array(out)
