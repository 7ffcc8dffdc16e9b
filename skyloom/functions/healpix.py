"""HEALPix pixel numbers as native column expressions, after Gorski et al. (2005)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def ang2pix(nside: int, ra: Column, dec: Column, nest: bool = False) -> Column:
    """Pixel of right ascension and declination in degrees, in the ring scheme or (nest) the nested one."""
    n = nside
    z = F.sin(F.radians(dec))
    tt = F.pmod(ra, F.lit(360.0)) / F.lit(90.0)
    za = F.abs(z)
    if nest:
        return _nested(n, z, za, tt)
    # equatorial belt
    a, b = F.lit(float(n)) * (F.lit(0.5) + tt), F.lit(n * 0.75) * z
    jp, jm = F.floor(a - b), F.floor(a + b)
    ir = F.lit(n + 1) + jp - jm
    shift = F.lit(1) - ir.bitwiseAND(F.lit(1))
    ip = F.pmod(F.floor((jp + jm - F.lit(n) + shift + F.lit(1)) / 2), F.lit(4 * n))
    belt = F.lit(2 * n * (n - 1)) + (ir - 1) * F.lit(4 * n) + ip
    # polar caps
    tp = tt - F.floor(tt)
    r = F.lit(float(n)) * F.sqrt(F.lit(3.0) * (F.lit(1.0) - za))
    up, down = F.floor(tp * r), F.floor((F.lit(1.0) - tp) * r)
    ring = up + down + 1
    at = F.pmod(F.floor(tt * ring), F.lit(4) * ring)
    cap = F.when(z > 0, F.lit(2) * ring * (ring - 1) + at).otherwise(F.lit(12 * n * n) - F.lit(2) * ring * (ring + 1) + at)
    return F.when(za <= 2 / 3, belt).otherwise(cap).cast("long")


def _nested(n: int, z: Column, za: Column, tt: Column) -> Column:
    a, b = F.lit(float(n)) * (F.lit(0.5) + tt), F.lit(n * 0.75) * z
    jp, jm = F.floor(a - b), F.floor(a + b)
    fp, fm = F.floor(jp / n), F.floor(jm / n)
    face_b = F.when(fp == fm, fp.bitwiseOR(F.lit(4))).when(fp < fm, fp).otherwise(fm + 8)
    last = F.lit(n - 1)
    xb, yb = jm.bitwiseAND(last), last - jp.bitwiseAND(last)
    quarter = F.least(F.floor(tt), F.lit(3))
    tp = tt - quarter
    r = F.lit(float(n)) * F.sqrt(F.lit(3.0) * (F.lit(1.0) - za))
    p, m = F.least(F.floor(tp * r), last), F.least(F.floor((F.lit(1.0) - tp) * r), last)
    face_c = F.when(z >= 0, quarter).otherwise(quarter + 8)
    xc, yc = F.when(z >= 0, last - m).otherwise(p), F.when(z >= 0, last - p).otherwise(m)
    belt = za <= 2 / 3
    face, x, y = F.when(belt, face_b).otherwise(face_c), F.when(belt, xb).otherwise(xc), F.when(belt, yb).otherwise(yc)
    out = face.cast("long") * F.lit(n * n)
    for bit in range(int(math.log2(n))):  # interleave the bits of x and y
        out = out + F.shiftleft(F.shiftright(x.cast("long"), bit).bitwiseAND(F.lit(1)), 2 * bit) + F.shiftleft(F.shiftright(y.cast("long"), bit).bitwiseAND(F.lit(1)), 2 * bit + 1)
    return out.cast("long")


def ring_sql(nside: int, ra: str, dec: str) -> str:
    """ang2pix (ring scheme) as DuckDB SQL."""
    n = nside
    z, tt = f"sin(radians({dec}))", f"((({ra}) % 360.0 + 360.0) % 360.0 / 90.0)"
    jp, jm = f"floor({n}.0 * (0.5 + {tt}) - {n * 0.75} * {z})::BIGINT", f"floor({n}.0 * (0.5 + {tt}) + {n * 0.75} * {z})::BIGINT"
    ir = f"({n + 1} + {jp} - {jm})"
    ip = f"((floor(({jp} + {jm} - {n} + (1 - ({ir} & 1)) + 1) / 2.0)::BIGINT % {4 * n} + {4 * n}) % {4 * n})"
    r = f"({n}.0 * sqrt(3.0 * (1.0 - abs({z}))))"
    ring = f"(floor(({tt} - floor({tt})) * {r})::BIGINT + floor((1.0 - ({tt} - floor({tt}))) * {r})::BIGINT + 1)"
    at = f"(floor({tt} * {ring})::BIGINT % (4 * {ring}))"
    return f"CASE WHEN abs({z}) <= 2.0 / 3.0 THEN {2 * n * (n - 1)} + ({ir} - 1) * {4 * n} + {ip} WHEN {z} > 0 THEN 2 * {ring} * ({ring} - 1) + {at} ELSE {12 * n * n} - 2 * {ring} * ({ring} + 1) + {at} END"


def pixel_area(nside: int) -> float:
    """Square degrees."""
    return 4 * math.pi * np.degrees(1) ** 2 / (12 * nside**2)
