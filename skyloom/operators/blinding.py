"""Blinding of survey catalogs: Alcock-Paczynski, shuffled distances, redshift space, primordial non-Gaussianity."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.functions.cosmology import DistanceToRedshift, blinded, cosmology
from skyloom.functions.interp import Spline, numpy_column
from skyloom.functions.rng import u01
from skyloom.operators import mesh
from skyloom.operators.scratch import settled

CRITICAL = 1.686


def positions_in(df: DataFrame, kind: str, columns, distance_of_z=None) -> DataFrame:
    """Position_x, _y, _z from 'xyz' (three columns), 'pos' (an array), 'rdd' (RA, DEC, distance) or 'rdz' (redshift)."""
    c = [F.col(x) for x in ([columns] if isinstance(columns, str) else columns)]
    need = {"pos": 1, "xyz": 3, "rdd": 3, "rdz": 3}
    if kind not in need or len(c) != need[kind]:
        raise ValueError(f"positions of kind {kind} need {need.get(kind, 'a known kind')} columns")
    if kind == "pos":
        v = tuple(F.element_at(c[0], i + 1).cast("double") for i in range(3))
    elif kind == "xyz":
        v = tuple(x.cast("double") for x in c)
    else:
        d = c[2].cast("double") if kind == "rdd" else distance_of_z(c[2].cast("double"))
        v = g.sky_to_cartesian(d, c[0].cast("double"), c[1].cast("double"))
    return df.withColumns(dict(zip(("Position_x", "Position_y", "Position_z"), v)))


def positions_out(df: DataFrame, kind: str, z_of_distance=None) -> DataFrame:
    """The inverse: adds pos, or x, y, z, or RA, DEC, Distance, or RA, DEC, Z."""
    v = g.vector("Position")
    if kind == "pos":
        return df.withColumn("pos", F.array(*v))
    if kind == "xyz":
        return df.withColumns(dict(zip("xyz", v)))
    d, ra, dec = g.cartesian_to_sky(v)
    return df.withColumns({"RA": ra, "DEC": dec, **({"Distance": d} if kind == "rdd" else {"Z": z_of_distance(d)})})


def weights_in(df: DataFrame, weight: str | None) -> DataFrame:
    return df.withColumn("Weight", F.col(weight).cast("double") if weight else F.lit(1.0))


def weights_out(df: DataFrame, weight: str) -> DataFrame:
    """The inverse: Weight goes back to the column it came from."""
    return df.withColumn(weight, F.col("Weight")) if weight == "Weight" else df.withColumn(weight, F.col("Weight")).drop("Weight")


#: Rows of a bucket of the ranking, on average.
BUCKET_ROWS = 8192


def ranked(rows: DataFrame, u: Column, name: str) -> DataFrame:
    """rows with their place (1, 2, ...) in the order of a uniform number u: counts of buckets, whose number follows the
    rows, then a window in each."""
    parts = max(1, -(-rows.count() // BUCKET_ROWS))
    r = rows.withColumn("__u", u).withColumn("__b", F.floor(F.col("__u") * parts))
    ahead = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    n = r.groupBy("__b").agg(F.count("*").alias("__n")).select("__b", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__ahead"))
    inside = Window.partitionBy("__b").orderBy("__u")
    return r.join(F.broadcast(n), "__b").withColumn(name, F.col("__ahead") + F.row_number().over(inside)).drop("__b", "__u", "__ahead")


#: Parameters that are blinded unless others are named, and how far on either side.
SPREADS = {"w0_fld": 0.05, "wa_fld": 0.2, "Omega_m": 0.02, "f": 0.05, "fnl": 10}


class Blinding:
    """A fiducial and a blind cosmology. The blind one is given, or drawn around the fiducial one by `spreads` (SPREADS if
    none are named; an empty dict blinds nothing); its f is that at redshift z."""

    def __init__(self, fiducial="DESI", spreads: dict | None = None, seed: int = 42, bias: float = 1.0, z: float = 1.0, blind=None, zmax: float = 6.0):
        self.fid = cosmology(fiducial)
        self.blind = cosmology(blind) if blind is not None else blinded(self.fid, SPREADS if spreads is None else spreads, seed, z=z)
        self.bias, self.z = bias, z
        grid = np.concatenate([[0.0], np.geomspace(1e-4, zmax, 2047)])
        self.inverse = DistanceToRedshift(self.fid.distance, zmax)
        # blind over fiducial distance, as a function of fiducial distance
        d = self.fid.distance(grid)
        ratio = np.append(np.nan, self.blind.distance(grid[1:]) / d[1:])
        ratio[0] = ratio[1]
        self.ratio = Spline(d, ratio, 3, "clip")

    def ap(self, rows: DataFrame) -> DataFrame:
        """Distances become those that the redshifts have in the blind cosmology."""
        v = g.vector("Position")
        r = rows.withColumn("__k", self.ratio.column(g.norm(v)))
        return r.withColumns({f"Position_{a}": c * F.col("__k") for a, c in zip("xyz", v)}).drop("__k")

    def fraction(self) -> float:
        f = (self.blind.get("f", self.z) / self.fid.get("f", self.z)) ** 2
        if f > 1:
            raise ValueError("shuffling needs a smaller growth rate in the blind cosmology")
        return f

    def shuffle(self, rows: DataFrame, row_id: str = "row_id", seed: int = 42, fraction: float | None = None) -> DataFrame:
        """A fraction of the rows, (f_blind / f)^2 unless given, swap distances at random; the others keep theirs."""
        share = self.fraction() if fraction is None else fraction
        v = g.vector("Position")
        r = settled(rows.withColumn("__d", g.norm(v)), "shuffle")
        moved = r.where(u01(F.col(row_id), seed, "pick") < share).select(row_id, "__d")
        give = ranked(moved, u01(F.col(row_id), seed, "give"), "__r").select("__r", F.col("__d").alias("__new"))
        take = ranked(moved, u01(F.col(row_id), seed, "take"), "__r").select(row_id, "__r")
        swap = take.join(give, "__r").select(row_id, "__new")
        out = r.join(swap, row_id, "left").withColumn("__k", F.coalesce("__new", "__d") / F.col("__d"))
        return out.withColumns({f"Position_{a}": c * F.col("__k") for a, c in zip("xyz", v)}).drop("__k", "__d", "__new")

    # reconstruction: Zel'dovich displacements of the smoothed density contrast of data against randoms

    def contrast(self, data: DataFrame, randoms: DataFrame | None, grid: mesh.Grid, radius: float = 15.0, floor: float = 0.01) -> DataFrame:
        """delta_k of the field, smoothed by a Gaussian of the radius, over the bias."""
        w = "Weight" if "Weight" in data.columns else None
        a = mesh.paint(data, grid, weight=w)
        if randoms is None:
            m = mesh.mean(a)
            d = a.select("ix", F.transform("v", lambda x: x / F.lit(m) - 1.0).alias("v"))
        else:
            b = settled(mesh.paint(randoms, grid, weight="Weight" if "Weight" in randoms.columns else None), "randoms")
            a = settled(a, "data")
            alpha = mesh.mean(a) / mesh.mean(b)
            least = floor * mesh.mean(b) * alpha
            d = mesh.combine(lambda x, y: np.where(alpha * y > least, x / np.maximum(alpha * y, least) - 1, 0.0), a, b)
        bias = self.bias
        s = lambda c, kx, ky, kz: c * np.exp(-0.5 * radius**2 * (kx**2 + ky**2 + kz**2)) / bias
        return settled(mesh.map_complex(mesh.r2c(d, grid.n), grid, s), "contrast")

    def gradients(self, rows: DataFrame, delta_k: DataFrame, grid: mesh.Grid, row_id: str, name: str) -> DataFrame:
        """rows with <name>_x, _y, _z: i k / k^2 times the field, read out at positions."""
        fields = {}
        for a, x in enumerate("xyz"):
            m = lambda c, kx, ky, kz, a=a: np.where((k2 := kx**2 + ky**2 + kz**2) > 0, 1j * (kx, ky, kz)[a] / np.where(k2 > 0, k2, 1) * c, 0)
            fields[f"{name}_{x}"] = mesh.c2r(mesh.map_complex(delta_k, grid, m), grid.n)
        return rows.join(mesh.readout_many(fields, grid, rows, row_id=row_id), row_id)

    def shifts(self, rows: DataFrame, delta_k: DataFrame, grid: mesh.Grid, f: float, row_id: str = "row_id") -> DataFrame:
        """(row_id, shift_x, _y, _z): f times the displacement along the local line of sight."""
        out = self.gradients(rows.select(row_id, *[f"Position_{a}" for a in "xyz"]), delta_k, grid, row_id, "psi")
        v = g.vector_projection(g.vector("psi"), g.vector("Position"))
        return out.select(row_id, *[(c * f).alias(f"shift_{a}") for a, c in zip("xyz", v)])

    def rsd(self, data: DataFrame, randoms: DataFrame | None, grid: mesh.Grid, radius: float = 15.0, row_id: str = "row_id") -> DataFrame:
        """Positions move by (f_blind / f_fid - 1) times the reconstructed redshift-space shift."""
        f, fb = self.fid.get("f", self.z), self.blind.get("f", self.z)
        s = self.shifts(data, self.contrast(data, randoms, grid, radius), grid, f, row_id)
        out = data.join(s, row_id)
        return out.withColumns({f"Position_{a}": F.col(f"Position_{a}") + (fb / f - 1) * F.col(f"shift_{a}") for a in "xyz"}).drop("shift_x", "shift_y", "shift_z")

    def primordial(self, k):
        """The factor T(k) between the contrast of matter and the primordial potential, at redshift z."""
        k = np.asarray(k, float)
        growth = float(self.fid.growth_factor(np.asarray(self.z)))
        return 2 * k**2 * self.fid.transfer(k) * growth / (3 * self.fid.Omega_m * (100.0 / 299792.458) ** 2)

    def bfnl(self) -> float:
        """Response of the galaxies to the potential, times the blind fnl."""
        return 2 * CRITICAL * (self.bias - 1) * self.blind.get("fnl")

    def shot_noise_factor(self, noise, radius: float):
        """What the added field is multiplied by so that, with noise of this power, the power at a pivot scale is the one
        that is asked for: the positive root of a quadratic. noise: a number or an array.

        The contrast is smoothed twice by `radius`: for the shifts that undo redshift space, and as the field itself.
        """
        f, b, bfnl = self.fid.get("f", self.z), self.bias, self.bfnl()
        mu, k = 0.6, 4e-3 if bfnl >= 0 else 8e-3
        smooth = lambda q: np.exp(-0.5 * q**2 * radius**2)
        power, t = float(self.fid.power(k, self.z)), bfnl / float(self.primordial(k))
        q = np.geomspace(1e-5, 10.0, 4096)
        q = q[smooth(q) > 1e-4]
        variance = np.trapezoid(smooth(q) ** 2 * self.fid.power(q, self.z), q) / (6 * np.pi**2)  # of displacements along an axis
        s = float(smooth(k))
        undone = b + (1 - s) * f * mu**2
        cross = (b + f * mu**2) * undone * s * power + s * noise * np.exp(-0.5 * k**2 * mu**2 * f**2 * variance)
        own = undone**2 * s**2 * power + s**2 * noise
        asked = 2 * t * b * (b + f * mu**2) * power + t**2 * b**2 * power
        return (np.sqrt(cross**2 + own * asked) - cross) / own / t

    def noise_at(self, data: DataFrame, randoms: DataFrame | None, rows: DataFrame, grid: mesh.Grid, radius: float, row_id: str) -> DataFrame:
        """(row_id, noise): power of the shot noise at positions, from smoothed densities of weights."""
        w = F.col("Weight") if "Weight" in data.columns else F.lit(1.0)
        weighted = data.withColumns({"__w": w, "__w2": w * w})
        total = float(weighted.agg(F.sum("__w")).first()[0] or 0.0)
        d, d2 = (settled(mesh.paint(weighted, grid, weight=c), "noise") for c in ("__w", "__w2"))
        if randoms is None:
            nbar = total / grid.volume
            inverse = mesh.combine(lambda x, y: x * nbar / np.where(y == 0, 1.0, y), d, d2)
        else:
            weights = randoms.withColumn("__w", F.col("Weight") if "Weight" in randoms.columns else F.lit(1.0))
            alpha = total / float(weights.agg(F.sum("__w")).first()[0]) / grid.cell**3
            n = settled(mesh.paint(weights, grid, weight="__w"), "noise")
            inverse = mesh.combine(lambda x, y, z: x * alpha * z / np.where(y == 0, 1.0, y), d, d2, n)
        s = lambda c, kx, ky, kz: c * np.exp(-0.5 * radius**2 * (kx**2 + ky**2 + kz**2))
        smooth = mesh.c2r(mesh.map_complex(mesh.r2c(inverse, grid.n), grid, s), grid.n)
        return mesh.readout(smooth, grid, rows, row_id=row_id, name="__n").select(row_id, (1.0 / F.col("__n")).alias("noise"))

    def png(self, data: DataFrame, randoms: DataFrame | None, grid: mesh.Grid, method: str = "randoms_weights", radius: float = 30.0, row_id: str = "row_id", shotnoise: bool = False) -> DataFrame:
        """Local non-Gaussianity: bfnl / T(k) on the contrast of data whose redshift-space shifts are undone, as weights of
        data (1 + s) or randoms (1 - s), or as displaced positions of either, which keep their mean."""
        if method not in ("data_weights", "randoms_weights", "data_positions", "randoms_positions"):
            raise ValueError(f"unknown method {method}")
        if shotnoise and method.endswith("positions"):
            raise ValueError("there is no correction for shot noise when positions are displaced")
        rows = data if method.startswith("data") else randoms
        if rows is None:
            raise ValueError(f"{method} needs randoms")
        f, bfnl, t = self.fid.get("f", self.z), self.bfnl(), self.primordial
        undone = data.join(self.shifts(data, self.contrast(data, randoms, grid, radius), grid, f, row_id), row_id)
        undone = settled(undone.withColumns({f"Position_{a}": F.col(f"Position_{a}") - F.col(f"shift_{a}") for a in "xyz"}).drop("shift_x", "shift_y", "shift_z"), "real-space")

        def shape(c, kx, ky, kz):
            k = np.sqrt(kx**2 + ky**2 + kz**2)
            return np.where(k > 0, c * bfnl / t(np.where(k > 0, k, 1)), 0)

        delta_k = settled(mesh.map_complex(self.contrast(undone, randoms, grid, radius), grid, shape), "png")
        sign = 1.0 if method.startswith("data") else -1.0
        if method.endswith("weights"):
            out = rows.join(mesh.readout(mesh.c2r(delta_k, grid.n), grid, rows, row_id=row_id, name="__s"), row_id)
            factor = F.lit(1.0)
            if shotnoise:
                out = out.join(self.noise_at(data, randoms, rows, grid, radius, row_id), row_id)
                factor = numpy_column(lambda noise: self.shot_noise_factor(noise, radius))(F.col("noise"))
            w = F.col("Weight") if "Weight" in rows.columns else F.lit(1.0)
            return out.withColumn("Weight", w * (1.0 + sign * factor * F.col("__s"))).drop("__s", "noise")
        out = settled(self.gradients(rows, delta_k, grid, row_id, "__p"), "displaced")
        mean = out.agg(*[F.avg(f"__p_{a}").alias(a) for a in "xyz"]).first()
        return out.withColumns({f"Position_{a}": F.col(f"Position_{a}") + sign * (F.col(f"__p_{a}") - F.lit(mean[a])) for a in "xyz"}).drop(*[f"__p_{a}" for a in "xyz"])
