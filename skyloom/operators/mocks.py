"""Gaussian, lognormal and Zel'dovich mock catalogs from a power spectrum."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.operators import mesh
from skyloom.operators.catalog import BoxCatalog
from skyloom.operators.mesh import Grid, grid_of
from skyloom.operators.scratch import settled


def _takes_mu(power) -> bool:
    import inspect

    try:
        return len([p for p in inspect.signature(power).parameters.values() if p.default is p.empty]) > 1
    except (TypeError, ValueError):
        return False


def centered(grid: Grid, x, y, z):
    """Positions in space from coordinates on the grid."""
    return [np.mod(c, grid.boxsize) + o - grid.boxsize / 2 for c, o in zip((x, y, z), grid.boxcenter)]


def sky(grid: Grid, x, y, z):
    """Distance, right ascension and declination from coordinates on the grid."""
    a, b, c = np.broadcast_arrays(*centered(grid, x, y, z))
    d = np.sqrt(a * a + b * b + c * c)
    return d, np.degrees(np.arctan2(b, a)) % 360.0, np.degrees(np.arcsin(np.divide(c, d, out=np.zeros_like(d), where=d > 0)))


@dataclass(frozen=True)
class GaussianMock:
    """Fields of a mock. delta_k is the density contrast; delta its real, biased form; nbar a density or a field."""

    spark: SparkSession
    grid: Grid
    los: tuple | None = None
    delta_k: DataFrame | None = None
    delta: DataFrame | None = None
    nbar: object = None
    fields: dict = field(default_factory=dict)
    attrs: dict = field(default_factory=dict)

    @classmethod
    def from_power(cls, spark, power, nmesh=None, boxsize=None, cellsize=None, boxcenter=0.0, los=None, seed: int = 42, unitary: bool = False, inverted: bool = False):
        """delta_k = w sqrt(P / V) with white noise w; power(k) or power(k, mu). unitary: amplitudes of w are 1."""
        grid = grid_of(nmesh, boxsize, cellsize, boxcenter)
        n, v = grid.n, None if los is None else g.line_of_sight(los)
        noise = mesh.r2c(mesh.white_noise(spark, grid, seed), n)
        with_mu = v is not None and _takes_mu(power)

        def shape(c, kx, ky, kz):
            k = np.sqrt(kx**2 + ky**2 + kz**2)
            w = c * n**1.5
            if unitary:
                a = np.abs(w)
                w = np.where(a > 0, w / np.where(a > 0, a, 1), 1.0)
            kk = np.where(k > 0, k, 1.0)
            p = power(kk, (kx * v[0] + ky * v[1] + kz * v[2]) / kk) if with_mu else power(kk)
            return np.where(k > 0, w * np.sqrt(p / grid.volume), 0.0) * (-1 if inverted else 1)

        return cls(spark, grid, None if v is None else tuple(v), settled(mesh.map_complex(noise, grid, shape), "delta-k"), attrs={"seed": seed})

    @classmethod
    def from_field(cls, spark, delta: DataFrame, grid: Grid, los=None, complex_field: bool = True):
        return cls(spark, grid, None if los is None else tuple(g.line_of_sight(los)), delta if complex_field else mesh.r2c(delta, grid.n))

    def with_real(self, bias=None, lognormal: bool = False):
        """Inverse transform; bias a number or f(delta, distance); lognormal: exp, over its mean, minus 1."""
        grid = self.grid
        real = mesh.c2r(self.delta_k, grid.n)
        if bias is not None or lognormal:
            def change(v, x, y, z):
                if callable(bias):
                    v = bias(v, sky(grid, x, y, z)[0])
                elif bias is not None:
                    v = bias * v
                return np.exp(v) if lognormal else v

            real = mesh.map_real(real, grid, change)
        real = settled(real, "delta")
        if lognormal:
            m = mesh.mean(real)
            real = real.select("ix", F.transform("v", lambda x: x / F.lit(m) - 1.0).alias("v"))
        return replace(self, delta=real)

    def with_selection(self, nbar, interlacing: int | bool = False):
        """nbar: a number, or f(distance, ra, dec) on the nodes; interlacing averages so many shifted grids in Fourier space
        (True and 1 mean 2)."""
        if not callable(nbar):
            return replace(self, nbar=float(nbar), attrs=self.attrs | {"norm": float(nbar) ** 2 * self.grid.volume})
        grid, n, h = self.grid, self.grid.n, self.grid.cell
        steps = range(max(2, int(interlacing))) if interlacing else [0]
        total = None
        for s in steps:
            shift = s / len(steps) * h
            made = mesh.map_real(mesh.make_real(self.spark, grid, lambda i, gr: np.zeros((gr.n, gr.n))), grid, lambda v, x, y, z, d=shift: nbar(*sky(grid, x + d, y + d, z + d)))
            if len(steps) > 1:
                made = mesh.map_complex(mesh.r2c(made, n), self.grid, lambda c, kx, ky, kz, d=shift: c * np.exp(-1j * (kx + ky + kz) * d) / len(steps))
                made = mesh.c2r(made, n)
            total = made if total is None else mesh.combine(lambda a, b: a + b, total, made)
        total = settled(total, "nbar")
        norm = float(total.select(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("s")).agg(F.sum("s")).first()[0]) * h**3
        return replace(self, nbar=total, attrs=self.attrs | {"norm": norm})

    def with_white_noise(self, nbar: float, seed: int = 43):
        """Shot noise: normal of variance 1 / (nbar cell volume)."""
        k = 1 / np.sqrt(nbar * self.grid.cell**3)
        noise = mesh.white_noise(self.spark, self.grid, seed)
        return replace(self, delta=mesh.combine(lambda a, b: a + k * b, self.delta, noise), attrs=self.attrs | {"shotnoise": 1 / nbar})

    def _nbar(self) -> DataFrame | float:
        if self.nbar is None:
            raise ValueError("give a selection function first")
        return self.nbar

    def galaxies(self) -> DataFrame:
        """The field (1 + delta) nbar."""
        n = self._nbar()
        if isinstance(n, float):
            return self.delta.select("ix", F.transform("v", lambda x: (x + 1.0) * F.lit(n)).alias("v"))
        return mesh.combine(lambda a, b: (1 + a) * b, self.delta, n)

    def poisson_sample(self, seed: int = 44) -> DataFrame:
        """row_id, Position: Poisson counts of mean (1 + delta) nbar dv (not under 0), uniform inside the cells.

        Numbers depend on the seed and the slab, not on the partitioning.
        """
        grid = self.grid
        low = [c - grid.boxsize / 2 for c in grid.boxcenter]

        def draw(frames):
            for p in frames:
                for i, v in zip(p.ix, p.v):
                    r = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 1, int(i)]))
                    counts = r.poisson(np.maximum(np.asarray(v), 0) * grid.cell**3)
                    cell = np.repeat(np.arange(len(counts)), counts)
                    u = r.random((len(cell), 3)) * grid.cell
                    xyz = np.stack([np.full(len(cell), i), cell // grid.n, cell % grid.n], 1) * grid.cell + u + low
                    yield pd.DataFrame({"row_id": (np.int64(i) << 32) + np.arange(len(cell)), **{f"Position_{a}": xyz[:, j] for j, a in enumerate("xyz")}})

        return self.galaxies().mapInPandas(draw, "row_id long, Position_x double, Position_y double, Position_z double")

    def field(self, name: str) -> DataFrame:
        return {"delta": self.delta, "nbar": self.nbar}.get(name) if name in ("delta", "nbar") else self.fields[name]

    def readout(self, rows: DataFrame, name="delta", resampler: str = "cic", compensate: bool = False) -> DataFrame:
        """(row_id, value) of a field, by name or as a table, at positions."""
        f = self.field(name) if isinstance(name, str) else name
        if compensate:
            f = mesh.c2r(mesh.compensate(mesh.r2c(f, self.grid.n), self.grid, resampler), self.grid.n)
        return mesh.readout(f, self.grid, rows, resampler)

    def to_catalog(self, rows: DataFrame | None = None, seed: int = 44) -> BoxCatalog:
        rows = settled(self.poisson_sample(seed), "sample") if rows is None else rows
        return BoxCatalog(rows, boxsize=(self.grid.boxsize,) * 3, boxcenter=self.grid.boxcenter, attrs=dict(self.attrs))


class EulerianMock(GaussianMock):
    def with_rsd(self, f: float, los=None):
        """Linear redshift space: along a fixed direction delta_k (1 + f mu^2); else the sum over pairs of axes of
        x_i x_j / r^2 times the transform of k_i k_j / k^2 delta_k, in real space. The unbiased delta_k moves."""
        grid, n = self.grid, self.grid.n
        v = self.los if los is None else tuple(g.line_of_sight(los))
        if v is not None:
            def plane(c, kx, ky, kz):
                k2 = kx**2 + ky**2 + kz**2
                mu2 = (kx * v[0] + ky * v[1] + kz * v[2]) ** 2 / np.where(k2 > 0, k2, 1)
                return np.where(k2 > 0, c * mu2 * f, 0)

            extra = mesh.c2r(mesh.map_complex(self.delta_k, grid, plane), n)
            return replace(self, delta=mesh.combine(lambda a, b: a + b, self.delta, extra))
        out = self.delta
        nyquist = np.pi / grid.cell * (1 - 1e-9)
        for i in range(3):
            for j in range(i, 3):
                def pair(c, kx, ky, kz, i=i, j=j):
                    ks = (kx, ky, kz)
                    k2 = kx**2 + ky**2 + kz**2
                    keep = (k2 > 0) & ((i == j) | (np.abs(ks[i]) < nyquist) & (np.abs(ks[j]) < nyquist))
                    return np.where(keep, c * ks[i] * ks[j] / np.where(k2 > 0, k2, 1), 0)

                term = mesh.c2r(mesh.map_complex(self.delta_k, grid, pair), n)

                def weigh(t, x, y, z, i=i, j=j):
                    p = np.broadcast_arrays(*centered(grid, x, y, z))
                    r2 = sum(a * a for a in p)
                    return (1 if i == j else 2) * f * t * p[i] * p[j] / np.where(r2 > 0, r2, 1)

                out = mesh.combine(lambda a, b: a + b, out, mesh.map_real(term, grid, weigh))
        return replace(self, delta=settled(out, "delta"))


class LagrangianMock(GaussianMock):
    def with_real(self, bias=None, lognormal: bool = False):
        """Also the displacements psi_i: the transforms of i k_i / k^2 delta_k, the Nyquist plane of axis i left out."""
        out = GaussianMock.with_real(self, bias, lognormal)
        grid, nyquist = self.grid, np.pi / self.grid.cell * (1 - 1e-9)
        fields = {}
        for a in range(3):
            def move(c, kx, ky, kz, a=a):
                ks = (kx, ky, kz)
                k2 = kx**2 + ky**2 + kz**2
                return np.where((k2 > 0) & (np.abs(ks[a]) < nyquist), 1j * ks[a] / np.where(k2 > 0, k2, 1) * c, 0)

            fields[f"disp_{'xyz'[a]}"] = settled(mesh.c2r(mesh.map_complex(self.delta_k, grid, move), grid.n), "disp")
        return replace(out, fields=self.fields | fields)

    def poisson_sample(self, seed: int = 44, resampler: str = "cic") -> DataFrame:
        """Also Displacement; Position is moved by it and wrapped into the box."""
        rows = settled(GaussianMock.poisson_sample(self, seed), "sample")
        out = rows.join(mesh.readout_many({f"Displacement_{a}": self.fields[f"disp_{a}"] for a in "xyz"}, self.grid, rows, resampler), "row_id")
        low = [c - self.grid.boxsize / 2 for c in self.grid.boxcenter]
        moved = {f"Position_{a}": F.pmod(F.col(f"Position_{a}") + F.col(f"Displacement_{a}") - F.lit(o), F.lit(self.grid.boxsize)) + F.lit(o) for a, o in zip("xyz", low)}
        return out.withColumns(moved)

    def with_rsd(self, rows: DataFrame, f, los=None) -> DataFrame:
        """rows with Position + f x the displacement along the line of sight."""
        cat = BoxCatalog(rows, velocity="Displacement", boxsize=(self.grid.boxsize,) * 3, boxcenter=self.grid.boxcenter)
        return cat.with_vectors({"Position": cat.rsd_position(f, los if los is not None else self.los)}).df

    def to_catalog(self, rows: DataFrame | None = None, seed: int = 44) -> BoxCatalog:
        rows = settled(self.poisson_sample(seed), "sample") if rows is None else rows
        return BoxCatalog(rows, velocity="Displacement", boxsize=(self.grid.boxsize,) * 3, boxcenter=self.grid.boxcenter, attrs=dict(self.attrs))
