"""A flat dark-energy cosmology by quadrature: distances, growth, and blinded parameters."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np

from skyloom.functions.interp import Spline

SPEED = 299792.458  # km/s
#: Other names of parameters.
ALIASES = {"w0_fld": "w0", "wa_fld": "wa"}


@dataclass(frozen=True)
class Cosmology:
    """Distances are in Mpc/h; growth follows Omega_m(z) ** 0.55."""

    Omega_m: float = 0.3
    w0: float = -1.0
    wa: float = 0.0
    h: float = 0.7
    sigma8: float = 0.8
    n_s: float = 0.96
    derived: dict = field(default_factory=dict, compare=False)

    def efunc(self, z):
        a = 1 / (1 + np.asarray(z, float))
        dark = (1 - self.Omega_m) * a ** (-3 * (1 + self.w0 + self.wa)) * np.exp(-3 * self.wa * (1 - a))
        return np.sqrt(self.Omega_m / a**3 + dark)

    def distance(self, z):
        """Comoving radial distance, by Gauss-Legendre of 64 points."""
        z = np.asarray(z, float)
        p, w = np.polynomial.legendre.leggauss(64)
        at = z[..., None] * (p + 1) / 2
        return 100 ** -1 * SPEED * z / 2 * (w / self.efunc(at)).sum(-1)

    def Omega_m_z(self, z):  # noqa: N802
        return self.Omega_m * (1 + np.asarray(z, float)) ** 3 / self.efunc(z) ** 2

    def growth_rate(self, z):
        return self.derived.get("f", None) if "f" in self.derived else self.Omega_m_z(z) ** 0.55

    def growth_factor(self, z):
        """Relative to redshift 0."""
        z = np.asarray(z, float)
        p, w = np.polynomial.legendre.leggauss(32)
        at = z[..., None] * (p + 1) / 2
        return np.exp(-(z / 2 * (w * self.Omega_m_z(at) ** 0.55 / (1 + at)).sum(-1)))

    def sigma8_z(self, z):
        return self.sigma8 * self.growth_factor(z)

    def fsigma8(self, z):
        return self.growth_rate(z) * self.sigma8_z(z)

    def transfer(self, k):
        """Zero-baryon transfer function of Bardeen, Bond, Kaiser and Szalay (1986)."""
        q = np.maximum(np.asarray(k, float), 1e-12) / (self.Omega_m * self.h)
        return np.log(1 + 2.34 * q) / (2.34 * q) * (1 + 3.89 * q + (16.1 * q) ** 2 + (5.46 * q) ** 3 + (6.71 * q) ** 4) ** -0.25

    def power(self, k, z: float = 0.0):
        """Linear power spectrum with the normalisation sigma8."""
        k = np.asarray(k, float)
        kk = np.geomspace(1e-4, 50, 2000)
        x = kk * 8
        window = 3 * (np.sin(x) - x * np.cos(x)) / x**3
        shape = kk**self.n_s * self.transfer(kk) ** 2
        var = np.trapezoid(shape * window**2 * kk**3 / (2 * np.pi**2), np.log(kk))
        out = self.sigma8**2 / var * np.maximum(k, 1e-12) ** self.n_s * self.transfer(k) ** 2 * self.growth_factor(z) ** 2
        return np.where(k > 0, out, 0.0)

    def get(self, name: str, z: float = 0.0):
        """A quantity by name: Omega_m, omega_m, sigma8, fsigma8, f, fnl, h, w0, wa, n_s; w0_fld and wa_fld are w0 and wa."""
        name = ALIASES.get(name, name)
        if name in self.derived:
            return self.derived[name]
        if name == "omega_m":
            return self.Omega_m * self.h**2
        if name == "sigma8":
            return float(self.sigma8_z(z))
        if name == "fsigma8":
            return float(self.fsigma8(z))
        if name == "f":
            return float(self.growth_rate(z))
        if name == "fnl":
            return 0.0
        return getattr(self, name)


#: Named parameter sets.
NAMED = {
    "DESI": {"Omega_m": 0.3137721026737606, "h": 0.6736, "sigma8": 0.8, "n_s": 0.9649},
    "Planck2018": {"Omega_m": 0.3111, "h": 0.6766, "sigma8": 0.8102, "n_s": 0.9665},
}


def cosmology(spec="DESI") -> Cosmology:
    """From a name, a (name, changes) pair, a dict of parameters or a Cosmology."""
    if isinstance(spec, Cosmology):
        return spec
    if isinstance(spec, str):
        return Cosmology(**NAMED[spec])
    if isinstance(spec, dict):
        return blinded(Cosmology(), {}, fixed=spec)
    name, changes = spec
    return blinded(cosmology(name), {}, fixed=changes)


def blinded(fiducial: Cosmology, spreads: dict[str, float], seed: int = 42, fixed: dict | None = None, z: float = 0.0) -> Cosmology:
    """Each parameter uniform within fiducial +- spread, in the order given; f (at redshift z) and fnl are kept apart as
    derived."""
    rng = np.random.RandomState(seed)
    values = {ALIASES.get(k, k): fiducial.get(k, z) + 2 * s * (rng.uniform() - 0.5) for k, s in spreads.items()} | {ALIASES.get(k, k): v for k, v in (fixed or {}).items()}
    own = {k: v for k, v in values.items() if k in Cosmology.__dataclass_fields__ and k != "derived"}
    return replace(fiducial, **own, derived=fiducial.derived | {k: v for k, v in values.items() if k not in own})


class DistanceToRedshift:
    """Inverse of a distance(z) function on a table of nz redshifts, 0 and then logarithmic from 1e-8 to zmax."""

    def __init__(self, distance, zmax: float = 100.0, nz: int = 2048, order: int = 3):
        z = np.concatenate([[0.0], np.geomspace(1e-8, zmax, nz)])
        self.spline = Spline(distance(z), z, order, "raise")

    def __call__(self, d):
        return self.spline(d)

    def column(self, d):
        return self.spline.column(d)
