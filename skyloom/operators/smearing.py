"""Redshift errors that depend on redshift: inverse cumulative distributions tabulated in (u, z)."""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from skyloom.functions.cosmology import SPEED
from skyloom.functions.distributions import Laplace, Normal, TruncatedCauchy, TruncatedNormal
from skyloom.functions.interp import Spline, numpy_column
from skyloom.functions.rng import u01


class RedshiftSmearing:
    """cdf (dz, z) on a grid; ppf(u, z) is cubic in u and linear in z, then transformed to a redshift error."""

    def __init__(self, z, dz, cdf, transform=None, size: int = 1000):
        self.z, self.dz, self.cdf = np.asarray(z, float), np.asarray(dz, float), np.asarray(cdf, float)
        self.transform = transform
        self.u = np.linspace(0, 1, size)

    @cached_property
    def table(self) -> np.ndarray:
        """(z, u): the inverse of each node's distribution."""
        columns = []
        for k in range(len(self.z)):
            c = self.cdf[:, k]
            up = np.concatenate([[True], np.diff(c) > 1e-12])  # flat parts have no inverse
            x, y = c[up], self.dz[up]
            columns.append(np.clip(np.interp(self.u, x, y), y[0], y[-1]))
        return np.array(columns)

    @cached_property
    def splines(self) -> list[Spline]:
        return [Spline(self.u, t, 3, "clip") for t in self.table]

    def ppf(self, u, z):
        u, z = np.broadcast_arrays(np.atleast_1d(np.asarray(u, float)), np.atleast_1d(np.asarray(z, float)))
        i = np.clip(np.searchsorted(self.z, z, "right") - 1, 0, max(0, len(self.z) - 2))
        j = np.minimum(i + 1, len(self.z) - 1)
        gap = np.where(j > i, self.z[j] - self.z[i], 1.0)
        w = np.clip((z - self.z[i]) / gap, 0, 1) * (j > i)
        v = np.empty((2, *u.shape))
        for k, s in enumerate(self.splines):
            for side, at in enumerate((i, j)):
                m = at == k
                if m.any():
                    v[side][m] = np.clip(s(u[m]), self.table[k].min(), self.table[k].max())
        dz = v[0] * (1 - w) + v[1] * w
        return self.transform(z, dz) if self.transform else dz

    def column(self, row_id: Column, z: Column, seed: int = 0, uniform=u01) -> Column:
        """A draw for each row."""
        assert self.splines  # built here, once, and sent along
        return numpy_column(self.ppf)(uniform(row_id, seed, "smear"), z)

    @classmethod
    def average(cls, parts: list["RedshiftSmearing"], weights) -> "RedshiftSmearing":
        """Mixture with weights that may depend on z; all parts share nodes and grid."""
        first = parts[0]
        if any(not np.array_equal(p.z, first.z) or p.dz[0] != first.dz[0] or p.dz[-1] != first.dz[-1] for p in parts):
            raise ValueError("parts of a mixture need the same redshifts and support")
        w = np.array([np.broadcast_to(x, first.z.shape) for x in weights], float)
        return cls(first.z, first.dz, sum(p.cdf * a for p, a in zip(parts, w / w.sum(0))), first.transform)

    @classmethod
    def from_pdf(cls, z, dz, pdf, transform=None) -> "RedshiftSmearing":
        """pdf: (dz, z). Cumulated by trapezoids and scaled to 0..1."""
        dz, pdf = np.asarray(dz, float), np.asarray(pdf, float)
        step = (pdf[1:] + pdf[:-1]) / 2 * np.diff(dz)[:, None]
        c = np.vstack([np.zeros(pdf.shape[1]), np.cumsum(step, 0)])
        return cls(z, dz, c / c[-1], transform)

    @classmethod
    def from_distributions(cls, z, distributions, transform=None, dzsize: int = 10000, grid=None) -> "RedshiftSmearing":
        """One distribution a node; an infinite support is cut at the quantiles 1e-6 and 1 - 1e-6 of the widest."""
        if grid is None:
            lo = min(d.a if math.isfinite(d.a) else float(d.ppf(1e-6)) for d in distributions)
            hi = max(d.b if math.isfinite(d.b) else float(d.ppf(1 - 1e-6)) for d in distributions)
            grid = np.linspace(lo, hi, dzsize)
        c = np.array([d.cdf(grid) for d in distributions]).T
        return cls(z, grid, (c - c[0]) / (c[-1] - c[0]), transform)


#: Fits of redshift errors in km/s, as (mean z, parameters); widths of the truncation.
FITS = {
    "BGS": [(0.15745217751220622, (0.020648070838865554, -0.479595663959054, 12.6178619438766, 0.3094640225513846, 1)), (0.25662071572987527, (0.01836858932341326, -0.4957199227709448, 17.393290252516117, 0.05344961880455568, 1)), (0.35401957265814493, (13.238735144929114, -0.39949643065082435, 23.708107834479488, -0.3720220936870443, 1)), (0.4515590753972025, (20.18636841643035, -0.4511265511009661, 34.70484962054861, -0.2581318164043072, 1))],
    "ELG": [(0.8511735847340604, (6.683488995093191, -0.0045347628626179965, 12.072377665243373, 0.026368206357539392, 1)), (0.9510667104505985, (8.709350226809898, 0.1286947815691341, 15.89327031800966, 0.11842007268395063, 1)), (1.050204955239296, (12.207034302543573, 0.2720090280435801, 22.303384672906873, -0.00891173855304724, 1)), (1.1503984035984949, (11.197528942951879, 0.2873346319694507, 20.576811852801004, 0.13523285320667847, 1)), (1.249815653855852, (11.624466532865904, 0.292646949024502, 21.62585411691305, 0.47596262633818287, 1)), (1.3495956390419264, (13.536754379486247, 0.055382813630734724, 24.752803063338952, 0.2570692619990102, 1)), (1.4493230952593565, (13.7092837373788, -0.06138697113121127, 25.417487698631152, 0.056382471481945674, 1)), (1.5512681017664727, (20.647800197574462, -1.1968073816115827, 38.920808536766934, -1.293440485451026, 1))],
    "LRG": [(0.45060165849993533, (30.334376347858782, -0.3767041716384321, 54.76116515949481, -0.8310167548830771, 0)), (0.551966474295519, (40.417204760407586, -0.26220707470683985, 73.14161978553928, -0.4671489090327476, 0)), (0.6503446625109893, (55.20042442123441, -0.003039741470765826, 102.2762906953154, 0.6963527927187529, 0)), (0.7523984387097208, (59.535454523846404, -0.6049185373894962, 106.21482685434762, -0.3749249780381053, 0)), (0.8506205344501716, (66.06863429308795, 5.06960492344597, 118.06615704521735, 4.764196083422546, 0)), (0.9501854247059642, (74.48969110524028, 4.87173069350935, 135.28081336034742, 5.451180233022367, 0)), (1.0491095361561567, (79.21163480420365, 1.6881394553090503, 144.77065829163973, 3.491296982192106, 0))],
    "QSO-clustering": [(0.9658, (108.146, 0, 201.312, 0, 1)), (1.3665, (190.217, 0, 156.368, 0, 1)), (1.8320, (514.007, 0, 546.131, 0, 1)), (2.4561, (706.553, 0, 1083.65, 0, 1))],
    "QSO-sv1": [(1.00918213944318, (421255.2743769755, 0.0, 158.78914559098325, 10000.0, 0.8972426264530098)), (1.290938758251331, (261651.76778875382, 0.0, 317.5635657092603, 10000.0, 0.8646937012339042)), (1.5032103818264175, (285107.92236206745, 0.0, 566.0915548737385, 10000.0, 0.8588162755089682)), (1.7025608467694633, (253997.99446243054, 0.0, 941.4328912089015, 10000.0, 0.8516830592240989)), (1.902713895870565, (269441.2318935868, 0.0, 934.4614142626605, 10000.0, 0.8401266259712434))],
    "QSO-sv3": [(1.7002260329265209, (2497223.4530838733, 0.0, 996.508685448806, 10000.0, 0.9618815604311426)), (1.897031786765814, (2394515.05470983, 0.0, 1042.024461966914, 10000.0, 0.964534617109541)), (2.0969360912761563, (1917926.1055756428, 0.0, 1021.9225315282257, 10000.0, 0.9536552770699529)), (2.298120467315207, (1545151.9290138609, 0.0, 940.7594885087548, 10000.0, 0.9299494898854528)), (2.4935965836274208, (1154364.616870538, 0.0, 856.9521057167341, 10000.0, 0.8751876256091651)), (2.6946578909499683, (806215.1697360306, 0.0, 690.6663970306769, 10000.0, 0.8570958660540442)), (2.8945457194757394, (548679.5896564563, 0.0, 590.5081983239878, 10000.0, 0.8312555870629044)), (3.1740934036965447, (700052.3266951664, 0.0, 487.0111293872488, 10000.0, 0.8189428766816327)), (3.615560345337705, (294928.3336605119, 0.0, 374.4515706987164, 10000.0, 0.7746868970126665))],
}
TRUNCATION = {"QSO-clustering": 2000.0, "LRG": 400.0, "ELG": 150.0, "BGS": 150.0}


def tracer_fits(tracer: str, kind: str = "statistical") -> list[tuple[float, tuple]]:
    """(mean z, parameters) in order; of two surveys the later one holds from its first redshift on."""
    if tracer == "QSO" and kind == "statistical":
        late = FITS["QSO-sv3"]
        return [r for r in FITS["QSO-sv1"] if r[0] < late[0][0]] + late
    if kind == "clustering" and tracer != "QSO":
        raise ValueError(f"{tracer} has no clustering errors of its own")
    return FITS["QSO-clustering" if tracer == "QSO" else tracer]


def tracer_distributions(tracer: str, kind: str = "statistical"):
    """(z, [peaked distributions], [Gaussians], weights of the peaked ones, transform)."""
    z, peaked, gauss, weight = [], [], [], []
    for mean, v in tracer_fits(tracer, kind):
        z.append(mean)
        if tracer == "QSO" and kind == "statistical":
            _, x0, laplace, normal, la = v
            peaked.append(Laplace(x0, laplace / math.sqrt(2)))
            gauss.append(Normal(x0, normal / math.sqrt(2)))
        else:
            sigma, x0, width, mu, la = v
            t = TRUNCATION["QSO-clustering" if tracer == "QSO" else tracer]
            peaked.append(TruncatedCauchy(mu, width / 2, -t, t))
            gauss.append(TruncatedNormal(x0, sigma, -t, t))
        weight.append(la)
    power = -1 if tracer == "QSO" and kind == "statistical" else 1
    return np.array(z), peaked, gauss, np.array(weight, float), lambda z, v: v / SPEED * (1 + z) ** power


def tracer_smearing(tracer: str, kind: str = "statistical", dzsize: int = 10000) -> RedshiftSmearing:
    z, peaked, gauss, weight, transform = tracer_distributions(tracer, kind)
    both = [RedshiftSmearing.from_distributions(z, d, transform, dzsize) for d in (peaked, gauss)]
    grid = np.linspace(min(b.dz[0] for b in both), max(b.dz[-1] for b in both), dzsize)
    both = [RedshiftSmearing.from_distributions(z, d, transform, grid=grid) for d in (peaked, gauss)]
    return RedshiftSmearing.average(both, [weight, 1 - weight])


def smeared(df, z: str, tracer: str, row_id: str, seed: int = 13, kind: str = "statistical"):
    """z plus a draw of the tracer's error."""
    return df.withColumn(z, F.col(z) + tracer_smearing(tracer, kind).column(F.col(row_id), F.col(z), seed))
