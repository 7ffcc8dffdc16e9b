"""Catalogs of particles: immutable wrappers of a DataFrame with flat vector columns <name>_x, _y, _z and metadata."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.functions.rng import u01, u01_fast
from skyloom.operators.isometry import Isometry, IsometryError, box_to_cutsky, cutsky_to_box  # noqa: F401
from skyloom.operators.masks import UniformAngular, UniformRadial
from skyloom.operators.remap import Cuboid
from skyloom.operators.scratch import once


@dataclass(frozen=True)
class ParticleCatalog:
    df: DataFrame
    position: str = "Position"
    velocity: str | None = None
    vectors: frozenset[str] = frozenset()
    invariants: frozenset[str] = frozenset()
    attrs: dict = field(default_factory=dict)
    row_id: str = "row_id"

    def __post_init__(self):
        named = {self.position} | ({self.velocity} if self.velocity else set())
        object.__setattr__(self, "vectors", frozenset(self.vectors) | named)
        object.__setattr__(self, "invariants", frozenset(self.invariants) | ({self.velocity} if self.velocity else set()))

    @classmethod
    def from_arrays(cls, spark: SparkSession, data: dict, **options):
        """From numpy arrays; (N, 3) arrays become vectors. For small inputs: data passes through the driver."""
        import pandas as pd

        flat, vectors = {}, set(options.pop("vectors", ()))
        for k, v in data.items():
            v = np.asarray(v)
            if v.ndim == 2 and v.shape[1] == 3:
                flat |= {f"{k}_{a}": v[:, i].astype(float) for i, a in enumerate(g.AXES)}
                vectors.add(k)
            else:
                flat[k] = v
        frame = pd.DataFrame(flat)
        if "row_id" not in frame:
            frame.insert(0, "row_id", np.arange(len(frame)))
        return cls(spark.createDataFrame(frame), vectors=frozenset(vectors), **options)

    @classmethod
    def from_array_columns(cls, df: DataFrame, names, **options):
        """From array<double> columns of three elements."""
        for n in names:
            df = df.select("*", *[F.element_at(n, i + 1).alias(f"{n}_{a}") for i, a in enumerate(g.AXES)]).drop(n)
        return cls(df, vectors=frozenset(names), **options)

    def vector(self, name: str | None = None):
        return g.vector(name or self.position)

    def with_vectors(self, values: dict, **changes):
        """Replace or add vectors by expressions, in one projection."""
        cols = {f"{n}_{a}": c for n, v in values.items() for a, c in zip(g.AXES, v)}
        return replace(self, df=self.df.withColumns(cols), vectors=self.vectors | set(values), **changes)

    def distance(self, name: str | None = None) -> Column:
        return g.norm(self.vector(name))

    def rsd_position(self, f=1.0, los=None):
        """Position + f x the velocity along the line of sight (None: radial); f a number or a function of distance."""
        x, v = self.vector(), self.vector(self.velocity)
        along = g.vector_projection(v, x if los is None else g.line_of_sight(los))
        k = f(self.distance()) if callable(f) else F.lit(float(f))
        return tuple(a + k * b for a, b in zip(x, along))

    def isometry(self, way: Isometry):
        if way.is_identity:
            return self
        return self.with_vectors({n: way.apply(g.vector(n), n in self.invariants) for n in sorted(self.vectors)})

    def where(self, *conditions: Column):
        out = self.df
        for c in conditions:
            out = out.where(c)
        return replace(self, df=out)

    def concatenate(self, *others):
        df = self.df
        for o in others:
            df = df.unionByName(o.df, allowMissingColumns=True)
        return replace(self, df=df)

    def drop(self, *names: str):
        return replace(self, df=self.df.drop(*names))


@dataclass(frozen=True)
class CutskyCatalog(ParticleCatalog):
    """A survey on the sky."""


@dataclass(frozen=True)
class BoxCatalog(ParticleCatalog):
    """A periodic box of given size and center."""

    boxsize: tuple = ()
    boxcenter: tuple = (0.0, 0.0, 0.0)

    def __post_init__(self):
        super().__post_init__()
        size = self.boxsize if np.size(self.boxsize) else self.attrs.get("boxsize", ())
        if not np.size(size):
            raise ValueError("a box needs a boxsize")
        object.__setattr__(self, "boxsize", tuple(map(float, g.triple(size))))
        object.__setattr__(self, "boxcenter", tuple(map(float, g.triple(self.boxcenter if np.size(self.boxcenter) else 0))))

    @property
    def global_los(self) -> np.ndarray:
        return g.line_of_sight(self.boxcenter)

    def translate(self, shift):
        s = g.triple(shift)
        center = tuple(map(float, np.add(self.boxcenter, s)))
        return replace(self.isometry(Isometry(translation=s)), boxcenter=center)

    def recenter(self):
        return self.translate(-np.array(self.boxcenter))

    def rotate(self, quarters: int, axis="x"):
        """By quarter turns, about the origin."""
        m = np.rint(g.rotation_about(axis, 90.0 * quarters))
        out = self.isometry(Isometry(m))
        return replace(out, boxsize=tuple(np.abs(m @ self.boxsize)), boxcenter=tuple(m @ np.array(self.boxcenter)))

    def remap(self, u):
        """Cuboid remapping; same center, new size."""
        cuboid = u if isinstance(u, Cuboid) else Cuboid(u, self.boxsize)
        low = np.array(self.boxcenter) - np.array(self.boxsize) / 2
        new_low = np.array(self.boxcenter) - cuboid.size / 2
        values = {}
        for n in sorted(self.vectors):
            v = g.vector(n)
            if n in self.invariants:
                values[n] = cuboid.columns(v, velocity=True)
            else:
                inside = cuboid.columns(tuple(c - F.lit(float(o)) for c, o in zip(v, low)))
                values[n] = tuple(c + F.lit(float(o)) for c, o in zip(inside, new_low))
        return replace(self.with_vectors(values), boxsize=tuple(cuboid.size))

    def remap_to_ranges(self, ranges, which: int = 0, maxint: int = 1, quarters=((1, "y"), (1, "x"))):
        """Remap to a lattice whose sizes lie in the ranges, in the order of its sizes, and turn by quarters about axes, by
        default so that the least size comes first: the depth of a survey."""
        sizes = Cuboid.lattices(self.boxsize, maxint, 1, sort=False, ranges=ranges)
        if which >= len(sizes):
            raise IsometryError(f"only {len(sizes)} lattices have sizes in {ranges}")
        out = self.remap(list(sizes.values())[which][0])
        for n, axis in quarters:
            out = out.rotate(n, axis)
        return out

    def cutsky_rsd(self, dmin: float, dmax: float, f, names=("RA", "DEC", "DISTANCE"), center=(0.0, 0.0)) -> "CutskyCatalog":
        """The whole box moved to where the largest survey up to dmax fits, with RSDPosition and its sky coordinates: redshift
        space comes before any cut in distance."""
        drange, rarange, decrange = box_to_cutsky(self.boxsize, dmax, dmin)
        ways, _, _ = self.isometries_for_cutsky(drange, np.array(rarange) + center[0], np.array(decrange) + center[1])
        cut = CutskyCatalog(self.df, self.position, self.velocity, self.vectors, self.invariants, dict(self.attrs), self.row_id).isometry(ways[0])
        cut = replace(cut, df=once(cut.df, {f"RSDPosition_{a}": c for a, c in zip(g.AXES, cut.rsd_position(f))}), vectors=cut.vectors | {"RSDPosition"})
        d, ra, dec = g.cartesian_to_sky(g.vector("RSDPosition"))
        return replace(cut, df=cut.df.withColumns(dict(zip(names, (ra, dec, d)))))

    def subbox(self, ranges=(0.0, 1.0), boxsize_unit: bool = True):
        """Rows with lo <= x < hi on each axis; plain comparisons of stored columns reach the Parquet scan."""
        r = np.array([ranges] * 3 if np.ndim(ranges) == 1 else ranges, float)
        size, low = np.array(self.boxsize), np.array(self.boxcenter) - np.array(self.boxsize) / 2
        if boxsize_unit:
            r = low[:, None] + r * size[:, None]
        keep = [c for x, (lo, hi) in zip(self.vector(), r) for c in (x >= float(lo), x < float(hi))]
        lo, hi = np.maximum(r[:, 0], low), np.minimum(r[:, 1], low + size)
        return replace(self.where(*keep), boxsize=tuple(hi - lo), boxcenter=tuple((lo + hi) / 2))

    def pad(self, factor=1.1):
        """Periodic copies around the box, up to `factor` times its size (both ends inclusive)."""
        factor, size, center = g.triple(factor), np.array(self.boxsize), np.array(self.boxcenter)
        reach = [range(-int(math.ceil((f - 1) / 2)), int(math.ceil((f - 1) / 2)) + 1) for f in factor]
        shifts = F.array(*[F.struct(*[F.lit(int(s)).alias(a) for a, s in zip(g.AXES, t)]) for t in itertools.product(*reach)])
        moved = self.df.withColumn("__s", F.explode(shifts))  # a fixed number of copies a row: no join
        out = replace(self, df=moved)
        values = {n: tuple(c + F.col(f"__s.{a}") * F.lit(float(s)) for c, a, s in zip(g.vector(n), g.AXES, size)) for n in sorted(self.vectors - self.invariants)}
        out = out.with_vectors(values)
        half = size * factor / 2
        out = out.where(*[(c >= float(o - h)) & (c <= float(o + h)) for c, o, h in zip(out.vector(), center, half)]).drop("__s")
        return replace(out, boxsize=tuple(size * factor))

    def isometries_for_cutsky(self, drange, rarange, decrange, noutput: int | None = 1, external_margin=None, internal_margin=None, cubic: bool = False):
        """Isometries that cut surveys out of the box, and the radial and angular masks of the survey.

        noutput None: as many disjoint cuts as fit. Margins not given share the slack; given ones are scaled alike to
        fill the box.
        """
        size, way = cutsky_to_box(drange, rarange, decrange)
        radial, angular = UniformRadial(drange), UniformAngular(rarange, decrange)
        box, center = np.array(self.boxsize), np.array(self.boxcenter)
        if noutput == 1:
            if (size > box + 1e-9).any():
                raise IsometryError(f"the survey needs a box of {size}")
            return [Isometry().translation(-center) + way], radial, angular
        em, im = (None if m is None else g.triple(m) for m in (external_margin, internal_margin))
        e, i = (np.zeros(3) if m is None else m for m in (em, im))
        n = np.floor((box - 2 * e + i) / (size + i) + 1e-12).astype(int)
        if (n < 1).any() or (noutput is not None and n.prod() < noutput):
            raise IsometryError(f"only {max(0, int(n.clip(0).prod()))} cuts fit")
        grids = []
        for a in range(3):
            slack = box[a] - size[a] * n[a]
            if em is None and im is None:
                ee = ii = slack / (n[a] + 1)
            else:
                ee, ii = (i[a] if em is None else e[a]), (e[a] if im is None else i[a])  # a missing one is like the other
                total = 2 * ee + (n[a] - 1) * ii
                if total > slack + 1e-9:
                    raise IsometryError(f"margins of {total} do not fit into {slack}")
                ee, ii = (ee * slack / total, ii * slack / total) if total else (slack / 2, 0.0)
            grids.append([center[a] - box[a] / 2 + ee + size[a] / 2 + m * (size[a] + ii) for m in range(n[a])])
        ways = [Isometry().translation(-np.array(c)) + way for c in itertools.product(*grids)]
        return ways[:noutput], radial, angular

    def cutsky_from_isometry(self, ways, radial=None, angular=None, names=("RA", "DEC", "Distance")):
        """Move, add sky coordinates, select. Several isometries give one catalog with a column cut_id, in one pass."""
        many = not isinstance(ways, Isometry)
        ways = list(ways) if many else [ways]
        ra, dec, dist = names
        cut = CutskyCatalog(self.df, self.position, self.velocity, self.vectors, self.invariants, dict(self.attrs), self.row_id)
        if not many or len(ways) == 1:
            cut = cut.isometry(ways[0])
            if many:
                cut = replace(cut, df=cut.df.withColumn("cut_id", F.lit(0)))
        else:
            rows = F.array(*[F.struct(F.lit(i).alias("i"), *[F.lit(float(v)).alias(f"r{j}{k}") for j, r in enumerate(w.rotation_matrix) for k, v in enumerate(r)], *[F.lit(float(v)).alias(f"t{j}") for j, v in enumerate(w.shift)]) for i, w in enumerate(ways)])
            df = cut.df.withColumn("__w", F.explode(rows)).withColumn("cut_id", F.col("__w.i"))
            values = {}
            for n in sorted(cut.vectors):
                v = g.vector(n)
                values[n] = tuple(
                    sum((F.col(f"__w.r{j}{k}") * v[k] for k in (1, 2)), F.col(f"__w.r{j}0") * v[0]) + (F.lit(0.0) if n in cut.invariants else F.col(f"__w.t{j}")) for j in range(3)
                )
            cut = replace(cut, df=df).with_vectors(values).drop("__w")
        d, r, c = g.cartesian_to_sky(cut.vector())
        if isinstance(radial, UniformRadial) and radial.nbar >= 1:  # squares first: most rows need no angles
            lo, hi = map(float, radial.zrange)
            x, y, z = cut.vector()
            cut, radial = cut.where((x * x + y * y + z * z).between(lo * lo * (1 - 1e-12), hi * hi * (1 + 1e-12))), None
            cut = replace(cut, df=once(cut.df, {dist: d, ra: r, dec: c})).where(F.col(dist).between(lo, hi))
        else:
            cut = replace(cut, df=once(cut.df, {dist: d, ra: r, dec: c}))
        if radial is not None:
            cut = cut.where(radial.keep(F.col(self.row_id), F.col(dist)))
        if angular is not None:
            cut = cut.where(angular.inside(F.col(ra), F.col(dec)) if angular.nbar >= 1 else angular.keep(F.col(self.row_id), F.col(ra), F.col(dec)))
        return cut

    def cutsky(self, drange, rarange, decrange, noutput: int | None = 1, mask_radial: bool = True, mask_angular: bool = True, **options):
        ways, radial, angular = self.isometries_for_cutsky(drange, rarange, decrange, noutput, **options)
        return self.cutsky_from_isometry(ways[0] if noutput == 1 else ways, radial if mask_radial else None, angular if mask_angular else None)


def random_box(spark: SparkSession, boxsize, boxcenter=0.0, csize: int | None = None, nbar: float | None = None, seed: int = 42, uniform=u01_fast) -> BoxCatalog:
    """csize rows, or nbar rows a unit of volume, uniform in a box; uniform: u01 gives numbers that any engine can repeat."""
    size, center = g.triple(boxsize), g.triple(boxcenter)
    if csize is None:
        csize = int(nbar * size.prod() + 0.5)
    rows = spark.range(csize).withColumnRenamed("id", "row_id")
    cols = {f"Position_{a}": (uniform(F.col("row_id"), seed, a) - 0.5) * float(s) + float(c) for a, s, c in zip(g.AXES, size, center)}
    return BoxCatalog(rows.withColumns(cols), boxsize=tuple(size), boxcenter=tuple(center), attrs={"seed": seed})


def box_of(df: DataFrame, row_id: str, boxsize, boxcenter=0.0, seed: int = 42, uniform=u01, velocity: float | None = None, digits: int = 6) -> BoxCatalog:
    """A uniform box with one particle for each row of a table, keyed by its id."""
    size, center = g.triple(boxsize), g.triple(boxcenter)
    rows = df.select(F.col(row_id).cast("long").alias("row_id"))
    cols = {f"Position_{a}": F.round((uniform(F.col("row_id"), seed, a) - 0.5) * float(s) + float(c), digits) for a, s, c in zip(g.AXES, size, center)}
    if velocity is not None:
        cols |= {f"Velocity_{a}": F.round((uniform(F.col("row_id"), seed, "v" + a) - 0.5) * float(velocity), digits) for a in g.AXES}
    return BoxCatalog(once(rows, cols), velocity="Velocity" if velocity is not None else None, boxsize=tuple(size), boxcenter=tuple(center), attrs={"seed": seed})


def random_cutsky(spark: SparkSession, rarange, decrange, drange=None, csize: int | None = None, nbar: float | None = None, seed: int = 42, position: str = "Position", uniform=u01_fast) -> CutskyCatalog:
    """csize rows, or nbar rows a square degree, uniform on the sky and in volume between distances."""
    area = g.radec_area(rarange, decrange)
    if csize is None:
        csize = int(nbar * area + 0.5)
    lo, hi = rarange
    hi = hi if hi >= lo else hi + 360.0
    s0, s1 = np.sin(np.radians(decrange))
    i = F.col("row_id")
    ra = F.pmod(F.lit(float(lo)) + F.lit(float(hi - lo)) * uniform(i, seed, "ra"), F.lit(360.0))
    dec = F.degrees(F.asin(F.lit(float(s0)) + F.lit(float(s1 - s0)) * uniform(i, seed, "dec")))
    d = F.lit(1.0) if drange is None else F.cbrt(F.lit(float(drange[0]) ** 3) + F.lit(float(drange[1]) ** 3 - float(drange[0]) ** 3) * uniform(i, seed, "d"))
    rows = spark.range(csize).withColumnRenamed("id", "row_id").withColumns({"RA": ra, "DEC": dec, "Distance": d})
    xyz = g.sky_to_cartesian(F.col("Distance"), F.col("RA"), F.col("DEC"))
    return CutskyCatalog(rows.withColumns({f"{position}_{a}": c for a, c in zip(g.AXES, xyz)}), position=position, attrs={"seed": seed, "area": area})
