"""Selection by probability: radial, angular, tabulated and chunk-wise masks, as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.functions import healpix
from skyloom.functions.interp import Spline, bisect
from skyloom.functions.rng import u01, u01_fast


class Mask:
    """A subclass gives prob(*columns); keep() is true where prob is at least a uniform number of the row."""

    def prob(self, *columns: Column) -> Column:
        raise NotImplementedError

    def keep(self, row_id: Column, *columns: Column, seed: int = 0, uniform=u01) -> Column:
        return self.prob(*columns) >= uniform(row_id, seed, "mask")


class MaskCollection(Mask):
    """A mask for each value of a chunk column; rows of other chunks pass."""

    def __init__(self, masks: dict):
        self.masks = masks

    def prob(self, chunk: Column, *columns: Column) -> Column:
        out = None
        for k, m in self.masks.items():
            out = (F if out is None else out).when(chunk == F.lit(k), m.prob(*columns))
        return F.lit(1.0) if out is None else out.otherwise(1.0)


class UniformRadial(Mask):
    def __init__(self, zrange=(0.0, np.inf), nbar: float = 1.0):
        self.zrange, self.nbar = zrange, float(np.clip(nbar, 0, 1))

    def prob(self, z: Column) -> Column:
        return F.when((z >= float(self.zrange[0])) & (z <= float(self.zrange[1])), self.nbar).otherwise(0.0)

    def sample(self, spark: SparkSession, size: int, distance, to_redshift, seed: int = 0) -> DataFrame:
        """(row_id, z, distance): size draws uniform in volume times the mask, without replacement of ids."""
        d0, d1 = (float(distance(np.asarray(z))) for z in self.zrange)

        def candidates(ids: DataFrame) -> DataFrame:
            d = F.cbrt(F.lit(d0**3) + F.lit(d1**3 - d0**3) * u01_fast(F.col("id"), seed, "d"))
            rows = ids.withColumn("distance", d)
            return rows.withColumn("z", to_redshift.column(F.col("distance"))).where(self.keep(F.col("id"), F.col("z"), seed=seed, uniform=u01_fast))

        return fill(spark, size, candidates, "z", "distance")


class TabulatedRadial(UniformRadial):
    """n(z) from a table, interpolated with order 1 to 3; probability is norm x nbar, at most 1."""

    def __init__(self, z=None, nbar=None, filename: str | None = None, zrange=None, order: int = 2, norm: float | None = None):
        if filename is not None:
            z, nbar = np.loadtxt(filename, unpack=True)
        self.z, self.nbar_table, self.order = np.asarray(z, float), np.asarray(nbar, float), order
        if (self.nbar_table < 0).any():
            raise ValueError("densities cannot be negative")
        self.zrange = tuple(zrange) if zrange is not None else (float(self.z[0]), float(self.z[-1]))
        if self.zrange[0] < self.z[0] - 1e-9 or self.zrange[1] > self.z[-1] + 1e-9:
            raise ValueError("the redshift range exceeds the table")
        self.norm = norm if norm is not None else 1 / self.peak()

    @property
    def inside(self) -> np.ndarray:
        """Nodes of the table in the redshift range."""
        return (self.z >= self.zrange[0]) & (self.z <= self.zrange[1])

    def peak(self) -> float:
        """Largest density in the range: of the table for order 1, else of the spline, refined from a fine grid."""
        if self.order == 1:
            return float(self.nbar_table[self.inside].max())
        s = Spline(self.z, self.nbar_table, self.order, "zeros")
        grid = np.linspace(*self.zrange, 50 * len(self.z) + 1)
        v = s(grid)
        i = int(v.argmax())
        lo, hi = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
        for _ in range(60):
            a, b = lo + (hi - lo) / 3, hi - (hi - lo) / 3
            lo, hi = (a, hi) if s(a) < s(b) else (lo, b)
        return float(max(v[i], s((lo + hi) / 2)))

    def spline(self, norm: float | None = None) -> Spline:
        return Spline(self.z, np.minimum((self.norm if norm is None else norm) * self.nbar_table, 1.0), self.order, "zeros")

    def prob(self, z: Column) -> Column:
        value = self.spline().column(z)
        return F.when((z >= float(self.zrange[0])) & (z <= float(self.zrange[1])), value).otherwise(0.0)

    def integral(self, sample: DataFrame | None = None, z: str = "z", weight: str | None = None, norm: float | None = None) -> float:
        """Mean probability over the range, or over a sample of redshifts."""
        s = self.spline(norm)
        if sample is None:
            return s.integral(*self.zrange) / (self.zrange[1] - self.zrange[0])
        w = F.col(weight) if weight else F.lit(1.0)
        inside = F.col(z).between(*map(float, self.zrange))
        p = F.when(inside, s.column(F.col(z))).otherwise(0.0)
        r = sample.agg((F.sum(w * p) / F.sum(w)).alias("m")).first()
        return float(r.m)

    def normalized(self, target: float, sample: DataFrame | None = None, z: str = "z", weight: str | None = None, bins: int = 4096) -> "TabulatedRadial":
        """The mask whose integral is target. A sample enters through one histogram of `bins` bins, not once a step."""
        if sample is None:
            value = lambda norm: self.integral(norm=norm)
        else:
            lo, hi = self.zrange
            w = F.col(weight) if weight else F.lit(1.0)
            k = F.least(F.floor((F.col(z) - float(lo)) / float(hi - lo) * bins), F.lit(bins - 1))
            rows = sample.groupBy(F.when(F.col(z).between(float(lo), float(hi)), k).alias("k")).agg(F.sum(w).alias("w"), F.sum(w * F.col(z)).alias("wz")).collect()
            total = sum(r.w for r in rows)
            at = np.array([(r.wz / r.w, r.w) for r in rows if r.k is not None and r.w])
            value = lambda norm: float((self.spline(norm)(at[:, 0]) * at[:, 1]).sum() / total) if len(at) else 0.0
        top = 1.0 / max(self.nbar_table[self.inside & (self.nbar_table > 0)].min(), 1e-300)
        if not 0 <= target <= value(top) + 1e-12:
            raise ValueError(f"no normalisation gives {target}")
        return TabulatedRadial(self.z, self.nbar_table, None, self.zrange, self.order, bisect(lambda n: value(n) - target, 0.0, top))

    def convert(self, distance_from, distance_to, z_from_distance) -> "TabulatedRadial":
        """The same objects in another cosmology: redshifts move with distance, densities with shell volume."""
        d = distance_from(self.z)
        z = z_from_distance(d)
        shell = lambda f, x: f(x) ** 2 * np.gradient(f(x), x)
        return TabulatedRadial(z, self.nbar_table * shell(distance_from, self.z) / np.maximum(shell(distance_to, self.z), 1e-300), None, None, self.order)


class UniformAngular(Mask):
    """Right ascension (wrapping when lo > hi) and declination ranges, both inclusive."""

    def __init__(self, rarange=None, decrange=None, nbar: float = 1.0):
        self.rarange = None if rarange is None else tuple(float(r) if -1e-12 < r <= 360 else float(r % 360.0) for r in rarange)
        self.decrange = None if decrange is None else tuple(map(float, decrange))
        self.nbar = float(np.clip(nbar, 0, 1))

    def inside(self, ra: Column, dec: Column) -> Column:
        out = F.lit(True)
        if self.rarange is not None:
            lo, hi = self.rarange
            ra = F.pmod(ra, F.lit(360.0)) if hi < 360 else ra
            out = (ra >= lo) & (ra <= hi) if lo <= hi else (ra >= lo) | (ra <= hi)
        if self.decrange is not None:
            out = out & (dec >= self.decrange[0]) & (dec <= self.decrange[1])
        return out

    def prob(self, ra: Column, dec: Column) -> Column:
        return F.when(self.inside(ra, dec), self.nbar).otherwise(0.0)

    def sample(self, spark: SparkSession, size: int, seed: int = 0, uniform=u01_fast) -> DataFrame:
        """(row_id, ra, dec): size draws uniform on the sphere times the mask."""
        lo, hi = self.rarange or (0.0, 360.0)
        hi = hi if hi >= lo else hi + 360.0
        s0, s1 = np.sin(np.radians(self.decrange or (-90.0, 90.0)))

        def candidates(ids: DataFrame) -> DataFrame:
            ra = F.pmod(F.lit(lo) + F.lit(hi - lo) * uniform(F.col("id"), seed, "ra"), F.lit(360.0))
            dec = F.degrees(F.asin(F.lit(float(s0)) + F.lit(float(s1 - s0)) * uniform(F.col("id"), seed, "dec")))
            rows = ids.withColumn("ra", ra).withColumn("dec", dec)
            return self.selected(rows, seed, uniform)

        return fill(spark, size, candidates, "ra", "dec")

    def selected(self, rows: DataFrame, seed: int, uniform=u01_fast) -> DataFrame:
        return rows.where(self.keep(F.col("id"), F.col("ra"), F.col("dec"), seed=seed, uniform=uniform))


def generate_redshifts(nz: DataFrame, spark: SparkSession, size: int, distance, to_redshift, zmin: float, zmax: float, seed: int = 145) -> DataFrame:
    """(row_id, z, distance): size redshifts that follow a table n(z) of counts (zmin, zmax, nz) between two redshifts."""
    rows = sorted(tuple(r) for r in nz.select("zmin", "zmax", "nz").collect())  # a row for each bin
    low, high, n = (np.array(x, float) for x in zip(*rows))
    volume = distance(high) ** 3 - distance(low) ** 3
    return TabulatedRadial((low + high) / 2, n / volume, zrange=(zmin, zmax), order=2).sample(spark, size, distance, to_redshift, seed)


class HealpixAngular(UniformAngular):
    """A density for each HEALPix pixel: a table (pix, nbar), joined by pixel (the map's size decides how)."""

    def __init__(self, table: DataFrame, nside: int, nest: bool = False, rarange=None, decrange=None):
        super().__init__(rarange, decrange)
        self.table, self.nside, self.nest = table.select(F.col("pix").cast("long").alias("pix"), F.col("nbar").cast("double").alias("map_nbar")), nside, nest

    @classmethod
    def from_array(cls, spark: SparkSession, values, nest: bool = False, **options) -> "HealpixAngular":
        nside = int(round(np.sqrt(len(values) / 12)))
        if 12 * nside**2 != len(values):
            raise ValueError("a map has 12 nside^2 pixels")
        return cls(spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pix long, nbar double"), nside, nest, **options)

    def with_prob(self, rows: DataFrame, ra: str = "ra", dec: str = "dec", name: str = "prob") -> DataFrame:
        pix = healpix.ang2pix(self.nside, F.col(ra), F.col(dec), self.nest)
        # 12 nside^2 rows: broadcast while that is small, else Spark picks the join
        table = F.broadcast(self.table) if self.nside <= 256 else self.table
        value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("map_nbar", F.lit(0.0))))
        return rows.withColumn("pix", pix).join(table, "pix", "left").withColumn(name, F.when(self.inside(F.col(ra), F.col(dec)), value).otherwise(0.0)).drop("pix", "map_nbar")

    def selected(self, rows: DataFrame, seed: int, uniform=u01_fast) -> DataFrame:
        return self.with_prob(rows, name="__p").where(F.col("__p") >= uniform(F.col("id"), seed, "mask")).drop("__p")


class PolygonAngular(UniformAngular):
    """Mangle polygons: each is the intersection of caps x, y, z, cm; a point has the weight of its polygon, else 0."""

    def __init__(self, polygons: list[tuple[float, list[tuple[float, float, float, float]]]], rarange=None, decrange=None):
        super().__init__(rarange, decrange)
        self.polygons = polygons

    @classmethod
    def from_file(cls, path: str, **options) -> "PolygonAngular":
        """Text format: 'polygon i ( n caps, weight w, ...):' and then n lines x y z cm."""
        import re

        out, caps, weight = [], None, 1.0
        for line in open(path):
            if m := re.match(r"polygon\s+\d+\s*\(\s*(\d+)\s+caps?(?:,\s*([-+.eE\d]+)\s+weight)?", line):
                caps, weight = [], float(m[2] or 1)
                out.append((weight, caps))
            elif caps is not None and len(v := line.split()) == 4:
                caps.append(tuple(map(float, v)))
        return cls(out, **options)

    def with_prob(self, rows: DataFrame, ra: str = "ra", dec: str = "dec", name: str = "prob", size: float = 4.0) -> DataFrame:
        """rows with the weight of the first polygon that holds them.

        A polygon is listed in the cells of the sky that its least cap touches, and a point looks through the polygons of
        its cell: for any number of polygons one equi-join of a row a point.
        """
        from skyloom.operators.footprint import by_cell, with_cells

        table = []
        for k, (weight, caps) in enumerate(self.polygons):
            x, y, z, cm = min((c for c in caps if c[3] >= 0), key=lambda c: c[3], default=(0.0, 0.0, 1.0, 2.0))
            reach = np.degrees(np.arccos(np.clip(1 - cm, -1, 1))) + 1e-6
            table.append((k, float(weight), [tuple(map(float, c)) for c in caps], float(np.degrees(np.arctan2(y, x)) % 360), float(np.degrees(np.arcsin(np.clip(z, -1, 1)))), float(reach)))
        schema = "id int, weight double, caps array<struct<x:double,y:double,z:double,cm:double>>, tra double, tdec double, reach double"
        polygons = rows.sparkSession.createDataFrame(table, schema)
        v = g.sky_to_cartesian(F.lit(1.0), F.col(ra), F.col(dec))

        def holds(c):
            away = F.lit(1.0) - (v[0] * c["x"] + v[1] * c["y"] + v[2] * c["z"])
            return F.when(c["cm"] >= 0, away < c["cm"]).otherwise(away > -c["cm"])

        out = with_cells(rows, by_cell(polygons, size, F.col("reach"), "id", "weight", "caps"), size, ra, dec, "__polygons")
        first = F.array_min(F.filter("__polygons", lambda p: F.forall(p["caps"], holds)))
        return out.withColumn(name, F.when(self.inside(F.col(ra), F.col(dec)), F.coalesce(first["weight"], F.lit(0.0))).otherwise(0.0)).drop("__polygons")

    def selected(self, rows: DataFrame, seed: int, uniform=u01_fast) -> DataFrame:
        return self.with_prob(rows, name="__p").where(F.col("__p") >= uniform(F.col("id"), seed, "mask")).drop("__p")

    def prob(self, ra: Column, dec: Column) -> Column:
        """As an expression, with a branch for each polygon: for a few of them; with_prob takes any number."""
        v = g.sky_to_cartesian(F.lit(1.0), ra, dec)
        out = None
        for weight, caps in self.polygons:
            inside = F.lit(True)
            for x, y, z, cm in caps:
                away = F.lit(1.0) - g.dot(v, (x, y, z))
                inside = inside & ((away < cm) if cm >= 0 else (away > -cm))
            out = (F if out is None else out).when(inside, float(weight))
        value = F.lit(0.0) if out is None else out.otherwise(0.0)
        return F.when(self.inside(ra, dec), value).otherwise(0.0)


def fill(spark: SparkSession, size: int, candidates, *columns: str) -> DataFrame:
    """The first `size` accepted candidates by id: ranges of ids grow until there are enough; no row is drawn twice."""
    from pyspark.sql import Window

    n = max(size, 1)
    for _ in range(40):
        rows = candidates(spark.range(n))
        got = rows.count()
        if got >= size:
            break
        n = int(n * min(50, max(1.2, 1.1 * size / max(got, 1)))) + 16
    if got < size:
        raise ValueError("the mask accepts too few rows")
    # cut at an id: counts by block of ids tell the block, a window inside that block tells the row
    block = F.floor(F.col("id") / 65536)
    ahead = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(block.alias("b")).agg(F.count("*").alias("n"))
    counts = counts.select("b", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("b").orderBy("id"))
    return rows.withColumn("b", block).join(counts, "b").withColumn("place", place).where(F.col("place") <= size).select((F.col("place") - 1).alias("row_id"), *columns)


def photometric_region(ra: Column, dec: Column, region: str) -> Column:
    """N, S and their parts by declination 32.375 and the galactic cuts; N+SNGC is N or the northern strip of S."""
    north, strip = dec > 32.375, (ra > 100 - dec) & (ra < 280 + dec)
    south = dec < 32.375
    regions = {"N": north, "S": south, "DN": south & strip, "SNGC": south & strip, "DS": south & (dec > -25) & ~strip, "SSGC": south & (dec > -25) & ~strip, "N+SNGC": north | (south & strip), "N+DN": north | (south & strip)}
    if region.upper() not in regions:
        raise ValueError(f"unknown region {region}")
    return regions[region.upper()]


#: Centres (ra, dec) of photometric regions.
REGION_CENTERS = {"N": (192.3, 56.0), "N+DN": (192.0, 35.0), "N+SNGC": (192.0, 35.0), "DN": (192.0, 13.0), "SNGC": (192.0, 13.0), "DS": (6.4, 5.3), "SSGC": (6.4, 5.3)}


def region_center(region: str) -> tuple[float, float]:
    if region not in REGION_CENTERS:
        raise ValueError(f"unknown region {region}")
    return REGION_CENTERS[region]


def north_or_south(dec: Column) -> Column:
    return F.when(dec > 32.375, "N").otherwise("S")


def downsample(rows: DataFrame, targets: DataFrame, region: str, row_id: str, seed: int = 0) -> DataFrame:
    """Keep in each region the fraction targets.ndata / rows (at most all), by a uniform number of the row.

    targets: (region, ndata). Counting is a partial aggregation, so a region with most rows is no hot key.
    """
    sizes = rows.groupBy(region).agg(F.count("*").alias("__n")).join(targets, region).select(region, (F.col("ndata") / F.col("__n")).alias("__f"))
    return rows.join(sizes, region).where(u01(F.col(row_id), seed, "down") < F.col("__f")).drop("__f")
