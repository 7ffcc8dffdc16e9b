"""Fields on regular grids as tables of slabs, and their Fourier transforms.

Real fields: (ix, v) with v the slab's values, y then z. Complex fields: (iy, re, im), transposed, with kx then kz
(half of it, by Hermitian symmetry). A transform is one pass over slabs, one exchange by the other axis, and one pass
over those; no task holds more than a slab.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REAL = "ix int, v array<double>"
COMPLEX = "iy int, re array<double>, im array<double>"


@dataclass(frozen=True)
class Grid:
    n: int
    boxsize: float
    boxcenter: tuple = (0.0, 0.0, 0.0)

    @property
    def cell(self) -> float:
        return self.boxsize / self.n

    @property
    def volume(self) -> float:
        return self.boxsize**3

    def k(self) -> np.ndarray:
        return 2 * np.pi / self.boxsize * np.fft.fftfreq(self.n, 1 / self.n)

    def kz(self) -> np.ndarray:
        return 2 * np.pi / self.boxsize * np.arange(self.n // 2 + 1)

    def coordinates(self) -> np.ndarray:
        """Of the grid nodes along an axis, from 0."""
        return np.arange(self.n) * self.cell


def grid_of(nmesh=None, boxsize=None, cellsize=None, boxcenter=0.0) -> Grid:
    """Two of number, size and cell size give the third."""
    if boxsize is None:
        boxsize = nmesh * cellsize
    if nmesh is None:
        nmesh = int(round(boxsize / cellsize))
    return Grid(int(nmesh), float(boxsize), tuple(map(float, np.ones(3) * boxcenter)))


def real_from_array(spark: SparkSession, a) -> DataFrame:
    """A small array through the driver."""
    a = np.asarray(a, float)
    return spark.createDataFrame([(i, s.ravel().tolist()) for i, s in enumerate(a)], REAL)


def real_to_array(field: DataFrame, n: int) -> np.ndarray:
    rows = sorted(field.collect(), key=lambda r: r.ix)
    return np.array([r.v for r in rows]).reshape(n, n, n)


def complex_to_array(field: DataFrame, n: int) -> np.ndarray:
    rows = sorted(field.collect(), key=lambda r: r.iy)
    c = np.array([np.array(r.re) + 1j * np.array(r.im) for r in rows]).reshape(n, n, n // 2 + 1)
    return c.transpose(1, 0, 2)


def complex_from_array(spark: SparkSession, a) -> DataFrame:
    """Half (n, n, n/2+1) or full (n, n, n) Hermitian arrays."""
    a = np.asarray(a)
    a = a[:, :, : a.shape[0] // 2 + 1]
    return spark.createDataFrame([(i, a[:, i].real.ravel().tolist(), a[:, i].imag.ravel().tolist()) for i in range(a.shape[1])], COMPLEX)


def slabs(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n, numPartitions=min(n, spark.sparkContext.defaultParallelism * 4)).select(F.col("id").cast("int").alias("ix"))


def make_real(spark: SparkSession, grid: Grid, f) -> DataFrame:
    """f(ix, grid) -> (n, n) values."""

    def run(frames):
        for p in frames:
            yield pd.DataFrame({"ix": p.ix, "v": [np.asarray(f(int(i), grid), float).ravel() for i in p.ix]})

    return slabs(spark, grid.n).mapInPandas(run, REAL)


def map_real(field: DataFrame, grid: Grid, f) -> DataFrame:
    """f(values (n, n), x, y, z of the nodes from 0) -> values, slab by slab."""
    c = grid.coordinates()

    def run(frames):
        for p in frames:
            out = [np.asarray(f(np.asarray(v).reshape(grid.n, grid.n), c[i], c[:, None], c[None, :]), float).ravel() for i, v in zip(p.ix, p.v)]
            yield pd.DataFrame({"ix": p.ix, "v": out})

    return field.mapInPandas(run, REAL)


def map_complex(field: DataFrame, grid: Grid, f) -> DataFrame:
    """f(values (n, n/2+1), kx, ky, kz) -> values; ky is a number."""
    k, kz = grid.k(), grid.kz()

    def run(frames):
        for p in frames:
            out = []
            for i, re, im in zip(p.iy, p.re, p.im):
                c = (np.asarray(re) + 1j * np.asarray(im)).reshape(grid.n, -1)
                out.append(np.asarray(f(c, k[:, None], k[i], kz[None, :])).ravel())
            yield pd.DataFrame({"iy": p.iy, "re": [c.real.astype(float) for c in out], "im": [c.imag.astype(float) for c in out]})

    return field.mapInPandas(run, COMPLEX)


def combine(op, *fields: DataFrame) -> DataFrame:
    """Element by element over real fields of the same grid: op takes arrays."""
    out, size = fields[0].withColumnRenamed("v", "v0"), len(fields)
    for i, f in enumerate(fields[1:], 1):
        out = out.join(f.withColumnRenamed("v", f"v{i}"), "ix")

    def run(frames):
        for p in frames:
            cols = [p[f"v{i}"] for i in range(size)]
            yield pd.DataFrame({"ix": p.ix, "v": [np.asarray(op(*map(np.asarray, row)), float) for row in zip(*cols)]})

    return out.mapInPandas(run, REAL)


def r2c(field: DataFrame, n: int) -> DataFrame:
    """Forward transform, divided by the number of cells."""

    def first(frames):
        for p in frames:
            for i, v in zip(p.ix, p.v):
                c = np.fft.rfft2(np.asarray(v).reshape(n, n))
                yield pd.DataFrame({"iy": np.arange(n, dtype=np.int32), "ix": np.full(n, i, np.int32), "re": list(c.real.copy()), "im": list(c.imag.copy())})

    def second(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("ix")
        c = np.fft.fft(np.stack(p.re.to_numpy()) + 1j * np.stack(p.im.to_numpy()), axis=0) / n**3
        return pd.DataFrame({"iy": [p.iy.iloc[0]], "re": [c.real.ravel()], "im": [c.imag.ravel()]})

    return field.mapInPandas(first, "iy int, ix int, re array<double>, im array<double>").groupBy("iy").applyInPandas(second, COMPLEX)


def c2r(field: DataFrame, n: int) -> DataFrame:
    """Inverse of r2c."""

    def first(frames):
        for p in frames:
            for i, re, im in zip(p.iy, p.re, p.im):
                c = np.fft.ifft((np.asarray(re) + 1j * np.asarray(im)).reshape(n, -1), axis=0) * n
                yield pd.DataFrame({"ix": np.arange(n, dtype=np.int32), "iy": np.full(n, i, np.int32), "re": list(c.real.copy()), "im": list(c.imag.copy())})

    def second(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("iy")
        c = np.stack(p.re.to_numpy()) + 1j * np.stack(p.im.to_numpy())
        return pd.DataFrame({"ix": [p.ix.iloc[0]], "v": [(np.fft.irfft2(c, s=(n, n)) * n**2).ravel()]})

    return field.mapInPandas(first, "ix int, iy int, re array<double>, im array<double>").groupBy("ix").applyInPandas(second, REAL)


ORDERS = {"nnb": 1, "ngp": 1, "cic": 2, "tsc": 3, "pcs": 4}


def window(k, cell: float, resampler: str):
    """Fourier transform of a resampler along one axis."""
    return np.sinc(k * cell / (2 * np.pi)) ** ORDERS[resampler]


def compensate(field: DataFrame, grid: Grid, resampler: str) -> DataFrame:
    return map_complex(field, grid, lambda c, kx, ky, kz: c / (window(kx, grid.cell, resampler) * window(ky, grid.cell, resampler) * window(kz, grid.cell, resampler)))


def white_noise(spark: SparkSession, grid: Grid, seed: int = 42) -> DataFrame:
    """Normal numbers of variance 1 on the nodes; a slab's numbers depend on seed and slab alone."""

    def run(ix, g):
        r = np.random.Generator(np.random.Philox(key=seed, counter=[0, 0, 0, ix]))
        return r.standard_normal((g.n, g.n))

    return make_real(spark, grid, run)


def stencil(x: Column, n: int, resampler: str) -> list[tuple[Column, Column]]:
    """(index, weight) pairs along an axis for a coordinate in cells."""
    near = F.floor(x + 0.5) if resampler == "nnb" else None
    if resampler in ("nnb", "ngp"):
        i = near if near is not None else F.floor(x)
        return [(F.pmod(i.cast("int"), F.lit(n)), F.lit(1.0))]
    if resampler == "cic":
        i = F.floor(x)
        d = x - i
        parts = [(i, 1 - d), (i + 1, d)]
    elif resampler == "tsc":
        i = F.floor(x + 0.5)
        d = x - i
        parts = [(i - 1, 0.5 * (0.5 - d) * (0.5 - d)), (i, 0.75 - d * d), (i + 1, 0.5 * (0.5 + d) * (0.5 + d))]
    elif resampler == "pcs":
        i = F.floor(x)
        d = x - i
        e = 1 - d
        parts = [(i - 1, e * e * e / 6), (i, (4 - 6 * d * d + 3 * d * d * d) / 6), (i + 1, (4 - 6 * e * e + 3 * e * e * e) / 6), (i + 2, d * d * d / 6)]
    else:
        raise ValueError(f"unknown resampler {resampler}")
    return [(F.pmod(a.cast("int"), F.lit(n)), w) for a, w in parts]


def _pairs(parts) -> Column:
    return F.array(*[F.struct(i.cast("int").alias("i"), w.cast("double").alias("w")) for i, w in parts])


def _cells(rows: DataFrame, grid: Grid, position: str):
    low = [c - grid.boxsize / 2 for c in grid.boxcenter]
    return [(F.col(f"{position}_{a}") - F.lit(o)) / grid.cell for a, o in zip("xyz", low)]


#: Nodes around a coordinate that a resampler reads: the first, relative to the node below it (or the nearest), and how many.
REACH = {"nnb": (0, 1), "ngp": (0, 1), "cic": (0, 2), "tsc": (-1, 3), "pcs": (-1, 4)}
#: Rows of a slab that are read out together.
READ_ROWS = 250_000


def weights(x: np.ndarray, resampler: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Lowest node and the weights of the nodes from it on, for coordinates in cells."""
    i = np.floor(x + 0.5 if resampler in ("nnb", "tsc") else x).astype(np.int64)
    d = x - i
    e = 1 - d
    w = {
        "nnb": lambda: [np.ones_like(x)], "ngp": lambda: [np.ones_like(x)], "cic": lambda: [e, d], "tsc": lambda: [0.5 * (0.5 - d) ** 2, 0.75 - d * d, 0.5 * (0.5 + d) ** 2],
        "pcs": lambda: [e**3 / 6, (4 - 6 * d * d + 3 * d**3) / 6, (4 - 6 * e * e + 3 * e**3) / 6, d**3 / 6],
    }
    return i + REACH[resampler][0], w[resampler]()


def readout_many(fields: dict[str, DataFrame], grid: Grid, rows: DataFrame, resampler: str = "cic", position: str = "Position", row_id: str = "row_id") -> DataFrame:
    """(row_id, a column for each field): fields at positions.

    Rows move once, to the slab they lie in, and meet the slabs that their stencils reach; a slab with many rows is several
    tasks. No task holds more than the slabs of a stencil and READ_ROWS rows on average.
    """
    if resampler not in REACH:
        raise ValueError(f"unknown resampler {resampler}")
    n, (low, width) = grid.n, REACH[resampler]
    names = list(fields)
    table = None
    for i, f in enumerate(fields.values()):
        f = f.select("ix", F.col("v").alias(f"v{i}"))
        table = f if table is None else table.join(f, "ix")
    x, y, z = _cells(rows, grid, position)
    slab = F.pmod(F.floor(x + 0.5 if resampler in ("nnb", "tsc") else x).cast("int"), F.lit(n))
    r = rows.select(F.col(row_id).alias("id"), slab.alias("slab"), x.alias("x"), y.alias("y"), z.alias("z"))
    blocks = F.broadcast(r.groupBy("slab").agg(F.ceil(F.count("*") / READ_ROWS).cast("int").alias("blocks")))  # a row for each slab at most
    r = r.join(blocks, "slab").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
    halo = table.withColumn("at", F.explode(F.array(*[F.lit(k) for k in range(width)]))).withColumn("slab", F.pmod(F.col("ix") - F.col("at") - low, F.lit(n)).cast("int")).drop("ix")
    halo = halo.join(blocks, "slab").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def read(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        (_, wx), (iy, wy), (iz, wz) = (weights(p[c].to_numpy(float), resampler) for c in "xyz")
        out = {"id": p.id}
        q = q.sort_values("at")
        for i, name in enumerate(names):
            value = np.zeros(len(p))
            for v, a in zip(q[f"v{i}"], wx):
                v = np.asarray(v)
                for j, b in enumerate(wy):
                    for k, c in enumerate(wz):
                        value += a * b * c * v[(iy + j) % n * n + (iz + k) % n]
            out[name] = value
        return pd.DataFrame(out)

    kind = dict(rows.dtypes)[row_id]
    got = r.groupBy("slab", "block").cogroup(halo.groupBy("slab", "block")).applyInPandas(read, f"id {kind}, " + ", ".join(f"`{m}` double" for m in names))
    return got.withColumnRenamed("id", row_id)


def readout(field: DataFrame, grid: Grid, rows: DataFrame, resampler: str = "cic", position: str = "Position", row_id: str = "row_id", name: str = "value") -> DataFrame:
    """(row_id, value): the field at positions."""
    return readout_many({name: field}, grid, rows, resampler, position, row_id)


def paint(rows: DataFrame, grid: Grid, resampler: str = "cic", position: str = "Position", weight: str | None = None) -> DataFrame:
    """Sums of weights on the nodes: a native aggregation by node, then slabs."""
    x, y, z = (_pairs(stencil(c, grid.n, resampler)) for c in _cells(rows, grid, position))
    w = F.col(weight) if weight else F.lit(1.0)
    r = rows.select(w.alias("m"), F.explode(x).alias("x"), y.alias("y"), z.alias("z")).select("m", "x", F.explode("y").alias("y"), "z").select("m", "x", "y", F.explode("z").alias("z"))
    node = F.col("y.i") * F.lit(grid.n) + F.col("z.i")
    sums = r.groupBy(F.col("x.i").alias("ix"), node.alias("node")).agg(F.sum(F.col("m") * F.col("x.w") * F.col("y.w") * F.col("z.w")).alias("s"))
    empty = slabs(rows.sparkSession, grid.n).select("ix", F.lit(None).cast("int").alias("node"), F.lit(None).cast("double").alias("s"))
    n = grid.n

    def slab(p: pd.DataFrame) -> pd.DataFrame:
        v = np.zeros(n * n)
        q = p.dropna()
        v[q.node.astype(int)] = q.s
        return pd.DataFrame({"ix": [p.ix.iloc[0]], "v": [v]})

    return sums.unionByName(empty).groupBy("ix").applyInPandas(slab, REAL)


def mean(field: DataFrame) -> float:
    return float(field.select(F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("s"), F.size("v").alias("n")).agg(F.sum("s") / F.sum("n")).first()[0])


def moments(field: DataFrame) -> DataFrame:
    """One row: cells, mean and variance."""
    e = field.select(F.size("v").alias("n"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("s"), F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("q"))
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    return e.agg(n.alias("cells"), (s / n).alias("mean"), (q / n - (s / n) * (s / n)).alias("variance"))


def power_spectrum(field: DataFrame, grid: Grid, edges) -> DataFrame:
    """(bin, k, power, modes) of a complex field, each mode and its mirror counted."""
    k, kz, e = grid.k(), grid.kz(), np.asarray(edges, float)
    n, volume = grid.n, grid.volume

    def run(frames):
        for p in frames:
            for i, re, im in zip(p.iy, p.re, p.im):
                c2 = (np.asarray(re) ** 2 + np.asarray(im) ** 2).reshape(n, -1) * volume
                kk = np.sqrt(k[:, None] ** 2 + k[i] ** 2 + kz[None, :] ** 2)
                w = np.broadcast_to(np.where((kz == 0) | (np.arange(len(kz)) == n / 2), 1.0, 2.0)[None], kk.shape)
                b = np.searchsorted(e, kk.ravel(), "right") - 1
                ok = (b >= 0) & (b < len(e) - 1)
                s = [np.bincount(b[ok], (a * w).ravel()[ok], len(e) - 1) for a in (np.ones_like(kk), kk, c2)]
                yield pd.DataFrame({"bin": np.arange(len(e) - 1, dtype=np.int32), "m": s[0], "k": s[1], "p": s[2]})

    return field.mapInPandas(run, "bin int, m double, k double, p double").groupBy("bin").agg((F.sum("k") / F.sum("m")).alias("k"), (F.sum("p") / F.sum("m")).alias("power"), F.sum("m").alias("modes"))
