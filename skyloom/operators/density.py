"""Weighted histograms of redshift, n(z) interpolation, effective redshift, and collective statistics."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.functions.interp import Spline
from skyloom.operators.scratch import settled


def weighted_variance(x: Column, w: Column) -> Column:
    """Variance with reliability weights and one degree of freedom: V1 / (V1^2 - V2) sum w (x - mean)^2."""
    v1, v2 = F.sum(w), F.sum(w * w)
    return (F.sum(w * x * x) - F.sum(w * x) * F.sum(w * x) / v1) * v1 / (v1 * v1 - v2)


def statistics(rows: DataFrame, x: str, w: str | None = None) -> DataFrame:
    """One row: size, min, max, sum, mean, std, weighted average, weighted variance, in a single aggregation."""
    v, weight = F.col(x), F.col(w) if w else F.lit(1.0)
    return rows.agg(
        F.count(v).alias("csize"), F.min(v).alias("cmin"), F.max(v).alias("cmax"), F.sum(v).alias("csum"), F.avg(v).alias("cmean"),
        F.stddev_pop(v).alias("cstd"), (F.sum(v * weight) / F.sum(weight)).alias("caverage"), weighted_variance(v, weight).alias("cvar"),
    )


def bin_edges(rows: DataFrame, z: str, bins=None, w: str | None = None) -> np.ndarray:
    """Edges: given, or a number of equal bins, or (None, 'scott') of Scott's width from the least value on."""
    if bins is not None and not isinstance(bins, str) and np.ndim(bins):
        return np.asarray(bins, float)
    s = statistics(rows, z, w).first()
    if bins is None or bins == "scott":
        width = math.sqrt(s.cvar) * (24 * math.sqrt(math.pi) / s.csize) ** (1 / 3)
        n = max(1, math.ceil((s.cmax - s.cmin) / width))
        return s.cmin + width * np.arange(n + 1)
    return np.linspace(s.cmin, s.cmax, int(bins) + 1)


def histogram(rows: DataFrame, z: str, edges, w: str | None = None) -> DataFrame:
    """(bin, lo, hi, counts) for every bin; bins are half-open but the last, which is closed. One partial aggregation."""
    e = np.asarray(edges, float)
    n = len(e) - 1
    v, weight = F.col(z), F.col(w).cast("double") if w else F.lit(1.0)
    width = (e[-1] - e[0]) / n
    if n > 1 and np.allclose(np.diff(e), width, rtol=1e-9, atol=0):
        # equal bins: a guess by arithmetic, moved by one where the exact edges say so
        table = F.array(*[F.lit(float(a)) for a in e])
        k = F.greatest(F.lit(0), F.least(F.floor((v - float(e[0])) / float(width)).cast("int"), F.lit(n - 1)))
        k = F.when(v < F.element_at(table, k + 1), k - 1).when((v >= F.element_at(table, k + 2)) & (k < n - 1), k + 1).otherwise(k)
    else:
        from skyloom.functions.interp import _place

        k = F.least(_place(v, e) - 1, F.lit(n - 1))
    inside = rows.where((v >= float(e[0])) & (v <= float(e[-1])))
    got = inside.groupBy(k.cast("int").alias("bin")).agg(F.sum(weight).alias("counts"))
    frame = rows.sparkSession.createDataFrame([(i, float(e[i]), float(e[i + 1])) for i in range(n)], "bin int, lo double, hi double")
    return frame.join(got, "bin", "left").select("bin", "lo", "hi", F.coalesce("counts", F.lit(0.0)).alias("counts"))


class RedshiftDensity:
    """n(z) of a sample: counts over shell volume (fsky None: counts), interpolated, 0 outside of the bin centres."""

    def __init__(self, rows: DataFrame, z: str, bins=None, w: str | None = None, fsky: float | None = 1.0, distance=None, order: int = 1):
        self.edges = bin_edges(rows, z, bins, w)
        d = self.edges if distance is None else distance(self.edges)
        volume = np.ones(len(d) - 1) if fsky is None else fsky * 4 / 3 * math.pi * np.diff(d**3)
        counts = {r.bin: r.counts for r in histogram(rows, z, self.edges, w).collect()}  # a row a bin
        self.z = (self.edges[1:] + self.edges[:-1]) / 2
        self.nbar = np.array([counts[i] for i in range(len(self.z))]) / volume
        self.spline = Spline(self.z, self.nbar, order, "zeros")

    def __call__(self, z):
        return self.spline(z)

    def column(self, z: Column) -> Column:
        return self.spline.column(z)


def effective_redshift(rows: DataFrame, z: str = "z", w: str | None = None) -> DataFrame:
    weight = F.col(w) if w else F.lit(1.0)
    return rows.agg((F.sum(F.col(z) * weight) / F.sum(weight)).alias("zeff"))


def region_counts(rows: DataFrame, region: str, z: str, zrange, areas: DataFrame) -> DataFrame:
    """(region, ndata, density): rows strictly inside a redshift range, and per square degree."""
    inside = rows.where((F.col(z) > float(zrange[0])) & (F.col(z) < float(zrange[1])))
    return inside.groupBy(region).agg(F.count("*").alias("ndata")).join(areas, region).select(region, "ndata", (F.col("ndata") / F.col("area")).alias("density"))


def unique_counts(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys with counts and the first row by order: np.unique(return_index, return_counts)."""
    return rows.groupBy(key).agg(F.count("*").alias("counts"), F.min(order).alias("first_index"))


def covariance(rows: DataFrame, mock: str, index: str, value: str) -> DataFrame:
    """(i, j, mean_i, mean_j, cov) over mocks, ddof 1: vectors have a fixed number of entries, so pairs stay within a mock."""
    a = rows.select(F.col(mock).alias("m"), F.col(index).alias("i"), F.col(value).alias("a"))
    b = rows.select(F.col(mock).alias("m"), F.col(index).alias("j"), F.col(value).alias("b"))
    return a.join(b, "m").groupBy("i", "j").agg(F.avg("a").alias("mean_i"), F.avg("b").alias("mean_j"), F.covar_samp("a", "b").alias("cov"))


def array_covariance(rows: DataFrame, vector: str) -> DataFrame:
    """The same for an array column, one pass: each row gives the products of its own entries."""
    e = rows.select(F.posexplode(F.col(vector)).alias("i", "a"), F.col(vector).alias("v")).select("i", F.col("a").cast("double").alias("a"), F.posexplode("v").alias("j", "b"))
    e = e.withColumn("b", F.col("b").cast("double"))
    return e.groupBy("i", "j").agg(F.avg("a").alias("mean_i"), F.avg("b").alias("mean_j"), F.covar_samp("a", "b").alias("cov"))


def correlation_edges(mode: str, smax: float = 150.0, step: float = 4.0, scale: str = "lin") -> tuple[np.ndarray, np.ndarray]:
    """Edges of (s, mu), (rp, pi) or theta bins, linear or logarithmic."""
    s = np.arange(0, smax + step / 2, step) if scale == "lin" else np.geomspace(0.01 if mode != "theta" else 0.001, smax, 49)
    second = {"smu": np.linspace(-1, 1, 201), "rppi": np.linspace(-40, 40, 81), "theta": np.array([0.0, np.inf])}
    if mode not in second:
        raise ValueError(f"unknown mode {mode}")
    return s, second[mode]


#: Points of a cell, on average, and of a block of a crowded cell; two blocks are compared at a time.
CELL_POINTS, BLOCK_POINTS = 64, 2048


def pair_counts(a: DataFrame, b: DataFrame, edges, position: str = "Position", row_id: str = "row_id", auto: bool = False) -> DataFrame:
    """(bin, lo, hi, pairs): pairs by separation.

    Space is cut in cells of at least the largest separation. A point of `a` is at home in its cell; points of `b` go to the
    cells around theirs (for pairs within one catalog to half of them, so that a pair meets once), and inside tasks the
    separations are counted block by block: pairs never become rows. Crowded cells are cut in blocks on either side, so
    that a task holds two blocks, whatever the crowding.
    """
    e = np.asarray(edges, float)
    x = g.vector(position)
    span = a.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(f"s{i}") for i, c in enumerate(x)]).first()
    volume = float(np.prod([max(span[f"s{i}"] or 0.0, e[-1]) for i in range(3)]))
    size = max(float(e[-1]), (volume * CELL_POINTS / max(1, span.n)) ** (1 / 3))
    # of a cell and the 26 around it, the half that comes after it in order; the cell itself comes first
    around = sorted(itertools.product((-1, 0, 1), repeat=3), key=lambda s: (s != (0, 0, 0), s))
    if auto:
        around = [s for s in around if s >= (0, 0, 0)]
    cell = lambda c: F.floor(c / size).cast("long")
    home = a.select(F.col(row_id).alias("id"), *[c.alias(f"p{i}") for i, c in enumerate(x)]).withColumns({f"c{i}": cell(F.col(f"p{i}")) for i in range(3)}).withColumn("side", F.lit(0))
    steps = F.array(*[F.struct(*[F.lit(int(v)).alias(f"d{i}") for i, v in enumerate(s)]) for s in around])
    guests = b.select(F.col(row_id).alias("id"), *[c.alias(f"p{i}") for i, c in enumerate(x)], F.explode(steps).alias("s"))
    guests = guests.select("id", "p0", "p1", "p2", *[(cell(F.col(f"p{i}")) - F.col(f"s.d{i}")).alias(f"c{i}") for i in range(3)], F.when(F.col("s.d0").isin(0) & F.col("s.d1").isin(0) & F.col("s.d2").isin(0), 1).otherwise(2).alias("side"))
    cells = ["c0", "c1", "c2"]
    # blocks of cells with more points than a block: a small table
    crowd = home.groupBy(*cells).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_POINTS).select(*cells, F.ceil(F.col("n") / BLOCK_POINTS).cast("int").alias("nh"))
    full = guests.groupBy(*cells).agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_POINTS).select(*cells, F.ceil(F.col("n") / BLOCK_POINTS).cast("int").alias("ng"))
    blocks = settled(crowd.join(full, cells, "full").select(*cells, F.coalesce("nh", F.lit(1)).alias("nh"), F.coalesce("ng", F.lit(1)).alias("ng")), "crowded")
    rows = home.unionByName(guests)
    own = F.pmod(F.xxhash64("id"), F.when(F.col("side") == 0, F.col("nh")).otherwise(F.col("ng"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("ng")).otherwise(F.col("nh")) - 1)
    crowded = rows.join(blocks, cells).withColumn("own", own).withColumn("other", F.explode(other))
    crowded = crowded.select("id", "p0", "p1", "p2", *cells, "side", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("side") == 0, F.col("other")).otherwise(F.col("own")).alias("k"))
    calm = rows.join(blocks, cells, "left_anti") if not blocks.isEmpty() else rows
    rows = calm.select("id", "p0", "p1", "p2", *cells, "side", F.lit(0).alias("i"), F.lit(0).alias("k"))
    if not blocks.isEmpty():
        rows = rows.unionByName(crowded)
    key = [*cells, "i", "k"]
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = rows.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(_pairs_of_cells(e, auto), "bin int, pairs long")
    bins = a.sparkSession.createDataFrame([(i, float(lo), float(hi)) for i, (lo, hi) in enumerate(zip(e[:-1], e[1:]))], "bin int, lo double, hi double")
    return bins.join(F.broadcast(counts.groupBy("bin").agg(F.sum("pairs").alias("pairs"))), "bin", "left").select("bin", "lo", "hi", F.coalesce("pairs", F.lit(0)).alias("pairs"))


def _pairs_of_cells(edges: np.ndarray, auto: bool):
    """Counts of separations between the points at home and the guests of each pair of blocks; rows arrive by cell."""
    squares, last = edges**2, len(edges) - 1

    def count(p: np.ndarray, side: np.ndarray, ids: np.ndarray, out: np.ndarray):
        home, guests = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
        for at in range(0, len(home), 256):
            h = home[at : at + 256]
            d = np.zeros((len(h), len(guests)))
            for i in range(3):
                d += (p[i][h][:, None] - p[i][guests][None]) ** 2
            meets = d <= squares[-1]
            if auto:  # guests of the cell itself meet once
                meets &= (side[guests] == 2)[None] | (ids[h][:, None] < ids[guests][None])
            # the root, as edges are compared with separations
            bins = np.searchsorted(edges, np.sqrt(d[meets]), "right") - 1
            bins[np.sqrt(d[meets]) == edges[-1]] = last - 1
            bins = bins[(bins >= 0) & (bins < last)]
            out += np.bincount(bins, minlength=last)

    def run(batches):
        out, held = np.zeros(last, np.int64), None
        schema = pa.schema([("bin", pa.int32()), ("pairs", pa.int64())])
        for batch in batches:
            cols = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("p0", "p1", "p2", "side", "id", "c0", "c1", "c2", "i", "k")]
            if held is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(held, cols)]
            key = np.stack(cols[5:])
            new = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            ends = [0, *new.tolist()]
            for lo, hi in zip(ends[:-1], ends[1:]):
                count([c[lo:hi] for c in cols[:3]], cols[3][lo:hi], cols[4][lo:hi], out)
            held = [c[ends[-1] :] for c in cols]
        if held is not None:
            count(held[:3], held[3], held[4], out)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(last, dtype=np.int32)), pa.array(out)], schema=schema)

    return run


def cumulative(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, cdf): running sum over the total, for tables of a few thousand bins."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(key, (F.sum(value).over(w) / F.sum(value).over(Window.partitionBy())).alias("cdf"))
