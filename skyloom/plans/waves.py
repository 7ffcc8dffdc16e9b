"""Queries on meshes whose results have a closed form: a plane wave, on a mesh that grows with the table of orders."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from skyloom.operators import mesh, mocks
from skyloom.plans.sky import POS, box_sql, orders_box, r6, rounded, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The wave's numbers of periods along the axes; size and centre of the box.
WAVE, SIZE, CENTER = (2, -1, 3), 1000.0, (1500.0, 0.0, 0.0)
CELLS = """n AS (SELECT (16 * ceil(cbrt(count(*)) / 32))::INT AS n FROM orders), gx AS (SELECT n, unnest(range(n)) AS ix FROM n), gy AS (SELECT *, unnest(range(n)) AS iy FROM gx), gz AS (SELECT *, unnest(range(n)) AS iz FROM gy),
g AS (SELECT *, 2 * pi() * (2 * ix - iy + 3 * iz) / n AS ph, 1000.0 + 1000.0 * ix / n AS x, 1000.0 * iy / n - 500.0 AS y, 1000.0 * iz / n - 500.0 AS z FROM gz)"""
PLACE = "ix::INT AS ix, iy::INT AS iy, iz::INT AS iz"


def grid_for(spark, sf_dir) -> mesh.Grid:
    rows = table(spark, sf_dir, "orders").count()
    return mesh.Grid(16 * math.ceil(rows ** (1 / 3) / 32 - 1e-12), SIZE, CENTER)


def wave(spark, grid: mesh.Grid):
    a, b, c = WAVE

    def slab(i, g):
        m = np.arange(g.n)
        return np.cos(2 * np.pi * (a * i + b * m[:, None] + c * m[None, :]) / g.n)

    return mesh.make_real(spark, grid, slab)


def mock(spark, sf_dir, kind=mocks.GaussianMock):
    grid = grid_for(spark, sf_dir)
    return kind.from_field(spark, mesh.r2c(wave(spark, grid), grid.n), grid)


def cells(field, n: int, name: str = "v", digits: int = 6):
    """A row for each node."""
    rows = field.select("ix", F.posexplode("v").alias("at", name))
    return rows.select("ix", F.floor(F.col("at") / n).cast("int").alias("iy"), (F.col("at") % n).cast("int").alias("iz"), (F.round(name, digits) + 0.0).alias(name))


@query(f"WITH {CELLS} SELECT {PLACE}, {r6('exp(1.5 * cos(ph)) / (SELECT avg(exp(1.5 * cos(ph))) FROM g) - 1', 'v')} FROM g")
def lognormal_field(spark, sf_dir):
    m = mock(spark, sf_dir)
    return cells(m.with_real(1.5, lognormal=True).delta, m.grid.n)


@query(f"WITH {CELLS} SELECT {PLACE}, {r6('cos(ph) * sqrt(x * x + y * y + z * z) / 1000', 'v')} FROM g")
def bias_of_distance(spark, sf_dir):
    m = mock(spark, sf_dir)
    return cells(m.with_real(lambda v, d: v * d / 1000).delta, m.grid.n)


@query(f"WITH {CELLS} SELECT {PLACE}, {r6('cos(ph) * (2.0 + 0.8 * 9 / 14)', 'v')} FROM g")
def eulerian_rsd_plane(spark, sf_dir):
    m = mock(spark, sf_dir, mocks.EulerianMock)
    return cells(m.with_real(2.0).with_rsd(0.8, los="z").delta, m.grid.n)


@query(f"WITH {CELLS} SELECT {PLACE}, {r6('cos(ph) * (1 + 0.8 * (2 * x - y + 3 * z) ** 2 / (14 * (x * x + y * y + z * z)))', 'v')} FROM g")
def eulerian_rsd_local(spark, sf_dir):
    m = mock(spark, sf_dir, mocks.EulerianMock)
    return cells(m.with_real().with_rsd(0.8).delta, m.grid.n)


@query(f"""WITH {CELLS}, d AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM g)
SELECT {PLACE}, {r6('(1 + cos(ph)) * exp(-(((d - 1500) / 500) ** 2)) * (1 + 0.5 * z / d) * (2 + cos(atan2(y, x)))', 'v')} FROM d""")
def selection_function(spark, sf_dir):
    """The wave times a density of distance, right ascension and declination."""
    m = mock(spark, sf_dir).with_real()
    m = m.with_selection(lambda d, ra, dec: np.exp(-(((d - 1500) / 500) ** 2)) * (1 + 0.5 * np.sin(np.radians(dec))) * (2 + np.cos(np.radians(ra))))
    return cells(m.galaxies(), m.grid.n)


@query(f"""WITH {CELLS}, d AS (SELECT *, -sin(ph) / (2 * pi() / 1000 * 14) AS psi FROM g)
SELECT {PLACE}, {r6('2 * psi', 'psi_x')}, {r6('-psi', 'psi_y')}, {r6('3 * psi', 'psi_z')} FROM d""")
def displacement_fields(spark, sf_dir):
    """i k / k^2 of the wave."""
    m = mock(spark, sf_dir, mocks.LagrangianMock).with_real()
    out = None
    for a in "xyz":
        f = cells(m.fields[f"disp_{a}"], m.grid.n, f"psi_{a}")
        out = f if out is None else out.join(f, ["ix", "iy", "iz"])
    return out


@query(f"WITH {CELLS}, w AS (SELECT *, pi() / n AS h FROM g) SELECT {PLACE}, {r6('cos(ph) / (sin(2 * h) / (2 * h) * sin(h) / h * sin(3 * h) / (3 * h)) ** 3', 'v')} FROM w")
def window_compensation(spark, sf_dir):
    """The wave divided by the transform of the third resampler."""
    grid = grid_for(spark, sf_dir)
    return cells(mesh.c2r(mesh.compensate(mesh.r2c(wave(spark, grid), grid.n), grid, "tsc"), grid.n), grid.n)


EDGES = [0.001, 0.01, 0.02, 0.03, 0.045]


@query(f"""WITH {CELLS}, a AS (SELECT n, unnest(range(-n // 2, n // 2)) AS p FROM n), b AS (SELECT *, unnest(range(-n // 2, n // 2)) AS q FROM a), c AS (SELECT *, unnest(range(-n // 2, n // 2)) AS r FROM b),
m AS (SELECT 2 * pi() / 1000 * sqrt((p * p + q * q + r * r)::DOUBLE) AS k, (p = 2 AND q = -1 AND r = 3 OR p = -2 AND q = 1 AND r = -3)::INT AS own FROM c), e AS (SELECT unnest([0, 1, 2, 3]) AS bin, {EDGES}::DOUBLE[] AS e)
SELECT bin::INT AS bin, {r6('avg(k)', 'k')}, {r6('sum(own) * 0.25e9 / count(*)', 'power', 3)}, count(*)::DOUBLE AS modes FROM e, m WHERE k >= e[bin + 1] AND k < e[bin + 2] GROUP BY bin""")
def wave_power(spark, sf_dir):
    """All power is in the wave's own modes."""
    m = mock(spark, sf_dir)
    p = mesh.power_spectrum(m.delta_k, m.grid, EDGES)
    return p.select("bin", F.round("k", 6).alias("k"), (F.round("power", 3) + 0.0).alias("power"), "modes")


@query(f"WITH b AS ({box_sql(center=CENTER, velocity=10.0)}) SELECT row_id, {', '.join(r6(f'{a} + 0.414213562 * (vx * x + vy * y + vz * z) / (x * x + y * y + z * z) * {a}', p) for a, p in zip('xyz', POS))} FROM b")
def lagrangian_rsd(spark, sf_dir):
    """Displacements of particles along their lines of sight."""
    b = orders_box(spark, sf_dir, SIZE, CENTER, velocity=10.0).df
    rows = b.select("row_id", *POS, *[F.col(f"Velocity_{a}").alias(f"Displacement_{a}") for a in "xyz"])
    m = mocks.LagrangianMock(spark, mesh.Grid(16, SIZE, CENTER))
    return rounded(m.with_rsd(rows, 0.414213562), *POS)


@query(f"WITH {CELLS} SELECT {PLACE}, {r6('cos(ph) + ix * 0.25', 'v')} FROM g")
def fields_combined(spark, sf_dir):
    """Two meshes, one of them made of an expression, added node by node."""
    grid = grid_for(spark, sf_dir)
    other = mesh.make_real(spark, grid, lambda i, g: np.full((g.n, g.n), i * 0.25))
    return cells(mesh.combine(lambda a, b: a + b, wave(spark, grid), other), grid.n)
