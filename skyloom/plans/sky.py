"""Queries over catalogs, geometry, masks and densities, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.functions import healpix
from skyloom.functions.cosmology import DistanceToRedshift, cosmology
from skyloom.functions.interp import Spline
from skyloom.functions.rng import u01, u01_sql
from skyloom.operators import density, masks
from skyloom.operators.catalog import box_of, random_box, random_cutsky
from skyloom.operators.isometry import Isometry, box_to_cutsky, cutsky_to_box
from skyloom.operators.remap import Cuboid

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_box(spark, sf_dir, size=1000.0, center=0.0, velocity=None):
    return box_of(table(spark, sf_dir, "orders"), "o_orderkey", size, center, velocity=velocity)


def box_sql(size=(1000.0,) * 3, center=(0.0,) * 3, velocity=None, seed=42) -> str:
    """(row_id, x, y, z[, vx, vy, vz]) of orders_box."""
    size, center = g.triple(size), g.triple(center)
    cols = [f"round(({u01_sql('o_orderkey', seed, a)} - 0.5) * {s} + {c}, 6) AS {a}" for a, s, c in zip("xyz", size, center)]
    if velocity:
        cols += [f"round(({u01_sql('o_orderkey', seed, 'v' + a)} - 0.5) * {velocity}, 6) AS v{a}" for a in "xyz"]
    return f"SELECT o_orderkey AS row_id, {', '.join(cols)} FROM orders"


def rounded(df, *names, digits=6, keep=("row_id",)):
    """Doubles rounded, with -0.0 made 0.0."""
    return df.select(*keep, *[(F.round(n, digits) + F.lit(0.0)).alias(n) for n in names])


def r6(e, name, digits=6):
    return f"round({e}, {digits}) + 0.0 AS {name}"


POS = ("Position_x", "Position_y", "Position_z")
VEL = ("Velocity_x", "Velocity_y", "Velocity_z")
PLAIN = ", ".join(r6(a, p) for a, p in zip("xyz", POS))
D = "sqrt(x * x + y * y + z * z)"
RA = "CASE WHEN atan2(y, x) < 0 THEN degrees(atan2(y, x)) + 360.0 ELSE degrees(atan2(y, x)) END"


@query(f"WITH b AS ({box_sql()}) SELECT row_id, {r6(D, 'Distance')}, {r6(RA, 'RA')}, {r6(f'degrees(asin(z / {D}))', 'DEC')} FROM b")
def cartesian_to_sky(spark, sf_dir):
    b = orders_box(spark, sf_dir)
    d, ra, dec = g.cartesian_to_sky(b.vector())
    return rounded(b.df.withColumns({"Distance": d, "RA": ra, "DEC": dec}), "Distance", "RA", "DEC")


SKY = f"SELECT o_orderkey AS row_id, {u01_sql('o_orderkey', 7, 'ra')} * 360.0 AS ra, {u01_sql('o_orderkey', 7, 'dec')} * 180.0 - 90.0 AS dec, 100.0 + 900.0 * {u01_sql('o_orderkey', 7, 'd')} AS d FROM orders"


def orders_sky(spark, sf_dir):
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(i.alias("row_id"), (u01(i, 7, "ra") * 360.0).alias("ra"), (u01(i, 7, "dec") * 180.0 - 90.0).alias("dec"), (100.0 + 900.0 * u01(i, 7, "d")).alias("d"))


@query(f"WITH s AS ({SKY}) SELECT row_id, {r6('d * cos(radians(dec)) * cos(radians(ra))', 'x')}, {r6('d * cos(radians(dec)) * sin(radians(ra))', 'y')}, {r6('d * sin(radians(dec))', 'z')} FROM s")
def sky_to_cartesian(spark, sf_dir):
    s = orders_sky(spark, sf_dir)
    x, y, z = g.sky_to_cartesian(F.col("d"), F.col("ra"), F.col("dec"))
    return rounded(s.withColumns({"x": x, "y": y, "z": z}), "x", "y", "z")


@query("SELECT o_orderkey AS row_id, " + r6("((o_totalprice - 5000.0) % 360.0 + 360.0) % 360.0", "angle") + " FROM orders")
def wrap_angle(spark, sf_dir):
    return rounded(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), g.wrap_angle(F.col("o_totalprice") - 5000.0).alias("angle")), "angle")


@query("SELECT * FROM (VALUES (0, round(30.0 * degrees(sin(radians(10.0)) - sin(radians(-10.0))), 6)), (1, round(20.0 * degrees(sin(radians(60.0)) - sin(radians(0.0))), 6))) t(range_id, area)")
def radec_area(spark, sf_dir):
    area = g.radec_area(([0.0, 350.0], [30.0, 10.0]), ([-10.0, 0.0], [10.0, 60.0]))
    return spark.createDataFrame([(i, round(float(a), 6)) for i, a in enumerate(area)], "range_id int, area double")


@query(f"WITH b AS ({box_sql(velocity=10.0)}) SELECT row_id, {', '.join(r6(f'(vx * x + vy * y + vz * z) / (x * x + y * y + z * z) * {a}', n) for a, n in zip('xyz', VEL))} FROM b")
def vector_projection(spark, sf_dir):
    b = orders_box(spark, sf_dir, velocity=10.0)
    v = g.vector_projection(b.vector("Velocity"), b.vector())
    return rounded(b.df.withColumns(dict(zip(VEL, v))), *VEL)


@query("SELECT vec_id, round(list_sum(embedding::DOUBLE[]) / 64.0, 6) + 0.0 AS along FROM embeddings")
def vector_projection_nd(spark, sf_dir):
    ones = F.array_repeat(F.lit(1.0), 64)
    e = table(spark, sf_dir, "embeddings").select("vec_id", g.array_projection(F.col("embedding"), ones).alias("p"))
    return e.select("vec_id", (F.round(F.element_at("p", 1), 6) + 0.0).alias("along"))


def _matrix_sql(way: Isometry, invariant=False, axes="xyz"):
    out = []
    for row, t in zip(way.rotation_matrix, way.shift):
        e = " + ".join(f"({v!r}) * {a}" for v, a in zip(map(float, row), axes) if v) or "0.0"
        out.append(e + (f" + ({float(t)!r})" if t and not invariant else ""))
    return out


CHAIN = Isometry().rotation(30.0, "z").translation(100.0, "x").rotation(-20.0, "y") + Isometry().translation((1.0, 2.0, 3.0), frame="current")


@query(f"WITH b AS ({box_sql(velocity=10.0)}) SELECT row_id, {', '.join(r6(e, n) for e, n in zip(_matrix_sql(CHAIN), POS))}, {', '.join(r6(e, n) for e, n in zip(_matrix_sql(CHAIN, True, ('vx', 'vy', 'vz')), VEL))} FROM b")
def isometry_chain(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir, velocity=10.0).isometry(CHAIN).df, *POS, *VEL)


@query(f"WITH b AS ({box_sql()}) SELECT row_id, round(x + 10.0, 6) + 0.0 AS Position_x, round(y - 20.0, 6) + 0.0 AS Position_y, round(z + 30.0, 6) + 0.0 AS Position_z FROM b")
def box_translate(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir).translate((10.0, -20.0, 30.0)).df, *POS)


@query(f"WITH b AS ({box_sql(center=(500.0,) * 3)}) SELECT row_id, {', '.join(r6(f'{a} - 500.0', p) for a, p in zip('xyz', POS))} FROM b")
def box_recenter(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir, center=500.0).recenter().df, *POS)


@query(f"WITH b AS ({box_sql(center=(1.0, 2.0, 3.0))}) SELECT row_id, {r6('x', POS[0])}, {r6('-z', POS[1])}, {r6('y', POS[2])} FROM b")
def box_rotate(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir, center=(1.0, 2.0, 3.0)).rotate(1, "x").df, *POS)


@query(f"WITH b AS ({box_sql()}) SELECT row_id, {PLAIN} FROM b WHERE x >= -400.0 AND x < 0.0 AND y >= -400.0 AND y < 0.0 AND z >= -400.0 AND z < 0.0")
def subbox(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir).subbox((0.1, 0.5)).df, *POS)


@query(f"""WITH b AS ({box_sql()}), s AS (SELECT unnest([-1, 0, 1]) AS s), p AS (SELECT row_id, x + 1000.0 * a.s AS x, y + 1000.0 * b2.s AS y, z + 1000.0 * c.s AS z FROM b, s a, s b2, s c)
SELECT row_id, {PLAIN} FROM p WHERE abs(x) <= 600.0 AND abs(y) <= 600.0 AND abs(z) <= 600.0""")
def pad(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir).pad(1.2).df, *POS)


CUT = dict(drange=(800.0, 1100.0), rarange=(0.0, 30.0), decrange=(-10.0, 10.0))
CUT_SIZE, CUT_WAY = cutsky_to_box(**CUT)
CUT_BOX = tuple(float(round(s * 1.1, 3)) for s in CUT_SIZE)


def _cut_sql(way, source):
    x, y, z = _matrix_sql(way)
    return f"""WITH b AS ({source}), m AS (SELECT row_id, {x} AS x, {y} AS y, {z} AS z FROM b),
s AS (SELECT row_id, {D} AS d, {RA} AS ra, degrees(asin(z / {D})) AS dec FROM m)
SELECT row_id, {r6('d', 'Distance')}, {r6('ra', 'RA')}, {r6('dec', 'DEC')} FROM s WHERE d BETWEEN 800.0 AND 1100.0 AND ra BETWEEN 0.0 AND 30.0 AND dec BETWEEN -10.0 AND 10.0"""


@query(_cut_sql(CUT_WAY, box_sql(CUT_BOX)))
def cutsky_single(spark, sf_dir):
    """Flagship: a survey cut out of a box, one projection and one filter, no shuffle."""
    return rounded(orders_box(spark, sf_dir, CUT_BOX).cutsky(**CUT).df, "Distance", "RA", "DEC")


BIG_BOX = tuple(float(round(s * 2.1, 3)) for s in CUT_SIZE)


def _multi_sql():
    from skyloom.operators.catalog import BoxCatalog

    ways, _, _ = BoxCatalog.isometries_for_cutsky(type("Box", (), {"boxsize": BIG_BOX, "boxcenter": (0.0,) * 3})(), noutput=None, **CUT)
    rows = ", ".join(f"({i}, {', '.join(repr(float(v)) for v in w.rotation_matrix.ravel())}, {', '.join(repr(float(v)) for v in w.shift)})" for i, w in enumerate(ways))
    lin = [f"r{j}0 * b.x + r{j}1 * b.y + r{j}2 * b.z + t{j}" for j in range(3)]
    return f"""WITH b AS ({box_sql(BIG_BOX)}), w(cut_id, r00, r01, r02, r10, r11, r12, r20, r21, r22, t0, t1, t2) AS (VALUES {rows}),
m AS (SELECT row_id, cut_id, {lin[0]} AS x, {lin[1]} AS y, {lin[2]} AS z FROM b, w),
s AS (SELECT row_id, cut_id, {D} AS d, {RA} AS ra, degrees(asin(z / {D})) AS dec FROM m)
SELECT row_id, cut_id, {r6('d', 'Distance')}, {r6('ra', 'RA')}, {r6('dec', 'DEC')} FROM s WHERE d BETWEEN 800.0 AND 1100.0 AND ra BETWEEN 0.0 AND 30.0 AND dec BETWEEN -10.0 AND 10.0"""


@query(_multi_sql())
def cutsky_multi(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir, BIG_BOX).cutsky(noutput=None, **CUT).df, "Distance", "RA", "DEC", keep=("row_id", "cut_id"))


@query("SELECT * FROM (VALUES (0, 2000.0, 4600.0, -90.0, 90.0), (1, 0.0, 500.0, -180.0, 180.0), (2, 3500.0, 4000.0, -22.024313, 22.024313), (3, 3500.0, 4000.0, -55.150095, 55.150095)) t(case_id, dmin, dmax, ramin, ramax) WHERE case_id > 0")
def box_to_cutsky_ranges(spark, sf_dir):
    cases = [(1, 1000.0, 500.0, 0.0), (2, (2000.0, 3000.0, 8000.0), 4000.0, 3500.0), (3, (2000.0, 9000.0, 8000.0), 4000.0, 3500.0)]
    rows = [(i, *d, *[round(x, 6) for x in ra]) for i, b, hi, lo in cases for d, ra, _ in [box_to_cutsky(b, hi, lo)]]
    return spark.createDataFrame([(i, *map(float, r)) for i, *r in rows], "case_id int, dmin double, dmax double, ramin double, ramax double")


@query(f"WITH b AS ({box_sql(velocity=10.0)}) SELECT row_id, {', '.join(r6(f'{a} + 0.8 * (vx * x + vy * y + vz * z) / (x * x + y * y + z * z) * {a}', p) for a, p in zip('xyz', POS))} FROM b")
def rsd_local(spark, sf_dir):
    b = orders_box(spark, sf_dir, velocity=10.0)
    return rounded(b.with_vectors({"Position": b.rsd_position(0.8)}).df, *POS)


@query(f"WITH b AS ({box_sql(velocity=10.0)}) SELECT row_id, {r6('x', POS[0])}, {r6('y', POS[1])}, {r6('z + 0.8 * vz', POS[2])} FROM b")
def rsd_plane(spark, sf_dir):
    b = orders_box(spark, sf_dir, velocity=10.0)
    return rounded(b.with_vectors({"Position": b.rsd_position(0.8, "z")}).df, *POS)


@query(f"WITH b AS ({box_sql(velocity=10.0)}) SELECT row_id, {', '.join(r6(f'{a} + {D} / 1000.0 * (vx * x + vy * y + vz * z) / (x * x + y * y + z * z) * {a}', p) for a, p in zip('xyz', POS))} FROM b")
def rsd_distance_dependent(spark, sf_dir):
    b = orders_box(spark, sf_dir, velocity=10.0)
    return rounded(b.with_vectors({"Position": b.rsd_position(lambda d: d / 1000.0)}).df, *POS)


LATTICE = ((0, 1, 1), (1, 0, 1), (0, 1, 0))
CUBOID = Cuboid(LATTICE, 1000.0)


def _remap_sql():
    n = CUBOID.n.tolist()
    dots = [f"((px + i) * ({n[j][0]!r}) + (py + j) * ({n[j][1]!r}) + (pz + k) * ({n[j][2]!r}))" for j in range(3)]
    ok = " AND ".join(f"{d} >= -1e-9 AND {d} < {float(CUBOID.length[j])!r} - 1e-9" for j, d in enumerate(dots))
    return f"""WITH b AS ({box_sql()}), p AS (SELECT row_id, (x + 500.0) / 1000.0 AS px, (y + 500.0) / 1000.0 AS py, (z + 500.0) / 1000.0 AS pz FROM b),
s AS (SELECT unnest([-2, -1, 0, 1, 2]) AS s)
SELECT row_id, {', '.join(r6(f'greatest({d}, 0.0) * {float(CUBOID.resize[j])!r} - {float(CUBOID.size[j] / 2)!r}', POS[j], 4) for j, d in enumerate(dots))}
FROM p, (SELECT a.s AS i, b2.s AS j, c.s AS k FROM s a, s b2, s c) WHERE {ok}"""


@query(_remap_sql())
def remap_forward(spark, sf_dir):
    """Closed form here; a search over all integer shifts in the SQL."""
    return rounded(orders_box(spark, sf_dir).remap(LATTICE).df, *POS, digits=4)


@query(f"WITH b AS ({box_sql()}) SELECT row_id, {', '.join(r6(a, p) for a, p in zip('xyz', POS))} FROM b")
def remap_round_trip(spark, sf_dir):
    b = orders_box(spark, sf_dir)
    r = b.remap(LATTICE)
    low = CUBOID.size / 2
    back = CUBOID.inverse_columns(tuple(c + F.lit(float(o)) for c, o in zip(r.vector(), low)))
    return rounded(r.with_vectors({"Position": tuple(c - 500.0 for c in back)}).df, *POS, digits=6)


@query(f"WITH b AS ({box_sql(velocity=10.0)}) SELECT row_id, {r6('(vy + vz) / sqrt(2.0)', 'Velocity_x')}, {r6('(vx - 0.5 * vy + 0.5 * vz) / sqrt(1.5)', 'Velocity_y')}, {r6('(vx + vy - vz) / sqrt(3.0)', 'Velocity_z')} FROM b")
def remap_velocity(spark, sf_dir):
    """Velocities are rotated onto the axes of the cuboid."""
    r = orders_box(spark, sf_dir, velocity=10.0).remap(LATTICE)
    return rounded(r.df, "Velocity_x", "Velocity_y", "Velocity_z")


@query("""SELECT round(a, 6) AS l1, round(b, 6) AS l2, round(c, 6) AS l3 FROM (VALUES (1.0, 1.0, 1.0), (sqrt(2.0), 1.0, sqrt(0.5)), (sqrt(2.0), sqrt(1.5), sqrt(1.0 / 3.0)), (sqrt(3.0), sqrt(2.0 / 3.0), sqrt(0.5)), (sqrt(3.0), sqrt(2.0), sqrt(1.0 / 6.0))) t(a, b, c)""")
def lattice_sizes(spark, sf_dir):
    return spark.createDataFrame([tuple(round(x, 6) for x in k) for k in Cuboid.lattices(1.0, 1)], "l1 double, l2 double, l3 double")


@query(f"SELECT o_orderkey AS row_id, {', '.join(r6(f'({u01_sql('o_orderkey', 42, a)} - 0.5) * 10.0 + 3.0', p) for a, p in zip('xyz', POS))} FROM orders")
def random_box_keyed(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir, 10.0, 3.0).df, *POS)


IDS = "SELECT unnest(range({n}))::BIGINT AS i"


@query(f"SELECT i AS row_id, {', '.join(r6(f'({u01_sql('i', 42, a)} - 0.5) * 10.0 + 3.0', p) for a, p in zip('xyz', POS))} FROM ({IDS.format(n=1000)})")
def random_box_generator(spark, sf_dir):
    return rounded(random_box(spark, 10.0, 3.0, nbar=1.0, uniform=u01).df, *POS)


S0, S1 = float(np.sin(np.radians(-10.0))), float(np.sin(np.radians(10.0)))


@query(f"""WITH c AS (SELECT i AS row_id, (350.0 + 40.0 * {u01_sql('i', 42, 'ra')}) % 360.0 AS RA, degrees(asin({S0!r}::DOUBLE + {S1 - S0!r}::DOUBLE * {u01_sql('i', 42, 'dec')})) AS DEC,
  cbrt(1000.0 ** 3 + (2000.0 ** 3 - 1000.0 ** 3) * {u01_sql('i', 42, 'd')}) AS d FROM ({IDS.format(n=1000)}))
SELECT row_id, {r6('RA', 'RA')}, {r6('DEC', 'DEC')}, {r6('d', 'Distance')}, {r6('d * cos(radians(DEC)) * cos(radians(RA))', 'Position_x')}, {r6('d * cos(radians(DEC)) * sin(radians(RA))', 'Position_y')}, {r6('d * sin(radians(DEC))', 'Position_z')} FROM c""")
def random_cutsky_generator(spark, sf_dir):
    c = random_cutsky(spark, (350.0, 30.0), (-10.0, 10.0), (1000.0, 2000.0), csize=1000, uniform=u01)
    return rounded(c.df, "RA", "DEC", "Distance", *POS)


EV = "SELECT event_id AS row_id, value / 200.0 AS z FROM events"


def events_z(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), (F.col("value") / 200.0).alias("z"))


@query(f"WITH e AS ({EV}) SELECT row_id, z FROM e WHERE CASE WHEN z BETWEEN 0.5 AND 1.5 THEN 0.4 ELSE 0.0 END >= {u01_sql('row_id', 5, 'mask')}")
def mask_radial_uniform(spark, sf_dir):
    e = events_z(spark, sf_dir)
    return e.where(masks.UniformRadial((0.5, 1.5), 0.4).keep(F.col("row_id"), F.col("z"), seed=5))


@query(f"WITH s AS ({SKY}) SELECT row_id, {r6('ra', 'ra')}, {r6('dec', 'dec')} FROM s WHERE CASE WHEN (ra >= 300.0 OR ra <= 20.0) AND dec BETWEEN -30.0 AND 40.0 THEN 0.7 ELSE 0.0 END >= {u01_sql('row_id', 5, 'mask')}")
def mask_angular_wrap(spark, sf_dir):
    s = orders_sky(spark, sf_dir)
    return rounded(s.where(masks.UniformAngular((300.0, 20.0), (-30.0, 40.0), 0.7).keep(F.col("row_id"), F.col("ra"), F.col("dec"), seed=5)), "ra", "dec")


@query(f"""SELECT event_id AS row_id, event_type FROM events WHERE CASE event_type WHEN 'click' THEN CASE WHEN value / 200.0 BETWEEN 0.6 AND 0.8 THEN 1.0 ELSE 0.0 END
WHEN 'view' THEN CASE WHEN value / 200.0 BETWEEN 0.8 AND 2.0 THEN 0.5 ELSE 0.0 END ELSE 1.0 END >= {u01_sql('event_id', 5, 'mask')}""")
def mask_chunks(spark, sf_dir):
    m = masks.MaskCollection({"click": masks.UniformRadial((0.6, 0.8)), "view": masks.UniformRadial((0.8, 2.0), 0.5)})
    e = table(spark, sf_dir, "events")
    return e.where(m.keep(F.col("event_id"), F.col("event_type"), F.col("value") / 200.0, seed=5)).select(F.col("event_id").alias("row_id"), "event_type")


NZ, NN = np.linspace(0.3, 1.7, 8), 10 * np.exp(-10 * (np.linspace(0.3, 1.7, 8) - 1) ** 2)


def _linear_sql(v, x, y):
    parts = [f"WHEN {v} <= {float(b)!r} THEN {float(c)!r} + ({float((d - c) / (b - a))!r}) * ({v} - {float(a)!r})" for a, b, c, d in zip(x[:-1], x[1:], y[:-1], y[1:])]
    return f"CASE {' '.join(parts)} END"


@query(f"WITH e AS ({EV}) SELECT row_id, round(z, 9) AS z FROM e WHERE round(CASE WHEN z BETWEEN 0.3 AND 1.7 THEN {_linear_sql('z', NZ, NN / NN.max())} ELSE 0.0 END, 9) >= {u01_sql('row_id', 6, 'mask')}")
def mask_tabulated_linear(spark, sf_dir):
    m = masks.TabulatedRadial(NZ, NN, order=1)
    e = events_z(spark, sf_dir)
    return e.where(F.round(m.prob(F.col("z")), 9) >= u01(F.col("row_id"), 6, "mask")).select("row_id", F.round("z", 9).alias("z"))


@query()
def mask_tabulated_cubic(spark, sf_dir):
    m = masks.TabulatedRadial(np.linspace(0.3, 1.7, 100), 10 * np.exp(-10 * (np.linspace(0.3, 1.7, 100) - 1) ** 2), order=3).normalized(0.3)
    e = events_z(spark, sf_dir)
    return e.where(F.col("z").between(0.3, 1.7)).where(m.keep(F.col("row_id"), F.col("z"), seed=6))


@query(f"WITH e AS ({EV}) SELECT round(avg(CASE WHEN z BETWEEN 0.3 AND 1.7 THEN {_linear_sql('z', NZ, NN / NN.max())} ELSE 0.0 END), 6) AS integral FROM e")
def mask_integral_sample(spark, sf_dir):
    value = masks.TabulatedRadial(NZ, NN, order=1).integral(events_z(spark, sf_dir))
    return spark.createDataFrame([(round(value, 6),)], "integral double")


@query(f"""WITH t AS (SELECT unnest({[float(x) for x in NZ]})::DOUBLE AS z, unnest({[float(x) for x in NN]})::DOUBLE AS n), s AS (SELECT (n + lead(n) OVER w) / 2 * (lead(z) OVER w - z) AS part FROM t WINDOW w AS (ORDER BY z))
SELECT round(0.2 * (SELECT max(z) - min(z) FROM t) / sum(part), 9) AS norm, 0.2::DOUBLE AS integral FROM s""")
def mask_normalize(spark, sf_dir):
    """The factor that brings the mean probability to a target."""
    m = masks.TabulatedRadial(NZ, NN, order=1).normalized(0.2)
    return spark.createDataFrame([(round(float(m.norm), 9), round(float(m.integral()), 6))], "norm double, integral double")


@query()
def mask_convert_cosmology(spark, sf_dir):
    a, b = cosmology(), cosmology({"Omega_m": 0.25})
    back = DistanceToRedshift(b.distance, 3.0)
    m = masks.TabulatedRadial(NZ, NN, order=2).convert(a.distance, b.distance, back)
    return spark.createDataFrame([(float(z), float(n)) for z, n in zip(m.z, m.nbar_table)], "z double, nbar double")


@query(f"WITH s AS ({SKY}), h AS (SELECT row_id, ra, dec, {healpix.ring_sql(4, 'ra', 'dec')} AS pix FROM s) SELECT row_id, pix, {r6('CASE WHEN dec BETWEEN -60.0 AND 60.0 THEN (pix % 10) / 10.0 ELSE 0.0 END', 'prob')} FROM h")
def healpix_mask(spark, sf_dir):
    m = masks.HealpixAngular.from_array(spark, (np.arange(192) % 10) / 10.0, decrange=(-60.0, 60.0))
    s = orders_sky(spark, sf_dir).withColumn("pixel", healpix.ang2pix(4, F.col("ra"), F.col("dec")))
    return rounded(m.with_prob(s).withColumnRenamed("pixel", "pix"), "prob", keep=("row_id", "pix"))


@query(f"""WITH s AS ({SKY}), v AS (SELECT row_id, cos(radians(dec)) * cos(radians(ra)) AS x, sin(radians(dec)) AS z FROM s)
SELECT row_id, CASE WHEN 1 - z < 0.5 THEN 0.8 WHEN 1 - x < 0.3 AND 1 - z > 0.9 THEN 0.4 ELSE 0.0 END::DOUBLE AS prob FROM v""")
def polygon_mask(spark, sf_dir):
    m = masks.PolygonAngular([(0.8, [(0.0, 0.0, 1.0, 0.5)]), (0.4, [(1.0, 0.0, 0.0, 0.3), (0.0, 0.0, 1.0, -0.9)])])
    return m.with_prob(orders_sky(spark, sf_dir)).select("row_id", "prob")


@query(f"WITH s AS ({SKY}) SELECT row_id, dec > 32.375 AS in_n, dec < 32.375 AND ra > 100 - dec AND ra < 280 + dec AS in_dn, dec < 32.375 AND dec > -25 AND NOT (ra > 100 - dec AND ra < 280 + dec) AS in_ds, CASE WHEN dec > 32.375 THEN 'N' ELSE 'S' END AS region FROM s")
def photometric_region(spark, sf_dir):
    s = orders_sky(spark, sf_dir)
    return s.select("row_id", *[masks.photometric_region(F.col("ra"), F.col("dec"), r).alias(f"in_{r.lower()}") for r in ("N", "DN", "DS")], masks.north_or_south(F.col("dec")).alias("region"))


A0, A1 = float(np.sin(np.radians(-30.0))), float(np.sin(np.radians(40.0)))


@query(f"""WITH c AS (SELECT i, (300.0 + 80.0 * {u01_sql('i', 3, 'ra')}) % 360.0 AS ra, degrees(asin({A0!r}::DOUBLE + {A1 - A0!r}::DOUBLE * {u01_sql('i', 3, 'dec')})) AS dec FROM ({IDS.format(n=4000)}) WHERE {u01_sql('i', 3, 'mask')} <= 0.5)
SELECT row_number() OVER (ORDER BY i) - 1 AS row_id, {r6('ra', 'ra')}, {r6('dec', 'dec')} FROM c QUALIFY row_number() OVER (ORDER BY i) <= 1000""")
def angular_sampler(spark, sf_dir):
    """The first thousand candidates that the mask accepts."""
    return rounded(masks.UniformAngular((300.0, 20.0), (-30.0, 40.0), 0.5).sample(spark, 1000, seed=3, uniform=u01), "ra", "dec")


@query("SELECT DISTINCT 1000::BIGINT AS rows_made, true AS in_range FROM region")
def radial_sampler(spark, sf_dir):
    c = cosmology()
    r = masks.TabulatedRadial(NZ, NN, order=2).sample(spark, 1000, c.distance, DistanceToRedshift(c.distance, 3.0), seed=3)
    return r.agg(F.count_distinct("row_id").alias("rows_made"), F.bool_and(F.col("z").between(0.2999, 1.7001)).alias("in_range"))


@query("SELECT p_partkey, p_size FROM part WHERE (p_size & 37) = 0")
def bit_mask(spark, sf_dir):
    return table(spark, sf_dir, "part").where(g.bits_clear(F.col("p_size"), (0, 2, 5))).select("p_partkey", "p_size")


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus FROM orders), n AS (SELECT o_orderstatus, count(*) AS n FROM r GROUP BY ALL), t(o_orderstatus, ndata) AS (VALUES ('F', 100), ('O', 200))
SELECT r.o_orderkey, r.o_orderstatus FROM r JOIN n USING (o_orderstatus) JOIN t USING (o_orderstatus) WHERE {u01_sql('o_orderkey', 9, 'down')} < ndata::DOUBLE / n""")
def downsample(spark, sf_dir):
    t = spark.createDataFrame([("F", 100), ("O", 200)], "o_orderstatus string, ndata long")
    return masks.downsample(table(spark, sf_dir, "orders"), t, "o_orderstatus", "o_orderkey", 9).select("o_orderkey", "o_orderstatus")


EDGES = [0.0, 0.25, 0.5, 1.0, 1.5, 2.0, 2.45]


@query(f"""WITH l AS (SELECT l_quantity / 20.0 AS z, l_discount + 1.0 AS w FROM lineitem), e AS (SELECT unnest(range(6)) AS bin, {EDGES}::DOUBLE[] AS e)
SELECT bin::INT AS bin, e[bin + 1] AS lo, e[bin + 2] AS hi, round(coalesce((SELECT sum(w) FROM l WHERE z >= e[bin + 1] AND (z < e[bin + 2] OR bin = 5 AND z = e[bin + 2])), 0.0), 4) AS counts FROM e""")
def nz_histogram_edges(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 20.0).alias("z"), (F.col("l_discount") + 1.0).alias("w"))
    return density.histogram(rows, "z", EDGES, "w").withColumn("counts", F.round("counts", 4))


@query(f"""WITH e AS ({EV}), m AS (SELECT min(z) AS a, max(z) AS b FROM e), k AS (SELECT least(floor((z - a) / (b - a) * 50), 49)::INT AS bin FROM e, m)
SELECT bin, count(*)::DOUBLE AS counts FROM k GROUP BY bin""")
def nz_histogram_bins(spark, sf_dir):
    e = events_z(spark, sf_dir)
    return density.histogram(e, "z", density.bin_edges(e, "z", 50)).where("counts > 0").select("bin", "counts")


@query(f"""WITH e AS ({EV}), s AS (SELECT min(z) AS a, max(z) AS b, stddev_samp(z) * (24 * sqrt(pi()) / count(*)) ** (1.0 / 3) AS dx FROM e)
SELECT ceil((b - a) / dx)::BIGINT AS nbins, round(dx, 6) AS width FROM s""")
def nz_scott(spark, sf_dir):
    e = density.bin_edges(events_z(spark, sf_dir), "z", "scott")
    return spark.createDataFrame([(len(e) - 1, round(float(e[1] - e[0]), 6))], "nbins long, width double")


NZ_EDGES = np.linspace(0.0, 2.4, 31)
NZ_SHELLS = 0.42 * 4 / 3 * np.pi * np.diff(cosmology().distance(NZ_EDGES) ** 3)


@query(f"""WITH e AS ({EV}), k AS (SELECT {[float(x) for x in NZ_EDGES]}::DOUBLE[] AS edge, {[float(x) for x in (NZ_EDGES[1:] + NZ_EDGES[:-1]) / 2]}::DOUBLE[] AS mid, {[float(x) for x in NZ_SHELLS]}::DOUBLE[] AS shell),
h AS (SELECT least(len(list_filter(edge, lambda x: x <= z)), 30) AS i, count(*) AS c FROM e, k WHERE z BETWEEN 0.0 AND 2.4 GROUP BY 1),
n AS (SELECT list(coalesce(c, 0) / shell[b.i] ORDER BY b.i) AS n FROM (SELECT unnest(range(1, 31)) AS i) b LEFT JOIN h USING (i), k),
p AS (SELECT row_id, z, mid, n, least(len(list_filter(mid, lambda x: x <= z)), 29) AS j FROM e, k, n)
SELECT row_id, {r6('CASE WHEN z BETWEEN mid[1] AND mid[30] THEN n[j] + (n[j + 1] - n[j]) * (z - mid[j]) / (mid[j + 1] - mid[j]) ELSE 0.0 END * 1e9', 'nbar_e9', 3)} FROM p""")
def nz_density(spark, sf_dir):
    """n(z) per volume (times 10^9), evaluated for every event."""
    e = events_z(spark, sf_dir)
    n = density.RedshiftDensity(e, "z", NZ_EDGES, fsky=0.42, distance=cosmology().distance)
    return rounded(e.withColumn("nbar_e9", n.column(F.col("z")) * 1e9), "nbar_e9", digits=3)


@query("SELECT round(sum(l_quantity * l_extendedprice) / sum(l_extendedprice), 6) AS zeff FROM lineitem")
def effective_redshift(spark, sf_dir):
    return density.effective_redshift(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("zeff", 6).alias("zeff"))


@query("""SELECT count(*) AS csize, min(l_quantity) AS cmin, max(l_quantity) AS cmax, sum(l_quantity) AS csum, round(avg(l_quantity), 6) AS cmean, round(stddev_pop(l_quantity), 6) AS cstd,
round(sum(l_quantity * w) / sum(w), 6) AS caverage, round((sum(w * l_quantity * l_quantity) - sum(w * l_quantity) ** 2 / sum(w)) * sum(w) / (sum(w) ** 2 - sum(w * w)), 4) AS cvar
FROM (SELECT l_quantity::DOUBLE AS l_quantity, 1.0 + l_discount AS w FROM lineitem)""")
def collective_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("q"), (F.col("l_discount") + 1.0).alias("w"))
    s = density.statistics(rows, "q", "w")
    return s.select("csize", "cmin", "cmax", "csum", *[F.round(c, d).alias(c) for c, d in (("cmean", 6), ("cstd", 6), ("caverage", 6), ("cvar", 4))])


@query("SELECT l_suppkey, count(*) AS counts, min(l_orderkey) AS first_index FROM lineitem GROUP BY l_suppkey")
def unique_counts(spark, sf_dir):
    return density.unique_counts(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_orderkey")


@query("SELECT event_type, count(*) AS ndata, round(count(*) / 100.0, 6) AS density FROM events WHERE value > 100 AND value < 300 GROUP BY event_type")
def region_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    areas = e.select("event_type").distinct().withColumn("area", F.lit(100.0))
    return density.region_counts(e, "event_type", "value", (100, 300), areas).withColumn("density", F.round("density", 6))


@query("""WITH e AS (SELECT vec_id, unnest(range(64))::INT AS i, embedding FROM embeddings), p AS (SELECT a.i, b.i AS j, a.embedding[a.i + 1]::DOUBLE AS x, a.embedding[b.i + 1]::DOUBLE AS y FROM e a JOIN e b USING (vec_id))
SELECT i, j, round(covar_samp(x, y), 8) + 0.0 AS cov FROM p GROUP BY i, j""")
def covariance_matrix(spark, sf_dir):
    return density.array_covariance(table(spark, sf_dir, "embeddings"), "embedding").select("i", "j", (F.round("cov", 8) + 0.0).alias("cov"))


@query("""WITH l AS (SELECT l_suppkey % 20 AS m, l_linenumber AS i, avg(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT a.i, b.i AS j, round(covar_samp(a.v, b.v), 6) + 0.0 AS cov FROM l a JOIN l b USING (m) GROUP BY a.i, b.i""")
def covariance_over_mocks(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("m"), F.col("l_linenumber").alias("k")).agg(F.avg("l_quantity").alias("v"))  # noqa: E741
    return density.covariance(l, "m", "k", "v").select("i", "j", (F.round("cov", 6) + 0.0).alias("cov"))


@query(f"""WITH b AS ({box_sql()}), p AS (SELECT sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2) AS d FROM b a JOIN b ON a.row_id < b.row_id WHERE abs(a.x - b.x) <= 40.0 AND abs(a.y - b.y) <= 40.0 AND abs(a.z - b.z) <= 40.0)
SELECT k::INT AS bin, (SELECT count(*) FROM p WHERE d >= 10.0 * k AND (d < 10.0 * (k + 1) OR k = 3 AND d = 40.0)) AS pairs FROM (SELECT unnest(range(4)) AS k)""")
def pair_counts(spark, sf_dir):
    b = orders_box(spark, sf_dir).df
    return density.pair_counts(b, b, [0.0, 10.0, 20.0, 30.0, 40.0], auto=True).select("bin", "pairs")


@query("SELECT 's' AS axis, unnest(range(0, 152, 4))::DOUBLE AS edge UNION ALL SELECT 'mu', round(unnest(range(0, 201)) / 100.0 - 1.0, 9)")
def correlation_edges(spark, sf_dir):
    s, mu = density.correlation_edges("smu")
    return spark.createDataFrame([("s", float(x)) for x in s] + [("mu", round(float(x), 9) + 0.0) for x in mu], "axis string, edge double")


Z2 = np.concatenate([[0.0], np.geomspace(1e-3, 2.0, 31)])
D2 = cosmology().distance(Z2)


@query(f"WITH s AS ({SKY}) SELECT row_id, {r6(_linear_sql('d', D2, Z2), 'z')} FROM s")
def distance_to_redshift_linear(spark, sf_dir):
    s = orders_sky(spark, sf_dir)
    return rounded(s.withColumn("z", Spline(D2, Z2, 1, "raise").column(F.col("d"))), "z")


@query(f"WITH s AS ({SKY}) SELECT row_id, true AS ok FROM s")
def distance_to_redshift(spark, sf_dir):
    """Cubic inverse of the distance, checked by the way back."""
    c = cosmology()
    inv = DistanceToRedshift(c.distance, 2.0)
    z = orders_sky(spark, sf_dir).withColumn("z", inv.column(F.col("d")))
    from skyloom.functions.interp import numpy_column

    return z.select("row_id", (F.abs(numpy_column(c.distance)(F.col("z")) - F.col("d")) < 1e-4).alias("ok"))


@query(f"WITH b AS ({box_sql()}) SELECT row_id, {r6('x', POS[0])} FROM b ORDER BY x, row_id")
def global_sort(spark, sf_dir):
    return rounded(orders_box(spark, sf_dir).df.orderBy("Position_x", "row_id"), POS[0])


@query("SELECT l_suppkey, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM lineitem GROUP BY l_suppkey")
def key_clustered(spark, sf_dir):
    """Rows of a key in one place, sorted: one exchange serves both aggregates."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey").repartition("l_suppkey").sortWithinPartitions("l_suppkey")
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query(f"WITH b AS ({box_sql()}) SELECT row_id, {', '.join(r6(a, p) for a, p in zip('xyz', POS))}, CASE WHEN row_id % 2 = 0 THEN row_id ELSE -1 END AS mark FROM b UNION ALL SELECT row_id, {', '.join(r6(f'{a} + 5.0', p) for a, p in zip('xyz', POS))}, -1 FROM b")
def concatenate(spark, sf_dir):
    """Two catalogs, one of which lacks a column."""
    from dataclasses import replace

    b = orders_box(spark, sf_dir)
    marked = replace(b, df=b.df.withColumn("mark", F.when(F.col("row_id") % 2 == 0, F.col("row_id"))))
    both = marked.concatenate(b.translate(5.0)).df
    return rounded(both.withColumn("mark", F.coalesce("mark", F.lit(-1))), *POS, keep=("row_id", "mark"))


@query("SELECT n_nationkey::BIGINT AS row_id, n_nationkey * 1.5::DOUBLE AS Position_x, n_regionkey * 2.0::DOUBLE AS Position_y, (n_nationkey - n_regionkey)::DOUBLE AS Position_z, length(n_name)::BIGINT AS size FROM nation")
def catalog_from_arrays(spark, sf_dir):
    """Arrays of the driver, one of them of vectors."""
    from skyloom.operators.catalog import ParticleCatalog

    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    key, region = (np.array([r[c] for r in rows], np.int64) for c in ("n_nationkey", "n_regionkey"))
    data = {"row_id": key, "Position": np.stack([key * 1.5, region * 2.0, key - region], 1), "size": np.array([len(r.n_name) for r in rows], np.int64)}
    return ParticleCatalog.from_arrays(spark, data).df.select("row_id", *POS, "size")


@query(f"""WITH b AS ({box_sql()}), k AS (SELECT *, 1 / sqrt(3.0) AS c, sqrt(2.0 / 3.0) AS s, -1 / sqrt(2.0) AS ky, 1 / sqrt(2.0) AS kz FROM b), d AS (SELECT *, ky * y + kz * z AS along FROM k)
SELECT row_id, {r6('c * x + s * (ky * z - kz * y)', POS[0])}, {r6('c * y + s * kz * x + ky * along * (1 - c)', POS[1])}, {r6('c * z - s * ky * x + kz * along * (1 - c)', POS[2])} FROM d""")
def rotate_between(spark, sf_dir):
    """The rotation that takes the x axis to the diagonal, in the form of Rodrigues."""
    b = orders_box(spark, sf_dir)
    return rounded(b.isometry(Isometry(g.rotation_between((1.0, 0.0, 0.0), (1.0, 1.0, 1.0)))).df, *POS)


@query(f"WITH b AS ({box_sql(center=(100.0, 200.0, 200.0), velocity=10.0)}), l AS (SELECT *, (vx + 2 * vy + 2 * vz) / 3 AS v FROM b) SELECT row_id, {', '.join(r6(f'{a} + 0.414213562 * v * {n} / 3', p) for a, n, p in zip('xyz', (1, 2, 2), POS))} FROM l")
def rsd_global(spark, sf_dir):
    """Along the direction of the box's centre."""
    b = orders_box(spark, sf_dir, center=(100.0, 200.0, 200.0), velocity=10.0)
    return rounded(b.with_vectors({"Position": b.rsd_position(0.414213562, b.global_los)}).df, *POS)


@query("SELECT region, ra::DOUBLE AS ra, dec::DOUBLE AS dec FROM (VALUES ('DN', 192.0, 13.0), ('DS', 6.4, 5.3), ('N', 192.3, 56.0), ('N+DN', 192.0, 35.0), ('N+SNGC', 192.0, 35.0), ('SNGC', 192.0, 13.0), ('SSGC', 6.4, 5.3)) t(region, ra, dec)")
def region_centers(spark, sf_dir):
    return spark.createDataFrame([(r, *masks.region_center(r)) for r in sorted(masks.REGION_CENTERS)], "region string, ra double, dec double")
