"""Queries over tiles, bricks, fibres, smearing, meshes, mocks and blinding, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyloom.functions import geometry as g
from skyloom.functions.cosmology import cosmology
from skyloom.functions.distributions import TruncatedCauchy, TruncatedNormal
from skyloom.functions.rng import u01, u01_sql
from skyloom.operators import blinding, bricks, fibers, footprint, mesh, mocks, smearing
from skyloom.operators.scratch import settled, shared_folder
from skyloom.plans.sky import POS, SKY, _linear_sql, box_sql, orders_box, orders_sky, r6, rounded, table
from skyloom.sources import files
from skyloom.streaming.nz import streaming_nz

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# tiles: one a supplier, three passes by key
def tiles(spark, sf_dir):
    i = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(i.alias("TILEID"), F.round(u01(i, 3, "tra") * 360.0, 6).alias("RA"), F.round(u01(i, 3, "tdec") * 160.0 - 80.0, 6).alias("DEC"), (i % 3).cast("int").alias("PASS"))


TILES = f"SELECT s_suppkey AS TILEID, round({u01_sql('s_suppkey', 3, 'tra')} * 360.0, 6) AS tra, round({u01_sql('s_suppkey', 3, 'tdec')} * 160.0 - 80.0, 6) AS tdec, (s_suppkey % 3)::INT AS PASS FROM supplier"
R = 8.0
HAV = "sin(radians(dec - tdec) / 2) ** 2 + cos(radians(dec)) * cos(radians(tdec)) * sin(radians(ra - tra) / 2) ** 2"
HITS = f"s AS ({SKY}), t AS ({TILES}), h AS (SELECT row_id, TILEID, PASS FROM s, t WHERE {HAV} <= sin(radians({R}) / 2) ** 2)"


def points(spark, sf_dir):
    return orders_sky(spark, sf_dir).select("row_id", F.col("ra").alias("RA"), F.col("dec").alias("DEC"))


@query(f"WITH {HITS} SELECT row_id, TILEID FROM h")
def point_in_tile(spark, sf_dir):
    return footprint.points_in_tiles(points(spark, sf_dir), tiles(spark, sf_dir), R)


@query(f"WITH {HITS} SELECT s.row_id, count(DISTINCT TILEID) >= 2 AS in_footprint FROM s LEFT JOIN h USING (row_id) GROUP BY s.row_id")
def footprint_passes(spark, sf_dir):
    return footprint.in_footprint(points(spark, sf_dir), tiles(spark, sf_dir), 2, radius=R).select("row_id", "in_footprint")


@query(f"WITH {HITS} SELECT s.row_id, coalesce(min(TILEID), -1) AS TILEID FROM s LEFT JOIN (SELECT * FROM h WHERE PASS = 1) USING (row_id) GROUP BY s.row_id")
def first_tile_of_pass(spark, sf_dir):
    return footprint.tile_of_pass(points(spark, sf_dir), tiles(spark, sf_dir), 1, radius=R).select("row_id", "TILEID")


@query(f"WITH {HITS} SELECT DISTINCT row_id FROM h JOIN s USING (row_id) WHERE dec < 32.375 AND ra > 100 - dec AND ra < 280 + dec")
def footprint_photometric(spark, sf_dir):
    from skyloom.operators.masks import photometric_region

    p = points(spark, sf_dir).where(photometric_region(F.col("RA"), F.col("DEC"), "DN"))
    return footprint.in_footprint(p, tiles(spark, sf_dir), radius=R).where("in_footprint").select("row_id")


@query("SELECT s_suppkey AS ROSETTE_NUMBER, unnest([s_suppkey * 2, s_suppkey * 2 + 1]) AS TILEID, 'S' AS region FROM supplier")
def rosette_tiles(spark, sf_dir):
    r = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ROSETTE_NUMBER"), F.lit(10.0).alias("RA"), F.lit(0.0).alias("DEC"), F.concat_ws(",", F.col("s_suppkey") * 2, F.col("s_suppkey") * 2 + 1).alias("TILEID"))
    return footprint.rosette_tiles(r).select("ROSETTE_NUMBER", "TILEID", "region")


@query("SELECT s_suppkey AS TILEID, 1 AS OBSCONDITIONS FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 < 3 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 45)")
def tiles_for_program(spark, sf_dir):
    i = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(i.alias("TILEID"), F.when(i % 2 == 0, "DARK").otherwise("BRIGHT").alias("PROGRAM"), (i % 5).alias("PASS"))
    seen = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("TILEID"))
    return files.tiles_for_program(t, seen, "DARK", 3).select("TILEID", "OBSCONDITIONS")


@query("SELECT s_suppkey AS TILEID, s_acctbal AS RA FROM supplier WHERE s_suppkey % 3 = 0 AND 20220600 + s_suppkey % 30 <= 20220613")
def tiles_for_release(spark, sf_dir):
    i = F.col("s_suppkey")
    t = table(spark, sf_dir, "supplier").select(i.alias("TILEID"), F.col("s_acctbal").alias("TILERA"), F.lit(0.0).alias("TILEDEC"), F.lit("main").alias("SURVEY"), F.when(i % 3 == 0, "dark").otherwise("bright").alias("FAPRGRM"), (F.lit(20220600) + i % 30).alias("LASTNIGHT"))
    return files.tiles_for_release(t, "y1").select("TILEID", "RA")


@query("SELECT DISTINCT substr(lpad(s_suppkey::VARCHAR, 6, '0'), 1, 3) || '/' || lpad(s_suppkey::VARCHAR, 6, '0') || '.fits' AS path FROM supplier")
def tile_file_list(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in files.tile_files(tiles(spark, sf_dir))], "path string")


BRICKS = f"""s AS ({SKY}), r AS (SELECT row_id, ra, dec, floor((dec + 90.125) / 0.25)::INT AS brickrow FROM s), m AS (SELECT *, brickrow * 0.25 - 90.0 AS mid FROM r),
n AS (SELECT *, CASE WHEN brickrow IN (0, 720) THEN 1 ELSE (ceil(1440.0 * cos(radians(greatest(0.0, abs(mid) - 0.125))) / 2) * 2)::INT END AS n FROM m),
b AS (SELECT *, least(floor(ra * n / 360.0), n - 1)::INT AS brickcol FROM n)"""


@query(f"WITH {BRICKS} SELECT row_id, brickrow, brickcol, CASE WHEN mid > 32.375 THEN 'N' ELSE 'S' END AS photsys FROM b")
def brick_lookup(spark, sf_dir):
    return bricks.with_bricks(points(spark, sf_dir)).select("row_id", "brickrow", "brickcol", "photsys")


@query(f"WITH {BRICKS} SELECT row_id, CASE WHEN (brickrow + brickcol) % 4 = 0 THEN 7 ELSE ((brickrow * 7 + brickcol) % 64) END::SMALLINT AS maskbits FROM b")
def brick_pixels(spark, sf_dir):
    """Each brick's image has one value here, told by its name; a quarter of the bricks have none and give the default."""
    b = settled(bricks.with_bricks(points(spark, sf_dir)), "bricks")
    numbers = {r.brickname: (r.brickrow, r.brickcol) for r in b.select("brickname", "brickrow", "brickcol").distinct().collect()}  # at most the bricks of the sky

    def open_(name, region):
        row, col = numbers[name]
        return None if (row + col) % 4 == 0 else (np.full((80, 80), (row * 7 + col) % 64, np.int16), 0.3 / 60, 39.5)

    return bricks.pixel_values(points(spark, sf_dir), {"maskbits": (open_, 7)}, "maskbits short").select("row_id", "maskbits")


@query()
def brick_images(spark, sf_dir):
    """Pixel values through per-brick images that a callable opens on the executors."""
    def open_(name, region):
        if int(name[:4]) % 3 == 0:
            return None
        y, x = np.mgrid[0:64, 0:64]
        return ((x + y + len(region)) % 32).astype(np.int16), 0.25 / 64, 31.5

    return bricks.pixel_values(points(spark, sf_dir), {"maskbits": (open_, -1)}, "maskbits short").select("row_id", "maskbits")


# fibres: targets are customers, each within reach of two fibres of a tile by key arithmetic
def targets(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), (F.col("c_custkey") % 3).alias("PRIORITY"))
    return fibers.prepared_targets(c, "row_id")


def reach(spark, sf_dir):
    i = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(i.alias("TARGETID"), (i % 7).alias("TILEID"), F.explode(F.array(i % 40, (i * 13 + 5) % 40)).alias("FIBER")).distinct()


TARGETS = f"t AS (SELECT c_custkey AS TARGETID, c_custkey % 3 AS p, {u01_sql('c_custkey', 44, 'sub')} AS s FROM customer), r AS (SELECT DISTINCT c_custkey AS TARGETID, c_custkey % 7 AS TILEID, unnest([c_custkey % 40, (c_custkey * 13 + 5) % 40]) AS FIBER FROM customer)"
GREEDY = f"""{TARGETS}, b1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY TILEID, FIBER ORDER BY p DESC, s DESC, TARGETID) AS k FROM r JOIN t USING (TARGETID)) WHERE k = 1),
g1 AS (SELECT TARGETID, TILEID, min(FIBER) AS FIBER FROM b1 GROUP BY ALL),
o AS (SELECT * FROM r JOIN t USING (TARGETID) WHERE (TILEID, FIBER) NOT IN (SELECT (TILEID, FIBER) FROM g1) AND (TILEID, TARGETID) NOT IN (SELECT (TILEID, TARGETID) FROM g1)),
b2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY TILEID, FIBER ORDER BY p DESC, s DESC, TARGETID) AS k FROM o) WHERE k = 1),
g AS (SELECT * FROM g1 UNION ALL SELECT TARGETID, TILEID, min(FIBER) FROM b2 GROUP BY ALL)"""


@query(f"WITH {GREEDY} SELECT TARGETID, TILEID, FIBER FROM g")
def fiber_greedy(spark, sf_dir):
    return fibers.greedy(reach(spark, sf_dir), targets(spark, sf_dir), rounds=2)


@query(f"WITH {GREEDY} SELECT r.TARGETID, r.TILEID, min(r.FIBER) AS FIBER FROM r JOIN (SELECT DISTINCT TILEID, FIBER FROM g) u USING (TILEID, FIBER) GROUP BY r.TARGETID, r.TILEID")
def fiber_available(spark, sf_dir):
    r = reach(spark, sf_dir)
    return fibers.available(r, fibers.greedy(r, targets(spark, sf_dir), rounds=2))


@query(f"""WITH {GREEDY}, ok AS (SELECT tile AS TILEID, fiber AS FIBER FROM (SELECT unnest(range(7)) AS tile), (SELECT unnest(range(40)) AS fiber) WHERE fiber % 11 <> 3),
a AS (SELECT r.TARGETID, min(r.FIBER) AS FIBER, r.TILEID FROM r JOIN (SELECT DISTINCT TILEID, FIBER FROM g) u USING (TILEID, FIBER) GROUP BY r.TARGETID, r.TILEID),
ga AS (SELECT g.* FROM g JOIN ok USING (TILEID, FIBER)), aa AS (SELECT a.* FROM a JOIN ok USING (TILEID, FIBER))
SELECT t.TARGETID, ga.FIBER IS NOT NULL OR aa.FIBER IS NOT NULL AS AVAILABLE, coalesce(ga.FIBER, aa.FIBER, -1) AS FIBER, (ga.FIBER IS NOT NULL)::BIGINT AS NUMOBS, 1 - (ga.FIBER IS NOT NULL)::BIGINT AS NUMOBS_MORE
FROM t LEFT JOIN ga USING (TARGETID) LEFT JOIN aa USING (TARGETID)""")
def mtl_update(spark, sf_dir):
    r, t = reach(spark, sf_dir), targets(spark, sf_dir)
    got = settled(fibers.greedy(r, t, rounds=2))
    z = spark.range(7).select(F.col("id").alias("TILEID"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("FIBER")).withColumn("ZWARN", F.when(F.col("FIBER") % 11 == 3, 1 << 9).otherwise(0))
    return fibers.mtl_update(t, got, fibers.available(r, got), z).select("TARGETID", "AVAILABLE", "FIBER", "NUMOBS", "NUMOBS_MORE")


def history(spark, sf_dir):
    o, t = F.col("o_orderkey"), F.col("TARGETID")
    h = table(spark, sf_dir, "orders").select((o % 1000).alias("TARGETID"), (F.floor(o / 1000) % 3).cast("int").alias("PASS"), (o % 5).alias("TILEID"), o.alias("o"))
    h = h.groupBy("TARGETID", "PASS").agg(F.min("TILEID").alias("TILEID"), F.min("o").alias("o"))
    f = F.when(F.col("o") % 9 == 0, -1).otherwise((t * 7) % 60)
    return h.select("TARGETID", "PASS", "TILEID", f.alias("FIBER"), (((F.floor(t / 60) + F.col("PASS")) % 6 == 0) & (F.col("o") % 9 != 0)).alias("OBSERVED"))


HISTORY = """h0 AS (SELECT o_orderkey % 1000 AS TARGETID, (o_orderkey // 1000 % 3)::INT AS PASS, min(o_orderkey % 5) AS TILEID, min(o_orderkey) AS o FROM orders GROUP BY 1, 2),
h AS (SELECT TARGETID, PASS, TILEID, CASE WHEN o % 9 = 0 THEN -1 ELSE TARGETID * 7 % 60 END AS FIBER, (TARGETID // 60 + PASS) % 6 = 0 AND o % 9 <> 0 AS OBSERVED FROM h0)"""


@query(f"""WITH {HISTORY}, never AS (SELECT TARGETID FROM h GROUP BY TARGETID HAVING NOT bool_or(OBSERVED)),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY TARGETID ORDER BY PASS) AS k FROM h WHERE FIBER <> -1 AND TARGETID IN (SELECT TARGETID FROM never)) WHERE k = 1),
x AS (SELECT PASS, TILEID, FIBER, count(*) AS extra FROM f GROUP BY ALL)
SELECT t.TARGETID, w.weight AS COMP_WEIGHT FROM (SELECT DISTINCT TARGETID FROM h) t LEFT JOIN (SELECT TARGETID, 1.0 + coalesce(sum(extra), 0)::DOUBLE AS weight FROM h LEFT JOIN x USING (PASS, TILEID, FIBER) WHERE OBSERVED GROUP BY TARGETID) w USING (TARGETID)""")
def completeness(spark, sf_dir):
    h = history(spark, sf_dir)
    w = fibers.completeness_weights(h.select("TARGETID").distinct(), h)
    return w.select("TARGETID", F.when(~F.isnan("COMP_WEIGHT"), F.col("COMP_WEIGHT")).alias("COMP_WEIGHT"))


NEVER = "never AS (SELECT TARGETID FROM h GROUP BY TARGETID HAVING NOT bool_or(OBSERVED) AND max(FIBER) <> -1)"


@query(f"""WITH {HISTORY}, {NEVER}, unused AS (SELECT TARGETID FROM never WHERE TARGETID NOT IN (SELECT TARGETID FROM h WHERE PASS = 0 AND FIBER <> -1)),
x AS (SELECT TILEID, FIBER, count(*) AS extra FROM h JOIN unused USING (TARGETID) WHERE PASS = 1 AND FIBER <> -1 GROUP BY ALL)
SELECT TARGETID, extra FROM h JOIN x USING (TILEID, FIBER) WHERE PASS = 1 AND OBSERVED""")
def completeness_one_pass(spark, sf_dir):
    """The second pass, after the first has used up its targets."""
    h = history(spark, sf_dir)
    _, unused = fibers.completeness_one_pass(h, 0, fibers.never_observed(h))
    return fibers.completeness_one_pass(h, 1, unused)[0]


@query(f"""WITH {HISTORY}, {NEVER}, k AS (SELECT unnest([0, 1, 2])::INT AS PASS)
SELECT PASS, (SELECT count(*) FROM never WHERE TARGETID NOT IN (SELECT TARGETID FROM h WHERE h.PASS <= k.PASS AND FIBER <> -1)) AS remaining FROM k
WHERE (SELECT count(*) FROM never WHERE TARGETID NOT IN (SELECT TARGETID FROM h WHERE h.PASS <= k.PASS AND FIBER <> -1)) > 0""")
def completeness_remaining(spark, sf_dir):
    """How many unobserved targets are left to count after each pass."""
    h = history(spark, sf_dir)
    return fibers.completeness_by_pass(h.select("TARGETID").distinct(), h, 3)[1]


@query()
def assign_passes(spark, sf_dir):
    """Three dependent passes over tiles and fibres on the sky."""
    t = fibers.prepared_targets(points(spark, sf_dir), "row_id")
    ti = tiles(spark, sf_dir)
    f = ti.select("TILEID", F.col("RA").alias("r0"), F.col("DEC").alias("d0"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("FIBER"))
    f = f.select("TILEID", "FIBER", F.pmod(F.col("r0") + (F.col("FIBER") % 4 - 1.5) * 2, F.lit(360.0)).alias("RA"), (F.col("d0") + (F.floor(F.col("FIBER") / 4) - 1.5) * 2).alias("DEC"))
    state, h = fibers.assign_passes(t, ti, f, 3, R, 1.2)
    return fibers.pass_arrays(fibers.completeness_weights(state, h), h, 3).select("TARGETID", "NUMOBS", "AVAILABLE", "FIBER", "OBS_PASS", "COMP_WEIGHT")


EV = "SELECT event_id AS row_id, 0.2 + value / 200.0 AS z FROM events"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), (0.2 + F.col("value") / 200.0).alias("z"))


@query()
def smearing_qso(spark, sf_dir):
    return smearing.smeared(events(spark, sf_dir), "z", "QSO", "row_id")


@query()
def smearing_lrg(spark, sf_dir):
    return smearing.smeared(events(spark, sf_dir), "z", "LRG", "row_id")


@query(f"WITH e AS ({EV}) SELECT row_id, round(z + ({u01_sql('row_id', 13, 'smear')} - 0.5) * 0.02, 6) AS z FROM e")
def smearing_uniform(spark, sf_dir):
    """A flat error of width 0.02 at all redshifts, whose inverse is linear."""
    s = smearing.RedshiftSmearing([0.0, 3.0], [-0.01, 0.01], [[0.0, 0.0], [1.0, 1.0]])
    e = events(spark, sf_dir)
    return e.select("row_id", F.round(F.col("z") + s.column(F.col("row_id"), F.col("z"), 13), 6).alias("z"))


XS = [-1.6, -0.6, -0.25, 0.0, 0.2, 0.55, 0.9, 1.1, 2.1]
QS = [0.0, 0.1, 0.35, 0.5, 0.8, 1.0]


HEIGHT = "sum(exp(-0.5 * ((-0.6 + (i + 0.5) * h - 0.2) / 0.8) ** 2)) * h"


@query(f"""WITH x AS (SELECT x, (least(greatest(x, -0.6), 1.1) + 0.6) / 2000 AS h FROM (SELECT unnest({XS})::DOUBLE AS x)), i AS (SELECT unnest(range(2000)) AS i),
g AS (SELECT x, {HEIGHT} AS below FROM x, i GROUP BY x, h), w AS (SELECT {HEIGHT} AS whole FROM (SELECT 1.7 / 2000 AS h), i GROUP BY h),
c AS (SELECT 'cauchy' AS dist, x, (atan((least(greatest(x, -0.6), 1.1) - 0.2) / 0.8) - atan(-1.0)) / (atan(0.9 / 0.8) - atan(-1.0)) AS cdf, CASE WHEN x BETWEEN -0.6 AND 1.1 THEN 1 / (1 + ((x - 0.2) / 0.8) ** 2) / 0.8 / (atan(0.9 / 0.8) - atan(-1.0)) ELSE 0.0 END AS pdf FROM x
UNION ALL SELECT 'normal', x, below / whole, CASE WHEN x BETWEEN -0.6 AND 1.1 THEN exp(-0.5 * ((x - 0.2) / 0.8) ** 2) / whole ELSE 0.0 END FROM g, w)
SELECT dist, x, {r6('cdf', 'cdf')}, {r6('pdf', 'pdf')} FROM c""")
def truncated_distributions(spark, sf_dir):
    rows = []
    for n, d in (("cauchy", TruncatedCauchy(0.2, 0.8, -0.6, 1.1)), ("normal", TruncatedNormal(0.2, 0.8, -0.6, 1.1))):
        rows += [(n, x, round(float(d.cdf(x)), 6) + 0.0, round(float(d.pdf(x)), 6) + 0.0) for x in XS]
    return spark.createDataFrame(rows, "dist string, x double, cdf double, pdf double")


@query(f"""WITH q AS (SELECT unnest({QS})::DOUBLE AS q), c AS (SELECT q, 0.2 + 0.8 * tan(atan(-1.0) + q * (atan(0.9 / 0.8) - atan(-1.0))) AS x FROM q) SELECT q, {r6('x', 'x')} FROM c""")
def truncated_ppf(spark, sf_dir):
    d = TruncatedCauchy(0.2, 0.8, -0.6, 1.1)
    return spark.createDataFrame([(q, round(float(d.ppf(q)), 6)) for q in QS], "q double, x double")


N = 16
GRID = mesh.Grid(N, 1000.0)
FIELD = "SELECT ix, iy, iz, sin(ix * 0.7) + cos(iy * 1.3) * iz AS v FROM (SELECT unnest(range(16)) AS ix), (SELECT unnest(range(16)) AS iy), (SELECT unnest(range(16)) AS iz)"


def field(spark):
    return mesh.make_real(spark, GRID, lambda i, gr: np.sin(i * 0.7) + np.cos(np.arange(gr.n)[:, None] * 1.3) * np.arange(gr.n)[None, :])


def _readout_sql(weights: str) -> str:
    return f"""WITH b AS ({box_sql()}), f AS ({FIELD}), c AS (SELECT row_id, (x + 500.0) / 62.5 AS x, (y + 500.0) / 62.5 AS y, (z + 500.0) / 62.5 AS z FROM b), {weights}
SELECT row_id, {r6('sum(a.w * b2.w * c2.w * f.v)', 'value')} FROM ax a JOIN ay b2 USING (row_id) JOIN az c2 USING (row_id) JOIN f ON f.ix = a.i AND f.iy = b2.i AND f.iz = c2.i GROUP BY row_id"""


CIC = ", ".join(f"a{a} AS (SELECT row_id, (floor({a})::INT + s) % 16 AS i, CASE s WHEN 0 THEN 1 - ({a} - floor({a})) ELSE {a} - floor({a}) END AS w FROM c, (SELECT unnest([0, 1]) AS s))" for a in "xyz")
NGP = ", ".join(f"a{a} AS (SELECT row_id, floor({a})::INT % 16 AS i, 1.0 AS w FROM c)" for a in "xyz")


@query(_readout_sql(CIC))
def mesh_readout_cic(spark, sf_dir):
    return rounded(mesh.readout(field(spark), GRID, orders_box(spark, sf_dir).df), "value")


@query(_readout_sql(NGP))
def mesh_readout_ngp(spark, sf_dir):
    return rounded(mesh.readout(field(spark), GRID, orders_box(spark, sf_dir).df, "ngp"), "value")


TSC = ", ".join(f"a{a} AS (SELECT row_id, (floor({a} + 0.5)::INT + s + 16) % 16 AS i, CASE s WHEN -1 THEN 0.5 * (0.5 - d) ** 2 WHEN 0 THEN 0.75 - d * d ELSE 0.5 * (0.5 + d) ** 2 END AS w FROM (SELECT *, {a} - floor({a} + 0.5) AS d FROM c), (SELECT unnest([-1, 0, 1]) AS s))" for a in "xyz")
PCS = ", ".join(f"a{a} AS (SELECT row_id, (floor({a})::INT + s + 16) % 16 AS i, CASE WHEN u < 1 THEN (4 - 6 * u ** 2 + 3 * u ** 3) / 6 ELSE (2 - u) ** 3 / 6 END AS w FROM (SELECT *, abs({a} - floor({a}) - s) AS u FROM c, (SELECT unnest([-1, 0, 1, 2]) AS s)))" for a in "xyz")


@query(_readout_sql(TSC))
def mesh_readout_tsc(spark, sf_dir):
    return rounded(mesh.readout(field(spark), GRID, orders_box(spark, sf_dir).df, "tsc"), "value")


@query(_readout_sql(PCS))
def mesh_readout_pcs(spark, sf_dir):
    return rounded(mesh.readout(field(spark), GRID, orders_box(spark, sf_dir).df, "pcs"), "value")


@query(f"WITH b AS ({box_sql()}) SELECT (floor((x + 500.0) / 62.5)::INT % 16)::INT AS ix, count(*)::DOUBLE AS mass FROM b GROUP BY 1")
def mesh_paint(spark, sf_dir):
    p = mesh.paint(orders_box(spark, sf_dir).df, GRID, "ngp")
    return p.select("ix", F.aggregate("v", F.lit(0.0), lambda s, x: s + x).alias("mass")).where("mass > 0")


@query("SELECT 16 * 16 * 16 AS cells, round(avg(v), 6) AS mean, round(var_pop(v), 6) AS variance FROM (" + FIELD + ")")
def mesh_moments(spark, sf_dir):
    m = mesh.moments(field(spark))
    return m.select(F.col("cells").cast("int").alias("cells"), F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))


@query("SELECT ix::INT AS ix, iy::INT AS iy, iz::INT AS iz, round(v, 6) + 0.0 AS v FROM (" + FIELD + ")")
def mesh_fft_round_trip(spark, sf_dir):
    back = mesh.c2r(mesh.r2c(field(spark), N), N).select("ix", F.posexplode("v").alias("at", "v"))
    return back.select("ix", F.floor(F.col("at") / N).cast("int").alias("iy"), (F.col("at") % N).cast("int").alias("iz"), (F.round("v", 6) + 0.0).alias("v"))


def power(k):
    return 2e4 * k / (1 + (k / 0.02) ** 3)


@query()
def gaussian_power(spark, sf_dir):
    m = mocks.GaussianMock.from_power(spark, power, nmesh=N, boxsize=1000.0, seed=1)
    return mesh.power_spectrum(m.delta_k, m.grid, np.arange(0.003, 0.06, 0.01))


MODES = "SELECT sqrt((x * x + y * y + z * z)::DOUBLE) * 2 * pi() / 1000.0 AS k FROM (SELECT unnest(range(-8, 8)) AS x), (SELECT unnest(range(-8, 8)) AS y), (SELECT unnest(range(-8, 8)) AS z)"


@query(f"""WITH m AS ({MODES}), e AS (SELECT unnest([0, 1, 2]) AS bin, [0.003, 0.02, 0.04, 0.05]::DOUBLE[] AS e)
SELECT bin::INT AS bin, {r6('avg(k)', 'k')}, 100.0::DOUBLE AS power, count(*)::DOUBLE AS modes FROM e, m WHERE k >= e[bin + 1] AND k < e[bin + 2] GROUP BY bin""")
def gaussian_unitary(spark, sf_dir):
    """Unit amplitudes give the power spectrum without scatter; modes are counted by wave numbers."""
    m = mocks.GaussianMock.from_power(spark, lambda k: 100.0 + 0 * k, nmesh=N, boxsize=1000.0, unitary=True, inverted=True)
    return rounded(mesh.power_spectrum(m.delta_k, m.grid, [0.003, 0.02, 0.04, 0.05]), "k", "power", keep=("bin", "modes"))


@query()
def shot_noise_field(spark, sf_dir):
    m = mocks.GaussianMock.from_power(spark, power, nmesh=N, boxsize=1000.0).with_real().with_white_noise(1e-3)
    return mesh.moments(m.delta)


@query()
def poisson_catalog(spark, sf_dir):
    m = mocks.GaussianMock.from_power(spark, power, nmesh=N, boxsize=1000.0).with_real(lognormal=True).with_selection(1e-5)
    return m.to_catalog().df


@query()
def zeldovich_catalog(spark, sf_dir):
    m = mocks.LagrangianMock.from_power(spark, power, nmesh=N, boxsize=1000.0, los="x").with_real(lognormal=True).with_selection(1e-5)
    return m.with_rsd(settled(m.poisson_sample()), 0.8)


BLIND = blinding.Blinding(blind={"Omega_m": 0.3, "h": 0.6736, "sigma8": 0.8, "n_s": 0.9649, "w0": -0.95}, zmax=3.0)


@query(f"WITH b AS ({box_sql(center=(1500.0, 0.0, 0.0))}) SELECT row_id, true AS moved_along_sight FROM b")
def blind_ap(spark, sf_dir):
    """Directions stay, and the new distance is the blind one at the old redshift."""
    b = orders_box(spark, sf_dir, center=(1500.0, 0.0, 0.0)).df
    out = BLIND.ap(b.withColumns({f"o{a}": F.col(f"Position_{a}") for a in "xyz"}))
    old, new = tuple(F.col(f"o{a}") for a in "xyz"), g.vector("Position")
    from skyloom.functions.interp import numpy_column

    d = numpy_column(lambda d: BLIND.blind.distance(BLIND.inverse(d)))(g.norm(old))
    cosine = g.dot(old, new) / g.norm(old) / g.norm(new)
    return out.select("row_id", ((F.abs(g.norm(new) - d) < 1e-3) & (cosine > 1 - 1e-12)).alias("moved_along_sight"))


SHARE = 0.3


@query(f"""WITH b AS ({box_sql(center=(1500.0, 0.0, 0.0))}), d AS (SELECT row_id, sqrt(x * x + y * y + z * z) AS d FROM b), m AS (SELECT * FROM d WHERE {u01_sql('row_id', 42, 'pick')} < {SHARE}),
gv AS (SELECT d AS new, row_number() OVER (ORDER BY {u01_sql('row_id', 42, 'give')}) AS r FROM m), tk AS (SELECT row_id, row_number() OVER (ORDER BY {u01_sql('row_id', 42, 'take')}) AS r FROM m)
SELECT d.row_id, {r6('coalesce(new, d)', 'Distance', 4)} FROM d LEFT JOIN (SELECT row_id, new FROM tk JOIN gv USING (r)) USING (row_id)""")
def blind_shuffle(spark, sf_dir):
    out = BLIND.shuffle(orders_box(spark, sf_dir, center=(1500.0, 0.0, 0.0)).df, fraction=SHARE)
    return rounded(out.withColumn("Distance", g.norm(g.vector("Position"))), "Distance", digits=4)


def _blind(**more):
    return blinding.Blinding(blind=("DESI", more), bias=2.0)


@query()
def blind_rsd(spark, sf_dir):
    b = orders_box(spark, sf_dir, center=(1500.0, 0.0, 0.0))
    return _blind(f=0.7).rsd(b.df, None, mesh.Grid(N, 1000.0, b.boxcenter), radius=60.0)


@query()
def blind_png(spark, sf_dir):
    b = orders_box(spark, sf_dir, center=(1500.0, 0.0, 0.0))
    return _blind(fnl=20.0).png(b.df, None, mesh.Grid(N, 1000.0, b.boxcenter), "data_weights", radius=60.0)


@query(f"""WITH b AS ({box_sql(center=(1500.0, 0.0, 0.0))}), d AS (SELECT *, sqrt(x * x + y * y + z * z) AS d FROM b)
SELECT row_id, {r6('(degrees(atan2(y, x)) + 360.0) % 360.0', 'RA')}, {r6('degrees(asin(z / d))', 'DEC')}, {r6('d', 'Distance')}, {', '.join(r6(a, p) for a, p in zip('xyz', POS))}, {r6('x + y + z', 'total')} FROM d""")
def position_formats(spark, sf_dir):
    """Cartesian to sky, back to Cartesian, and as an array."""
    b = orders_box(spark, sf_dir, center=(1500.0, 0.0, 0.0)).df
    sky = blinding.positions_out(b, "rdd").drop(*POS)
    back = blinding.positions_out(blinding.positions_in(sky, "rdd", ("RA", "DEC", "Distance")), "pos")
    return rounded(back.withColumn("total", F.aggregate("pos", F.lit(0.0), lambda t, x: t + x)), "RA", "DEC", "Distance", *POS, "total")


@query()
def blind_cosmology(spark, sf_dir):
    from skyloom.functions.cosmology import blinded

    b = blinded(cosmology(), {"Omega_m": 0.01, "f": 0.1, "fnl": 20.0})
    return spark.createDataFrame([(n, float(cosmology().get(n, 1.0)), float(b.get(n, 1.0))) for n in ("Omega_m", "omega_m", "sigma8", "fsigma8", "f", "fnl")], "name string, fiducial double, blind double")


@query(f"WITH b AS ({box_sql()}) SELECT row_id, {r6('x', POS[0])}, {r6('y', POS[1])}, {r6('z', POS[2])} FROM b")
def catalog_round_trip(spark, sf_dir):
    import uuid

    path = f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    files.write_catalog(orders_box(spark, sf_dir), path, files=2, group="1")
    return rounded(files.read_catalog(spark, path, group="1").df, *POS)


@query(f"WITH b AS ({box_sql()}) SELECT row_id, {r6('x', POS[0])}, {r6('y', POS[1])}, {r6('z', POS[2])} FROM b")
def catalog_fits_round_trip(spark, sf_dir):
    """Written as a few FITS tables and read back by executors."""
    import uuid

    path = f"{shared_folder(spark)}/fits-{uuid.uuid4().hex}"
    files.write_fits(orders_box(spark, sf_dir).df.select("row_id", *POS), path, 3)
    return rounded(files.read_fits(spark, f"{path}/*.fits", "row_id long, Position_x double, Position_y double, Position_z double"), *POS)


@query("SELECT s_suppkey AS TILEID, round(s_acctbal, 2) AS RA, 1 AS OBSCONDITIONS FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 5 < 3")
def tiles_from_csv(spark, sf_dir):
    """A CSV file whose table follows 18 lines of comment."""
    import uuid

    t = table(spark, sf_dir, "supplier").orderBy("s_suppkey").collect()  # tiles are a small table
    text = "\n".join([f"# comment {k}" for k in range(18)] + ["TILEID,PASS,PROGRAM,RA"] + [f"{r.s_suppkey},{r.s_suppkey % 5},{'DARK' if r.s_suppkey % 2 == 0 else 'BRIGHT'},{r.s_acctbal:.2f}" for r in t])
    path = f"{shared_folder(spark)}/tiles-{uuid.uuid4().hex}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    tiles_ = files.read_tiles_csv(spark, path, "TILEID long, PASS int, PROGRAM string, RA double")
    return files.tiles_for_program(tiles_, tiles_, "DARK", 3).select("TILEID", "RA", "OBSCONDITIONS")


@query("""WITH b AS (SELECT i, 0.05::DOUBLE + 0.05::DOUBLE * i AS low FROM (SELECT unnest(range(89)) AS i))
SELECT round(low, 9) AS zmin, round(low + 0.05, 9) AS zmax, (i * i % 7)::DOUBLE AS nz, round(low + 0.025, 9) AS zmid, round((low + 0.05) ** 3 - low ** 3, 9) AS volume FROM b""")
def nz_from_text(spark, sf_dir):
    """A text file of n(z) with one line of names."""
    import uuid

    path = f"{shared_folder(spark)}/nz-{uuid.uuid4().hex}"
    text = "zmin zmax nz\n" + "\n".join(f"{0.05 + 0.05 * i:.3f} {0.1 + 0.05 * i:.3f} {i * i % 7}" for i in range(89))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    t = files.read_nz_text(spark, path)
    return t.select("nz", *[F.round(c, 9).alias(c) for c in ("zmin", "zmax", "zmid", "volume")])


@query("SELECT date_trunc('day', ts) AS start, floor(value / 50.0)::INT AS bin, count(*) AS counts FROM events GROUP BY ALL")
def windowed_nz(spark, sf_dir):
    """The aggregation that streaming n(z) uses, on the table."""
    return streaming_nz(table(spark, sf_dir, "events"), "ts", "value", 0.0, 50.0)


@query(f"WITH e AS ({EV}) SELECT row_id FROM e WHERE round({_linear_sql('z', np.array([0.2, 1.0, 2.7]), np.array([0.0, 1.0, 0.0]))}, 9) >= {u01_sql('row_id', 21, 'mask')}")
def apply_radial_mask(spark, sf_dir):
    from skyloom.operators.masks import TabulatedRadial

    m = TabulatedRadial([0.2, 1.0, 2.7], [0.0, 5.0, 0.0], order=1)
    return events(spark, sf_dir).where(F.round(m.prob(F.col("z")), 9) >= u01(F.col("row_id"), 21, "mask")).select("row_id")


@query()
def survey_from_box(spark, sf_dir):
    """End to end: remap, cut to the sky, redshift space, smear, select by n(z) and photometric region."""
    from skyloom.functions.cosmology import DistanceToRedshift
    from skyloom.operators.masks import TabulatedRadial, photometric_region

    c = cosmology()
    from dataclasses import replace

    b = orders_box(spark, sf_dir, 2000.0, velocity=20.0).remap(((1, 1, 0), (0, 1, 0), (0, 0, 1)))
    b = replace(b, df=settled(b.df, "remapped"))  # each step repeats the columns before it in its expressions
    cut = b.cutsky((200.0, 1000.0), (-20.0, 20.0), (-15.0, 15.0), mask_radial=False)
    cut = replace(cut, df=settled(cut.df, "cut"))
    cut = cut.with_vectors({"Position": cut.rsd_position(1.0)})
    d, ra, dec = g.cartesian_to_sky(cut.vector())
    s = cut.df.withColumns({"Distance": d, "RA": ra, "DEC": dec}).where(F.col("Distance").between(200.0, 1000.0)).where(photometric_region(F.col("RA"), F.col("DEC"), "S"))
    s = smearing.smeared(s.withColumn("Z", DistanceToRedshift(c.distance, 3.0).column(F.col("Distance"))), "Z", "LRG", "row_id")
    return s.where(TabulatedRadial(np.linspace(0.0, 0.6, 13), np.linspace(1, 2, 13)).keep(F.col("row_id"), F.col("Z"), seed=2)).select("row_id", "RA", "DEC", "Distance", "Z")


@query("SELECT c_custkey % 4 AS m, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1")
def compacted_files(spark, sf_dir):
    """Many small files of wide rows become a few files of two columns."""
    import uuid

    path = f"{shared_folder(spark)}/compact-{uuid.uuid4().hex}"
    files.compact(table(spark, sf_dir, "customer").repartition(16), path, ["c_custkey", "c_acctbal"], 2)
    return spark.read.parquet(path).groupBy((F.col("c_custkey") % 4).alias("m")).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("SELECT r_regionkey::BIGINT AS ROSETTE_NUMBER, round(r_regionkey * 7.25::DOUBLE, 2) AS RA, round(r_regionkey - 2.5::DOUBLE, 2) AS DEC, unnest([r_regionkey * 3, r_regionkey * 3 + 1])::BIGINT AS TILEID, 'S' AS region FROM region")
def rosettes_from_ecsv(spark, sf_dir):
    """An ECSV file with a column of comma-joined tile ids."""
    import uuid

    rows = sorted(r.r_regionkey for r in table(spark, sf_dir, "region").collect())  # 5 rows
    head = ["# %ECSV 1.0", "# ---", "# delimiter: ','", "# datatype:", *[f"# - {{name: {n}, datatype: {k}}}" for n, k in (("ROSETTE_NUMBER", "int64"), ("RA", "float64"), ("DEC", "float64"), ("TILEID", "string"))], "ROSETTE_NUMBER,RA,DEC,TILEID"]
    text = "\n".join(head + [f'{i},{i * 7.25:.2f},{i - 2.5:.2f},"{i * 3},{i * 3 + 1}"' for i in rows])
    path = f"{shared_folder(spark)}/ecsv-{uuid.uuid4().hex}"
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return footprint.rosette_tiles(files.read_ecsv(spark, path)).select("ROSETTE_NUMBER", F.round("RA", 2).alias("RA"), F.round("DEC", 2).alias("DEC"), "TILEID", "region")


@query(f"WITH b AS ({box_sql()}) SELECT row_id, round(row_id % 7 / 4.0, 6) AS w, {r6('x', POS[0])} FROM b")
def weights_round_trip(spark, sf_dir):
    """Weights under another name, and back."""
    b = orders_box(spark, sf_dir).df.withColumn("w", F.col("row_id") % 7 / 4.0)
    out = blinding.weights_out(blinding.weights_in(b, "w").drop("w"), "w")
    return rounded(out.select("row_id", "w", POS[0]), "w", POS[0])


@query("SELECT round(a, 6) AS l1, round(b, 6) AS l2, round(c, 6) AS l3 FROM (VALUES (1.0, 1.0, 1.0), (sqrt(2.0), 1.0, sqrt(0.5)), (sqrt(2.0), sqrt(1.5), sqrt(1.0 / 3.0)), (sqrt(3.0), sqrt(2.0 / 3.0), sqrt(0.5)), (sqrt(3.0), sqrt(2.0), sqrt(1.0 / 6.0))) t(a, b, c)")
def lattices_from_cache(spark, sf_dir):
    """Lattices computed once and read from their table the second time."""
    import uuid

    from skyloom.operators.remap import Cuboid

    path = f"{shared_folder(spark)}/lattices-{uuid.uuid4().hex}"
    files.cached_lattices(spark, path, lambda: Cuboid.lattices(1.0, 1))
    return files.cached_lattices(spark, path, lambda: {}).select(*[F.round(c, 6).alias(c) for c in ("l1", "l2", "l3")])
