"""Redshift errors against a numeric inverse, and fibre assignment over passes against plain loops."""

import math

import numpy as np
import pytest

from skyloom.functions.rng import u01_py
from skyloom.operators import fibers, smearing


@pytest.mark.parametrize("tracer, kind", [("BGS", "statistical"), ("ELG", "statistical"), ("LRG", "statistical"), ("QSO", "statistical"), ("QSO", "clustering")])
def test_draws_invert_the_mixture(spark, tracer, kind):
    """At the tabulated redshifts, the distribution of the error at a draw is the uniform number it was made from."""
    z, peaked, gauss, weight, _ = smearing.tracer_distributions(tracer, kind)
    rows = [(40 * k + i, float(z[k])) for k in range(len(z)) for i in range(40)]
    out = smearing.smeared(spark.createDataFrame(rows, "row_id long, z double"), "z", tracer, "row_id", kind=kind).collect()
    power = -1 if tracer == "QSO" and kind == "statistical" else 1
    start = dict(rows)
    off = []
    for r in out:
        k = r.row_id // 40
        v = (r.z - start[r.row_id]) * 299792.458 / (1 + z[k]) ** power
        cdf = weight[k] * float(peaked[k].cdf(v)) + (1 - weight[k]) * float(gauss[k].cdf(v))
        off.append(abs(cdf - u01_py(r.row_id, 13, "smear")))
    assert len(off) == len(rows) and max(off) < 0.01 and np.mean(off) < 0.002


def test_errors_between_redshifts_are_linear():
    s = smearing.tracer_smearing("LRG")
    u = np.linspace(0.05, 0.95, 7)
    a, b = s.z[2], s.z[3]
    bare = smearing.RedshiftSmearing(s.z, s.dz, s.cdf)
    assert np.allclose(bare.ppf(u, 0.3 * a + 0.7 * b), 0.3 * bare.ppf(u, a) + 0.7 * bare.ppf(u, b))
    assert np.allclose(s.ppf(u, a), bare.ppf(u, a) / 299792.458 * (1 + a))
    assert np.allclose(bare.ppf(u, s.z[0] - 0.1), bare.ppf(u, s.z[0])) and np.allclose(bare.ppf(u, 9.0), bare.ppf(u, s.z[-1]))


def apart(a, b):
    (ra1, d1), (ra2, d2) = np.radians(a), np.radians(b)
    h = math.sin((d1 - d2) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((ra1 - ra2) / 2) ** 2
    return math.degrees(2 * math.asin(math.sqrt(h)))


def test_passes_of_fibre_assignment(spark):
    """Tiles, reach, two greedy rounds, bad fibres and the counts carried from pass to pass."""
    r = np.random.RandomState(4)
    targets = [(i, float(a), float(d), float(s), 1, 0, -1) for i, (a, d, s) in enumerate(zip(r.uniform(10, 14, 160), r.uniform(-2, 2, 160), r.uniform(size=160)))]
    tiles = [(10 * p + k, 11.0 + 2 * (k % 2) + 0.3 * p, -1.0 + 2 * (k // 2), p) for p in range(3) for k in range(4)]
    fib = [(t, f, ra + 0.6 * (f % 3 - 1), dec + 0.6 * (f // 3 - 1)) for t, ra, dec, _ in tiles for f in range(9)]
    warn = [(t, f, (1 << 9) if (t + f) % 7 == 0 else 0) for t, f, *_ in fib]
    radius, patrol = 1.6, 0.45
    frame = spark.createDataFrame
    state = frame([(i, a, d, s, m, n) for i, a, d, s, m, n, _ in targets], "TARGETID long, RA double, DEC double, SUBPRIORITY double, NUMOBS_MORE long, NUMOBS long").selectExpr("*", "CAST(-1 AS BIGINT) AS TILEID")
    out, history = fibers.assign_passes(state, frame(tiles, "TILEID long, RA double, DEC double, PASS int"), frame(fib, "TILEID long, FIBER int, RA double, DEC double"), 3, radius, patrol, frame(warn, "TILEID long, FIBER int, ZWARN long"))
    more, want = {t[0]: 1 for t in targets}, set()
    good = {(t, f) for t, f, w in warn if w == 0}
    for p in range(3):
        tile = {}
        for i, a, d, *_ in targets:
            inside = [t for t, ra, dec, k in tiles if k == p and apart((a, d), (ra, dec)) <= radius]
            if inside and more[i] >= 1:
                tile[i] = min(inside)
        reach = [(i, t, f) for i, t in tile.items() for tt, f, ra, dec in fib if tt == t and apart(targets[i][1:3], (ra, dec)) <= patrol]
        got, used, done = {}, set(), set()
        for _ in range(2):
            best = {}
            for i, t, f in reach:
                if (t, f) not in used and (t, i) not in done:
                    key = (-targets[i][3], i)
                    best[t, f] = min(best.get((t, f), key), key)
            mine = {}
            for (t, f), (_, i) in best.items():
                mine[t, i] = min(mine.get((t, i), f), f)
            for (t, i), f in mine.items():
                got[i] = f
                used.add((t, f))
                done.add((t, i))
        near = {}
        for i, t, f in reach:
            if (t, f) in used:
                near[i] = min(near.get(i, f), f)
        for i, t in tile.items():
            seen = i in got and (t, got[i]) in good
            free = i in near and (t, near[i]) in good
            want.add((i, p, t, got[i] if seen else near[i] if free else -1, seen))
            more[i] -= seen
    assert {tuple(x) for x in history.select("TARGETID", "PASS", "TILEID", "FIBER", "OBSERVED").collect()} == want
    assert {x.TARGETID: x.NUMOBS_MORE for x in out.collect()} == more and 20 < sum(o for *_, o in want) < 150
    assert any(f != -1 and not o for *_, f, o in want)


def test_many_polygons(spark):
    """Polygons by cells against a branch for each, with caps of all sizes, holes and the poles."""
    from pyspark.sql import functions as F

    from skyloom.operators import masks

    r = np.random.RandomState(7)
    polygons = []
    for k in range(60):
        v = r.normal(size=(3, 3))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        if k < 3:
            v[0] = [0, 0, 1 - 2 * (k % 2)]
        near = v[0] + 0.2 * v[1]
        caps = [(*v[0], float(r.choice([0.002, 0.02, 0.2, 1.2]))), (*(near / np.linalg.norm(near)), float(r.uniform(0.05, 0.5)))]
        polygons.append((float(r.uniform(0.1, 1)), caps + [(*v[2], -float(r.uniform(0.05, 0.5)))] * (k % 2)))
    polygons.append((0.05, [(0.0, 1.0, 0.0, -0.3)]))
    m = masks.PolygonAngular(polygons)
    u = r.uniform(size=(4000, 2))
    points = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(zip(360 * u[:, 0], np.degrees(np.arcsin(2 * u[:, 1] - 1))))], "row_id long, ra double, dec double")
    rows = m.with_prob(points).withColumn("plain", m.prob(F.col("ra"), F.col("dec"))).collect()
    assert len(rows) == 4000 and all(x.prob == x.plain for x in rows) and len({x.prob for x in rows}) > 30


def sky_tiles(r, n, radius):
    """Tiles and points in all places: the poles, both ends of right ascension, and at a tile's edge and centre."""
    tiles = [(i, float(a), float(d), i % 2) for i, (a, d) in enumerate(zip(r.uniform(0, 360, n), np.degrees(np.arcsin(r.uniform(-1, 1, n)))))]
    tiles += [(n, 0.0, 0.0, 0), (n + 1, 359.9, 1.0, 1), (n + 2, 77.0, 90.0, 0), (n + 3, 200.0, -90.0, 1), (n + 4, 10.0, 90.0 - radius, 0)]
    points = [(float(a), float(d)) for a, d in zip(r.uniform(0, 360, 3000), np.degrees(np.arcsin(r.uniform(-1, 1, 3000))))]
    points += [(0.0, radius), (radius, 0.0), (360.0 - radius / 2, 0.0), (0.0, 90.0), (123.0, -90.0), (0.0, 0.0), (10.0, 90.0), (190.0, 90.0 - radius / 3)]
    return tiles, [(i, *p) for i, p in enumerate(points)]


def inside(point, tile, radius):
    return apart(point[1:3], tile[1:3]) - radius


def test_points_in_tiles_pair_by_pair(spark):
    """All pairs, a tile that is listed twice too, and each is told in generated code."""
    from skyloom.operators import footprint

    radius = 6.0
    tiles, points = sky_tiles(np.random.RandomState(3), 150, radius)
    frame = spark.createDataFrame
    out = footprint.points_in_tiles(frame(points + [(9999, float("nan"), 1.0), (9998, None, 1.0)], "row_id long, RA double, DEC double"), frame(tiles + tiles[:1], "TILEID long, RA double, DEC double, PASS int"), radius, extra=("PASS",))
    got = sorted(tuple(x) for x in out.collect())
    gap = {(p[0], t[0]): inside(p, t, radius) for p in points for t in tiles}
    sure = sorted((p, t, tiles[t][3]) for (p, t), d in gap.items() if d < -1e-9 for _ in range(1 + (t == 0)))
    edge = {k for k, d in gap.items() if abs(d) <= 1e-9}
    assert [x for x in got if x[:2] not in edge] == sure and len(sure) > 1000 and edge
    assert "lambdafunction" not in out._jdf.queryExecution().executedPlan().toString()


def test_first_tile_of_many(spark):
    """The first of many tiles over a point, wherever it is; where no tile is, and off the sky, none."""
    from skyloom.operators import footprint

    radius = 9.0
    tiles, points = sky_tiles(np.random.RandomState(5), 400, radius)
    odd = [(9999, float("nan"), 1.0), (9998, None, 1.0), (9997, 3.0, float("nan"))]
    frame = spark.createDataFrame
    out = footprint.tile_of_pass(frame(points + odd, "row_id long, RA double, DEC double"), frame(tiles, "TILEID long, RA double, DEC double, PASS int"), 0, radius=radius)
    got = {x.row_id: x.TILEID for x in out.collect()}
    assert len(got) == len(points) + 3 and {got[i] for i, *_ in odd} == {-1}
    for p in points:
        sure = min((t[0] for t in tiles if t[3] == 0 and inside(p, t, radius) < -1e-9), default=-1)
        edge = {t[0] for t in tiles if t[3] == 0 and abs(inside(p, t, radius)) <= 1e-9}
        assert got[p[0]] == sure or got[p[0]] in edge
    assert len(set(got.values())) > 50


def test_own_tile_only(spark):
    """Targets with a tile are compared with its fibres alone: 60 times as many other fibres add no row to any step."""
    own = [(7, f, 20.0 + 0.1 * f, 5.0) for f in range(10)]
    other = [(t, f, 20.0 + 0.1 * f, 5.0) for t in range(100, 700) for f in range(10)]
    frame = spark.createDataFrame
    targets = frame([(i, 20.0 + 0.01 * i, 5.0, 7) for i in range(100)], "TARGETID long, RA double, DEC double, TILEID long")
    out = fibers.reachable(targets, frame(own + other, "TILEID long, FIBER int, RA double, DEC double"), 0.03)
    got = {tuple(x) for x in out.collect()}
    assert got == {(i, 7, f) for i in range(100) for _, f, a, d in own if apart((20.0 + 0.01 * i, 5.0), (a, d)) <= 0.03} and len(got) > 50
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "own#" not in plan and "lambdafunction" not in plan


def test_greedy_order(spark):
    """A fibre takes the highest priority, then subpriority, then the smallest id, negative ids and ties too."""
    frame = spark.createDataFrame
    reach = frame([(i, 1, f) for i in (-5, -2, 3, 9, 11) for f in (0, 1, 2)], "TARGETID long, TILEID long, FIBER int")
    targets = frame([(-5, 1, 0.5), (-2, 1, 0.5), (3, 2, 0.1), (9, 0, 0.9), (11, 1, 0.4)], "TARGETID long, PRIORITY int, SUBPRIORITY double")
    for rounds, want in ((1, [(3, 0)]), (2, [(3, 0), (-5, 1)]), (3, [(3, 0), (-5, 1), (-2, 2)])):
        assert sorted((x.TARGETID, x.FIBER) for x in fibers.greedy(reach, targets, rounds).collect()) == sorted(want)
