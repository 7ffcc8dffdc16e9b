"""Golden values, invariants and round trips of the numeric parts."""

import numpy as np
import pytest

from skyloom.functions.cosmology import DistanceToRedshift, cosmology
from skyloom.functions.distributions import Laplace, TruncatedCauchy, TruncatedNormal
from skyloom.functions.geometry import radec_area, rotation_about, rotation_between
from skyloom.functions.interp import Spline
from skyloom.operators import mesh
from skyloom.operators.catalog import BoxCatalog, random_box
from skyloom.operators.isometry import Isometry, IsometryError, box_to_cutsky, cutsky_to_box
from skyloom.operators.masks import TabulatedRadial, region_center
from skyloom.operators.remap import Cuboid, CuboidError
from skyloom.operators.smearing import RedshiftSmearing, tracer_fits, tracer_smearing
from skyloom.sources import files

GOLDEN = [(1.242481120911554, 0.07927226867048176, 0.5366145978426384), (0.6109877044894946, 1.0016399037833623, 0.2301527456400675), (0.05562675154380102, 0.5823615999835122, 0.4442670251479918), (1.298308859982872, 0.5311517137862527, 0.2857449536972063)]


def test_remap_golden():
    r = np.random.RandomState(42)
    points = np.array([r.uniform(0, 1, 4) for _ in range(3)]).T
    c = Cuboid(((0, 1, 1), (1, 0, 1), (0, 1, 0)))
    assert np.allclose(c.transform(points), GOLDEN)
    assert np.allclose(c.inverse(c.transform(points)), points)


@pytest.mark.parametrize("u", [((1, 1, 0), (0, 1, 0), (0, 0, 1)), ((1, 0, 1), (1, 1, 0), (0, 0, 1)), ((-1, 0, 0), (0, -1, 0), (0, 0, 1))])
def test_remap_inside(u):
    c = Cuboid(u, 10.0)
    p = np.random.RandomState(1).uniform(0, 10, (2000, 3))
    q = c.transform(p)
    assert (q >= 0).all() and (q <= c.size * (1 + 1e-12)).all()
    assert np.allclose(c.inverse(q), p)
    assert np.isclose(c.size.prod(), 1000)


def test_remap_needs_determinant_one():
    with pytest.raises(CuboidError):
        Cuboid(((1, 0, 0), (0, 2, 0), (0, 0, 1)))


def test_lattices():
    assert len(Cuboid.lattices(1.0, 1)) == 5
    assert all(np.isclose(np.prod(k), 8.0) for k in Cuboid.lattices(2.0, 1))


def test_box_to_cutsky_golden():
    assert box_to_cutsky((3900, 9500, 4500), 4600, 2000)[0] == (2000, 4600)
    d, ra, dec = box_to_cutsky(1000, 500)
    assert (d, ra, dec) == ((0, 500), (-180, 180), (-90, 90))
    d, ra, dec = box_to_cutsky((2000, 3000, 8000), 4000, 3500)
    assert np.allclose(ra, (-22.024312837042164, 22.024312837042164)) and np.allclose(dec, (-55.15009542095352, 55.15009542095352))
    d, ra, dec = box_to_cutsky((2000, 9000, 8000), 4000, 3500)
    assert np.allclose(ra, (-55.15009542095352, 55.15009542095352)) and np.allclose(dec, (-55.15009542095352, 55.15009542095352))
    with pytest.raises(IsometryError):
        box_to_cutsky((2000, 9000, 8000), 4000, 100)


def test_isometries():
    p = np.random.RandomState(0).normal(size=(50, 3))
    w = Isometry().rotation(30, "z").translation(5, "x").rotation(-12, "y")
    assert np.allclose(Isometry().rotation(90, "x")(p), p[:, [0, 2, 1]] * [1, -1, 1])
    assert np.allclose((Isometry().rotation(20, "z") + Isometry().rotation(25, "z"))(p), Isometry().rotation(45, "z")(p))
    assert np.allclose(w.reset_rotation().rotation_matrix, np.eye(3)) and np.allclose(w.reset_translation()(p), p @ w.rotation_matrix.T)
    assert sum([w, w]).is_identity is False and Isometry().is_identity
    assert np.allclose(rotation_between((1, 0, 0), (0, 1, 0)), rotation_about("z", 90))
    m = rotation_between((1, 0, 0), (-1, 0, 0))
    assert np.allclose(m @ (1, 0, 0), (-1, 0, 0)) and np.isclose(np.linalg.det(m), 1)


def test_cutsky_box_round_trip():
    size, way = cutsky_to_box((2200.0, 2300.0), (0.0, 50.0), (-1.0, 5.0))
    assert size.shape == (3,) and np.isclose(np.linalg.norm(way([[0, 0, 0]])), 2300 - size[0] / 2)


def test_disjoint_cuts(spark):
    size, _ = cutsky_to_box((2200.0, 2300.0), (0.0, 50.0), (-1.0, 5.0))
    b = random_box(spark, size * 2.1, 0.0, csize=20000)
    counts = {r["cut_id"]: r["count"] for r in b.cutsky((2200.0, 2300.0), (0.0, 50.0), (-1.0, 5.0), noutput=None).df.groupBy("cut_id").count().collect()}
    assert len(counts) == 8
    mean = sum(counts.values()) / 8
    assert all(abs(n - mean) < 4 * mean**0.5 for n in counts.values())
    with pytest.raises(ValueError):
        BoxCatalog(b.df)


def test_repartition_invariance(spark):
    a = random_box(spark, 10.0, csize=500).df
    assert {tuple(r) for r in a.repartition(7).collect()} == {tuple(r) for r in a.collect()}


def test_spline_orders():
    x = np.sort(np.random.RandomState(3).uniform(0, 5, 12))
    for k in (1, 2, 3):
        y = x**k - 2 * x
        s = Spline(x, y, k)
        v = np.linspace(x[0], x[-1], 50)
        assert np.allclose(s(x), y) and np.allclose(s(v), v**k - 2 * v if k > 1 else np.interp(v, x, y), atol=1e-9)
        assert np.isclose(s.integral(x[0], x[-1]), np.trapezoid(s(np.linspace(x[0], x[-1], 200001)), np.linspace(x[0], x[-1], 200001)), atol=1e-6)
    assert Spline(x, x, 1, "zeros")([x[0] - 1]) == 0
    with pytest.raises(ValueError):
        Spline(x, x, 3, "raise")([x[0] - 1])


def test_distributions():
    for d in (TruncatedCauchy(0.2, 0.8, -0.6, 1.1), TruncatedNormal(0.2, 0.8, -0.6, 1.1), Laplace(0.2, 0.8)):
        q = np.linspace(0.01, 0.99, 21)
        assert np.allclose(d.cdf(d.ppf(q)), q, atol=1e-9)
        v = np.linspace(float(d.ppf(0.01)), float(d.ppf(0.99)), 20001)
        assert np.isclose(np.trapezoid(d.pdf(v), v), 0.98, atol=1e-4)


def test_cosmology():
    c = cosmology()
    z = np.linspace(0.01, 2, 20)
    assert np.allclose(DistanceToRedshift(c.distance, 3.0)(c.distance(z)), z, atol=1e-6)
    assert np.isclose(cosmology({"Omega_m": 1.0}).distance(1.0), 2 * 2997.92458 * (1 - 0.5**0.5), rtol=1e-6)


def test_masks():
    z = np.linspace(0.3, 1.7, 100)
    m = TabulatedRadial(z, 10 * np.exp(-10 * (z - 1) ** 2), order=2)
    assert np.isclose(m.normalized(0.5).integral(), 0.5)
    assert np.isclose(radec_area((350.0, 10.0), (-90.0, 90.0)), 20 * np.degrees(2))
    with pytest.raises(ValueError):
        region_center("nowhere")


def test_smearing():
    u = (np.arange(2000) + 0.5) / 2000
    z = np.full(2000, 0.75)
    for tracer, width in (("LRG", 400), ("ELG", 150), ("QSO", 1e5)):
        dz = tracer_smearing(tracer, dzsize=2000).ppf(u, z)
        assert abs(np.median(dz)) < 1e-3 and np.abs(dz).max() < width / 299792.458 * 1.8
    assert [r[0] for r in tracer_fits("QSO")] == sorted(r[0] for r in tracer_fits("QSO")) and len(tracer_fits("QSO")) == 12
    with pytest.raises(ValueError):
        tracer_fits("LRG", "clustering")
    s = RedshiftSmearing.from_pdf([0.5, 1.5], np.linspace(-20, 20, 1000), np.exp(-0.5 * np.linspace(-20, 20, 1000)[:, None] ** 2 / np.array([1.0, 2.0]) ** 2))
    assert np.isclose(s.ppf(0.8413447, 1.0), 1.5, rtol=0.01)


def test_fft(spark):
    n = 8
    a = np.random.RandomState(0).normal(size=(n, n, n))
    f = mesh.real_from_array(spark, a)
    assert np.allclose(mesh.complex_to_array(mesh.r2c(f, n), n), np.fft.rfftn(a) / n**3)
    assert np.allclose(mesh.real_to_array(mesh.c2r(mesh.r2c(f, n), n), n), a)


def test_ecsv_and_fits(spark, tmp_path):
    names, rows = files.parse_ecsv("# %ECSV 1.0\n# ---\n# datatype:\n# - {name: v, datatype: string}\nv mean_z\n[1,2,3] 0.5\n[4,5,6] 0.7\n")
    assert names == ["v", "mean_z"] and rows[1] == {"v": [4.0, 5.0, 6.0], "mean_z": 0.7}
    data = files.fits_bytes({"RA": np.array([1.0, 2.0]), "ID": np.array([5, 6], "i8"), "V": np.arange(6.0).reshape(2, 3), "NAME": np.array(["ab", "c"])})
    (tmp_path / "t.fits").write_bytes(data)
    got = files.read_fits(spark, str(tmp_path / "t.fits"), "RA double, ID long, V array<double>, NAME string").orderBy("ID").collect()
    assert got[1].RA == 2.0 and got[1].ID == 6 and got[1].V == [3.0, 4.0, 5.0] and got[0].NAME == "ab"


def test_precedence_union(spark):
    a = spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "mean_z double")
    b = spark.createDataFrame([(0.6,), (0.8,)], "mean_z double")
    assert [r.mean_z for r in files.precedence_union([a, b], "mean_z").collect()] == [0.1, 0.5, 0.6, 0.8]


def test_stream(spark, tmp_path):
    from skyloom.streaming.nz import streaming_nz

    rows = spark.createDataFrame([("2024-01-01 10:00:00", 1.0), ("2024-01-01 11:00:00", 1.2), ("2024-01-02 10:00:00", 2.0)], "ts string, z double").selectExpr("cast(ts as timestamp) ts", "z")
    rows.write.parquet(str(tmp_path / "in"))
    q = streaming_nz(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "ts", "z", 0.0, 1.0).writeStream.format("memory").queryName("nz").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.bin, r.counts) for r in spark.table("nz").collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("auto", [True, False])
def test_pairs_of_crowded_cells(spark, auto, monkeypatch):
    """Half of the points lie in one cell, which is cut in blocks; every pair counts once."""
    from skyloom.operators import density

    monkeypatch.setattr(density, "BLOCK_POINTS", 50)
    r = np.random.RandomState(1)
    a = np.concatenate([r.uniform(0, 40, (150, 3)), r.uniform(10, 11, (150, 3)), [[5.0, 5.0, 5.0], [5.0, 5.0, 8.0]]])
    b = a if auto else np.concatenate([r.uniform(0, 40, (100, 3)), r.uniform(10, 11, (120, 3))])
    edges = [0.5, 1.0, 2.0, 3.0]
    frame = lambda p: spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "row_id long, Position_x double, Position_y double, Position_z double")
    got = [r.pairs for r in density.pair_counts(frame(a), frame(b), edges, auto=auto).orderBy("bin").collect()]
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    d = d[np.triu_indices(len(a), 1)] if auto else d.ravel()
    assert got == np.histogram(d, edges)[0].tolist()
    empty = frame(a[:0])
    assert [r.pairs for r in density.pair_counts(empty, empty, edges, auto=auto).orderBy("bin").collect()] == [0, 0, 0]


def test_margins_of_cuts():
    """A margin that is not given is like the other, and both grow alike to fill the box."""
    from skyloom.operators.catalog import BoxCatalog
    from skyloom.operators.isometry import IsometryError

    box = type("Box", (), {"boxsize": (400.0,) * 3, "boxcenter": (0.0,) * 3})()
    cut = dict(drange=(200.0, 260.0), rarange=(-10.0, 10.0), decrange=(-8.0, 8.0), noutput=None)
    from skyloom.operators.isometry import cutsky_to_box

    size, way = cutsky_to_box(cut["drange"], cut["rarange"], cut["decrange"])

    def centers(**margins):
        ways, _, _ = BoxCatalog.isometries_for_cutsky(box, **cut, **margins)
        shifts = np.array([np.linalg.solve(np.array(w.rotation_matrix), np.array(way.shift) - np.array(w.shift)) for w in ways])
        return [sorted(set(np.round(shifts[:, i], 6))) for i in range(3)]

    for margins, e, i in (({"external_margin": 2.0}, 2.0, 2.0), ({"internal_margin": 1.0}, 1.0, 1.0), ({"external_margin": 1.0, "internal_margin": 3.0}, 1.0, 3.0)):
        for a, got in enumerate(centers(**margins)):
            given_e, given_i = margins.get("external_margin", 0.0), margins.get("internal_margin", 0.0)
            n = int((400 - 2 * given_e + given_i) / (size[a] + given_i))
            k = (400 - size[a] * n) / (i * (n - 1) + 2 * e)
            want = k * e + (size[a] + k * i) * np.arange(n) + size[a] / 2 - 200
            assert k >= 1 and np.allclose(got, want, atol=1e-5)
    with pytest.raises(IsometryError):
        centers(internal_margin=8.0)


def test_passes_and_closed_form_agree(spark):
    """Completeness pass after pass in plain loops, by pass with tables, and in closed form."""
    from skyloom.operators import fibers

    r = np.random.RandomState(2)
    rows = [(t, k, int(r.randint(3)), int(r.choice([-1, *range(8)])), bool(r.uniform() < 0.2)) for t in range(200) for k in range(3) if r.uniform() < 0.8]
    taken = set()
    rows = [(t, k, ti, f, o and f != -1 and (k, ti, f) not in taken and not taken.add((k, ti, f))) for t, k, ti, f, o in rows]
    seen = {t for t, *_, o in rows if o}
    unused = {t for t, _, _, f, _ in rows if f != -1} - seen
    weight, left = dict.fromkeys(seen, 1.0), []
    for k in range(3):
        mine = [x for x in rows if x[1] == k]
        for t, _, tile, fiber, o in mine:
            if o:
                weight[t] += sum(x[2:4] == (tile, fiber) and x[0] in unused for x in mine)
        unused -= {x[0] for x in mine if x[3] != -1}
        left.append((k, len(unused)))
    h = spark.createDataFrame(rows, "TARGETID long, PASS int, TILEID int, FIBER int, OBSERVED boolean")
    targets = h.select("TARGETID").distinct()
    by_pass, remaining = fibers.completeness_by_pass(targets, h, 3)
    for out in (by_pass, fibers.completeness_weights(targets, h)):
        got = {x.TARGETID: x.COMP_WEIGHT for x in out.collect()}
        assert {t: w for t, w in got.items() if w == w} == weight and max(weight.values()) > 2 and len(got) > len(weight)
    assert [tuple(x) for x in remaining.orderBy("PASS").collect()] == [x for x in left if x[1]]


def test_one_interlaced_grid_means_two(spark):
    from skyloom.operators import mesh, mocks

    made = lambda k: mesh.real_to_array(mocks.GaussianMock.from_power(spark, lambda q: 1e3 + 0 * q, nmesh=6, boxsize=600.0, boxcenter=1000.0).with_real().with_selection(lambda d, ra, dec: 1e-4 * d, interlacing=k).nbar, 6)
    plain, one, true, two = (made(k) for k in (False, 1, True, 2))
    assert np.allclose(one, two) and np.allclose(true, two) and not np.allclose(plain, two)


def test_images_maps_and_sky_targets(spark, tmp_path):
    """FITS images of bricks, HEALPix maps and per-tile sky targets through files."""
    from skyloom.operators import bricks, masks
    from skyloom.sources import files

    r = np.random.RandomState(0)
    image = r.randint(-99, 99, (5, 7)).astype("i2")
    got, header = files.parse_fits_image(files.image_bytes(image, {"CRPIX1": 4, "CD1_1": -0.01}))
    assert np.array_equal(got, image) and header["CRPIX1"] == "4"
    points = spark.createDataFrame([(i, float(a), float(d)) for i, (a, d) in enumerate(r.uniform([10, 30], [11, 33], (300, 2)))], "row_id long, RA double, DEC double")
    rows = bricks.with_bricks(points).collect()
    names = sorted({(x.brickname, x.photsys) for x in rows})
    n, scale = 120, 0.3 / 120
    for k, (name, region) in enumerate(names[1:]):  # the first has no image
        (tmp_path / f"{region}-{name}.fits").write_bytes(files.image_bytes((np.arange(n * n).reshape(n, n) % 1000 + k).astype("i4"), {"CRPIX1": (n + 1) / 2, "CD1_1": -scale}))
    out = bricks.pixel_values(points, {"maskbits": (files.brick_image_opener(str(tmp_path / "{region}-{brick}.fits")), -1)}, "maskbits int").collect()
    value = {x.row_id: x.maskbits for x in out}
    assert {x.photsys for x in rows} == {"N", "S"} and len(value) == 300
    for x in rows:
        k = names.index((x.brickname, x.photsys))
        if k == 0:
            assert value[x.row_id] == -1
            continue
        ra, dec, a0, d0 = np.radians([x.RA, x.DEC, x.brick_ra, x.brick_dec])
        c = np.sin(d0) * np.sin(dec) + np.cos(d0) * np.cos(dec) * np.cos(ra - a0)
        px = round(np.degrees(-np.cos(dec) * np.sin(ra - a0) / c) / scale + (n - 1) / 2)
        py = round(np.degrees((np.cos(d0) * np.sin(dec) - np.sin(d0) * np.cos(dec) * np.cos(ra - a0)) / c) / scale + (n - 1) / 2)
        assert value[x.row_id] == (py * n + px) % 1000 + k - 1

    values = r.uniform(size=(48, 4))
    (tmp_path / "map.fits").write_bytes(files.fits_bytes({"w": values}))
    m = files.read_healpix_map(spark, str(tmp_path / "map.fits"), "w")
    assert [x.nbar for x in m.orderBy("pix").collect()] == values.ravel().tolist()
    p = masks.HealpixAngular(m, 4).with_prob(points, "RA", "DEC").collect()
    from skyloom.functions import healpix

    pix = {x.row_id: x.p for x in points.select("row_id", healpix.ang2pix(4, points.RA, points.DEC).alias("p")).collect()}
    assert all(np.isclose(x.prob, values.ravel()[pix[x.row_id]]) for x in p)

    targets = r.uniform([10, 30], [12, 33], (200, 2))
    for k in range(2):
        own = slice(100 * k, 100 * k + 100)
        (tmp_path / f"sky-{k}.fits").write_bytes(files.fits_bytes({"RA": targets[own, 0], "TARGETID": np.arange(200)[own], "DEC": targets[own, 1]}))
    tiles = spark.createDataFrame([(1, 11.0, 31.0), (2, 11.5, 32.5)], "TILEID long, RA double, DEC double")
    got = {x.TARGETID for x in files.read_sky_targets(spark, str(tmp_path / "sky-*.fits"), tiles, 0.6).collect()}
    a, d = np.radians(targets).T
    near = lambda ra, dec: np.degrees(np.arccos(np.sin(d) * np.sin(np.radians(dec)) + np.cos(d) * np.cos(np.radians(dec)) * np.cos(a - np.radians(ra)))) <= 0.6
    assert got == set(np.flatnonzero(near(11, 31) | near(11.5, 32.5)).tolist()) and got


def test_steps_from_box_to_survey(spark):
    """Lattice by ranges of sizes and quarter turns; redshift space before cuts; redshifts that follow n(z)."""
    from skyloom.functions.cosmology import DistanceToRedshift, cosmology
    from skyloom.operators import masks
    from skyloom.operators.catalog import random_box
    from skyloom.operators.remap import Cuboid

    box = random_box(spark, 5500.0, csize=500)
    ranges = [[8000, 10000], [4000, 5000], [2000, 4000]]
    sizes = list(Cuboid.lattices((5500.0,) * 3, 1, 1, sort=False, ranges=ranges))
    out = box.remap_to_ranges(ranges)
    assert len(sizes) == 1 and np.allclose(out.boxsize, np.array(sizes[0])[[2, 0, 1]]) and np.isclose(np.prod(out.boxsize), 5500.0**3)
    low, high = np.array(out.boxcenter) - np.array(out.boxsize) / 2, np.array(out.boxcenter) + np.array(out.boxsize) / 2
    p = out.df.toPandas()[["Position_x", "Position_y", "Position_z"]].to_numpy()
    assert (p >= low - 1e-6).all() and (p <= high + 1e-6).all()

    from pyspark.sql import functions as F

    b = random_box(spark, (2000.0, 3000.0, 8000.0), csize=300)
    from dataclasses import replace

    b = replace(b, df=b.df.withColumns({f"Velocity_{a}": F.col(f"Position_{a}") * 0.001 + 1 for a in "xyz"}), velocity="Velocity", vectors=b.vectors | {"Velocity"}, invariants=frozenset({"Velocity"}))
    c = b.cutsky_rsd(3500.0, 4000.0, 0.7).df.toPandas()
    x, v = (c[[f"{n}_{a}" for a in "xyz"]].to_numpy() for n in ("Position", "Velocity"))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = x + 0.7 * (v * unit).sum(1, keepdims=True) * unit
    assert np.allclose(c[[f"RSDPosition_{a}" for a in "xyz"]].to_numpy(), want) and np.allclose(c.DISTANCE, np.linalg.norm(want, axis=1))
    assert np.allclose(c.DEC, np.degrees(np.arcsin(want[:, 2] / c.DISTANCE))) and len(c) == 300
    assert np.isclose(x[:, 0].mean(), 3000, rtol=0.05) and x[:, 0].max() <= 4000  # the far corners of a box 2000 deep lie at 4000

    cosmo = cosmology()
    edges = np.linspace(0.1, 1.1, 11)
    n = np.array([1, 3, 6, 9, 12, 12, 9, 6, 3, 1.0])
    nz = spark.createDataFrame([(float(a), float(b), float(k)) for a, b, k in zip(edges[:-1], edges[1:], n)], "zmin double, zmax double, nz double")
    z = masks.generate_redshifts(nz, spark, 4000, cosmo.distance, DistanceToRedshift(cosmo.distance, 2.0), 0.2, 1.0).toPandas().z
    assert len(z) == 4000 and z.between(0.2, 1.0).all()
    got = np.histogram(z, edges[1:-1])[0] / 4000
    assert np.abs(got - n[1:-1] / n[1:-1].sum()).max() < 0.03
