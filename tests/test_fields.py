"""Operators on meshes against numpy on the driver: painting, reading out, blinding by reconstruction."""

import numpy as np
import pytest

from skyloom.operators import blinding, mesh

N, SIZE, CENTER = 12, 600.0, (900.0, 0.0, 0.0)
GRID = mesh.Grid(N, SIZE, CENTER)
AXES = "xyz"


def cloud(p):
    """Nodes and weights of cloud-in-cell: (8, rows, 3) and (8, rows)."""
    x = (p - np.array(CENTER) + SIZE / 2) / (SIZE / N)
    low = np.floor(x).astype(int)
    d = x - low
    steps = np.array([[i, j, k] for i in (0, 1) for j in (0, 1) for k in (0, 1)])
    return (low[None] + steps[:, None]) % N, np.where(steps[:, None] == 1, d[None], 1 - d[None]).prod(-1)


def paint(p, w):
    out = np.zeros((N, N, N))
    at, c = cloud(p)
    np.add.at(out, tuple(at.transpose(2, 0, 1)), c * w[None])
    return out


def read(field, p):
    at, c = cloud(p)
    return (field[tuple(at.transpose(2, 0, 1))] * c).sum(0)


def waves():
    k = 2 * np.pi / SIZE * np.fft.fftfreq(N, 1 / N)
    kz = 2 * np.pi / SIZE * np.arange(N // 2 + 1)
    return np.meshgrid(k, k, kz, indexing="ij")


def filtered(field, f):
    return np.fft.irfftn(np.fft.rfftn(field) * f(*waves()), s=(N, N, N), axes=(0, 1, 2))


def square(*k):
    return sum(x**2 for x in k)


def contrast(b, data, w, randoms, rw, radius, floor=0.01):
    a = paint(data, w)
    if randoms is None:
        d = a / a.mean() - 1
    else:
        r = paint(randoms, rw)
        alpha = a.mean() / r.mean()
        least = floor * r.mean() * alpha
        d = np.where(alpha * r > least, a / np.maximum(alpha * r, least) - 1, 0)
    return filtered(d, lambda *k: np.exp(-0.5 * radius**2 * square(*k)) / b.bias)


def gradients(field, p):
    one = lambda a: lambda *k: 1j * k[a] / np.where(square(*k) > 0, square(*k), 1)
    return np.stack([read(filtered(field, one(a)), p) for a in range(3)], 1)


def shifts(b, field, p):
    n = p / np.sqrt((p**2).sum(1, keepdims=True))
    return b.fid.get("f", b.z) * (gradients(field, p) * n).sum(1, keepdims=True) * n


@pytest.fixture(scope="module")
def points():
    r = np.random.RandomState(8)
    data, randoms = (np.array(CENTER) + r.uniform(-SIZE / 2, SIZE / 2, (n, 3)) for n in (300, 900))
    data[:100] = np.array(CENTER) + r.normal(0, 60, (100, 3))
    return data, r.uniform(0.5, 2, 300), randoms, r.uniform(0.5, 1.5, 900)


def frame(spark, p, w):
    return spark.createDataFrame([(i, *map(float, x), float(v)) for i, (x, v) in enumerate(zip(p, w))], "row_id long, Position_x double, Position_y double, Position_z double, Weight double")


def positions(df):
    rows = sorted(df.collect(), key=lambda r: r.row_id)
    return np.array([[r[f"Position_{a}"] for a in AXES] for r in rows]), np.array([r.Weight for r in rows])


def test_rsd_blinding(spark, points):
    data, w, randoms, rw = points
    b = blinding.Blinding(blind=("DESI", {"f": 0.6}), bias=2.0)
    got, _ = positions(b.rsd(frame(spark, data, w), frame(spark, randoms, rw), GRID, radius=50.0))
    s = shifts(b, contrast(b, data, w, randoms, rw, 50.0), data)
    want = data + (0.6 / b.fid.get("f", 1.0) - 1) * s
    assert np.abs(s).max() > 0.1 and np.allclose(got, want, atol=1e-6)


@pytest.mark.parametrize("method, shotnoise, with_randoms", [("data_weights", False, False), ("randoms_weights", False, True), ("data_weights", True, True), ("randoms_weights", True, True), ("data_positions", False, True)])
def test_png_blinding(spark, points, method, shotnoise, with_randoms):
    data, w, randoms, rw = points
    b = blinding.Blinding(blind=("DESI", {"fnl": 500.0}), bias=2.0)
    got, weight = positions(b.png(frame(spark, data, w), frame(spark, randoms, rw) if with_randoms else None, GRID, method, radius=50.0, shotnoise=shotnoise))
    r, v = (randoms, rw) if with_randoms else (None, None)
    real = data - shifts(b, contrast(b, data, w, r, v, 50.0), data)
    bfnl = 2 * 1.686 * 500.0

    def shape(*k):
        q = np.sqrt(square(*k))
        return np.where(q > 0, bfnl / b.primordial(np.where(q > 0, q, 1)), 0)

    field = filtered(contrast(b, real, w, r, v, 50.0), shape)
    rows, own = (data, w) if method.startswith("data") else (randoms, rw)
    if method == "data_positions":
        s = gradients(field, rows)
        assert np.allclose(got, rows + s - s.mean(0), atol=1e-6) and np.allclose(weight, own)
        return
    factor = 1.0
    if shotnoise:
        d, d2 = paint(data, w), paint(data, w * w)
        inverse = d * (w.sum() / rw.sum() / (SIZE / N) ** 3 * paint(randoms, rw)) / np.where(d2 == 0, 1, d2)
        noise = 1 / read(filtered(inverse, lambda *k: np.exp(-0.5 * 50.0**2 * square(*k))), rows)
        factor = np.array([b.shot_noise_factor(x, 50.0) for x in noise])
        assert (factor < 1).all() and (factor > 0).all()
    s = factor * read(field, rows)
    assert np.abs(s).max() > 1e-3 and np.allclose(weight, own * (1 + s if method == "data_weights" else 1 - s), atol=1e-8)


def test_shot_noise_factor_solves_its_equation():
    """With the factor, the power at the pivot scale is what was asked for; without noise and smoothing nothing changes much."""
    b = blinding.Blinding(blind=("DESI", {"fnl": 30.0}), bias=2.0)
    k, mu, f, noise, radius = 4e-3, 0.6, b.fid.get("f", 1.0), 2e4, 30.0
    a, s, p = b.shot_noise_factor(noise, radius), np.exp(-0.5 * k**2 * radius**2), float(b.fid.power(k, 1.0))
    t = 2 * 1.686 * 30.0 / float(b.primordial(k))
    q = np.geomspace(1e-5, 10, 4096)
    q = q[np.exp(-0.5 * q**2 * radius**2) > 1e-4]
    damp = np.exp(-0.5 * k**2 * mu**2 * f**2 * np.trapezoid(np.exp(-(q**2) * radius**2) * b.fid.power(q, 1.0), q) / (6 * np.pi**2))
    undone = b.bias + (1 - s) * f * mu**2
    added = 2 * a * t * ((b.bias + f * mu**2) * undone * s * p + s * noise * damp) + (a * t) ** 2 * (undone**2 * s**2 * p + s**2 * noise)
    assert np.isclose(added, 2 * t * b.bias * (b.bias + f * mu**2) * p + t**2 * b.bias**2 * p)
    assert np.isclose(b.shot_noise_factor(0.0, 1e-3), 1, rtol=0.05)


def test_default_parameters_are_blinded():
    b = blinding.Blinding(seed=3)
    assert set(blinding.SPREADS) == {"w0_fld", "wa_fld", "Omega_m", "f", "fnl"}
    for name, spread in blinding.SPREADS.items():
        moved = abs(b.blind.get(name) - b.fid.get(name, 1.0))
        assert 0 < moved <= spread
    u = np.random.RandomState(3).uniform(size=5)
    assert np.isclose(b.blind.get("w0_fld"), -1 + 0.1 * (u[0] - 0.5)) and np.isclose(b.blind.get("fnl"), 20 * (u[4] - 0.5))
    assert blinding.Blinding(spreads={}).blind == b.fid


def shape():
    return lambda k: 2e4 * k / (1 + (k / 0.02) ** 3)  # made here, so that executors get its code and not this module's name


power = shape()


@pytest.fixture(scope="module")
def mock(spark):
    """A mock, and its delta_k and delta as arrays."""
    from skyloom.operators import mocks

    m = mocks.GaussianMock.from_power(spark, power, nmesh=N, boxsize=SIZE, boxcenter=CENTER, seed=5)
    return m, mesh.complex_to_array(m.delta_k, N)


def inverse(c):
    return np.fft.irfftn(c * N**3, s=(N, N, N), axes=(0, 1, 2))


def array(field):
    return mesh.real_to_array(field, N)


def nodes():
    c = np.arange(N) * SIZE / N
    return np.meshgrid(*[c + o - SIZE / 2 for o in CENTER], indexing="ij")


def test_noise_has_the_power_asked_for(spark, mock):
    from skyloom.operators import mocks

    m, c = mock
    white = np.fft.rfftn(array(mesh.white_noise(spark, m.grid, 5)))
    k = np.sqrt(square(*waves()))
    want = np.where(k > 0, white / N**1.5 * np.sqrt(power(np.where(k > 0, k, 1)) / SIZE**3), 0)
    assert np.allclose(c, want, atol=1e-12)
    edges = np.arange(0.005, 0.06, 0.01)
    got = mesh.power_spectrum(m.delta_k, m.grid, edges).orderBy("bin").collect()
    full = np.fft.fftn(inverse(c)) / N**3
    kk = np.sqrt(square(*np.meshgrid(*[2 * np.pi / SIZE * np.fft.fftfreq(N, 1 / N)] * 3, indexing="ij")))
    for r in got:
        own = (kk >= edges[r.bin]) & (kk < edges[r.bin + 1])
        assert r.modes == own.sum() and np.isclose(r.power, (np.abs(full[own]) ** 2).mean() * SIZE**3) and np.isclose(r.k, kk[own].mean())
    flat = mocks.GaussianMock.from_power(spark, power, nmesh=N, boxsize=SIZE, unitary=True, inverted=True, seed=5)
    u = mesh.complex_to_array(flat.delta_k, N)
    assert np.allclose(u[k > 0], -(white / np.abs(white) * np.sqrt(power(np.where(k > 0, k, 1)) / SIZE**3))[k > 0], atol=1e-12)


def test_bias_lognormal_and_selection(mock):
    m, c = mock
    d = inverse(c)
    log = np.exp(1.5 * d)
    assert np.allclose(array(m.with_real(1.5, lognormal=True).delta), log / log.mean() - 1)
    far = np.sqrt(square(*nodes()))
    assert np.allclose(array(m.with_real(lambda v, r: v * r).delta), d * far)
    nbar = lambda r, ra, dec: 1e-4 * np.exp(-((r - 900) ** 2) / 1e5) * (1 + np.cos(np.radians(ra))) * (90 - dec) / 90
    s = m.with_real().with_selection(nbar)
    x, y, z = nodes()
    n = nbar(far, np.degrees(np.arctan2(y, x)) % 360, np.degrees(np.arcsin(z / far)))
    assert np.allclose(array(s.galaxies()), (1 + d) * n) and np.isclose(s.attrs["norm"], (n**2).sum() * (SIZE / N) ** 3)
    noisy = array(m.with_real().with_white_noise(1e-3).delta)
    assert np.allclose(noisy - d, array(mesh.white_noise(m.spark, m.grid, 43)) / np.sqrt(1e-3 * (SIZE / N) ** 3))


def test_eulerian_redshift_space(spark, mock):
    from skyloom.operators import mocks

    m, c = mock
    kx, ky, kz = waves()
    k2 = np.where(square(kx, ky, kz) > 0, square(kx, ky, kz), 1)
    e = mocks.EulerianMock.from_field(spark, m.delta_k, m.grid).with_real(2.0)
    assert np.allclose(array(e.with_rsd(0.8, los="z").delta), inverse(c * (2 + 0.8 * kz**2 / k2)))
    x, r2 = nodes(), square(*nodes())
    top = np.pi / (SIZE / N) * (1 - 1e-9)
    want = 2 * inverse(c)
    for i, p in enumerate((kx, ky, kz)):
        for j, q in enumerate((kx, ky, kz)):
            keep = (i == j) | (np.abs(p) < top) & (np.abs(q) < top)
            want = want + 0.8 * x[i] * x[j] / r2 * inverse(np.where(keep, c * p * q / k2, 0))
    assert np.allclose(array(e.with_rsd(0.8).delta), want)


def test_zeldovich_sample(spark, mock):
    """Counts, displacements, wrapping and redshift space of a sample."""
    from skyloom.operators import mocks

    m, c = mock
    z = mocks.LagrangianMock.from_field(spark, m.delta_k, m.grid, los="x").with_real(lognormal=True).with_selection(2e-5)
    top, ks = np.pi / (SIZE / N) * (1 - 1e-9), waves()
    k2 = np.where(square(*ks) > 0, square(*ks), 1)
    psi = [inverse(np.where(np.abs(k) < top, 1j * k / k2 * c, 0)) for k in ks]
    assert all(np.allclose(array(z.fields[f"disp_{a}"]), p) for a, p in zip(AXES, psi))
    at = lambda df, name: np.array([[r[f"{name}_{a}"] for a in AXES] for r in sorted(df.collect(), key=lambda r: r.row_id)])
    before, after = at(mocks.GaussianMock.poisson_sample(z), "Position"), z.poisson_sample()
    cells = np.floor((before - np.array(CENTER) + SIZE / 2) / (SIZE / N)).astype(int)
    counts = np.zeros((N, N, N))
    np.add.at(counts, tuple(cells.T), 1)
    mean = np.maximum(1 + array(z.delta), 0) * 2e-5 * (SIZE / N) ** 3
    want = [np.random.Generator(np.random.Philox(key=44, counter=[0, 0, 1, i])).poisson(mean[i].ravel()) for i in range(N)]
    assert np.array_equal(counts.reshape(N, -1), np.array(want)) and abs(len(before) - mean.sum()) < 5 * np.sqrt(mean.sum())
    d = np.stack([read(p, before) for p in psi], 1)
    assert np.allclose(at(after, "Displacement"), d)
    low = np.array(CENTER) - SIZE / 2
    moved = np.mod(before + d - low, SIZE) + low
    assert np.allclose(at(after, "Position"), moved)
    assert np.allclose(at(z.with_rsd(after, 0.5), "Position"), moved + 0.5 * d * [1, 0, 0])


@pytest.mark.parametrize("resampler", ["nnb", "ngp", "cic", "tsc", "pcs"])
def test_readout_and_compensation(spark, points, resampler, monkeypatch):
    """Kernels against their definition as repeated convolutions of a cell; slabs with many rows are split."""
    monkeypatch.setattr(mesh, "READ_ROWS", 40)
    data, w, *_ = points
    r = np.random.RandomState(1)
    a, b = r.normal(size=(2, N, N, N))
    order = {"nnb": 1, "ngp": 1, "cic": 2, "tsc": 3, "pcs": 4}[resampler]

    def kernel(u):
        u = np.abs(u)
        if order == 2:
            return np.clip(1 - u, 0, None)
        if order == 3:
            return np.where(u < 0.5, 0.75 - u**2, np.where(u < 1.5, 0.5 * (1.5 - u) ** 2, 0))
        return np.where(u < 1, (4 - 6 * u**2 + 3 * u**3) / 6, np.where(u < 2, (2 - u) ** 3 / 6, 0))

    x = (data - np.array(CENTER) + SIZE / 2) / (SIZE / N)
    if order == 1:
        k = [np.eye(N)[(np.floor(x[:, i] + (0.5 if resampler == "nnb" else 0)).astype(int)) % N] for i in range(3)]
    else:
        gap = x[:, :, None] - np.arange(N)
        k = [kernel((gap[:, i] + N / 2) % N - N / 2) for i in range(3)]
    want = [np.einsum("pi,pj,pk,ijk->p", *k, f) for f in (a, b)]
    rows = mesh.readout_many({"a": mesh.real_from_array(spark, a), "b": mesh.real_from_array(spark, b)}, GRID, frame(spark, data, w), resampler).collect()
    got = np.array([(r.a, r.b) for r in sorted(rows, key=lambda r: r.row_id)]).T
    assert len(rows) == len(data) and np.allclose(got, want)
    painted = array(mesh.paint(frame(spark, data, w), GRID, resampler, weight="Weight"))
    assert np.allclose(painted, np.einsum("p,pi,pj,pk->ijk", w, *k))
    field = mesh.compensate(mesh.r2c(mesh.real_from_array(spark, a), N), GRID, resampler)
    sinc = np.prod([np.sinc(q * SIZE / N / (2 * np.pi)) ** order for q in waves()], axis=0)
    assert np.allclose(mesh.complex_to_array(field, N), np.fft.rfftn(a) / N**3 / sinc)
