"""Operators that SQL cannot express, and edge cases of the others, against numpy or by hand."""

import time

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from skyloom.functions import geometry as geo
from skyloom.functions.spline import not_a_knot, spinning_dust
from skyloom.operators import calibration, codec, components, dense, fourier, gibbs, harmonics, noise, sampling, simulation, timelines, unbinned
from skyloom.operators import mapmaking as mm
from skyloom.sources import layouts, parameters, readers, session, sinks
from skyloom.streaming import increments

rng = np.random.default_rng(11)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-9, 9), min_size=1, max_size=60))
def test_huffman(values):
    x = np.array(values)
    tree = codec.build_tree((int(s), int(n)) for s, n in zip(*np.unique(x, return_counts=True), strict=True))
    codes = tree.codes()
    data = codec.encode(x, codes)
    assert 1 <= data[0] <= 8
    assert codec.decode(data, tree, len(x)).tolist() == values
    with pytest.raises(ValueError):
        codec.decode(data, tree, len(x) + 1)
    words = sorted((f"{c:0{n}b}" for c, n in codes.values()), key=len)
    assert not any(b.startswith(a) for i, a in enumerate(words) for b in words[i + 1 :])


def test_fourier_family():
    x = rng.standard_normal(300)
    assert np.allclose(fourier.irfft_mirrored(fourier.rfft_mirrored(x), 300), x)
    y = rng.standard_normal(300)
    h = lambda f: 1 / (1 + 2j * np.pi * f * 0.3)
    assert np.isclose(fourier.transfer(x, 1.0, h) @ y, x @ fourier.transfer(y, 1.0, h, adjoint=True))
    f, p = fourier.periodogram(x, 2.0)
    assert np.isclose(2 * p.sum() - p[0] - p[-1], (x**2).sum())
    _, means = fourier.binned(f, np.full(len(f), 3.0), 8)
    assert np.allclose(means[~np.isnan(means)], 3.0)
    white = rng.standard_normal(20000) * 2
    assert 1.5 < fourier.sigma_of_psd(white, 1.0, 0.05) < 2.1


def test_correlated_noise_against_dense_solution():
    n, sigma = 40, 0.7
    mask = np.ones(n)
    mask[10:17] = 0
    x = rng.standard_normal(n)
    corr = lambda f: fourier.oof(f, sigma, 0.1, -1.5, white=False)
    c = corr(np.fft.rfftfreq(2 * n))
    inv = np.where(c > 0, 1 / np.where(c > 0, c, 1), 0)
    dense = np.stack([fourier.irfft_mirrored(inv * fourier.rfft_mirrored(e), n) for e in np.eye(n)], 1) + np.diag(mask / sigma**2)
    want = np.linalg.solve(dense, mask * x / sigma**2)
    assert np.allclose(noise.full_noise(x, mask, sigma, inv), want, atol=1e-6)
    draw = noise.constrained_noise(x, mask, sigma, inv, tolerance=1e-12, most=500)
    assert draw.converged and draw.iterations <= 8 and np.allclose(draw.noise, want, atol=1e-6)
    white, prior = rng.standard_normal(n), rng.standard_normal(n)
    drawn = noise.constrained_noise(x, mask, sigma, inv, white, prior, 1e-12, 500).noise
    assert np.allclose(drawn, noise.full_noise(x, mask, sigma, inv, white, prior), atol=1e-6)
    # what stands in a gap changes nothing
    other = np.where(mask > 0, x, 99.0)
    assert np.allclose(noise.constrained_noise(other, mask, sigma, inv, white, prior, 1e-12, 500).noise, drawn, atol=1e-6)
    assert np.allclose(noise.constrained_noise(x, np.ones(n), sigma, inv).noise, noise.stationary_noise(x, sigma, inv))


def test_gap_noise_falls_back():
    n = 60
    mask = np.ones(n)
    mask[20:30] = 0
    c = fourier.oof(np.fft.rfftfreq(2 * n), 1.0, 0.1, -1.5, white=False)
    inv = np.where(c > 0, 1 / np.where(c > 0, c, 1), 0)
    x, white, prior = (rng.standard_normal(n) for _ in range(3))
    assert noise.gap_noise(x, mask, 1.0, inv, "full_cg", white, prior)[1] == "full_cg"
    assert noise.gap_noise(x, mask, 1.0, inv, "full_cg", white, prior, most=0)[1] == "fallback"
    assert noise.gap_noise(x, mask, 1.0, inv, "full_cg", white, 1e4 * prior)[1] == "fallback"
    assert noise.gap_noise(x, mask, 1.0, inv, "fallback", white, prior)[1] == "fallback"
    with pytest.raises(ValueError):
        noise.gap_noise(x, mask, 1.0, inv, "none", white, prior)


def test_noise_step():
    n = 2000
    x = noise.stationary_noise(rng.standard_normal(n), 1.0, np.full(n + 1, 1.0)) + rng.standard_normal(n) + 5
    mask = np.ones(n)
    mask[300:340] = 0
    draws = (rng.standard_normal(n), rng.standard_normal(n), np.full(4, 0.5))
    for mode, most, status in (("full", 100, "converged"), ("full", 0, "stationary"), ("offset", 100, "offset"), ("no_offset", 100, "converged")):
        step = noise.noise_step(x, mask, 10.0, 1.0, 0.5, -1.0, draws, mode, most)
        assert step.status == status and np.isfinite(step.noise).all() and step.sigma0 == 1.0
        if mode == "no_offset":
            assert abs(step.noise.mean()) < 1e-9
    assert np.allclose(noise.noise_step(x, mask, 10.0, 1.0, 0.5, -1.0, draws, "offset").noise, x[mask > 0].mean(), atol=0.2)
    assert noise.noise_step(x, 0 * mask, 10.0, 1.0, 0.5, -1.0, draws).status == "empty"
    assert noise.noise_step(x, mask, 10.0, 1.0, 0.5, -1.0, (draws[0], 1e6 * draws[1], draws[2])).status == "high_variance"
    with pytest.raises(ValueError):
        noise.noise_step(x, mask, 10.0, 0.0, 0.5, -1.0, draws)
    assert 0.5 < noise.noise_step(x, mask, 10.0, None, 0.5, -1.0, draws).sigma0 < 1.6


def test_noise_parameters_recover_the_spectrum():
    n, fs = 1 << 14, 50.0
    f = np.fft.rfftfreq(n, 1 / fs)
    x = np.fft.irfft(np.fft.rfft(rng.standard_normal(n)) * np.sqrt(fourier.oof(f, 1.0, 1.0, -1.6)), n)
    for options in ({}, {"binned": True}, {"window": (0.02, 20.0)}, {"window": (0.02, 20.0), "binned": True}):
        knee, slope = noise.fitted_parameters(x, fs, 1.0, 0.3, -1.0, np.full(10, 0.5), **options)
        assert 0.7 < knee < 1.4 and -1.9 < slope < -1.3
    # a narrow prior decides, a window without modes changes nothing
    knee, slope = noise.fitted_parameters(x, fs, 1.0, 0.3, -1.0, np.full(10, 0.5), prior=lambda k, a: -0.5 * ((a + 0.8) / 1e-4) ** 2)
    assert abs(slope + 0.8) < 0.02
    assert noise.fitted_parameters(x, fs, 1.0, 0.3, -1.0, np.full(10, 0.5), window=(1e3, 2e3)) == (0.3, -1.0)
    edges = noise.log_bins(5000)
    assert edges[0] == 0 and edges[-1] == 5000 and (np.diff(edges) > 0).all() and len(edges) <= 101


def test_temporal_gain_against_dense_solution():
    n = 30
    a, b = rng.random(n) + 0.5, rng.standard_normal(n)
    f = np.fft.rfftfreq(n)
    prior = np.where(f > 0, np.where(f > 0, f, 1.0) ** -2.0, 0)
    inv = np.where(prior > 0, 1 / np.where(prior > 0, prior, 1), 0)
    dense = np.stack([np.fft.irfft(inv * np.fft.rfft(e), n) for e in np.eye(n)], 1) + np.diag(a)
    want = np.linalg.solve(dense, b)
    assert np.allclose(fourier.temporal_gain(a, b, prior), want - want.mean(), atol=1e-7)
    assert fourier.temporal_gain(a[:1], b[:1], prior[:1]).tolist() == [0.0]


def test_harmonics():
    nside, lmax = 4, 5
    w = np.array([ell for ell, _ in harmonics.pairs(lmax)])
    alm = rng.standard_normal(len(w)) + 1j * rng.standard_normal(len(w))
    alm[: lmax + 1] = alm[: lmax + 1].real
    m = rng.standard_normal(12 * nside**2)
    assert np.isclose(harmonics.synthesis(alm, nside, lmax) @ m, harmonics.dot(alm, harmonics.adjoint(m, nside, lmax), lmax))
    assert np.allclose(harmonics.least_squares(harmonics.synthesis(alm, nside, lmax), nside, lmax), alm, atol=1e-8)
    theta, phi = harmonics.directions(nside)
    one = np.zeros(len(w), complex)
    one[0] = np.sqrt(4 * np.pi)
    one[1] = np.sqrt(4 * np.pi / 3)
    assert np.allclose(harmonics.synthesis(one, nside, lmax), 1 + np.cos(theta))
    e, b = (np.where(w >= 2, rng.standard_normal(len(w)) + 1j * rng.standard_normal(len(w)), 0) for _ in range(2))
    e[: lmax + 1], b[: lmax + 1] = e[: lmax + 1].real, b[: lmax + 1].real
    q, u = harmonics.synthesis_spin2(e, b, nside, lmax)
    x, y = rng.standard_normal(len(q)), rng.standard_normal(len(q))
    ae, ab = harmonics.adjoint_spin2(x, y, nside, lmax)
    assert np.isclose(q @ x + u @ y, harmonics.dot(e, ae, lmax) + harmonics.dot(b, ab, lmax))
    ones = np.ones(len(theta))
    smooth, rms = harmonics.smooth(ones * 3, ones * 2, nside, 0, np.ones(1))
    assert np.allclose(smooth, 3) and np.allclose(rms, 2)


def test_directions_and_pixels_agree(spark):
    theta, phi = harmonics.directions(4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(theta, phi, strict=True))], "p long, t double, f double")
    got = df.select("p", "t", "f", geo.ang2pix(4, F.col("t"), F.col("f")).alias("q"), geo.pix2z(4, F.col("p")).alias("z"), geo.pix2phi(4, F.col("p")).alias("phi")).toPandas()
    assert (got.p == got.q).all() and np.allclose(np.cos(got.t), got.z) and np.allclose(got.f, got.phi)
    down = spark.range(12 * 64).select(geo.regrade(8, 4, F.col("id")).alias("q")).groupBy("q").count().toPandas()
    assert len(down) == 192 and (down["count"] == 4).all()


def test_amplitude_solver_against_dense_solution():
    nside, lmax = 2, 2
    bands = [sampling.Band(rng.standard_normal(48), rng.random(48) + 0.1, np.exp(-0.1 * np.arange(3) * s)) for s in (1.0, 2.0, 3.0)]
    s = sampling.AmplitudeSolver(bands, rng.random((3, 2)) + 0.2, np.full((2, 3), 2.0), nside, lmax)
    a = s.solve()
    residual = s.rhs() - s.apply(a / s.root)
    assert np.abs(residual).max() < 1e-6 * np.abs(s.rhs()).max()


def test_metropolis_and_groups():
    density = sampling.bounded(lambda at: 0.0, {"b": (-5, 9)}, {"b": (2.0, 0.5)})
    step, draws = sampling.gaussian_step({"b": 1.0}), np.random.default_rng(2)
    here, seen, taken = {"b": 0.0}, [], 0
    for _ in range(400):
        here, _, n = sampling.metropolis(here, density, step, 10, draws)
        taken += n
        seen.append(here["b"])
    assert abs(np.mean(seen) - 2) < 0.15 and 0.35 < np.std(seen) < 0.65 and 0 < taken < 4000
    # outside the bounds nothing is accepted, and what was solved for the state stays with it
    last, solved, taken = sampling.metropolis({"b": 1.0}, lambda at: (0.0 if at["b"] == 1.0 else -np.inf, at["b"]), step, 50, draws)
    assert (last, solved, taken) == ({"b": 1.0}, 1.0, 0)
    P = sampling.Parameter
    both = [P("dust", pol, "beta", 1.5, 0.1, 0, 3, (1.5, 0.1)) for pol in ("I", "QU")]
    assert list(sampling.parameter_groups([*both, P("cmb", "I", "t", 2.7, 0, 0, 3)])) == [("dust", "beta")]
    assert sampling.parameter_groups(both, ["cmb"]) == {}
    for wrong in (P("dust", "QU", "beta", 1.4, 0.1, 0, 3), P("a", "I", "b", 5, 0.1, 0, 3), P("a", "I", "b", 1, -1, 0, 3), P("a", "I", "b", 1, 1, 3, 0), P("a", "I", "b", 1, 1, 0, 3, (1, 0))):
        with pytest.raises(ValueError):
            sampling.parameter_groups([*both, wrong])


def test_gibbs_cycle_records():
    seen = []
    out = sampling.gibbs([("a", lambda s: {"a": s["a"] + s["b"]}), ("b", lambda s: {"b": s["a"]})], {"a": 1, "b": 1}, 3, lambda k, s: seen.append((k, s["b"])))
    assert out == {"a": 8, "b": 8} and seen == [(0, 2), (1, 4), (2, 8)]


def test_gaps_at_edges_and_without_samples(spark):
    rows = [("a", i, float(i), i not in (0, 1, 5)) for i in range(8)] + [("b", i, 1.0, False) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, i long, v double, keep boolean")
    got = {(r.k, r.i): r.filled for r in timelines.fill_gaps(df, ["k"], "v", "keep").collect()}
    assert got["a", 0] == got["a", 1] == np.mean([2, 3, 4, 6, 7])
    assert got["a", 5] == (np.mean([2, 3, 4]) + np.mean([6, 7])) / 2
    assert [got["b", i] for i in range(3)] == [0, 0, 0]


def test_levels_without_enough_pairs(spark):
    df = spark.createDataFrame([("a", i, float(i * i), True) for i in range(6)] + [("b", 0, 1.0, True)], "k string, i long, v double, keep boolean")
    got = {r.k: r.sigma0 for r in timelines.sigma_robust(df, ["k"], "v", "keep").collect()}
    assert got == {"a": float("inf"), "b": float("inf")}
    assert {r.k: r.pairs for r in timelines.sigma_simple(df, ["k"], "v", "keep").collect()} == {"a": 5, "b": 0}


def test_gain_without_weight_stays(spark):
    sums = spark.createDataFrame([("x", 1, 2.0, 4.0), ("x", 2, 1.0, 0.0), ("x", 3, 3.0, 2.0)], "g string, det long, r double, d double")
    got = {r.det: r.gain for r in calibration.relative_gain(sums, ["g"], "det", F.lit(7.0), F.lit(0.0)).collect()}
    assert got[2] == 7.0 and abs(got[1] + got[3]) < 1e-12
    assert [r.gain for r in calibration.absolute_gain(sums.where("det = 2"), ["g"], F.lit(7.0), F.lit(0.0)).collect()] == [7.0]


def test_readers_and_sinks(spark, tmp_path):
    rows = [("A", 1, 0, 1.0, [0.0] * 3, [1e-4, 2e-4], [1, 2], [0.1, 0.2], [0, 0]), ("A", 2, 0, 1.0, [0.0] * 3, [0.0, 0.0], [1, 2], [0.1, 0.2], [0, 0]), ("A", 3, 0, 1.0, [0.0] * 3, [1e-4, 1e-4], [1, 2], [0.1, 0.2], [1, 0]), ("A", 4, 0, 1.0, [0.0] * 3, [1e-4, float("nan")], [1, 2], [0.1, 0.2], [0, 0])]
    spark.createDataFrame(rows, readers.SCANS).write.parquet(str(tmp_path / "scans"))
    got = readers.read_samples("scans", spark, str(tmp_path / "scans")).orderBy("i").collect()
    assert [(r.scan_id, r.i, r.pix) for r in got] == [(1, 0, 1), (1, 1, 2)]
    bad = spark.createDataFrame([(1,)], "scan_id long")
    assert readers.read_samples("scans", spark, str(tmp_path / "scans"), bad_scans=bad).count() == 0
    with pytest.raises(ValueError):
        readers.read_samples("none", spark)
    m = spark.createDataFrame([("A", 1, 2.0)], "band string, pix long, v double")
    chain = str(tmp_path / "chain")
    assert sinks.write_chain(m, chain, 0, 2) and sinks.write_chain(m.withColumn("v", F.lit(3.0)), chain, 0, 4)
    assert not sinks.write_chain(m, chain, 0, 5, every=2)
    assert sinks.read_chain(spark, chain, 0).first().v == 3.0 and sinks.read_chain(spark, chain, 0, 2).first().v == 2.0
    (tmp_path / "cat.dat").write_text("# made by hand\n# name flux\nx 1.5\n\ny  2\n")
    assert [tuple(r) for r in readers.read_catalogue(spark, str(tmp_path / "cat.dat")).orderBy("name").collect()] == [("x", "1.5"), ("y", "2")]
    sinks.write_manifest(spark.createDataFrame([(2, "b"), (1, "a")], "pid long, path string"), str(tmp_path / "list"))
    assert [r.value for r in spark.read.text(str(tmp_path / "list")).collect()] == ['1 "a" 1 0.0 0.0', '2 "b" 1 0.0 0.0']
    flat = sinks.flat_form(spark.createDataFrame([(2, [3.0]), (1, [1.0, 2.0])], "k long, v array<double>"), ["k"], "v").first()
    assert flat.lengths == [2, 1] and flat.flat == [1.0, 2.0, 3.0]


def test_streamed_map_equals_batch_map(spark, tmp_path):
    rows = [("A", i % 3, 0.1 * i, float(i), 1.0) for i in range(60)]
    schema = "band string, pix long, psi double, tod double, sigma0 double"
    df = spark.createDataFrame(rows, schema)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sums = increments.map_increments(stream, ["band", "pix"], F.lit(1.0), F.col("tod"))
    q = sums.writeStream.outputMode("complete").format("memory").queryName("maps").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = mm.solve_maps(spark.table("maps"), ["band", "pix"]).orderBy("pix").toPandas()
    want = mm.solve_maps(mm.normal_equations(df, ["band", "pix"], F.lit(1.0), F.col("tod")), ["band", "pix"]).orderBy("pix").toPandas()
    assert np.allclose(got.s_i, want.s_i) and (got.hits == want.hits).all()


def test_streamed_windows(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(str(tmp_path / "ev"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    w = increments.windowed(increments.read_events(spark, str(tmp_path / "ev"), schema), "1 day", "60 days", ["event_type"], "value")
    q = w.writeStream.outputMode("complete").format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").agg(F.sum("n")).first()[0] == 1000


def test_selection_of_scans_with_nan(spark):
    stats = spark.createDataFrame([("a", 0.9, 1.0), ("a", 0.9, float("nan")), ("a", 0.1, 1.0), ("a", 0.9, 9.0)], "k string, good_fraction double, chisq_z double")
    r = calibration.selection_counts(stats, ["k"], 0.5, 5.0).first()
    assert (r.present, r.accepted, r.low_fraction, r.bad_chisq) == (4, 1, 1, 2)


def test_dense_solvers():
    m = rng.standard_normal((50, 4, 4))
    a = m @ m.transpose(0, 2, 1) + 0.1 * np.eye(4)
    b = rng.standard_normal((50, 4))
    a[7] = -np.eye(4)
    x, ok = dense.cholesky_solve(a, b)
    assert not ok[7] and not x[7].any() and ok.sum() == 49
    assert np.allclose(x[ok], np.linalg.solve(a[ok], b[ok][..., None])[..., 0])
    f, order, regular = dense.lu(m[0])
    assert regular and np.allclose(dense.lu_solve(f, order, b[0]), np.linalg.solve(m[0], b[0]))
    assert not dense.lu(np.zeros((3, 3)))[2]
    assert np.allclose(dense.floored_inverse(a[0]), np.linalg.inv(a[0]))
    symmetric, least, _ = dense.check_operator(dense.operator_matrix(lambda v: a[0] @ v, 4))
    assert symmetric and least > 0


def test_spline_is_exact_for_cubics():
    x = np.sort(rng.random(9)) * 4
    p = np.poly1d([0.3, -1, 2, 0.5])
    at = np.linspace(x[0], x[-1], 50)
    assert np.allclose(not_a_knot(x, p(x), at), p(at))
    nu = np.geomspace(1, 100, 40)
    sed = spinning_dust(np.array([20.0, 22.0, 1000.0]), 22.0, 30.0, nu, nu**1.5, 30.0)
    assert np.isclose(sed[0], (20 / 22) ** -0.5) and sed[1] == 1 and sed[2] == 0


def test_smoothing_and_random_coefficients():
    nside, lmax = 4, 6
    alm = harmonics.random_alm(np.ones(lmax + 1), 2, np.random.default_rng(2))
    ell = np.array([x for x, _ in harmonics.pairs(lmax)])
    assert not alm[ell < 2].any() and not alm[: lmax + 1].imag.any()
    m = harmonics.synthesis(alm, nside, lmax)
    got = harmonics.band_sky(m, 2.0, nside, lmax, 600.0, 1000.0)
    assert np.allclose(got, 2 * harmonics.synthesis(alm * harmonics.gaussian_window(lmax, 800.0)[ell], nside, lmax), atol=1e-7)
    assert harmonics.smooth_to(m, nside, lmax, 10.0, 5.0) is m


def test_simulation_repeats_whatever_the_partitions(spark):
    df = spark.createDataFrame([(k, i, float(i)) for k in range(3) for i in range(64)], "k long, i long, s double")
    a, b = (simulation.simulate(x, ["k"], "s", 3, 1.0, 1.0, 0.1, -1.5).orderBy("k", "i").collect() for x in (df, df.repartition(7)))
    assert a == b and len({r.tod for r in a}) == 192
    x = simulation.noise(1 << 16, 1.0, 2.0, 0.0, -1.0, np.random.default_rng(1))
    assert abs(x.std() - 2) < 0.05


def test_parameters(tmp_path):
    (tmp_path / "in.yml").write_text("nu: 30\nname: low\n")
    (tmp_path / "p.yml").write_text("general:\n  factor: 2\nbands:\n  a: !inc in.yml\n  b:\n    nu: 44\n    factor: 3\n")
    p = parameters.load(tmp_path / "p.yml")
    assert p.bands.a.nu == 30 and p.bands.b._name == "b"
    assert [parameters.resolve("factor", b, p.general, default=1) for b in (p.bands.a, p.bands.b)] == [2, 3]
    with pytest.raises(ValueError, match="temp"):
        parameters.check_keys({"temp": 1}, {"temporal"})
    groups = parameters.check_groups({"g": {"components": ["x"]}, "h": {}}, {"x", "y"}, {"a", "b"})
    assert groups == {"g": (["x"], ["a", "b"]), "h": (["x", "y"], ["a", "b"])}
    with pytest.raises(ValueError, match="unknown bands z"):
        parameters.check_groups({"g": {"bands": ["z"]}}, {"x"}, {"a"})
    with pytest.raises(ValueError, match="no amplitude groups q"):
        parameters.check_tiers(groups, {"s": {"resolve": ["q"]}})
    assert parameters.transfer_of({"tau": 1}, None)["tau"] == 1 and parameters.transfer_of({}, {"kind": "x"}) == {"kind": "x"}
    assert parameters.views({"a": "IQU", "b": "I"}, 2) == [[("a", "I"), ("b", "I")], [("a", "QU")]]


def test_harmonics_of_high_degree():
    """Legendre polynomials, the addition theorem, a round trip up to the resolution's limit."""
    theta = np.array([0.003, 0.2, 1.1, 1.5, 3.1])
    for ell in (1, 56, 191, 600):
        want = np.polynomial.legendre.legval(np.cos(theta), [0] * ell + [1])
        assert np.allclose(harmonics.wigner_d(ell, 0, 0, theta)[ell], want, atol=1e-10)
    for spin, least in ((0, 0), (2, 2)):
        total = np.zeros((151, len(theta)))
        for m in range(151):
            for lam in harmonics.lambdas(150, m, theta, spin):
                total[m:] += (1 if m == 0 else 2) * lam**2 * (2 if spin else 1) / (2 if spin else 1)
        ells = np.arange(151)
        want = (2 * ells + 1) / (4 * np.pi) * (ells >= least)
        assert np.allclose(total, want[:, None], rtol=1e-9, atol=1e-12)
    nside, lmax = 16, 31
    a = harmonics.random_alm(np.ones(lmax + 1), 0, rng)
    assert np.allclose(harmonics.least_squares(harmonics.synthesis(a, nside, lmax), nside, lmax), a, atol=1e-9)
    e, b = (harmonics.random_alm(np.ones(lmax + 1), 2, rng) for _ in range(2))
    got = harmonics.least_squares_spin2(*harmonics.synthesis_spin2(e, b, nside, lmax), nside, lmax)
    assert np.allclose(got[0], e, atol=1e-9) and np.allclose(got[1], b, atol=1e-9)
    x = rng.standard_normal(12 * nside**2)
    w = np.array([1.0 if m == 0 else 2.0 for _, m in harmonics.pairs(lmax)])
    assert np.isclose(np.sum(w * (harmonics.analysis(x, nside, lmax).conj() * a).real), harmonics.analysis_adjoint(a, nside, lmax) @ x)


def test_harmonic_tables_equal_the_arrays(spark):
    nside, lmax = 4, 7
    lm = harmonics.pairs(lmax)
    e, b = (harmonics.random_alm(np.ones(lmax + 1), 2, rng) for _ in range(2))
    rows = [(k, ell, m, float(x[j].real), float(x[j].imag), float(y[j].real), float(y[j].imag)) for k, (x, y) in enumerate(((e, b), (b, 2 * e))) for j, (ell, m) in enumerate(lm)]
    table = spark.createDataFrame(rows, "k int, l int, m int, e_re double, e_im double, b_re double, b_im double")
    maps = harmonics.synthesis_table(table, ["k"], nside, lmax, ("e", "b"), ("q", "u"))
    got = maps.orderBy("k", "pix").toPandas()
    for k, (x, y) in enumerate(((e, b), (b, 2 * e))):
        q, u = harmonics.synthesis_spin2(x, y, nside, lmax)
        assert np.allclose(got[got.k == k].q, q) and np.allclose(got[got.k == k].u, u)
    back = harmonics.adjoint_table(maps.where("pix <> 5"), ["k"], nside, lmax, ("q", "u"), ("e", "b")).where("k = 0").orderBy("m", "l").toPandas()
    q, u = harmonics.synthesis_spin2(e, b, nside, lmax)
    q[5] = u[5] = 0
    we, wb = harmonics.adjoint_spin2(q, u, nside, lmax)
    assert np.allclose(back.e_re + 1j * back.e_im, we) and np.allclose(back.b_re + 1j * back.b_im, wb)
    none = harmonics.synthesis_table(table.where("k > 9"), ["k"], nside, lmax, ("e", "b"), ("q", "u"))
    assert none.count() == 0


def test_preconditioners_lead_to_the_same_solution():
    nside, lmax = 2, 3
    bands = [sampling.Band(rng.standard_normal(48), rng.random(48) + 0.5, np.exp(-0.1 * np.arange(lmax + 1) * s)) for s in (1.0, 2.0, 3.0)]
    solver = sampling.AmplitudeSolver(bands, rng.random((3, 2)) + 0.2, np.full((2, lmax + 1), 2.0), nside, lmax)
    want = solver.solve()
    for kind in sampling.PRECONDITIONERS:
        assert np.allclose(solver.solve(preconditioner=kind), want, atol=1e-6), kind
    with pytest.raises(ValueError):
        solver.preconditioner("other")


def brute_jumps(x, flags, valid, n):
    """One jump after the other, on samples that are corrected in place."""
    x, found, skipped, i = x.copy(), [], 0, 0
    while i < len(x):
        if not flags[i]:
            i += 1
            continue
        j = i
        while j < len(x) and flags[j]:
            j += 1
        before = [k for k in range(i) if valid[k]][-n:]
        after = [k for k in range(j, len(x)) if valid[k]][:n]
        if len(before) < n or len(after) < n:
            skipped += 1
        else:
            offset = x[before].mean() - x[after].mean()
            x[j:] += offset
            found.append((j, offset))
        i = j
    return found, skipped


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(-9, 9), st.sampled_from([0, 0, 0, 2, 1]), st.booleans()), max_size=40), st.integers(1, 4))
def test_level_changes(rows, n):
    x, flags, extra = (np.array([r[k] for r in rows]) for k in range(3))
    flags = flags.astype(int) == 2
    valid = ~flags & extra.astype(bool)
    places, offsets, skipped = timelines.level_changes(x.astype(float), flags, valid, n)
    want, left_out = brute_jumps(x.astype(float), flags, valid, n)
    assert skipped == left_out and places.tolist() == [p for p, _ in want]
    assert np.allclose(offsets, [o for _, o in want])


def stairs(jumps):
    """Three samples of a level, then a flagged one after which the level is one higher."""
    i = np.arange(4 * (jumps + 1))
    return i, (i // 4).astype(float), np.where((i % 4 == 3) & (i < 4 * jumps), 2, 0)


def test_level_changes_of_many_jumps():
    """A jump's offset takes its own two windows, not a pass over all earlier jumps."""
    _, x, flags = stairs(4000)
    began = time.process_time()
    places, offsets, skipped = timelines.level_changes(x, flags != 0, flags == 0, 3)
    assert time.process_time() - began < 20
    assert skipped == 0 and places.tolist() == list(range(4, 16001, 4)) and (offsets == -1).all()


def unbinned_samples(spark, scans=6, n=25):
    rows = []
    for s in range(scans):
        for i in range(n):
            rows.append((s, i, int(rng.integers(0, 12)), float(rng.random() * 3), float(rng.standard_normal()), 1.0 + s % 3))
    return spark.createDataFrame(rows, "scan long, i long, pix long, psi double, tod double, sigma0 double")


def test_unbinned_operator_is_symmetric_and_solved(spark):
    """Against the dense matrix of P, T and N^-1; with a time constant the binned map is another one."""
    x = unbinned_samples(spark)
    model = unbinned.ScanModel(1.0, unbinned.white_without_mean, lambda f: 1 / (1 + 2j * np.pi * f * 0.7))
    pdf = x.toPandas()
    total, right = np.zeros((36, 36)), np.zeros(36)
    for _, scan in pdf.groupby("scan"):
        scan = scan.sort_values("i")
        n = len(scan)
        p = np.zeros((n, 36))
        for k, (pix, psi) in enumerate(zip(scan.pix, scan.psi, strict=True)):
            p[k, 3 * pix : 3 * pix + 3] = 1, np.cos(2 * psi), np.sin(2 * psi)
        t = np.stack([model.transfer(e) for e in np.eye(n)], 1)
        assert np.allclose(np.stack([model.transfer_adjoint(e) for e in np.eye(n)], 1), t.T)
        inv = (np.eye(n) - 1 / n) / scan.sigma0.iloc[0] ** 2
        total += p.T @ t.T @ inv @ t @ p
        right += p.T @ t.T @ inv @ scan.tod.to_numpy()
    flat = lambda df: df.orderBy("pix").select("s_i", "s_q", "s_u").toPandas().to_numpy().ravel()
    assert np.allclose(flat(unbinned.right_side(x, ["scan"], model)), right)
    sky = spark.createDataFrame([(k, *map(float, rng.standard_normal(3))) for k in range(12)], "pix long, s_i double, s_q double, s_u double")
    assert np.allclose(flat(unbinned.left_side(x, ["scan"], model, sky, 12)), total @ flat(sky))
    session.ensure_checkpoint_dir(spark)
    got = flat(unbinned.solve(x, ["scan"], model, 12, 1e-8, 80))
    assert np.allclose(total @ got, right, atol=1e-4)
    white = unbinned.ScanModel(1.0, unbinned.white)
    binned = mm.solve_maps(mm.normal_equations(x, ["pix"], F.lit(1.0) / (F.col("sigma0") * F.col("sigma0")), F.col("tod")), ["pix"])
    assert np.allclose(flat(unbinned.solve(x, ["scan"], white, 12, 1e-10)), flat(binned), atol=1e-6)
    assert not np.allclose(got, flat(binned), atol=1e-2)
    with pytest.raises(ValueError):
        model.data_side(np.array([1.0, np.nan]), 1.0)


def test_long_codes_and_streams():
    """Codes longer than the decoder's window, and streams of another length."""
    counts = [(k, 2**k) for k in range(24)]
    tree = codec.build_tree(counts)
    codes = tree.codes()
    assert max(n for _, n in codes.values()) > codec.WINDOW
    x = np.array([0, 1, 23, 22, 0, 5, 3, 23, 0] * 40)
    data = codec.encode(x, codes)
    assert codec.decode(data, tree, len(x)).tolist() == x.tolist()
    for wrong in (len(x) - 1, len(x) + 1):
        with pytest.raises(ValueError):
            codec.decode(data, tree, wrong)
    with pytest.raises(ValueError):
        codec.encode(np.array([99]), codes)


def test_nested_pixels(spark):
    """A nested pixel's parent is its number without the last two bits, as a bijection of all pixels."""
    for nside in (2, 8):
        got = spark.range(12 * nside**2).select("id", layouts.nested_to_ring(nside, F.col("id")).alias("pix"))
        up = geo.with_coarser(got, nside, nside // 2).withColumnRenamed("pix", "up")
        rows = got.join(up, "id").select("id", "pix", "up", layouts.nested_to_ring(nside // 2, F.floor(F.col("id") / 4)).alias("parent")).toPandas()
        assert sorted(rows.pix) == list(range(12 * nside**2)) and (rows.up == rows.parent).all()


def test_with_pixel_equals_the_expression(spark):
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(np.arccos(rng.uniform(-1, 1, 3000)), rng.uniform(-7, 14, 3000), strict=True)] + [(0.0, 0.0), (3.141592653589793, 6.3)], "t double, f double")
    for nside in (1, 4, 64):
        got = geo.with_pixel(df, nside, F.col("t"), F.col("f"), "p").select("p", geo.ang2pix(nside, F.col("t"), F.col("f")).alias("q")).toPandas()
        assert (got.p == got.q).all()


def test_selection_window_and_masks(spark):
    on = {"enabled": True, "first": 2, "last": 4, "most_z": 5.0}
    assert [calibration.selection_window(on, k, True)[0] for k in range(1, 6)] == [False, True, True, True, False]
    assert not calibration.selection_window(on, 3, False)[0] and calibration.selection_window(on | {"needs_noise": False}, 3, False) == (True, 5.0, 0.1)
    assert calibration.selection_window({}, 3, True) == (False, 1e4, 0.1)
    m = spark.range(48).select(F.col("id").alias("pix"), F.lit(True).alias("keep"))
    assert mm.keeps_all(mm.threshold_mask(m, 2, 1))


def test_horizon(spark):
    """At the pole azimuth is minus the hour angle and elevation the declination; a star's zenith is its latitude."""
    df = spark.createDataFrame([(0.3, 0.7), (2.0, 1.2)], "az double, el double")
    dec, ra = geo.celestial(F.col("az"), F.col("el"), np.pi / 2, F.lit(1.0))
    got = df.select(dec.alias("dec"), ra.alias("ra"), "az", "el").toPandas()
    assert np.allclose(got.dec, got.el) and np.allclose(np.mod(got.ra - 1.0 - (got.az - np.pi), 2 * np.pi) % (2 * np.pi), 0, atol=1e-9) or np.allclose(np.cos(got.ra - 1.0), -np.cos(got.az))
    up = df.select(geo.celestial(F.lit(0.3), F.lit(np.pi / 2), -0.4, F.lit(2.0))[0].alias("dec")).first()
    assert np.isclose(up.dec, -0.4)


def test_component_views_round_trip(spark):
    rows = [(c, p, ell, m, float(ell + m), float(m)) for c in (1, 2) for p in ("I", "E", "B") for ell in range(3) for m in range(ell + 1) if not (c == 2 and p != "I")]
    a = spark.createDataFrame(rows, "comp int, pol string, l int, m int, re double, im double")
    whole = components.joined(a)
    back = components.split(whole, "I").unionByName(components.split(whole, "QU"))
    assert sorted(map(tuple, back.select(a.columns).collect())) == sorted(rows)
    assert components.unmatched(a, a.withColumn("comp", F.col("comp") + 1), ["comp", "pol"]).select("comp").distinct().collect()[0][0] in (2, 3)
    with pytest.raises(Exception, match="no polarisation"):
        components.views_of(spark.createDataFrame([("a", "A", "a", "V", True, 1)], "comp string, class string, short string, pol string, enabled boolean, lmax int")).collect()
    assert components.full_lmax(64) == 160


def test_chain_restarts(spark, tmp_path):
    """A chain that goes on from its last iteration is the chain that was never stopped."""
    rows = [(b, d, s, int(rng.integers(0, 12)), float(rng.random() * 3), 0.0, 1.0) for b in "AN" for d in range(2) for s in range(2) for _ in range(90)]
    x = spark.createDataFrame(rows, "band string, det_id long, scan_id long, pix long, psi double, tod double, sigma0 double")
    x = x.withColumn("tod", F.lit(2.0) * (F.col("pix") % 5 + 3.0) * (F.lit(1.0) + F.col("det_id") * 0.1) + F.cos(F.col("psi") * 9.0))
    sky = spark.range(12).select(F.col("id").alias("pix"), (F.col("id") % 5 + 3.0).alias("s_i"), F.lit(0.0).alias("s_q"), F.lit(0.0).alias("s_u"))
    mixing = spark.createDataFrame([("A", 1.0), ("N", 1.0)], "band string, m0 double")
    chain = gibbs.Chain(spark, str(tmp_path / "chain"))
    maps = gibbs.run(chain, x, sky, mixing, 1, 12, 2)
    assert maps.count() == 24 and chain.last("gains").count() == 8 and chain.last("gains", 1).count() == 8
    g = chain.last("gains", 1).groupBy("band").agg(F.max("g_abs").alias("a"), F.sum("g_rel").alias("r")).collect()
    assert all(2.0 < r.a < 2.2 and abs(r.r) < 1e-6 for r in g)
    fresh = gibbs.first_gains(x)
    assert gibbs.resumed(fresh, None).where("g_abs = 1").count() == 8
    assert gibbs.resumed(fresh, chain.last("gains").where("det_id = 0")).where("g_abs = 1").count() == 4


def test_shared_folder_must_be_shared(spark, monkeypatch):
    class Far:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Far()

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_diagnostics_without_pixels(spark, tmp_path):
    """With every scan rejected the maps are empty, not unreadable; a band's name stays a string."""
    x = spark.createDataFrame([("30", k % 2, 0.3 * k) for k in range(6)], "band string, pix long, psi double")
    for least, want in ((0, {("30", 0), ("30", 1)}), (9, set())):
        kept = x.groupBy("band").count().where(F.col("count") >= least)
        equations = mm.fused_equations(x, kept, ["band"], ["band", "pix"], F.lit(1.0), {"s": F.col("psi")})
        path = str(tmp_path / f"maps{least}")
        schema = sinks.write_diagnostics(equations, mm.solve_fused(equations, ["band", "pix"], ("s",)), path)
        got = spark.read.schema(schema).parquet(path)
        assert {(r.band, r.pix) for r in got.collect()} == want and "s_rms" in got.columns


def test_many_jumps_are_applied(spark):
    """A scan with 4000 jumps, its catalogue packed and unpacked, comes back to its first level."""
    i, x, flags = stairs(4000)
    rows = pd.DataFrame({"scan": 1, "i": i, "tod": x, "flag": flags, "valid": flags == 0})
    df = spark.createDataFrame(rows)
    began = time.perf_counter()
    catalogue = timelines.unpack_jumps(timelines.pack_jumps(timelines.detect_jumps(df, ["scan"], "tod", 2, 3), ["scan"]), ["scan"])
    got = timelines.apply_jumps(df, catalogue, ["scan"], "tod").where("valid").toPandas()
    assert time.perf_counter() - began < 40
    assert len(got) == 12004 and (got.corrected == 0).all()


def test_a_jump_takes_arithmetic_alone():
    """A scan of 100 000 jumps takes its windows at once, not two calls a jump."""
    _, x, flags = stairs(100_000)
    began = time.process_time()
    places, offsets, _ = timelines.level_changes(x, flags != 0, flags == 0, 3)
    assert time.process_time() - began < 1.2
    assert len(places) == 100_000 and (offsets == -1).all()


def test_samples_with_jumps_are_dealt_by_scan(spark):
    """Detection reads and deals the samples once, application joins no sample by its place."""
    rows = [("a", 1, i, float(i // 4), 2 * (i % 4 == 3), i % 4 != 3) for i in range(16)] + [("a", 2, i, 1.0, 0, True) for i in range(5)] + [(None, 2, 0, 1.0, 2, False)]
    df = spark.createDataFrame(rows, "band string, scan long, i long, tod double, flag int, valid boolean").withColumn("other", F.lit(7))
    found = timelines.detect_jumps(df, ["band", "scan"], "tod", 2, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert [(r.band, r.scan, [(j.loc, j.offset) for j in r.jumps], r.skipped) for r in found.collect()] == [("a", 1, [(4, -1.0), (8, -1.0), (12, -1.0)], 1)]
    got = timelines.apply_jumps(df, timelines.unpack_jumps(timelines.pack_jumps(found, ["band", "scan"]), ["band", "scan"]), ["band", "scan"], "tod")
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.columns == [*df.columns, "corrected"] and got.count() == len(rows) and got.where("other != 7").count() == 0
    assert {r.corrected for r in got.where("scan = 1 and valid").collect()} == {0.0} and {r.corrected for r in got.where("scan = 2").collect()} == {1.0}


def test_a_jump_without_a_sample_at_its_place(spark):
    """A jump moves all samples from its place on, also where the sample at its place is missing."""
    df = spark.createDataFrame([(1, i, 5.0) for i in (0, 1, 3, 4)] + [(2, 2, 5.0)], "scan long, i long, tod double")
    jumps = spark.createDataFrame([(1, 2, 1.0), (1, 4, 2.0), (1, 4, 3.0)], "scan long, loc long, offset double")
    got = timelines.apply_jumps(df, jumps, ["scan"], "tod")
    assert {(r.scan, r.i): r.corrected for r in got.collect()} == {(1, 0): 5.0, (1, 1): 5.0, (1, 3): 6.0, (1, 4): 11.0, (2, 2): 5.0}


def test_spread_of_long_scans(spark):
    """The cut by spread is linear in the scan and keeps its digits at a large mean."""
    tod = F.transform(F.sequence(F.lit(0), F.lit(39_999)), lambda k: (k % 2 * 2 + 1e6).cast("float"))  # spread 1
    scans = spark.range(1).select(tod.alias("tod"), F.array_repeat(F.lit(0), 40_000).alias("flag"))
    began = time.perf_counter()
    got = scans.select(layouts.live(1, 0.75, 2e6, 1.01).alias("wide"), layouts.live(1, 0.75, 2e6, 0.99).alias("narrow")).first()
    assert time.perf_counter() - began < 20
    assert got.wide and not got.narrow


def test_frequencies_of_bins_are_exact(spark):
    """Means that end on a five in the fourth decimal round as the fractions do, not as a sum of rounded terms."""
    long = spark.range(360).select(F.lit(1).alias("scan"), F.col("id").alias("i"), (F.col("id") % 7 * 1.0).alias("tod"))
    short = spark.range(3).select(F.lit(2).alias("scan"), F.col("id").alias("i"), (F.col("id") * 1.0).alias("tod"))
    got = fourier.scan_spectra(long.union(short), ["scan"], "tod", 1.0, 12).toPandas().set_index(["scan", "bin"])
    at = np.minimum(11, np.floor(12 * np.log(np.arange(1, 181)) / np.log(180 * (1 + 1e-9)))).astype(int)
    for b in set(at.tolist()):
        k = np.flatnonzero(at == b) + 1
        assert got.f[(1, b)] == k.sum() / (360 * len(k))
    assert got.f[(1, 8)] == 0.1125 and got.f[2].dropna().tolist() == [1 / 3]
