"""The DataFrame operators of signals against the kernels, their edge cases, and their plans."""

import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.functions import kernels as K
from tideline.functions.features import compute
from tideline.model import BANDS, FEATURES, MONTAGE_62, Config
from tideline.operators import complexity, entropies, graphs, pairs, segments, spectrum, states, timedomain
from tideline.plans import catalogue

NAMES = "FP1 FP2 F7 F8 F3 F4 FZ C3 C4 O1 O2 PZ FC5 CP5".split()
SCHEMA = "seg long, eeg array<array<double>>, ch int, x int, n int, r string, p double"
SPECTRAL = [*FEATURES["frequency_domain"], *FEATURES["composite"], "alpha_beta_band_power_correlation", "hemispheric_alpha_asymmetry", "frontal_occipital_alpha_ratio"]
SF = "/root/testdata/sf0.001"


def signal(seed, channels=len(NAMES), samples=400):
    rnd = np.random.RandomState(seed)
    t = np.arange(samples) / 200
    return rnd.randn(channels, samples) + 3 * np.sin(2 * np.pi * 10 * t + rnd.rand(channels, 1) * 6) + np.cumsum(rnd.randn(channels, samples), axis=1) / 9


def table(spark, matrices, keys=None):
    """Segments with clashing extra columns."""
    rows = [(keys[i] if keys else i, None if m is None else np.asarray(m).tolist() if isinstance(m, np.ndarray) else m, 1, 2, 3, "r", 0.5) for i, m in enumerate(matrices)]
    return spark.createDataFrame(rows, SCHEMA)


def same(got, want, rel=1e-7):
    return got == want if got is None or want is None else math.isclose(got, want, rel_tol=rel, abs_tol=1e-9)


BROKEN = [None, [], [[]], [None, [1.0]], [[1.0, 2.0], [1.0]], [[1.0, float("nan")]], [[1.0, float("inf")]], [[1.0, None]]]


@pytest.mark.parametrize("config", [Config(channels=tuple(NAMES)), Config(channels=tuple(NAMES), nperseg=64, noverlap=20, nfft=128, normalize_entropy=True), Config(fs=100.0, channels=tuple(NAMES), nperseg=100, nfft=64)])
@pytest.mark.parametrize("samples", [400, 101])
def test_spectra_equal_kernels(spark, config, samples):
    """Production frames, frames longer than the transform, and segments shorter than a frame."""
    ms = [signal(s, samples=samples) for s in range(3)]
    df = table(spark, ms)
    for length in (None, samples):
        got = {r["seg"]: r for r in spectrum.frequency_features(df, config, length=length).collect()}
        de = {r["seg"]: r for r in spectrum.entropy_features(df, config, length=length).collect()}
        for i, m in enumerate(ms):
            want = compute(m, config, [*SPECTRAL, *FEATURES["de_features"]])
            assert {k for k, v in want.items() if not same((got[i].asDict() | de[i].asDict())[k], v)} == set()


def test_density_and_time_order(spark):
    config = Config(channels=tuple(NAMES), nperseg=64, noverlap=32)
    m = signal(4)
    df = table(spark, [m.T])
    rows = spectrum.channels(df, ("seg",), by_time=True)
    f, p = K.welch(m, 200.0, 64, 32, 512)
    got = spectrum.density(spectrum.lags(rows, config), ("seg",), config, spectrum.sizes_of(rows, config)).orderBy("k").collect()
    assert np.allclose([r["hz"] for r in got], f) and np.allclose([r["p"] for r in got], p.mean(0))


def test_few_and_unknown_channels(spark):
    """Placeholder names have no sides or pairs; one channel has no correlation."""
    for names in (("CH1", "CH2"), ("FZ",)):
        config = Config(channels=names)
        m = signal(5, len(names))
        r = spectrum.frequency_features(table(spark, [m]), config).first().asDict() | spectrum.entropy_features(table(spark, [m]), config).first().asDict()
        want = compute(m, config, [*SPECTRAL, *FEATURES["de_features"]])
        assert {k for k, v in want.items() if not same(r[k], v)} == set()


def test_time_domain_equals_kernels(spark):
    rnd = np.random.RandomState(1)
    ms = [signal(1), np.round(signal(2, samples=60)), np.zeros((3, 50)), rnd.randn(2, 2), rnd.randn(2, 1), np.tile([0.0, 1, 0, -1, -1, 0], (2, 9)), np.cumsum(rnd.randn(2, 40), 1)]
    got = {r["seg"]: r for r in timedomain.features(table(spark, ms)).collect()}
    for i, m in enumerate(ms):
        want = compute(m, Config(), [*FEATURES["time_domain"]])
        if m.shape[1] > 2:
            want |= compute(m, Config(), list(timedomain.FRACTAL))
        assert {k for k, v in want.items() if not same(got[i][k], v)} == set(), i


def test_wavelet_and_hurst_equal_kernels(spark):
    """Also series shorter than the taps, of constant values, and just long enough."""
    rnd = np.random.RandomState(12)
    ms = [signal(1), signal(2, samples=100), rnd.randn(2, 19), rnd.randn(2, 32), np.cumsum(rnd.randn(3, 256), 1), np.ones((2, 64)), rnd.randn(2, 3), np.vstack([rnd.randn(64), np.zeros(64)]), np.r_[np.zeros(40), rnd.randn(24)][None, :]]
    for levels in (5, 2):
        config = Config(wavelet_level=levels)
        got = {r["seg"]: r for r in complexity.features(table(spark, ms), config).collect()}
        for i, m in enumerate(ms):
            want = compute(m, config, list(complexity.NAMES))
            assert {k for k, v in want.items() if not same(got[i][k], v)} == set(), (i, levels)


def test_peak_frequencies_equal_kernels(spark):
    config = Config(channels=tuple(NAMES))
    ms = [signal(3), None]
    got = {(r["seg"], r["ch"], r["band"]): r["hz"] for r in spectrum.peak_frequencies(table(spark, ms), config, (*BANDS, ("nowhere", 0.1, 0.2))).collect()}
    f, p = K.welch(ms[0], 200.0, 256, 128, 512)
    for b, lo, hi in BANDS:
        inside = (f >= lo) & (f <= hi)
        assert [got[0, c, b] for c in range(len(NAMES))] == f[inside][p[:, inside].argmax(1)].tolist()
    assert got[0, 0, "nowhere"] is None and got[1, None, "alpha"] is None


def test_fitted_features_by_trial_and_segment(spark):
    """A template a segment is what extraction does without one; other ways than by subject warn."""
    rows = [(1, k // 2, k, signal(k, samples=80).tolist()) for k in range(4)]
    df = spark.createDataFrame(rows, "subject long, trial long, seg long, eeg array<array<double>>")
    with pytest.warns(UserWarning, match="unstable"):
        own = {r["seg"]: r for r in states.fitted_features(df, 200.0, ("seg",)).collect()}
    for _, _, k, m in rows:
        want = compute(np.array(m), Config(), list(FEATURES["microstate"]))
        assert all(same(own[k][n], v) for n, v in want.items())
    for by in (("subject", "trial"), ("subject",)):
        with warnings.catch_warnings():
            warnings.simplefilter("error" if by == ("subject",) else "ignore")
            got = {r["seg"]: r for r in states.fitted_features(df, 200.0, by).collect()}
        for group in {(r[0], r[1])[: len(by)] for r in rows}:
            mine = [(k, np.array(m)) for s, t, k, m in rows if (s, t)[: len(by)] == group]
            maps = K.template(np.array([m[:, t] for _, m in mine for t in sorted(K.gfp_peaks(m.std(0)))]))
            assert all(same(got[k][n], v) for k, m in mine for n, v in K.microstates(m, maps, 200.0).items())


@pytest.mark.parametrize("shared", [True, False])
def test_draws_equal_the_drivers(spark, shared):
    rnd = np.random.RandomState(4)
    trials = {s: {t: sorted(rnd.choice(50, rnd.randint(1, 9), replace=False).tolist()) for t in range(1, 6)} for s in (1, 2)}
    rows = [(s, t, g, "x", 7) for s, ts in trials.items() for t, gs in ts.items() for g in gs]
    df = spark.createDataFrame(rows, "subject long, trial long, segment long, drawn_by string, __n int").repartition(4)
    for n in (-1, 1, 3):
        got = sorted((r["subject"], r["trial"], r["segment"], r["drawn"]) for r in segments.draw(df, n, shared).collect())
        plain = segments.sample_exact if shared else segments.sample_sorted
        assert got == sorted((s, *r) for s, ts in trials.items() for r in plain(spark, ts, n).collect())
    one = segments.draw(df.where("subject = 1").drop("subject"), 2, shared).select("trial", "segment", "drawn")
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, plain(spark, trials[1], 2).collect()))
    assert segments.draw(df.limit(0), 2, shared).count() == 0


def test_broken_repeated_and_unnamed_segments(spark):
    m = signal(6)
    ms, keys = [*BROKEN, m, m, m], [*range(len(BROKEN)), None, 100, 100]
    df, config = table(spark, ms, keys), Config(channels=tuple(NAMES))
    for rows, name in (
        (spectrum.frequency_features(df, config), "alpha_power"), (spectrum.frequency_features(df, config), "aperiodic_exponent"), (spectrum.entropy_features(df, config), "de_alpha"),
        (timedomain.features(df, config), "mean_rms"), (pairs.mean_correlation(df), "mean_interchannel_correlation"), (entropies.features(df, config), "sample_entropy"),
    ):
        got = rows.select("seg", name).collect()
        assert sorted((str(k), v is None) for k, v in got) == sorted((str(k), i < len(BROKEN)) for i, k in enumerate(keys)), name
    empty = df.where("seg > 1000")
    for rows in (spectrum.frequency_features(empty, config), timedomain.features(empty, config), pairs.coherence_features(empty, config), entropies.features(empty, config), states.fit_template(empty)):
        assert rows.count() == 0


# -- pairs and graphs


@pytest.mark.parametrize("by_time", [False, True])
def test_pairs_equal_kernels(spark, by_time):
    config = Config(channels=tuple(NAMES))
    ms = [signal(7), signal(8, samples=150), np.vstack([signal(9, 4), np.zeros((1, 400))])]
    df = table(spark, [m.T if by_time else m for m in ms])
    coherence = {(r["seg"], r["i"], r["j"]): r["w"] for r in pairs.coherence_edges(df, config, by_time=by_time).collect()}
    correlation = {(r["seg"], r["i"], r["j"]): r["w"] for r in pairs.correlation_edges(df, by_time=by_time).collect()}
    means = {r["seg"]: r[1] for r in pairs.mean_correlation(df, by_time=by_time).collect()}
    both = {r["seg"]: r for r in pairs.coherence_features(df, config, by_time=by_time).collect()}
    for s, m in enumerate(ms):
        n = min(256, m.shape[1])
        want = K.coherence_matrix(m, 200.0, n, min(128, m.shape[1] // 2), (8.0, 13.0))
        varied = [i for i in range(len(m)) if m[i].std() > 1e-10]
        r = np.corrcoef(m[varied])
        assert sum(k[0] == s for k in coherence) == len(m) * (len(m) - 1) // 2
        assert all(same(w, want[i, j]) for (seg, i, j), w in coherence.items() if seg == s)
        assert {(i, j) for seg, i, j in correlation if seg == s} == {(a, b) for a in varied for b in varied if a < b}
        assert all(same(w, r[varied.index(i), varied.index(j)]) for (seg, i, j), w in correlation.items() if seg == s)
        want = compute(m, config, ["mean_interchannel_correlation", "mean_alpha_coherence", "interhemispheric_alpha_coherence"])
        assert same(means[s], want["mean_interchannel_correlation"]) and all(same(both[s][k], want[k]) for k in list(want)[1:])


@pytest.mark.parametrize("samples", [250, 41])
def test_phase_locking_equals_kernels(spark, samples):
    """Segments of another length, and broken ones, have no pairs."""
    config = Config(channels=tuple(NAMES))
    ms = [signal(7, samples=samples), signal(8, samples=samples), signal(9, samples=60), None, np.zeros((3, samples))]
    df = table(spark, ms)
    edges = {(r["seg"], r["band"], r["i"], r["j"]): r["w"] for r in pairs.locking_edges(df, config, samples).collect()}
    got = {r["seg"]: r for r in pairs.locking_features(df, config, samples).collect()}
    assert set(got) == {0, 1, 4}
    for s in (0, 1):
        for b, lo, hi in pairs.LOCKING:
            want = K.plv_matrix(ms[s], 200.0, (lo, hi))
            assert all(same(w, want[i, j], 1e-6) for (seg, band, i, j), w in edges.items() if (seg, band) == (s, b))
        names = [n for n in FEATURES["connectivity"] if n.startswith("plv")]
        assert all(same(got[s][n], v, 1e-6) for n, v in compute(ms[s], config, names).items())
    assert len(edges) == 4 * (2 * 91 + 3)
    high = Config(fs=20.0, channels=tuple(NAMES))  # no room for the upper bands
    assert {r["band"] for r in pairs.locking_edges(df, high, samples).collect()} == {b for b, lo, hi in pairs.LOCKING if K.bandpass(ms[0], 20.0, (lo, hi)) is not None}


def test_graphs_equal_kernels(spark):
    """Also graphs in parts, graphs of equal weights and of two nodes."""
    rnd = np.random.RandomState(3)
    for n, keep in ((10, 0.1), (12, 0.3), (12, 0.6), (2, 0.3)):
        ws = [np.round(rnd.rand(n, n), 1), rnd.rand(n, n), np.ones((n, n))]
        edges = spark.createDataFrame([(s, i, j, float(w[i, j])) for s, w in enumerate(ws) for i in range(n) for j in range(i + 1, n)], "seg long, i int, j int, w double")
        got = {r["seg"]: r for r in graphs.measures(pairs.edge_lists(edges), n, keep).collect()}
        for s, w in enumerate(ws):
            w = np.triu(w, 1) + np.triu(w, 1).T
            assert all(same(got[s][k], v) for k, v in K.network(w, keep).items()), (n, keep, s)


# -- entropies


def series_table(spark, xs):
    return spark.createDataFrame([(i, np.asarray(x, float).tolist()) for i, x in enumerate(xs)], "id long, x array<double>")


@pytest.mark.parametrize("m", [1, 2, 3])
def test_entropies_equal_kernels(spark, m):
    rnd = np.random.RandomState(2)
    xs = [rnd.randn(100), np.round(rnd.randn(300), 1), np.cumsum(rnd.randn(250)), np.r_[np.zeros(150), rnd.randn(50)], rnd.randint(0, 2, 60), rnd.randn(m + 1), 1e9 + rnd.randn(50), rnd.randn(m + 2), np.ones(40), rnd.randn(m)]
    got = {r["id"]: r for r in entropies.entropies_of(series_table(spark, xs), m, 0.2).collect()}
    assert sorted(got) == list(range(len(xs) - 2))  # the flat and the too short series have none
    for i in got:
        x = np.asarray(xs[i], float)
        assert same(got[i]["sample_entropy"], K.sample_entropy(x, m, 0.2 * x.std()), 1e-6), i
        assert same(got[i]["approx_entropy"], K.approximate_entropy(x, m, 0.2 * x.std()), 1e-6), i


def blocks(x, m, r, size=500):
    """Counts within r of each template of m samples, in blocks."""
    v = np.lib.stride_tricks.sliding_window_view(x, m)
    return np.concatenate([(np.abs(v[i : i + size, None, :] - v[None, :, :]).max(2) < r).sum(1) for i in range(0, len(v), size)])


def test_entropies_of_long_series(spark):
    """Blocks of all pairs for 5,000 samples; 100,000 samples, a third of them flat, finish without comparing all pairs."""
    rnd = np.random.RandomState(5)
    x = rnd.randn(5_000)
    r = 0.2 * x.std()
    b, a = blocks(x, 2, r), blocks(x, 3, r)
    got = entropies.entropies_of(series_table(spark, [x])).first()
    assert same(got["sample_entropy"], -np.log((a.sum() - len(a)) / (b.sum() - len(b))), 1e-9)
    assert same(got["approx_entropy"], np.log(b / len(b)).mean() - np.log(a / len(a)).mean(), 1e-9)
    long = rnd.randn(100_000)
    long[:33_000] = 0.0
    t = entropies.templates(series_table(spark, [long]), 2, 0.2)
    assert t.agg(F.max("w"), F.sum("w")).first() == (32_998, 99_999)
    got = entropies.entropies_of(series_table(spark, [long])).first()
    assert 0 < got["sample_entropy"] < got["approx_entropy"] + 5


# -- microstates


def test_peaks_equal_kernels(spark):
    rnd = np.random.RandomState(6)
    gs = [rnd.rand(100), np.round(rnd.rand(100), 1), np.ones(30), np.arange(20.0), rnd.rand(5), np.array([1.0]), np.repeat(rnd.rand(40), 3), np.r_[1, 3, 3, 1, 1, 4, 4, 4, 0.0]]
    got = {r["id"]: list(r["p"]) for r in series_table(spark, gs).select("id", states.peaks(F.col("x")).alias("p")).collect()}
    for i, g in enumerate(gs):
        assert sorted(got[i]) == sorted(K.gfp_peaks(g).tolist()), i


def test_template_equals_plain_means(spark):
    """Subjects apart, a null subject, one with fewer maps than states, one without."""
    rnd = np.random.RandomState(7)
    rows = []
    for s, n in ((1, 6), (2, 4), (None, 3)):
        rows += [(s, k, signal(rnd.randint(999), 5 if s == 2 else 8, 60).tolist()) for k in range(n)]  # montages may differ
    rows += [(5, 0, signal(1, 8, 2).tolist()), (6, 0, None)]
    df = spark.createDataFrame(rows, "who long, seg long, eeg array<array<double>>").repartition(5)
    got = {}
    for r in states.fit_template(df, subject="who").orderBy("subject", "state").collect():
        got.setdefault(r["subject"], []).append(r["map"])
    assert set(got) == {1, 2, None, 5}
    for s in got:
        maps = [np.array(e)[:, t] for w, _, e in sorted((r for r in rows if r[0] == s), key=lambda r: r[1]) for t in sorted(K.gfp_peaks(np.array(e).std(0)))]
        want = K.template(np.array(maps))
        assert np.allclose(got[s], want, atol=1e-9), s


def test_state_features_equal_kernels(spark):
    rnd = np.random.RandomState(8)
    maps = rnd.randn(4, len(NAMES))
    ms = [signal(1), signal(2, samples=37), np.zeros((len(NAMES), 20)), None]
    t = spark.createDataFrame([(0, k, m.tolist()) for k, m in enumerate(maps)], "subject long, state int, map array<double>")
    got = {r["seg"]: r for r in states.features(table(spark, ms), t, 200.0).collect()}
    for i, m in enumerate(ms[:3]):
        assert all(same(got[i][k], v) for k, v in K.microstates(m, maps, 200.0).items()), i
    assert all(got[3][k] is None for k in FEATURES["microstate"])


# -- plans

NATIVE = "pairs_locking complexity_native spectrum_peaks td_native cx_fractal_native spectrum_psd spectrum_coverage spectrum_features spectrum_entropy spectrum_rasm pairs_correlation pairs_coherence pairs_strongest graph_measures entropy_range_join states_features".split()


@pytest.mark.parametrize("name", NATIVE)
def test_no_python_and_no_cross_join(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))
    assert len(MONTAGE_62) == 62
