"""Connectivity of channel pairs as DataFrame operations: no Python on executors.

A segment's channels are reduced to a few numbers each, in the segment's own
row: complex Fourier coefficients of the frames at the bins of a band
(coherence), or the standardised series (correlation). Pairs are then made by
two generators, first over the channels and then over those after each, so a
row stands for one pair only while its weight is computed, and nothing moves:
the work is channels squared a segment, and linear in segments.

The mean correlation needs no pairs at all. With standardised channels z the
sum of all correlations is the mean over time of (sum of z)^2.

A row whose signal isn't a full matrix of finite numbers has no edges and null
features; so has one of a single channel no edges, and 0 for the means.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import series
from tideline.functions.kernels import analytic, bandpass
from tideline.model import BANDS, Config, hemisphere
from tideline.operators.spectrum import channels, dot, frames, matrix, shape, sizes_of

EPS = 1e-10
ALPHA = (8.0, 13.0)
#: Bands of phase locking.
LOCKING = tuple(b for b in BANDS if b[0] in ("theta", "alpha", "beta", "gamma"))


def waves(sizes: DataFrame, fs: float, band: tuple[float, float]) -> DataFrame:
    """For each row (n, nfft) the cosines and sines of a frame of n samples at the bins of the closed band."""
    bins = F.filter(F.sequence(F.lit(0), F.floor(F.col("n") / 2).cast("int")), lambda k: (k * fs / F.col("n")).between(*band))
    rows = sizes.select("n", bins.alias("__k"), F.sequence(F.lit(0), F.col("n") - 1).alias("__i"))
    at = lambda wave: F.transform("__k", lambda k: F.transform("__i", lambda i: wave(F.lit(2 * math.pi) * ((k * i) % F.col("n")) / F.col("n"))))
    return rows.select("n", F.arrays_zip(at(F.cos).alias("c"), at(F.sin).alias("s")).alias("waves"))


def coefficients(segments: DataFrame, config: Config, band: tuple[float, float] = ALPHA, eeg: str = "eeg", by_time: bool = False, length: int | None = None) -> DataFrame:
    """Rows with z in place of the signal: for each channel and each bin of the closed band (re, im, power), re and im over frames.

    length: the samples of every segment, where they are known to be equal;
    else the lengths that occur are looked up first.
    """
    rows = segments.withColumn("__m", matrix(eeg, by_time)).drop(eeg)
    first = rows.select(F.get("__m", F.lit(0)).alias("x"))
    table = waves(sizes_of(first, config, length=length), config.fs, band)
    n, step, _ = shape(F.get("__m", F.lit(0)), config)
    rows = rows.withColumns({"n": n, "__step": step}).join(F.broadcast(table), "n", "left")
    parts = lambda f: F.transform("waves", lambda w: F.struct(F.transform(f, lambda y: dot(y, w["c"])).alias("re"), F.transform(f, lambda y: -dot(y, w["s"])).alias("im")))
    powered = lambda p: F.struct(p["re"].alias("re"), p["im"].alias("im"), (dot(p["re"], p["re"]) + dot(p["im"], p["im"])).alias("power"))
    framed = F.transform("__m", lambda x: F.struct(frames(x, F.col("n"), F.col("__step"), config.whole).alias("f")))
    z = F.transform(F.transform(framed, lambda f: parts(f["f"])), lambda ps: F.transform(ps, powered))
    return rows.withColumn("z", z).drop("__m", "n", "__step", "waves")


def coherence(a: Column, b: Column) -> Column:
    """Mean magnitude-squared coherence of two channels over the bins where it is finite; 0 where it is nowhere."""
    one = F.zip_with(a, b, lambda p, q: F.struct((dot(p["re"], q["re"]) + dot(p["im"], q["im"])).alias("x"), (dot(p["im"], q["re"]) - dot(p["re"], q["im"])).alias("y"), (p["power"] * q["power"]).alias("d")))
    known = F.filter(F.transform(one, lambda v: F.when(v["d"] > 0, (v["x"] * v["x"] + v["y"] * v["y"]) / v["d"])), lambda w: w.isNotNull())
    return F.coalesce(series.mean(known), F.lit(0.0))


def pairs(rows: DataFrame, keys: tuple[str, ...], z: str, weight) -> DataFrame:
    """(keys, i, j, w) for all i < j of the array z; weight(a, b) is computed pair by pair.

    The outer generators keep rows without channels or pairs, which go again:
    of an inner one the optimiser makes a filter on the array's size, and
    computes the array once more for that.
    """
    one = rows.select(*keys, F.col(z).alias("__z"), F.posexplode_outer(z).alias("i", "__a"))
    after = F.slice("__z", F.col("i") + 2, F.greatest(F.size("__z") - F.col("i") - 1, F.lit(0)))
    both = one.select(*keys, "i", "__a", F.posexplode_outer(after).alias("__d", "__b")).where(F.col("__d").isNotNull())
    return both.select(*keys, "i", (F.col("i") + F.col("__d") + 1).alias("j"), weight(F.col("__a"), F.col("__b")).alias("w"))


def coherence_edges(segments: DataFrame, config: Config, keys: tuple[str, ...] = ("seg",), band: tuple[float, float] = ALPHA, eeg: str = "eeg", by_time: bool = False, length: int | None = None) -> DataFrame:
    """(keys, i, j, w): the coherence of every pair of channels."""
    return pairs(coefficients(segments.select(*keys, eeg), config, band, eeg, by_time, length), keys, "z", coherence)


def standardised(m: Column) -> Column:
    """Channels with their numbers, without mean and of unit deviation; flat channels are left out."""
    known = F.transform(m, lambda x, i: F.struct(i.alias("ch"), x.alias("x"), series.moments(x).alias("m")))
    varied = F.filter(known, lambda c: series.deviation(c["m"]) > EPS)
    return F.transform(varied, lambda c: F.struct(c["ch"].alias("ch"), F.transform(c["x"], lambda v: (v - c["m"]["mean"]) / series.deviation(c["m"])).alias("z")))


def correlation_edges(segments: DataFrame, keys: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False) -> DataFrame:
    """(keys, i, j, w): the correlation of every pair of channels that vary."""
    rows = segments.select(*keys, standardised(matrix(eeg, by_time)).alias("__s"))
    weight = lambda a, b: F.struct(a["ch"].alias("i"), b["ch"].alias("j"), (dot(a["z"], b["z"]) / F.size(a["z"])).alias("w"))
    return pairs(rows, keys, "__s", weight).select(*keys, "w.*")


def mean_correlation(segments: DataFrame, keys: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False) -> DataFrame:
    """mean_interchannel_correlation of each segment, by one pass over its samples."""
    rows = segments.select(*keys, matrix(eeg, by_time).alias("__m")).withColumn("__z", F.transform(standardised(F.col("__m")), lambda c: c["z"]))
    zero = F.array_repeat(F.lit(0.0), F.size(F.get("__m", F.lit(0))))
    rows = rows.withColumn("__t", F.aggregate("__z", zero, lambda a, z: F.zip_with(a, z, lambda u, v: u + v)))
    c, t = F.size("__z").cast("double"), F.col("__t")
    mean = F.when(c >= 2, (dot(t, t) / F.size(t) - c) / (c * (c - 1))).otherwise(0.0)
    return rows.select(*keys, F.when(F.col("__m").isNotNull(), mean).alias("mean_interchannel_correlation"))


def across(config: Config) -> Column:
    """Whether the pair i, j has a channel on either side of the scalp."""
    side = [hemisphere(c) for c in config.channels]
    left, right = ([i for i, s in enumerate(side) if s == w] for w in ("left", "right"))
    of = lambda c, places: F.col(c).isin(places) if places else F.lit(False)
    return (of("i", left) & of("j", right)) | (of("i", right) & of("j", left))


def coherence_features(segments: DataFrame, config: Config, keys: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False, length: int | None = None) -> DataFrame:
    """Mean coherence of all pairs and of those across the hemispheres, one row a segment: sums are made before the shuffle."""
    edges = coherence_edges(segments, config, keys, ALPHA, eeg, by_time, length)
    return edges.groupBy(*keys).agg(F.avg("w").alias("mean_alpha_coherence"), F.coalesce(F.avg(F.when(across(config), F.col("w"))), F.lit(0.0)).alias("interhemispheric_alpha_coherence"))


def analytic_table(spark: SparkSession, samples: int, fs: float, bands: tuple[tuple[str, float, float], ...]) -> tuple[DataFrame, list[str]]:
    """(t, u, re0, im0, re1, ...): what a unit at sample t adds to the filtered analytic signal at u in each band; and the bands.

    Zero-phase filtering with mirrored edges and the analytic signal are both
    linear, so a table of samples squared rows stands for them. It depends on
    the length only, and is made on the driver; bands without room below half
    the rate are left out.
    """
    t, u = np.divmod(np.arange(samples * samples), samples)
    cols, names = {"t": pa.array(t, pa.int32()), "u": pa.array(u, pa.int32())}, []
    for name, lo, hi in bands:
        y = bandpass(np.eye(samples), fs, (lo, hi))
        if y is not None:
            z = analytic(y)
            cols |= {f"re{len(names)}": z.real.ravel(), f"im{len(names)}": z.imag.ravel()}
            names.append(name)
    return spark.createDataFrame(pa.table(cols)), names


def locking_edges(segments: DataFrame, config: Config, samples: int, bands=LOCKING, keys: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False) -> DataFrame:
    """(keys, band, i, j, w): the phase-locking value (Lachaux et al. 1999) of every pair of channels in segments of `samples` samples.

    A join of samples with the table of the filter and the analytic signal,
    which is broadcast and has all bands in a row; samples are dealt by keys
    beforehand, so that the sums over it, and the pairs, move nothing. Meant for
    segments of up to some 1,000 samples, whose table takes 24 MB a band;
    `extract` has no bound.
    """
    table, names = analytic_table(segments.sparkSession, samples, config.fs, bands)
    # by a number of its own, so that adaptive execution doesn't merge the tasks, nor takes the shuffle before for this one:
    # the rows are few and the work on each is long
    tasks = 2 * int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = channels(segments.select(*keys, eeg).repartition(tasks, *keys), keys, eeg, by_time)
    at = rows.select(*keys, "ch", F.posexplode_outer(F.when(F.size("x") == samples, F.col("x"))).alias("t", "v"))
    parts = [f"{c}{i}" for i in range(len(names)) for c in ("re", "im")]
    z = at.join(F.broadcast(table), "t").groupBy(*keys, "ch", "u").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("v") * F.col(c)).alias(c) for c in parts])
    size = lambda i: F.sqrt(F.col(f"re{i}") * F.col(f"re{i}") + F.col(f"im{i}") * F.col(f"im{i}"))
    phase = z.select(*keys, "ch", "u", *[F.when(size(c[2:]) > 0, F.col(c) / size(c[2:])).otherwise(1.0 if c.startswith("re") else 0.0).alias(c) for c in parts])
    listed = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    series_of = lambda i: F.struct(F.lit(names[i]).alias("band"), F.col(f"p.re{i}").alias("re"), F.col(f"p.im{i}").alias("im"))
    each = F.array(*[series_of(i) for i in range(len(names))]).cast("array<struct<band:string,re:array<double>,im:array<double>>>")
    one = phase.groupBy(*keys, "ch").agg(listed("u", *parts).alias("p")).select(*keys, "ch", F.explode_outer(each).alias("b")).where(F.col("b").isNotNull()).select(*keys, "ch", "b.*")
    every = one.groupBy(*keys, "band").agg(listed("ch", "re", "im").alias("z"))

    def locking(a: Column, b: Column) -> Column:
        x, y = dot(a["re"], b["re"]) + dot(a["im"], b["im"]), dot(a["im"], b["re"]) - dot(a["re"], b["im"])
        return F.sqrt(x * x + y * y) / samples

    return pairs(every, (*keys, "band"), "z", locking)


def locking_features(segments: DataFrame, config: Config, samples: int, keys: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False) -> DataFrame:
    """Mean phase locking of all pairs in each band, and of those across the hemispheres, one row a segment with such pairs."""
    edges = locking_edges(segments, config, samples, LOCKING, keys, eeg, by_time)
    of = lambda b, w: F.avg(F.when(F.col("band") == b, w))
    out = {f"plv_{b}_mean": of(b, F.col("w")) for b, _, _ in LOCKING} | {f"plv_{b}_interhemispheric": of(b, F.when(across(config), F.col("w"))) for b in ("theta", "alpha")}
    return edges.groupBy(*keys).agg(*[v.alias(k) for k, v in out.items()])


def edge_lists(edges: DataFrame, keys: tuple[str, ...] = ("seg",)) -> DataFrame:
    """(keys, edges): each segment's edges (i, j, w) in order; one shuffle. A segment has channels squared edges at most."""
    return edges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "j", "w"))).alias("edges"))
