"""Time-domain and fractal features as DataFrame operations: no Python on executors.

A channel is reduced where it lies, by one pass of higher-order functions over
its own samples; a segment's features are means over its channels. A segment
without a full signal keeps its keys and has null features.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import series
from tideline.model import FEATURES, Config
from tideline.operators.spectrum import channels, numbered

FRACTAL = ("higuchi_fd", "katz_fd", "petrosian_fd")


def channel_features(rows: DataFrame, fs: float, names: tuple[str, ...] = FEATURES["time_domain"], least: int | None = None) -> DataFrame:
    """Rows of channels (keys, ch, x) with a column for each named feature; least: samples that Higuchi's dimension asks for."""
    x, d = F.col("x"), F.col("__d")
    m = {f"__m{k}": series.moments(v) for k, v in ((0, x), (1, d), (2, series.differences(d)))}
    s = rows.withColumn("__d", series.differences(x)).withColumns(m)
    s = s.withColumns({f"__s{k}": F.when(F.size(x) > 0, F.coalesce(series.deviation(F.col(f"__m{k}")), F.lit(0.0))) for k in range(3)})
    fractal = {"higuchi_fd": ("__lengths", series.curve_lengths(x, least=least)), "katz_fd": ("__path", series.path(x, d)), "petrosian_fd": ("__turns", series.turns(d))}
    s = s.withColumns({c: F.when(F.size(x) > 0, v) for n, (c, v) in fractal.items() if n in names})
    s0, s1, s2 = (F.col(f"__s{k}") for k in range(3))
    have = lambda v: F.when(s0.isNotNull(), v)
    values = {
        "mean_abs_amplitude": series.mean(F.transform(x, lambda v: F.abs(v))),
        "mean_channel_std": s0,
        "mean_peak_to_peak": series.peak_to_peak(x),
        "mean_rms": series.rms(x),
        "mean_zero_crossing_rate": series.sign_changes(x) / (F.size(x) / fs),
        "hjorth_activity": s0 * s0,
        "hjorth_mobility": have(series.mobility(s0, s1)),
        "hjorth_complexity": have(series.hjorth_complexity(s0, s1, s2)),
        "higuchi_fd": series.higuchi(F.col("__lengths")),
        "katz_fd": series.katz(F.size(x), F.col("__path")),
        "petrosian_fd": series.petrosian(F.size(x), F.col("__turns")),
    }
    return s.withColumns({n: values[n] for n in names}).drop("__d", *m, "__s0", "__s1", "__s2", "__lengths", "__path", "__turns")


def means(rows: DataFrame, keys: tuple[str, ...], names: tuple[str, ...]) -> DataFrame:
    """Means over channels; a channel without a value doesn't count."""
    return rows.groupBy(*keys).agg(*[F.avg(n).alias(n) for n in names])


def features(segments: DataFrame, config: Config = Config(), names: tuple[str, ...] = (*FEATURES["time_domain"], *FRACTAL), keys: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False) -> DataFrame:
    """The named features, one row a segment, by one shuffle of a row a channel."""
    by = (*keys, "__segment")
    rows = channel_features(channels(numbered(segments), by, eeg, by_time), config.fs, names, 2 if (config.whole or 0) >= 32 else None)
    return means(rows, by, names).drop("__segment")
