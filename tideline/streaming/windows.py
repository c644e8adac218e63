"""Features of time windows over a stream of readings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_features(stream: DataFrame, every: str = "1 hour", late: str = "2 hours", time: str = "ts", channel: str = "event_type", value: str = "value") -> DataFrame:
    """Amplitude features of each tumbling window and channel; readings later than `late` are left out.

    Works on batches too, where no reading is late.
    """
    v = F.col(value)
    rows = stream.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), F.col(channel).alias("channel"))
    out = rows.agg(F.count(v).alias("n"), F.avg(F.abs(v)).alias("mean_abs"), F.stddev_pop(v).alias("std"), (F.max(v) - F.min(v)).alias("peak_to_peak"), F.sqrt(F.avg(v * v)).alias("rms"))
    return out.select(F.col("w.start").alias("window_start"), "channel", "n", "mean_abs", "std", "peak_to_peak", "rms")
