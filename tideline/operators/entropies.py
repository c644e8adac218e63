"""Sample and approximate entropy by a range join: no Python on executors, no comparison of all pairs.

Both count, for each stretch of m samples (a template), the templates within r
of it in every place, and those that are still within r one sample later.
Templates are put into cells of width r by their first two samples. Two
templates within r lie in neighbouring cells, so each is sent to the nine cells
around its own and met there by a plain equi-join; counts are summed where the
pairs are made, before anything moves.

Equal templates are counted first and join as one row with a weight, so a flat
stretch, however long, is one row. Hot cells are what adaptive execution splits
in a join by sorting. Work still grows with the pairs within about r: where
most of a series lies in one cell, that is its square.

Segments need no keys of their own: channels are written once with a number
each, which also ends the lineage. A series that doesn't vary is left out; one
of fewer than m + 2 samples has sample entropy 0, one of m or fewer none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import series
from tideline.model import Config
from tideline.operators.spectrum import channels, numbered
from tideline.session import written

EPS = 1e-10


def templates(rows: DataFrame, m: int, r: float) -> DataFrame:
    """(id, n, r, v, after, w): the different templates of each series, the sample after them, and how often they occur."""
    size = F.size("x")
    known = rows.withColumn("__m", series.moments(F.col("x"))).withColumn("__s", series.deviation(F.col("__m"))).where((F.col("__s") > EPS) & (size > m))
    each = F.transform(F.sequence(F.lit(0), size - m), lambda i: F.struct(F.slice("x", i + 1, m).alias("v"), F.get("x", i + m).alias("after")))
    out = known.select("id", size.alias("n"), (r * F.col("__s")).alias("r"), F.explode_outer(each).alias("t"))
    return out.groupBy("id", "n", "r", F.col("t.v").alias("v"), F.col("t.after").alias("after")).agg(F.count(F.lit(1)).alias("w"))


def neighbours(t: DataFrame, m: int) -> DataFrame:
    """(id, n, r, after, w, near, longer): for each template the weight of those within r, and of those still within r one sample later."""
    # a little wider than r, so that rounding never puts templates within r two cells apart
    cell = lambda k: F.floor(F.col("v")[k] / (F.col("r") * (1 + 1e-9)))
    dims = min(m, 2)
    names = [f"c{k}" for k in range(dims)]
    own = t.select("id", "n", "r", "v", "after", "w", *[cell(k).alias(c) for k, c in enumerate(names)])
    a = own.withColumn("row", F.monotonically_increasing_id())
    b = own.select("id", F.col("v").alias("u"), F.col("after").alias("next"), F.col("w").alias("weight"), *names)
    for c in names:
        b = b.withColumn(c, F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1)))
    within = lambda x, y: F.abs(x - y) < F.col("r")
    both = a.join(b.hint("merge"), ["id", *names]).where(reduce(Column.__and__, [within(F.col("v")[k], F.col("u")[k]) for k in range(m)]))
    longer = F.sum(F.when(within(F.col("after"), F.col("next")), F.col("weight")).otherwise(0))
    return both.groupBy("id", "row").agg(*[F.first(c).alias(c) for c in ("n", "r", "after", "w")], F.sum("weight").alias("near"), longer.alias("longer"))


def entropies_of(rows: DataFrame, m: int = 2, r: float = 0.2, whole: int | None = None) -> DataFrame:
    """(id, sample_entropy, approx_entropy) of each series (id, x) that varies and has more than m samples.

    whole: approximate entropy takes shares of the templates of so many samples.
    """
    c = neighbours(templates(rows, m, r), m)
    short, long = F.col("n") - m + 1, F.col("n") - m
    every = F.greatest(F.col("n"), F.lit(whole or 0))
    has_next = F.col("after").isNotNull()
    sums = c.groupBy("id", "n").agg(
        ((F.sum(F.col("w") * F.col("near")) - F.first(short)) / 2).alias("b"), ((F.sum(F.when(has_next, F.col("w") * F.col("longer"))) - F.first(long)) / 2).alias("a"),
        (F.sum(F.col("w") * F.log(F.col("near") / (every - m + 1))) / F.first(short)).alias("phi"), (F.sum(F.when(has_next, F.col("w") * F.log(F.col("longer") / (every - m)))) / F.first(long)).alias("phi1"),
    )
    a, b = F.col("a"), F.col("b")
    return sums.select("id", F.when((a > 0) & (b > 0), -F.log(a / b)).otherwise(0.0).alias("sample_entropy"), (F.col("phi") - F.col("phi1")).alias("approx_entropy"))


def features(segments: DataFrame, config: Config = Config(), keys: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False) -> DataFrame:
    """sample_entropy and approx_entropy of each segment: means over the channels that vary."""
    by = (*keys, "__segment")
    rows = written(channels(numbered(segments), by, eeg, by_time).withColumn("id", F.monotonically_increasing_id()), "series")
    e = entropies_of(rows.where(F.col("x").isNotNull()).select("id", "x"), config.m, config.r, config.whole)
    both = rows.select(*by, "id").join(e, "id", "left")
    return both.groupBy(*by).agg(F.avg("sample_entropy").alias("sample_entropy"), F.avg("approx_entropy").alias("approx_entropy")).drop("__segment")
