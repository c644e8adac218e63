"""Small expressions on columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column) -> Column:
    """Null for a denominator that isn't positive and finite; otherwise clipped to 0.01 .. 100."""
    ok = (b > 0) & (b < float("inf")) & ~F.isnan(a) & (F.abs(a) < float("inf"))
    return F.when(ok, F.least(F.greatest(F.try_divide(a, b), F.lit(0.01)), F.lit(100.0)))


def differential_entropy(variance: Column) -> Column:
    return F.when(variance > 0, 0.5 * F.log(2 * math.pi * math.e * variance)).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def phase_locking(a: Column, b: Column) -> Column:
    """Aggregate: phase-locking value of two phases."""
    d = a - b
    return F.sqrt(F.pow(F.avg(F.cos(d)), 2) + F.pow(F.avg(F.sin(d)), 2))


def guarded_corr(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's correlation, 0 where a side is constant."""
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 1e-10, F.try_divide(F.avg(a * b) - F.avg(a) * F.avg(b), spread)).otherwise(0.0)


def small_world(clustering: Column, path: Column, nodes: int, keep: float = 0.3) -> Column:
    k = max(1.0, keep * nodes)
    c0, p0 = k / nodes, math.log(nodes) / math.log(k) if k > 1 else float(nodes)
    return F.coalesce(F.try_divide(clustering / c0, path / p0), F.lit(1.0))


def knee_frequency(knee: Column, exponent: Column) -> Column:
    return F.when((knee > 0) & (exponent != 0), F.pow(knee, F.try_divide(F.lit(1.0), exponent)))


def knee_time(knee: Column, exponent: Column) -> Column:
    """Time constant of a knee."""
    return F.try_divide(F.lit(1.0), 2 * math.pi * knee_frequency(knee, exponent))
