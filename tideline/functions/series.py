"""Features of one series as column expressions over an array of doubles.

Everything here is higher-order functions of Spark SQL on a row's own array:
nothing moves, no Python runs. Definitions: Hjorth (1970), Katz (1988),
Petrosian (1995), Higuchi (1988). An empty or null array gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-10


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def filled(x: Column, n: Column) -> Column:
    """x up to n values, the missing ones zero."""
    return F.when(F.size(x) < n, F.concat(x, F.array_repeat(F.lit(0.0), n - F.size(x)))).otherwise(x)


def mean(x: Column) -> Column:
    return F.when(F.size(x) > 0, total(x) / F.size(x))


def moments(x: Column) -> Column:
    """(n, mean, m2) in one pass; m2 is the sum of squared deviations (Welford's update)."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def step(a: Column, v: Column) -> Column:
        n = a["n"] + 1.0
        d = v - a["mean"]
        m = a["mean"] + d / n
        return F.struct(n.alias("n"), m.alias("mean"), (a["m2"] + d * (v - m)).alias("m2"))

    return F.aggregate(x, start, step)


def deviation(m: Column) -> Column:
    """Population deviation from moments; null without values."""
    return F.when(m["n"] > 0, F.sqrt(m["m2"] / m["n"]))


def differences(x: Column) -> Column:
    """Steps from each value to the next."""
    n = F.size(x)
    return F.when(n > 1, F.zip_with(F.slice(x, 2, n - 1), F.slice(x, 1, n - 1), lambda b, a: b - a)).otherwise(F.array().cast("array<double>"))


def rms(x: Column) -> Column:
    return F.when(F.size(x) > 0, F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)))


def peak_to_peak(x: Column) -> Column:
    return F.array_max(x) - F.array_min(x)


def sign_changes(x: Column) -> Column:
    """Strict changes of sign; a zero has the sign before it, so neither leading nor inner zeros count."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def step(a: Column, v: Column) -> Column:
        turned = (F.signum(v) * a["s"] < 0).cast("int")
        return F.struct(F.when(v == 0, a["s"]).otherwise(F.signum(v)).alias("s"), (a["n"] + turned).alias("n"))

    return F.when(F.size(x) > 0, F.aggregate(x, start, step)["n"])


def _over(a: Column, b: Column) -> Column:
    return F.when(b > EPS, a / F.greatest(b, F.lit(EPS))).otherwise(F.lit(0.0))


def mobility(s0: Column, s1: Column) -> Column:
    """Hjorth's mobility from the deviations of a series and of its differences."""
    return _over(s1, s0)


def hjorth_complexity(s0: Column, s1: Column, s2: Column) -> Column:
    """Hjorth's complexity from the deviations of a series and of its first and second differences."""
    return _over(_over(s2, s1), _over(s1, s0))


def path(x: Column, d: Column) -> Column:
    """(length, far): the length of the curve and its largest distance from the start, given the differences."""
    length = F.aggregate(d, F.lit(0.0), lambda a, v: a + F.sqrt(1.0 + v * v))
    far = F.sqrt(F.array_max(F.transform(x, lambda v, i: i.cast("double") * i + (v - x[0]) * (v - x[0]))))
    return F.struct(length.alias("length"), far.alias("far"))


def katz(n: Column, path: Column) -> Column:
    """Katz's dimension from the number of values and their path; null outside 0.5 .. 2 and for fewer than three values."""
    top = F.log10((n - 1).cast("double"))
    low = top + F.log10(path["far"] / path["length"])
    out = F.when((n >= 3) & (path["length"] >= EPS) & (path["far"] >= EPS) & (F.abs(low) > EPS), top / low)
    return F.when(out.between(0.5, 2.0), out)


def turns(d: Column) -> Column:
    """Changes of direction, from the differences."""
    n = F.size(d)
    return F.when(n > 1, F.aggregate(F.zip_with(F.slice(d, 2, n - 1), F.slice(d, 1, n - 1), lambda b, a: (b * a < 0).cast("int")), F.lit(0), lambda a, v: a + v)).otherwise(0)


def petrosian(n: Column, turns: Column) -> Column:
    """Petrosian's dimension from the number of values and of turns; null without a turn."""
    n = n.cast("double")
    return F.when(turns > 0, F.log10(n) / (F.log10(n) + F.log10(n / (n + 0.4 * turns))))


def curve_lengths(x: Column, kmax: int = 8, least: int | None = None) -> Column:
    """Higuchi's mean curve lengths at steps 1 to kmax; null for fewer than 4 kmax values, or than `least`.

    Steps without a jump have null.
    """
    n = F.size(x)

    def at(k: int) -> Column:
        jumps = F.zip_with(F.slice(x, k + 1, n - k), F.slice(x, 1, n - k), lambda b, a: F.abs(b - a))
        # start m has floor((n - 1 - m) / k) jumps, and its own scale
        scaled = F.transform(jumps, lambda v, i: v * (n - 1) / (F.floor((n - 1 - i % k) / k) * k * k))
        return F.when(n > k, total(scaled) / F.least(n - k, F.lit(k)))  # the starts that have a jump

    return F.when(n >= (4 * kmax if least is None else least), F.array(*[at(k) for k in range(1, kmax + 1)]))


def higuchi(lengths: Column, kmax: int = 8) -> Column:
    """Higuchi's dimension from the curve lengths: the slope of a line through their logarithms; null outside 1 .. 2."""

    def slope(last: int) -> Column:
        xs = [math.log(k) for k in range(1, last + 1)]
        centre = sum(xs) / last
        spread = sum((v - centre) ** 2 for v in xs)
        return sum((F.log(lengths[k] + 1e-15) * (-(v - centre) / spread) for k, v in enumerate(xs)), F.lit(0.0))

    # the steps with a length are the first ones; fewer than two make no line
    d = F.coalesce(*[slope(last) for last in range(kmax, 1, -1)])
    return F.when(d.between(1.0, 2.0), d)
