"""Repair of feature rows, comparison of runs, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tideline.model import GROUP_OF, META, OPTIONAL, Config
from tideline.operators.extract import extract
from tideline.session import written


def required() -> list[str]:
    return [f for f in GROUP_OF if f not in OPTIONAL]


def ensure(df: DataFrame, names: list[str]) -> DataFrame:
    """Missing columns as nulls; order: metadata, names, the others."""
    have = set(df.columns)
    out = df.withColumns({n: F.lit(None).cast("double") for n in names if n not in have})
    lead = [c for c in META if c in have]
    return out.select(*lead, *names, *[c for c in df.columns if c not in lead and c not in names])


def is_missing(name: str) -> Column:
    return F.col(name).isNull() | F.isnan(name)


def missing(df: DataFrame, names: list[str]) -> Column:
    """The names of a row's missing features."""
    return F.array_compact(F.array(*[F.when(is_missing(n), F.lit(n)) for n in names]))


def fill(rows: DataFrame, fresh: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """Old values stay; only missing ones are taken from fresh. Rows that miss nothing aren't joined."""
    whole = rows.where(F.size(missing(rows, names)) == 0)
    holes = rows.where(F.size(missing(rows, names)) > 0).alias("o")
    f = fresh.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(n).alias(f"__{n}") for n in names])
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"__{k}")) for k in keys]
    new = {n: F.when(is_missing(n), F.col(f"__{n}")).otherwise(F.col(n)) for n in names}
    out = holes.join(f, on, "left").withColumns(new).select(rows.columns)
    return whole.unionByName(out)


def refill(rows: DataFrame, segments: DataFrame, names: list[str], keys: list[str], config: Config = Config(), tries: int = 3, **how) -> DataFrame:
    """Compute what is missing, and nothing else: only features that some row misses, only for rows that miss one.

    Rows whose features are missing again are tried anew, up to `tries` times.
    how goes to `extract` (eeg, by_time, templates, limit, ...).
    """
    def told(df: DataFrame) -> Row:
        holes = F.sum((F.size(missing(df, names)) > 0).cast("long")).alias("__holes")
        return df.agg(holes, *[F.max(is_missing(n).cast("int")).alias(n) for n in names]).first()

    rows = written(rows, "refill")
    state = told(rows)
    for _ in range(tries):
        wanted = [n for n in names if state[n]]
        if not wanted:
            break
        holes = rows.where(F.size(missing(rows, wanted)) > 0).select(*keys).distinct()
        own = segments.join(holes.hint("merge"), keys, "left_semi")
        rows = written(fill(rows, extract(own, wanted, config, keep=tuple(keys), **how), wanted, keys), "refill")
        before, state = state, told(rows)
        if state["__holes"] == before["__holes"]:
            break  # nothing more can be had
    return rows


def compare(a: DataFrame, b: DataFrame, keys: list[str], names: list[str], tolerance: float = 1e-6) -> DataFrame:
    """Largest and mean difference of each feature between two runs, and whether all are within tolerance."""
    long = lambda d, v: d.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).alias("v")) for n in names])).alias("x")).select(*keys, "x.feature", F.col("x.v").alias(v))
    both = long(a, "va").join(long(b, "vb"), [*keys, "feature"], "full")
    d = F.abs(F.col("va") - F.col("vb"))
    return both.groupBy("feature").agg(F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"), F.bool_and(F.coalesce(d <= tolerance + 1e-5 * F.abs("vb"), F.col("va").isNull() & F.col("vb").isNull())).alias("close"))


def column_counts(frames: dict[str, DataFrame], spark) -> DataFrame:
    """Columns of each source, whether they are as many as in the first, and which it has more or fewer."""
    first = next(iter(frames.values())).columns
    rows = [(k, len(d.columns), len(d.columns) == len(first), [c for c in d.columns if c not in first], [c for c in first if c not in d.columns]) for k, d in frames.items()]
    return spark.createDataFrame(rows, "source string, n_columns int, consistent boolean, more array<string>, fewer array<string>")


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, for sinks that know only plain columns."""
    return df.select([F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])


def write(df: DataFrame, path: str, by: tuple[str, ...] = (), fmt: str = "parquet") -> None:
    """Feature rows, partitioned; a rerun replaces only the partitions that it writes."""
    w = df.write.mode("overwrite").option("header", "true").option("partitionOverwriteMode", "dynamic" if by else "static")
    (w.partitionBy(*by) if by else w).format(fmt).save(path)


def summary(parts: list[DataFrame], names: list[str]) -> DataFrame:
    """All parts under one another, with the columns of all of them."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return ensure(out, names)
