"""Segment algebra: merge, sample, count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import written


def _of(segments: DataFrame, subject: str | None) -> tuple[str, ...]:
    """The subject's column as a key, where the rows have one."""
    return (subject,) if subject and subject in segments.columns else ()


def indexed(rows: DataFrame, order: tuple[str, ...], name: str = "__r") -> DataFrame:
    """Rows with their place in one global order, from 0, without bringing all rows to one task.

    Rows are dealt by range and counted for each range; a range's rows are
    numbered on from the counts of those before it. Only the counts, one number
    a range, visit the driver.
    """
    part = F.spark_partition_id().alias("__p")
    dealt = written(rows.repartitionByRange(*order).select("*", part), "ranges")
    before, offsets = 0, []
    for p, n in sorted(tuple(r) for r in dealt.groupBy("__p").count().collect()):
        offsets.append((p, before))
        before += n
    base = rows.sparkSession.createDataFrame(offsets, "__p int, __base long")
    own = F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1
    return dealt.withColumn("__own", own).join(F.broadcast(base), "__p").withColumn(name, F.col("__own") + F.col("__base")).drop("__own", "__base", "__p")


def merge(segments: DataFrame, k: int, within: tuple[str, ...] = ("trial",), order: tuple[str, ...] = ("trial", "segment"), eeg: str | None = None, subject: str | None = "subject") -> DataFrame:
    """Merge k consecutive segments of each partition `within`; an incomplete tail is dropped.

    Segments of different subjects (column subject, where the rows have it)
    never meet. within=() merges across trials: in each subject's own order,
    or without subjects by one ordering of all segments, in which rows with
    equal order columns keep any order. Columns: the subject, trial, segment,
    label, start_time, end_time, time_length, source_file (that of the first)
    and, if named, the signal (channels x samples), which is joined along time.
    """
    who = _of(segments, subject)
    cols = [c for c in ("trial", "segment", "session_id", "label", "start_time", "end_time", "time_length", "source_file", eeg) if c and c in segments.columns]
    keys = [*who, *(w for w in within if w not in who)]
    if keys:
        numbered = segments.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    else:
        numbered = indexed(segments, order)
    keys.append("merged_id")
    rows = numbered.withColumn("merged_id", F.expr(f"CAST(__r AS BIGINT) div {k}"))
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__r", *cols))).alias("s")).where(F.size("s") == k)
    pick = lambda c: F.transform("s", lambda x: x[c])
    out = [pick("trial").alias("trial_ids"), pick("segment").alias("segment_ids")]
    out += [F.col("s")[0][c].alias(n) for c, n in (("session_id", "session_id"), ("label", "primary_label"), ("start_time", "start_time"), ("source_file", "source_file")) if c in cols]
    if "label" in cols:
        out.append(pick("label").alias("labels"))
    if "end_time" in cols:
        out.append(F.col("s")[k - 1]["end_time"].alias("end_time"))
    if "time_length" in cols:
        out.append(F.aggregate(pick("time_length"), F.lit(0.0), lambda a, x: a + x).alias("total_time_length"))
    out.append(F.size("s").alias("merge_count"))
    out.append(F.transform("s", lambda x: F.concat(F.lit("trial"), x["trial"], F.lit("/segment"), x["segment"])).alias("source_segments"))
    return g.select(*keys, *out, *([_joined(eeg).alias(eeg)] if eeg else []))


def _joined(eeg: str):
    first = F.col("s")[0][eeg]
    return F.transform(first, lambda _, i: F.flatten(F.transform("s", lambda x: x[eeg][i])))


def sources(merged: DataFrame, subject: str | None = "subject") -> DataFrame:
    """One row for each source segment of merged rows, to read them again."""
    who = _of(merged, subject)
    out = merged.select(*who, "merged_id", F.posexplode("source_segments").alias("nth", "name"))
    return out.select(*who, "merged_id", "nth", F.regexp_extract("name", r"trial(\d+)/", 1).cast("long").alias("trial"), F.regexp_extract("name", r"/segment(\d+)", 1).cast("long").alias("segment"))


def sample(segments: DataFrame, n: int, by: str = "trial", key: str = "segment", seed: int = 42, subject: str | None = "subject") -> DataFrame:
    """n segments of each trial, by a hash of seed and key that any engine can compute; all for n < 0."""
    if n < 0:
        return segments
    who = _of(segments, subject)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in (*who, by, key)]))
    return segments.withColumn("__r", F.row_number().over(Window.partitionBy(*who, by).orderBy(h, key))).where(F.col("__r") <= n).drop("__r")


def sample_exact(spark, trials: dict[int, list[int]], n: int, seed: int = 42) -> DataFrame:
    """The (trial, segment) pairs that one shared random state draws, in the order drawn."""
    import numpy as np

    rng, rows = np.random.RandomState(seed), []
    for t in sorted(trials):
        segs = trials[t]
        take = segs if n < 0 or len(segs) <= n else [segs[i] for i in rng.choice(len(segs), n, replace=False)]
        rows += [(t, s, i) for i, s in enumerate(take)]
    return spark.createDataFrame(rows, "trial long, segment long, drawn int")


def sample_sorted(spark, trials: dict[int, list[int]], n: int | None, seed: int = 42, first: int = 1) -> DataFrame:
    """n segments of each trial in their own order, drawn with a generator for each trial: seed + first + trials before."""
    import numpy as np

    rows = []
    for k, t in enumerate(sorted(trials)):
        segs = trials[t]
        every = not n or n < 0 or len(segs) <= n
        take = range(len(segs)) if every else sorted(np.random.default_rng(seed + first + k).choice(len(segs), n, replace=False))
        rows += [(t, segs[i], j) for j, i in enumerate(take)]
    return spark.createDataFrame(rows, "trial long, segment long, drawn int")


def draw(segments: DataFrame, n: int, shared: bool, by: str = "trial", key: str = "segment", seed: int = 42, first: int = 1, subject: str | None = "subject") -> DataFrame:
    """The rows that seeded generators draw, n of each trial, with their place in the draw (column drawn).

    shared=True: one generator a subject goes on from trial to trial, and a
    trial's rows are in the order drawn (`sample_exact` for each subject).
    shared=False: each trial has its own generator, of seed, first and the
    subject's trials before it, and its rows are in their own order
    (`sample_sorted`). A trial with n rows or fewer, or any for n < 0, gives all
    in order. Trials are ordered by `by` and rows by key, the first of equal
    keys first in any order.

    Only numbers of rows visit the generators, one row a trial; a subject's
    meet in one task. Segments themselves are numbered trial by trial.
    """
    import numpy as np
    import pyarrow as pa

    who = _of(segments, subject)
    group = F.struct(*who) if who else F.struct(F.lit(0))
    numbered = segments.withColumns({"__who": group, "__place": F.row_number().over(Window.partitionBy(*who, by).orderBy(key)) - 1})
    counts = numbered.groupBy("__who", by).agg(F.count(F.lit(1)).alias("__n"))
    schema = counts.select("__who", by).withColumn("__place", F.lit(0)).withColumn("drawn", F.lit(0)).schema

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by(by)
        state, rows = np.random.RandomState(seed), []
        for i, size in enumerate(t["__n"].to_pylist()):
            if n < 0 or size <= n:
                got = range(size)
            elif shared:
                got = state.choice(size, n, replace=False).tolist()
            else:
                got = sorted(np.random.default_rng(seed + first + i).choice(size, n, replace=False).tolist())
            rows += [(i, p, d) for d, p in enumerate(got)]
        at = pa.array([r[0] for r in rows], pa.int64())
        return pa.table([t["__who"].take(at), t[by].take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], names=schema.names)

    drawn = counts.groupBy("__who").applyInArrow(run, schema)
    on = F.col("a.__who").eqNullSafe(F.col("b.__who")) & F.col(f"a.{by}").eqNullSafe(F.col(f"b.{by}")) & (F.col("a.__place") == F.col("b.__place"))
    return numbered.alias("a").join(drawn.alias("b"), on).select(*[F.col(f"a.{c}") for c in segments.columns], "b.drawn")


def statistics(segments: DataFrame, by: str = "label", subject: str | None = "subject") -> DataFrame:
    """Trials and segments of each subject and label; a trial counts with the label of its first segment.

    by="session_id" counts them for each session in the same way.
    """
    who = _of(segments, subject)
    trial = segments.groupBy(*who, "trial").agg(F.min_by(by, "segment").alias(by), F.count(F.lit(1)).alias("n"))
    return trial.groupBy(*who, by).agg(F.count(F.lit(1)).alias("n_trials"), F.sum("n").alias("n_segments"))
