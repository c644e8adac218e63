"""Feature extraction: segments in, one wide row a segment out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.features import compute
from tideline.functions.kernels import gfp_peaks, template
from tideline.model import FEATURES, GROUP_OF, Config
from tideline.operators.selection import Selection

_custom: dict[str, tuple[tuple[str, ...], Callable]] = {}


def register_group(name: str, features: tuple[str, ...]) -> Callable:
    """Decorator: add a group of features, computed by f(segment, wanted names) -> dict."""

    def add(f: Callable) -> Callable:
        _custom[name] = (features, f)
        return f

    return add


def group(name: str) -> tuple[str, ...]:
    if name in _custom:
        return _custom[name][0]
    if name not in FEATURES:
        raise KeyError(name)
    return FEATURES[name]


def catalogue(spark) -> DataFrame:
    """Every feature with its group and place."""
    rows = [(g, i, f) for g, fs in FEATURES.items() for i, f in enumerate(fs)] + [(g, i, f) for g, (fs, _) in _custom.items() for i, f in enumerate(fs)]
    return spark.createDataFrame(rows, "grp string, ord int, feature string")


def _matrix(col: pa.Array, i: int, by_time: bool) -> np.ndarray | None:
    """Row i as channels x samples, read from Arrow's buffers; None where it is no full matrix of finite numbers."""
    value = col[i].values
    if value is None or not len(value) or value.null_count:
        return None
    sizes = value.value_lengths().to_numpy()
    if sizes[0] == 0 or (sizes != sizes[0]).any():
        return None
    x = value.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(value), -1)
    return np.ascontiguousarray(x.T if by_time else x) if np.isfinite(x).all() else None


def extract(segments: DataFrame, selection: Selection | list[str], config: Config = Config(), keep: tuple[str, ...] = ("seg",), eeg: str = "eeg", by_time: bool = False, centroids: np.ndarray | None = None, errors: bool = False, templates: DataFrame | None = None, subject: str = "subject", limit: float | None = None) -> DataFrame:
    """The selected features of each segment, computed where the segment is: no shuffle.

    by_time: the signal is stored as time steps of channels. Only the inputs
    that the selected features share are built, once a segment. Features that
    can't be computed are null; with errors=True column error tells of signals
    that are no full matrix, and of each group that failed or took longer than
    limit seconds for a segment, with its exception.
    Microstates use the given centroids, or those that templates (the rows of
    `fit_template`) has for the row's subject, or the segment's own.
    """
    names = selection if isinstance(selection, list) else selection.computable()
    own = [n for n in names if n not in GROUP_OF]
    extra = {g: f for g, (fs, f) in _custom.items() if set(fs) & set(own)}
    fitted = templates is not None
    if fitted:
        maps = templates.groupBy(F.col("subject").alias("__subject")).agg(F.transform(F.array_sort(F.collect_list(F.struct("state", "map"))), lambda x: x["map"]).alias("__maps"))
        segments = segments.join(maps.hint("merge"), F.col(subject).eqNullSafe(F.col("__subject")), "left")
    src = segments.select(*keep, F.col(eeg).alias("__x"), *([F.col("__maps")] if fitted else []))
    fields = [src.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names]
    if errors:
        fields.append(T.StructField("error", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(b.schema.get_field_index("__x"))
            own = b.column(b.schema.get_field_index("__maps")) if fitted else None
            rows, bad = [], []
            for i in range(b.num_rows):
                m, failed = _matrix(x, i, by_time), []
                at = centroids if own is None else _matrix(own, i, False)
                rows.append(compute(m, config, names, at, extra, failed, limit) if m is not None else dict.fromkeys(names))
                bad.append("; ".join(failed) or None if m is not None else "the signal is no full matrix of finite numbers")
            cols = [b.column(b.schema.get_field_index(c)) for c in keep] + [pa.array([r[n] for r in rows], pa.float64()) for n in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(bad, pa.string())] if errors else cols, names=[f.name for f in fields])

    return src.mapInArrow(run, T.StructType(fields))


def fit_template(segments: DataFrame, keep: tuple[str, ...] = ("seg",), subject: str | None = None, eeg: str = "eeg", by_time: bool = False, seed: int = 42) -> DataFrame:
    """Microstate maps of each subject: (subject, state, map). Without a subject column all segments are one subject's.

    Segments are cut down to their peak maps before anything moves; then one
    subject's maps, a few thousand rows of 62 numbers at the usual sample of
    segments, meet in one group, in the order of keep and time.
    """
    who = F.col(subject) if subject else F.lit(0).cast("long")
    src = segments.select(who.alias("subject"), *keep, F.col(eeg).alias("__x"))
    fields = T.StructType([src.schema["subject"], *[src.schema[c] for c in keep], T.StructField("t", T.IntegerType()), T.StructField("map", T.ArrayType(T.DoubleType()))])

    def peaks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                m = _matrix(b.column(b.schema.get_field_index("__x")), i, by_time)
                for t in [] if m is None else gfp_peaks(m.std(0)).tolist():
                    out.append((i, t, m[:, t].tolist()))
            at = pa.array([o[0] for o in out], pa.int64())
            cols = [b.column(b.schema.get_field_index(c)).take(at) for c in ("subject", *keep)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=fields.names)

    def cluster(t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in (*keep, "t")])
        maps = template(np.array(t["map"].to_pylist()), seed=seed)
        return pa.table({"subject": pa.array([t["subject"][0].as_py()] * len(maps), t["subject"].type), "state": pa.array(range(len(maps)), pa.int32()), "map": pa.array(maps.tolist(), pa.list_(pa.float64()))})

    out = T.StructType([src.schema["subject"], T.StructField("state", T.IntegerType()), T.StructField("map", T.ArrayType(T.DoubleType()))])
    return src.mapInArrow(peaks, fields).groupBy("subject").applyInArrow(cluster, out)
