"""HDF5 subject files as a Spark data source; needs h5py.

A partition is one trial of one file, so that a long recording is read by many
tasks; planning opens files for their attributes and trial names only. Filters
on subject_id, trial_id and segment_id (equality, or a list of values) are
applied here: files, trials and segments that they leave out aren't read. All
other filters are Spark's. Rows go to Spark as Arrow batches of a few segments.

Files end in .h5 or .hdf5 and are found in all folders below the path; a file
that is reached by two names is read once, under the first. Attributes that a
file lacks have defaults: subject and segment 0, session 1, label 0, 200 Hz, no
channel names, start 0 and a length of two seconds, an end of start and length.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

SCHEMA = "subject_id int, dataset_name string, task_type string, sampling_rate double, channel_names array<string>, trial_id int, segment_id int, session_id int, label int, start_time double, end_time double, time_length double, eeg array<array<float>>, source_file string"
SUFFIXES = (".h5", ".hdf5")
#: Segments of an Arrow batch.
BATCH = 32


def number(name: str) -> int:
    """The digits of a name such as trial12."""
    return int("".join(c for c in name if c.isdigit()) or 0)


def first(attrs, name: str, default):
    """An attribute, or the first of its values; the default where it is missing or empty."""
    v = attrs.get(name)
    if v is None:
        return default
    if isinstance(v, bytes):
        return v.decode()
    if hasattr(v, "__len__") and not isinstance(v, str):
        return v[0] if len(v) else default
    return v


def ordered(names: Iterable[str], prefix: str) -> list[str]:
    """Names with the prefix by the number in them."""
    return sorted((n for n in names if n.startswith(prefix)), key=lambda n: (number(n), n))


def found(path: str) -> list[str]:
    """The subject files at a path: itself, or all below it in order, each real file once."""
    if os.path.isfile(path):
        return [path]
    every = sorted(os.path.join(folder, n) for folder, _, names in os.walk(path) for n in names if n.lower().endswith(SUFFIXES))
    seen: dict[str, str] = {}
    for p in every:
        seen.setdefault(os.path.realpath(p), p)
    return list(seen.values())


class SubjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "eegh5"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SubjectReader(self.options["path"])


@dataclass
class Trial(InputPartition):
    file: str
    trial: str


class SubjectReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in ("subject_id", "trial_id", "segment_id"):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[column] = self.wanted.get(column, values) & values
            else:
                yield f

    def takes(self, column: str, value: int) -> bool:
        return column not in self.wanted or value in self.wanted[column]

    def partitions(self) -> list[InputPartition]:
        import h5py

        out: list[InputPartition] = []
        for p in found(self.path):
            with h5py.File(p, "r") as f:
                if self.takes("subject_id", int(first(f.attrs, "subject_id", 0))):
                    out += [Trial(p, t) for t in ordered(f, "trial") if self.takes("trial_id", int(first(f[t].attrs, "trial_id", number(t))))]
        return out

    def read(self, partition: Trial | None) -> Iterator[pa.RecordBatch]:
        import h5py

        if partition is None:  # what Spark makes of no partitions
            return
        with h5py.File(partition.file, "r") as f:
            t = f[partition.trial]
            names = [n.decode() if isinstance(n, bytes) else str(n) for n in f.attrs.get("chn_name", [])]
            subject = (int(first(f.attrs, "subject_id", 0)), str(first(f.attrs, "dataset_name", "")), str(first(f.attrs, "task_type", "")), float(first(f.attrs, "rsFreq", 200.0)), names)
            rows = []
            for s in ordered(t, "segment"):
                data = t[s]["eeg"]
                a = data.attrs
                segment = int(first(a, "segment_id", 0))
                if not self.takes("segment_id", segment):
                    continue
                start, length = float(first(a, "start_time", 0.0)), float(first(a, "time_length", 2.0))
                end = float(first(a, "end_time", start + length))
                session = int(first(t.attrs, "session_id", 1))
                rows.append((*subject, int(first(t.attrs, "trial_id", number(partition.trial))), segment, session, int(first(a, "label", 0)), start, end, length, (data[:] * 1e6).astype("float32").tolist(), partition.file))
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    f64, i32, text = pa.float64(), pa.int32(), pa.string()
    kinds = [i32, text, text, f64, pa.list_(text), i32, i32, i32, i32, f64, f64, f64, pa.list_(pa.list_(pa.float32())), text]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)
