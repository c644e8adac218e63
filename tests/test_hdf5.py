"""The HDF5 source over a stand-in for h5py, which keeps a file's tree as JSON and tells which trials it opened."""

import importlib
import json
import os
import sys

import pytest

from tideline.sources import signals

H5PY = '''
import json
import os

import numpy as np


class Attrs(dict):
    pass


class Group:
    def __init__(self, spec, file, path=""):
        self.spec, self.file, self.path, self.attrs = spec, file, path, Attrs(spec.get("attrs", {}))

    def __iter__(self):
        return iter(self.spec.get("groups", {}))

    def __getitem__(self, name):
        if name == "eeg" and "eeg" in self.spec:
            return Data(self.spec, self.file, self.path)
        return Group(self.spec["groups"][name], self.file, self.path + "/" + name)


class Data:
    def __init__(self, spec, file, path):
        self.values, self.attrs, self.file, self.path = np.array(spec["eeg"], float), Attrs(spec.get("attrs", {})), file, path

    def __getitem__(self, _):
        with open(self.file + ".read", "a") as f:
            f.write(self.path + "\\n")
        return self.values


class File(Group):
    def __init__(self, path, mode):
        with open(path) as f:
            super().__init__(json.load(f), path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return None
'''


def subject(s, trials, segments, **attrs):
    groups = {}
    for t in trials:
        own = {f"segment{k}": {"eeg": [[1e-6 * s, 2e-6], [1e-6 * t, 1e-6 * k]], "attrs": {"segment_id": k, "label": [k % 3], "start_time": 2.0 * k}} for k in segments}
        groups[f"trial{t}"] = {"attrs": {"trial_id": t, "session_id": 2}, "groups": own}
    return {"attrs": {"subject_id": s, "rsFreq": 100.0, "chn_name": ["F3", "F4"], **attrs}, "groups": groups}


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("h5")
    (at / "h5py.py").write_text(H5PY)
    spark.sparkContext.addPyFile(str(at / "h5py.py"))
    sys.path.insert(0, str(at))
    importlib.invalidate_caches()
    data = at / "data"
    (data / "deep").mkdir(parents=True)
    (data / "a.h5").write_text(json.dumps(subject(1, [10, 9, 2], [0, 1, 11, 2], dataset_name="set", task_type="rest")))
    (data / "deep" / "b.hdf5").write_text(json.dumps(subject(2, [1], [5])))
    (data / "deep" / "bare.H5").write_text(json.dumps({"groups": {"trial7": {"groups": {"segment3": {"eeg": [[1e-6]]}}}}}))
    (data / "notes.txt").write_text("not a recording")
    os.symlink(data / "a.h5", data / "z.h5")
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    assert signals.register_hdf5(spark)
    yield data
    spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    sys.path.remove(str(at))
    sys.modules.pop("h5py", None)


def reads(data, name):
    p = data / f"{name}.read"
    got = p.read_text().split() if p.exists() else []
    p.unlink(missing_ok=True)
    return sorted(got)


def test_every_segment_once_with_defaults(spark, source):
    rows = spark.read.format("eegh5").load(str(source)).collect()
    keys = [(r.subject_id, r.trial_id, r.segment_id) for r in rows]
    assert sorted(keys) == sorted([(1, t, s) for t in (2, 9, 10) for s in (0, 1, 2, 11)] + [(2, 1, 5), (0, 7, 0)])
    one = next(r for r in rows if (r.subject_id, r.trial_id, r.segment_id) == (1, 9, 11))
    assert (one.dataset_name, one.task_type, one.sampling_rate, one.channel_names, one.session_id, one.label, one.start_time, one.end_time, one.time_length) == ("set", "rest", 100.0, ["F3", "F4"], 2, 2, 22.0, 24.0, 2.0)
    assert one.eeg == [[1.0, 2.0], [9.0, 11.0]] and one.source_file.endswith("/a.h5")
    bare = next(r for r in rows if r.trial_id == 7)
    assert (bare.dataset_name, bare.sampling_rate, bare.channel_names, bare.session_id, bare.label, bare.end_time, bare.eeg) == ("", 200.0, [], 1, 0, 2.0, [[1.0]])


def test_a_partition_a_trial(spark, source):
    df = spark.read.format("eegh5").load(str(source))
    assert df.rdd.getNumPartitions() == 5
    assert spark.read.format("eegh5").load(str(source / "a.h5")).rdd.getNumPartitions() == 3


def test_filters_reach_the_files(spark, source):
    df = spark.read.format("eegh5").load(str(source))
    for name in ("a.h5", "deep/b.hdf5"):
        reads(source, name)
    got = df.where("trial_id = 9 AND segment_id IN (1, 11) AND start_time > 3").collect()
    assert [(r.subject_id, r.trial_id, r.segment_id) for r in got] == [(1, 9, 11)]
    assert reads(source, "a.h5") == ["/trial9/segment1", "/trial9/segment11"] and reads(source, "deep/b.hdf5") == []
    assert df.where("subject_id = 2").count() == 1
    assert reads(source, "a.h5") == [] and len(reads(source, "deep/b.hdf5")) == 1
    assert df.where("trial_id = 2 AND trial_id IN (9, 10)").count() == 0
    assert df.where("trial_id > 9").count() == 4  # Spark's own filter
    assert df.where("subject_id = 1 AND trial_id IS NOT NULL").count() == 12


def test_no_files(spark, tmp_path):
    pytest.importorskip("h5py")
    assert spark.read.format("eegh5").load(str(tmp_path)).count() == 0
