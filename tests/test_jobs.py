"""The jobs: two runs over growing input, reruns, broken runs, edge cases, command line."""

import json
import math
import random
import re

import numpy as np
import pytest

from jobs import segment_features, text_rhythm
from jobs.queries import QUERIES
from tideline.functions import kernels
from tideline.functions.features import compute
from tideline.model import Config

SF = "/root/testdata/sf0.001"
RHYTHM = json.loads(text_rhythm.CONFIG.read_text())
SEGMENTS = json.loads(segment_features.CONFIG.read_text())
DOCS = "doc_id long, text string, lang string, source string, n_words long, part string"


def near(a, b):
    return a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- text rhythm


def documents():
    rnd = random.Random(5)
    texts = [None, "", " \n\t", "one", "two words", "a a a a", "long " * 3000, "naïve 日本語 🙂 x", "x" * 100_000] + [" ".join("w" * rnd.randint(1, 12) for _ in range(rnd.randint(1, 80))) for _ in range(30)]
    return [(i % 20, t, rnd.choice(["en", "de", "", None]), "s", 9, "clash") for i, t in enumerate(texts)]


def plain_rhythm(text):
    x = np.array([len(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")], float)
    if not len(x):
        return (0, *[None] * len(text_rhythm.FEATURES))
    c = x - x.mean()
    s = [g for g in np.sign(c) if g]
    hj = kernels.hjorth(x[None, :])
    turns = kernels.petrosian(x) if len(x) > 2 else None
    return (len(x), x.mean(), x.std(), np.ptp(x), np.sqrt((x**2).mean()), sum(a != b for a, b in zip(s, s[1:], strict=False)) / len(x), float(hj[1][0]), float(hj[2][0]), kernels.katz(x), turns)


def test_rhythm_equals_plain_version(spark):
    docs = documents()
    numbered = spark.createDataFrame([(i, *d[1:]) for i, d in enumerate(docs)], DOCS)
    got = [tuple(r) for r in text_rhythm.rhythm(numbered, RHYTHM["word"]).orderBy("doc_id").collect()]
    assert len(got) == len(docs)
    for d, g in zip(docs, got, strict=True):
        assert all(near(a, b) for a, b in zip(g[3:], plain_rhythm(d[1]), strict=True)), d[1][:50]


def test_stream_takes_only_new_files(spark, tmp_path):
    docs = documents()
    at = {k: str(tmp_path / k) for k in ("in", "out", "mark")}
    add = lambda part: spark.createDataFrame(part, DOCS).repartition(3).write.mode("append").parquet(at["in"])
    go = lambda n=256: text_rhythm.run(spark, at["in"], at["out"], at["mark"], RHYTHM | {"files_a_batch": n})
    whole = lambda part: rows_of(text_rhythm.rhythm(spark.createDataFrame(part, DOCS), RHYTHM["word"]))
    add(docs[:15])
    first = rows_of(go())
    assert first == whole(docs[:15])
    files = {p.name for p in (tmp_path / "out").rglob("*.parquet")}
    assert rows_of(go()) == first and {p.name for p in (tmp_path / "out").rglob("*.parquet")} == files
    add(docs[15:])
    assert rows_of(go(1)) == whole(docs)
    assert files <= {p.name for p in (tmp_path / "out").rglob("*.parquet")}  # what was written stays as it was
    assert {p.name for p in (tmp_path / "out").glob("part=*")} == {"part=en", "part=de", "part=none"}


def test_stream_goes_on_after_a_broken_batch(spark, tmp_path):
    """A batch that was written but not committed, as by a lost driver, is done again without doubling rows."""
    docs = documents()
    at = {k: str(tmp_path / k) for k in ("in", "out", "mark")}
    spark.createDataFrame(docs, DOCS).coalesce(1).write.parquet(at["in"])
    want = rows_of(text_rhythm.run(spark, at["in"], at["out"], at["mark"], RHYTHM))
    for p in (tmp_path / "mark" / "commits").glob("*"):
        p.unlink()
    assert rows_of(text_rhythm.run(spark, at["in"], at["out"], at["mark"], RHYTHM)) == want


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "in"))
    assert text_rhythm.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), RHYTHM).count() == 0


# -- segment features


def steps(n, seed=1, channels=62):
    rnd = np.random.RandomState(seed)
    return [(i, rnd.randn(channels + 2).astype(float).tolist(), i % 3) for i in range(n)]


STEPS = "vec_id long, embedding array<float>, label int"


def test_segments_equal_plain_features(spark, tmp_path):
    rows = steps(250)
    spark.createDataFrame(rows, STEPS).write.parquet(str(tmp_path / "in"))
    got = segment_features.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), SEGMENTS).orderBy("seg").collect()
    assert [(r["trial"], r["seg"], r["label"]) for r in got] == [(0, 0, 0), (0, 1, 1)]
    config = Config(nperseg=64, noverlap=32)
    for r in got:
        x = np.array([np.float32(v[:62]) for _, v, _ in rows[r["seg"] * 100 : r["seg"] * 100 + 100]], float).T
        want = compute(x, config, [*segment_features.AMPLITUDE, *segment_features.POWER])
        assert all(math.isclose(r[n], v, rel_tol=1e-5, abs_tol=2e-6) for n, v in want.items())


def test_mark_takes_only_new_steps(spark, tmp_path):
    rows = steps(1350)
    at = {k: str(tmp_path / k) for k in ("in", "out", "mark")}
    add = lambda part: spark.createDataFrame(part, STEPS).write.mode("append").parquet(at["in"])
    go = lambda: rows_of(segment_features.run(spark, at["in"], at["out"], at["mark"], SEGMENTS))
    fresh = lambda n, tag: rows_of(segment_features.run(spark, at["in"], str(tmp_path / f"o{tag}"), str(tmp_path / f"m{tag}"), SEGMENTS))
    files = lambda t: {p.name for p in (tmp_path / "out" / f"trial={t}").glob("*.parquet")}
    add(rows[:550])
    assert len(go()) == 5 and segment_features.marked(spark, at["mark"]) == 1
    old = files(0)
    assert go() == fresh(5, "a") and files(0) == old  # trial 0 was complete
    add(rows[550:])
    assert go() == fresh(13, "b") and len(go()) == 13
    assert files(0) == old and segment_features.marked(spark, at["mark"]) == 3


def test_broken_run_is_repaired(spark, tmp_path):
    """Rows were written, the mark wasn't."""
    rows = steps(900)
    spark.createDataFrame(rows, STEPS).write.parquet(str(tmp_path / "in"))
    args = [str(tmp_path / k) for k in ("in", "out", "mark")]
    want = rows_of(segment_features.run(spark, *args, SEGMENTS))
    assert rows_of(segment_features.run(spark, args[0], args[1], str(tmp_path / "none"), SEGMENTS)) == want
    assert segment_features.marked(spark, str(tmp_path / "none")) == segment_features.marked(spark, args[2]) == 2


def test_steps_that_are_missing_repeated_or_broken(spark, tmp_path):
    rows = steps(1300)
    rows[450] = (None, rows[450][1], 0)  # segment 4 lacks a step: not written, and trial 1 stays open
    rows[20] = (20, None, None)  # segment 0: null features
    rows[120] = (120, rows[120][1][:40], 1)  # segment 1: vectors of unequal size
    rows += [rows[250], (251, [99.0] * 64, 2), (-5, [1.0] * 64, 0)]
    spark.createDataFrame(rows, STEPS).write.parquet(str(tmp_path / "in"))
    args = [str(tmp_path / k) for k in ("in", "out", "mark")]
    got = {r["seg"]: r for r in segment_features.run(spark, *args, SEGMENTS).collect()}
    assert sorted(got) == [0, 1, 2, 3, *range(5, 13)]
    assert all(got[s][n] is None for s in (0, 1) for n in (*segment_features.AMPLITUDE, *segment_features.POWER))
    assert got[2]["mean_rms"] is not None and segment_features.marked(spark, args[2]) == 1
    spark.createDataFrame([(450, [0.5] * 64, 1)], STEPS).write.mode("append").parquet(args[0])
    assert segment_features.run(spark, *args, SEGMENTS).count() == 13 and segment_features.marked(spark, args[2]) == 3


def test_empty_steps(spark, tmp_path):
    spark.createDataFrame([], STEPS).write.parquet(str(tmp_path / "in"))
    args = [str(tmp_path / k) for k in ("in", "out", "mark")]
    assert segment_features.run(spark, *args, SEGMENTS).count() == 0
    assert segment_features.run(spark, *args, SEGMENTS).count() == 0


# -- both


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_use_a_new_folder_each_time(spark, name):
    a, b = (QUERIES[name](spark, SF) for _ in range(2))
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() > 0
    assert set(a.inputFiles()).isdisjoint(b.inputFiles())


def test_command_lines(spark, tmp_path, monkeypatch):
    """The command line makes a session and stops it; here it gets the tests' own, which must live on."""

    class Builder:
        def appName(self, _):
            return self

        def getOrCreate(self):
            return Session()

    class Session:
        builder = Builder()
        stopped = 0

        def __getattr__(self, name):
            return getattr(spark, name)

        def stop(self):
            Session.stopped += 1

    for i, (job, table) in enumerate(((text_rhythm, "documents"), (segment_features, "embeddings"))):
        monkeypatch.setattr(job, "SparkSession", Session)
        config = tmp_path / "config.json"
        config.write_text(job.CONFIG.read_text())
        job.main([f"{SF}/{table}.parquet", str(tmp_path / f"out{i}"), str(tmp_path / f"mark{i}"), "--config", str(config)])
        assert Session.stopped == i + 1 and job.output(spark, str(tmp_path / f"out{i}")).count() > 0
