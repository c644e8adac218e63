"""Spark operators on small hand-made inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.model import Config
from tideline.operators import extract as ex
from tideline.operators import repair, segments
from tideline.sources import signals
from tideline.streaming.windows import window_features


@pytest.fixture(scope="module")
def recording(spark):
    rows = [(t, s, s % 2, 2.0 * s, 2.0 * s + 2, 2.0, [[float(10 * t + s + c)] * 3 for c in range(2)]) for t in (1, 2) for s in range(5)]
    return spark.createDataFrame(rows, "trial long, segment long, label int, start_time double, end_time double, time_length double, eeg array<array<double>>")


def test_merge_joins_along_time_and_drops_the_tail(recording):
    out = segments.merge(recording, 2, eeg="eeg").orderBy("trial", "merged_id").collect()
    assert len(out) == 4
    assert out[0].eeg == [[10.0] * 3 + [11.0] * 3, [11.0] * 3 + [12.0] * 3]
    assert out[0].source_segments == ["trial1/segment0", "trial1/segment1"] and out[0].total_time_length == 4.0
    assert segments.merge(recording, 2, within=()).count() == 5
    assert segments.sources(segments.merge(recording, 2, within=())).count() == 10


def test_indexed_is_one_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")).repartition(5)
    got = {r.k: r.i for r in segments.indexed(df, ("k",), "i").collect()}
    assert [got[k] for k in sorted(got)] == list(range(1000))


def test_sampling(spark, recording):
    assert segments.sample(recording, 2).groupBy("trial").count().collect()[0][1] == 2
    assert segments.sample(recording, -1).count() == 10
    exact = segments.sample_exact(spark, {1: list(range(5)), 2: list(range(5))}, 2).collect()
    rng = np.random.RandomState(42)
    want = [(t, int(i)) for t in (1, 2) for i in rng.choice(5, 2, replace=False)]
    assert [(r.trial, r.segment) for r in exact] == want


def test_subjects_stay_apart(spark, recording):
    both = recording.withColumn("subject", F.lit("a")).unionByName(recording.withColumn("subject", F.lit("b")).withColumn("label", F.lit(7)))
    for within, n in ((("trial",), 8), ((), 10)):
        out = segments.merge(both, 2, within=within, eeg="eeg").collect()
        assert len(out) == n and all(set(r.labels) <= ({0, 1} if r.subject == "a" else {7}) for r in out)
    assert segments.sources(segments.merge(both, 2, within=())).groupBy("subject", "trial", "segment").count().where("count > 1").count() == 0
    assert segments.sample(both, 2).groupBy("subject", "trial").count().where("count = 2").count() == 4
    assert {tuple(r) for r in segments.statistics(both).collect()} == {("a", 0, 2, 10), ("b", 7, 2, 10)}
    # without subjects, repeated rows are numbered themselves
    assert segments.merge(both.drop("subject"), 2, within=()).count() == 10


def test_template_of_each_subject(spark):
    rng = np.random.default_rng(1)
    x = [rng.standard_normal((8, 200)).cumsum(1) for _ in range(2)]
    df = spark.createDataFrame([(s, 1, x[i].tolist()) for i, s in enumerate("ab")], "subject string, seg long, eeg array<array<double>>")
    fitted = ex.fit_template(df, subject="subject")
    config, names = Config(channels=tuple("ABCDEFGH")), ["Microstate_0_gev", "Microstate_1_gev"]
    got = {r.subject: (r[names[0]], r[names[1]]) for r in ex.extract(df, names, config, keep=("subject",), templates=fitted).collect()}
    for s in "ab":
        maps = np.array([r.map for r in fitted.where(F.col("subject") == s).orderBy("state").collect()])
        own = ex.extract(df.where(F.col("subject") == s), names, config, keep=("subject",), centroids=maps).first()
        assert got[s] == (own[names[0]], own[names[1]])


def test_refill_computes_only_what_is_missing(spark):
    rng = np.random.default_rng(3)
    segs = spark.createDataFrame([(i, rng.standard_normal((2, 50)).tolist()) for i in range(4)], "seg long, eeg array<array<double>>")
    config = Config(channels=("F3", "F4"))
    whole = ex.extract(segs, ["mean_rms", "mean_channel_std", "mean_peak_to_peak"], config)
    holes = whole.withColumn("mean_rms", F.when(F.col("seg") != 1, F.col("mean_rms"))).withColumn("mean_peak_to_peak", F.col("mean_peak_to_peak") + 100)
    out = repair.refill(holes, segs, ["mean_rms", "mean_channel_std", "mean_peak_to_peak"], ["seg"], config)
    want = {r.seg: (r.mean_rms, r.mean_peak_to_peak + 100) for r in whole.collect()}  # what was there stays
    assert {r.seg: (r.mean_rms, r.mean_peak_to_peak) for r in out.collect()} == want
    # what can't be had stays missing
    gone = repair.refill(holes, segs.where("seg <> 1"), ["mean_rms"], ["seg"], config)
    assert [r.seg for r in gone.where("mean_rms IS NULL").collect()] == [1]


def test_time_limit(spark):
    import time

    @ex.register_group("slow", ("slow_one",))
    def slow(s, want):
        import time as clock

        clock.sleep(3)
        return {"slow_one": 1.0}

    df = spark.createDataFrame([(1, [[0.0, 1.0, 0.0, 2.0] * 30] * 2)], "seg long, eeg array<array<double>>")
    try:
        began = time.perf_counter()
        row = ex.extract(df, ["slow_one", "mean_rms"], Config(channels=("F3", "F4")), errors=True, limit=0.3).first()
        assert row.slow_one is None and row.mean_rms > 0 and "TimeoutError" in row.error and time.perf_counter() - began < 3
    finally:
        ex._custom.pop("slow")


def test_feature_rows_and_tree(spark, recording, tmp_path):
    rows = spark.createDataFrame([(1, 1.5, None), (2, float("nan"), 4.0)], "seg long, x double, y double")
    repair.write(rows, str(tmp_path / "csv"), fmt="csv")
    got = signals.feature_rows(spark, str(tmp_path / "csv"))
    assert dict(got.dtypes)["x"] == "double" and got.where(repair.is_missing("x")).count() == 1 and got.where(repair.is_missing("y")).count() == 1
    shape = [tuple(r) for r in signals.tree(recording).collect()]
    assert shape == [(t, s, 2, 3) for t in (1, 2) for s in range(5)]


def test_extract_tells_what_failed(spark):
    @ex.register_group("broken", ("never",))
    def broken(s, want):
        raise ValueError("no luck")

    df = spark.createDataFrame([(1, [[0.0, 1.0, 0.0, 2.0] * 30] * 2)], "seg long, eeg array<array<double>>")
    try:
        row = ex.extract(df, ["never", "mean_rms"], Config(channels=("F3", "F4")), errors=True).first()
        assert row.never is None and row.mean_rms > 0 and row.error == "broken: ValueError: no luck"
    finally:
        ex._custom.pop("broken")


def test_extract_reports_broken_signals(spark):
    rows = [(1, [[0.0, 1.0, 0.0, 2.0] * 30] * 2), (2, None), (3, [[1.0], [1.0, 2.0]]), (4, [])]
    df = spark.createDataFrame(rows, "seg long, eeg array<array<double>>")
    out = {r.seg: r for r in ex.extract(df, ["mean_rms", "mean_channel_std"], Config(channels=("F3", "F4")), errors=True).collect()}
    assert out[1].mean_rms > 0 and out[1].error is None and all(out[k].mean_rms is None and out[k].error for k in (2, 3, 4))


def test_template_and_backfit(spark):
    x = np.random.default_rng(0).standard_normal((8, 200)).cumsum(1)
    df = spark.createDataFrame([(1, x.tolist()), (2, (-x).tolist())], "seg long, eeg array<array<double>>")
    maps = np.array([r.map for r in ex.fit_template(df).orderBy("state").collect()])
    assert maps.shape == (4, 8)
    a, b = ex.extract(df, ["Microstate_0_timecov", "Microstate_0_gev"], Config(channels=tuple("ABCDEFGH")), centroids=maps).orderBy("seg").collect()
    assert a.Microstate_0_timecov == b.Microstate_0_timecov


def test_repair_and_compare(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 4.0), (3, 5.0, 6.0)], "seg long, x double, y double")
    b = spark.createDataFrame([(1, 9.0, 2.0), (2, 3.0, 9.0)], "seg long, x double, y double")
    assert sorted(map(tuple, repair.fill(a, b, ["x", "y"], ["seg"]).collect())) == [(1, 1.0, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0)]
    diff = {r.feature: r.close for r in repair.compare(a.fillna(0), b, ["seg"], ["x"]).collect()}
    assert diff == {"x": False}
    assert repair.ensure(a, ["z", "x"]).columns == ["z", "x", "seg", "y"]
    assert len(repair.required()) == 101
    assert [r.consistent for r in repair.column_counts({"a": a, "b": b, "c": b.drop("y")}, spark).collect()] == [True, True, False]
    odd = repair.column_counts({"a": a, "c": b.drop("y").withColumn("z", F.lit(1))}, spark).collect()[1]
    assert odd.more == ["z"] and odd.fewer == ["y"]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "seg long, x double")
    repair.write(a, str(tmp_path / "out"), by=("seg",))
    repair.write(a.where("seg = 2").withColumn("x", F.lit(7.0)), str(tmp_path / "out"), by=("seg",))
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 7.0]
    repair.write(a, str(tmp_path / "csv"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "csv"), header=True, schema="seg long, x double").count() == 2
    assert repair.summary([a, a.drop("x")], ["x", "y"]).count() == 4


def test_sources(spark, tmp_path):
    s = signals.synthetic(spark, channels=3)
    assert s.count() == 1200 and len(signals.widened(s).first().eeg) == 3
    raw = spark.createDataFrame([(5, None)], "subject_id int, sampling_rate double")
    assert tuple(signals.subjects(raw).first()) == (5, "", "", 200.0, [], 0)
    volts = spark.createDataFrame([([[1e-6]], None)], "eeg array<array<double>>, label int")
    assert tuple(signals.microvolts(volts).first()) == ([[1.0]], 0)
    names = spark.createDataFrame([("trial10",), ("trial9",)], "name string")
    assert [r.trial_no for r in signals.numbered(names, "name", "trial").orderBy("trial_no").collect()] == [9, 10]
    raw.write.parquet(str(tmp_path / "a" / "b"))
    assert signals.subject_files(spark, str(tmp_path), glob="*.parquet").count() == 1
    assert signals.register_hdf5(spark) in (True, False)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:{m:02d}:00", "k", float(h * m)) for h in range(5) for m in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    q = window_features(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    got = sorted(map(tuple, spark.sql("SELECT * FROM windows").collect()))
    q.stop()
    assert got == sorted(map(tuple, window_features(df).collect())) and len(got) == 5


def test_custom_groups(spark):
    @ex.register_group("twice", ("twice_mean",))
    def twice(s, want):
        return {"twice_mean": 2 * s.x.mean()}

    df = spark.createDataFrame([(1, [[1.0, 2.0]] * 2)], "seg long, eeg array<array<double>>")
    assert ex.extract(df, ["twice_mean", "mean_rms"]).first().twice_mean == 3.0
    assert ex.group("twice") == ("twice_mean",)
    with pytest.raises(KeyError):
        ex.group("nope")


def test_sample_sorted(spark):
    got = [(r.trial, r.segment) for r in segments.sample_sorted(spark, {1: [5, 6, 7, 8], 2: [1]}, 2).collect()]
    want = [(1, 5 + int(i)) for i in sorted(np.random.default_rng(43).choice(4, 2, replace=False))] + [(2, 1)]
    assert got == want


def test_columns(spark):
    from tideline.functions import columns as C

    df = spark.createDataFrame([(1.0, 0.0), (1.0, 1e-9), (3.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(C.safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, 100.0, 1.5]
    assert df.select(C.phase_locking(F.col("a"), F.col("a"))).first()[0] == pytest.approx(1)
    assert df.select(C.guarded_corr(F.lit(1.0), F.col("a"))).first()[0] == 0.0
    assert df.select(C.guarded_corr(F.col("a"), 2 * F.col("a"))).first()[0] == pytest.approx(1)
    assert df.select(C.knee_frequency(F.lit(8.0), F.lit(3.0))).first()[0] == pytest.approx(2)


def test_api_and_command_line(spark, tmp_path):
    from tideline import api

    x = np.random.default_rng(2).standard_normal((4, 400))
    out = api.calculate(x, 200.0, ["time_domain", "katz_fd"])
    assert len(out) == 9 and out["mean_rms"] > 0
    with pytest.raises(ValueError, match="array"):
        api.calculate([1, 2])
    rows = [(1, s, x[:, :100].tolist()) for s in range(4)]
    spark.createDataFrame(rows, "trial long, segment long, eeg array<array<double>>").write.parquet(str(tmp_path / "in"))
    api.main([str(tmp_path / "in"), str(tmp_path / "out"), "--groups", "time_domain", "microstate", "--merge", "2", "--channels", "F3,F4,O1,O2"])
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 2 and all(r.mean_rms > 0 and r.Microstate_0_timecov is not None and r.error is None for r in got)
    assert all("in/part-" in r.source_file for r in got)
    # each file a subject, to a CSV sink with lists as text
    for s in ("s1", "s2"):
        spark.createDataFrame(rows, "trial long, segment long, eeg array<array<double>>").coalesce(1).write.parquet(str(tmp_path / "two" / s))
    api.main([str(tmp_path / "two" / "*"), str(tmp_path / "csv"), "--groups", "time_domain", "--merge", "2", "--subject-files", "--sink", "csv", "--channels", "F3,F4,O1,O2"])
    got = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).collect()
    assert len(got) == 4 and len({r.subject for r in got}) == 2 and {r.segment_ids for r in got} == {"[0,1]", "[2,3]"}
    # a subject's attributes reach its feature rows
    told = [(s, t, g, e, f"set{s}", 100.0 + s) for s in (1, 2) for t, g, e in rows]
    kinds = "subject long, trial long, segment long, eeg array<array<double>>, dataset_name string, sampling_rate double"
    for k, (subjects, df) in enumerate((({1, 2}, spark.createDataFrame(told, kinds)), ({None}, spark.createDataFrame(told[:4], kinds).drop("subject")))):
        df.write.parquet(str(tmp_path / f"told{k}"))
        api.main([str(tmp_path / f"told{k}"), str(tmp_path / f"rows{k}"), "--groups", "time_domain", "--merge", "2", "--channels", "F3,F4,O1,O2"])
        got = spark.read.parquet(str(tmp_path / f"rows{k}")).collect()
        assert len(got) == 2 * len(subjects) and all((r.dataset_name, r.sampling_rate) == (f"set{s}", 100.0 + s) for r in got for s in [getattr(r, "subject", 1)])


def test_listing(capsys):
    from tideline import api

    api.main(["list"])
    out = capsys.readouterr().out
    assert "time_domain" in out and "preset standard" in out and "katz_fd" in out
