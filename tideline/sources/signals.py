"""Signal sources: samples and segments from tables, files and generators.

Long form: samples(seg, ch, t, v). Wide form: segments(seg, eeg) with eeg an
array of channels, each an array of samples.
"""

from __future__ import annotations

import importlib.util

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.session import table

CHANNELS = 62


def embedding_samples(spark: SparkSession, sf_dir: str, length: int = 100) -> DataFrame:
    """embeddings as a recording: a vector is a time step, its first 62 elements are channels."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr(f"vec_id div {length}").alias("seg"), F.expr(f"vec_id % {length}").alias("t"), F.posexplode(F.slice("embedding", 1, CHANNELS)).alias("ch", "x")).select("seg", "ch", "t", F.col("x").cast("double").alias("v"))


def embedding_segments(spark: SparkSession, sf_dir: str, length: int = 100) -> DataFrame:
    """The same in wide form, with the label of the first time step. One shuffle, of whole vectors."""
    e = table(spark, sf_dir, "embeddings")
    steps = e.select(F.expr(f"vec_id div {length}").alias("seg"), "vec_id", F.slice("embedding", 1, CHANNELS).cast("array<double>").alias("x"), "label")
    return steps.groupBy("seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda r: r["x"]).alias("steps"), F.min_by("label", "vec_id").alias("label"), F.count(F.lit(1)).alias("n"))


def event_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events on an hour x type grid: mean value, gaps filled with 0."""
    e = table(spark, sf_dir, "events").select(F.expr("CAST(floor(unix_timestamp(ts) / 3600) AS BIGINT)").alias("hour"), "event_type", "value")
    seen = e.groupBy("hour", "event_type").agg(F.avg("value").alias("v"))
    span = e.agg(F.min("hour").alias("a"), F.max("hour").alias("b"), F.array_sort(F.collect_set("event_type")).alias("types"))
    grid = span.select(F.explode(F.sequence("a", "b")).alias("hour"), F.col("a"), F.col("types")).select("hour", (F.col("hour") - F.col("a")).alias("t"), F.posexplode("types").alias("ch", "event_type"))
    return grid.join(seen, ["hour", "event_type"], "left").select("ch", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def user_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series a user, events in the order of their ids."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    return e.select(F.col("user_id").alias("seg"), F.lit(0).alias("ch"), (F.row_number().over(order) - 1).alias("t"), F.col("value").alias("v"))


def synthetic(spark: SparkSession, seconds: float = 2.0, channels: int = 62, fs: float = 200.0, tones=((2, 20), (6, 15), (10, 25), (20, 10), (40, 5)), noise: float = 5.0, seed: int = 42) -> DataFrame:
    """Sum of tones with a random phase for each channel and tone, plus noise; the same for the same seed and partitioning."""
    n = int(seconds * fs)
    base = spark.range(channels, numPartitions=1).select(F.col("id").cast("int").alias("ch"), F.array(*[F.rand(seed + i) for i in range(len(tones))]).alias("phase"))
    t = base.select("ch", "phase", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("t"))
    wave = sum((F.lit(float(a)) * F.sin(2 * 3.141592653589793 * (F.lit(float(f)) * F.col("t") / fs + F.col("phase")[i])) for i, (f, a) in enumerate(tones)), F.lit(0.0))
    return t.select(F.lit(0).cast("long").alias("seg"), "ch", "t", (wave + noise * F.randn(seed + 99)).alias("v"))


def widened(samples: DataFrame) -> DataFrame:
    """Long form to wide form."""
    rows = samples.groupBy("seg", "ch").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda r: r["v"]).alias("x"))
    return rows.groupBy("seg").agg(F.transform(F.array_sort(F.collect_list(F.struct("ch", "x"))), lambda r: r["x"]).alias("eeg"))


def subject_files(spark: SparkSession, path: str, fmt: str = "parquet", glob: str = "*") -> DataFrame:
    """Segments from a folder, a pattern or a file, searched through, with the file's name."""
    return spark.read.format(fmt).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).withColumn("source_file", F.input_file_name())


def feature_rows(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Feature rows of an earlier run: from CSV with a header, all but integers as doubles and empty cells as nulls."""
    if fmt != "csv":
        return spark.read.format(fmt).load(path)
    return spark.read.option("header", "true").option("inferSchema", "true").option("recursiveFileLookup", "true").option("nanValue", "nan").csv(path)


def tree(segments: DataFrame, eeg: str = "eeg", subject: str = "subject") -> DataFrame:
    """What a recording holds: one row a segment, in numeric order, with its channels and samples."""
    who = [subject] if subject in segments.columns else []
    size = F.coalesce(F.size(F.get(eeg, F.lit(0))), F.lit(0))
    return segments.select(*who, "trial", "segment", F.greatest(F.size(eeg), F.lit(0)).alias("channels"), F.greatest(size, F.lit(0)).alias("samples")).orderBy(*who, "trial", "segment")


def subjects(raw: DataFrame) -> DataFrame:
    """Subject attributes with their defaults."""
    have = set(raw.columns)
    value = lambda c, d: F.coalesce(F.col(c), d) if c in have else d
    names = value("channel_names", F.array().cast("array<string>"))
    return raw.select(
        value("subject_id", F.lit(0)).cast("int").alias("subject_id"),
        value("dataset_name", F.lit("")).alias("dataset_name"),
        value("task_type", F.lit("")).alias("task_type"),
        value("sampling_rate", F.lit(200.0)).cast("double").alias("sampling_rate"),
        names.alias("channel_names"),
        F.size(names).alias("n_channels"),
    )


def microvolts(segments: DataFrame, eeg: str = "eeg") -> DataFrame:
    """Volts to microvolts, and defaults of the segment's attributes."""
    out = segments.withColumn(eeg, F.transform(eeg, lambda ch: F.transform(ch, lambda v: (v * 1e6).cast("float"))))
    for c, d in (("session_id", 1), ("segment_id", 0), ("trial_id", 0), ("label", 0), ("time_length", 2.0)):
        if c in out.columns:
            out = out.withColumn(c, F.coalesce(c, F.lit(d)))
    return out


def numbered(df: DataFrame, name: str, prefix: str) -> DataFrame:
    """Rows with the number in names such as trial12, for numeric order."""
    return df.withColumn(f"{prefix}_no", F.regexp_extract(name, rf"{prefix}(\d+)", 1).cast("int"))


def register_hdf5(spark: SparkSession) -> bool:
    """Register the format `eegh5` (subject files in HDF5) where h5py is installed.

    Its reader takes filters, which Spark passes on to Python sources only
    where the session says so.
    """
    if importlib.util.find_spec("h5py") is None:
        return False
    from tideline.sources.hdf5 import SubjectSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SubjectSource)
    return True
