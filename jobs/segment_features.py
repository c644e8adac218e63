"""Job: feature rows of a growing recording, only for what is new.

The input is a table of time steps, (vec_id, embedding, label): the step's
number, the values of all channels and its label. Steps are cut into segments
of a fixed length and segments into trials. A run

1. reads its high-water mark, the first trial that isn't complete yet,
2. reads the steps from there on (the filter reaches the scan),
3. computes amplitude, crossing, Hjorth and band power features of each
   complete segment with the library's native operators,
4. writes them by trial, replacing just the partitions that it writes,
5. adds the new mark.

The open trial is written anew whenever it grows. A run that was broken off
between 4 and 5 is repaired by the next, which does the same trials once more,
with the same result. A run over the same input leaves the output as it was.

A segment needs `length` different step numbers, else it isn't written yet, and
a trial with such a segment holds the mark until the steps come. Of repeated
steps the least vector counts; steps without a number are left out. A null
vector, or vectors of unequal size, give the segment null features. Steps that
come for a trial below the mark, which was complete, are not taken up.

    python -m jobs.segment_features STEPS OUTPUT MARK [--config jobs/segment_features.json]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.model import BANDS, FEATURES, Config
from tideline.operators import spectrum, timedomain

log = logging.getLogger("jobs.segment_features")
CONFIG = Path(__file__).with_suffix(".json")
AMPLITUDE = FEATURES["time_domain"]
POWER = (*(f"{b}_power" for b, _, _ in BANDS), "mean_total_power")


def segments(steps: DataFrame, config: dict) -> DataFrame:
    """(trial, seg, label, steps) of complete segments; one shuffle, of the steps."""
    length = config["length"]
    seg = F.expr(f"vec_id div {length}").alias("seg")
    one = steps.where("vec_id >= 0").select(seg, "vec_id", F.slice("embedding", 1, config["channels"]).cast("array<double>").alias("x"), "label")
    listed = F.array_sort(F.collect_list(F.struct("vec_id", "x", "label")))
    # of equal steps only the first, in the order of vectors
    once = F.filter("s", lambda r, i: (i == 0) | (r["vec_id"] != F.col("s")[F.greatest(i - 1, F.lit(0))]["vec_id"]))
    whole = one.groupBy("seg").agg(listed.alias("s")).withColumn("s", once).where(F.size("s") == length)
    trial = F.expr(f"seg div {config['trial']}").alias("trial")
    return whole.select(trial, "seg", F.col("s")[0]["label"].cast("long").alias("label"), F.transform("s", lambda r: r["x"]).alias("steps"))


def features(segs: DataFrame, config: dict) -> DataFrame:
    """trial, seg, label and the features; a channel is reduced in its own row, and its numbers are averaged."""
    c = Config(fs=config["fs"], nperseg=config["nperseg"], noverlap=config["noverlap"], nfft=config["nfft"])
    keys = ("trial", "seg", "label")
    rows = timedomain.channel_features(spectrum.channels(segs, keys, "steps", by_time=True), c.fs)
    power = spectrum.band_powers(rows, c, length=config["length"])
    power = power.select(*keys, *AMPLITUDE, *[F.col(b).alias(f"{b}_power") for b, _, _ in BANDS], F.col("total").alias("mean_total_power"))
    out = timedomain.means(power, keys, (*AMPLITUDE, *POWER))
    return out.select(*keys, *[(F.round(f, config["digits"]) + F.lit(0.0)).alias(f) for f in (*AMPLITUDE, *POWER)])


def marked(spark: SparkSession, path: str) -> int:
    """The first trial that isn't complete; 0 where there is no mark yet."""
    try:
        row = spark.read.schema("open_trial long").parquet(path).agg(F.max("open_trial")).first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0
    return row[0] or 0


def output(spark: SparkSession, path: str) -> DataFrame:
    """The whole output as it stands."""
    kinds = "seg long, label long, " + ", ".join(f"{f} double" for f in (*AMPLITUDE, *POWER)) + ", trial long"
    return spark.read.schema(kinds).parquet(path)


def first_open(whole: DataFrame, first: int, size: int) -> int:
    """The first trial from `first` on that hasn't all its segments."""
    full = whole.where(F.col("trial") >= first).groupBy("trial").count().where(F.col("count") >= size).select("trial")
    after = full.select((F.col("trial") + 1).alias("trial"))
    start = whole.sparkSession.range(1).select(F.lit(first).cast("long").alias("trial"))
    return after.unionByName(start).join(full, "trial", "left_anti").agg(F.min("trial")).first()[0]


def run(spark: SparkSession, steps: str, out: str, mark: str, config: dict) -> DataFrame:
    """Bring the output up to date with the steps; returns the whole output."""
    first = marked(spark, mark)
    new = spark.read.parquet(steps).where(F.col("vec_id") >= first * config["length"] * config["trial"])
    rows = features(segments(new, config), config)
    rows.repartition("trial").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trial").parquet(out)
    whole = output(spark, out)
    written = whole.where(F.col("trial") >= first).count()
    after = first_open(whole, first, config["trial"])
    if after > first:
        spark.range(1).select(F.lit(after).cast("long").alias("open_trial")).coalesce(1).write.mode("append").parquet(mark)
    log.info("read the steps of %s from trial %d on; wrote %d segments to %s, whose first open trial is %d", steps, first, written, out, after)
    return whole


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("steps")
    p.add_argument("output")
    p.add_argument("mark")
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("segment_features").getOrCreate()
    try:
        run(spark, a.steps, a.output, a.mark, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
