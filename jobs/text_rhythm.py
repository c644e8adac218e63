"""Job: rhythm features of texts, taken up as files arrive.

A text is read as a signal: the lengths of its words in order. Each document
gets the amplitude, crossing, Hjorth and fractal features of that series, the
same as a recorded channel would, so that texts can be compared with
recordings and with one another by how regular they are.

The job is a stream over the files of a documents table. A run takes all files
that its checkpoint hasn't seen, some at a time, writes their rows and ends; a
run without new files adds nothing. The sink writes each batch once, however
often a run is broken off: its log in the output says which files count, and
readers of the output follow it. Rows are written by language.

A null or empty text, or one of blanks, has no words and null features; a null
or empty language is written under `none`. Repeated rows give repeated rows.

    python -m jobs.text_rhythm DOCUMENTS OUTPUT CHECKPOINT [--config jobs/text_rhythm.json]
"""

from __future__ import annotations

import argparse
import json
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import series

log = logging.getLogger("jobs.text_rhythm")
CONFIG = Path(__file__).with_suffix(".json")
FEATURES = ("mean_length", "length_std", "length_range", "length_rms", "crossing_rate", "hjorth_mobility", "hjorth_complexity", "katz_fd", "petrosian_fd")
SCHEMA = "doc_id long, text string, lang string, source string"


def rhythm(docs: DataFrame, word: str, digits: int = 6) -> DataFrame:
    """doc_id, source, lang, n_words and FEATURES of each row; all in the JVM, nothing moves."""
    lengths = F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(word), F.lit(0)), lambda w: F.char_length(w).cast("double"))
    x, d = F.col("x"), F.col("d")
    steps = docs.select("doc_id", "source", "lang", lengths.alias("x")).withColumns({"m0": series.moments(x), "mean": series.mean(x), "d": series.differences(x)})
    steps = steps.withColumns({"m1": series.moments(d), "m2": series.moments(series.differences(d)), "centred": F.transform(x, lambda v: v - F.col("mean"))})
    steps = steps.withColumns({f"s{k}": series.deviation(F.col(f"m{k}")) for k in range(3)} | {"path": series.path(x, d), "turns": series.turns(d)})
    s0, s1, s2 = (F.coalesce(f"s{k}", F.lit(0.0)) for k in range(3))
    some = F.size(x) > 0
    out = {
        "mean_length": F.col("mean"),
        "length_std": s0,
        "length_range": series.peak_to_peak(x),
        "length_rms": series.rms(x),
        "crossing_rate": series.sign_changes(F.col("centred")) / F.size(x),
        "hjorth_mobility": series.mobility(s0, s1),
        "hjorth_complexity": series.hjorth_complexity(s0, s1, s2),
        "katz_fd": series.katz(F.size(x), F.col("path")),
        "petrosian_fd": series.petrosian(F.size(x), F.col("turns")),
    }
    return steps.select("doc_id", "source", "lang", F.size(x).cast("long").alias("n_words"), *[F.when(some, F.round(out[f], digits) + F.lit(0.0)).alias(f) for f in FEATURES])


def output(spark: SparkSession, path: str) -> DataFrame:
    """The whole output as it stands."""
    kinds = "doc_id long, source string, lang string, n_words long, " + ", ".join(f"{f} double" for f in FEATURES)
    return spark.read.schema(kinds + ", part string").parquet(path).drop("part")


def pattern(path: str) -> str:
    """The path as a pattern that only it fits: a file stream takes a table of one file by pattern only."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> DataFrame:
    """Take up what is new in the folder (or file) documents; returns the whole output."""
    read = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(pattern(documents))
    rows = rhythm(read, config["word"]).withColumn("part", F.coalesce(F.nullif("lang", F.lit("")), F.lit("none")))
    query = rows.writeStream.format("parquet").partitionBy("part").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    batches = [p for p in query.recentProgress if p.numInputRows]
    for p in batches:
        log.info("batch %d: read %d rows of %s", p.batchId, p.numInputRows, documents)
    whole = output(spark, out)
    log.info("read %d new rows in %d batches; %s now holds %d rows", sum(p.numInputRows for p in batches), len(batches), out, whole.count())
    return whole


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("documents")
    p.add_argument("output")
    p.add_argument("checkpoint")
    p.add_argument("--config", default=str(CONFIG))
    a = p.parse_args(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("text_rhythm").getOrCreate()
    try:
        run(spark, a.documents, a.output, a.checkpoint, json.loads(Path(a.config).read_text()))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
