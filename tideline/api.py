"""Features of arrays in memory, and the command line."""

from __future__ import annotations

import argparse
import sys

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.features import compute
from tideline.model import FEATURES, PRESETS, Config
from tideline.operators import extract as ex
from tideline.operators import repair, segments
from tideline.operators.selection import Selection, load, preset, resolve


def calculate(eeg: np.ndarray, fs: float = 200.0, features: list[str] | None = None, channels: list[str] | None = None) -> dict[str, float | None]:
    """The named features or groups (nothing: all) of one channels x samples array."""
    if not isinstance(eeg, np.ndarray) or eeg.ndim != 2:
        raise ValueError("the signal must be an array of channels x samples")
    names = channels or [f"CH{i + 1}" for i in range(len(eeg))]
    return compute(eeg, Config(fs=fs, channels=tuple(names)), resolve(features).computable())


def selection_of(args: argparse.Namespace) -> Selection:
    out = load(args.config) if args.config else preset(args.preset) if args.preset else Selection()
    out = out + Selection(tuple(args.groups), tuple(args.features), tuple(args.exclude))
    return out if out.names() else preset("standard")


def described(merged: DataFrame, rows: DataFrame) -> DataFrame:
    """Merged rows with the attributes of their subject that the input has: dataset_name, task_type and sampling_rate.

    They go by subject; rows without a subject column are one subject's. Where
    a subject's rows differ, the largest value counts.
    """
    names = [c for c in ("dataset_name", "task_type", "sampling_rate") if c in rows.columns]
    if not names:
        return merged
    most = [F.max(c).alias(c) for c in names]
    if "subject" not in rows.columns:
        one = rows.agg(*most).first()
        return merged.withColumns({c: F.lit(one[c]).cast(rows.schema[c].dataType) for c in names})
    own = rows.groupBy(F.col("subject").alias("__subject")).agg(*most)
    return merged.join(own, F.col("subject").eqNullSafe(F.col("__subject")), "left").drop("__subject")


def run(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Read segments (trial, segment, eeg and, if there, subject, times and labels), merge, extract, write.

    Each subject has its own microstate template, fitted on a sample of its segments.
    """
    rows = spark.read.format(args.format).load(args.input)
    rows = rows.withColumn("source_file", F.input_file_name())
    if args.subject_files:  # a file is a subject
        rows = rows.withColumn("subject", F.col("source_file"))
    chosen = selection_of(args).computable()
    within = () if args.cross_trial else ("trial",)
    merged = described(segments.merge(rows, args.merge, within=within, eeg="eeg"), rows)
    keep = tuple(c for c in merged.columns if c != "eeg")
    names = tuple(args.channels.split(",")) if args.channels else Config().channels
    config = Config(fs=args.fs, channels=names)
    templates = None
    if any(f.startswith("Microstate") for f in chosen):
        subject = "subject" if "subject" in rows.columns else None
        templates = ex.fit_template(segments.sample(rows, args.template_segments), keep=("trial", "segment"), subject=subject)
        if subject is None:
            merged = merged.withColumn("subject", F.lit(0).cast("long"))
    out = ex.extract(merged, chosen, config, keep=keep, templates=templates, errors=True)
    repair.write(repair.flat(out) if args.sink == "csv" else out, args.output, fmt=args.sink)
    return out


def listing() -> None:
    """Print every group with its features, and every preset."""
    for g, names in FEATURES.items():
        print(f"{g} ({len(names)})", *names, sep="\n  ")
    for name in PRESETS:
        chosen = preset(name)
        print(f"preset {name}: {len(chosen.names())} features of {', '.join(chosen.required_groups())}")


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["list"]:
        return listing()
    p = argparse.ArgumentParser(prog="tideline", epilog="`tideline list` shows features, groups and presets")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--format", default="parquet")
    p.add_argument("--sink", default="parquet", choices=("parquet", "json", "orc", "csv"))
    p.add_argument("--preset")
    p.add_argument("--config")
    p.add_argument("--groups", nargs="*", default=[])
    p.add_argument("--features", nargs="*", default=[])
    p.add_argument("--exclude", nargs="*", default=[])
    p.add_argument("--merge", type=int, default=1)
    p.add_argument("--subject-files", action="store_true", help="each input file is a subject")
    p.add_argument("--cross-trial", action="store_true")
    p.add_argument("--template-segments", type=int, default=10)
    p.add_argument("--fs", type=float, default=200.0)
    p.add_argument("--channels")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tideline").getOrCreate()
    from tideline.session import ship

    ship(spark)
    run(spark, args)


if __name__ == "__main__":
    main()
