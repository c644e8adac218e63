"""A corpus pipeline of five stages over the documents of a data folder.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept, and returns a DataFrame; all but the last return the columns
of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import decontaminate, jaccard, pieces, secrets, toxicity
from tideline.llm.queries import remainder, tokenizer_path
from tideline.llm.words import unused
from tideline.session import ship, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the clause grammar scores at the threshold or above go."""
    ship(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(remainder(3) != 1))
    score = unused(docs.columns, "__score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the least id stays."""
    ship(spark)
    return jaccard.representatives(docs, jaccard.NEAR)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are half benchmark go."""
    ship(spark)
    out = decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    ship(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each text encoded, and decoded again: the token ids to train on, and their digests."""
    ship(spark)
    return pieces.encode_decode(docs, tokenizer_path(), real=True).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("sentencepiece", tokenized),
]

#: No SQL: the toxicity grammar and the tokenizer can't be written in it; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
