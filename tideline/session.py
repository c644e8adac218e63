"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table of a data folder; the folder may be on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Make the package importable on every executor.

    The zip goes through Spark's own file server, so nothing depends on a
    folder that the driver and the executors share. Done once a context. Rows
    here are whole texts or recordings, so where nobody has set the rows of an
    Arrow batch, 2,000 of them bound a worker's memory; a setting is kept.
    """
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, None) is None:
        spark.conf.set(rows, "2000")
    sc = spark.sparkContext
    if getattr(sc, "_tideline_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="tideline")) / "tideline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    sc.addPyFile(str(target))
    sc._tideline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, for tables written between steps.

    A cluster names it in spark.checkpoint.dir. Where driver and executors are
    one process (a local master) the driver's temporary folder will do.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = f"file://{os.path.join(tempfile.gettempdir(), 'tideline-shared')}"
    return at.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, lost executors cost nothing done before.

    What is written is removed when the driver's process ends.
    """
    import atexit

    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(at)
    atexit.register(_remove, spark, at)
    out = spark.read.schema(df.schema).parquet(at)
    out._tideline_at = at
    return out


def discard(df: DataFrame) -> None:
    """Remove a table made by written() that nothing reads any more."""
    _remove(df.sparkSession, df._tideline_at)


def _remove(spark: SparkSession, at: str) -> None:
    try:
        jvm, sc = spark._jvm, spark.sparkContext
        if sc._jsc is None:
            return
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the gateway may be gone at exit; the folder is scratch space
        return
