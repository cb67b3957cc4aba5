"""The shared folder for intermediate tables and checkpoints, and the size of batches for Python workers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_made: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder the session names in ``spark.checkpoint.dir``.

    Only where none is named and all runs in one process, as in local tests, a folder
    is made: on a cluster every machine would write to a disk of its own.
    """
    global _made
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        _made = _made or tempfile.mkdtemp(prefix="reviewlake-")
        named = _made
    return named


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stable(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, so that all its readers see the same rows."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to ``path`` and read back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lean_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python workers a thousand rows at a time, unless the session says how many.

    Spark's own 10,000 rows of a few kilobytes, several times in flight, are most of what a
    worker and the buffers beside it hold.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
