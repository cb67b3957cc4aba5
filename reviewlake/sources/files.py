"""Source files as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.work import written


def decode_source(content: Column) -> Column:
    """UTF-8 where the bytes are valid UTF-8, else Latin-1, which reads any bytes."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def scan_sources(
    spark: SparkSession, path: str, *, glob: str | None = None, max_bytes: int = 64 << 20, work_path: str | None = None
) -> DataFrame:
    """(path, bytes, source, error): a row for every file below ``path`` that is not empty, also for one that cannot be read.

    Files are listed by themselves and held against what was read: one that is gone, broken or
    refused by then gets an error and no source, and so does one beyond ``max_bytes``, which is
    not read at all. With ``work_path`` the sources are written there, and read from
    there; without it looking for what is missing reads the files once more.
    """
    def reader() -> DataFrame:
        r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        r = r.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
        return (r.option("pathGlobFilter", glob) if glob else r).load(path)

    listed = reader().select("path", F.col("length").alias("bytes"))
    found = reader().where(F.col("length") <= max_bytes).select(
        "path", F.length("content").cast("bigint").alias("bytes"), decode_source(F.col("content")).alias("source")
    )
    if work_path is not None:
        found = written(found, work_path)
    # a path counts as read only where its bytes were
    seen = found.where(F.col("bytes") >= 0).select("path")
    lost = listed.join(seen, "path", "left_anti").select(
        "path", "bytes", F.lit(None).cast("string").alias("source"),
        F.when(F.col("bytes") > max_bytes, F.concat(F.lit("larger than "), F.lit(max_bytes), F.lit(" bytes"))).otherwise("unreadable").alias("error"),
    )
    return found.withColumn("error", F.lit(None).cast("string")).unionByName(lost)
