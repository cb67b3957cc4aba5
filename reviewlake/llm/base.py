"""Registry of this subpackage's queries, and small shared helpers."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.work import lean_batches  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The characters that separate words, as the inside of a character class.
BLANKS = r"\x20\x09-\x0D"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def utf8(text: Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def ship(spark: SparkSession, name: str, content: bytes) -> str:
    """Hand a file to every executor, also to those that come later; its name for ``mapped_path``.

    Spark copies the file into the working folder of each executor, where tasks
    can map it into memory.
    """
    root = os.path.join(SparkFiles.getRootDirectory(), "made")
    os.makedirs(root, exist_ok=True)
    name = f"{name}-{hashlib.sha256(content).hexdigest()[:16]}"
    path = os.path.join(root, name)
    if not os.path.exists(path):
        with open(path + ".part", "wb") as out:
            out.write(content)
        os.replace(path + ".part", path)
    spark.sparkContext.addFile(path)
    return name


def shipped_path(name: str) -> str:
    return SparkFiles.get(name)


def small_side(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """``df`` for the narrow side of a join: broadcast if its values are counted to be small.

    Beyond ``max_bytes`` it is returned as it is, and Spark shuffles both sides. A row
    counts with 64 bytes and the length of its values written out.
    """
    size = F.sum(F.length(F.to_json(F.struct("*"))) + 64)
    return F.broadcast(df) if (df.agg(size).first()[0] or 0) <= max_bytes else df


def most_frequent(df: DataFrame, count_col: str, n: int) -> DataFrame:
    """The rows of largest count, about ``n`` of them and never more, without sorting any.

    Counts are put into steps of a sixteenth of a doubling; one number a step reaches the
    driver, and the last step that would go beyond ``n`` is left out as a whole. (Asking
    for the first n rows in order makes every task send n rows of its own.)
    """
    step = F.floor(F.log2(F.col(count_col).cast("double")) * 16).cast("int")
    sizes = sorted(((r[0], r[1]) for r in df.where(F.col(count_col) > 0).groupBy(step).count().collect()), reverse=True)
    least, taken = None, 0
    for at, size in sizes:
        taken += size
        if taken > n:
            break
        least = at
    return df.limit(0) if least is None else df.where((F.col(count_col) > 0) & (step >= least))
