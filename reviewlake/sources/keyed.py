"""Tables stored in folders by the hash of their key.

A key's rows lie in one folder, sorted, with a bloom filter on the key in each file. So a
lookup opens the folders of its keys only, and in them skips what cannot hold the key; and
an upsert rewrites the folders that its updates touch and leaves all others as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .tables import upsert

FOLDERS = 64


def _folder(key: Column, folders: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(folders)).cast("int")


def _save(rows: DataFrame, path: str, key: str, mode: str) -> None:
    """Write rows that have their ``folder``; of the folders that are there only those of the rows are replaced."""
    writer = rows.repartition("folder").sortWithinPartitions("folder", key).write.mode(mode).partitionBy("folder")
    writer = writer.option("partitionOverwriteMode", "dynamic").option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.parquet(path)


def create(rows: DataFrame, path: str, key: str, *, folders: int = FOLDERS) -> None:
    """Store ``rows``; a table of 100 times the rows wants about as many times the folders."""
    _save(rows.withColumn("folder", _folder(F.col(key), folders)), path, key, "overwrite")


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _folders_of(spark: SparkSession, key_type: str, values: list, folders: int) -> list[int]:
    given = spark.createDataFrame([(v,) for v in values], f"k {key_type}")
    return sorted({r[0] for r in given.select(_folder(F.col("k"), folders)).collect()})


def lookup(spark: SparkSession, path: str, key: str, values: list, *, folders: int = FOLDERS) -> DataFrame:
    """The rows of a few keys; other folders are not opened."""
    rows = stored(spark, path)
    some = _folders_of(spark, dict(rows.dtypes)[key], values, folders)
    return rows.where(F.col("folder").isin(some) & F.col(key).isin(values)).drop("folder")


def upsert_stored(
    updates: DataFrame, path: str, key: str, changed: list[str], *, order: str, folders: int = FOLDERS
) -> list[int]:
    """Insert new keys and move the ``changed`` columns of known ones in a stored table; the folders that were rewritten.

    As ``tables.upsert``, folder by folder: the new rows of all touched folders are staged
    in the shared folder first and then take the place of the old ones, so that a run that
    breaks off can be run again, and one that is repeated changes nothing. Rows without a
    key are refused.
    """
    spark = updates.sparkSession
    if not updates.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"updates without {key}")
    target = stored(spark, path)
    columns = [c for c in target.columns if c != "folder"]
    placed = written(updates.withColumn("folder", _folder(F.col(key), folders)), new_dir(spark, "updates"))
    touched = sorted(r[0] for r in placed.select("folder").distinct().collect())
    old = target.where(F.col("folder").isin(touched)).select(*columns)
    new = upsert(old, placed.drop("folder"), key, changed, order=order).select(*columns)
    staged = written(new.withColumn("folder", _folder(F.col(key), folders)), new_dir(spark, "staged"))
    if touched:
        _save(staged, path, key, "overwrite")
    return touched
