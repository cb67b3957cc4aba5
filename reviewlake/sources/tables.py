"""Stored tables: append, upsert, seed, evolve, look up.

There is no table format here, so an upsert returns the new table for the
caller to write to a new path; a path is never read and written at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv


def split_duplicates(stored: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows to append, rows whose key is stored already)."""
    have = stored.select(key)
    return new.join(have, key, "left_anti"), new.join(have, key, "left_semi")


def append_sessions(new: DataFrame, path: str, *, key="id", partition="repo_name") -> None:
    """Append to the audit table; a key that is there already is an error.

    The check also covers keys that repeat within ``new``.
    """
    spark = new.sparkSession
    if new.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError(f"duplicate {key} in the new rows")
    if table_exists(spark, path):
        _, clash = split_duplicates(spark.read.parquet(path), new, key)
        if clash.limit(1).count():
            raise ValueError(f"duplicate {key}: already stored in {path}")
    new.write.mode("append").partitionBy(partition).parquet(path)


def table_exists(spark, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def upsert(target: DataFrame, updates: DataFrame, key: str, changed: list[str], *, order: str) -> DataFrame:
    """Insert new keys; on known keys only the ``changed`` columns move.

    The last update of a key wins. It is picked by an aggregate, which combines
    map-side, so a key with very many updates does not meet in one task.
    """
    cols = [c for c in target.columns if c != key]
    values = F.struct(*[F.col(c) for c in cols])
    last = updates.groupBy(key).agg(F.max_by(values, F.col(order)).alias("_u"))
    known = F.col("_t").isNotNull()
    old = target.select(key, F.struct(*cols).alias("_t"))
    picked = []
    for c in cols:
        new, was = F.col("_u")[c], F.col("_t")[c]
        keep_old = known & (F.col("_u").isNull() | F.lit(c not in changed))
        picked.append(F.when(keep_old, was).otherwise(new).alias(c))
    return old.join(last, key, "full_outer").select(key, *picked)


def upsert_rules(target: DataFrame, updates: DataFrame, *, order: str) -> DataFrame:
    """Name, weight and time follow the update; base weight and counters stay."""
    target = _with(target, last_updated="timestamp")
    full = updates.select(
        order, "rule_id", "rule_name", F.col("current_weight").alias("base_weight"), "current_weight",
        F.lit(0.0).alias("ci_flakiness_correlation"), F.lit(0).cast("bigint").alias("revert_count"),
        "last_updated",
    )
    return upsert(target, full, "rule_id", ["rule_name", "current_weight", "last_updated"], order=order)


def upsert_incidents(target: DataFrame, updates: DataFrame, *, order: str) -> DataFrame:
    """On a known id only description and embedding change."""
    return upsert(target, updates, "id", ["description", "embedding"], order=order)


def seed_if_empty(target: DataFrame, defaults: DataFrame) -> DataFrame:
    """``target``, or the defaults when it has no row (one row is looked for)."""
    return defaults.select(*target.columns) if target.isEmpty() else target


def evolve_sessions(*parts: DataFrame) -> DataFrame:
    """Union of old and new session rows; missing columns take their defaults."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    defaults = {
        "quality_score": fv.DEFAULT_SCORE, "user_id": fv.DEFAULT_USER, "language": fv.DEFAULT_LANGUAGE,
    }
    for name, value in defaults.items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def lookup(df: DataFrame, key: str, values: list) -> DataFrame:
    return df.where(F.col(key).isin(values))


def _with(df: DataFrame, **columns: str) -> DataFrame:
    for name, kind in columns.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df
