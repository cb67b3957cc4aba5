"""How rows are laid out over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core when a small input arrives in fewer partitions than that.

    A large table already has many more scan splits than cores; it is returned
    as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle by the keys for heavy work behind the shuffle.

    A shuffle that is not told its number of partitions is put together to a few by their
    bytes, which leaves cores idle where a row of few bytes takes long.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)
