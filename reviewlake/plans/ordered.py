"""Ordered work per key that does not need one task per key.

Rows are range-partitioned by (key, order), so a hot key spreads over many
tasks. Inside the partitions they are numbered, and the numbers cut every key
into blocks of bounded size. Blocks are combined level by level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .work import stable


def number_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Add ``_pos``: increasing in (keys, order), with gaps between partitions."""
    sort = [*keys, *order]
    return (
        df.repartitionByRange(*[F.col(c) for c in sort])
        .sortWithinPartitions(*sort)
        .withColumn("_pos", F.monotonically_increasing_id())
    )


def block(bits: int) -> Column:
    """Id of the block of 2**bits neighbouring numbers that ``_pos`` falls in."""
    return F.shiftright("_pos", bits)


def positions(df: DataFrame, keys: list[str], order: list[str], name: str = "seq") -> DataFrame:
    """Number the rows of every key 1, 2, 3, ... in ``order``.

    Row counts of blocks (4096 rows) and super-blocks (4096 blocks) are summed
    up to offsets. Each window runs over the blocks of one super-block or the
    super-blocks of one key, never over the rows of a key.
    """
    numbered = stable(
        number_rows(df, keys, order).withColumn("_b1", block(12)).withColumn("_b2", block(24))
    )
    blocks = numbered.groupBy(*keys, "_b2", "_b1").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_from")
    )
    supers = blocks.groupBy(*keys, "_b2").agg(F.sum("_n").alias("_n2"))
    up_to = lambda part, by: (
        Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("bigint")
    supers = supers.withColumn("_before2", F.coalesce(F.sum("_n2").over(up_to(keys, "_b2")), zero))
    blocks = blocks.withColumn(
        "_before1", F.coalesce(F.sum("_n").over(up_to([*keys, "_b2"], "_b1")), zero)
    )
    offsets = blocks.join(supers, [*keys, "_b2"]).select(
        *keys, "_b1", (F.col("_before1") + F.col("_before2") - F.col("_from")).alias("_shift")
    )
    return (
        numbered.join(offsets, [*keys, "_b1"])
        .withColumn(name, F.col("_pos") + F.col("_shift") + 1)
        .drop("_b1", "_b2", "_pos", "_shift")
    )
