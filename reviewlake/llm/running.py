"""Running sums in a total order, without one task per key.

Rows are range-partitioned by key and order, so that a hot key spreads over
many tasks, and cut into blocks of at most 1024 neighbouring rows. Sums of
blocks, and of blocks of blocks, are carried on; a window never holds more rows
than one block, or more block sums than one block of blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import block, number_rows
from ..plans.work import new_dir, written


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str]) -> DataFrame:
    """Add, for every ``name: column``, the column's sum over the earlier rows of the key.

    ``order`` should be total up to rows that are alike. Keys must not be null.
    An empty table stays empty.
    """
    spark = df.sparkSession
    numbered = written(
        number_rows(df, keys, order).withColumns({"_b1": block(10), "_b2": block(20)}),
        new_dir(spark, "running"),
    )

    def before(part: list[str], by: str, column: str):
        window = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(column).over(window), F.lit(0).cast("bigint"))

    blocks = numbered.groupBy(*keys, "_b2", "_b1").agg(
        *[F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    )
    supers = blocks.groupBy(*keys, "_b2").agg(*[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    supers = supers.select(
        *keys, "_b2", *[before(keys, "_b2", f"_t_{n}").alias(f"_u_{n}") for n in sums]
    )
    blocks = blocks.select(
        *keys, "_b2", "_b1",
        *[before([*keys, "_b2"], "_b1", f"_s_{n}").alias(f"_v_{n}") for n in sums],
    )
    offsets = blocks.join(supers, [*keys, "_b2"]).select(
        *keys, "_b1", *[(F.col(f"_u_{n}") + F.col(f"_v_{n}")).alias(f"_o_{n}") for n in sums]
    )
    own = [*keys, "_b1"]
    return (
        numbered.join(offsets, own)
        .withColumns({n: F.col(f"_o_{n}") + before(own, "_pos", c) for n, c in sums.items()})
        .select(*df.columns, *sums)
    )
