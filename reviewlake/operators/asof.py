"""As-of join: the last row of the other side at or before a row's time.

Both sides are put into one order by key and time and cut into blocks. Inside a block
a window carries the last value on; what a block starts with comes from the last values
of the blocks before it, which are themselves carried on in blocks. No task ever holds
all rows of a key, however many there are, and no pair of rows is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ordered import block, number_rows
from ..plans.work import stable

BITS = 12


def asof_join(
    left: DataFrame, right: DataFrame, keys: list[str], *, left_time: str, right_time: str, values: list[str], order: list[str] = ()
) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of its key whose time is not later.

    Of rows of ``right`` at the same time the last by ``order`` counts (nulls first). A row
    without an earlier one, or with a null key or time, gets nulls; so does every row if
    ``right`` is empty. Rows of ``left`` may repeat.
    """
    k, o = [f"_k{i}" for i in range(len(keys))], [f"_o{i}" for i in range(len(order))]
    kinds = {c: t for c, t in right.dtypes}
    a = left.select(
        *[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(left_time).alias("_t"), F.lit(1).alias("_side"),
        *[F.lit(None).cast(kinds[c]).alias(n) for c, n in zip(order, o)], F.struct(*left.columns).alias("_row"),
        F.lit(None).cast(_struct(right, values)).alias("_value"),
    )
    b = right.select(
        *[F.col(c).alias(n) for c, n in zip(keys, k)], F.col(right_time).alias("_t"), F.lit(0).alias("_side"),
        *[F.col(c).alias(n) for c, n in zip(order, o)], F.lit(None).cast(_struct(left, left.columns)).alias("_row"),
        F.struct(*values).alias("_value"),
    )
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [*k, "_t"])
    rows = a.where(whole).unionByName(b.where(whole))
    # rows of one key and time may be many: their hash parts them
    rows = rows.withColumn("_spread", F.when(F.col("_side") == 1, F.xxhash64("_row")))
    numbered = stable(
        number_rows(rows, k, ["_t", "_side", *o, "_spread"]).select(
            *k, "_row", "_value", "_pos", block(BITS).alias("_b1"), block(2 * BITS).alias("_b2")
        )
    )
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col("_pos")))
    blocks = numbered.groupBy(*k, "_b2", "_b1").agg(last.alias("_v1"))
    supers = blocks.groupBy(*k, "_b2").agg(F.max_by("_v1", F.when(F.col("_v1").isNotNull(), F.col("_b1"))).alias("_v2"))

    def before(part: list[str], by: str, column: str):
        w = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
        return F.last(column, ignorenulls=True).over(w)

    supers = supers.select(*k, "_b2", before(k, "_b2", "_v2").alias("_from2"))
    blocks = blocks.select(*k, "_b2", "_b1", before([*k, "_b2"], "_b1", "_v1").alias("_from1"))
    starts = blocks.join(supers, [*k, "_b2"]).select(*k, "_b1", F.coalesce("_from1", "_from2").alias("_from"))
    upto = Window.partitionBy(*k, "_b1").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    found = (
        numbered.join(starts, [*k, "_b1"])
        .withColumn("_found", F.coalesce(F.last("_value", ignorenulls=True).over(upto), F.col("_from")))
        .where(F.col("_row").isNotNull())
    )
    out = [F.col("_found")[c].alias(c) for c in values]
    odd = left.where(" OR ".join(f"`{c}` IS NULL" for c in [*keys, left_time]))
    none = [F.lit(None).cast(kinds[c]).alias(c) for c in values]
    return found.select("_row.*", *out).unionByName(odd.select(*left.columns, *none))


def _struct(df: DataFrame, columns: list[str]) -> str:
    """The type of a struct of these columns."""
    return df.select(F.struct(*columns).alias("s")).schema["s"].dataType.simpleString()
