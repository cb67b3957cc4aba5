"""Joins of rows with one line a group, where a few groups hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_GROUPS = 20_000


def of_group(rows: DataFrame, groups: DataFrame, keys: list[str], count_col: str, least: int = 10_000) -> DataFrame:
    """``rows`` with the line of their group; keys must not be null.

    Groups of more rows than a threshold are sent to the tasks; the threshold is ``least``, or
    as much more as it takes that there cannot be more than 20,000 such groups. All other
    groups are joined by a shuffle, in which none is large.
    """
    total = groups.agg(F.sum(count_col)).first()[0] or 0
    hot = F.col(count_col) > max(least, total // HOT_GROUPS)
    large = groups.where(hot)
    few = rows.join(F.broadcast(large), keys)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti")
    return few.unionByName(rest.join(groups.where(~hot), keys))
