"""Connected components of a table of links, by alternating stars.

Every round ties the larger neighbours of a node to its smallest one, then the
smaller ones, until nothing changes; what is left are stars around the smallest
node of each component. Rounds are written to the shared folder, so a lost
executor costs one round at most. Nothing but two numbers reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.work import new_dir, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("low"))
    low = low.select("a", F.least("a", "low").alias("low"))
    return (
        both.where("b > a").join(low, "a")
        .select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("low"))
    ties = down.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return ties.union(low.select("a", F.col("low").alias("b"))).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node with a link; the component is its smallest node.

    Links to oneself and with a null end count for nothing; repeated links do no harm.
    """
    spark = links.sparkSession
    edges = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct()
    edges = written(edges, new_dir(spark, "links"))
    seen = None
    while True:
        edges = written(_small_star(_large_star(edges)), new_dir(spark, "links"))
        now = edges.agg(
            F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))
        ).first()
        if now == seen or not now[0]:
            break
        seen = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
