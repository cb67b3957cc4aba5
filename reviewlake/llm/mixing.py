"""Mixing of sources to target weights by Pareto order sampling.

Targets. Sources get shares of the whole size by weight. A source above its cap
(``cap`` times its own size) stops there and the excess is shared out anew,
until none is above; that is the same as one water level for all others.

Samples. Inside a source a document of ``w`` size bits is expected
``min(cap, level * w)`` times, where the level makes the expected size the
target: longer documents are somewhat more likely. The whole part is certain.
The fraction p is the inclusion probability of one more copy: documents are
ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)),
and the first ones are taken until the size that is still wanted is reached. As
targets are sizes, the sample's fixed size is counted in words; it ends at the
document that brings it nearest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.work import new_dir, written
from .base import BLANKS
from .running import running

SALTS = 64


def words(text: Column) -> Column:
    """Number of words of the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANKS}]+")), F.lit(0)).cast("bigint")


def _targets(sources: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """``sources`` (key columns, source_size) with ``target``."""
    ranked = running(
        sources.withColumn("_one", F.lit(1).cast("bigint")), [], ["_none", "_source"], {"_rank": "_one"}
    )
    weight = F.element_at(
        F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")
    )
    ranked = written(
        ranked.select("_none", "_source", "source_size", weight.cast("bigint").alias("_weight")),
        new_dir(sources.sparkSession, "sources"),
    )
    rest, shares = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    rest, shares, above = rest or 0, shares or 1, -1
    total = rest
    while True:
        share = F.col("_weight") * F.lit(float(rest)) / F.lit(float(shares))
        limit = (F.col("source_size") * cap).cast("double")
        over, size, weighed = ranked.where(limit < share).agg(
            F.count(F.lit(1)), F.sum("source_size"), F.sum("_weight")
        ).first()
        if over == above:
            return ranked.withColumn("target", F.when(limit < share, limit).otherwise(share))
        above = over
        rest = total - cap * (size or 0)
        shares = ranked.agg(F.sum("_weight")).first()[0] - (weighed or 0) if over else shares


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tag_col: str | None = None,
) -> DataFrame:
    """How often the mix takes each document.

    Returns id, source, size, source_size, target, copies, taken (copies * size).
    ``weights`` repeat over the sources in code point order; the null source comes
    last. Draws depend on ``seed`` and the id only, so reruns agree. A document
    without words (null, empty, blanks only) is never taken; a null id draws as the
    empty text; rows with one id draw alike and are told apart by their size. An
    empty table stays empty; extra columns are left out, but for ``tag_col``, which is
    given back as ``tag`` so that rows of one id can be told apart.
    """
    spark = docs.sparkSession
    # one pass over the texts; what follows moves a few numbers a row
    narrow = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
            words(F.col(text_col)).alias("size"), *([F.col(tag_col).alias("tag")] if tag_col else []),
        ).withColumns({
            "_none": F.col("source").isNull().cast("int"),
            "_source": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "_bits": F.length(F.bin("size")).cast("bigint"),
        }),
        new_dir(spark, "sizes"),
    )
    by = ["_none", "_source"]
    classes = narrow.groupBy(*by, "_bits").agg(F.sum("size").alias("_words"))
    targets = _targets(classes.groupBy(*by).agg(F.sum("_words").alias("source_size")), weights, cap)

    # the level of each source: documents of the first (longest) classes may be at the cap
    down = Window.partitionBy(*by).orderBy(F.desc("_bits"))
    up_to = down.rowsBetween(Window.unboundedPreceding, -1)
    onward = down.rowsBetween(0, Window.unboundedFollowing)
    filled = classes.where("_words > 0").join(targets, by)
    level = (
        F.col("target") - cap * F.coalesce(F.sum("_words").over(up_to), F.lit(0))
    ) / F.sum(F.col("_bits") * F.col("_words")).over(onward)
    levels = filled.withColumn("_level", level).groupBy(*by).agg(
        F.max_by(
            F.when(F.col("_level") * F.col("_bits") <= cap, F.col("_level")),
            F.when(F.col("_level") * F.col("_bits") <= cap, F.col("_bits")),
        ).alias("_level")
    ).select(*by, F.coalesce("_level", F.lit(float(cap))).alias("_level"))
    expected = F.least(F.lit(float(cap)), F.col("_level") * F.col("_bits"))
    certain = filled.join(levels, by).groupBy(*by).agg(
        F.sum(F.floor(expected) * F.col("_words")).alias("_certain")
    )
    plan = targets.join(levels, by, "left").join(certain, by, "left").select(
        *by, "source_size", "target", F.coalesce("_level", F.lit(0.0)).alias("_level"),
        (F.col("target") - F.coalesce("_certain", F.lit(0))).alias("_wanted"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )

    # a hot source is split by salt, so that no task meets all its documents
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")).cast("binary")), 1, 13)
    draw = (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(1 << 52))
    salted = narrow.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int"))
    rows = salted.join(plan, [*by, "_salt"]).withColumns({
        "_copies": F.when(F.col("size") > 0, F.floor(expected)).otherwise(0).cast("bigint"),
        "_chance": F.when(F.col("size") > 0, expected - F.floor(expected)).otherwise(0.0),
        "_draw": draw,
    })
    odds = (F.col("_draw") / (1 - F.col("_draw"))) / (F.col("_chance") / (1 - F.col("_chance")))
    rows = rows.withColumn(
        "_odds", F.when(F.col("_chance") > 0, odds).otherwise(F.lit(float("inf")))
    ).drop("_salt", "_level", "_bits", "_draw")
    ranked = running(rows, by, ["_odds", "doc_id", "size"], {"_before": "size"})
    one_more = (F.col("_chance") > 0) & (F.col("_before") + F.col("size") / 2 <= F.col("_wanted"))
    copies = F.col("_copies") + one_more.cast("bigint")
    return ranked.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"), *(["tag"] if tag_col else []),
    )
