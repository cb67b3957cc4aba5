"""Records of quoted text over several lines, from files that are read in splits.

Whether a line begins inside quotes depends on all lines before it. But a line only maps
the two states to two states: it keeps them, swaps them, or ends in one whatever it
began in. Such maps combine, so states are carried over blocks of lines, and over blocks
of blocks, and no task has to read a file from its start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fixed, split_lines, strip
from ..plans.ordered import block, number_rows
from ..plans.work import new_dir, written

_INSIDE = r'[^"]*+(?:""[^"]*+)*+'
_AFTER = r'(?:[^",][^,]*+)?'  # what follows a closing quote, or a field without quotes
ENDS_INSIDE = rf'^(?:(?:"{_INSIDE}"{_AFTER}|{_AFTER}),)*+"{_INSIDE}$'
STAYS_INSIDE = rf"^{_INSIDE}$"
CLOSING = rf'^{_INSIDE}"{_AFTER},?'
BITS = 12
MOST_LINES = 10_000  # of one record


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, start, at, value``: the lines of text files, large ones read in splits; (start, at) orders those of a file."""
    rows = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"), F.posexplode(split_lines(F.col("value"))).alias("part", "value"),
    )
    return rows.select("file", "start", F.struct("row", "part").alias("at"), "value")


def _map(ends: Column) -> tuple[Column, Column]:
    """(constant, swap) of a line: the state it ends in whatever it began in, or null; and whether it swaps."""
    closed = F.when(ends.rlike(STAYS_INSIDE), True).otherwise(F.regexp_replace(ends, CLOSING, "").rlike(ENDS_INSIDE))
    opened = ends.rlike(ENDS_INSIDE)
    return F.when(opened == closed, opened.cast("int")), (opened & ~closed).cast("int")


def _composed(df: DataFrame, part: list[str], by: str) -> DataFrame:
    """Add ``_pc, _ps``: the map of all earlier rows of the part; ``_c, _s`` become that with the row itself."""
    upto = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    # swaps after the last constant count from it: both are counted from the part's start
    df = df.withColumn("_n", F.sum("_s").over(upto).cast("int"))
    df = df.withColumn("_k", F.when(F.col("_c").isNotNull(), (F.col("_c") + F.col("_n")) % 2))
    out = {}
    for name, window in (("", upto), ("p", before)):
        swaps = F.coalesce(F.sum("_s").over(window), F.lit(0)) % 2
        last = F.last("_k", ignorenulls=True).over(window)
        out[f"_{name}c2"], out[f"_{name}s2"] = ((last + swaps) % 2).cast("int"), swaps.cast("int")
    df = df.withColumns(out).drop("_c", "_s", "_n", "_k")
    return df.withColumnsRenamed({"_c2": "_c", "_s2": "_s", "_pc2": "_pc", "_ps2": "_ps"})


def _then(state: Column, c: str, s: str) -> Column:
    return F.coalesce(F.col(c), (state + F.col(s)) % 2)


def nonblank(lines: DataFrame, keys: list[str], order: list[str], line_col: str) -> DataFrame:
    """``keys``, ``at`` and the stripped ``_line``; the line stands fixed before the filter that names it."""
    slim = lines.select(*keys, F.struct(*order).alias("at"), F.col(line_col).alias("_raw"))
    return fixed(slim, _line=strip(F.col("_raw"))).drop("_raw").where(F.col("_line") != "")


def records(lines: DataFrame, keys: list[str], order: list[str], *, line_col: str = "value") -> DataFrame:
    """``keys``, ``at`` (a struct of ``order``) and ``line_col``: one row per record, its lines stripped and joined.

    Fields are quoted as in CSV: a quote at a field's start opens it, two inside stand for one, and
    a line that ends inside is continued by the next one that is not blank, with nothing between.
    Blank and null lines drop out. A file's last record may stay open. A record that would take
    more than 10,000 lines is none: its lines are then records by themselves, so that a lost quote
    does not swallow the rest of a file. Keys must not be null; rows of a key need an order
    of their own.
    """
    spark = lines.sparkSession
    slim = nonblank(lines, keys, order, line_col)
    c, s = _map(F.col("_line"))
    # positions have to be the same for all readers
    rows = written(
        number_rows(slim, keys, ["at"]).select(
            *keys, "at", "_line", c.alias("_c"), s.alias("_s"), "_pos", block(BITS).alias("_b1"), block(2 * BITS).alias("_b2")
        ),
        new_dir(spark, "lines"),
    )
    end = lambda df, part, by: df.groupBy(*part).agg(F.max_by("_c", by).alias("_c"), F.max_by("_s", by).alias("_s"))
    rows = _composed(rows, [*keys, "_b1"], "_pos")
    blocks = _composed(end(rows, [*keys, "_b2", "_b1"], "_pos"), [*keys, "_b2"], "_b1")
    supers = _composed(end(blocks, [*keys, "_b2"], "_b1"), keys, "_b2")
    outer = supers.select(*keys, "_b2", _then(F.lit(0), "_pc", "_ps").alias("_state"))
    starts = blocks.select(*keys, "_b2", "_b1", "_pc", "_ps").join(outer, [*keys, "_b2"]).select(
        *keys, "_b1", "_b2", _then(F.col("_state"), "_pc", "_ps").alias("_state")
    )
    rows = rows.join(starts.drop("_b2"), [*keys, "_b1"]).withColumn("_open", _then(F.col("_state"), "_pc", "_ps"))
    # a record is named by the place of its first line, which may lie in an earlier block
    first = F.when(F.col("_open") == 0, F.col("_pos"))
    heads = rows.groupBy(*keys, "_b2", "_b1").agg(F.max(first).alias("_h"))
    above = heads.groupBy(*keys, "_b2").agg(F.max("_h").alias("_h2"))
    earlier = lambda part, by: Window.partitionBy(*part).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    above = above.select(*keys, "_b2", F.max("_h2").over(earlier(keys, "_b2")).alias("_h2"))
    heads = heads.withColumn("_h", F.max("_h").over(earlier([*keys, "_b2"], "_b1"))).join(above, [*keys, "_b2"])
    heads = heads.select(*keys, "_b1", F.coalesce("_h", "_h2").alias("_h"))
    upto = Window.partitionBy(*keys, "_b1").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(heads, [*keys, "_b1"]).select(
        *keys, "at", "_line", "_pos", F.coalesce(F.max(first).over(upto), F.col("_h")).alias("_record")
    )
    # lines of too long records go by themselves; there cannot be more such records than lines by 10,000
    rows = written(rows, new_dir(spark, "named"))
    long = rows.groupBy(*keys, "_record").count().where(F.col("count") > MOST_LINES).select(*keys, "_record", F.lit(True).alias("_long"))
    rows = rows.join(long, [*keys, "_record"], "left")
    name = F.when(F.col("_long"), F.col("_pos")).otherwise(F.col("_record"))
    parts = rows.groupBy(*keys, name.alias("_record")).agg(F.array_sort(F.collect_list(F.struct("_pos", "at", "_line"))).alias("_parts"))
    return parts.select(
        *keys, F.col("_parts")[0]["at"].alias("at"), F.array_join(F.transform("_parts", lambda p: p["_line"]), "").alias(line_col)
    )
