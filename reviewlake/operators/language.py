"""Language tagging and guideline lookup."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import all_of, any_of


def language_of(code: Column, path: Column | None = None) -> Column:
    """By extension, then by content, else the default language."""
    chain = None

    def add(cond, value):
        nonlocal chain
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)

    if path is not None:
        lower = F.lower(path)
        for lang, endings in fv.LANGUAGE_EXTENSIONS:
            add(any_of([lower.endswith(e) for e in endings]), F.lit(lang))
    for lang, patterns, need_all in fv.LANGUAGE_CONTENT:
        tests = [code.rlike(p) for p in patterns]
        add(all_of(tests) if need_all else any_of(tests), F.lit(lang))
    return chain.otherwise(F.lit(fv.DEFAULT_LANGUAGE))


def is_python_path(path: Column) -> Column:
    """``.py``, or a base name without a dot."""
    return path.endswith(".py") | ~F.element_at(F.split(path, "/", -1), -1).contains(".")


def guidelines(spark: SparkSession, rows=None) -> DataFrame:
    """The lookup as a table of values; tasks need no Python to read it."""
    names = ["language", "best_practices", "anti_patterns", "note"]
    kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string()]
    columns = list(zip(*(fv.GUIDELINES if rows is None else rows))) or [[]] * len(names)
    return spark.createDataFrame(pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names))


def attach_guidelines(df: DataFrame, table: DataFrame | None = None, *, lang_col="language"):
    """Left join on the trimmed lower-case language; unknown takes the default row.

    Only the built-in table, a row per language, is sent to all tasks by hint.
    """
    table = F.broadcast(guidelines(df.sparkSession)) if table is None else table
    names = [r[0] for r in fv.GUIDELINES]
    key = F.lower(F.trim(F.col(lang_col)))
    keyed = df.withColumn(
        "_lang", F.when(key.isin(names), key).otherwise(F.lit(fv.DEFAULT_LANGUAGE))
    )
    right = table.withColumnRenamed("language", "_lang")
    return keyed.join(right, "_lang", "left").drop("_lang")
