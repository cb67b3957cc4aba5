"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.layout import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with heavy per-row text work ahead of it."""
    return spread(table(spark, sf_dir, name))


def pick(options: list[str], index: Column) -> Column:
    """The option at ``index`` modulo the number of options."""
    at = (index % len(options) + 1).cast("int")
    return F.element_at(F.array(*[F.lit(o) for o in options]), at)


def plant(text: Column, options: list[str], index: Column) -> Column:
    """``text`` with one of the options as its last lines."""
    return F.concat(text, F.lit("\n"), pick(options, index))


# --- the same in SQL ---------------------------------------------------------


def quote(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def sql_list(options: list[str]) -> str:
    return "[" + ", ".join(quote(o) for o in options) + "]"


def sql_pick(options: list[str], index: str) -> str:
    return f"({sql_list(options)})[CAST({index} % {len(options)} + 1 AS INTEGER)]"


def sql_plant(text: str, options: list[str], index: str) -> str:
    return f"({text} || chr(10) || {sql_pick(options, index)})"
