"""Feedback events as JSON, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv

EVENT_SCHEMA = (
    "id string, event_type string, repo_name string, commit_sha string, rule_id string, "
    "pr_id string, details map<string,string>, timestamp timestamp, _bad string"
)


def reject_reason(rule_id, event_type, bad):
    """Why an event is no valid one; NULL if it is."""
    return (
        F.when(bad, "unreadable")
        .when(rule_id.isNull() | event_type.isNull(), "missing field")
        .when(~event_type.isin(list(fv.EVENT_FACTORS)), "unknown event type")
    )


def parse_events(lines: DataFrame, *, value_col="value", arrived=None, place=None) -> DataFrame:
    """Typed events with defaults; ``reject_reason`` is NULL for the valid ones.

    An event without an id is an event of its own. In a batch it is named by its ``place``
    in the input (a column; by default the number of its row) and its text, so that a task
    that is run again, or a second reader of the same input, gives the same name; rows of a
    stream have no number, there it gets a random one. One without a time gets that of its arrival (``arrived``, a column or literal; by default the
    time of the query or micro-batch). Works on batch and streaming input.
    """
    arrived = F.current_timestamp() if arrived is None else arrived
    if lines.isStreaming:
        made = F.expr("uuid()")
    else:
        made = F.md5(F.concat_ws(":", F.monotonically_increasing_id() if place is None else place, F.col(value_col)))
    value = F.col(value_col)
    parsed = F.from_json(
        value, EVENT_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    )
    e = F.col("_e")
    kept = [c for c in lines.columns if c != value_col]
    return lines.withColumn("_e", parsed).select(
        *kept,
        F.coalesce(e["id"], F.concat(F.lit("EVT-"), F.upper(made))).alias("id"),
        e["event_type"].alias("event_type"),
        F.coalesce(e["repo_name"], F.lit(fv.EVENT_DEFAULT_REPO)).alias("repo_name"),
        F.coalesce(e["commit_sha"], F.lit(fv.EVENT_DEFAULT_SHA)).alias("commit_sha"),
        e["rule_id"].alias("rule_id"),
        e["pr_id"].alias("pr_id"),
        F.coalesce(e["details"], F.create_map().cast("map<string,string>")).alias("details"),
        F.coalesce(e["timestamp"], arrived).alias("ts"),
        reject_reason(e["rule_id"], e["event_type"], e["_bad"].isNotNull()).alias("reject_reason"),
    )


def split_events(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected)."""
    ok = F.col("reject_reason").isNull()
    return parsed.where(ok).drop("reject_reason"), parsed.where(~ok)


def _placed(lines: DataFrame) -> DataFrame:
    """Lines of text files with their place: the file, the split and the row in it."""
    at = F.concat_ws(":", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return lines.select("value", at.alias("_place"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(_placed(spark.read.text(path)), place=F.col("_place")).drop("_place")


def read_event_stream(spark: SparkSession, path: str, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_events(reader.load(path))
