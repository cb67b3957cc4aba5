"""The whole review of a table of payloads as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import diffs, redact, retrieval, rules, scoring
from ..operators.language import language_of
from .work import written


@dataclass
class Review:
    """Lazy results of a review; nothing runs before one of them is read."""

    inspected: DataFrame
    findings: DataFrame
    ratings: DataFrame
    sessions: DataFrame
    precedents: DataFrame | None = None
    elevated: DataFrame | None = None


def review(
    payloads: DataFrame, *, incidents: DataFrame | None = None, work_path: str | None = None
) -> Review:
    """Inspect, tag, scan, rate and log payloads.

    Needs ``payload_id``, ``diff``, ``repo_name``, ``commit_sha``, ``author_id``,
    ``user_id``, ``language`` (NULL or empty: detected) and ``created_at``. Only
    accepted Python payloads are scanned; a rejected one keeps an empty finding
    list and so the full score.

    The inspected payloads feed the scan, the retrieval and the sessions. With
    ``work_path`` they, and beside them the findings, are written there once and read
    back; without it Spark inspects them again for each of these that is read.
    """
    seen = redact.inspect(payloads, text_col="diff")
    given = F.nullif(F.col("language"), F.lit(""))
    seen = seen.withColumn("language", F.coalesce(given, language_of(F.col("diff"))))
    if work_path is not None:
        seen = written(seen, work_path)
    accepted, _ = redact.split_quarantined(seen)
    python = accepted.where(F.col("language") == "python").select(
        F.col("payload_id").alias("file_id"), F.col("sanitized").alias("diff")
    )
    source = diffs.to_source(python).where(~F.col("is_empty")).select("file_id", "source")
    found = rules.find(source).withColumnRenamed("file_id", "payload_id")
    if work_path is not None:
        found = written(found, f"{work_path}-findings")
    ratings = scoring.rate(seen.select("payload_id"), found)
    return Review(seen, found, ratings, session_rows(seen, ratings), *retrieve(accepted, incidents))


def session_rows(inspected: DataFrame, ratings: DataFrame) -> DataFrame:
    """Rows for the session table; how long a review took comes with the payload, if at all."""
    took = F.col("execution_duration_ms") if "execution_duration_ms" in inspected.columns else F.lit(None)
    n = sum((F.col(c) for c in scoring.COUNTS), F.lit(0))
    slim = inspected.select(
        "payload_id", "repo_name", "commit_sha", "author_id", "integrity_hash", "dlp_status", "user_id",
        "language", "created_at", took.cast("bigint").alias("execution_duration_ms"),
    )
    return slim.join(ratings, "payload_id").select(
        F.col("payload_id").alias("id"),
        "repo_name",
        F.substring("commit_sha", 1, 8).alias("pr_id"),
        "commit_sha",
        "author_id",
        F.col("integrity_hash").alias("payload_hash"),
        n.cast("int").alias("findings_count"),
        "dlp_status",
        F.col("score").alias("quality_score"),
        F.coalesce("user_id", F.lit(fv.DEFAULT_USER)).alias("user_id"),
        "language",
        "execution_duration_ms",
        "created_at",
    )


def retrieve(accepted: DataFrame, incidents: DataFrame | None):
    if incidents is None:
        return None, None
    queries = accepted.select(
        F.col("payload_id").alias("query_id"),
        retrieval.session_query_text(F.col("repo_name"), F.col("sanitized")).alias("text"),
    )
    corpus = incidents.select(F.col("id").alias("item_id"), F.col("embedding").alias("vec"))
    found = retrieval.topk_text(queries, corpus, min_sim=fv.SESSION_MIN_SIMILARITY)
    meta = incidents.withColumnRenamed("id", "item_id").drop("embedding")
    matched = found.join(meta, "item_id")
    return matched, retrieval.elevated_rules(matched)
