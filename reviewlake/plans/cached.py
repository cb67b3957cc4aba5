"""Reviews that look up what was reviewed before.

Results are stored per review key, which is the hash of a payload's text and given
language, and per version of the rules. Only payloads whose key has no result of that
version are reviewed, one of each key; the others take the stored result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import redact, scoring
from ..sources.tables import table_exists
from .review import Review, retrieve, review, session_rows
from .work import new_dir, written

RESULT = ["language", "sanitized", "dlp_status", "n_redacted", "info_types", "integrity_hash", "original_hash", "quarantine_reason"]
SMALL_KEYS = 1_000_000  # keys of 64 characters that are sent to the tasks; more are joined by a shuffle


def review_key(diff: Column, language: Column) -> Column:
    """Hash of all that a result depends on; a missing text has a key of its own."""
    return F.sha2(F.concat_ws("\n", F.coalesce(language, F.lit("")), F.when(diff.isNull(), "-").otherwise(F.concat(F.lit("+"), diff))), 256)


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.limit(SMALL_KEYS + 1).count() <= SMALL_KEYS else keys


def review_cached(
    payloads: DataFrame, store: str, *, version: str, incidents: DataFrame | None = None, work_path: str | None = None
) -> Review:
    """``review`` with the results kept in ``store``; its rows are those of a full run.

    New results are appended to the store before the review is given back, so that the next
    run finds them. A new ``version`` of the rules reviews everything anew. Payloads that
    repeat a text are reviewed once. What does not depend on text and language (ids, repository, users,
    times) always comes from the payload itself.
    """
    spark = payloads.sparkSession
    given = F.nullif(F.col("language"), F.lit(""))
    keyed = written(
        payloads.withColumn("review_key", review_key(F.col("diff"), given)), work_path or new_dir(spark, "keyed")
    )
    todo = keyed
    if table_exists(spark, store):
        have = spark.read.parquet(store).where(F.col("version") == version).select("review_key")
        todo = keyed.join(_few(have), "review_key", "left_anti")
    # a text that comes very often meets itself in map tasks first
    todo = todo.groupBy("review_key").agg(F.first("diff").alias("diff"), F.first("language").alias("language"))
    names = ["repo_name", "commit_sha", "author_id", "user_id"]
    fresh = review(
        todo.select(
            F.col("review_key").alias("payload_id"), "diff", "language", *[F.lit(None).cast("string").alias(c) for c in names],
            F.lit(None).cast("timestamp").alias("created_at"),
        ),
        work_path=new_dir(spark, "fresh"),
    )
    found = fresh.findings.groupBy("payload_id").agg(
        F.collect_list(F.struct(*[c for c in fresh.findings.columns if c != "payload_id"])).alias("findings")
    )
    rows = fresh.inspected.select("payload_id", *RESULT).join(found, "payload_id", "left")
    rows.withColumnRenamed("payload_id", "review_key").withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(store)
    return _from_store(keyed, spark.read.parquet(store).where(F.col("version") == version).drop("version"), incidents)


def _from_store(keyed: DataFrame, results: DataFrame, incidents: DataFrame | None) -> Review:
    meta = [c for c in keyed.columns if c not in ("diff", "language")]
    seen = keyed.select(*meta, "diff").join(results, "review_key").drop("review_key")
    found = seen.select("payload_id", F.inline("findings"))
    inspected = seen.drop("findings")
    ratings = scoring.rate(inspected.select("payload_id"), found)
    accepted, _ = redact.split_quarantined(inspected)
    return Review(inspected, found, ratings, session_rows(inspected, ratings), *retrieve(accepted, incidents))
