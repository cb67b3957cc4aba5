"""Queries that run the streaming jobs over the driver tables as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.work import new_dir
from ..sources.events import parse_events
from ..streaming import jobs
from . import feedback as fb
from . import redaction as rd
from .base import ORACLES, query, plant, table


def stream(spark, sf_dir, name):
    """A table of the driver, one file or a folder of files, as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}[.]parquet")  # as a pattern; a path itself has to be a folder


def _feed(spark, sf_dir):
    return fb.valid_feed(stream(spark, sf_dir, "events"))


@query(
    "events_stream",
    f"""WITH v AS ({ORACLES['events_validate']})
    SELECT CASE WHEN reject_reason = '' THEN 'valid' ELSE reject_reason END AS outcome, event_type, count(*) AS n FROM v GROUP BY ALL""",
)
def events_stream(spark, sf_dir):
    lines = stream(spark, sf_dir, "events").withColumn("kind", F.expr(fb._KIND_SQL))
    parsed = parse_events(lines.select(F.expr(fb._JSON_SQL).alias("value")))
    at = new_dir(spark, "events-stream")
    jobs.route_events(parsed, f"{at}/valid", f"{at}/rejected", f"{at}/checkpoint").awaitTermination()
    good = jobs.read_batches(spark, f"{at}/valid").select(F.lit("valid").alias("outcome"), "event_type")
    bad = jobs.read_batches(spark, f"{at}/rejected").select(F.col("reject_reason").alias("outcome"), "event_type")
    both = good.unionByName(bad).withColumn("event_type", F.coalesce("event_type", F.lit("")))
    return both.groupBy("outcome", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "weight_fold_stream",
    f"""WITH {fb._FOLDED_SQL}, {fb._UNKNOWN_SQL} SELECT rule_id, w AS current_weight, true AS known FROM folded
    UNION ALL SELECT rule_id, weight, false FROM unknown""",
)
def weight_fold_stream(spark, sf_dir):
    at = new_dir(spark, "weights-stream")
    jobs.fold_weights(
        _feed(spark, sf_dir), fb.rules(spark, sf_dir), f"{at}/weights", f"{at}/checkpoint"
    ).awaitTermination()
    return jobs.latest_weights(spark, f"{at}/weights")


@query(
    "weight_state_stream",
    f"""WITH {fb._FOLDED_SQL}, {fb._UNKNOWN_SQL}, n AS (SELECT rule_id, count(*) AS n FROM feed GROUP BY rule_id)
    SELECT rule_id, w AS current_weight, true AS known, n AS n_events FROM folded JOIN n USING (rule_id)
    UNION ALL SELECT rule_id, weight, false, n FROM unknown JOIN n USING (rule_id)""",
)
def weight_state_stream(spark, sf_dir):
    at = new_dir(spark, "states-stream")
    states = jobs.weight_states(_feed(spark, sf_dir), fb.rules(spark, sf_dir))
    jobs.write_batches(states, f"{at}/states", f"{at}/checkpoint", mode="update").awaitTermination()
    return jobs.latest_states(spark, f"{at}/states").drop("idle")


@query(
    "event_counts_stream",
    f"""WITH {fb.FEED_SQL}
    SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM feed GROUP BY 1, 2""",
)
def event_counts_stream(spark, sf_dir):
    at = new_dir(spark, "counts-stream")
    counts = jobs.event_counts(_feed(spark, sf_dir))
    jobs.write_batches(counts, f"{at}/counts", f"{at}/checkpoint", mode="update").awaitTermination()
    return jobs.latest_counts(spark, f"{at}/counts").withColumn(
        "window_start", F.col("window_start").cast("timestamp_ntz")
    )


@query("inspect_stream", ORACLES["inspect"])
def inspect_stream(spark, sf_dir):
    at = new_dir(spark, "inspect-stream")
    docs = stream(spark, sf_dir, "documents").select(
        "doc_id", plant(F.col("text"), rd.PAYLOADS, F.col("doc_id")).alias("text")
    )
    seen = jobs.inspect_payloads(docs).select(
        "doc_id", "dlp_status", F.col("n_redacted").cast("bigint").alias("n_redacted"),
        F.array_join("info_types", ",").alias("info_types"), "integrity_hash", "original_hash",
        F.coalesce("quarantine_reason", F.lit("")).alias("quarantine_reason"),
    )
    jobs.write_batches(seen, f"{at}/inspected", f"{at}/checkpoint").awaitTermination()
    return jobs.read_batches(spark, f"{at}/inspected")


@query(
    "sessions_stream",
    f"WITH {fb.SESSIONS_SQL} SELECT id, repo_name, pr_id, author_id, findings_count, dlp_status, created_at FROM sessions",
)
def sessions_stream(spark, sf_dir):
    at = new_dir(spark, "sessions-stream")
    rows = stream(spark, sf_dir, "events").selectExpr(*fb._split_columns(fb._SESSION_COLS))
    jobs.write_batches(rows, f"{at}/sessions", f"{at}/checkpoint", partition="repo_name").awaitTermination()
    return jobs.read_batches(spark, f"{at}/sessions").select(
        "id", "repo_name", "pr_id", "author_id", "findings_count", "dlp_status", "created_at"
    )
