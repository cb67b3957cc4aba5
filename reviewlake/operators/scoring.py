"""Severity counts, quality score, gates and rollups.

Scores are worked out in tenths, as integers, so grade edges are exact.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv

NAMED = ["CRITICAL", "HIGH", "MEDIUM"]
COUNTS = ["critical_defects", "high_defects", "medium_defects", "low_defects"]


def tenths(text: str) -> int:
    return int(Decimal(text) * 10)


def severity_counts(findings: DataFrame, *, key="payload_id") -> DataFrame:
    """Findings per severity; ``low_defects`` holds every other severity.

    ``low_shown`` counts LOW and AUDIT_NOTE only, as the printed summary does.
    """
    sev = F.upper(F.coalesce(F.col("severity"), F.lit("")))
    return findings.groupBy(key).agg(
        *[F.count_if(sev == s).alias(c) for s, c in zip(NAMED, COUNTS)],
        F.count_if(~sev.isin(NAMED)).alias("low_defects"),
        F.count_if(sev.isin("LOW", "AUDIT_NOTE")).alias("low_shown"),
    )


def rate(payloads: DataFrame, findings: DataFrame, *, key="payload_id") -> DataFrame:
    """Score, grade and verdict per payload; no findings is a full score."""
    counts = severity_counts(findings, key=key)
    joined = payloads.join(counts, key, "left").na.fill(0, [*COUNTS, "low_shown"])
    return add_rating(joined)


def add_rating(counted: DataFrame) -> DataFrame:
    weights = [tenths(fv.PENALTY[s]) for s in (*NAMED, "LOW")]
    penalty = sum((F.col(c) * w for c, w in zip(COUNTS, weights)), F.lit(0))
    scored = counted.withColumn("_p", penalty).withColumn(
        "_s", F.greatest(F.lit(10), F.least(F.lit(100), F.lit(100) - F.col("_p")))
    )
    return scored.select(
        *counted.columns,
        (F.col("_p") / 10).cast("double").alias("penalty_points"),
        (F.col("_s") / 10).cast("double").alias("score"),
        _graded(1).alias("grade"),
        _graded(2).alias("verdict"),
    )


def _graded(field: int) -> Column:
    chain = None
    for row in fv.GRADES:
        cond = F.col("_s") >= tenths(row[0])
        chain = F.when(cond, row[field]) if chain is None else chain.when(cond, row[field])
    return chain


def severity_rank(severity: Column) -> Column:
    chain = None
    for name, rank in fv.SEVERITY_RANK.items():
        cond = F.upper(severity) == name
        chain = F.when(cond, rank) if chain is None else chain.when(cond, rank)
    return chain.otherwise(fv.UNKNOWN_SEVERITY_RANK)


def filter_severity(findings: DataFrame, threshold: str = "medium") -> DataFrame:
    floor = fv.SEVERITY_RANK.get(threshold.upper(), fv.UNKNOWN_SEVERITY_RANK)
    return findings.where(severity_rank(F.coalesce("severity", F.lit("LOW"))) >= floor)


def gate(payloads: DataFrame, findings: DataFrame, *, key="payload_id", threshold="medium") -> DataFrame:
    """``blocked`` and exit code per payload: any finding at or above the threshold."""
    kept = filter_severity(findings, threshold).groupBy(key).agg(F.count(F.lit(1)).alias("n_kept"))
    return payloads.join(kept, key, "left").withColumn(
        "n_kept", F.coalesce("n_kept", F.lit(0).cast("bigint"))
    ).withColumn("blocked", F.col("n_kept") > 0).withColumn(
        "exit_code", F.when(F.col("blocked"), 1).otherwise(0)
    )


def rollup_reviews(files: DataFrame, *, key="review_id") -> DataFrame:
    """Sum latency and fired rules over the files of a review.

    The status is that of the last file that is not clean, not the worst one.
    """
    last = F.max(F.when(F.col("dlp_status") != "CLEAN", F.struct("file_no", "dlp_status")))
    return files.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum("n_findings").alias("n_findings"),
        F.round(F.sum("latency_ms"), 2).alias("latency_ms"),
        F.sum("rules_fired").alias("rules_fired"),
        F.coalesce(last["dlp_status"], F.lit("CLEAN")).alias("dlp_status"),
    )


def enrich_findings(findings: DataFrame, payloads: DataFrame, *, key="payload_id") -> DataFrame:
    """Put the payload's status and info types into ``audit_metadata``."""
    side = payloads.select(key, F.col("dlp_status").alias("_st"), F.col("info_types").alias("_ty"))
    return (
        findings.join(side, key)
        .withColumn(
            "audit_metadata",
            F.col("audit_metadata").withField("dlp_status", F.col("_st")).withField("redacted_entities", F.col("_ty")),
        )
        .drop("_st", "_ty")
    )
