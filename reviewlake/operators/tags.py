"""Keyword risk tags on sanitized payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import all_of, contains_any, fixed

_FINDING = "struct<category:string,severity:string,summary:string>"


def _hit(low: Column, tag) -> Column:
    _, _, _, groups, absent = tag
    conds = [contains_any(low, g) for g in groups] + [~low.contains(w) for w in absent]
    return all_of(conds)


def _cell(tag) -> Column:
    category, severity, summary = tag[:3]
    return F.struct(
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), F.lit(summary).alias("summary")
    )


def tag_risks(payloads: DataFrame, *, key="payload_id", text_col="sanitized", findings: DataFrame | None = None, tags=None) -> DataFrame:
    """One row per payload and risk whose words occur.

    A category that the payload's findings have already is not raised again. The
    SQL injection tag only looks at summaries, so it may stand next to a finding
    of its own category.
    """
    tags = fv.RISK_TAGS if tags is None else tags
    low = fixed(payloads.select(key, text_col), _low=F.lower(F.coalesce(F.col(text_col), F.lit(""))))
    cells = [F.when(_hit(F.col("_low"), t), _cell(t)) for t in [*tags, fv.SQL_INJECTION_TAG]]
    rows = fixed(low, _cells=F.array_compact(F.array(*cells))).select(key, "_cells").where(F.size("_cells") > 0)
    if findings is None:
        return rows.select(key, F.inline("_cells"))
    # one row a payload: the few categories it has, and whether a summary names the injection
    have = findings.groupBy(key).agg(
        F.collect_set("category").alias("_have"),
        F.bool_or(F.col("summary").contains(fv.SQL_INJECTION_WORDS)).alias("_sql"),
    )
    joined = rows.join(have, key, "left")
    categories = F.coalesce("_have", F.array().cast("array<string>"))
    fresh = F.filter(
        "_cells",
        lambda c: F.when(c["summary"] == fv.SQL_INJECTION_TAG[2], ~F.coalesce("_sql", F.lit(False)))
        .otherwise(~F.array_contains(categories, c["category"])),
    )
    return joined.select(key, F.inline(fresh))


def scan_to_findings(findings: DataFrame, *, key="file_id", path: Column | None = None) -> DataFrame:
    """Rule findings as finding records; unknown categories become AST_SYNTAX."""
    cat = F.coalesce("category", F.lit("AST_SYNTAX"))
    return findings.select(
        key,
        F.coalesce("severity", F.lit("HIGH")).alias("severity"),
        F.when(cat.isin(fv.CATEGORIES), cat).otherwise("AST_SYNTAX").alias("category"),
        F.coalesce(path if path is not None else F.lit(None), F.lit("app/main.py")).alias("file_path"),
        F.array(F.col("line_start"), F.col("line_start") + 2).alias("line_range"),
        F.coalesce("message", F.lit("Syntax issue detected")).alias("summary"),
        F.concat(
            F.lit("Deterministic FinTech violation identified under rule "), "rule_id",
            F.lit(". Causal analysis: code violates transactional soundness in financial execution path."),
        ).alias("detailed_analysis"),
    )
