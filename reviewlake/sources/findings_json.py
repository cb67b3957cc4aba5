"""Findings out of free text that holds a JSON array."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import fixed, strip

FINDING_SCHEMA = (
    "id string, timestamp string, severity string, category string, file_path string, "
    "line_range array<int>, summary string, detailed_analysis string, "
    "historical_pr_evidence struct<pr_id:string,commit_sha:string,similarity_score:double,lesson_learned:string>, "
    "sandboxed_repro_script struct<runtime:string,test_framework:string,script_content:string,expected_failure:string>, "
    "suggested_patch struct<diff:string,explanation:string,automated_verification_status:string>, "
    "audit_metadata struct<dlp_status:string,redacted_entities:array<string>,token_cost_usd:double,latency_ms:double>, "
    "_bad string"
)
REQUIRED = ["file_path", "summary", "detailed_analysis"]
REQUIRED_INSIDE = {
    "historical_pr_evidence": ["pr_id", "commit_sha", "similarity_score", "lesson_learned"],
    "sandboxed_repro_script": ["script_content", "expected_failure"],
    "suggested_patch": ["diff", "explanation"],
}
_JSON_FENCE = r"(?s)```json\s*(.*?)\s*```"
_ANY_FENCE = r"(?s)```\s*(.*?)\s*```"


def array_text(text: Column) -> Column:
    """The fenced body when there is one, from its first [ to its last ]."""
    body = (
        F.when(text.rlike(_JSON_FENCE), F.regexp_extract(text, _JSON_FENCE, 1))
        .when(text.contains("```json"), text)
        .when(text.rlike(_ANY_FENCE), F.regexp_extract(text, _ANY_FENCE, 1))
        .otherwise(text)
    )
    return F.coalesce(
        F.nullif(F.regexp_extract(body, r"(?s)(\[.*\])", 1), F.lit("")), strip(body)
    )


def extract_findings(df: DataFrame, *, text_col="text") -> DataFrame:
    """One row per valid finding, with ``item_no``.

    Items are read one by one, so a bad one does not take the others with it; a
    text that holds no readable array gives no rows.
    """
    kept = [c for c in df.columns if c != text_col]
    body = fixed(df, _body=array_text(strip(F.col(text_col))))
    items = body.select(
        *kept, F.posexplode(F.from_json("_body", "array<string>")).alias("item_no", "_item")
    )
    parsed = fixed(
        items, _f=F.from_json("_item", FINDING_SCHEMA, {"columnNameOfCorruptRecord": "_bad"})
    )
    f = F.col("_f")
    ok = f["_bad"].isNull() & f["severity"].isin(fv.SEVERITIES) & f["category"].isin(fv.CATEGORIES)
    for name in REQUIRED:
        ok = ok & f[name].isNotNull()
    for outer, names in REQUIRED_INSIDE.items():
        for name in names:
            ok = ok & (f[outer].isNull() | f[outer][name].isNotNull())
    good = parsed.where(ok)
    meta = f["audit_metadata"]
    return good.select(
        *kept,
        "item_no",
        f["severity"].alias("severity"),
        f["category"].alias("category"),
        f["file_path"].alias("file_path"),
        F.coalesce(f["line_range"], F.array(F.lit(1), F.lit(1))).alias("line_range"),
        f["summary"].alias("summary"),
        f["detailed_analysis"].alias("detailed_analysis"),
        f["historical_pr_evidence"].alias("historical_pr_evidence"),
        f["sandboxed_repro_script"].alias("sandboxed_repro_script"),
        f["suggested_patch"].alias("suggested_patch"),
        F.struct(
            F.coalesce(meta["dlp_status"], F.lit("CLEAN")).alias("dlp_status"),
            F.coalesce(meta["redacted_entities"], F.array().cast("array<string>")).alias("redacted_entities"),
            F.coalesce(meta["token_cost_usd"], F.lit(0.0)).alias("token_cost_usd"),
            F.coalesce(meta["latency_ms"], F.lit(0.0)).alias("latency_ms"),
        ).alias("audit_metadata"),
    )
