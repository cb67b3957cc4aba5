"""Finding records, exports, remediation texts and prompts on example rows."""

import json

from reviewlake import fixed_values as fv
from reviewlake.operators import report, rules, scoring, tags


def test_scan_findings_become_records(spark):
    files = spark.createDataFrame([("f", "total = 1.5\n")], "file_id string, source string")
    row = tags.scan_to_findings(rules.find(files)).first()
    assert (row["category"], row["severity"], row["line_range"], row["file_path"]) == (
        "LEDGER_INTEGRITY", "CRITICAL", [1, 3], "app/main.py")
    assert "under rule AST-FIN-001" in row["detailed_analysis"]


def test_tags_skip_categories_that_are_there(spark):
    p = spark.createDataFrame(
        [(1, "wallet debit"), (2, "wallet debit for update"), (3, "template card"), (4, "template card"), (5, None)],
        "payload_id int, sanitized string",
    )
    have = spark.createDataFrame(
        [(1, "RACE_CONDITION", "x"), (3, "SECURITY_DLP", "x"), (4, "OTHER", "SQL Injection here")],
        "payload_id int, category string, summary string",
    )
    got = sorted((r["payload_id"], r["summary"][:9]) for r in tags.tag_risks(p, findings=have).collect())
    assert got == [(3, "Untrusted"), (4, "PCI-DSS R")]


def test_exports(spark):
    files = spark.createDataFrame(
        [(1, 1, 95, 1.5, 2, "REDACTED"), (1, 2, 0, 0.5, 0, "CLEAN"), (2, 1, 0, 1.0, 0, "CLEAN")],
        "review_id int, file_no int, n_findings int, latency_ms double, rules_fired int, dlp_status string",
    )
    found = spark.createDataFrame(
        [(1, n, "HIGH", "IDEMPOTENCY") for n in range(95)], "review_id int, finding_no int, severity string, category string"
    )
    out = report.export_report(
        scoring.rollup_reviews(files), found, key="review_id", fields=("latency_ms", "rules_fired", "dlp_status"), part_rows=10
    ).collect()
    docs = [json.loads(r["report"]) for r in out]
    first = [d for d in docs if d["review_id"] == 1]
    assert len(first) == 10 and all(len(d["findings"]) <= 10 for d in first)
    in_order = sorted(first, key=lambda d: d["part"])
    assert [f["finding_no"] for d in in_order for f in d["findings"]] == list(range(95))
    assert first[0]["dlp_status"] == "REDACTED" and first[0]["latency_ms"] == 2.0
    assert [d["findings"] for d in docs if d["review_id"] == 2] == [[]]


def test_remediation_default(spark):
    df = spark.createDataFrame(
        [("race_condition", None, None), ("AST_SYNTAX", None, "mine")],
        "category string, expected_failure string, patch_explanation string",
    )
    got = {r["category"]: r for r in report.fill_remediation(df).collect()}
    assert got["race_condition"]["expected_failure"] == "Critical: Balance dropped below zero"
    assert got["AST_SYNTAX"]["expected_failure"] == fv.DEFAULT_EXPECTED_FAILURE
    assert (got["AST_SYNTAX"]["patch_explanation"], got["AST_SYNTAX"]["verification_status"]) == ("mine", None)


def test_prompt_leaves_empty_sections_out(spark):
    p = spark.createDataFrame([(1, "r", "c", "go", " x ")], "payload_id int, repo_name string, commit_sha string, language string, sanitized string")
    none = spark.createDataFrame(
        [], "payload_id int, finding_no int, rule_id string, category string, file_path string, line_start int, severity string, message string, snippet string"
    )
    prec = spark.createDataFrame(
        [(1, 1, "9", 0.9, "B", "d", "rc", "rem", "sha")],
        "payload_id int, rank int, pr_id string, score double, bug_category string, description string, root_cause string, remediation string, fix_commit_sha string",
    )
    text = report.build_prompts(p, none, none.select("payload_id", "rule_id"), prec).first()["prompt"]
    assert "AST FINDINGS" not in text and "Elevated Rule" not in text
    assert "- [Precedent 1] PR #9 (Similarity: 0.9 | Category: B):\n  Incident: d" in text
    assert "```diff\nx\n```" in text and text.endswith(fv.PROMPT_END)
