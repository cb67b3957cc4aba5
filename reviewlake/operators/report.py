"""Remediation texts, prompts and nested JSON reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .language import attach_guidelines

REPORT_PART_ROWS = 1000


def fill(template: str, **values: Column) -> Column:
    """The template with its {names} replaced, as one concatenation."""
    parts, rest = [], template
    while "{" in rest:
        head, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(head), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def remediation_table(spark: SparkSession, rows=None) -> DataFrame:
    """(category, expected_failure); one row per known category."""
    return spark.createDataFrame(
        fv.EXPECTED_FAILURES if rows is None else rows, "_cat string, _expected string"
    )


def fill_remediation(findings: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """Fill missing repro and patch texts from the lookup by category.

    Needs ``category``, ``expected_failure`` and ``patch_explanation``; a
    category that is not listed takes the default.
    """
    table = F.broadcast(remediation_table(findings.sparkSession)) if table is None else table
    joined = findings.withColumn("_cat", F.upper("category")).join(table, "_cat", "left")
    expected = F.coalesce("_expected", F.lit(fv.DEFAULT_EXPECTED_FAILURE))
    missing = F.col("expected_failure").isNull()
    return joined.select(
        *[c for c in findings.columns if c not in ("expected_failure", "patch_explanation")],
        F.coalesce("expected_failure", expected).alias("expected_failure"),
        F.when(missing, fv.REPRO_RUNTIME).alias("runtime"),
        F.when(missing, fv.REPRO_FRAMEWORK).alias("test_framework"),
        F.coalesce(
            "patch_explanation", F.concat(F.lit(fv.PATCH_EXPLANATION_PREFIX), F.col("category"))
        ).alias("patch_explanation"),
        F.when(F.col("patch_explanation").isNull(), "PENDING").alias("verification_status"),
    )


def build_prompts(
    payloads: DataFrame, findings: DataFrame, rules: DataFrame, precedents: DataFrame, *, key="payload_id"
) -> DataFrame:
    """One prompt per payload; sections without rows are left out.

    A prompt is one string, so what is gathered per payload fits a row.
    """
    f = F.col

    def gathered(df, order, body, name):
        rows = df.select(key, F.struct(F.col(order).alias("o"), body.alias("b")).alias("s"))
        return rows.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias(name))

    def numbered(name: str, template: str) -> Column:
        head, _, tail = template.partition("{n}")
        return F.transform(
            name, lambda s, i: F.concat(F.lit(head), (i + 1).cast("string"), s["b"])
        )

    finding_tail = fv.PROMPT_FINDING.partition("{n}")[2]
    precedent_tail = fv.PROMPT_PRECEDENT.partition("{n}")[2]
    lists = [
        gathered(
            findings, "finding_no",
            fill(
                finding_tail, rule_id=f("rule_id"), category=f("category"), file_path=f("file_path"),
                line=f("line_start"), severity=f("severity"), message=f("message"), snippet=F.trim(f("snippet")),
            ),
            "_findings",
        ),
        gathered(rules, "rule_id", fill(fv.PROMPT_RULE, rule=f("rule_id")), "_rules"),
        gathered(
            precedents, "rank",
            fill(
                precedent_tail, pr_id=f("pr_id"), score=f("score"), bug_category=f("bug_category"),
                description=f("description"), root_cause=f("root_cause"), remediation=f("remediation"),
                fix_commit_sha=f("fix_commit_sha"),
            ),
            "_precedents",
        ),
    ]
    rows = attach_guidelines(payloads)
    for part in lists:
        rows = rows.join(part, key, "left")
    lang = F.upper("language")

    def section(name: str, head: str, lines: Column, end: str) -> Column:
        return F.when(F.size(name) > 0, F.concat_ws("\n", F.lit(head), F.array_join(lines, "\n"), F.lit(end)))

    prompt = F.concat_ws(
        "\n",
        fill(fv.PROMPT_HEADER, repo=f("repo_name"), language=lang, commit=f("commit_sha")),
        fill(fv.PROMPT_GUIDELINES, language=lang),
        F.concat(F.lit(fv.PROMPT_BEST), F.array_join("best_practices", "; ")),
        F.concat(F.lit(fv.PROMPT_ANTI), F.array_join("anti_patterns", "; ")),
        F.concat(F.lit(fv.PROMPT_NOTE), f("note")),
        F.lit(fv.PROMPT_PAYLOAD),
        F.regexp_replace("sanitized", r"^\s+|\s+$", ""),
        F.lit(fv.PROMPT_PAYLOAD_END),
        section("_findings", fv.PROMPT_FINDINGS, numbered("_findings", fv.PROMPT_FINDING), fv.PROMPT_FINDINGS_END),
        section("_rules", fv.PROMPT_RULES, F.transform("_rules", lambda s: s["b"]), ""),
        section("_precedents", fv.PROMPT_PRECEDENTS, numbered("_precedents", fv.PROMPT_PRECEDENT), fv.PROMPT_PRECEDENTS_END),
        F.lit(fv.PROMPT_END),
    )
    return rows.select(key, prompt.alias("prompt"))


def export_report(
    rated: DataFrame, findings: DataFrame, *, key="payload_id", fields=("score", "grade"), part_rows=REPORT_PART_ROWS
) -> DataFrame:
    """Nested JSON per payload: its rating and its findings.

    ``fields`` names the columns of ``rated`` to show; with a review rollup and
    its latency, fired rules and status this is the findings-and-stats export.
    A report of any size is written in the same form: part p holds the findings
    whose number divided by ``part_rows`` is p, in order, so no list grows without bound
    and the parts follow each other.
    """
    placed = findings.withColumn("part", F.floor(F.col("finding_no") / part_rows).cast("int"))
    body = F.struct("finding_no", "severity", "category")
    lists = placed.groupBy(key, "part").agg(F.array_sort(F.collect_list(body)).alias("findings"))
    empty = F.array().cast("array<struct<finding_no:int,severity:string,category:string>>")
    full = rated.join(lists, key, "left").select(
        key, F.coalesce("part", F.lit(0)).alias("part"), *fields, F.coalesce("findings", empty).alias("findings")
    )
    return full.select(key, "part", F.to_json(F.struct(key, "part", *fields, "findings")).alias("report"))
