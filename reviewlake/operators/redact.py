"""Redaction and quarantine over a table of payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.redaction import card_hits, gate_open, mask_cards
from ..functions.text import settle, sha_hash


def redact_cards(df: DataFrame, *, text_col="text", tag=fv.REDACTION_TAG) -> DataFrame:
    """Add ``sanitized`` and ``n_cards``; only Luhn-valid candidates go."""
    counted = df.withColumn("n_cards", F.coalesce(F.size(card_hits(F.col(text_col))), F.lit(0)))
    return counted.withColumn(
        "sanitized",
        F.when(F.col("n_cards") > 0, mask_cards(F.col(text_col), tag)).otherwise(F.col(text_col)),
    )


def redact_patterns(
    df: DataFrame, *, text_col="sanitized", tag=fv.REDACTION_TAG, patterns=None
) -> DataFrame:
    """Run the ordered, gated passes; add ``n_patterns`` and ``pattern_types``.

    Each pass is its own projection that reads the column of the pass before,
    so a regex runs once to count and a second time only where it hit.
    """
    patterns = fv.REDACTION_PATTERNS if patterns is None else patterns
    kept = [c for c in df.columns if c != text_col]
    out = df.select(*kept, F.col(text_col).alias("_t"))
    counts: list[str] = []
    for i, (_, pattern, gate) in enumerate(patterns):
        name = f"_n{i}"
        text = F.col("_t")
        out = out.withColumn(
            name,
            F.when(gate_open(text, gate), F.regexp_count(text, F.lit(pattern))).otherwise(0),
        )
        out = out.withColumn(
            "_t",
            F.when(F.col(name) > 0, F.regexp_replace(text, pattern, _literal(tag))).otherwise(text),
        )
        counts.append(name)
    types = F.array_compact(
        F.array(*[F.when(F.col(n) > 0, F.lit(t)) for n, (t, _, _) in zip(counts, patterns)])
    )
    total = sum((F.coalesce(F.col(n), F.lit(0)) for n in counts), F.lit(0))
    return out.select(
        *kept,
        F.col("_t").alias(text_col),
        total.alias("n_patterns"),
        F.array_sort(F.array_distinct(types)).alias("pattern_types"),
    )


def redact(df: DataFrame, *, text_col="text", tag=fv.REDACTION_TAG, patterns=None) -> DataFrame:
    """Cards first, then the patterns: ``sanitized``, ``n_redacted``, ``info_types``."""
    both = redact_patterns(redact_cards(df, text_col=text_col, tag=tag), tag=tag, patterns=patterns)
    card_type = F.when(F.col("n_cards") > 0, F.array(F.lit(fv.CARD_TYPE))).otherwise(
        F.array().cast("array<string>")
    )
    out = (
        both.withColumn("n_redacted", F.col("n_cards") + F.col("n_patterns"))
        .withColumn("info_types", F.array_sort(F.array_union(card_type, F.col("pattern_types"))))
        .drop("n_cards", "n_patterns", "pattern_types")
    )
    return settle(out, "sanitized", "n_redacted", "info_types")


def check_injection(df: DataFrame, *, text_col="text", patterns=None) -> DataFrame:
    """Add ``is_quarantined``, ``reason``, ``matched`` and ``injection_severity``."""
    words = fv.INJECTION_WORDS if patterns is None else [()] * len(patterns)
    patterns = fv.INJECTION_PATTERNS if patterns is None else patterns
    text = F.col(text_col)
    found = df.withColumn("_low", F.lower(text)).withColumn(
        "_hit",
        _first(
            patterns,
            lambda i, p: (gate_open(F.col("_low"), words[i]) & text.rlike(p[0]), F.lit(i)),
        ),
    )
    found = settle(found.drop("_low"), "_hit").withColumn(
        "matched",
        _first(patterns, lambda i, p: (F.col("_hit") == i, F.regexp_extract(text, p[0], 0))),
    )
    return found.select(
        *df.columns,
        F.col("_hit").isNotNull().alias("is_quarantined"),
        _first(
            patterns,
            lambda i, p: (
                F.col("_hit") == i,
                F.concat(F.lit(f"{p[1]} (matched: '"), F.col("matched"), F.lit("')")),
            ),
        ).alias("reason"),
        "matched",
        F.coalesce(
            _first(patterns, lambda i, p: (F.col("_hit") == i, F.lit(p[2]))), F.lit("CLEAN")
        ).alias("injection_severity"),
    )


def inspect(
    df: DataFrame, *, text_col="text", tag=fv.REDACTION_TAG, patterns=None, injections=None
) -> DataFrame:
    """Quarantine, then redact. A text that is missing or no valid UTF-8 fails closed.

    The text may come as bytes; nothing looks into it before its encoding is judged. Adds ``sanitized``, ``dlp_status``, ``n_redacted``, ``info_types``,
    ``integrity_hash``, ``original_hash`` and ``quarantine_reason``. Works the
    same on a streaming DataFrame: no shuffle, no state.
    """
    text = F.col(text_col).cast("string")
    readable = df.withColumn("_text", F.when(F.is_valid_utf8(text), text))
    checked = check_injection(readable, text_col="_text", patterns=injections).withColumn(
        "_safe", F.when(~F.col("is_quarantined"), F.col("_text"))
    )
    red = redact(checked, text_col="_safe", tag=tag, patterns=patterns)
    missing, failed = F.col(text_col).isNull(), F.col("_text").isNull()
    hostile = F.col("is_quarantined")
    none = F.array().cast("array<string>")
    return red.select(
        *df.columns,
        F.when(failed, fv.FAILURE_TEXT)
        .when(hostile, fv.QUARANTINE_TEXT)
        .otherwise(F.col("sanitized"))
        .alias("sanitized"),
        F.when(failed | hostile, "QUARANTINED")
        .when(F.col("n_redacted") > 0, "REDACTED")
        .otherwise("CLEAN")
        .alias("dlp_status"),
        F.when(failed, 0).when(hostile, 1).otherwise(F.col("n_redacted")).alias("n_redacted"),
        F.when(failed, none)
        .when(hostile, F.array(F.lit(fv.QUARANTINE_TYPE)))
        .otherwise(F.col("info_types"))
        .alias("info_types"),
        F.when(failed, sha_hash(F.lit(fv.FAILURE_HASH_INPUT)))
        .when(hostile, sha_hash(F.lit(fv.QUARANTINE_HASH_INPUT)))
        .otherwise(sha_hash(F.col("sanitized")))
        .alias("integrity_hash"),
        sha_hash(F.col(text_col)).alias("original_hash"),
        F.when(missing, "Fail-closed: DLP inspection failed (missing text)")
        .when(failed, "Fail-closed: DLP inspection failed (invalid encoding)")
        .when(hostile, F.col("reason"))
        .alias("quarantine_reason"),
    )


def split_quarantined(inspected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by the quarantine status."""
    hostile = F.col("dlp_status") == "QUARANTINED"
    return inspected.where(~hostile), inspected.where(hostile)


def quarantine_findings(inspected: DataFrame, *, path_col="file_path") -> DataFrame:
    """One synthetic CRITICAL finding per rejected payload."""
    rejected = split_quarantined(inspected)[1]
    return rejected.select(
        *[c for c in inspected.columns if c in ("payload_id", "doc_id", path_col)],
        F.lit("SEC-QUARANTINE").alias("rule_id"),
        F.lit("CRITICAL").alias("severity"),
        F.lit("SECURITY_DLP").alias("category"),
        F.lit("Adversarial Prompt Injection Quarantined").alias("summary"),
        F.concat(
            F.lit("Payload contained malicious prompt injection pattern: "),
            F.col("quarantine_reason"),
        ).alias("detailed_analysis"),
    )


def leak_findings(inspected: DataFrame, *, path_col="file_path") -> DataFrame:
    """One CRITICAL finding per accepted payload in which something was redacted."""
    leaking = split_quarantined(inspected)[0].where(F.col("n_redacted") > 0)
    return leaking.select(
        *[c for c in inspected.columns if c in ("payload_id", "doc_id", path_col)],
        F.lit("SEC-DLP-LEAK").alias("rule_id"),
        F.lit("CRITICAL").alias("severity"),
        F.lit("SECURITY_DLP").alias("category"),
        F.concat(
            F.lit("Detected "), F.col("n_redacted").cast("string"),
            F.lit(" Sensitive Secrets/Credentials/PANs"),
        ).alias("summary"),
        F.concat(
            F.lit("Redacted info types: "), F.array_join("info_types", ", "),
            F.lit(". Secrets must never be committed."),
        ).alias("detailed_analysis"),
    )


def redaction_report(inspected: DataFrame, *, group_col="source") -> DataFrame:
    """Payloads per group, status and info type, with subtotals (NULL: all).

    A payload with several types counts once in each of them, and once in every
    subtotal. Each sends its rows to the lines it belongs to, so the texts are
    inspected once.
    """
    none = F.lit(None).cast("string")

    def line(group, status, kind):
        return F.struct(group.alias(group_col), status.alias("dlp_status"), kind.alias("info_type"))

    group, status = F.col(group_col).cast("string"), F.col("dlp_status")
    found = F.array_distinct(F.coalesce("info_types", F.array().cast("array<string>")))
    kinds = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("NONE")))
    lines = F.concat(
        F.transform(kinds, lambda k: line(group, status, k)),
        F.array(line(group, status, none), line(group, none, none), line(none, none, none)),
    )
    return (
        inspected.select(F.inline(lines))
        .groupBy(group_col, "dlp_status", "info_type")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _first(patterns, branch) -> Column:
    """when(...).when(...) over the patterns; NULL when none applies."""
    chain = None
    for i, p in enumerate(patterns):
        cond, value = branch(i, p)
        chain = F.when(cond, value) if chain is None else chain.when(cond, value)
    return chain


def _literal(replacement: str) -> str:
    return replacement.replace("\\", "\\\\").replace("$", "\\$")
