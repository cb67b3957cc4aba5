"""Review history lines: ``<id>, <type>, <description>``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import fixed, strip
from ..operators.retrieval import embed
from .records import read_lines, records

# One field after its comma: quoted, quoted but never closed, or plain.
FIELD = r',("[^"]*(?:""[^"]*)*"[^,]*|"[^"]*(?:""[^"]*)*$|[^,]*)'


def fields(line: Column) -> Column:
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(FIELD), F.lit(1))
    return F.transform(
        raw,
        lambda f: F.when(
            f.startswith('"'),
            F.replace(F.regexp_replace(f, r'(?s)^"([^"]*(?:""[^"]*)*)"?(.*)$', "$1$2"), F.lit('""'), F.lit('"')),
        ).otherwise(f),
    )


def parse_history(lines: DataFrame, *, line_col: str = "value") -> DataFrame:
    """Rules from history lines; headers, blank and short rows drop out."""
    kept = [c for c in lines.columns if c != line_col]
    cells = fixed(lines, _l=strip(F.col(line_col))).where(F.col("_l") != "")
    cells = fixed(cells, _f=F.transform(fields(F.col("_l")), strip))
    f = F.col("_f")
    full = F.size(f) >= 3
    out = cells.where(~F.lower(f[0]).isin("id", "<id>") & (F.size(f) >= 2)).select(
        *kept,
        F.concat(F.lit(fv.HISTORY_PREFIX), f[0]).alias("rule_id"),
        F.when(full, F.lower(f[1])).otherwise(fv.HISTORY_DEFAULT_TYPE).alias("rule_type"),
        F.when(full, F.array_join(F.slice(f, F.lit(3), F.size(f)), ", ")).otherwise(f[1]).alias("description"),
    )
    return out.where(F.col("description") != "")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Rules of history files, quoted cells over several lines included, with the ``file`` they come from."""
    found = records(read_lines(spark, path), ["file"], ["start", "at"])
    return parse_history(found.drop("at"))


def enrich_history(records: DataFrame) -> DataFrame:
    """Rule name and the text to embed."""
    kind = F.col("rule_type")
    title = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1 << 30)))
    return records.withColumn(
        "rule_name",
        F.concat(title, F.lit("Guard: "), F.substring("description", 1, 40), F.lit("...")),
    ).withColumn("full_text", F.concat(F.lit("["), F.upper(kind), F.lit("] "), F.col("description")))


def history_rules(records: DataFrame) -> DataFrame:
    """Updates for the rule table."""
    return enrich_history(records).select(
        "rule_id", "rule_name", F.lit(fv.HISTORY_WEIGHT).alias("current_weight"),
        F.current_timestamp().alias("last_updated"),
    )


def with_vectors(rich: DataFrame, *, text_col: str = "full_text", make=embed) -> DataFrame:
    """The rows with what ``make`` finds of their text; a row is carried along whole, so ids may repeat."""
    rows = rich.select(F.struct("*").alias("_row"), F.col(text_col).alias("_text"))
    found = make(rows, id_col="_row", text_col="_text")
    return found.select("_row.*", *[c for c in found.columns if c != "_row"])


def history_incidents(records: DataFrame) -> DataFrame:
    """Updates for the incident table, with vectors; of a repeated id the upsert takes the last."""
    kept = [c for c in records.columns if c not in ("rule_id", "rule_type", "description")]
    return with_vectors(enrich_history(records)).select(
        *kept,
        F.col("rule_id").alias("id"),
        F.concat(F.lit(fv.HISTORY_URL_PREFIX), F.col("rule_id")).alias("pr_url"),
        F.upper("rule_type").alias("bug_category"),
        "description",
        F.concat(F.lit(fv.HISTORY_ROOT_CAUSE_PREFIX), F.col("description")).alias("root_cause"),
        F.col("description").alias("remediation"),
        F.lit(fv.HISTORY_COMMIT).alias("fix_commit_sha"),
        F.col("embedding").cast("array<float>").alias("embedding"),
    )
