"""Shaping of unified diffs: one row per file, source text, hunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, fixed, let, split_lines, strip

FILE_HEADER = "diff --git "
HUNK = r"@@\s+-\d+(?:,\d+)?\s+\+\d+(?:,\d+)?\s+@@"
NO_NAME = "git-diff"
# A hunk is looked for this many lines around the place it names.
REACH = 14


def unify(text: Column) -> Column:
    """The text with every line break written as \\n and none at the end."""
    return F.array_join(split_lines(text), "\n")


def split_by_file(df: DataFrame, *, text_col="diff") -> DataFrame:
    """One row per ``diff --git`` section: ``file_no``, ``file_path``, ``file_diff``."""
    text = F.col(text_col)
    parts = F.split(unify(text), rf"(?m)(?=^{FILE_HEADER})", -1)
    kept = [c for c in df.columns if c != text_col]
    out = df.where(strip(text) != "").select(*kept, F.posexplode(parts).alias("file_no", "_p"))
    body = F.regexp_replace("_p", r"\n$", "")
    head = F.split(F.element_at(F.split("_p", "\n", 2), 1), " ", -1)
    fourth = F.get(head, 3)
    return out.select(
        *kept,
        "file_no",
        F.when(
            F.col("_p").startswith(FILE_HEADER) & fourth.startswith("b/") & (F.length(fourth) > 2),
            F.substring(fourth, 3, 1 << 30),
        ).otherwise(NO_NAME).alias("file_path"),
        body.alias("file_diff"),
    )


def to_source(df: DataFrame, *, text_col="diff", default="patch.py") -> DataFrame:
    """The new side of a diff: added and context lines without their marker.

    The text is first freed of the margin that all its lines with text share.
    Adds ``target``, ``source`` and ``is_empty`` (an empty source is clean).
    """
    out = fixed(df, _lines=split_lines(F.col(text_col)))
    margins = F.transform(
        F.filter("_lines", lambda x: x.rlike(r"\S")), lambda x: F.regexp_extract(x, r"^[ \t]*", 0)
    )
    # What the smallest and the largest margin share, all margins share.
    out = fixed(out, _margins=margins)
    out = fixed(out, _low=F.array_min("_margins"), _high=F.array_max("_margins"))
    shared = F.filter(
        F.sequence(F.lit(0), F.least(F.length("_low"), F.length("_high"))),
        lambda n: F.substr("_low", F.lit(1), n) == F.substr("_high", F.lit(1), n),
    )
    out = fixed(out, _cut=F.coalesce(F.array_max(shared), F.lit(0)))
    freed = F.transform(
        "_lines",
        lambda x: F.when(F.col("_cut") == 0, x)
        .when(x.rlike(r"^[ \t]*$"), "")
        .otherwise(F.substr(x, F.col("_cut") + 1)),
    )
    out = fixed(out, _freed=strip(F.array_join(freed, "\n")))
    out = fixed(out, _lines=split_lines(F.col("_freed"))).drop("_freed")
    kept = F.filter(
        "_lines", lambda x: (x.startswith("+") & ~x.startswith("+++")) | x.startswith(" ")
    )
    names = F.filter("_lines", lambda x: x.startswith("+++ b/"))
    out = out.withColumn(
        "target",
        F.coalesce(strip(F.substr(F.try_element_at(names, F.lit(-1)), F.lit(7))), F.lit(default)),
    )
    out = fixed(out, source=F.array_join(F.transform(kept, lambda x: F.substr(x, F.lit(2))), "\n"))
    return out.withColumn("is_empty", strip(F.col("source")) == "").drop(
        "_lines", "_margins", "_low", "_high", "_cut"
    )


def added_source(text: Column) -> Column:
    """The looser variant: drops only deletions, hunk headers and git lines."""
    def keep(x):
        return (x.startswith("+") & ~x.startswith("+++")) | ~any_of(
            [x.startswith(m) for m in ("-", "@@", "diff ", "index ")]
        )

    shown = F.transform(
        F.filter(split_lines(text), keep),
        lambda x: F.when(x.startswith("+") & ~x.startswith("+++"), F.substr(x, F.lit(2))).otherwise(x),
    )
    return F.array_join(shown, "\n")


def looks_like_diff(text: Column) -> Column:
    return text.contains("diff --git") | text.startswith("--- ") | text.contains("\n@@ ")


def drop_deleted(text: Column) -> Column:
    """Without deleted lines, when it is a diff: taking a secret out must pass."""
    kept = F.filter(split_lines(text), lambda x: ~x.startswith("-") | x.startswith("---"))
    return F.when(looks_like_diff(text), F.array_join(kept, "\n")).otherwise(text)


def as_added(path: Column, text: Column) -> Column:
    """A whole file as a diff in which every line is new."""
    def whole(lines: Column) -> Column:
        head = F.concat(
            F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -0,0 +1,"),
            F.size(lines).cast("string"), F.lit(" @@\n"),
        )
        return F.concat(head, F.array_join(F.transform(lines, lambda x: F.concat(F.lit("+"), x)), "\n"))

    return let(split_lines(text), whole)


def hunks_of(patch: Column) -> Column:
    """Array of (hunk_no, start_old, expected, replacement) in patch order."""
    parts = F.filter(
        F.split(unify(strip(patch)), rf"(?m)(?=^{HUNK})", -1), lambda p: p.rlike(rf"^{HUNK}")
    )

    def side(part: Column, sign: str) -> Column:
        body = F.filter(
            F.slice(F.split(part, "\n", -1), F.lit(2), F.size(F.split(part, "\n", -1))),
            lambda x: x.startswith(" ") | x.startswith(sign),
        )
        return F.transform(body, lambda x: F.substr(x, F.lit(2)))

    return F.transform(
        parts,
        lambda p, i: F.struct(
            i.alias("hunk_no"),
            F.regexp_extract(p, r"^@@\s+-(\d+)", 1).cast("int").alias("start_old"),
            side(p, "-").alias("expected"),
            side(p, "+").alias("replacement"),
        ),
    )


def parse_hunks(df: DataFrame, *, patch_col="patch") -> DataFrame:
    kept = [c for c in df.columns if c != patch_col]
    return df.select(*kept, F.inline(hunks_of(F.col(patch_col))))


def match_hunks(files: DataFrame, patches: DataFrame, *, key="file_id", text_col="text", patch_col="patch") -> DataFrame:
    """Where each hunk of a patch fits its file: ``status``, ``position``, ``shift``.

    One row per file meets one row per patch; the few places a hunk may sit at
    are tried inside the row, nearest first and before ahead of after.
    """
    order = [0] + [o for d in range(1, REACH + 1) for o in (-d, d)]
    both = files.select(key, split_lines(F.col(text_col)).alias("_lines")).join(
        patches.select(key, hunks_of(F.col(patch_col)).alias("_hunks")), key
    )
    lines = F.col("_lines")

    def place(h: Column) -> Column:
        start = F.greatest(F.lit(0), h["start_old"] - 1)
        n = F.size(h["expected"])

        def fits(o: Column) -> Column:
            at = start + o
            return (
                (at >= 0)
                & (at + n <= F.size(lines))
                & (F.slice(lines, F.greatest(at, F.lit(0)) + 1, n) == h["expected"])
            )

        near = F.get(F.filter(F.array(*[F.lit(o) for o in order]), fits), F.lit(0))
        # Plain text search, as lines and also within a line.
        whole = F.array_join(lines, "\n")
        inside = F.instr(whole, F.array_join(h["expected"], "\n"))
        return F.struct(
            h["hunk_no"].alias("hunk_no"),
            h["start_old"].alias("start_old"),
            F.when(near.isNotNull(), "MATCH").when(inside > 0, "SUBSTRING").otherwise("CONFLICT").alias("status"),
            F.when(near.isNotNull(), start + near + 1)
            .when(inside > 0, F.size(F.split(F.substr(whole, F.lit(1), inside - 1), "\n", -1)))
            .alias("position"),
            near.alias("shift"),
        )

    return both.select(key, F.inline(F.transform("_hunks", place)))
