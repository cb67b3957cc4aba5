"""Queries over unified diffs made from whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import LINE_BREAK
from ..operators import diffs as df_
from .base import pick, query, quote, sql_pick, texts

# Every line of a document becomes a diff line; its marker goes by its place.
MARKS = ["+", " ", "-", "", "+", "@@ ", "--- ", "+++ b/", "index "]
# Two sections per document, some with text before the first header, a path
# with a space, or no b/ in the header.
HEADS = [
    "diff --git a/src/one.py b/src/one.py\n--- a/src/one.py\n+++ b/src/one.py\n@@ -1,3 +1,4 @@\n",
    "note before\ndiff --git a/x.go b/x.go\n+++ b/x.go\n",
    "\n  diff --git a/no.py b/no.py\n",
    "diff --git a/my file.py b/my file.py\n+++ b/my file.py\n",
    "diff --git old new\n",
    "diff --git a/q b/\n+++ b/q.py \n",
]
TAIL = "\ndiff --git a/two/b.js b/two/b.js\nindex 1..2\n--- a/two/b.js\n+++ b/two/b.js\n@@ -1 +1 @@\n-var a = 1\n+var a = 2"

_BREAK = quote(LINE_BREAK)


def lines_sql(text: str) -> str:
    parts = f"string_split_regex({text}, {_BREAK})"
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[1:len({parts}) - 1] ELSE {parts} END)"


_MARKED = f"array_to_string(list_transform({lines_sql('text')}, lambda x, i: {sql_pick(MARKS, 'i')} || x), chr(10))"
DIFF_SQL = f"diffs AS (SELECT doc_id, {sql_pick(HEADS, 'doc_id')} || {_MARKED} || {quote(TAIL)} AS diff FROM documents)"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def diffs(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    marked = F.transform(
        df_.split_lines(F.col("text")), lambda x, i: F.concat(pick(MARKS, i + 1), x)
    )
    return docs.select(
        "doc_id",
        F.concat(pick(HEADS, F.col("doc_id")), F.array_join(marked, "\n"), F.lit(TAIL)).alias("diff"),
    )


@query(
    "diff_split",
    f"""WITH {DIFF_SQL}, l AS (SELECT doc_id, {lines_sql('diff')} AS ls FROM diffs),
      e AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM l),
      s AS (SELECT doc_id, i, line, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM e),
      g AS (SELECT doc_id, sec, string_agg(line, chr(10) ORDER BY i) AS file_diff, arg_min(line, i) AS head FROM s GROUP BY doc_id, sec)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1 AS BIGINT) AS file_no,
      CASE WHEN starts_with(head, 'diff --git ') AND starts_with(string_split(head, ' ')[4], 'b/') AND length(string_split(head, ' ')[4]) > 2 THEN substr(string_split(head, ' ')[4], 3) ELSE 'git-diff' END AS file_path,
      sha256(file_diff) AS diff_hash FROM g""",
)
def diff_split(spark, sf_dir):
    out = df_.split_by_file(diffs(spark, sf_dir))
    return out.select(
        "doc_id", F.col("file_no").cast("bigint").alias("file_no"), "file_path", F.sha2("file_diff", 256).alias("diff_hash")
    )


# Half of the diffs are indented as a whole, so dedenting has work to do.
_INDENTED = f"(CASE WHEN doc_id % 2 = 0 THEN array_to_string(list_transform({lines_sql('diff')}, lambda x: '    ' || x), chr(10)) ELSE diff END)"


@query(
    "diff_source",
    f"""WITH {DIFF_SQL}, a AS (SELECT doc_id, {lines_sql(_STRIP.format('diff'))} AS ls,
        {lines_sql(_INDENTED)} AS raw FROM diffs),
      m AS (SELECT doc_id, raw, coalesce(list_min(list_transform(list_filter(raw, lambda x: regexp_matches(x, '\\S')), lambda x: length(regexp_extract(x, '^ *')))), 0) AS cut FROM a),
      d AS (SELECT doc_id, {lines_sql(_STRIP.format("array_to_string(list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '^[ \t]*$') AND cut > 0 THEN '' ELSE substr(x, cut + 1) END), chr(10))"))} AS ls FROM m),
      k AS (SELECT doc_id, array_to_string(list_transform(list_filter(ls, lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++')) OR starts_with(x, ' ')), lambda x: substr(x, 2)), chr(10)) AS source,
        list_filter(ls, lambda x: starts_with(x, '+++ b/')) AS names FROM d)
    SELECT doc_id, sha256(source) AS source_hash, {_STRIP.format("substr(names[-1], 7)")} AS target, {_STRIP.format('source')} = '' AS is_empty FROM k""",
)
def diff_source(spark, sf_dir):
    raw = diffs(spark, sf_dir)
    shifted = F.array_join(F.transform(df_.split_lines(F.col("diff")), lambda x: F.concat(F.lit("    "), x)), "\n")
    some = raw.withColumn("diff", F.when(F.col("doc_id") % 2 == 0, shifted).otherwise(F.col("diff")))
    return df_.to_source(some).select("doc_id", F.sha2("source", 256).alias("source_hash"), "target", "is_empty")


@query(
    "diff_source_cli",
    f"""WITH {DIFF_SQL} SELECT doc_id, sha256(array_to_string(list_transform(list_filter({lines_sql('diff')}, lambda x: (starts_with(x, '+') AND NOT starts_with(x, '+++'))
      OR NOT (starts_with(x, '-') OR starts_with(x, '@@') OR starts_with(x, 'diff ') OR starts_with(x, 'index '))),
      lambda x: CASE WHEN starts_with(x, '+') AND NOT starts_with(x, '+++') THEN substr(x, 2) ELSE x END), chr(10))) AS source_hash FROM diffs""",
)
def diff_source_cli(spark, sf_dir):
    return diffs(spark, sf_dir).select(
        "doc_id", F.sha2(df_.added_source(F.col("diff")), 256).alias("source_hash")
    )


_MAYBE = "(CASE WHEN doc_id % 5 = 0 THEN array_to_string(list_transform({}, lambda x: '-' || x), chr(10)) ELSE diff END)"


@query(
    "diff_active",
    f"""WITH {DIFF_SQL}, m AS (SELECT doc_id, {_MAYBE.format(lines_sql("replace(diff, 'diff --git', 'x')"))} AS t FROM diffs)
    SELECT doc_id, contains(t, 'diff --git') OR starts_with(t, '--- ') OR contains(t, chr(10) || '@@ ') AS is_diff,
      sha256(CASE WHEN contains(t, 'diff --git') OR starts_with(t, '--- ') OR contains(t, chr(10) || '@@ ')
      THEN array_to_string(list_filter({lines_sql('t')}, lambda x: NOT starts_with(x, '-') OR starts_with(x, '---')), chr(10)) ELSE t END) AS text_hash FROM m""",
)
def diff_active(spark, sf_dir):
    """Every fifth text only looks like deleted lines and is no diff."""
    raw = diffs(spark, sf_dir)
    plain = F.transform(
        df_.split_lines(F.replace("diff", F.lit("diff --git"), F.lit("x"))), lambda x: F.concat(F.lit("-"), x)
    )
    text = F.when(F.col("doc_id") % 5 == 0, F.array_join(plain, "\n")).otherwise(F.col("diff"))
    mixed = raw.select("doc_id", text.alias("t"))
    return mixed.select(
        "doc_id", df_.looks_like_diff(F.col("t")).alias("is_diff"), F.sha2(df_.drop_deleted(F.col("t")), 256).alias("text_hash")
    )


@query(
    "diff_synth",
    f"""WITH l AS (SELECT doc_id, source, {lines_sql('text')} AS ls FROM documents)
    SELECT doc_id, sha256('--- a/' || source || '.py' || chr(10) || '+++ b/' || source || '.py' || chr(10) || '@@ -0,0 +1,' || len(ls) || ' @@' || chr(10)
      || array_to_string(list_transform(ls, lambda x: '+' || x), chr(10))) AS diff_hash FROM l""",
)
def diff_synth(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit(".py"))
    return docs.select("doc_id", F.sha2(df_.as_added(path, F.col("text")), 256).alias("diff_hash"))


# Patches: the first hunk names line 3 of the document while its text sits 0..15
# lines further down, or before, or nowhere; the second is a part of a line.
_SHIFTS = [0, 3, 14, 15, -2, 1]
_PATCH_SQL = f"""l AS (SELECT doc_id, {lines_sql('text')} AS ls, ([{', '.join(map(str, _SHIFTS))}])[doc_id % {len(_SHIFTS)} + 1] AS o FROM documents),
   patches AS (SELECT doc_id, ls, '--- a/x' || chr(10) || '+++ b/x' || chr(10) || '@@ -3,1 +3,2 @@ head' || chr(10) || '-' || coalesce(ls[3 + o], 'missing') || chr(10) || '+new line' || chr(10)
     || '@@ -1 +1 @@' || chr(10) || ' ' || substr(coalesce(ls[len(ls)], 'gone'), 2, 12) || CASE WHEN doc_id % 4 = 0 THEN ' never there' ELSE '' END || chr(10) || '+tail' AS patch FROM l)"""


def patches(spark, sf_dir):
    docs = texts(spark, sf_dir, "documents")
    shift = F.element_at(F.array(*[F.lit(s) for s in _SHIFTS]), (F.col("doc_id") % len(_SHIFTS) + 1).cast("int"))
    ls = df_.split_lines(F.col("text"))
    first = F.coalesce(F.get(ls, shift + 2), F.lit("missing"))
    last = F.substring(F.coalesce(F.get(ls, F.size(ls) - 1), F.lit("gone")), 2, 12)
    extra = F.when(F.col("doc_id") % 4 == 0, " never there").otherwise("")
    return docs.select(
        "doc_id",
        F.concat(
            F.lit("--- a/x\n+++ b/x\n@@ -3,1 +3,2 @@ head\n-"), first, F.lit("\n+new line\n@@ -1 +1 @@\n "), last, extra,
            F.lit("\n+tail"),
        ).alias("patch"),
    )


_HUNK_SQL = f"""{_PATCH_SQL}, e AS (SELECT doc_id, i, string_split(patch, chr(10))[i] AS line FROM patches, range(1, 20) r(i) WHERE i <= len(string_split(patch, chr(10)))),
   s AS (SELECT *, sum(CASE WHEN regexp_matches(line, {quote('^' + df_.HUNK)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM e),
   hunks AS (SELECT doc_id, h - 1 AS hunk_no, CAST(regexp_extract(arg_min(line, i), '-([0-9]+)', 1) AS INTEGER) AS start_old,
     coalesce(list(substr(line, 2) ORDER BY i) FILTER (line[1] IN (' ', '-')), []) AS expected, coalesce(list(substr(line, 2) ORDER BY i) FILTER (line[1] IN (' ', '+')), []) AS replacement
     FROM s WHERE h > 0 GROUP BY doc_id, h)"""


@query(
    "hunks",
    f"""WITH {_HUNK_SQL} SELECT doc_id, CAST(hunk_no AS BIGINT) AS hunk_no, CAST(start_old AS BIGINT) AS start_old,
      array_to_string(expected, chr(10)) AS expected, array_to_string(replacement, chr(10)) AS replacement FROM hunks""",
)
def hunks(spark, sf_dir):
    return df_.parse_hunks(patches(spark, sf_dir)).select(
        "doc_id", F.col("hunk_no").cast("bigint").alias("hunk_no"), F.col("start_old").cast("bigint").alias("start_old"),
        F.array_join("expected", "\n").alias("expected"), F.array_join("replacement", "\n").alias("replacement"),
    )


@query(
    "hunk_match",
    f"""WITH {_HUNK_SQL}, j AS (SELECT h.*, l.ls FROM hunks h JOIN l USING (doc_id)),
      c AS (SELECT doc_id, hunk_no, o, greatest(0, start_old - 1) + o AS at FROM j, range(-14, 15) r(o)
        WHERE greatest(0, start_old - 1) + o >= 0 AND greatest(0, start_old - 1) + o + len(expected) <= len(ls)
          AND ls[greatest(0, start_old - 1) + o + 1 : greatest(0, start_old - 1) + o + len(expected)] = expected),
      b AS (SELECT doc_id, hunk_no, arg_min(o, abs(o) * 2 + CASE WHEN o > 0 THEN 1 ELSE 0 END) AS o FROM c GROUP BY ALL),
      p AS (SELECT j.*, b.o, instr(array_to_string(ls, chr(10)), array_to_string(expected, chr(10))) AS ins FROM j LEFT JOIN b USING (doc_id, hunk_no))
    SELECT doc_id, CAST(hunk_no AS BIGINT) AS hunk_no, CASE WHEN o IS NOT NULL THEN 'MATCH' WHEN ins > 0 THEN 'SUBSTRING' ELSE 'CONFLICT' END AS status,
      CAST(coalesce(CASE WHEN o IS NOT NULL THEN greatest(0, start_old - 1) + o + 1 WHEN ins > 0 THEN len(string_split(left(array_to_string(ls, chr(10)), ins - 1), chr(10))) END, -1) AS BIGINT) AS position,
      CAST(coalesce(o, 99) AS BIGINT) AS shift FROM p""",
)
def hunk_match(spark, sf_dir):
    out = df_.match_hunks(texts(spark, sf_dir, "documents"), patches(spark, sf_dir), key="doc_id")
    return out.select(
        "doc_id", F.col("hunk_no").cast("bigint").alias("hunk_no"), "status",
        F.coalesce("position", F.lit(-1)).cast("bigint").alias("position"),
        F.coalesce("shift", F.lit(99)).cast("bigint").alias("shift"),
    )
