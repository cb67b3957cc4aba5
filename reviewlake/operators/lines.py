"""Source files as lines, logical statements and enclosing blocks.

A file arrives as one row, so everything per file is bounded by one value. All
windows and groups below lie within a file; the files are shuffled once, by id,
and every later step keeps that partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions.text import fixed, let, rewrite_matches, split_lines
from ..plans.layout import by_key

# Comments and string literals of Python source; the mark of an f-string belongs to it.
LITERAL = (
    r'(?s)(?:\b(?:[fF][rR]?|[rR][fF]))?(?:""".*?"""|\'\'\'.*?\'\'\'|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+')|#[^\n]*"
)
# A replacement field of an f-string: its expression, then conversion and format.
FIELD = r"\{([^{}:!]*(?:![=][^{}:!]*)*)([^{}]*)\}"

DEF = r"^\s*(?:async\s+)?def\s+(\w+)"
BRACKET = r"[()\[\]{}]"
# The next three are matched where the inside of brackets is blank: see top_level.
TRANSACTION = (
    r"^\s*(?:async\s+)?with\b[\s\S]*?\b(?:" + "|".join(fv.TRANSACTION_NAMES) + r")\s*\( *\)\s*(?:as\b|,|:)"
)
GROUPED_WITH = r"^\s*(?:async\s+)?with\s*\( *\)\s*:"
HEADER = (
    r"^\s*(?:(?:async\s+)?(?:def|with|for)\b|(?:class|if|elif|while|match|case|except)\b|(?:else|try|finally)\s*(?=:))[^:;]*:(?!=)"
)
TRY = r"^\s*(?:try\s*:|except\b|finally\s*:)"
ELSE = r"^\s*else\s*:"
# A line that begins like this starts a statement, whatever brackets are open.
STARTER = (
    r"^\s*(?:(?:async\s+)?(?:def|class|with)\b|@\w|(?:try|finally|else)\s*:|(?:except|return|raise|import|pass)\b)"
)


def mask_literals(text: Column) -> Column:
    """Blank out comments and string contents; places and \\n breaks stay the same."""
    def spaces(x: Column) -> Column:
        return F.repeat(F.lit(" "), F.length(x))

    def formatted(hit: Column) -> Column:
        """Fields become brackets around their expression; everything else is blank."""
        body = F.replace(F.replace(hit, F.lit("{{"), F.lit("  ")), F.lit("}}"), F.lit("  "))
        lines = lambda x: F.regexp_replace(x, r"[^\n]", " ")
        fields = F.zip_with(
            F.regexp_extract_all(body, F.lit(FIELD), F.lit(1)), F.regexp_extract_all(body, F.lit(FIELD), F.lit(2)),
            lambda e, f: F.concat(F.lit("("), e, lines(f), F.lit(")")),
        )
        return F.array_join(
            F.zip_with(F.split(body, FIELD, -1), fields, lambda t, f: F.concat(lines(t), F.coalesce(f, F.lit("")))), ""
        )

    def blank(hit: Column) -> Column:
        quote = F.substring(hit, 1, 1)
        long = F.array_join(F.transform(F.split(hit, "\n", -1), spaces), "\n")
        return (
            F.when(hit.startswith("#"), spaces(hit))
            .when(hit.rlike("^[fFrR]"), formatted(hit))
            .when(
                hit.startswith('"""') | hit.startswith("'''"),
                F.concat(F.lit('""'), F.substr(long, F.lit(3))),
            )
            .otherwise(F.concat(quote, F.repeat(F.lit(" "), F.length(hit) - 2), quote))
        )

    return rewrite_matches(text, LITERAL, blank)


def top_level(code: Column) -> Column:
    """The code with all that stands inside brackets blank, however deep they nest; of the same length."""
    marks = F.regexp_extract_all(code, F.lit(f"({BRACKET})"), F.lit(1))
    pairs = F.zip_with(
        F.split(code, BRACKET, -1), marks, lambda t, m: F.struct(t.alias("text"), F.coalesce(m, F.lit("")).alias("mark"))
    )
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(state: Column, x: Column) -> Column:
        depth, mark = state["depth"], x["mark"]
        after = F.when(mark == "", depth).when(mark.isin("(", "[", "{"), depth + 1).otherwise(F.greatest(depth - 1, F.lit(0)))
        return F.struct(
            after.alias("depth"),
            F.concat(
                state["out"], F.when(depth == 0, x["text"]).otherwise(F.repeat(F.lit(" "), F.length(x["text"]))),
                F.when((mark == "") | (F.least(depth, after) == 0), mark).otherwise(F.lit(" ")),
            ).alias("out"),
        )

    return F.aggregate(pairs, start, step, lambda state: state["out"])


def opens_transaction(code: Column) -> Column:
    """A ``with`` one of whose items begins a transaction; items may stand in brackets."""
    top = top_level(code)
    inside = F.regexp_extract(code, r"with\s*\(([\s\S]*)\)\s*:", 1)
    grouped = top.rlike(GROUPED_WITH) & top_level(F.concat(F.lit("with "), inside, F.lit(":"))).rlike(TRANSACTION)
    return F.when(code.rlike(r"^\s*(?:async\s+)?with\b"), top.rlike(TRANSACTION) | grouped).otherwise(F.lit(False))


def pieces(code: Column) -> Column:
    """Simple statements of a logical one: what ``;`` and the colon of a one-line block part.

    An array of (code, top, row, col): the piece, its ``top_level`` and the line and
    column it starts on, from 0. The header of a block is no piece.
    """
    def parted(top: Column) -> Column:
        head = F.length(F.regexp_extract(top, HEADER, 0))
        cut = F.struct(head.alias("head"), F.split(F.substr(top, head + 1), ";", -1).alias("segments"))
        return let(cut, lambda x: F.transform(x["segments"], lambda segment, i: piece(x["head"], x["segments"], segment, i)))

    def piece(head: Column, segments: Column, segment: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(segments, F.lit(1), i), head, lambda n, x: n + F.length(x) + 1)
        own = F.substr(code, before + 1, F.length(segment))
        up_to = F.concat(F.substr(code, F.lit(1), before), F.regexp_extract(own, r"^\s*", 0))
        return F.struct(
            own.alias("code"), segment.alias("top"), F.length(F.regexp_replace(up_to, r"[^\n]", "")).alias("row"),
            F.length(F.regexp_extract(up_to, r"[^\n]*$", 0)).alias("col"),
        )

    return F.filter(let(top_level(code), parted), lambda p: p["top"].rlike(r"\S"))


def explode_lines(files: DataFrame, *, source_col="source") -> DataFrame:
    """One row per line: ``line_no``, ``text``, masked ``code`` and ``indent``."""
    kept = [c for c in files.columns if c != source_col]
    split = fixed(files.select(*kept, source_col), _lines=split_lines(F.col(source_col)))
    joined = fixed(split.drop(source_col), _text=F.array_join("_lines", "\n"))
    masked = fixed(joined, _code=mask_literals(F.col("_text")))
    zipped = F.arrays_zip(F.col("_lines").alias("text"), F.split("_code", "\n", -1).alias("code"))
    rows = masked.select(*kept, F.posexplode(zipped).alias("_pos", "_line"))
    lead = F.regexp_replace(F.regexp_extract(F.col("_line.code"), r"^[ \t]*", 0), "\t", " " * 8)
    return rows.where(F.col("_line.text").isNotNull()).select(
        *kept,
        (F.col("_pos") + 1).alias("line_no"),
        F.col("_line.text").alias("text"),
        F.col("_line.code").alias("code"),
        F.length(lead).alias("indent"),
    )


def statements(files: DataFrame, *, source_col="source") -> DataFrame:
    """Logical statements: lines joined while a bracket or a backslash is open.

    ``parts`` holds the lines (line_no, code, text); ``code`` joins the masked
    lines with \\n. Lines without code drop out.
    """
    by_file = by_key(files.select("file_id", source_col), "file_id")
    lines = explode_lines(by_file, source_col=source_col).where(F.col("code").rlike(r"\S"))
    count = lambda chars: F.length(F.regexp_replace("code", f"[^{chars}]", ""))
    lines = lines.withColumns(
        {
            "_delta": count(r"(\[{") - count(r")\]}"),
            "_starter": F.col("code").rlike(STARTER),
            "_open_end": F.col("code").rlike(r"\\\s*$"),
        }
    )
    w = Window.partitionBy("file_id").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumns(
        {
            "_depth": F.coalesce(F.sum("_delta").over(before), F.lit(0)),
            "_joined": F.coalesce(F.lag("_open_end").over(w), F.lit(False)),
        }
    )
    base = F.last(F.when(F.col("_starter"), F.col("_depth")), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    lines = lines.withColumn("_depth", F.col("_depth") - F.coalesce(base, F.lit(0)))
    starts = F.col("_starter") | ((F.col("_depth") <= 0) & ~F.col("_joined"))
    lines = lines.withColumn(
        "stmt", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    )
    out = lines.groupBy("file_id", "stmt").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "code", "text"))).alias("parts"),
        F.min_by("indent", "line_no").alias("indent"),
    )
    code = F.array_join(F.transform("parts", lambda p: p["code"]), "\n")
    out = out.select(
        "file_id",
        "stmt",
        F.col("parts")[0]["line_no"].alias("line_start"),
        F.element_at("parts", -1)["line_no"].alias("line_end"),
        "indent",
        code.alias("code"),
        "parts",
    )
    c = F.col("code")
    kind = (
        F.when(c.rlike(DEF), "def").when(opens_transaction(c), "txn").when(c.rlike(TRY), "try")
        .when(c.rlike(ELSE), "else")
    )
    return out.withColumns({"kind": kind, "name": F.regexp_extract(c, DEF, 1)})


def _levels(stmts: DataFrame, carried: list[str]) -> DataFrame:
    """Statements once per indent at which the file opens a block (and once as level -1).

    At level k only statements indented by at most k can open or end a block,
    so the block around a deeper statement is found by looking back to the last
    of them. Wide columns ride on level -1 only.
    """
    opens = F.col("kind").isNotNull() & (F.col("kind") != "else")
    levels = F.collect_set(F.when(opens, F.col("indent"))).over(Window.partitionBy("file_id"))
    rows = stmts.withColumn("_ks", levels)
    rows = rows.withColumn("_k", F.explode(F.concat(F.array(F.lit(-1)), F.col("_ks")))).drop("_ks")
    rows = rows.withColumns({c: F.when(F.col("_k") == -1, F.col(c)) for c in carried})
    w = (
        Window.partitionBy("file_id", "_k").orderBy("stmt")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    at_level = F.col("indent") <= F.col("_k")
    last = F.last(F.when(at_level, F.struct("indent", "kind")), ignorenulls=True).over(w)
    rows = rows.withColumn("_last", last)
    after_try = (F.col("_last.kind") == "try") & (F.col("_last.indent") == F.col("indent"))
    rows = rows.withColumn(
        "_kind", F.when(F.col("kind") == "else", F.when(after_try, "try")).otherwise(F.col("kind"))
    )
    return rows


def block_spans(files: DataFrame, *, source_col="source") -> DataFrame:
    """def / txn / try blocks: first line and the line that ends them (NULL at the end)."""
    rows = _levels(statements(files, source_col=source_col).drop("parts", "code"), [])
    inside = rows.where(F.col("indent") <= F.col("_k"))
    w = Window.partitionBy("file_id", "_k").orderBy("stmt")
    ended = inside.withColumn("end_before", F.lead("line_start").over(w))
    return ended.where((F.col("indent") == F.col("_k")) & F.col("_kind").isNotNull()).select(
        "file_id", F.col("_kind").alias("kind"), "name", "line_start", "end_before"
    )


def in_block(files: DataFrame, *, source_col="source") -> DataFrame:
    """Statements with the innermost ``function`` and the ``txn_depth`` and ``try_depth`` around them."""
    wide = ["code", "parts"]
    rows = _levels(statements(files, source_col=source_col), wide)
    w = (
        Window.partitionBy("file_id", "_k").orderBy("stmt")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    opener = F.struct("stmt", "indent", F.col("_kind").alias("kind"), "name")
    head = F.last(F.when(F.col("indent") <= F.col("_k"), opener), ignorenulls=True).over(w)
    rows = rows.withColumn("_head", head)
    around = (F.col("indent") > F.col("_k")) & (F.col("_head.indent") == F.col("_k"))
    kind = F.when(around, F.col("_head.kind"))
    return rows.groupBy("file_id", "stmt").agg(
        F.first("line_start").alias("line_start"),
        F.first("line_end").alias("line_end"),
        F.first("indent").alias("indent"),
        F.first("kind").alias("kind"),
        F.first("name").alias("name"),
        *[F.first(c, ignorenulls=True).alias(c) for c in wide],
        F.max_by(F.when(kind == "def", F.col("_head.name")), F.when(kind == "def", F.col("_head.stmt"))).alias("function"),
        F.count_if(kind == "txn").alias("txn_depth"),
        F.count_if(kind == "try").alias("try_depth"),
        F.bool_or(F.col("_kind").eqNullSafe("try")).alias("of_try"),
    )
