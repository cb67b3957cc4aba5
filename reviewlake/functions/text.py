"""Column helpers for text: lines, masks, hashes and word tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The line breaks that end a line of text, in a form Java regex and RE2 both read.
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x{85}\x{2028}\x{2029}]"
OTHER_BREAKS = ["\r", "\x0b", "\f", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]  # all but \n


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def contains_any(text: Column, words) -> Column:
    return any_of([text.contains(w) for w in words])


def split_lines(text: Column) -> Column:
    """Array of lines; a final line break opens no further line.

    Only the last two characters are looked at for it, and the pattern of all breaks is
    for texts that hold another one than \\n: a single character is found without a regex.
    """
    rest = F.length(text) - 2
    end = F.regexp_replace(F.right(text, F.lit(2)), rf"(?:{LINE_BREAK})\z", "")
    body = F.concat(F.left(text, rest), end)
    pattern = F.when(~contains_any(text, OTHER_BREAKS), "\n").otherwise(LINE_BREAK)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, pattern, -1))


def sha_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def rewrite_matches(text: Column, pattern: str, rewrite) -> Column:
    """Replace each match of ``pattern`` by ``rewrite(match)``.

    The pieces between the matches and the matches themselves are zipped back
    together, so no marker has to be put into the text.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    joined = F.array_join(
        F.zip_with(
            pieces,
            hits,
            lambda piece, hit: F.concat(piece, F.coalesce(rewrite(hit), F.lit(""))),
        ),
        "",
    )
    return F.when(text.rlike(pattern), joined).otherwise(text)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used, inside lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def settle(df: DataFrame, *computed: str) -> DataFrame:
    """Fix the ``computed`` columns where they are.

    Catalyst pushes a later filter on a column below the projection that makes
    it, by copying the expression. For columns made by a chain of regex passes
    that would repeat the whole chain inside the filter. It also inlines a column
    into the lambda of an array function, which then works it out per element. A
    generator of one row keeps the finished values.
    """
    kept = [c for c in df.columns if c not in computed]
    return df.select(*kept, F.inline(F.array(F.struct(*computed))))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns and settle them."""
    return settle(df.withColumns(columns), *columns)
