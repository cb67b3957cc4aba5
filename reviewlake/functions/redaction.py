"""Card and credential redaction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .text import contains_any, rewrite_matches


def luhn_valid(number: Column) -> Column:
    """True when the 13 to 19 digits in ``number`` pass the Luhn check."""
    digits = F.regexp_replace(number, r"[^0-9]", "")
    length = F.length(digits)
    cells = F.filter(F.split(digits, ""), lambda c: c != "")

    def weigh(cell: Column, position: Column) -> Column:
        value = cell.cast("int")
        doubled = value * 2
        return F.when(
            position % 2 == F.size(cells) % 2,
            F.when(doubled > 9, doubled - 9).otherwise(doubled),
        ).otherwise(value)

    total = F.aggregate(F.transform(cells, weigh), F.lit(0), lambda acc, v: acc + v)
    return F.when(length.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def card_hits(text: Column, pattern: str = fv.CARD_PATTERN) -> Column:
    """Luhn-valid card candidates in ``text``."""
    return F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), luhn_valid)


def mask_cards(text: Column, tag: str = fv.REDACTION_TAG, pattern: str = fv.CARD_PATTERN) -> Column:
    return rewrite_matches(
        text, pattern, lambda hit: F.when(luhn_valid(hit), F.lit(tag)).otherwise(hit)
    )


def gate_open(text: Column, gate) -> Column:
    return contains_any(text, gate) if gate else F.lit(True)
