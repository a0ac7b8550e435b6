"""Numeric columns: rounding, integer parsing, full-width folding."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def round_to(value: Column, digits: int) -> Column:
    """Round half up by scaling, so every engine that follows IEEE 754 gives the same double."""
    scale = float(10**digits)
    return F.floor(value * scale + 0.5).cast("double") / scale


def unit_cents(total: Column, quantity: Column) -> Column:
    """total / quantity in whole cents, half up, in integer arithmetic."""
    cents = F.round(total * 100).cast("bigint")
    pieces = quantity.cast("bigint")
    return F.floor((cents * 2 + pieces) / (pieces * 2)).cast("bigint")


# The full-width forms U+FF01..U+FF5E lie 0xFEE0 above ASCII '!'..'~'; U+3000 is the wide space.
FULL_WIDTH = "".join(chr(code + 0xFEE0) for code in range(ord("!"), ord("~") + 1)) + "　"
HALF_WIDTH = "".join(chr(code) for code in range(ord("!"), ord("~") + 1)) + " "


WIDE_DIGITS = FULL_WIDTH[HALF_WIDTH.index("0") : HALF_WIDTH.index("9") + 1]


def fold_width(text: Column) -> Column:
    """Full-width characters to ASCII, inside the JVM."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


# Every character that counts as white space.
WHITE_SPACE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.trim(text, F.lit(WHITE_SPACE))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """General Unicode compatibility folding, for the few rows that width folding cannot serve."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def needs_nfkc(text: Column) -> Column:
    """Whether width folding may not be all that compatibility folding does to a text."""
    return F.coalesce(text.rlike("[^\\x00-\\x7F\\uFF01-\\uFF5E\\u3000]"), F.lit(False))


def strict_positive_integer(text: Column) -> Column:
    """Digits only, greater than zero; anything else is null. Full-width digits are digits too."""
    digits = F.translate(strip(text), WIDE_DIGITS, "0123456789")
    return F.when(digits.rlike(r"^[0-9]+$"), positive_int(digits))


def positive_int(digits: Column) -> Column:
    number = digits.try_cast("int")
    return F.when(number > 0, number)


# The spellings of a quantity that can be repaired.
GROUPED, DECIMAL_ZERO, DIGITS = r"^[1-9]\d{0,2}(?:,\d{3})+$", r"^\d+\.0+$", r"^\d+$"


def repaired_quantity(text: Column) -> Column:
    """'1,200', '800.0' and full-width digits to a positive integer; anything else is null."""
    folded = strip(fold_width(text))
    plain = (
        F.when(folded.rlike(GROUPED), F.regexp_replace(folded, ",", ""))
        .when(folded.rlike(DECIMAL_ZERO), F.regexp_extract(folded, r"^(\d+)", 1))
        .when(folded.rlike(DIGITS), folded)
    )
    return positive_int(plain)


def strict_iso_date(text: Column) -> Column:
    """YYYY-MM-DD only."""
    day = strip(text)
    return F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd"))


# The date spellings that can be repaired, with their Spark parse formats.
DATE_SPELLINGS: tuple[tuple[str, str], ...] = (
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d"),
    (r"^\d{4}年\d{1,2}月\d{1,2}日$", "yyyy年M月d日"),
    (r"^\d{8}$", "yyyyMMdd"),
)


def repaired_date(text: Column) -> Column:
    """One of the known spellings to a date; an impossible day is null."""
    day = strip(text)
    parsed = None
    for pattern, layout in DATE_SPELLINGS:
        hit = F.when(day.rlike(pattern), F.try_to_date(day, layout))
        parsed = hit if parsed is None else F.coalesce(parsed, hit)
    return parsed


def repaired_key(text: Column, folded: Column | None = None) -> Column:
    """Folded, trimmed, upper-case key; null when that changes nothing or leaves nothing. `folded` is the
    text after a wider folding."""
    key = F.upper(strip(fold_width(text if folded is None else folded)))
    return F.when((key != "") & (key != text), key)
