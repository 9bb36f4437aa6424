"""Score text to decimals and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeweave.schema import SCORE_PRECISION, SCORE_SCALE

# White space skipped around numbers, and the accepted number
# forms: an optional sign in front, or a sign behind.
NUMBER_SPACE = "\t\n\x0b\x0c\r "
DIGITS = r"(\d[\d,]*\.?\d*|\.\d+)"
SPACE = r"[\t-\r ]*"
NUMBER = rf"^{SPACE}([+-]?{DIGITS}|{DIGITS}{SPACE}[+-]){SPACE}$"


def is_number(c: Column) -> Column:
    """Whether a cell is a plain number: a sign on either side and thousands
    commas are allowed; no exponent, parentheses or currency sign."""
    return F.rlike(c, F.lit(NUMBER))


def _signed_in_front(c: Column) -> Column:
    """Text of a number without commas, its sign in front."""
    text = F.btrim(F.replace(c, F.lit(",")), F.lit(NUMBER_SPACE))
    sign = F.substring(text, -1, 1)
    in_front = F.concat(sign, F.btrim(text, F.lit(NUMBER_SPACE + "+-")))
    return F.when(sign.isin("+", "-"), in_front).otherwise(text)


def number_value(c: Column, precision: int = SCORE_PRECISION, scale: int = SCORE_SCALE) -> Column:
    """Decimal value of a cell known to be a number, rounded to ``scale``
    places; null where it is too large for the type (see ``number_loss``)."""
    return _signed_in_front(c).try_cast(f"decimal({precision},{scale})")


def number_loss(c: Column, precision: int = SCORE_PRECISION, scale: int = SCORE_SCALE) -> Column:
    """What ``number_value`` loses of a cell known to be a number: ``large``,
    ``places``, or null for nothing."""
    places = F.rtrim(F.regexp_extract(_signed_in_front(c), r"\.(\d*)$", 1), F.lit("0"))
    return F.when(number_value(c, precision, scale).isNull(), F.lit("large")).when(F.length(places) > scale, F.lit("places"))


def parse_score(c: Column, precision: int = SCORE_PRECISION, scale: int = SCORE_SCALE) -> Column:
    """Decimal value of a score cell, or null when the cell is no plain number."""
    return F.when(is_number(c), number_value(c, precision, scale))


def mean(total: Column, count: Column) -> Column:
    """Decimal mean, to as many places as the type leaves."""
    return total / count


def format_score(value: Column) -> Column:
    """At most two places, half away from zero, no trailing zeros."""
    text = F.round(value, 2).cast("decimal(38,2)").cast("string")
    return F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))


def format_mean(total: Column, count: Column) -> Column:
    """The exact mean as ``format_score`` writes it, rounded once: hundredths come from whole divisions."""
    size, n = F.abs(total), count.cast("decimal(20,0)")
    rest = size % n
    parts = rest * F.lit(100)
    left = parts % n
    whole = ((size - rest) / n).cast("decimal(38,0)")
    cents = ((parts - left) / n).cast("decimal(38,0)") + F.when(left * 2 >= n, 1).otherwise(0)
    value = whole.cast("decimal(36,2)") + (cents / 100).cast("decimal(36,2)")
    return format_score(F.when(total < 0, -value).otherwise(value))
