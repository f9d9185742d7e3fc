"""Number parsing, rounding and spreadsheet arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Currency symbols and codes that are stripped before a number is read.
CURRENCY_SYMBOLS = "$€£¥₩₽₹₺₫₱₦₴₪₡₲₵₸"
CURRENCY_CODES = ("USD", "EUR", "GBP", "JPY", "MXN", "COP", "CLP", "PEN", "BRL", "ARS", "CAD", "AUD")

_PLAIN_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SKIPPED = "% \t\r\n\f\u000b\u00a0" + CURRENCY_SYMBOLS
_CODES = rf"(?i){'|'.join(CURRENCY_CODES)}"


def parse_locale_number(text: Column) -> Column:
    """Read a number written in any common locale as a double.

    The later of ``.`` and ``,`` is the decimal separator; a trailing ``%`` divides by 100; blank
    text is 0; unreadable text is NULL, so that callers can report it.
    """
    raw = F.trim(text)
    cleaned = F.regexp_replace(F.translate(raw, _SKIPPED, ""), _CODES, "")
    with_dot = F.when(
        cleaned.rlike(r",[^.,]*$"), F.translate(cleaned, ",.", ".")
    ).otherwise(F.translate(cleaned, ",", ""))
    number = F.regexp_extract(with_dot, _PLAIN_NUMBER, 0).try_cast("double")
    divisor = F.when(F.endswith(raw, F.lit("%")), F.lit(100.0)).otherwise(F.lit(1.0))
    # A plain number is read at once; only other text is cleaned first, which takes several patterns.
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit(0.0)).when(raw.rlike(_PLAIN_NUMBER), raw.try_cast("double")).otherwise(
        number / divisor
    )


def number_or_zero(text: Column) -> Column:
    """Spreadsheet coercion: anything that is not a number counts as 0."""
    return F.coalesce(parse_locale_number(text), F.lit(0.0))


def to_decimal(text: Column) -> Column:
    """Text to DECIMAL(19,4); bad text is NULL."""
    value = F.trim(text)
    return F.when(value.rlike(_PLAIN_NUMBER), value.try_cast("decimal(19,4)"))


def to_bigint(text: Column) -> Column:
    """Whole numbers to BIGINT; anything else is NULL."""
    value = F.trim(text)
    return F.when(value.rlike(r"^[+-]?[0-9]+$"), value.try_cast("bigint"))


# Words read as booleans.
TRUE_WORDS = ("true", "t", "yes", "y", "1", "si", "sí", "verdadero")
FALSE_WORDS = ("false", "f", "no", "n", "0", "falso")


def to_boolean(text: Column) -> Column:
    word = F.lower(F.trim(text))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def numeric_guard(text: Column) -> Column:
    """Unsigned digits with an optional fraction: the load guard for quantities and prices."""
    return text.rlike(r"^[0-9]+\.?[0-9]*$")


def integer_guard(text: Column) -> Column:
    return text.rlike(r"^[0-9]+$")


def not_blank(text: Column) -> Column:
    return text.isNotNull() & (text != "")


def rounded_int(text: Column) -> Column:
    """Numeric text to INT, halves away from zero (a plain cast would truncate)."""
    return F.round(text.try_cast("decimal(19,4)"), 0).cast("int")


def round_half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def round_half_up(value: Column, digits: int = 0) -> Column:
    return F.round(value, digits)


def _directed(value: Column, digits: int, step) -> Column:
    factor = F.lit(10**digits)
    return F.signum(value) * step(F.abs(value) * factor).cast("double") / factor.cast("double")


def round_up(value: Column, digits: int = 0) -> Column:
    """Away from zero. Give a decimal to keep the scaling exact."""
    return _directed(value, digits, F.ceil)


def round_down(value: Column, digits: int = 0) -> Column:
    """Towards zero. Give a decimal to keep the scaling exact."""
    return _directed(value, digits, F.floor)


def safe_divide(a: Column, b: Column) -> Column:
    """Division where a zero divisor gives 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def if_error(value: Column, fallback: Column) -> Column:
    """NULL and NaN become ``fallback``."""
    return F.when(value.isNull() | F.isnan(value), fallback).otherwise(value)


def flatten_numbers(nested: Column) -> Column:
    """Nested ranges of text to one array of numbers, non-numbers as 0."""
    return F.transform(F.flatten(nested), number_or_zero)


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
