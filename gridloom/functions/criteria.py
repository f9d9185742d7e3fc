"""Spreadsheet criteria such as ``">=10"`` or ``"abc*"`` as boolean columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.functions.numbers import parse_locale_number, safe_divide

_OPERATORS = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "<>": lambda a, b: a != b,
    "=": lambda a, b: a == b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
}


def _number(text: Column) -> Column:
    return F.when(F.trim(text) != "", parse_locale_number(text))


def _as_float(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def criteria_match(value: Column, criterion: str | int | float | None, numeric: bool = False) -> Column:
    """Does ``value`` meet ``criterion``? Never NULL. ``numeric`` says that ``value`` is a number
    already, which saves reading it as text.

    A number compares by value. Text with a leading operator compares as numbers when both sides
    are numbers and as text otherwise; ``*`` matches any run of characters, ignoring case; other
    text must be equal.
    """
    if criterion is None:
        return F.lit(False)
    text = value.cast("string")
    number = value.cast("double") if numeric else _number(text)
    if isinstance(criterion, (int, float)):
        return F.coalesce(number == F.lit(float(criterion)), F.lit(False))
    split = re.match(r"(>=|<=|<>|=|>|<)(.*)$", criterion, re.S)
    sign, operand = split.groups() if split else (None, criterion)
    operand = operand.strip('"') if len(operand) > 1 else operand
    if "*" in operand:
        pattern = operand.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
        like = F.coalesce(text, F.lit("")).ilike(pattern.replace("*", "%"))
        return ~like if sign == "<>" else like
    if sign is None:
        return F.coalesce(text == F.lit(operand), F.lit(False))
    compare = _OPERATORS[sign]
    as_text = compare(F.coalesce(text, F.lit("")), F.lit(operand))
    wanted = _as_float(operand)
    if wanted is None:
        return as_text
    return F.coalesce(compare(number, F.lit(wanted)), as_text)


def _all(pairs: tuple[tuple, ...]) -> Column:
    return reduce(lambda a, b: a & b, [criteria_match(*pair) for pair in pairs])


def sum_ifs(values: Column, *pairs: tuple[Column, object]) -> Column:
    """Sum of ``values`` where every (column, criterion[, numeric]) matches; 0 when none does."""
    return F.coalesce(F.sum(F.when(_all(pairs), values)), F.lit(0))


def count_ifs(*pairs: tuple[Column, object]) -> Column:
    return F.count_if(_all(pairs))


def average_ifs(values: Column, *pairs: tuple[Column, object]) -> Column:
    """Mean of ``values`` over matching rows; 0 when none matches."""
    hit = _all(pairs)
    total = F.sum(F.when(hit, values)).cast("double")
    return safe_divide(total, F.count(F.when(hit, values)).cast("double"))
