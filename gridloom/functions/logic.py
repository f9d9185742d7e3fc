"""Comparisons, branches and logical connectives with spreadsheet defaults."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARISONS = ("=", "<>", ">", "<", ">=", "<=")


def compare(left: Column, operator: str, right: Column) -> Column:
    """The value of ``left operator right``; NULL when a side is NULL, as an empty cell answers no question."""
    found = {
        "=": left == right, "<>": left != right, ">": left > right, "<": left < right, ">=": left >= right, "<=": left <= right,
    }
    if operator not in found:
        raise ValueError(f"unknown comparison {operator!r}; known are {', '.join(COMPARISONS)}")
    return found[operator]


def truth(condition: Column) -> Column:
    """NULL counts as false."""
    return F.coalesce(condition, F.lit(False))


def if_branch(*branches: tuple[Column, Column], otherwise: Column) -> Column:
    """The value of the first branch whose condition holds."""
    picked = reduce(lambda found, b: found.when(truth(b[0]), b[1]), branches[1:], F.when(truth(branches[0][0]), branches[0][1]))
    return picked.otherwise(otherwise)


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, map(truth, conditions))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, map(truth, conditions))


def negated(condition: Column) -> Column:
    return ~truth(condition)
