"""Names and references inside spreadsheet formulas, and cell addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Functions whose targets are not visible in the text of the formula.
UNSUPPORTED_FUNCTIONS = ("INDIRECT", "OFFSET", "ADDRESS")

_CELL = r"\$?[A-Z]{1,3}\$?[0-9]+"
_SHEET = r"(?:'[^']+'!|[A-Za-z0-9_]+!)?"
_LINES = r"\$?[A-Z]{1,3}:\$?[A-Z]{1,3}|\$?[0-9]+:\$?[0-9]+"
_REFERENCE = rf"(?<![A-Za-z0-9_.$:!'])({_SHEET}(?:{_CELL}(?::{_CELL})?|{_LINES}))(?![A-Za-z0-9_(:!])"


def _without_strings(formula: Column) -> Column:
    return F.when(F.contains(formula, F.lit('"')), F.regexp_replace(formula, '"[^"]*"', '""')).otherwise(formula)


def formula_functions(formula: Column) -> Column:
    """Distinct function names in order of first use."""
    return F.array_distinct(
        F.regexp_extract_all(F.upper(_without_strings(formula)), F.lit(r"([A-Z][A-Z0-9_]*)\s*\("), 1)
    )


def formula_references(formula: Column, sheet: Column) -> Column:
    """Distinct references, each with its sheet and without ``$``; ranges stay ranges."""
    found = F.regexp_extract_all(_without_strings(formula), F.lit(_REFERENCE), 1)
    plain = F.transform(found, lambda r: F.translate(r, "$'", ""))
    return F.array_distinct(
        F.transform(plain, lambda r: F.when(F.contains(r, F.lit("!")), r).otherwise(F.concat(sheet, F.lit("!"), r)))
    )


def formula_names(formula: Column) -> Column:
    """Distinct words of a formula, in capitals, that may be defined names: no function and no reference."""
    found = F.regexp_extract_all(
        F.upper(_without_strings(formula)), F.lit(r"(?<![A-Z0-9_.$!:'])([A-Z_\\][A-Z0-9_.]*)(?![A-Z0-9_.(!:'])"), 1
    )
    return F.array_distinct(F.filter(found, lambda n: ~n.rlike(r"^[A-Z]{1,3}[0-9]+$")))


def column_index(letters: Column) -> Column:
    """1-based column number of one to three letters, ``A``…``XFD``; NULL for any other number of letters."""
    # A place without a letter holds the character before ``A`` and counts 0.
    padded = F.lpad(F.upper(letters), 3, "@")
    digit = lambda place: F.ascii(F.substring(padded, place, 1)) - 64
    # Picked by place and not by a condition: what only a branch needs is not shared, and the letters were found anew each time.
    return F.get(F.array(digit(1) * 676 + digit(2) * 26 + digit(3)), F.when(F.length(letters).between(1, 3), 0))


def column_letters(index: Column) -> Column:
    """Letters of a 1-based column number, up to three letters as in a workbook."""
    zero = index - 1
    last = F.chr(65 + zero % 26)
    middle = F.chr(65 + (F.floor(zero / 26) - 1) % 26)
    first = F.chr(65 + (F.floor((zero - 26) / 676) - 1) % 26)
    return F.concat(
        F.when(zero >= 702, first).otherwise(""), F.when(zero >= 26, middle).otherwise(""), last
    )


def address_row(address: Column) -> Column:
    return F.regexp_extract(address, r"([0-9]+)$", 1).try_cast("int")


def address_column(address: Column) -> Column:
    return column_index(F.regexp_extract(address, r"([A-Za-z]+)\$?[0-9]+$", 1))
