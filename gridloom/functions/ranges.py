"""Text of a cell range as a table function: ``SELECT … FROM refs, LATERAL range_pieces(ref, sheet)``.

A range is handed back as lines along its shorter side, each cut into aligned pieces of 1, 16, 256 … places, so a
whole column is two rows and not a million cells. :func:`holder_levels` gives a cell's piece of each size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

# Size of a sheet.
LAST_ROW, LAST_COLUMN = 1_048_576, 16_384
#: Stretches of rows or columns are cut into aligned pieces of 1, 16, 256 ... of them.
STEP = 16
PIECE_TYPE = "sheet string, down boolean, line int, level int, piece bigint"
_CORNER = re.compile(r"([A-Z]*)([0-9]*)")


def levels(last: int) -> int:
    """Number of piece sizes on a side of ``last`` places."""
    count = 1
    while STEP ** (count - 1) <= last:
        count += 1
    return count


def aligned_pieces(first: int, last: int, end: int) -> Iterator[tuple[int, int]]:
    """``level, piece`` of the fewest aligned pieces over ``first..last``; a range to the end may reach beyond it."""
    if 1 < first == last < end:
        yield 0, first
        return
    at, top = 0 if first <= 1 else first, levels(end)
    last = STEP**top - 1 if last >= end else last
    while at <= last:
        level = 0
        while level + 1 < top and at % STEP ** (level + 1) == 0 and at + STEP ** (level + 1) - 1 <= last:
            level += 1
        yield level, at // STEP**level
        if at + STEP**level > end:
            return
        at += STEP**level


def _number(letters: str) -> int:
    total = 0
    for letter in letters:
        total = total * 26 + ord(letter) - 64
    return total


def range_bounds(text: str) -> tuple[int, int, int, int] | None:
    """First and last row and column of ``A1``, ``A1:B9``, ``A:B`` or ``3:5``; None for any other text."""
    corners = [_CORNER.fullmatch(part.strip().upper()) for part in text.replace("$", "").split(":")]
    if len(corners) > 2 or not all(c and c.group(0) for c in corners):
        return None
    kinds = {(bool(c.group(1)), bool(c.group(2))) for c in corners}
    if len(kinds) > 1 or (len(corners) == 1 and kinds != {(True, True)}):
        return None
    cols = sorted(_number(c.group(1)) for c in corners if c.group(1)) or [1, LAST_COLUMN]
    rows = sorted(int(c.group(2)) for c in corners if c.group(2)) or [1, LAST_ROW]
    if rows[0] < 1 or rows[-1] > LAST_ROW or cols[-1] > LAST_COLUMN:
        return None
    return rows[0], rows[-1], cols[0], cols[-1]


class RangePieces:
    """A range without a sheet lies on ``sheet``; text that is no range, or NULL, gives no rows."""

    def eval(self, ref: str, sheet: str):
        if ref is None:
            return
        before, _, area = ref.rpartition("!")
        bounds = range_bounds(area)
        if bounds is None:
            return
        sheet = before.strip("'").replace("''", "'") if before else sheet
        r1, r2, c1, c2 = bounds
        down = r2 - r1 >= c2 - c1
        along, across, end = ((r1, r2), (c1, c2), LAST_ROW) if down else ((c1, c2), (r1, r2), LAST_COLUMN)
        pieces = list(aligned_pieces(*along, end))
        for line in range(across[0], across[1] + 1):
            for level, piece in pieces:
                yield sheet, down, line, level, piece


def register_ranges(spark: SparkSession, name: str = "range_pieces") -> str:
    """Make the table function known to SQL under ``name``."""
    spark.udtf.register(name, udtf(RangePieces, returnType=PIECE_TYPE))
    return name
