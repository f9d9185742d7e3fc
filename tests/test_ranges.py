"""Ranges as text: the table function against plain expansion."""

import random

from gridloom.functions import ranges
from gridloom.operators import grid


def test_pieces_cover_exactly():
    rng = random.Random(1)
    end = 5000
    for _ in range(300):
        a, b = sorted((rng.randrange(1, end + 1), rng.randrange(1, end + 1)))
        places = sorted(p for level, piece in ranges.aligned_pieces(a, b, end) for p in range(piece * 16**level, (piece + 1) * 16**level))
        assert len(set(places)) == len(places)
        assert [p for p in places if 1 <= p <= end] == list(range(a, b + 1))
    assert len(list(ranges.aligned_pieces(1, ranges.LAST_ROW, ranges.LAST_ROW))) <= 2
    assert max(len(list(ranges.aligned_pieces(2, n, ranges.LAST_ROW))) for n in range(3, 5000)) <= 100


def test_bounds_of_text():
    assert ranges.range_bounds("b3") == (3, 3, 2, 2)
    assert ranges.range_bounds("$C$9:A$2") == (2, 9, 1, 3)
    assert ranges.range_bounds("AA:Z") == (1, ranges.LAST_ROW, 26, 27)
    assert ranges.range_bounds("7:5") == (5, 7, 1, ranges.LAST_COLUMN)
    for text in ("", "A", "3", "A1:B", "A1:B2:C3", "Rate", "A0", "A1048577", "XFE1", "1A"):
        assert ranges.range_bounds(text) is None


def letters(n):
    out = ""
    while n:
        n, rest = divmod(n - 1, 26)
        out = chr(65 + rest) + out
    return out


def test_range_text_against_plain_expansion(spark):
    rng = random.Random(2)
    filled = {(s, rng.randrange(1, 60), rng.randrange(1, 40)) for s in ("S", "My sheet") for _ in range(500)}
    filled |= {("S", r, 3) for r in range(1, 3000)} | {("S", 1_048_576, 1), ("S", 5, 16_384)}
    cells = spark.createDataFrame([(s, r, c, f"{s}!{letters(c)}{r}") for s, r, c in filled], "sheet string, row int, col int, address string")
    asked = ["A1", "C:C", "5:5", "B2:F9", "'My sheet'!A1:D50", "a1:$XFD$7", "A:XFD", "nothing", "", None, "C1:C2999", "My sheet!4:9"]
    asked += [f"{letters(rng.randrange(1, 40))}{rng.randrange(1, 60)}:{letters(rng.randrange(1, 40))}{rng.randrange(1, 60)}" for _ in range(40)]
    # A whole sheet is a thousand lines and more, so it is asked for once.
    refs = spark.createDataFrame([(f"t{i}", a, "S") for i, a in enumerate(asked)], "target string, ref string, sheet string")
    found = sorted((r["target"], r["source"]) for r in grid.range_text_members(refs, cells).collect())
    want = []
    for i, text in enumerate(asked):
        bounds = ranges.range_bounds((text or "").rpartition("!")[2])
        sheet = "My sheet" if text and "My" in text else "S"
        if bounds:
            r1, r2, c1, c2 = bounds
            want += [(f"t{i}", f"{s}!{letters(c)}{r}") for s, r, c in filled if s == sheet and r1 <= r <= r2 and c1 <= c <= c2]
    assert found == sorted(want)


def test_table_function_alone(spark):
    name = ranges.register_ranges(spark, "pieces_of")
    rows = spark.sql(f"SELECT * FROM {name}('T!D2:D8', 'S')").collect()
    assert {tuple(r) for r in rows} == {("T", True, 4, 0, p) for p in range(2, 9)}
    assert spark.sql(f"SELECT * FROM {name}(CAST(NULL AS STRING), 'S')").count() == 0


def test_reference_parsing_is_compiled(spark):
    # Java leaves methods of more than 8000 bytes uncompiled, many times slower.
    import contextlib
    import io
    import re

    cells = spark.createDataFrame(
        [("S", "S!A1", "=SUM(B1:C9)+D1")], "sheet string, address string, formula string"
    )
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        grid.cell_references(cells).explain("codegen")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", shown.getvalue())]
    assert sizes and max(sizes) < 8000


def test_members_of_short_and_long_ranges(spark):
    filled = [(r, c) for r in (1, 2, 15, 16, 17, 18, 40, 300) for c in (1, 2, 3, 17, 18, 30)]
    cells = spark.createDataFrame(
        [("S", r, c, f"{r},{c}") for r, c in filled], "sheet string, row int, col int, address string"
    )
    areas = {
        "one": (2, 2, 3, 3), "short": (1, 16, 1, 2), "edge": (1, 17, 2, 2), "long": (2, 300, 1, 3),
        "flat": (1, 2, 2, 17), "wide": (15, 17, 1, 30), "empty": (50, 60, 1, 1),
    }
    refs = spark.createDataFrame(
        [("S!Z9", n, "S", *a) for n, a in areas.items()],
        "target string, ref string, ref_sheet string, r1 int, r2 int, c1 int, c2 int",
    )
    found = sorted((x.ref, x.source) for x in grid.range_members(refs, cells).collect())
    assert found == sorted(
        (n, f"{r},{c}") for n, (r1, r2, c1, c2) in areas.items() for r, c in filled if r1 <= r <= r2 and c1 <= c <= c2
    )


def test_an_area_is_expanded_once(spark, monkeypatch):
    """The same areas on many sheets reach the table function once each; sheet names keep their quotes and marks."""
    plans, plain = [], grid.per_key

    def kept(df):
        plans.append(df)
        return plain(df)

    monkeypatch.setattr(grid, "per_key", kept)
    sheets = [f"S{i}" for i in range(300)] + ["It's!odd"]
    cells = spark.createDataFrame([(s, r, 1, f"{s}!A{r}") for s in sheets for r in range(1, 41)], "sheet string, row int, col int, address string")
    quoted = [(s, "'" + s.replace("'", "''") + "'!") for s in sheets]
    asked = [(f"{s}-{i}", before + area, "elsewhere") for s, before in quoted for i, area in enumerate(["A2:A8", "$A$3", "A1:A40"])]
    asked += [("plain", "A2:A3", "S7"), ("none", "S1!", "S7")]
    refs = spark.createDataFrame(asked, "target string, ref string, sheet string")
    found = grid.range_text_members(refs, cells).collect()
    assert plans[0].select("area").distinct().count() == 4 and plans[0].count() == 4
    want = {(f"{s}-{i}", f"{s}!A{r}") for s in sheets for i, rows in enumerate([range(2, 9), [3], range(1, 41)]) for r in rows}
    assert {(r["target"], r["source"]) for r in found} == want | {("plain", "S7!A2"), ("plain", "S7!A3")} and len(found) == len(want) + 2
