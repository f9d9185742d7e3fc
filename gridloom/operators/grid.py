"""Cells of sheets: references, ranges, neighbours, labels and sections.

A cell table has one row per filled cell:
``sheet, row, col, address, value, value_type, formula, number_format, bold, merged_anchor``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.formulas import (
    column_index,
    column_letters,
    formula_names,
    formula_references,
)
from gridloom.functions.ranges import LAST_COLUMN, LAST_ROW, STEP, register_ranges
from gridloom.functions.ranges import levels as _levels
from gridloom.operators.ordered import carry_last
from gridloom.session import cut_lineage, cut_slices, discard, per_key

_STEP = STEP


def cell_address(sheet: Column, row: Column, col: Column) -> Column:
    return F.concat(sheet, F.lit("!"), column_letters(col), row.cast("string"))


_DIGITS, _LETTERS = string.digits, string.ascii_letters


def _corner(corner: Column) -> tuple[Column, Column]:
    """Row number (NULL for a whole column) and column letters (empty for a whole row) of a corner of a range.

    Trimmed, not matched by pattern: every reference of every formula passes here.
    """
    return F.ltrim(corner, F.lit(_LETTERS)).try_cast("int"), F.rtrim(corner, F.lit(_DIGITS))


def cell_references(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row per distinct reference of a formula cell, with its bounds.

    Whole columns and whole rows are ranges to the end of the sheet. ``names`` gives the areas of defined
    names as ``name, ref``, the reference with its sheet; a name in a formula counts as its area.
    """
    formulas = cells.filter(F.col("formula").isNotNull())
    refs = formulas.select(
        F.col("address").alias("target"),
        F.explode(formula_references(F.col("formula"), F.col("sheet"))).alias("ref"),
    )
    if names is not None:
        used = formulas.select(F.col("address").alias("target"), F.explode(formula_names(F.col("formula"))).alias("_name"))
        known = names.select(F.upper("name").alias("_name"), F.regexp_replace("ref", r"[$']", "").alias("ref"))
        refs = refs.unionByName(used.join(known, "_name").select("target", "ref")).distinct()
    # Step by step: each part is evaluated once a reference, and every generated method stays small enough to be compiled.
    area = F.substring_index("ref", "!", -1)
    corners = refs.select(
        "target", "ref", F.substring_index("ref", "!", 1).alias("ref_sheet"),
        F.substring_index(area, ":", 1).alias("_first"), F.substring_index(area, ":", -1).alias("_last"),
    )
    (ra, la), (rb, lb) = _corner(F.col("_first")), _corner(F.col("_last"))
    parts = corners.select("target", "ref", "ref_sheet", ra.alias("ra"), rb.alias("rb"), la.alias("la"), lb.alias("lb"))
    bounded = parts.select(
        "target", "ref", "ref_sheet",
        F.coalesce("ra", F.lit(1)).alias("ra"), F.coalesce("rb", F.lit(LAST_ROW)).alias("rb"),
        F.coalesce(column_index(F.col("la")), F.lit(1)).alias("ca"), F.coalesce(column_index(F.col("lb")), F.lit(LAST_COLUMN)).alias("cb"),
    )
    return bounded.select(
        "target", "ref", "ref_sheet",
        F.least("ra", "rb").alias("r1"), F.greatest("ra", "rb").alias("r2"),
        F.least("ca", "cb").alias("c1"), F.greatest("ca", "cb").alias("c2"),
    )


def _one_cell() -> Column:
    return (F.col("r1") == F.col("r2")) & (F.col("c1") == F.col("c2"))


def named_cells(refs: DataFrame) -> DataFrame:
    """The cell of every single-cell reference, filled or not."""
    return refs.filter(_one_cell()).select(
        "target", "ref", cell_address(F.col("ref_sheet"), F.col("r1"), F.col("c1")).alias("source"),
        F.col("ref_sheet").alias("sheet"), F.col("r1").alias("row"), F.col("c1").alias("col"),
    )


def _pieces(first: Column, last: Column, end: int) -> Column:
    """Aligned pieces that make up ``first..last``: array of ``level, piece``, at most 30 a level."""
    none = F.array().cast("array<bigint>")
    run = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(none)
    bounds = []
    for level in range(_levels(end)):
        size = _STEP**level
        bounds.append((F.ceil(first / size).cast("bigint"), F.floor((last + 1) / size).cast("bigint") - 1))
    parts = []
    for level, (a, b) in enumerate(bounds):
        if level + 1 < len(bounds):
            up_a, up_b = bounds[level + 1]
            outer = F.concat(
                run(a, F.least(b, up_a * _STEP - 1)), run(F.greatest(a, up_b * _STEP + _STEP), b)
            )
            found = F.when(up_a <= up_b, outer).otherwise(run(a, b))
        else:
            found = run(a, b)
        parts.append(_at_level(found, level))
    return F.concat(*parts)


def _at_level(pieces: Column, level: int) -> Column:
    return F.transform(pieces, lambda p: F.struct(F.lit(level).alias("level"), p.alias("piece")))


def _held(cells: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cells that lie on a line of some range, once for each piece size that ranges use on that line.

    A cell is put on its row and on its column only, two slim rows; the lines in use decide what is kept of them
    before anything is multiplied.
    """
    used = per_key(wanted.groupBy("ref_sheet", "down", "line").agg(F.collect_set("level").alias("_levels")))
    ways = F.array(
        F.struct(F.lit(True).alias("down"), F.col("col").alias("line"), F.col("row").alias("place")),
        F.struct(F.lit(False).alias("down"), F.col("row").alias("line"), F.col("col").alias("place")),
    )
    spots = cells.select(F.col("sheet").alias("ref_sheet"), F.col("address").alias("source"), F.explode(ways).alias("w")).select(
        "ref_sheet", "source", "w.down", "w.line", "w.place"
    )
    size = F.pow(F.lit(_STEP), F.col("level"))
    return (
        spots.join(used, ["ref_sheet", "down", "line"]).withColumn("level", F.explode("_levels"))
        .withColumn("piece", F.floor(F.col("place") / size).cast("bigint"))
        .select(
            "ref_sheet", "source", "down", "line", "level", "piece",
            F.when(F.col("down"), F.col("place")).otherwise(F.col("line")).alias("row"),
            F.when(F.col("down"), F.col("line")).otherwise(F.col("place")).alias("col"),
        )
    )


#: Places in use on any sheet, up to which they choose the cells that can be wanted.
_FEW_PLACES = 100_000


def _at_used_places(cells: DataFrame, places: DataFrame) -> DataFrame:
    """The cells at ``row, col`` of any sheet that ``places`` name, where these are few; else all cells."""
    used = per_key(places.select("row", "col").distinct().limit(_FEW_PLACES + 1))
    return cells.join(used, ["row", "col"], "left_semi") if used.count() <= _FEW_PLACES else cells


def _at_places(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """The filled cells at places ``ref_sheet, row, col`` of ranges; ``wanted`` is read twice."""
    held = _at_used_places(cells, wanted).select(F.col("sheet").alias("ref_sheet"), "row", "col", F.col("address").alias("source"))
    # A packed table is many times its files' size in memory, which Spark would judge it by: never a broadcast.
    held = held.hint("shuffle_merge")
    return wanted.join(held, ["ref_sheet", "row", "col"]).select(
        "target", "ref", "source", F.col("ref_sheet").alias("sheet"), "row", "col"
    )


def _in_pieces(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """The filled cells in pieces ``ref_sheet, down, line, level, piece`` of ranges."""
    return wanted.join(_held(cells, wanted), ["ref_sheet", "down", "line", "level", "piece"]).select(
        "target", "ref", "source", F.col("ref_sheet").alias("sheet"), "row", "col"
    )


def range_members(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """Filled cells inside each referenced range, whatever its size.

    A range is taken line by line along its shorter side. A short line is its places, which meet the cells
    there; a longer one is a few aligned pieces, and a cell knows the piece of every size that holds it. Both
    meet in an equality join whose result is exactly the members, so neither a tall range nor a crowded part
    of a sheet brings rows that are then filtered out. ``refs`` is read twice.
    """
    tall = (F.col("r2") - F.col("r1")) >= (F.col("c2") - F.col("c1"))
    lines = refs.withColumn("down", tall).withColumn(
        "line", F.explode(F.when(F.col("down"), F.sequence("c1", "c2")).otherwise(F.sequence("r1", "r2")))
    )
    side = F.greatest(F.col("r2") - F.col("r1"), F.col("c2") - F.col("c1"))
    places = F.when(F.col("down"), F.sequence("r1", "r2")).otherwise(F.sequence("c1", "c2"))
    short = lines.filter(side < _STEP).select("target", "ref", "ref_sheet", "down", "line", F.explode(places).alias("place"))
    near = short.select(
        "target", "ref", "ref_sheet",
        F.when(F.col("down"), F.col("place")).otherwise(F.col("line")).alias("row"),
        F.when(F.col("down"), F.col("line")).otherwise(F.col("place")).alias("col"),
    )
    pieces = F.when(F.col("down"), _pieces(F.col("r1"), F.col("r2"), LAST_ROW)).otherwise(
        _pieces(F.col("c1"), F.col("c2"), LAST_COLUMN)
    )
    far = cut_lineage(lines.filter(side >= _STEP).select(
        "target", "ref", "ref_sheet", "down", "line", F.explode(pieces).alias("p")
    ).select("target", "ref", "ref_sheet", "down", "line", "p.level", "p.piece"), "range-pieces", codec="zstd")
    found = _at_places(near, cells)
    # Without longer ranges the cells are not read a second time.
    return found if far.isEmpty() else found.unionByName(_in_pieces(far, cells))


def range_text_members(refs: DataFrame, cells: DataFrame) -> DataFrame:
    """Filled cells inside each range given as text: ``target, ref, sheet`` in, the members in SQL over a table function.

    ``sheet`` is where a reference without a sheet lies. The table function hands back pieces of the range.
    """
    spark = refs.sparkSession
    name = register_ranges(spark)
    # The table function takes the area without its sheet, once for each distinct text.
    area = F.substring_index("ref", "!", -1)
    before = F.regexp_extract("ref", "(?s)^(.*)!", 1)
    own = F.replace(F.trim(before, F.lit("'")), F.lit("''"), F.lit("'"))
    asked = cut_lineage(refs.filter("ref IS NOT NULL").select(
        "target", "ref", area.alias("area"), F.when(before == "", F.col("sheet")).otherwise(own).alias("ref_sheet")
    ), "range-text", codec="zstd")
    spread = per_key(spark.sql(
        f"""SELECT a.area, p.down, p.line, collect_list(struct(p.level, p.piece)) AS pieces
            FROM {{areas}} a, LATERAL {name}(a.area, NULL) p GROUP BY a.area, p.down, p.line""",
        areas=asked.select("area").distinct(),
    ))
    wanted = spark.sql(
        "SELECT w.target, w.ref, w.ref_sheet, s.down, s.line, inline(s.pieces) FROM {asked} w JOIN {spread} s ON s.area = w.area",
        asked=asked, spread=spread,
    )
    # A piece of one place meets the cell there; only longer ones need the cells by their pieces.
    near = spark.sql(
        """SELECT target, ref, ref_sheet, CASE WHEN down THEN piece ELSE line END AS row, CASE WHEN down THEN line ELSE piece END AS col
           FROM {wanted} WHERE level = 0""",
        wanted=wanted,
    )
    found = spark.sql(
        """SELECT /*+ MERGE(c) */ n.target, n.ref, c.address AS source, n.ref_sheet AS sheet, n.row, n.col FROM {near} n JOIN {cells} c
           ON c.sheet = n.ref_sheet AND c.row = n.row AND c.col = n.col""",
        near=near, cells=_at_used_places(cells, spread.selectExpr("down", "line", "inline(pieces)").filter("level = 0").selectExpr(
            "CASE WHEN down THEN piece ELSE line END AS row", "CASE WHEN down THEN line ELSE piece END AS col"
        )),
    )
    far = cut_lineage(wanted.filter("level > 0"), "range-pieces", codec="zstd")
    if far.isEmpty():
        return found
    return found.unionByName(spark.sql(
        """SELECT w.target, w.ref, h.source, h.ref_sheet AS sheet, h.row, h.col FROM {far} w JOIN {held} h
           ON h.ref_sheet = w.ref_sheet AND h.down = w.down AND h.line = w.line AND h.level = w.level AND h.piece = w.piece""",
        far=far, held=_held(cells, far),
    ))


def edge_list(cells: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Distinct (source, target) pairs, by one rule for all sizes.

    A reference to one cell links that cell even when it is empty; a range links the filled cells in it.
    """
    refs = cut_lineage(cell_references(cells, names), "references", codec="zstd")
    # A place tells the address, so only places are dealt out and made distinct.
    columns = ["target", "sheet", "row", "col"]
    members = range_members(refs.filter(~_one_cell()), cells).select(*columns)
    pairs = named_cells(refs).select(*columns).unionByName(members).distinct()
    return pairs.select(cell_address(F.col("sheet"), F.col("row"), F.col("col")).alias("source"), *columns)


def with_missing_cells(cells: DataFrame, edges: DataFrame, readers: bool = False) -> DataFrame:
    """The cell table plus empty cells that formulas point at; with ``readers`` also how many formulas read each cell.

    One join tells both, so that cells move once; :func:`cell_roles` takes the readers from there.
    """
    read = edges.groupBy(F.col("source").alias("_source")).agg(
        F.count("*").alias("readers"), F.min("row").alias("_row"), F.min("col").alias("_col")
    )
    both = cells.join(read, F.col("address") == F.col("_source"), "full_outer")
    missing = F.col("address").isNull() & F.col("_source").isNotNull()
    # The sheet of an address is what stands before its last exclamation mark.
    place = F.substring_index("_source", "!", -1)
    known = {
        "address": F.col("_source"), "row": F.col("_row"), "col": F.col("_col"), "value_type": F.lit("blank"),
        "sheet": F.left("_source", F.length("_source") - F.length(place) - 1),
    }
    full = [F.when(missing, known[c]).otherwise(F.col(c)).alias(c) if c in known else F.col(c) for c in cells.columns]
    return both.select(*full, *(["readers"] if readers else []))


def cell_roles(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Role of each cell from whether it has a formula and whether a formula reads it.

    Cells that bring their ``readers`` from :func:`with_missing_cells` are not joined again.
    """
    # Told before a join, so that who needs the role alone does not move the formulas.
    told = cells.withColumn("_formula", F.col("formula").isNotNull())
    if "readers" not in cells.columns:
        read = edges.groupBy(F.col("source").alias("address")).agg(F.count("*").alias("readers"))
        told = told.join(read, "address", "left")
    has_formula, is_read = F.col("_formula"), F.col("readers").isNotNull()
    role = (
        F.when(has_formula & is_read, "intermediate")
        .when(has_formula, "output")
        .when(is_read, "input")
        .otherwise("static")
    )
    return told.withColumn("role", role).drop("readers", "_formula")


def row_stats(cells: DataFrame) -> DataFrame:
    """Filled, typed-text and numeric cells per row; formulas count as filled only."""
    typed = F.col("formula").isNull()
    filled = (F.trim(F.coalesce("value", F.lit(""))) != "") | ~typed
    return cells.groupBy("sheet", "row").agg(
        F.count_if(filled).alias("non_empty"),
        F.count_if(filled & typed & (F.col("value_type") == "text")).alias("texts"),
        F.count_if(filled & typed & F.col("value_type").isin("number", "bool")).alias("numbers"),
    )


# Words that open a summary row.
SUMMARY_WORDS = ("total", "summary", "subtotal")


def structural_cells(cells: DataFrame) -> DataFrame:
    """Mark headings, section titles and summary labels among static text; needs ``role``."""
    text = F.trim("value")
    candidate = F.coalesce((F.col("role") == "static") & (F.col("value_type") == "text") & (text != ""), F.lit(False))
    stats = cut_lineage(row_stats(cells), "row-stats", codec="zstd")
    widest = per_key(stats.groupBy("sheet").agg(F.max("non_empty").alias("widest")))
    n, t, k, w = (F.col(c) for c in ("non_empty", "texts", "numbers", "widest"))
    lowered = F.lower(text)
    opens = F.startswith(lowered, F.lit(SUMMARY_WORDS[0]))
    for word in SUMMARY_WORDS[1:]:
        opens = opens | F.startswith(lowered, F.lit(word))
    wide = (n >= F.greatest(F.lit(3), F.floor(w * 0.7))) & (t >= F.greatest(F.lit(2), F.floor(n * 0.8)))
    shout = (F.upper(text) == text) & (lowered != text) & (F.length(text) >= 4)
    rule = (
        F.coalesce("merged_anchor", F.lit(False)) | F.coalesce("bold", F.lit(False))
        | (n <= 1) | ((t >= 2) & (k == 0)) | wide | F.endswith(text, F.lit(":")) | shout | opens
    )
    # Only static text can change its role; all other cells stay where they are.
    marked = (
        cells.filter(candidate).join(stats.join(widest, "sheet"), ["sheet", "row"], "left")
        .withColumn("role", F.when(rule, "structural").otherwise(F.col("role")))
    )
    return cells.filter(~candidate).unionByName(marked.select(*cells.columns))


def label_cells(cells: DataFrame) -> DataFrame:
    """Static text beside or above a cell with a calculating role becomes a label; ``cells`` is read several times."""
    plain_text = F.coalesce(
        (F.col("role") == "static") & (F.col("value_type") == "text") & (F.trim("value") != ""), F.lit(False)
    )
    active = cells.filter(F.col("role").isin("input", "output", "intermediate")).select("sheet", "row", "col")
    # Only plain text can become a label; all other cells stay where they are.
    texts = cells.filter(plain_text)
    places = texts.select("sheet", F.col("row").alias("_row"), F.col("col").alias("_col"))
    near = (
        _beside(places, active, "left_semi")
        .select("sheet", F.col("_row").alias("row"), F.col("_col").alias("col")).distinct().withColumn("near", F.lit(True))
    )
    labelled = texts.join(near, ["sheet", "row", "col"], "left").withColumn(
        "role", F.when(F.col("near"), "label").otherwise(F.col("role"))
    )
    return cells.filter(~plain_text).unionByName(labelled.select(*cells.columns))


def neighbour_join(cells: DataFrame) -> DataFrame:
    """Every label beside the calculating cells that touch it: ``address, value, neighbour, direction``.

    ``direction`` is where the neighbour lies as seen from the label.
    """
    active = cells.filter(F.col("role").isin("input", "output", "intermediate")).select(
        "sheet", "row", "col", F.col("address").alias("neighbour")
    )
    labels = cells.filter("role = 'label'").select("sheet", F.col("row").alias("_row"), F.col("col").alias("_col"), "address", "value")
    direction = (
        F.when(F.col("col") > F.col("_col"), "right").when(F.col("col") < F.col("_col"), "left")
        .when(F.col("row") > F.col("_row"), "below").otherwise("above")
    )
    return _beside(labels, active, "inner").select("address", "value", "neighbour", direction.alias("direction"))


#: Rows and columns of a tile; cells and what lies beside them meet there.
_TILE = 8


def _beside(cells: DataFrame, others: DataFrame, how: str) -> DataFrame:
    """Join cells at ``sheet, _row, _col`` with others at ``sheet, row, col`` that touch a side of them.

    The others go to their tile once, a cell to each tile that holds one of its four sides, mostly one. With
    ``left_semi`` a cell may come back once for each of its tiles.
    """
    tile = lambda row, col: F.struct(
        F.floor(row / _TILE).cast("int").alias("_down"), F.floor(col / _TILE).cast("int").alias("_right")
    )
    sides = [tile(F.col("_row") + dr, F.col("_col") + dc) for dr, dc in ((0, 1), (0, -1), (1, 0), (-1, 0))]
    asked = cells.withColumn("_tile", F.explode(F.array_distinct(F.array(*sides))))
    asked = asked.select(*cells.columns, "_tile._down", "_tile._right")
    held = others.withColumn("_tile", tile(F.col("row"), F.col("col")))
    held = held.select(F.col("sheet").alias("_sheet"), *[c for c in others.columns if c != "sheet"],
                       F.col("_tile._down").alias("_d"), F.col("_tile._right").alias("_r"))
    touch = F.abs(F.col("row") - F.col("_row")) + F.abs(F.col("col") - F.col("_col")) == 1
    on = (F.col("sheet") == F.col("_sheet")) & (F.col("_down") == F.col("_d")) & (F.col("_right") == F.col("_r")) & touch
    # A packed table is many times its files' size in memory: never a broadcast.
    return asked.join(held.hint("shuffle_merge"), on, how)


def classified(cells: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """All roles of a cell table, and its edges; ``edges`` are those of the same cells where they are known already.

    Later steps read each of these tables several times, so each is written once; with ``edges`` given, the caller
    has written ``cells`` and ``edges``.
    """
    if edges is None:
        cells = cut_lineage(cells, "cells", codec="zstd")
        edges = cut_lineage(edge_list(cells), "edges", codec="zstd")
    based = _base_roles(cells, edges)
    marked = cut_lineage(structural_cells(based), "roles", codec="zstd")
    discard(based)
    return label_cells(marked), edges


#: Edges whose cells get their roles at once; beyond it they are taken in slices of the addresses.
_SLICE_EDGES, _MOST_SLICES = 20_000_000, 8


def _base_roles(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """Cells, missing ones too, with their base roles, written.

    All columns of all cells move to the edges that read them; slice by slice only a part of them lies on disk at a time.
    """
    slices = min(_MOST_SLICES, max(1, -(-edges.count() // _SLICE_EDGES)))

    def of(number: int) -> DataFrame:
        inside = lambda address: F.pmod(F.xxhash64(address), F.lit(slices)) == number
        held, links = (cells, edges) if slices == 1 else (cells.filter(inside("address")), edges.filter(inside("source")))
        return cell_roles(with_missing_cells(held, links, readers=True), links)

    return cut_slices([of(number) for number in range(slices)], "base-roles", codec="zstd")


def input_types(cells: DataFrame) -> DataFrame:
    """Form field type of each cell from its value and number format."""
    kind, fmt = F.col("value_type"), F.lower(F.coalesce("number_format", F.lit("")))
    field = (
        F.when(kind == "date", "date")
        .when(kind == "bool", "boolean")
        .when((kind == "number") & F.contains(fmt, F.lit("%")), "percentage")
        .when((kind == "number") & fmt.rlike("[$€£]"), "currency")
        .when(kind == "number", "number")
        .otherwise("text")
    )
    return cells.withColumn("input_type", field)


def nearest_label(cells: DataFrame) -> DataFrame:
    """For calculating cells the nearest label to the left, else the nearest one above."""
    label = F.when(F.col("role").isin("label", "structural"), F.trim("value"))
    active = F.col("role").isin("input", "output", "intermediate")
    # Only labels and calculating cells matter. A row of a sheet has at most as many cells as the sheet has columns.
    held = cells.withColumn("_label", label).filter(F.col("_label").isNotNull() | active)
    before = Window.partitionBy("sheet", "row").orderBy("col").rowsBetween(Window.unboundedPreceding, 0)
    left = held.withColumn("label", F.last("_label", ignorenulls=True).over(before)).filter(active).drop("_label")
    left = cut_lineage(left, "left-labels", codec="zstd")
    # What has no label to its left asks further up, among the labels of its column.
    asking = left.filter("label IS NULL").drop("label")
    columns = per_key(asking.select("sheet", "col").distinct())
    above = held.filter(F.col("_label").isNotNull() & ~active).join(columns, ["sheet", "col"], "left_semi").select("sheet", "row", "col", "_label")
    line = asking.withColumn("_asks", F.lit(True)).unionByName(above, allowMissingColumns=True)
    found = carry_last(line, ["sheet", "col"], [F.col("row")], F.col("_label"), "label").filter("_asks").drop("_asks", "_label")
    return left.filter("label IS NOT NULL").unionByName(found.select(*left.columns))


def section_of(lines: DataFrame, group: list[str], order: str, heading: Column, out: str = "section") -> DataFrame:
    """The last heading at or above each row; ``General`` before the first."""
    found = carry_last(lines, group, [F.col(order)], heading, out)
    return found.withColumn(out, F.coalesce(out, F.lit("General")))


def section_bounds(headings: DataFrame, group: list[str], row: str) -> DataFrame:
    """First and last row of each section; the last section of a sheet stays open.

    ``headings`` must hold one row per heading row.
    """
    from gridloom.operators.ordered import carry_last_strict

    # Looking back from the negated row finds the next heading below.
    flipped = carry_last_strict(
        headings.withColumn("_neg", -F.col(row)), group, [F.col("_neg")], F.col(row), "_next"
    )
    return flipped.select(
        *headings.columns, (F.col(row) + 1).alias("first_row"), (F.col("_next") - 1).alias("last_row")
    )
