"""Finding the table inside a sheet, naming its columns, and stacking sheets.

Raw sheets have one row per line: ``sheet, row_idx`` (from 1) and ``cells`` (an array of text).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.similarity import match_synonyms
from gridloom.functions.text import null_if_blank, snake_name
from gridloom.operators.graph import components
from gridloom.operators.ordered import running_number
from gridloom.session import cut_lineage, per_key

# Words that open a total row.
TOTAL_WORDS = r"^(grand total|subtotal|total|sum)\b"
_NUMERIC = r"^[-+(]?[$€£]?\s?[0-9][0-9.,]*\s?[%$€£)]?$"
LONG_TEXT = 40
SPARSE = 0.8
HEADER_SPAN = 0.6


def _filled() -> Column:
    return F.filter(F.transform("cells", null_if_blank), lambda c: c.isNotNull())


def measured(rows: DataFrame) -> DataFrame:
    """Add the filled cells of each row and whether they could be a header."""
    found = rows.withColumn("filled", _filled()).withColumn("width", F.size("filled"))
    texty = ~F.exists("filled", lambda c: c.rlike(_NUMERIC))
    unlike = F.size(F.array_distinct("filled")) == F.col("width")
    return found.withColumn("texty", (F.col("width") >= 2) & texty & unlike)


def detect_header(rows: DataFrame) -> DataFrame:
    """First row of each sheet made of distinct texts across most of its width.

    Sheets without such a row do not appear. Rows shrink to one per (sheet, width) before they meet.
    """
    per_width = measured(rows).groupBy("sheet", "width").agg(
        F.min(F.when(F.col("texty"), F.struct("row_idx", "cells"))).alias("first")
    )
    widest = per_width.groupBy("sheet").agg(F.max("width").alias("widest"))
    return (
        per_width.join(widest, "sheet")
        .filter(F.col("width") >= F.col("widest") * HEADER_SPAN)
        .groupBy("sheet").agg(F.min("first").alias("first")).filter("first IS NOT NULL")
        .select("sheet", F.col("first.row_idx").alias("header_row"), F.col("first.cells").alias("header_cells"))
    )


def classify_rows(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Kind of every row: blank, title, header, data, section, total, repeated_header, footnote."""
    headers = per_key(detect_header(rows) if headers is None else headers)
    joined = measured(rows).join(headers, "sheet", "left")
    width, at, head = F.col("width"), F.col("row_idx"), F.col("header_row")
    same = F.transform("cells", null_if_blank) == F.transform("header_cells", null_if_blank)
    kind = (
        F.when(width == 0, "blank")
        .when(at == head, "header")
        .when(same & (at > head), "repeated_header")
        .when(F.lower(F.col("filled")[0]).rlike(TOTAL_WORDS), "total")
        .when((width == 1) & (at < F.coalesce(head, F.lit(4))), "title")
        .when(width == 1, "section")
        .when(at < head, "title")
        .otherwise("data")
    )
    first_pass = joined.withColumn("kind", kind)
    ends = per_key(first_pass.filter("kind = 'data'").groupBy("sheet").agg(F.max("row_idx").alias("last_data")))
    below = (F.col("kind") == "section") & (at > F.col("last_data")) & (F.length(F.col("filled")[0]) >= LONG_TEXT)
    return (
        first_pass.join(ends, "sheet", "left")
        .withColumn("kind", F.when(below, "footnote").otherwise(F.col("kind")))
        .select("sheet", "row_idx", "cells", "kind")
    )


def detect_bounds(kinds: DataFrame) -> DataFrame:
    """First and last data row of each sheet."""
    return kinds.filter("kind = 'data'").groupBy("sheet").agg(
        F.min("row_idx").alias("data_start"), F.max("row_idx").alias("data_end")
    )


def detect_noise_columns(kinds: DataFrame) -> DataFrame:
    """Columns (from 1) that are blank in all data rows, or sparse with long texts."""
    spread = kinds.filter("kind = 'data'").select("sheet", F.posexplode("cells").alias("pos", "value"))
    text = null_if_blank(F.col("value"))
    stats = spread.groupBy("sheet", (F.col("pos") + 1).alias("col")).agg(
        F.count("*").alias("n"), F.count(text).alias("k"), F.avg(F.length(text)).alias("mean_length")
    )
    blank = F.col("k") == 0
    remark = (F.col("k") <= F.col("n") * (1 - SPARSE)) & (F.col("mean_length") >= LONG_TEXT)
    return stats.filter(blank | remark).select("sheet", "col")


def extract_range(rows: DataFrame, bounds: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows from data start to data end, both included; an open end means to the bottom."""
    inside = rows.join(per_key(bounds), "sheet").filter(
        "row_idx >= coalesce(data_start, 1) AND (data_end IS NULL OR row_idx <= data_end)"
    )
    return inside.join(excluded.select("sheet", "row_idx"), ["sheet", "row_idx"], "left_anti").select("sheet", "row_idx", "cells")


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(F.exists("cells", lambda c: null_if_blank(c).isNotNull()))


def drop_noise_columns(rows: DataFrame, noise: DataFrame) -> DataFrame:
    """Remove the cells of noise columns; the list per sheet is bounded by the sheet's width."""
    lists = per_key(noise.groupBy("sheet").agg(F.collect_set("col").alias("noise")))
    kept = F.filter(F.col("cells"), lambda c, i: ~F.array_contains(F.coalesce("noise", F.array().cast("array<int>")), i + 1))
    return rows.join(lists, "sheet", "left").withColumn("cells", kept).drop("noise")


def header_columns(headers: DataFrame) -> DataFrame:
    """One row per column of each header: ``sheet, col, raw``."""
    return headers.select("sheet", F.posexplode("header_cells").alias("pos", "raw")).select(
        "sheet", (F.col("pos") + 1).alias("col"), "raw"
    )


def canonical_names(catalogue: DataFrame, raw: str = "raw") -> DataFrame:
    """Add the snake-case name and the canonical name; each distinct name is matched once."""
    named = catalogue.withColumn("snake", snake_name(F.col(raw)))
    matches = per_key(named.select("snake").distinct().withColumn("match", match_synonyms()(F.col("snake"))))
    canonical = F.when(F.col("snake") != "unnamed", F.col("match.canonical"))
    return named.join(matches, "snake").withColumn("canonical", F.coalesce(canonical, "snake")).drop("match")


def normalize_columns(catalogue: DataFrame) -> DataFrame:
    """Final column names for ``(sheet, col, raw)``; repeats in a sheet get ``_1``, ``_2``… ."""
    return dedupe_suffix(canonical_names(catalogue), ["sheet"], "col", "canonical", "name")


def dedupe_suffix(df: DataFrame, group: list[str], order: str, name: str, out: str) -> DataFrame:
    numbered = running_number(df, [*group, name], [F.col(order)], "_rep", start=0)
    suffix = F.when(F.col("_rep") > 0, F.concat(F.lit("_"), F.col("_rep").cast("string"))).otherwise("")
    return numbered.withColumn(out, F.concat(F.col(name), suffix)).drop("_rep")


def extract_table(rows: DataFrame) -> DataFrame:
    """Clean rows of every sheet as ``sheet, row_idx, record`` with column names as map keys."""
    rows = cut_lineage(rows, "raw")
    headers = cut_lineage(detect_header(rows), "headers")
    kinds = cut_lineage(classify_rows(rows, headers), "kinds")
    noise = detect_noise_columns(kinds)
    columns = header_columns(headers).join(noise, ["sheet", "col"], "left_anti")
    named = normalize_columns(columns)
    # One sheet's names in column order; bounded by the width of a sheet.
    lists = per_key(named.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("col", "name"))).alias("names")))
    data = drop_blank_rows(kinds.filter("kind = 'data'"))
    record = F.map_from_arrays(
        F.transform("names", lambda n: n["name"]),
        F.transform("names", lambda n: null_if_blank(F.get("cells", n["col"] - 1))),
    )
    return data.join(lists, "sheet").select("sheet", "row_idx", record.alias("record"))


def stack_records(records: DataFrame, names: list[str]) -> DataFrame:
    """Records of any number of sheets under one set of columns; absent columns are NULL."""
    return records.select(
        F.col("sheet").alias("_source_sheet"), F.col("row_idx").alias("_source_row"), *[F.col("record")[n].alias(n) for n in names]
    )


def stack_sheets(sheets: dict[str, DataFrame], order: dict[str, list[Column]]) -> DataFrame:
    """Outer stack by column name with the sheet name and the row number in the sheet (from 0)."""
    out = None
    for name, df in sheets.items():
        part = running_number(df, [], order[name], "_source_row", start=0).withColumn("_source_sheet", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def canonical_schema(catalogue: DataFrame) -> DataFrame:
    """Mapping of every sheet column to its canonical name, with the confidence of the mapping."""
    mapped = canonical_names(catalogue)
    return mapped.select(
        "sheet", "col", F.col("snake").alias("original"), "canonical",
        F.when(F.col("canonical") != F.col("snake"), 0.8).otherwise(1.0).alias("confidence"),
    )


#: Logical types, most specific first, each with the types that can hold all its values.
TYPE_LATTICE = {
    "boolean": ("boolean", "string"), "integer": ("integer", "decimal", "string"), "percentage": ("percentage", "decimal", "string"),
    "currency": ("currency", "decimal", "string"), "decimal": ("decimal", "string"), "date": ("date", "datetime", "string"),
    "datetime": ("datetime", "string"), "string": ("string",),
}


def common_types(columns: DataFrame) -> DataFrame:
    """``canonical, type, sheets, conflict``: the most specific type that holds what every sheet has in a column.

    ``columns`` has ``canonical, type``, one row per sheet column. Each type stands for the set of types above it;
    the sets are intersected as bits, which shrinks on the map side. A NULL or unknown type (a column without values)
    asks for nothing; where no sheet asks for anything the type is ``string``.
    """
    order = list(TYPE_LATTICE)
    bits = {t: sum(1 << order.index(a) for a in above) for t, above in TYPE_LATTICE.items()}
    every = (1 << len(order)) - 1
    known = F.col("type").isin(order)
    mask = F.coalesce(*[F.when(F.col("type") == t, F.lit(b)) for t, b in bits.items()], F.lit(every))
    met = columns.groupBy("canonical").agg(
        F.bit_and(mask).alias("_held"), F.count("*").alias("sheets"),
        F.min(F.when(known, F.col("type"))).alias("_low"), F.max(F.when(known, F.col("type"))).alias("_high"),
    )
    best = F.coalesce(*[F.when(F.col("_held").bitwiseAND(1 << i) != 0, F.lit(t)) for i, t in enumerate(order)])
    kind = F.when(F.col("_low").isNull(), "string").otherwise(best)
    return met.select("canonical", kind.alias("type"), "sheets", F.coalesce(F.col("_low") != F.col("_high"), F.lit(False)).alias("conflict"))


# When two sheets count as alike.
COLUMN_SLACK = 2
TYPE_SHARE = 0.7
NAME_SHARE = 0.5


def sheet_clusters(columns: DataFrame) -> DataFrame:
    """Group alike sheets from ``(sheet, name, type)``.

    Sheets with the same columns and types form one signature, and only signatures are compared. Two
    sets that share half of the larger one must share a name among their rarest half, so candidates
    meet on those names only.
    """
    listed = columns.groupBy("sheet").agg(F.array_sort(F.collect_set(F.struct("name", "type"))).alias("cols"))
    sheets = cut_lineage(
        listed.withColumn("sig", F.sha2(F.to_json(F.struct("cols")), 256)), "sheets"
    )
    signatures = cut_lineage(sheets.groupBy("sig").agg(F.first("cols").alias("cols")), "signatures")
    flat = signatures.select("sig", F.explode("cols").alias("c")).select("sig", "c.name")
    rarity = per_key(flat.groupBy("name").agg(F.count("*").alias("freq")))
    size = F.size("cols")
    ranked = (
        flat.join(rarity, "name")
        .groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("freq", "name"))).alias("rare"))
        .join(signatures, "sig")
        .withColumn("prefix", F.slice("rare", 1, size - F.ceil(size * NAME_SHARE).cast("int") + 1))
    )
    keyed = ranked.select("sig", "cols", F.explode("prefix").alias("p"), size.alias("size")).select(
        "sig", "cols", F.col("p.name").alias("name"), "size"
    )
    # The number of columns is part of the key, so that a common name does not pair sets of any size.
    other = keyed.select(
        F.col("sig").alias("sig2"), F.col("cols").alias("cols2"), "name",
        F.explode(F.sequence(F.col("size") - COLUMN_SLACK, F.col("size") + COLUMN_SLACK)).alias("size"),
    )
    names = lambda c: F.transform(c, lambda x: x["name"])
    shared = F.size(F.array_intersect(names("cols"), names("cols2")))
    equal_types = F.size(F.array_intersect("cols", "cols2"))
    alike = (
        (F.abs(F.size("cols") - F.size("cols2")) <= COLUMN_SLACK)
        & (shared >= F.greatest(F.size("cols"), F.size("cols2")) * NAME_SHARE)
        & (equal_types >= shared * TYPE_SHARE)
    )
    nodes = signatures.select(F.col("sig").alias("address"))
    # First everyone against one leader per name and size; then only sets that are still apart.
    leaders = per_key(other.groupBy("name", "size").agg(F.min(F.struct("sig2", "cols2")).alias("l")))
    stars = keyed.join(leaders.select("name", "size", "l.sig2", "l.cols2"), ["name", "size"]).filter("sig <> sig2").filter(alike)
    stars = cut_lineage(stars.select(F.col("sig").alias("source"), F.col("sig2").alias("target")).distinct(), "star-links")
    found = per_key(components(nodes, stars))
    left = keyed.join(found.select(F.col("address").alias("sig"), F.col("cluster").alias("part")), "sig")
    right = other.join(found.select(F.col("address").alias("sig2"), F.col("cluster").alias("part2")), "sig2")
    rest = left.join(right, ["name", "size"]).filter(F.col("part") < F.col("part2")).filter(alike).select(
        F.col("sig").alias("source"), F.col("sig2").alias("target")
    ).distinct()
    groups = per_key(components(nodes, stars.unionByName(rest)))
    return sheets.join(groups.withColumnRenamed("address", "sig"), "sig").select("sheet", "cluster")
