"""Sheets of cells made from the orders: one sheet per order, one rate sheet per customer."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import grid
from gridloom.plans.registry import Loader

COLUMNS = ("sheet", "row", "col", "value", "value_type", "formula", "number_format", "bold", "merged_anchor")


def _cell(row, col, value=None, kind="text", formula=None, fmt=None, bold=False, merged=False):
    lit = lambda x: x if hasattr(x, "cast") else F.lit(x)
    return F.struct(
        lit(row).cast("int").alias("row"), F.lit(col).cast("int").alias("col"), lit(value).cast("string").alias("value"),
        F.lit(kind).alias("value_type"), lit(formula).cast("string").alias("formula"),
        F.lit(fmt).cast("string").alias("number_format"), F.lit(bold).alias("bold"), F.lit(merged).alias("merged_anchor"),
    )


def _spread(df: DataFrame, sheet, cells: list) -> DataFrame:
    return df.select(sheet.alias("sheet"), F.explode(F.array(*cells)).alias("c")).select("sheet", "c.*")


def order_lines(load) -> DataFrame:
    """One row per order and line number."""
    return (
        load("lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(
            F.sum(F.col("l_quantity").cast("decimal(12,0)")).cast("bigint").alias("qty"),
            F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(18,2)").alias("price"),
        )
    )


def cells(load: Loader) -> DataFrame:
    return load.shared("cells", lambda: _cells(load))


def roles(load: Loader) -> DataFrame:
    # No role depends on number formats, and nothing asks for them beside the role.
    return load.shared("cell_roles", lambda: grid.classified(cells(load).drop("number_format"), edges(load))[0])


def label_texts(load: Loader) -> DataFrame:
    """The roles with the texts of labels alone, no other value being asked for when labels are looked up."""
    text = F.when(F.col("role").isin("label", "structural"), F.col("value"))
    return roles(load).select("sheet", "row", "col", "address", text.alias("value"), "role")


def edges(load: Loader) -> DataFrame:
    return load.shared("cell_edges", lambda: grid.edge_list(cells(load)))


def _cells(load: Loader) -> DataFrame:
    """Header row 1, lines from row 2, total in row 9, total with rate in row 10."""
    r = F.col("l_linenumber") + 1
    lines = _spread(
        order_lines(load),
        F.concat(F.lit("O"), "l_orderkey"),
        [
            _cell(r, 1, F.concat(F.lit("Item "), "l_linenumber")),
            _cell(r, 2, F.col("qty"), "number"),
            _cell(r, 3, F.col("price"), "number", fmt="$#,##0.00"),
            _cell(r, 4, None, "number", F.concat(F.lit("=B"), r, F.lit("*C"), r)),
        ],
    )
    frames = _spread(
        load("orders"),
        F.concat(F.lit("O"), "o_orderkey"),
        [
            _cell(1, 1, "Line", bold=True, merged=True), _cell(1, 2, "Qty"), _cell(1, 3, "Price"), _cell(1, 4, "Amount"),
            _cell(9, 1, "TOTAL"), _cell(9, 4, None, "number", "=SUM(D2:D8)"),
            _cell(10, 1, "With rate"), _cell(10, 2, "0.07", "number", fmt="0%"),
            _cell(10, 4, None, "number", F.concat(F.lit("=D9*(1+$B$10)*Cust"), "o_custkey", F.lit("!B1"))),
        ],
    )
    rates = _spread(
        load("customer"),
        F.concat(F.lit("Cust"), "c_custkey"),
        [_cell(1, 1, "Rate"), _cell(1, 2, "0.95", "number", fmt="0.00"), _cell(3, 1, "Agreed with sales")],
    )
    every = reduce(DataFrame.unionByName, [lines, frames, rates])
    return every.select(
        "sheet", "row", "col", grid.cell_address(F.col("sheet"), F.col("row"), F.col("col")).alias("address"), *COLUMNS[3:]
    )


_ORDER_FRAME = """
    (1, 1, 'Line', 'text', NULL, NULL, true, true), (1, 2, 'Qty', 'text', NULL, NULL, false, false),
    (1, 3, 'Price', 'text', NULL, NULL, false, false), (1, 4, 'Amount', 'text', NULL, NULL, false, false),
    (9, 1, 'TOTAL', 'text', NULL, NULL, false, false), (9, 4, NULL, 'number', '=SUM(D2:D8)', NULL, false, false),
    (10, 1, 'With rate', 'text', NULL, NULL, false, false), (10, 2, '0.07', 'number', NULL, '0%', false, false),
    (10, 4, NULL, 'number', '=D9*(1+$B$10)*Cust', NULL, false, false)
"""

CELLS_SQL = f"""
  order_lines AS (SELECT l_orderkey, l_linenumber AS n, sum(l_quantity::DECIMAL(12,0))::BIGINT AS qty,
      sum(l_extendedprice::DECIMAL(12,2))::DECIMAL(18,2) AS price FROM lineitem GROUP BY 1, 2),
  raw_cells AS (
    SELECT 'O' || l_orderkey AS sheet, n + 1 AS "row", 1 AS col, 'Item ' || n AS value, 'text' AS value_type, NULL AS formula,
           NULL AS number_format, false AS bold, false AS merged_anchor FROM order_lines
    UNION ALL SELECT 'O' || l_orderkey, n + 1, 2, qty::VARCHAR, 'number', NULL, NULL, false, false FROM order_lines
    UNION ALL SELECT 'O' || l_orderkey, n + 1, 3, price::VARCHAR, 'number', NULL, '$#,##0.00', false, false FROM order_lines
    UNION ALL SELECT 'O' || l_orderkey, n + 1, 4, NULL, 'number', '=B' || (n + 1) || '*C' || (n + 1), NULL, false, false FROM order_lines
    UNION ALL SELECT 'O' || o_orderkey, r, c, v, k, CASE WHEN f LIKE '%Cust' THEN f || o_custkey || '!B1' ELSE f END, nf, b, m
      FROM orders, (VALUES {_ORDER_FRAME}) t(r, c, v, k, f, nf, b, m)
    UNION ALL SELECT 'Cust' || c_custkey, r, c, v, k, NULL, nf, false, false FROM customer,
      (VALUES (1, 1, 'Rate', 'text', NULL), (1, 2, '0.95', 'number', '0.00'), (3, 1, 'Agreed with sales', 'text', NULL)) t(r, c, v, k, nf)),
  cells AS MATERIALIZED (SELECT *, sheet || '!' || chr(64 + col) || "row" AS address FROM raw_cells),
  refs AS (SELECT address AS target, sheet, unnest(regexp_extract_all(replace(formula, '$', ''), '(?:[A-Za-z0-9_]+!)?[A-Z]{{1,3}}[0-9]+(?::[A-Z]{{1,3}}[0-9]+)?')) AS ref
      FROM cells WHERE formula IS NOT NULL),
  full_refs AS (SELECT DISTINCT target, CASE WHEN ref LIKE '%!%' THEN ref ELSE sheet || '!' || ref END AS ref FROM refs),
  bounds AS (SELECT target, ref, split_part(ref, '!', 1) AS ref_sheet, ascii(regexp_extract(ref, '!([A-Z])', 1)) - 64 AS c1,
      regexp_extract(ref, '!([A-Z])([0-9]+)', 2)::INT AS r1, coalesce(nullif(regexp_extract(ref, ':[A-Z]([0-9]+)', 1), ''), regexp_extract(ref, '!([A-Z])([0-9]+)', 2))::INT AS r2
      FROM full_refs),
  edges AS MATERIALIZED (SELECT DISTINCT ref_sheet || '!' || chr(64 + c1) || r1 AS source, target, ref_sheet AS sheet, r1 AS "row", c1 AS col FROM bounds WHERE r1 = r2
      UNION SELECT address, target, sheet, "row", col FROM bounds JOIN cells ON sheet = ref_sheet AND col = c1 AND "row" BETWEEN r1 AND r2 WHERE r1 < r2),
  full_cells AS MATERIALIZED (SELECT sheet, "row", col, address, value, value_type, formula, number_format, bold, merged_anchor FROM cells
      UNION ALL SELECT DISTINCT e.sheet, e."row", e.col, source, NULL, 'blank', NULL, NULL, NULL, NULL FROM edges e ANTI JOIN cells c ON c.address = e.source),
  sources AS MATERIALIZED (SELECT DISTINCT source FROM edges),
  base_roles AS MATERIALIZED (SELECT c.*, CASE WHEN formula IS NOT NULL AND s.source IS NOT NULL THEN 'intermediate' WHEN formula IS NOT NULL THEN 'output'
      WHEN s.source IS NOT NULL THEN 'input' ELSE 'static' END AS role FROM full_cells c LEFT JOIN sources s ON c.address = s.source)
"""

ROLES_SQL = (
    CELLS_SQL
    + """,
  stats AS MATERIALIZED (SELECT sheet, "row", count(*) FILTER (trim(coalesce(value, '')) <> '' OR formula IS NOT NULL) AS non_empty,
      count(*) FILTER (formula IS NULL AND value_type = 'text' AND trim(coalesce(value, '')) <> '') AS texts,
      count(*) FILTER (formula IS NULL AND value_type IN ('number', 'bool') AND trim(coalesce(value, '')) <> '') AS numbers
      FROM full_cells GROUP BY 1, 2),
  widest AS MATERIALIZED (SELECT sheet, max(non_empty) AS widest FROM stats GROUP BY 1),
  with_structure AS MATERIALIZED (SELECT b.* EXCLUDE (role), CASE WHEN role = 'static' AND value_type = 'text' AND trim(value) <> '' AND (
      coalesce(merged_anchor, false) OR coalesce(bold, false) OR non_empty <= 1 OR (texts >= 2 AND numbers = 0)
      OR (non_empty >= greatest(3, floor(widest * 0.7)) AND texts >= greatest(2, floor(non_empty * 0.8)))
      OR trim(value) LIKE '%:' OR (upper(trim(value)) = trim(value) AND lower(trim(value)) <> trim(value) AND length(trim(value)) >= 4)
      OR starts_with(lower(trim(value)), 'total') OR starts_with(lower(trim(value)), 'summary') OR starts_with(lower(trim(value)), 'subtotal')) THEN 'structural' ELSE role END AS role
      FROM base_roles b LEFT JOIN stats s USING (sheet, "row") LEFT JOIN widest w USING (sheet)),
  active AS MATERIALIZED (SELECT DISTINCT sheet, "row" + dr AS "row", col + dc AS col FROM with_structure, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) d(dr, dc)
      WHERE role IN ('input', 'output', 'intermediate')),
  roles AS MATERIALIZED (SELECT w.* EXCLUDE (role), CASE WHEN role = 'static' AND value_type = 'text' AND trim(value) <> '' AND a.sheet IS NOT NULL
      THEN 'label' ELSE role END AS role FROM with_structure w LEFT JOIN active a USING (sheet, "row", col))
"""
)
