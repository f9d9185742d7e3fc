"""Lookups, grid joins, ranges, scenarios and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import formulas as X
from gridloom.operators import grid, lookups, ordered
from gridloom.plans.cells import CELLS_SQL, ROLES_SQL, cells, label_texts, roles
from gridloom.plans.registry import query
from gridloom.session import cut_lineage

_POSITION = ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
_ASC = ", ".join(_POSITION)
_DESC = ", ".join(f"{c} DESC" for c in _POSITION)


@query(
    "lookup_exact",
    f"""WITH f AS (SELECT l_orderkey, l_extendedprice, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_ASC}) AS a,
               row_number() OVER (PARTITION BY l_orderkey ORDER BY {_DESC}) AS z FROM lineitem)
        SELECT o_orderkey, coalesce(x.l_extendedprice, 0.0) AS first_price, coalesce(y.l_extendedprice, -1.0) AS last_price
        FROM orders LEFT JOIN f x ON x.l_orderkey = o_orderkey AND x.a = 1 LEFT JOIN f y ON y.l_orderkey = o_orderkey AND y.z = 1""",
)
def _(load):
    lines = load("lineitem").select("l_orderkey", *_POSITION)
    position = [F.col(c) for c in _POSITION]
    orders = load("orders").select(F.col("o_orderkey"))
    first = lookups.lookup_exact(orders, "o_orderkey", lines, "l_orderkey", "l_extendedprice", position, F.lit(0.0), out="first_price")
    return lookups.lookup_exact(
        first, "o_orderkey", lines, "l_orderkey", "l_extendedprice", position, F.lit(-1.0), last=True, out="last_price"
    )


@query(
    "lookup_asof",
    """WITH t AS (SELECT s_acctbal AS k, arg_min(s_name, s_suppkey) AS v FROM supplier GROUP BY 1),
       q AS (SELECT c_custkey, c_acctbal FROM customer)
       SELECT q.c_custkey, b.v AS at_or_below, b.k AS at_or_below_key, a.v AS at_or_above, a.k AS at_or_above_key
       FROM q ASOF LEFT JOIN t b ON q.c_acctbal >= b.k ASOF LEFT JOIN t a ON q.c_acctbal <= a.k""",
)
def _(load):
    bands = load("supplier").groupBy(F.col("s_acctbal").alias("bal")).agg(F.min_by("s_name", "s_suppkey").alias("name"))
    asked = load("customer").select("c_custkey", F.col("c_acctbal").alias("bal"))
    below = ordered.asof_lookup(asked, bands, "bal", "name", out="at_or_below")
    both = ordered.asof_lookup(below, bands, "bal", "name", forward=True, out="at_or_above")
    return both.drop("bal")


_MEMBERS_SQL = f"""WITH {CELLS_SQL} SELECT b.target, b.ref, c.address AS source FROM bounds b
        JOIN cells c ON c.sheet = b.ref_sheet AND c."row" BETWEEN r1 AND r2 AND c.col = b.c1"""


@query("range_membership", _MEMBERS_SQL)
def _(load):
    sheet = cells(load)
    refs = cut_lineage(grid.cell_references(sheet), "references", codec="zstd")
    return grid.range_members(refs, sheet).select("target", "ref", "source")


@query("range_text_members", _MEMBERS_SQL)
def _(load):
    # The same members, from the references' text by SQL over the table function.
    sheet = cells(load)
    refs = grid.cell_references(sheet).select("target", "ref", F.col("ref_sheet").alias("sheet"))
    return grid.range_text_members(refs, sheet).select("target", "ref", "source")


# Named sets of inputs.
SCENARIOS = {"base": (0.0, 1.0), "discount": (0.1, 1.0), "growth": (0.05, 1.2)}
_SCENARIO_SQL = ", ".join(f"('{n}', {c}::DECIMAL(4,2), {g}::DECIMAL(4,2))" for n, (c, g) in SCENARIOS.items())


@query(
    "scenario_grid",
    f"""SELECT scenario, l_returnflag, sum(l_extendedprice::DECIMAL(12,2) * (1 - cut) * grow)::DOUBLE AS revenue, count(*) AS n
        FROM lineitem, (VALUES {_SCENARIO_SQL}) s(scenario, cut, grow) GROUP BY 1, 2""",
)
def _(load):
    rows = [(name, cut, grow) for name, (cut, grow) in SCENARIOS.items()]
    scenarios = load.spark.createDataFrame(rows, "scenario string, cut double, grow double")
    price = F.col("l_extendedprice").cast("decimal(12,2)")

    def revenue(row):
        share, factor = (F.lit(x).cast("decimal(4,2)") for x in (1 - row["cut"], row["grow"]))
        return F.sum(price * share * factor).cast("double")

    return lookups.scenario_grid(load("lineitem"), ["l_returnflag"], scenarios, "scenario", revenue, "revenue")


@query(
    "override_join",
    """SELECT d.doc_id, CASE WHEN least(n_chars, 1000) / 1000.0 < 0.7 THEN coalesce(quality, (n_chars >= 500)::INT) ELSE (n_chars >= 500)::INT END AS decision,
              least(n_chars, 1000) / 1000.0 < 0.7 AND quality IS NULL AS needs_review
       FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(load):
    chars = F.col("n_chars")
    guesses = load("documents").select(
        "doc_id",
        F.when(chars >= 500, 1).otherwise(0).alias("guess"),
        (F.least(chars, F.lit(1000)) / F.lit(1000.0)).alias("confidence"),
    )
    answers = load("labels").select("doc_id", F.col("quality").alias("answer"))
    return lookups.override_join(guesses, answers, "doc_id").select("doc_id", "decision", "needs_review")


@query(
    "neighbor_join",
    f"""WITH {ROLES_SQL} SELECT l.address, l.value, n.address AS neighbour, direction FROM roles l
        JOIN (VALUES ('right', 0, 1), ('left', 0, -1), ('below', 1, 0), ('above', -1, 0)) d(direction, dr, dc) ON true
        JOIN roles n ON n.sheet = l.sheet AND n."row" = l."row" + dr AND n.col = l.col + dc
        WHERE l.role = 'label' AND n.role IN ('input', 'output', 'intermediate')""",
)
def _(load):
    return grid.neighbour_join(roles(load))


@query(
    "nearest_label",
    f"""WITH {ROLES_SQL}, l AS (SELECT *, CASE WHEN role IN ('label', 'structural') THEN trim(value) END AS text FROM roles),
        w AS (SELECT address, role, coalesce(last_value(text IGNORE NULLS) OVER (PARTITION BY sheet, "row" ORDER BY col),
              last_value(text IGNORE NULLS) OVER (PARTITION BY sheet, col ORDER BY "row")) AS label FROM l)
        SELECT address, label FROM w WHERE role IN ('input', 'output', 'intermediate')""",
)
def _(load):
    return grid.nearest_label(label_texts(load)).select("address", "label")


_LINES = """lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents)"""


def document_lines(load):
    return load("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


@query(
    "section_of",
    f"""WITH {_LINES} SELECT doc_id, n, coalesce(last_value(CASE WHEN length(line) <= 30 THEN line END IGNORE NULLS)
          OVER (PARTITION BY doc_id ORDER BY n), 'General') AS section FROM lines""",
)
def _(load):
    heading = F.when(F.length("line") <= 30, F.col("line"))
    return grid.section_of(document_lines(load), ["doc_id"], "n", heading).select("doc_id", "n", "section")


@query(
    "section_bounds",
    f"""WITH {_LINES}, h AS (SELECT doc_id, n FROM lines WHERE length(line) <= 30)
        SELECT doc_id, n, n + 1 AS first_row, lead(n) OVER (PARTITION BY doc_id ORDER BY n) - 1 AS last_row FROM h""",
)
def _(load):
    headings = document_lines(load).filter(F.length("line") <= 30).select("doc_id", "n")
    return grid.section_bounds(headings, ["doc_id"], "n")


@query(
    "cell_addresses",
    f"""WITH {CELLS_SQL} SELECT address, "row" AS r, col AS c, 'AAA' AS far FROM cells""",
)
def _(load):
    address = F.col("address")
    return cells(load).select(
        "address", X.address_row(address).alias("r"), X.address_column(address).alias("c"),
        X.column_letters(F.lit(702) + F.col("col") - F.col("col") + 1).alias("far"),
    )
