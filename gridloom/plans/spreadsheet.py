"""Conditional aggregates and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.criteria import average_ifs, count_ifs, sum_ifs
from gridloom.operators.spreadsheet import basic_aggregates, pivot_table
from gridloom.plans.registry import query

_PRICE = "l_extendedprice::DECIMAL(19,4)"


def _price():
    return F.col("l_extendedprice").cast("decimal(19,4)")


@query(
    "sum_if",
    f"""SELECT l_linestatus, coalesce(sum({_PRICE}) FILTER (l_quantity >= 30), 0)::DOUBLE AS big,
        coalesce(sum(l_quantity::DECIMAL(19,4)) FILTER (l_quantity > 45), 0)::DOUBLE AS own_range,
        coalesce(sum({_PRICE}) FILTER (l_returnflag ILIKE 'x%'), 0)::DOUBLE AS none FROM lineitem GROUP BY 1""",
)
def _(load):
    qty = F.col("l_quantity")
    return load("lineitem").groupBy("l_linestatus").agg(
        sum_ifs(_price(), (qty, ">=30", True)).cast("double").alias("big"),
        sum_ifs(qty.cast("decimal(19,4)"), (qty, ">45", True)).cast("double").alias("own_range"),
        sum_ifs(_price(), (F.col("l_returnflag"), "x*")).cast("double").alias("none"),
    )


@query(
    "sum_ifs",
    f"""SELECT l_suppkey, coalesce(sum({_PRICE}) FILTER (l_quantity >= 10 AND l_quantity < 40 AND l_returnflag = 'R'), 0)::DOUBLE AS total
        FROM lineitem GROUP BY 1""",
)
def _(load):
    qty = F.col("l_quantity")
    hit = sum_ifs(_price(), (qty, ">=10", True), (qty, "<40", True), (F.col("l_returnflag"), "R"))
    return load("lineitem").groupBy("l_suppkey").agg(hit.cast("double").alias("total"))


@query("count_if", "SELECT o_custkey, count(*) FILTER (o_orderpriority ILIKE '%-high') AS n FROM orders GROUP BY 1")
def _(load):
    return load("orders").groupBy("o_custkey").agg(count_ifs((F.col("o_orderpriority"), "*-high")).alias("n"))


@query(
    "count_ifs",
    "SELECT o_custkey, count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice >= 100000) AS n FROM orders GROUP BY 1",
)
def _(load):
    pairs = ((F.col("o_orderstatus"), "<>F"), (F.col("o_totalprice"), ">=100000", True))
    return load("orders").groupBy("o_custkey").agg(count_ifs(*pairs).alias("n"))


@query(
    "average_ifs",
    """SELECT o_custkey, coalesce((sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderstatus = 'O' AND o_totalprice > 400000))::DOUBLE
        / (count(*) FILTER (o_orderstatus = 'O' AND o_totalprice > 400000)), 0.0) AS mean FROM orders GROUP BY 1""",
)
def _(load):
    pairs = ((F.col("o_orderstatus"), "=O"), (F.col("o_totalprice"), ">400000", True))
    value = F.col("o_totalprice").cast("decimal(19,4)")
    return load("orders").groupBy("o_custkey").agg(average_ifs(value, *pairs).alias("mean"))


@query(
    "basic_aggregates",
    f"""WITH t AS (SELECT l_returnflag, CASE WHEN l_returnflag <> 'N' THEN {_PRICE} END AS v FROM lineitem)
        SELECT l_returnflag, coalesce(sum(v), 0)::DOUBLE AS total, coalesce(sum(v)::DOUBLE / count(v), 0.0) AS mean,
        coalesce(min(v), 0)::DOUBLE AS low, coalesce(max(v), 0)::DOUBLE AS high FROM t GROUP BY 1""",
)
def _(load):
    value = F.when(F.col("l_returnflag") != "N", _price())
    return basic_aggregates(load("lineitem"), ["l_returnflag"], value)


@query(
    "pivot_table",
    """SELECT o_orderpriority, (sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderstatus = 'F'))::DOUBLE AS "F",
        (sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderstatus = 'O'))::DOUBLE AS "O",
        (sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderstatus = 'P'))::DOUBLE AS "P",
        (sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderstatus IS NULL))::DOUBLE AS "null"
       FROM (SELECT * EXCLUDE (o_orderstatus), CASE WHEN o_orderkey % 97 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders) WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY 1""",
)
def _(load):
    recent = load("orders").filter("o_orderdate >= timestamp_ntz'1997-01-01'")
    total = F.sum(F.col("o_totalprice").cast("decimal(19,4)")).cast("double")
    status = F.when(F.col("o_orderkey") % 97 != 0, F.col("o_orderstatus"))
    return pivot_table(recent.withColumn("o_orderstatus", status), ["o_orderpriority"], "o_orderstatus", total)


@query(
    "pivot_with_headings",
    """SELECT o_orderpriority, (sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderstatus = 'F'))::DOUBLE AS "F",
        (sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderstatus <> 'F'))::DOUBLE AS "(other)" FROM orders GROUP BY 1""",
)
def _(load):
    total = F.sum(F.col("o_totalprice").cast("decimal(19,4)")).cast("double")
    return pivot_table(load("orders"), ["o_orderpriority"], "o_orderstatus", total, headings=["F"])
