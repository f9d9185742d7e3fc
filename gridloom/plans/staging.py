"""Staging text made from the line items, parts and suppliers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.loading import placeholders, surrogate


def staging_sales(load) -> DataFrame:
    """Every line item as text, with blanks and junk where real exports have them."""
    item, supp, order = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey")
    quantity = F.col("l_quantity").cast("decimal(12,2)").cast("string")
    price = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    return load("lineitem").select(
        F.when(item % 17 == 0, "n/a").when(item % 19 == 0, "").otherwise(quantity).alias("quantity"),
        F.concat(F.lit(" "), supp.cast("string"), F.lit(" ")).alias("client_num"),
        F.when(supp % 29 == 0, "-1").otherwise(price).alias("unit_price"),
        F.when(item % 37 == 0, "").otherwise(F.concat(F.lit("  Part "), item.cast("string"), F.lit(" "))).alias("product_name"),
        F.when(order % 43 == 0, F.lit(None)).when(order % 41 == 0, "")
        .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")).alias("sale_date"),
        F.concat(F.lit("P"), item.cast("string")).alias("sku"),
    )


def staging_clients(load) -> DataFrame:
    """Client numbers with names; every seventh name is missing."""
    key = F.col("s_suppkey")
    return load("supplier").select(
        F.concat(key.cast("string"), F.lit(" ")).alias("col0"),
        F.when(key % 7 != 0, F.concat(F.lit("  "), F.col("s_name"))).alias("client_name"),
    )


def products(load) -> DataFrame:
    key = F.col("p_partkey")
    return load("part").select(
        key.alias("product_id"),
        F.concat(F.lit("P"), key.cast("string")).alias("sku"),
        F.concat(F.lit("Part "), key.cast("string")).alias("product_name"),
        F.col("p_type").alias("category"),
        F.col("p_retailprice").cast("decimal(19,4)").alias("cost"),
        (F.col("p_size") == 50).alias("is_deleted"),
    )


def clients_before(load) -> DataFrame:
    """The client table before the load: suppliers with a good balance, the best ones deleted."""
    return load("supplier").filter("s_acctbal >= 6000").select(
        surrogate(F.lit("old"), "s_name").alias("client_id"),
        F.col("s_name").alias("client_name"),
        (F.col("s_acctbal") >= 9000).alias("is_deleted"),
    )


def clients_after(load) -> DataFrame:
    """The client table after new members and placeholders were added."""
    from gridloom.operators.loading import new_members

    before = clients_before(load)
    added = [
        new_members(staging_clients(load), F.col("client_name"), before, "client_name"),
        placeholders(staging_sales(load), before),
    ]
    out = before
    for names in added:
        out = out.unionByName(
            names.select(surrogate("client_name").alias("client_id"), "client_name", F.lit(False).alias("is_deleted"))
        )
    return out


STAGING_SQL = """
  staging_sales AS (SELECT
      CASE WHEN l_partkey % 17 = 0 THEN 'n/a' WHEN l_partkey % 19 = 0 THEN '' ELSE l_quantity::DECIMAL(12,2)::VARCHAR END AS quantity,
      ' ' || l_suppkey || ' ' AS client_num,
      CASE WHEN l_suppkey % 29 = 0 THEN '-1' ELSE l_extendedprice::DECIMAL(12,2)::VARCHAR END AS unit_price,
      CASE WHEN l_partkey % 37 = 0 THEN '' ELSE '  Part ' || l_partkey || ' ' END AS product_name,
      CASE WHEN l_orderkey % 43 = 0 THEN NULL WHEN l_orderkey % 41 = 0 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') END AS sale_date,
      'P' || l_partkey AS sku FROM lineitem),
  staging_clients AS (SELECT s_suppkey || ' ' AS col0, CASE WHEN s_suppkey % 7 <> 0 THEN '  ' || s_name END AS client_name FROM supplier),
  products AS (SELECT p_partkey AS product_id, 'P' || p_partkey AS sku, 'Part ' || p_partkey AS product_name, p_type AS category,
      p_retailprice::DECIMAL(19,4) AS cost, p_size = 50 AS is_deleted FROM part),
  clients_before AS (SELECT s_name AS client_name, s_acctbal >= 9000 AS is_deleted FROM supplier WHERE s_acctbal >= 6000),
  clients AS (SELECT * FROM clients_before
      UNION ALL SELECT DISTINCT trim(client_name), false FROM staging_clients WHERE trim(client_name) <> ''
        AND trim(client_name) NOT IN (SELECT client_name FROM clients_before WHERE NOT is_deleted)
      UNION ALL SELECT DISTINCT 'Client_' || trim(client_num), false FROM staging_sales WHERE trim(client_num) <> ''
        AND 'Client_' || trim(client_num) NOT IN (SELECT client_name FROM clients_before WHERE NOT is_deleted)),
  good AS (SELECT * FROM staging_sales WHERE regexp_full_match(quantity, '[0-9]+\\.?[0-9]*')
      AND regexp_full_match(unit_price, '[0-9]+\\.?[0-9]*') AND sale_date IS NOT NULL AND sale_date <> ''
      AND product_name IS NOT NULL AND product_name <> '')
"""

FACT_SQL = (
    STAGING_SQL
    + """, fact AS (SELECT p.product_id, c.client_name, round(s.quantity::DECIMAL(19,4), 0)::INT AS quantity,
      s.unit_price::DECIMAL(19,4)::DOUBLE AS unit_price, s.sale_date AS sale_date
    FROM good s JOIN products p ON trim(p.product_name) = trim(s.product_name) AND NOT p.is_deleted
    LEFT JOIN staging_clients sc ON trim(sc.col0) = trim(s.client_num)
    LEFT JOIN clients c ON trim(c.client_name) = CASE WHEN sc.client_name IS NOT NULL THEN trim(sc.client_name)
      ELSE 'Client_' || trim(s.client_num) END AND NOT c.is_deleted)
"""
)
