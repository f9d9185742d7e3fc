"""Star-schema loading: guards, new members, fallbacks and fact rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.numbers import not_blank, numeric_guard, rounded_int

PLACEHOLDER = "Client_"


def surrogate(*keys: Column) -> Column:
    """A member id computed from its natural key, so that tasks need no shared counter."""
    return F.xxhash64(*keys)


def alive(dim: DataFrame, flag: str = "is_deleted") -> DataFrame:
    return dim.filter(~F.col(flag))


def new_members(staged: DataFrame, name: Column, dim: DataFrame, member: str) -> DataFrame:
    """Distinct trimmed non-blank names that no live member of ``dim`` carries."""
    wanted = staged.select(F.trim(name).alias(member)).filter(F.col(member) != "").distinct()
    known = alive(dim).select(member).filter(F.col(member).isNotNull())
    return wanted.join(known, member, "left_anti")


def absent_rows(seed: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """Seed rows whose key the target does not hold yet."""
    return seed.join(target.select(key), key, "left_anti")


def append_new(target: DataFrame, incoming: DataFrame, key: list[str], prefer: list[Column]) -> DataFrame:
    """Target plus the incoming rows with new keys; one row per new key, the first by ``prefer``.

    The pick is a ``min`` aggregate, so repeated keys shrink before the shuffle.
    """
    rest = [c for c in target.columns if c not in key]
    order = [p.alias(f"_p{i}") for i, p in enumerate(prefer)]
    single = (
        incoming.withColumn("_row", F.struct(*order, *[F.col(c) for c in rest]))
        .groupBy(*key)
        .agg(F.min("_row").alias("_row"))
        .select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])
    )
    fresh = single.join(target.select(*key), key, "left_anti")
    return target.unionByName(fresh)


def placeholders(sales: DataFrame, dim: DataFrame) -> DataFrame:
    """Placeholder names for every client number in the sales that has none yet."""
    number = F.trim(F.col("client_num"))
    named = sales.select(F.when(number != "", F.concat(F.lit(PLACEHOLDER), number)).alias("n"))
    return new_members(named, F.col("n"), dim, "client_name")


def guarded_sales(sales: DataFrame) -> DataFrame:
    """Staged rows that pass the load guards."""
    return sales.filter(
        numeric_guard(F.col("quantity"))
        & numeric_guard(F.col("unit_price"))
        & not_blank(F.col("sale_date"))
        & not_blank(F.col("product_name"))
    )


def _measures() -> list[Column]:
    return [
        rounded_int(F.col("quantity")).alias("quantity"),
        F.col("unit_price").try_cast("decimal(19,4)").alias("unit_price"),
        F.col("sale_date").try_cast("timestamp").alias("sale_datetime"),
    ]


def product_map(products: DataFrame) -> DataFrame:
    return alive(products).select("product_id", F.trim("product_name").alias("_product"))


def client_map(staged_clients: DataFrame, clients: DataFrame) -> DataFrame:
    """Client number to live client, for the numbers whose name is known."""
    known = staged_clients.filter(F.col("client_name").isNotNull()).select(
        F.trim("col0").alias("_num"), F.trim("client_name").alias("_name")
    )
    members = alive(clients).select("client_id", F.trim("client_name").alias("_name"))
    return known.join(members, "_name", "left").select(
        "_num", "client_id", F.col("_name").alias("client_name")
    )


def fact_load(sales: DataFrame, products: DataFrame, staged_clients: DataFrame, clients: DataFrame) -> DataFrame:
    """Typed sales whose product and client are both known."""
    numbers = client_map(staged_clients, clients).filter(F.col("client_id").isNotNull())
    return (
        guarded_sales(sales)
        .withColumn("_product", F.trim("product_name"))
        .withColumn("_num", F.trim("client_num"))
        .join(product_map(products), "_product")
        .join(numbers, "_num")
        .select("product_id", "client_id", "client_name", *_measures())
    )


def fact_load_with_fallback(
    sales: DataFrame, products: DataFrame, staged_clients: DataFrame, clients: DataFrame
) -> DataFrame:
    """Typed sales of known products; unknown clients fall back to their placeholder member.

    The choice between a name and its placeholder is made on the two dimension tables, so the fact
    meets one client table in one equality join.
    """
    known = client_map(staged_clients, clients)
    reserve = (
        alive(clients)
        .filter(F.startswith(F.trim("client_name"), F.lit(PLACEHOLDER)))
        .select(
            F.regexp_replace(F.trim("client_name"), f"^{PLACEHOLDER}", "").alias("_num"),
            "client_id",
            F.trim("client_name").alias("client_name"),
        )
        .join(known.select("_num"), "_num", "left_anti")
    )
    members = known.unionByName(reserve)
    return (
        guarded_sales(sales)
        .withColumn("_product", F.trim("product_name"))
        .withColumn("_num", F.trim("client_num"))
        .join(product_map(products), "_product")
        .join(members, "_num", "left")
        .select("product_id", "client_id", "client_name", *_measures())
    )


def pattern_join(df: DataFrame, name: Column, patterns: dict[str, str], out: str) -> DataFrame:
    """One row per pattern that the name contains; ``patterns`` maps a key to its LIKE pattern.

    The patterns are part of the job, so they are tested in place of a nested-loop join.
    """
    tests = [F.when(name.like(p), F.lit(k)) for k, p in patterns.items()]
    hits = F.filter(F.array(*tests), lambda k: k.isNotNull())
    return df.withColumn(out, F.explode(hits))


def dimension_activity(dim: DataFrame, fact: DataFrame, key: str, labels: list[str], out: str) -> DataFrame:
    """Live members with the number of their live fact rows, zero kept."""
    counts = alive(fact).groupBy(key).agg(F.count("*").alias(out))
    return alive(dim).join(counts, key, "left").select(*labels, F.coalesce(out, F.lit(0)).alias(out))


def metric_rows(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row per metric name with the row count of its table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("metric"), "n") for k, df in metrics.items()]
    return reduce(DataFrame.unionByName, rows)
