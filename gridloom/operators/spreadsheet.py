"""Plain aggregates with spreadsheet defaults, and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def basic_aggregates(df: DataFrame, by: list[str], value: Column) -> DataFrame:
    """SUM, AVERAGE, MIN and MAX; a group without values gives 0."""
    zero = F.lit(0.0)
    total, n = F.sum(value).cast("double"), F.count(value).cast("double")
    return df.groupBy(*by).agg(
        F.coalesce(total, zero).alias("total"),
        F.coalesce(F.try_divide(total, n), zero).alias("mean"),
        F.coalesce(F.min(value).cast("double"), zero).alias("low"),
        F.coalesce(F.max(value).cast("double"), zero).alias("high"),
    )


def pivot_table(df: DataFrame, rows: list[str], columns: str, value: Column, headings: list | None = None) -> DataFrame:
    """Rows by columns, one for each value found, in order; NULL becomes ``null``.

    With ``headings`` only those columns come out, and the rows of all other values are summed up in
    ``(other)``, so that nothing is lost. Spark refuses more than ``spark.sql.pivotMaxValues`` columns.
    """
    if headings is None:
        return df.groupBy(*rows).pivot(columns).agg(value)
    known = F.col(columns).cast("string").isin([str(h) for h in headings])
    named = df.withColumn(columns, F.when(known, F.col(columns).cast("string")).otherwise("(other)"))
    return named.groupBy(*rows).pivot(columns, [*map(str, headings), "(other)"]).agg(value)
