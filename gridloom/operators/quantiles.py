"""Exact quantiles by narrowing histograms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
_TARGET = "tid int, column string, rank bigint, lo double, hi double"


def _long(df: DataFrame, columns: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.*").filter(finite(F.col("v")))


def finite(value: Column) -> Column:
    """True for numbers that are neither NULL, NaN nor infinite."""
    return F.coalesce(F.abs(value.cast("double")) < F.lit(float("inf")), F.lit(False))


def _share(value: Column, low: Column, high: Column) -> Column:
    """Place of a value between two others, 0 to 1; halves keep the widest brackets from overflowing."""
    return F.when(high - low < F.lit(float("inf")), (value - low) / (high - low)).otherwise(
        (value / 2 - low / 2) / (high / 2 - low / 2)
    )


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float]) -> dict[tuple[str, float], float]:
    """Linearly interpolated quantiles of the finite values of numeric columns.

    A bracket's ends fall into different buckets, so every pass leaves a smaller bracket.

    Every wanted rank is bracketed by the smallest and largest value it can be. A pass counts the
    values of each bracket in buckets and keeps the bucket that holds the rank, until a bracket is a
    single value. A pass returns at most one row per rank to the driver and shuffles only counts,
    so neither the number of distinct values nor a repeated value matters.
    """
    spark = df.sparkSession
    bounds = df.agg(
        *[F.count_if(finite(F.col(c))).alias(f"n_{c}") for c in columns],
        *[F.min(F.when(finite(F.col(c)), F.col(c).cast("double"))).alias(f"lo_{c}") for c in columns],
        *[F.max(F.when(finite(F.col(c)), F.col(c).cast("double"))).alias(f"hi_{c}") for c in columns],
    ).first()
    open_targets, found = {}, {}
    for c in columns:
        n = bounds[f"n_{c}"]
        for p in probabilities if n else []:
            for rank in {math.floor((n - 1) * p), math.ceil((n - 1) * p)}:
                open_targets[(c, rank)] = (rank, bounds[f"lo_{c}"], bounds[f"hi_{c}"])
    rows = _long(df, columns)
    while open_targets:
        for key, (_, lo, hi) in list(open_targets.items()):
            if lo == hi:
                found[key] = lo
                del open_targets[key]
        if not open_targets:
            break
        keys = list(open_targets)
        targets = spark.createDataFrame(
            [(i, k[0], *open_targets[k]) for i, k in enumerate(keys)], _TARGET
        )
        spot = F.least(F.floor(_share(F.col("v"), F.col("lo"), F.col("hi")) * BUCKETS), F.lit(BUCKETS - 1))
        counted = (
            rows.join(F.broadcast(targets), "column").filter("v BETWEEN lo AND hi")
            .groupBy("tid", "rank", spot.alias("bucket"))
            .agg(F.count("*").alias("n"), F.min("v").alias("vmin"), F.max("v").alias("vmax"))
        )
        upto = F.sum("n").over(Window.partitionBy("tid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        hits = (
            counted.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("n"))
            .filter("below <= rank AND rank < upto").collect()
        )
        for h in hits:
            open_targets[keys[h["tid"]]] = (h["rank"] - h["below"], h["vmin"], h["vmax"])
    result = {}
    for c in columns:
        n = bounds[f"n_{c}"]
        for p in probabilities if n else []:
            at = (n - 1) * p
            low, high = found[(c, math.floor(at))], found[(c, math.ceil(at))]
            part = at - math.floor(at)
            # A weighted mean, since the difference of two large values may overflow.
            result[(c, p)] = low + (high - low) * part if math.isfinite(high - low) else low * (1 - part) + high * part
    return result
