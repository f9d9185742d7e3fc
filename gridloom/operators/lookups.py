"""Exact lookups and reviewers' overrides."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import batched

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gridloom.session import per_key


def lookup_exact(
    left: DataFrame, left_key: str, right: DataFrame, right_key: str, value: str, position: list[Column],
    default: Column, last: bool = False, out: str = "found",
) -> DataFrame:
    """The value of the first (or last) right row with the key, else ``default``.

    The pick is an aggregate, so a key repeated many times shrinks on the map side.
    """
    spot = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(position)])
    pick = F.max_by(value, spot) if last else F.min_by(value, spot)
    single = per_key(right.groupBy(F.col(right_key).alias(left_key)).agg(pick.alias("_v")))
    return left.join(single, left_key, "left").withColumn(out, F.coalesce("_v", default)).drop("_v")


# Fixed value: decisions below this confidence go to a reviewer.
REVIEW_BELOW = 0.7


def override_join(guesses: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Answers replace low-confidence guesses; those without an answer are flagged."""
    low = F.col("confidence") < REVIEW_BELOW
    return (
        guesses.join(answers, key, "left")
        .withColumn("decision", F.when(low, F.coalesce("answer", "guess")).otherwise(F.col("guess")))
        .withColumn("needs_review", low & F.col("answer").isNull())
    )


#: Scenarios that one pass over the rows evaluates; their aggregates stand side by side in one plan.
SCENARIOS_AT_ONCE = 50


def scenario_grid(
    df: DataFrame, by: list[str], scenarios: DataFrame, name: str, measure: Callable[[Row], Column], out: str, count: str = "n"
) -> DataFrame:
    """``name, *by, out, count``: an aggregate of the rows of each group under every scenario of a table.

    ``measure`` makes the aggregate from a scenario's row. Scenarios come in groups of ``SCENARIOS_AT_ONCE``, so the
    driver never holds more of them, and no row is multiplied: each group is one pass over ``df`` whose result
    is a few rows per group of ``by``. Without scenarios there are no rows; names must be distinct.
    """
    if scenarios.groupBy(name).count().filter("count > 1").limit(1).count():
        raise ValueError(f"scenarios share a {name}")
    parts = []
    for group in batched(scenarios.orderBy(name).toLocalIterator(), SCENARIOS_AT_ONCE):
        sums = [measure(row).alias(f"_s{i}") for i, row in enumerate(group)]
        wide = df.groupBy(*by).agg(*sums, F.count("*").alias(count))
        cells = F.array(*[F.struct(F.lit(row[name]).alias(name), F.col(f"_s{i}").alias(out)) for i, row in enumerate(group)])
        parts.append(wide.select(*by, count, F.explode(cells).alias("_c")).select(f"_c.{name}", *by, f"_c.{out}", count))
    if not parts:
        # The same columns from no scenario at all.
        blank = df.limit(0).groupBy(*by).agg(F.lit(None).cast("double").alias(out), F.count("*").alias(count))
        return blank.select(F.lit(None).cast(scenarios.schema[name].dataType).alias(name), *by, out, count)
    return reduce(DataFrame.unionByName, parts)
