"""Minimal composite keys by refining partitions, level by level."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

#: Rows that still share their values with others are written apart when they are at most this share of a table.
STRIP = 0.5


@dataclass
class _Partition:
    """Rows that a set of columns does not tell apart: a table, and the columns that split it further.

    The table's ``_group`` identifies the classes of an earlier, smaller set; rows alone in their class are gone.
    """

    table: DataFrame
    rows: int
    by: tuple[str, ...]

    def refined(self, column: str) -> _Partition:
        """One aggregate counts the rows that the column leaves together; their classes get an identifier of their own."""
        by = (*self.by, column)
        classes = self.table.groupBy("_group", *by).agg(F.count("*").alias("_n"), F.min("_row").alias("_first")).filter("_n > 1")
        left = classes.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
        if left == 0 or left > STRIP * self.rows:
            return _Partition(self.table, left, by)
        # The smallest row number of a class names it exactly.
        named = classes.select("_group", *by, "_first")
        kept = self.table.join(named, ["_group", *by]).drop("_group").withColumnRenamed("_first", "_group")
        return _Partition(cut_lineage(kept, "key-classes"), left, ())


def minimal_keys(df: DataFrame, columns: list[str], width: int = 4) -> DataFrame:
    """All sets of up to ``width`` columns whose values tell every row apart and that hold no smaller such set.

    ``key`` joins the names with ``+`` in the order of ``columns``; ``width`` counts them. Columns with missing
    values take no part. A table with two equal rows, or without rows, has no key. Each candidate costs one
    aggregate over the rows that its best known subset leaves together, which soon are few; candidates whose numbers
    of values cannot reach the number of rows are not tried, and supersets of keys are none.
    """
    spark = df.sparkSession
    rows = cut_lineage(df.select(*columns).withColumn("_row", F.monotonically_increasing_id()), "key-rows")
    # One small aggregate a column; a single distinct in each.
    filled = rows.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in columns]).first()
    total = filled["_n"]
    usable = [c for c in columns if filled[c] == total]
    found: list[tuple[str, ...]] = []
    if total and usable:
        whole = _Partition(rows.withColumn("_group", F.lit(-1).cast("long")), total, ())
        everything = rows.groupBy(*usable).count().filter("count > 1").isEmpty()
        if everything:
            found = _search(whole, usable, min(width, len(usable)))
    return spark.createDataFrame([("+".join(k), len(k)) for k in found], "key string, width int")


def _search(whole: _Partition, columns: list[str], width: int) -> list[tuple[str, ...]]:
    values = {c: whole.table.agg(F.countDistinct(c)).first()[0] for c in columns}
    found: list[tuple[str, ...]] = []
    known: dict[tuple[str, ...], _Partition] = {(): whole}
    for size in range(1, width + 1):
        reached: dict[tuple[str, ...], _Partition] = {}
        for candidate in combinations(columns, size):
            if any(set(key) <= set(candidate) for key in found):
                continue
            if size == width and _most(values, candidate) < whole.rows:
                continue
            # A subset that was not worth refining has the partition of a smaller one.
            parents = [(known[p], c) for c in candidate if (p := tuple(x for x in candidate if x != c)) in known]
            parent, column = min(parents, key=lambda pc: (pc[0].rows, -values[pc[1]]))
            part = parent.refined(column)
            if part.rows == 0:
                found.append(candidate)
            else:
                reached[candidate] = part
        known = reached
    return found


def _most(values: dict[str, int], columns: tuple[str, ...]) -> int:
    product = 1
    for c in columns:
        product *= values[c]
    return product
