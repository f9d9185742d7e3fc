"""Ordered computations that stay spread out when one group holds most of the rows.

A plain window puts a whole group into one task. Here rows are range-partitioned by (group, order),
so that a large group spans many chunks; each chunk is computed on its own and a summary of one row
per (group, chunk) carries state from chunk to chunk. The chunks are written once to the shared
folder, because range boundaries come from a sample and both passes must see the same ones.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut_lineage, per_key

CHUNK = "_chunk"


def range_chunks(df: DataFrame, group: list[str], order: list[Column], chunks: int | None = None) -> DataFrame:
    """Add a chunk number that grows with (group, order); the rows are written and read back."""
    n = chunks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g) for g in group] + list(order)
    ranged = df.repartitionByRange(n, *keys).withColumn(CHUNK, F.spark_partition_id())
    return cut_lineage(ranged, "chunks", codec="zstd")


def _local(group: list[str], order: list[Column]):
    return Window.partitionBy(CHUNK, *group).orderBy(*order)


def _earlier(group: list[str]):
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    return w.orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def _crossing(rows: DataFrame, group: list[str]) -> DataFrame:
    """The rows of groups that may go on into a later chunk: the last group of each chunk, at most one a chunk.

    Chunks follow the order of the groups, so every other group lies in one chunk and has nothing to carry.
    """
    if not group:
        return rows
    ends = rows.groupBy(CHUNK).agg(F.max(F.struct(*group)).alias("_end")).select("_end").distinct()
    ends = per_key(ends.select(*[F.col("_end")[g].alias(f"_g{i}") for i, g in enumerate(group)]))
    on = [rows[g].eqNullSafe(ends[f"_g{i}"]) for i, g in enumerate(group)]
    return rows.join(ends, reduce(Column.__and__, on), "left_semi")


def _attach(rows: DataFrame, summary: DataFrame, group: list[str]) -> DataFrame:
    """Join the per-chunk carry back; NULL-safe on the group columns."""
    # What is carried is little: it is written, so that Spark sees its size and leaves the rows in place.
    summary = per_key(summary)
    renamed = summary.select(
        F.col(CHUNK).alias("_c"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        *[c for c in summary.columns if c != CHUNK and c not in group],
    )
    on = F.col(CHUNK) == F.col("_c")
    for i, g in enumerate(group):
        on = on & rows[g].eqNullSafe(renamed[f"_g{i}"])
    return rows.join(renamed, on, "left").drop("_c", *[f"_g{i}" for i in range(len(group))])


def running_number(
    df: DataFrame, group: list[str], order: list[Column], out: str, start: int = 1, chunks: int | None = None
) -> DataFrame:
    """Number the rows of each group in order, from ``start``."""
    rows = range_chunks(df, group, order, chunks)
    summary = (
        _crossing(rows, group).groupBy(CHUNK, *group).agg(F.count("*").alias("_n"))
        .withColumn("_before", F.sum("_n").over(_earlier(group))).filter("_before IS NOT NULL")
        .drop("_n")
    )
    numbered = rows.withColumn("_here", F.row_number().over(_local(group, order)))
    return (
        _attach(numbered, summary, group)
        .withColumn(out, F.coalesce("_before", F.lit(0).cast("bigint")) + F.col("_here") + F.lit(start - 1))
        .drop("_before", "_here", CHUNK)
    )


def running_sum(
    df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, chunks: int | None = None
) -> DataFrame:
    """Cumulative sum up to and including each row; the order must be total."""
    rows = range_chunks(df.withColumn("_v", value), group, order, chunks)
    summary = (
        _crossing(rows, group).groupBy(CHUNK, *group).agg(F.sum("_v").alias("_s"))
        .withColumn("_before", F.sum("_s").over(_earlier(group))).filter("_before IS NOT NULL")
        .drop("_s")
    )
    local = F.sum("_v").over(_local(group, order).rowsBetween(Window.unboundedPreceding, 0))
    return (
        _attach(rows.withColumn("_here", local), summary, group)
        .withColumn(out, F.when(F.col("_before").isNull(), F.col("_here")).otherwise(F.col("_before") + F.col("_here")))
        .drop("_before", "_here", "_v", CHUNK)
    )


def _last_per_chunk(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """For each (group, chunk) the last non-NULL value of all earlier chunks."""
    position = F.when(F.col("_v").isNotNull(), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return (
        _crossing(rows, group).groupBy(CHUNK, *group)
        .agg(F.max_by("_v", position).alias("_s"))
        .withColumn("_before", F.last("_s", ignorenulls=True).over(_earlier(group))).filter("_before IS NOT NULL")
        .drop("_s")
    )


def carry_last(
    df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, chunks: int | None = None
) -> DataFrame:
    """The last non-NULL ``value`` at or before each row of the group."""
    rows = range_chunks(df.withColumn("_v", value), group, order, chunks)
    summary = _last_per_chunk(rows, group, order)
    local = F.last("_v", ignorenulls=True).over(
        _local(group, order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        _attach(rows.withColumn("_here", local), summary, group)
        .withColumn(out, F.coalesce("_here", "_before"))
        .drop("_before", "_here", "_v", CHUNK)
    )


def previous_value(
    df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, chunks: int | None = None
) -> DataFrame:
    """The value of the row just before, NULL on the first row of the group."""
    boxed = F.struct(value.alias("v"))
    lagged = carry_last_strict(df, group, order, boxed, "_prev", chunks)
    return lagged.withColumn(out, F.col("_prev.v")).drop("_prev")


def carry_last_strict(
    df: DataFrame, group: list[str], order: list[Column], value: Column, out: str, chunks: int | None = None
) -> DataFrame:
    """Like :func:`carry_last`, looking only at rows before the current one."""
    rows = range_chunks(df.withColumn("_v", value), group, order, chunks)
    summary = _last_per_chunk(rows, group, order)
    local = F.last("_v", ignorenulls=True).over(
        _local(group, order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        _attach(rows.withColumn("_here", local), summary, group)
        .withColumn(out, F.coalesce("_here", "_before"))
        .drop("_before", "_here", "_v", CHUNK)
    )


def asof_lookup(
    left: DataFrame, right: DataFrame, key: str, value: str, forward: bool = False, out: str = "found"
) -> DataFrame:
    """For each left key the value of the nearest right key at or below it (or above, ``forward``).

    ``right`` must hold one row per key. Distinct left keys are looked up once and joined back, so a
    key repeated on a third of the rows costs one lookup.
    """
    asked = left.select(F.col(key).alias("_k")).filter("_k IS NOT NULL").distinct()
    boxed = F.struct(F.col(key).alias("k"), F.col(value).alias("v"))
    known = right.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_k"), F.lit(0).alias("_kind"), boxed.alias("_hit")
    )
    line = asked.select("_k", F.lit(1).alias("_kind")).unionByName(known, allowMissingColumns=True)
    # max_by needs an ascending position, so a forward search runs on the negated key.
    line = line.withColumn("_pos", -F.col("_k") if forward else F.col("_k"))
    order = [F.col("_pos"), F.col("_kind")]
    found = (
        carry_last(line, [], order, F.col("_hit"), "_found")
        .filter("_kind = 1")
        .select(F.col("_k").alias(key), F.col("_found.k").alias(f"{out}_key"), F.col("_found.v").alias(out))
    )
    return left.join(found, key, "left")
