"""Two-pass external shuffle into training shards.

The first pass scatters the rows uniformly over memory-sized buckets with seeded hashes; the second
shuffles each bucket by Fisher-Yates and writes it. A shard is a run of buckets, so neither a shard nor
the table ever has to fit into memory, and reading a shard's buckets in order reads a uniform shuffle.

A row's shard depends on ``doc_id`` and the number of shards only: shard ``j`` takes a row when its hash
for ``j`` is below 1/(j+1), and the last taker keeps it. Growing by one shard therefore moves rows only
into the new one. The bucket inside the shard comes from the row's position in the input, so that a
``doc_id`` repeated on a third of all rows still spreads over all buckets of its shard.

Defined cases: a NULL ``doc_id`` is a value like any other; a NULL text counts as empty (size 1, CRC 0);
repeated rows each keep a slot; a text of any
length moves whole, and one longer than a bucket should be makes its bucket so much larger; an empty table gives no rows and no shards; an input column named like
an output column is replaced. The input must be repeatable row for row, such as a table scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import tidy
from gridloom.session import per_key, scratch_path

SHARDS = 16
SEED = 20240601
#: Text bytes that one bucket should hold; a task shuffles one bucket in memory.
BUCKET_BYTES = 24 << 20
OUT = ("size", "shard", "grown_shard", "bucket", "place", "slot")


def shard_of(doc_id: Column, shards: int, seed: int = SEED) -> Column:
    """The shard of a key among ``shards``; one more shard takes keys only into itself."""
    if shards <= 1:
        return F.lit(0)
    # 2**62 / (j + 1): the hash, cut to 62 bits, is below it with probability 1 / (j + 1).
    takes = F.filter(
        F.sequence(F.lit(1), F.lit(shards - 1)),
        lambda j: F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id, j), 2)
        < (F.lit(1 << 62) / (j + 1)).cast("long"),
    )
    return F.coalesce(F.array_max(takes), F.lit(0))


def _fisher_yates(seed: int):
    """Put one bucket's rows into input order, then permute them with a generator seeded by the bucket."""

    def shuffle(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        order = np.argsort(table.column("_at").to_numpy(), kind="stable")
        # Generator.permutation is a Fisher-Yates shuffle.
        order = order[np.random.default_rng([seed, bucket]).permutation(len(order))]
        out = table.drop_columns(["_at"]).take(pa.array(order))
        return out.append_column("place", pa.array(np.arange(len(order), dtype=np.int64)))

    return shuffle


def shuffle_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, path: str | None = None
) -> DataFrame:
    """Write ``docs`` in shuffled order below ``path``, one folder per shard, and return the rows.

    Returned and written are the input columns and ``size, grown_shard, bucket, place``, with ``shard``
    from the folder; the returned rows also have ``slot``, the gapless place in the shard.
    """
    spark = docs.sparkSession
    rows = tidy(docs, taken=OUT)
    rows = rows.withColumns({
        "size": F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1,
        "shard": shard_of(F.col("doc_id"), shards, seed),
        "grown_shard": shard_of(F.col("doc_id"), shards + 1, seed),
    })
    # One row per shard; the number of shards is a parameter.
    load = {r["shard"]: r["bytes"] for r in rows.groupBy("shard").agg(F.sum("size").alias("bytes")).collect()}
    buckets = [max(1, -(-load.get(s, 0) // bucket_bytes)) for s in range(shards)]
    first = [sum(buckets[:s]) for s in range(shards + 1)]
    at = F.monotonically_increasing_id()
    in_shard = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("doc_id"), F.col("_at")), _pick(buckets, "shard"))
    scattered = (
        rows.withColumn("_at", at)
        .withColumn("bucket", (_pick(first, "shard") + in_shard).cast("long"))
        .repartition(max(1, first[-1]), "bucket")
    )
    kept = [f for f in scattered.schema.fields if f.name != "_at"]
    shuffled = scattered.groupBy("bucket").applyInArrow(
        _fisher_yates(seed), T.StructType([*kept, T.StructField("place", T.LongType())])
    )
    path = path or scratch_path(spark, "shards")
    shuffled.write.partitionBy("shard").parquet(path)
    schema = shuffled.schema
    written = spark.read.schema(T.StructType([*[f for f in schema if f.name != "shard"], schema["shard"]])).parquet(path)
    # Slots: places of the buckets before. One small row per bucket.
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    # Written first, so that its true size decides whether the texts need to be shuffled for the join.
    return written.join(per_key(offsets), "bucket").withColumn("slot", F.col("_before") + F.col("place")).drop("_before")


def _pick(values: list[int], index: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col(index) + 1)
