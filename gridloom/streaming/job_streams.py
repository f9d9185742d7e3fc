"""Structured Streaming over file arrivals and job events.

Every stream runs with ``availableNow`` here and keeps its checkpoint in the shared folder; a
long-running job only needs another trigger. State lives in the RocksDB store, so it may exceed the
memory of an executor.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.session import scratch_path
from gridloom.sources.files import file_type, route
from gridloom.streaming.keyed_state import ROCKSDB, STATE_STORE

#: Batches of updates kept apart before they are reduced to one row per key.
COMPACT = 8
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def event_stream(spark: SparkSession, root: str, name: str = "events") -> DataFrame:
    """The event table as a stream; times become instants, which watermarks need."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", f"{name}.parquet").parquet(root)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def _finish(
    df: DataFrame, mode: str, sink: Callable[[DataFrame, int], None], checkpoint: str | None = None, by_clock: bool = False
) -> int:
    """Run a stream to the end of its input; the number of rows that came behind the watermark.

    With a ``checkpoint`` of an earlier run the stream goes on where that one ended. State that expires ``by_clock``
    would make ``availableNow`` run empty batches for ever, so such a stream takes what is there in one batch.
    """
    spark = df.sparkSession
    spark.conf.set(STATE_STORE, ROCKSDB)
    # A busy key's sessions merge inside each partition before they are shuffled.
    spark.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    writer = df.writeStream.outputMode(mode).foreachBatch(sink).trigger(**{"once" if by_clock else "availableNow": True})
    run = writer.option("checkpointLocation", checkpoint or scratch_path(spark, "stream-checkpoint")).start()
    try:
        run.awaitTermination()
        return sum(
            int(state.get("numRowsDroppedByWatermark", 0)) for batch in run.recentProgress for state in batch["stateOperators"]
        )
    finally:
        run.stop()


def run_to_table(df: DataFrame) -> DataFrame:
    """Run an append-mode stream to the end of its input and read back what it wrote."""
    return run_counting_late(df)[0]


def run_counting_late(df: DataFrame, checkpoint: str | None = None) -> tuple[DataFrame, int]:
    """What an append-mode stream wrote, and how many rows came behind the watermark.

    A batch that is written again after a failure replaces its own folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    late = _finish(df, "append", write, checkpoint)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns), late


def latest_per_key(df: DataFrame, keys: list[str], checkpoint: str | None = None, by_clock: bool = False) -> DataFrame:
    """Run an update-mode stream and keep the newest row of each key among what this run tells.

    Every ``COMPACT`` batches, and at the end, the rows written so far are reduced to one per key. A
    compacted folder is complete before its name is noted, so a failure leaves the older ones valid.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stream")
    values = [c for c in df.columns if c not in keys]
    live: dict[int, str] = {}

    def newest() -> DataFrame:
        rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])).parquet(*live.values())
        picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*values, "_batch"), "_batch").alias("v"))
        return picked.select(*keys, *[F.col(f"v.{c}").alias(c) for c in values], F.col("v._batch").alias("_batch"))

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/batch-{number}")
        live[number] = f"{path}/batch-{number}"
        if len(live) > COMPACT:
            folded = f"{path}/upto-{number}"
            newest().write.mode("overwrite").parquet(folded)
            live.clear()
            live[number] = folded

    _finish(df, "update", write, checkpoint, by_clock)
    if not live:
        return spark.createDataFrame([], df.schema)
    return newest().select(*df.columns)


def arrivals_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive, with type and route; the bytes are not kept."""
    found = (
        spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("recursiveFileLookup", "true")
        .load(folder).select("path", "length", "modificationTime")
    )
    return found.withColumn("file_type", file_type(F.col("path"))).withColumn(
        "route", F.coalesce(route(F.col("file_type")), F.lit("rejected"))
    )


def dedupe_stream(events: DataFrame, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """Skip events whose key was seen before, as far back as the watermark reaches."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def progress_counts_stream(events: DataFrame, length: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Events per status in tumbling or sliding windows; rows behind the watermark are dropped."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    counted = events.withWatermark("ts", delay).groupBy(span.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "event_type", "n")


def sessions_stream(events: DataFrame, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Closed bursts of activity per key, with the status of the last event.

    Of events of one instant the one with the greater ``event_id`` is the last.
    """
    sessions = events.withWatermark("ts", delay).groupBy(key, F.session_window("ts", gap).alias("s")).agg(
        F.count("*").alias("n"), F.max("ts").alias("last_update"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("last_status"),
    )
    return sessions.select(key, F.col("s.start").alias("start"), F.col("s.end").alias("stop"), "n", "last_update", "last_status")
