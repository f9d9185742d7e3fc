"""Arriving delimited files loaded into a typed table, each row once.

A batch's rows go into a folder of their own, and then a ledger row per file (batch, file, rows) makes them part of
the table: readers see only folders that the ledger names. A batch that dies before its ledger row is written again
from the start; one that dies after it is found in the ledger and left alone. Files are known by name, so a lost
checkpoint does not load them twice either.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.dates import to_timestamp_coerce
from gridloom.functions.numbers import to_bigint, to_boolean, to_decimal
from gridloom.functions.text import null_if_blank
from gridloom.session import per_key

_LEDGER = "batch string, file string, rows bigint"


def _typed(text: Column, kind: T.DataType) -> Column:
    """Text as the given type; NULL where it does not read as such."""
    text = null_if_blank(text)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType)):
        return to_bigint(text).try_cast(kind)
    if isinstance(kind, (T.DecimalType, T.DoubleType, T.FloatType)):
        return to_decimal(text).try_cast(kind)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return to_timestamp_coerce(text).try_cast(kind)
    return to_boolean(text) if isinstance(kind, T.BooleanType) else text


class ArrivalTable:
    """A typed table below ``path`` that delimited files with a header flow into.

    ``schema`` names the columns and their types; texts that do not read as their type are NULL and counted in
    the row's ``unreadable``.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromDDL(schema)

    def _fs(self, path: str):
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def ledger(self) -> DataFrame:
        """``batch, file, rows`` of everything committed."""
        folder, fs = self._fs(f"{self.path}/ledger")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], _LEDGER)
        # Entries under way have names that begin with an underscore, which readers skip.
        return self.spark.read.schema(_LEDGER).option("recursiveFileLookup", "true").parquet(f"{self.path}/ledger")

    def rows(self) -> DataFrame:
        """The committed rows: columns of the schema, ``unreadable``, ``file`` and ``batch``."""
        schema = T.StructType([*self.schema.fields, T.StructField("unreadable", T.IntegerType()), T.StructField("file", T.StringType()), T.StructField("batch", T.StringType())])
        folder, fs = self._fs(f"{self.path}/rows")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        # One row per batch: Spark turns the join into a choice of folders.
        return stored.join(per_key(self.ledger().select("batch").distinct()), "batch", "left_semi").select(*schema.names)

    def _write(self, batch: DataFrame, name: str, before_commit: Callable[[], None]) -> None:
        done = self.ledger()
        if not done.filter(F.col("batch") == name).isEmpty():
            return
        names = [f.name for f in self.schema.fields]
        values = [_typed(F.col(f.name), f.dataType).alias(f.name) for f in self.schema.fields]
        unread = sum(((null_if_blank(F.col(n)).isNotNull() & _typed(F.col(n), f.dataType).isNull()).cast("int") for n, f in zip(names, self.schema.fields)), F.lit(0))
        fresh = batch.join(per_key(done.select("file").distinct()), "file", "left_anti")
        folder = f"{self.path}/rows/batch={name}"
        fresh.select(*values, unread.alias("unreadable"), "file").write.mode("overwrite").parquet(folder)
        before_commit()
        # From what was written, not from the batch: the ledger tells what readers will find.
        written = self.spark.read.parquet(folder).groupBy("file").agg(F.count("*").alias("rows"))
        entry, under_way = f"{self.path}/ledger/batch={name}", f"{self.path}/ledger/_{uuid.uuid4().hex}"
        written.select(F.lit(name).alias("batch"), "file", "rows").write.parquet(under_way)
        source, fs = self._fs(under_way)
        if not fs.rename(source, self._fs(entry)[0]):
            raise OSError(f"ledger entry {entry} could not be put in place")

    def load(self, folder: str, checkpoint: str, delimiter: str = ",", files_per_batch: int | None = None,
             before_commit: Callable[[], None] = lambda: None) -> None:
        """Take in what has arrived in ``folder`` since the last call with this ``checkpoint``.

        ``before_commit`` is called between a batch's rows and its ledger entry.
        """
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in self.schema.fields])
        reader = self.spark.readStream.schema(text).option("header", True).option("sep", delimiter).option("recursiveFileLookup", "true")
        reader = reader.option("pathGlobFilter", "*.csv")
        stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).csv(folder)
        stream = stream.withColumn("file", F.col("_metadata.file_path"))

        def sink(batch: DataFrame, number: int) -> None:
            # The stream's own id stays the same as long as its checkpoint does.
            run = self.spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
            self._write(batch, f"{run}-{number}", before_commit)

        run = stream.writeStream.foreachBatch(sink).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
        try:
            run.awaitTermination()
        finally:
            run.stop()
