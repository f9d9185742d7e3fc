"""Session helper and shared scratch space."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_scratch: dict[str, str] = {}
_steps = threading.local()
FOLDER = "gridloom-scratch"


def get_session(app_name: str = "gridloom", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and the bench; on a cluster pass your own session instead."""
    master = f"local[{cores or os.cpu_count() or 4}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(cores or os.cpu_count() or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _scratch_root(spark: SparkSession) -> str:
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_CHECKPOINT_KEY} must name a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="gridloom-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder named by ``spark.checkpoint.dir``, below one folder per application.

    Where the setting is absent a local master, as in tests, gets a folder of its own; any other is refused.
    """
    return f"{_scratch_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _scratch_folder(spark: SparkSession) -> str:
    return f"{_scratch_root(spark).rstrip('/')}/{FOLDER}-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote; frames that still read it become unreadable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside give up their shuffle files when they end, not when the driver's garbage is collected.

    Only for frames that run once: a second run of the very same frame would have to make them again.
    """
    before = spark.conf.get(_CLEANUP_KEY, "false")
    spark.conf.set(_CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP_KEY, before)


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that :func:`cut_lineage` writes inside are deleted at the end, except those handed to :func:`keep`.

    Whatever is handed out must read kept tables only. A kept table passes to the block around this one, if any.
    """
    outer = getattr(_steps, "kept", None)
    _steps.kept = {}
    try:
        yield
    finally:
        made, _steps.kept = _steps.kept, outer
        for path, kept in made.items():
            if not kept:
                _delete(spark, path)
            elif outer is not None:
                outer[path] = False


def keep(written: DataFrame) -> DataFrame:
    """Let a table of :func:`cut_lineage` outlive the block of :func:`passing_tables` it was written in."""
    if written._written_to in (getattr(_steps, "kept", None) or {}):
        _steps.kept[written._written_to] = True
    return written


def discard(written: DataFrame) -> None:
    """Delete a table of :func:`cut_lineage` that no frame reads any more."""
    _delete(written.sparkSession, written._written_to)
    (getattr(_steps, "kept", None) or {}).pop(written._written_to, None)


def per_key(df: DataFrame) -> DataFrame:
    """A table of one row per key, written before rows with that key join it.

    Read back, it has a true size: Spark broadcasts it when it is small. When it is not, both sides
    of the join start at a shuffle, which is what lets adaptive execution split a key that holds a
    large part of the rows; an aggregate joined back directly would pin that key to one task.
    """
    return cut_lineage(df, "per-key")


def cut_lineage(df: DataFrame, label: str, codec: str | None = None, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Iterative jobs call this once a round: the plan stays short, a lost executor costs a re-read
    rather than a recomputation, and the file sizes give the next join true statistics. The shuffle files of
    the writing job go with it. A ``lasting`` table stays whatever :func:`passing_tables` deletes.
    """
    return cut_slices([df], label, codec, lasting)


def cut_slices(slices: list[DataFrame], label: str, codec: str | None = None, lasting: bool = False) -> DataFrame:
    """One table of several frames of the same columns, each written when the shuffle files of the one before are gone."""
    spark = slices[0].sparkSession
    path = scratch_path(spark, label)
    for part in slices:
        writer = part.write.mode("append")
        with shuffles_freed(spark):
            (writer if codec is None else writer.option("compression", codec)).parquet(path)
    if getattr(_steps, "kept", None) is not None and not lasting:
        _steps.kept[path] = False
    stored = spark.read.schema(slices[0].schema).parquet(path)
    stored._written_to = path
    return stored
