"""Key registry behind the driver contract."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gridloom.session import cut_lineage, passing_tables
from gridloom.tables import table

_shared: dict[tuple, DataFrame] = {}


def forget_shared() -> None:
    """Build derived tables anew, so that a timing holds all the work of its key."""
    _shared.clear()


def _versions(spark: SparkSession, root: str) -> frozenset:
    """Name, size and time of every input file; changed input never meets an older derived table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = set()
    while found.hasNext():
        file = found.next()
        out.add((file.getPath().toString(), file.getLen(), file.getModificationTime()))
    return frozenset(out)


class Loader:
    """Gives input tables by name, and tables derived from them that several queries share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.root, name)

    def shared(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Write a derived table once per application and state of the input files; what led to it is deleted."""
        key = (self.spark.sparkContext.applicationId, _versions(self.spark, self.root), label)
        if key not in _shared:
            with passing_tables(self.spark):
                _shared[key] = cut_lineage(build(), label, codec="zstd", lasting=True)
        return _shared[key]



@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Loader], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, root: str) -> DataFrame:
        # Dates in the inputs carry no zone; UTC keeps casts to instants repeatable.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return self.build(Loader(spark, root))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(load)`` under ``name``; ``load(table_name)`` gives an input table."""

    def register(build: Callable[[Loader], DataFrame]) -> Callable[[Loader], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, build, sql)
        return build

    return register
