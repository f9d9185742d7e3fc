"""Small helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\x0c\r"


def tidy(docs: DataFrame, need: Iterable[str] = ("doc_id", "text"), taken: Iterable[str] = ()) -> DataFrame:
    """The same rows with one column for each name, letter case ignored.

    ``need`` must be there and wins over a namesake in other letter case; an input column named in
    ``taken`` is left out, because the operator returns a column of that name.
    """
    need, low = list(need), {t.lower() for t in taken}
    if missing := [n for n in need if n not in docs.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    place: dict[str, int] = {}
    for i, name in enumerate(docs.columns):
        if name in need or (name.lower() not in low and name.lower() not in place):
            if name in need and name.lower() in place and docs.columns[place[name.lower()]] == name:
                continue
            place[name.lower()] = i
    fresh = docs.toDF(*[f"_{i}" for i in range(len(docs.columns))])
    return fresh.select(*[F.col(f"_{i}").alias(docs.columns[i]) for i in sorted(place.values())])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for NULL."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words as long, 0 for NULL."""
    return F.size(words(text)).cast("long")


def uniform(*parts: Column) -> Column:
    """A number in (0, 1] that depends on the parts alone: 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(1.0)) / F.lit(float(1 << 52))


@contextmanager
def batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows while the block builds and runs its jobs."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: A sieve is a bitmap of 2**24 bits, 2 MB, whatever it is built from.
SIEVE_BITS = 24


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """One row ``bits`` that tells for nearly all other keys that they are not among ``keys``.

    It lets a scan drop rows that would find no partner, before they are shuffled for a join. With very many
    keys it lets more rows pass, and the join still decides.
    """
    blocks = 1 << (SIEVE_BITS - 6)
    place = F.xxhash64(*columns).bitwiseAND((1 << SIEVE_BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    used = keys.select(F.shiftright(place, 6).alias("id"), bit.alias("b")).groupBy("id").agg(F.bit_or("b").alias("b"))
    every = keys.sparkSession.range(blocks).join(used, "id", "left").select("id", F.coalesce("b", F.lit(0)).alias("b"))
    # A fixed number of small rows.
    row = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", "b"))), lambda x: x["b"]).alias("bits"))
    return cut_lineage(row, "sieve")


def sifted(rows: DataFrame, bits: DataFrame, *columns: str, passing: bool = True) -> DataFrame:
    """The rows whose key the sieve lets pass, or the others, which certainly have no partner."""
    place = F.xxhash64(*columns).bitwiseAND((1 << SIEVE_BITS) - 1)
    held = F.get(bits.scalar(), F.shiftright(place, 6).cast("int"))
    bit = F.call_function("shiftright", held, place.bitwiseAND(63).cast("int")).bitwiseAND(1)
    return rows.filter(bit == 1 if passing else bit == 0)


def packed(docs: DataFrame, need: Iterable[str] = ("doc_id", "text")) -> DataFrame:
    """The needed columns, and all others in a struct ``_row``, out of reach of the names an operator uses."""
    names, need = docs.columns, list(need)
    fresh = docs.toDF(*[f"_{i}" for i in range(len(names))])
    places = {n: names.index(n) for n in need}
    others = [i for i in range(len(names)) if i not in places.values()]
    row = [F.struct(*[F.col(f"_{i}").alias(f"c{i}") for i in others]).alias("_row")] if others else []
    return fresh.select(*[F.col(f"_{i}").alias(n) for n, i in places.items()], *row)


def unpacked(rows: DataFrame, names: list[str], need: Iterable[str] = ("doc_id", "text"), more: Iterable[str] = ()) -> DataFrame:
    """Columns as they were before :func:`packed`; an original column that bears a name in ``more`` gives way."""
    need, more = list(need), list(more)
    places = {names.index(n): n for n in need}
    kept = [i for i, n in enumerate(names) if n.lower() not in {m.lower() for m in more}]
    return rows.select(*[(F.col(places[i]) if i in places else F.col(f"_row.c{i}")).alias(names[i]) for i in kept], *more)
