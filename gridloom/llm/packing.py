"""Harmonic packing of token sequences.

Lengths are partitioned into reciprocal-capacity classes: class ``k`` holds the pieces longer than capacity/(k+1)
and not longer than capacity/k, and each of its bins takes exactly ``k`` of them. A piece's bin follows from its
rank in its class alone, so tasks fill bins without talking to one another: each numbers its own pieces, and one
small row per (task, class) says where its numbers begin.

With ``cut``, documents are cut at class boundaries first: whole capacities, then halves, quarters, … as the
binary digits of the rest say, longest first. Every piece then fills its class's share of a bin exactly, and a
full bin has no padding. What is left of the classes, fewer than ``k`` pieces each, is laid end to end from long
to short; it fills bins exactly too, and the last of them splits at powers of two. Without ``cut`` only whole
capacities are cut off, and a document's rest stays in one piece; bins then have the padding of the harmonic rule.

Defined cases: NULL and empty texts are the end token alone; repeated rows, also of one ``doc_id``, are separate
documents; equal lengths are ranked by task and row. A text of any length is encoded whole, in a task that
holds one batch of texts. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches, tidy
from gridloom.llm.token_counts import _encoder
from gridloom.session import cut_lineage, per_key

CAPACITY = 2048
END = 1
BATCH = 256
#: The same public vocabulary in the two forms that the two libraries read.
TOKENIZER, RANKS = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: In these characters the faster library is known to split texts alike (a test goes through all of them).
_PLAIN = re.compile("[\\x00-\\u024f\\u2010-\\u2027\\u2030-\\u205e]*")
_SPECIAL = "<|endoftext|>"

_full: dict[int, object] = {}


class Encoder:
    """Token ids as the ``tokenizers`` library gives them; plain texts go through a faster one."""

    def __init__(self, definition: bytes, ranks: bytes):
        key = hash(definition)
        if key not in _full:
            from tokenizers import Tokenizer

            _full[key] = Tokenizer.from_str(definition.decode())
        self.full, self.fast = _full[key], _encoder(ranks)

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        if _PLAIN.fullmatch(text) and _SPECIAL not in text:
            return self.fast.encode_ordinary(text)
        return self.full.encode(text, add_special_tokens=False).ids


def cuts(length: int, capacity: int, cut: bool) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of a document's pieces, longest first."""
    whole, rest = divmod(length, capacity)
    sizes = [capacity] * whole
    if rest:
        sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1] if cut else [rest]
    sizes = np.array(sizes, dtype=np.int64)
    return np.cumsum(sizes) - sizes, sizes


def _pieces(encoder_parts, capacity: int, cut: bool, end: int, with_ids: bool):
    def run(arrow_batches):
        encoder = Encoder(*(p.value for p in encoder_parts))
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for batch in arrow_batches:
            owner, rows, blobs = [], [], []
            for at, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encoder.ids(text), end], dtype="<u4").tobytes()
                total = len(ids) // 4
                for start, size in zip(*(x.tolist() for x in cuts(total, capacity, cut))):
                    kind = capacity // size
                    rank = seen.get(kind, 0)
                    seen[kind] = rank + 1
                    part = ids[4 * start : 4 * (start + size)]
                    owner.append(at)
                    rows.append((start, size, zlib.crc32(part), total, task, kind, rank))
                    blobs.append(part)
            columns = np.array(rows, dtype=np.int64).reshape(-1, len(_PIECE)).T
            arrays = [batch.column("doc_id").take(pa.array(owner, pa.int64())), *[pa.array(c) for c in columns]]
            names = ["doc_id", *_PIECE]
            if with_ids:
                values = pa.array(np.frombuffer(b"".join(blobs), dtype="<u4").astype(np.int32))
                edges = np.concatenate([[0], np.cumsum(columns[1])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(edges), values))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


_PIECE = ("start", "length", "ids_crc32", "doc_tokens", "_task", "_class", "_rank")


def cut_documents(
    docs: DataFrame, capacity: int = CAPACITY, cut: bool = True, end: int = END, with_ids: bool = False,
    tokenizer: str = TOKENIZER, ranks: str = RANKS,
) -> DataFrame:
    """Encode and cut: one row per piece with its class and its rank among the task's pieces of the class; written."""
    spark = docs.sparkSession
    shared = []
    for path in (tokenizer, ranks):
        with open(path, "rb") as file:
            # Vocabulary files of a few MB, whatever the input.
            shared.append(spark.sparkContext.broadcast(file.read()))
    rows = tidy(docs).select("doc_id", "text")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in _PIECE)
    schema += ", ids array<int>" if with_ids else ""
    with batches(spark, BATCH):
        return cut_lineage(rows.mapInArrow(_pieces(shared, capacity, cut, end, with_ids), schema), "packing-pieces")


def _ranked(pieces: DataFrame) -> tuple[DataFrame, list]:
    """``_rank`` counted through all tasks, and the number of pieces of each class (at most ``capacity`` rows)."""
    counts = cut_lineage(pieces.groupBy("_task", "_class").agg(F.count("*").alias("_n")), "packing-counts")
    before = F.sum("_n").over(Window.partitionBy("_class").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = per_key(counts.select("_task", "_class", F.coalesce(before, F.lit(0)).alias("_before")))
    totals = counts.groupBy("_class").agg(F.sum("_n").alias("n")).orderBy("_class").collect()
    ranked = pieces.join(offsets, ["_task", "_class"]).withColumn("_rank", F.col("_before") + F.col("_rank"))
    return ranked.drop("_before", "_task"), totals


def _span(place: Column, start: int, size: int, sequence: int) -> Column:
    inside = (place >= start) & (place < start + size)
    return F.when(inside, F.struct(F.lit(sequence).cast("long").alias("sequence_id"), (place - start).alias("offset")))


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cut: bool = True, **options) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; see :func:`cut_documents` for ``options``.

    ``cut`` needs a capacity that is a power of two. Sequences are numbered without gaps from 0, and so are the
    places inside each.
    """
    if cut and capacity & (capacity - 1):
        raise ValueError("cutting at class boundaries needs a capacity that is a power of two")
    spark = docs.sparkSession
    pieces, totals = _ranked(cut_documents(docs, capacity, cut, **options))
    # Per class: the first sequence of its full bins, and where its left-over pieces begin on their common line.
    first, line, plan = 0, 0, []
    for kind, n in totals:
        bins = n // kind if cut else -(-n // kind)
        plan.append((kind, n // kind * kind, first, line))
        first += bins
        line += n % kind * (capacity // kind) if cut else 0
    # At most one row per class, so at most ``capacity`` rows.
    known = F.broadcast(spark.createDataFrame(plan or [(1, 0, 0, 0)], "_class long, _full long, _first long, _line long"))
    rows = pieces.join(known, "_class")
    if not cut:
        rows = rows.withColumn("sequence_id", F.col("_first") + F.floor(F.col("_rank") / F.col("_class")))
        # A bin holds at most ``capacity`` pieces.
        ahead = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))
        return rows.drop("_class", "_rank", "_full", "_first", "_line")
    place = F.col("_line") + (F.col("_rank") - F.col("_full")) * F.col("length")
    ends = line // capacity * capacity
    begin = F.floor(place / capacity)
    left = F.struct((F.lit(first) + begin).cast("long").alias("sequence_id"), (place - begin * capacity).alias("offset"))
    # The last, partly filled bin splits at the binary digits of its filling.
    at, tail, sequence = ends, [], first + line // capacity
    for bit in reversed(range((line - ends).bit_length())):
        if (line - ends) >> bit & 1:
            tail.append(_span(place, at, 1 << bit, sequence))
            at, sequence = at + (1 << bit), sequence + 1
    left = F.when(place < ends, left).otherwise(F.coalesce(*tail)) if tail else left
    filled = F.floor(F.col("_rank") / F.col("_class"))
    whole = F.struct((F.col("_first") + filled).alias("sequence_id"), ((F.col("_rank") - filled * F.col("_class")) * F.col("length")).alias("offset"))
    spot = F.when(F.col("_rank") < F.col("_full"), whole).otherwise(left)
    rows = rows.withColumn("_spot", spot).withColumns({c: F.col(f"_spot.{c}").cast("long") for c in ("sequence_id", "offset")})
    return rows.drop("_spot", "_class", "_rank", "_full", "_first", "_line")


def padded_sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """The sequences themselves, from pieces with ``ids``: ``sequence_id, ids, n_tokens, padding, documents``.

    Filled up to ``capacity`` unless the length is a power of two; ``documents`` gives the piece at each offset.
    """
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    rows = pieces.groupBy("sequence_id").agg(parts.alias("_p"), F.sum("length").alias("n_tokens"))
    n = F.col("n_tokens").cast("int")
    padding = F.when(n.bitwiseAND(n - 1) == 0, 0).otherwise(F.lit(capacity) - n)
    ids = F.concat(F.flatten(F.transform("_p", lambda p: p["ids"])), F.array_repeat(F.lit(pad), padding))
    return rows.select(
        "sequence_id", ids.alias("ids"), "n_tokens", padding.alias("padding"),
        F.transform("_p", lambda p: F.struct(p["offset"], p["doc_id"], p["start"], p["length"])).alias("documents"),
    )
