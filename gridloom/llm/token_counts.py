"""Exact token length histogram and what it answers for every context limit.

Documents are encoded whole by a public byte-level tokenizer and only their lengths are counted, so that
one row per distinct length leaves each task. Suffix sums over the lengths then give, for a context limit
equal to that length, the documents cut, the tokens kept and lost, and the quantile reached.

Defined cases: NULL and empty texts have length 0; repeated rows count each time; special tokens' strings
in a text are ordinary text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batches
from gridloom.operators.ordered import running_sum
from gridloom.session import cut_lineage

#: Texts that a task holds at once.
BATCH = 500
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splitting rule that belongs to the vocabulary file (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encoders: dict[int, object] = {}


def _encoder(ranks: bytes):
    """The tokenizer, built once in each Python worker."""
    key = hash(ranks)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[key] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``n_tokens, n_docs`` counted inside each batch; the same length may come from several batches."""
    spark = docs.sparkSession
    with open(vocabulary, "rb") as file:
        # The vocabulary file, about 1 MB whatever the input.
        shared = spark.sparkContext.broadcast(file.read())

    def encode(batches):
        encoder = _encoder(shared.value)
        for batch in batches:
            lengths = [len(encoder.encode_ordinary(t)) if t else 0 for t in batch.column(0).to_pylist()]
            values, counts = np.unique(np.array(lengths, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["n_tokens", "n_docs"])

    return docs.select("text").mapInArrow(encode, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per distinct length ``n_tokens``, read as context limit.

    ``n_docs`` of that length, ``docs_longer`` cut by the limit, ``docs_upto`` not longer, ``quantile`` =
    share of documents not longer, ``tokens_total`` of all documents, ``tokens_kept`` after truncation to
    the limit, ``tokens_lost``. A limit between two lengths keeps what the length below keeps, plus one
    token per longer document and unit.
    """
    counts = token_lengths(docs, vocabulary).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    counts = counts.withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    with batches(docs.sparkSession, BATCH):
        counts = cut_lineage(counts, "token-lengths")
    total = counts.agg(F.sum("n_docs").alias("d"), F.sum("_tokens").alias("t")).first()
    # Longest first, so that a running sum is the suffix sum.
    longest = [-F.col("n_tokens")]
    sums = running_sum(counts, [], longest, F.col("n_docs"), "_docs_from")
    sums = running_sum(sums, [], longest, F.col("_tokens"), "_tokens_from")
    longer = F.col("_docs_from") - F.col("n_docs")
    kept = F.lit(total["t"]) - (F.col("_tokens_from") - F.col("_tokens")) + longer * F.col("n_tokens")
    return sums.select(
        "n_tokens", "n_docs", longer.alias("docs_longer"), (F.lit(total["d"]) - longer).alias("docs_upto"),
        ((F.lit(total["d"]) - longer) / F.lit(total["d"])).alias("quantile"),
        F.lit(total["t"]).cast("long").alias("tokens_total"), kept.alias("tokens_kept"),
        (F.lit(total["t"]) - kept).alias("tokens_lost"),
    )


def answer_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Truncated totals for any context limits, from the histogram alone."""
    cut = [
        F.sum(F.least(F.col("n_tokens"), F.lit(limit)) * F.col("n_docs")).alias(f"kept_{limit}") for limit in limits
    ]
    return histogram.agg(F.sum(F.col("n_tokens") * F.col("n_docs")).alias("total"), *cut)
