"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items and texts are read as words in lower case without punctuation. Every run of ``N`` words of an item
is looked up in all texts, and every place where a text holds it is a seed, so that any ``N`` words in a row
that a text shares with an item make the two meet, however common the words are in the corpus. Around the seeds'
diagonals a local alignment scores what was edited, and a text is contaminated by an item when the score is
``SCORE`` or more of the item's perfect score. A stretch of a text that holds too few of the item's words to
reach that score, wherever they stand, is not aligned.

Texts are keyed by fingerprint until the end: a passage in equal copies is aligned once. Items with the same
words are one item. A bitmap of fixed size over the runs of all items lets a text task drop nearly all of its
own runs before anything is shuffled; a large benchmark only makes it less sharp, never wrong.

Defined cases: NULL texts and items have no words; items of fewer than ``N`` words have no seeds and match
nothing; repeated rows are each reported;
texts of any length are searched whole and aligned around their seeds; of equal scores the first place counts; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import batches, sieve, sifted, tidy
from gridloom.llm.darts import WordHashes, shingles
from gridloom.session import cut_lineage, per_key

N = 4
SCORE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words that a text may hold more on either side of a seed than the item, as a share of the item's length.
SLACK = 0.5
#: Bits of the bitmap: 4 MB, whatever the size of the benchmark.
BITS = 25
BATCH = 1000

_PARTS = re.compile(r"[^\W_]+")
_words = WordHashes()


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return _PARTS.findall(text.lower()) if text else []


def _hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts one after the other, and the number of words of each."""
    split = [tokens(t) for t in texts]
    lengths = np.array([len(w) for w in split], dtype=np.int64)
    flat = (_words[w.encode("utf-8", "surrogatepass")] for ws in split for w in ws)
    return np.fromiter(flat, dtype=np.uint64, count=int(lengths.sum())), lengths


def _runs(texts: list[str | None], n: int):
    """Hash, text number and first word of every run of ``n`` words; shorter texts have none."""
    hashes, lengths = _hashed(texts)
    runs, owner = shingles(hashes, lengths, n)
    first = np.searchsorted(owner, np.arange(len(lengths)))
    place = np.arange(len(owner)) - first[owner]
    full = lengths[owner] >= n
    return runs[full], owner[full], place[full], lengths


def _item_runs(n: int):
    def run(arrow_batches):
        for batch in arrow_batches:
            runs, owner, place, lengths = _runs(batch.column("words").to_pylist(), n)
            item = batch.column("item").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs.view(np.int64)), pa.array(item[owner]), pa.array(place), pa.array(lengths[owner])],
                ["run", "item", "at", "length"],
            )

    return run


def _item_words(arrow_batches):
    for batch in arrow_batches:
        words = [" ".join(tokens(t)) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(words, pa.string())], ["item_id", "words"])


def _bitmap(spark: SparkSession, runs: DataFrame, bits: int):
    """Which of the 2**bits hash classes hold a run of an item; broadcast, of fixed size."""
    low = F.col("run").bitwiseAND((1 << bits) - 1)
    blocks = runs.select(F.shiftright(low, 5).alias("block"), F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(31).cast("int")).alias("bit"))
    blocks = blocks.groupBy("block").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 5), dtype=np.uint32)
    table[blocks.column("block").to_numpy()] = blocks.column("bits").to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(table)


def _text_hits(n: int, bits: int, shared):
    def run(arrow_batches):
        table = shared.value
        for batch in arrow_batches:
            runs, owner, place, _ = _runs(batch.column("text").to_pylist(), n)
            low = runs & np.uint64((1 << bits) - 1)
            hit = (table[(low >> np.uint64(5)).astype(np.int64)] >> (low & np.uint64(31)).astype(np.uint32)) & np.uint32(1)
            hit = np.flatnonzero(hit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp").take(pa.array(owner[hit])), pa.array(runs[hit].view(np.int64)), pa.array(place[hit])],
                ["fp", "run", "place"],
            )

    return run


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score, and the first and last text word (exclusive) of it.

    Rows run over the item. Gaps in the text direction are closed by a running maximum, so that a row is a
    few vector operations.
    """
    width = len(text)
    ramp = np.arange(1, width + 1) * -GAP
    score = np.zeros(width + 1, dtype=np.int64)
    start = np.arange(width + 1)
    best, best_from, best_to = 0, 0, 0
    for word in item:
        diagonal = score[:-1] + np.where(text == word, MATCH, MISMATCH)
        above = score[1:] + GAP
        cell = np.maximum(np.maximum(diagonal, above), 0)
        origin = np.where(diagonal >= above, start[:-1], start[1:])
        origin = np.where(cell == 0, np.arange(1, width + 1), origin)
        lifted = cell + ramp
        top = np.maximum.accumulate(lifted)
        from_left = np.maximum.accumulate(np.where(lifted == top, np.arange(width), -1))
        new = top - ramp
        moved = new > cell
        origin = np.where(moved, origin[from_left], origin)
        score = np.concatenate([[0], new])
        start = np.concatenate([[0], origin])
        at = int(new.argmax())
        if new[at] > best:
            best, best_from, best_to = int(new[at]), int(origin[at]), at + 1
    return best, best_from, best_to


def windows(diagonals: list[int], length: int, size: int) -> list[tuple[int, int]]:
    """Stretches of a text of ``size`` words to align with an item of ``length`` words, overlaps joined."""
    slack = max(4, int(length * SLACK))
    out: list[list[int]] = []
    for d in sorted(diagonals):
        low, high = max(0, d - slack), min(size, d + length + slack)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out if b > a]


def _aligned(least: float):
    """Best alignment of each text and item; a pair that cannot reach ``least`` may get a lower score than its own."""

    def run(arrow_batches):
        for batch in arrow_batches:
            texts, items = batch.column("text").to_pylist(), batch.column("words").to_pylist()
            diagonals = batch.column("diagonals").to_pylist()
            scores, first, last = [], [], []
            known: tuple[str | None, np.ndarray] = (None, np.zeros(0))
            for text, words, places in zip(texts, items, diagonals):
                item = _hashed([words])[0]
                if known[0] != text:
                    known = (text, _hashed([text])[0])
                found = (0, 0, 0)
                for low, high in windows(places, len(item), len(known[1])):
                    # Each word of the item matches once at most, and only if the stretch holds it.
                    if np.isin(item, known[1][low:high]).sum() < least * len(item):
                        continue
                    score, a, b = align(item, known[1][low:high])
                    if score > found[0]:
                        found = (score, low + a, low + b)
                scores.append(found[0] / (MATCH * max(1, len(item))))
                first.append(found[1])
                last.append(found[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), batch.column("item"), pa.array(scores, pa.float64()),
                 pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                ["fp", "item", "score", "first_word", "last_word"],
            )

    return run


def _matches(texts: DataFrame, items: DataFrame, n: int, least: float) -> DataFrame:
    """``fp, item, score, first_word, last_word`` of every seeded pair of a distinct text and item."""
    spark = texts.sparkSession
    runs = cut_lineage(items.mapInArrow(_item_runs(n), "run long, item string, at long, length long"), "item-runs")
    bitmap = _bitmap(spark, runs, BITS)
    with batches(spark, BATCH):
        near = texts.mapInArrow(_text_hits(n, BITS, bitmap), "fp string, run long, place long")
        distinct_runs = per_key(runs.groupBy("run").agg(F.count("*").alias("_n")))
        hits = cut_lineage(near.join(distinct_runs, "run", "left_semi"), "item-hits")
    met = hits.join(runs, "run").select("fp", "item", (F.col("place") - F.col("at")).alias("diagonal"))
    pairs = met.groupBy("fp", "item").agg(F.array_sort(F.collect_set("diagonal")).alias("diagonals"))
    pairs = cut_lineage(pairs, "seeded-pairs")
    wanted = per_key(pairs.select("fp").distinct())
    likely = sifted(texts, sieve(wanted, "fp"), "fp")
    # Copies of a text shrink to one per task before they meet.
    bodies = cut_lineage(likely.dropDuplicates(["fp"]).join(wanted, "fp"), "seeded-texts")
    full = pairs.join(bodies, "fp").join(per_key(items), "item")
    with batches(spark, 200):
        return cut_lineage(
            full.mapInArrow(
                _aligned(least), "fp string, item string, score double, first_word long, last_word long"
            ), "alignments",
        )


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, n: int = N, least: float = SCORE) -> DataFrame:
    """``doc_id, item_id, score, first_word, last_word`` for every document and item that match.

    Words are counted from 0 in the normalised text; the last word is exclusive.
    """
    texts = tidy(docs).select("doc_id", F.md5("text").alias("fp"), "text").filter("text IS NOT NULL")
    known = tidy(benchmark, ("item_id", "text")).select("item_id", "text")
    kind = dict(known.dtypes)["item_id"]
    named = cut_lineage(
        known.mapInArrow(_item_words, f"item_id {kind}, words string").withColumn("item", F.md5("words")), "item-words"
    )
    items = cut_lineage(named.groupBy("item").agg(F.min("words").alias("words")), "items")
    found = _matches(texts.select("fp", "text"), items, n, least).filter(F.col("score") >= least)
    found = cut_lineage(found, "contaminated")
    of_docs = texts.select("doc_id", "fp").join(found, "fp")
    return of_docs.join(named.select("item_id", "item"), "item").select("doc_id", "item_id", "score", "first_word", "last_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The input rows without the texts that match an item."""
    rows = tidy(docs, taken=("_fp",))
    texts = rows.select(F.md5("text").alias("fp"), "text").filter("text IS NOT NULL")
    known = tidy(benchmark, ("item_id", "text")).select("item_id", "text")
    kind = dict(known.dtypes)["item_id"]
    items = known.mapInArrow(_item_words, f"item_id {kind}, words string").select(F.md5("words").alias("item"), "words")
    items = cut_lineage(items.groupBy("item").agg(F.min("words").alias("words")), "items")
    least = options.get("least", SCORE)
    found = _matches(texts, items, options.get("n", N), least)
    bad = per_key(found.filter(F.col("score") >= least).select(F.col("fp").alias("_fp")).distinct())
    return rows.withColumn("_fp", F.md5("text")).join(bad, "_fp", "left_anti").select(*rows.columns)
