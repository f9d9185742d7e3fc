"""Phrase collocation mining: frequent phrases by Misra-Gries summaries, then exact counts and scores.

Words are counted exactly first. Then, for phrases of two words and after that of three, a first pass keeps a
Misra-Gries summary per hash partition: every task hands each partition the 32-bit fingerprints of its phrases
with counts, and the partition merges them into at most ``mass / threshold + 1`` counters, which guarantees that
every phrase that often survives. Only phrases all of whose shorter phrases may be frequent enter, told by a
bitmap of fixed size. A second pass over the texts counts the survivors exactly, by their words.

The bitmaps and the fingerprints let a few rare phrases through, never a frequent one out; the exact counts
decide. Word hashes have 64 bits. Counts leave a task once per distinct phrase, so a passage found in a third
of all texts costs one row a task.

Defined cases: NULL and empty texts have no words; a NULL language is ``und``; repeated rows count each time;
ties in the score go to the greater count and then to the phrase in byte order, ties between cuts to the first
one. Texts of any length are read whole, a batch at a time. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches, tidy
from gridloom.session import cut_lineage, per_key

LEAST = 10
INSIDE = 50
BEST = 2000
SCALE = 1_000_000
LONGEST = 3
BATCH = 500
#: Characters that are taken apart at once.
PORTION = 1 << 21
#: Distinct phrases that a task holds before it passes their counts on.
HELD = 1 << 20
#: Phrases that one hash partition should see.
MASS = 1 << 23
#: Bits of a bitmap: 8 MB, whatever it is built from.
BITS = 26
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_WORD, _BLANK, _BREAK = 0, 1, 2
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[*b".,;:!?", *range(0x0A, 0x0E)]] = _BREAK
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[np.arange(65, 91)] += 32
_powers = [np.ones(1, dtype=np.uint64)] * 2


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for i, base in enumerate((_BASE, inverse)):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def _portions(batch: pa.RecordBatch):
    """Texts and languages of a batch, not much more than ``PORTION`` characters at a time."""
    texts, languages = (batch.column(c).to_pylist() for c in ("text", "lang"))
    begin = held = 0
    for at, text in enumerate(texts):
        held += len(text or "")
        if held >= PORTION or at == len(texts) - 1:
            yield Words(texts[begin : at + 1], languages[begin : at + 1])
            begin, held = at + 1, 0


class Words:
    """The words of a batch of texts: hash, piece and place of each; A-Z lower-cased."""

    def __init__(self, texts: list[str | None], languages: list[str | None]):
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        # A line feed ends a piece, so that no phrase goes from one text into the next.
        self.data = _FOLD[np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)]
        self.raw = self.data.tobytes()
        kind = _CLASS[self.data]
        inside = np.concatenate([[False], kind == _WORD])
        self.start = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.stop = np.flatnonzero(~inside[1:] & inside[:-1])
        power, inverse = _power(len(self.data))
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(power * (self.data.astype(np.uint64) + np.uint64(1)))])
        poly = (total[self.stop] - total[self.start]) * inverse[self.start]
        edges = np.cumsum([len(r) + 1 for r in raw])
        owner = np.searchsorted(edges, self.start, side="right")
        names = {name: i for i, name in enumerate(dict.fromkeys("und" if x is None else x for x in languages))}
        self.names = list(names)
        language = np.array([names["und" if x is None else x] for x in languages], dtype=np.int64)
        self.language = language[owner] if len(owner) else np.zeros(0, dtype=np.int64)
        seeds = np.array([_text_hash(x) for x in self.names], dtype=np.uint64)
        length = (self.stop - self.start).astype(np.uint64)
        self.hash = _mix(poly + _mix(length)) ^ (seeds[self.language] if len(seeds) else np.uint64(0))
        self.piece = np.cumsum(kind == _BREAK)[self.start]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every run of ``n`` words inside a piece."""
        if len(self.hash) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        count = len(self.hash) - n + 1
        first = np.flatnonzero(self.piece[:count] == self.piece[n - 1 :])
        hashes = self.hash[first]
        for i in range(1, n):
            hashes = _mix(hashes * np.uint64(3) + self.hash[first + i])
        return first, hashes

    def phrase(self, first: int, n: int) -> str:
        # Inside a piece only blanks lie between words.
        raw = self.raw[self.start[first] : self.stop[first + n - 1]]
        return (raw if n == 1 else b" ".join(raw.split())).decode("utf-8", "surrogatepass")

    def allowed(self, n: int, sieves: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Runs of ``n`` words whose shorter runs all pass their sieves."""
        first, hashes = self.runs(n)
        keep = np.ones(len(first), dtype=bool)
        for size, bits in enumerate(sieves, 1):
            if size >= n:
                break
            at, short = self.runs(size)
            passing = np.zeros(len(self.hash) + 1, dtype=bool)
            passing[at] = _among(bits, short)
            for i in range(n - size + 1):
                keep &= passing[first + i]
        return first[keep], hashes[keep]


def _text_hash(text: str) -> np.uint64:
    value = np.uint64(len(text))
    with np.errstate(over="ignore"):
        for byte in text.encode("utf-8", "surrogatepass"):
            value = _mix(np.array([value * _BASE + np.uint64(byte + 1)], dtype=np.uint64))[0]
    return value


def _among(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64((1 << BITS) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


_NAMES, _KINDS = ("lang", "phrase", "hash", "size", "n"), (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64())
_COUNTS = "lang string, phrase string, hash long, size int, n long"


def _counted_phrases(sizes: tuple[int, ...], sieves: dict[int, list]):
    """Exact counts of the phrases of ``sizes`` words that pass; a task's own counts are added up before they leave."""

    def run(arrow_batches):
        place: dict[int, int] = {}
        columns: list[list] = [[] for _ in _NAMES]
        langs, phrases, hashes_, sizes_, counts_ = columns

        def rows():
            batch = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, _KINDS)], _NAMES)
            for c in (place, *columns):
                c.clear()
            return batch

        for words in (w for batch in arrow_batches for w in _portions(batch)):
            for size in sizes:
                own = [b.value for b in sieves[size]]
                first, hashes = words.allowed(size, own[:-1]) if own else words.runs(size)
                if own:
                    passing = _among(own[-1], hashes)
                    first, hashes = first[passing], hashes[passing]
                distinct, at, counts = np.unique(hashes, return_index=True, return_counts=True)
                for h, f, n in zip(distinct.view(np.int64).tolist(), first[at].tolist(), counts.tolist()):
                    known = place.setdefault(h, len(counts_))
                    if known < len(counts_):
                        counts_[known] += n
                    else:
                        # A phrase is spelt out once for all its occurrences in the task.
                        langs.append(words.names[words.language[f]])
                        phrases.append(words.phrase(f, size))
                        hashes_.append(h)
                        sizes_.append(size)
                        counts_.append(n)
            if len(place) > HELD // 2:
                yield rows()
        yield rows()

    return run


def _summaries(size: int, sieves: list, parts: int, least: int):
    """Fingerprints and counts of a task's phrases per hash partition; counts above the threshold add nothing."""

    def run(arrow_batches):
        keys, counts = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)

        def rows():
            part = (keys >> np.uint64(32)) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            out = {"part": [], "prints": [], "counts": []}
            for p in range(parts):
                chosen = order[cuts[p] : cuts[p + 1]]
                if len(chosen):
                    out["part"].append(p)
                    out["prints"].append(_print(keys[chosen]).tobytes())
                    out["counts"].append(np.minimum(counts[chosen], least).astype(np.uint8).tobytes())
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("part", pa.int32()), ("prints", pa.binary()), ("counts", pa.binary())]))

        for words in (w for batch in arrow_batches for w in _portions(batch)):
            fresh = words.allowed(size, [b.value for b in sieves])[1]
            keys, counts = _merged(np.concatenate([keys, fresh]), np.concatenate([counts, np.ones(len(fresh), dtype=np.int64)]))
            if len(keys) > HELD:
                yield rows()
                keys, counts = keys[:0], counts[:0]
        yield rows()

    return run


def _print(hashes: np.ndarray) -> np.ndarray:
    """The lower 32 bits, which also hold the place in a bitmap."""
    return (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


class MisraGries:
    """At most ``capacity`` counters; ``error`` is what any key's count may lack."""

    def __init__(self, capacity: int, kind=np.uint32):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray, error: int = 0) -> None:
        """Add another summary's counters, then take from all what leaves no more than ``capacity``."""
        self.error += error
        self.keys, self.counts = _merged(np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts]))
        if len(self.keys) > self.capacity:
            cut = -np.partition(-self.counts, self.capacity)[self.capacity]
            self.counts = self.counts - cut
            self.error += int(cut)
            kept = self.counts > 0
            self.keys, self.counts = self.keys[kept], self.counts[kept]

    def may_reach(self, least: int) -> np.ndarray:
        return self.keys[self.counts + self.error >= least]


def _survivors(least: int):
    """Bits of the phrases of one hash partition that may be frequent."""

    def run(table: pa.Table) -> pa.Table:
        prints = [np.frombuffer(x, dtype=np.uint32) for x in table.column("prints").to_pylist()]
        counts = [np.frombuffer(x, dtype=np.uint8).astype(np.int64) for x in table.column("counts").to_pylist()]
        # More counters than mass / threshold: less than the threshold is ever taken from a key.
        summary = MisraGries(int(sum(c.sum() for c in counts)) // least + 1)
        for k, c in zip(prints, counts):
            summary.merge(k, c)
        return _bits(summary.may_reach(least).astype(np.uint64))

    return run


def _bits(hashes: np.ndarray) -> pa.Table:
    place = np.unique(hashes & np.uint64((1 << BITS) - 1))
    block = (place >> np.uint64(6)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, dtype=np.int64)
    bits = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first) if len(first) else place
    return pa.table({"block": pa.array(block[first]), "bits": pa.array(bits.view(np.int64))})


def _sieve(blocks: DataFrame):
    """The bitmap on every executor: ``block, bits`` rows, as many as the bitmap has 64-bit words at most."""
    joined = blocks.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    words[joined.column("block").to_numpy()] = joined.column("bits").to_numpy().view(np.uint64)
    return blocks.sparkSession.sparkContext.broadcast(words.astype("<u8").view(np.uint8))


def _word_bits(words: DataFrame):
    place = F.col("hash").bitwiseAND((1 << BITS) - 1)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))
    return words.select(F.shiftright(place, 6).alias("block"), bit.alias("bits"))




def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Exact counts ``lang, phrase, size, f`` of all phrases up to ``longest`` words found ``least`` times or more, and ``lang, n``."""
    spark = docs.sparkSession
    rows = tidy(docs, ("lang", "text")).select("text", F.col("lang").cast("string").alias("lang"))
    with batches(spark, BATCH):
        found = rows.mapInArrow(_counted_phrases((1,), {1: []}), _COUNTS)
        words = cut_lineage(found.groupBy("lang", "phrase").agg(F.first("hash").alias("hash"), F.sum("n").alias("f")), "phrase-words")
        totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
        mass = words.agg(F.sum("f")).first()[0] or 0
        parts = max(1, -(-mass // MASS))
        frequent = words.filter(F.col("f") >= least)
        sieves = [_sieve(_word_bits(frequent))]
        for size in range(2, longest + 1):
            told = rows.mapInArrow(_summaries(size, sieves, parts, least), "part int, prints binary, counts binary")
            bits = told.groupBy("part").applyInArrow(_survivors(least), "block long, bits long")
            sieves = [*sieves, _sieve(cut_lineage(bits, "phrase-bits"))]
        sizes = tuple(range(2, longest + 1))
        found = rows.mapInArrow(_counted_phrases(sizes, {s: sieves[:s] for s in sizes}), _COUNTS)
        phrases = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        both = frequent.select("lang", "phrase", F.lit(1).alias("size"), "f").unionByName(phrases)
        return cut_lineage(both, "phrases"), cut_lineage(totals, "phrase-totals")


def exact_score() -> Column:
    """floor(10**6 a a / (l r)) of counts below 10**16, whose products pass 64 bits; at most 10**6 where a <= l, r."""
    wide = {c: f"cast({c} as decimal(16,0))" for c in "alr"}
    return F.expr(f"cast(({wide['a']} * {wide['a']} * {SCALE}) div ({wide['l']} * {wide['r']}) as long)")


def collocations(
    docs: DataFrame, least: int = LEAST, inside: int = INSIDE, best: int | None = BEST, longest: int = LONGEST
) -> DataFrame:
    """``lang, rank, phrase, size, a, l, r, n, score`` of phrases of two to ``longest`` words, best first.

    A phrase found ``a`` times is cut in two; with ``l`` and ``r`` the counts of the parts the score is
    floor(10**6 a a / (l r)), and the lowest-scoring cut counts. A phrase goes when a longer frequent one that holds
    it has at least ``inside`` percent of its count. ``best`` phrases a language, all if None.
    """
    phrases, totals = frequent_phrases(docs, least, longest)
    parts = F.split("phrase", " ")
    candidates = phrases.filter("size > 1")
    cut = candidates.select("lang", "phrase", "size", F.col("f").alias("a"), parts.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("_k"))
    cut = cut.select(
        "lang", "phrase", "size", "a", "_k",
        F.array_join(F.slice("_w", F.lit(1), F.col("_k")), " ").alias("_left"),
        F.array_join(F.slice("_w", F.col("_k") + 1, F.col("size") - F.col("_k")), " ").alias("_right"),
    )
    for side, name in (("_left", "l"), ("_right", "r")):
        cut = cut.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    scored = cut.withColumn("score", exact_score()).groupBy("lang", "phrase", "size", "a").agg(
        F.min(F.struct("score", "_k", "l", "r")).alias("_cut")
    )
    # The greatest count among the longer frequent phrases around each shorter one.
    shorter = candidates.filter("size > 2").select(
        "lang", "f", parts.alias("_w"), "size", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("_m")
    ).select("lang", "f", "_w", "_m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("_m") + 1)).alias("_i"))
    around = shorter.groupBy("lang", F.array_join(F.slice("_w", F.col("_i"), F.col("_m")), " ").alias("phrase")).agg(F.max("f").alias("_around"))
    kept = scored.join(around, ["lang", "phrase"], "left").filter(
        F.col("_around").isNull() | (F.col("_around") * 100 < F.col("a") * inside)
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("_cut.score"), F.desc("a"), "phrase"))
    # The bare row number lets Spark keep the best of each task before the shuffle.
    ranked = kept.withColumn("rank", rank)
    ranked = ranked if best is None else ranked.filter(F.col("rank") <= best)
    return ranked.join(per_key(totals), "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "size", "a", F.col("_cut.l").alias("l"), F.col("_cut.r").alias("r"), "n", F.col("_cut.score").alias("score")
    )
