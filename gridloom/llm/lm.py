"""Language model scoring with a hierarchical Pitman-Yor model.

The words are those of a lexicon, the most frequent training words (at most ``LEXICON`` of those seen twice or
more), plus one sign for all others. A context is the word before; every context is a restaurant and all of them
share one parent. Seatings are sampled by Gibbs sweeps over all restaurants (see ``pitman_yor``), the parent
being brought up to date between rounds, and the predictive probabilities of the last ``SAMPLES`` rounds are
averaged. Words behind the sign follow a Pitman-Yor restaurant of their own: a word seen c times there has the
share (c - d) / (theta + C), and what is left is the probability of a word never seen, which is one event, as
in the base score. The probabilities of all known words and of that event sum to one.

All training documents are counted. Word counts, pair counts and seatings stay distributed; what is broadcast has
a fixed bound: the lexicon, and one number per context and word of it and sample. For scoring, each batch of
documents sends its words and word pairs, packed by share of the model, to the task that holds that share, and
gets back one sum per document.

Defined cases: NULL and empty texts are the end sign alone; a NULL doc_id has the remainder of an empty text;
repeated rows are scored alike; with no training documents every distribution is uniform; an empty table gives no
rows; an input column named like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import batches, tidy
from gridloom.llm.darts import WordHashes, mix
from gridloom.llm.pitman_yor import THETA, Root, discount_of, rest_part, seen_part, sweep
from gridloom.session import cut_lineage

LEXICON = 65_534
MIN_COUNT = 2
END, OTHER, FIRST = 0, 1, 2
ROUNDS, SAMPLES = 5, 3
SEED = 97
#: The model is dealt out in shares of about this many entries, and at least this many shares.
SHARE_ENTRIES, LEAST_SHARES = 600_000, 16
#: Pieces of a share of the pairs; a task of the sampler holds one piece at a time.
PIECES = 8
#: Documents in a batch; their numbers in it take one byte.
BATCH = 256
#: Documents whose requests to one share may meet in a task at once.
TOGETHER = 300_000
#: Distinct keys that a counting task holds before it passes them on.
HELD = 400_000

#: Hash of a single word; whole batches are hashed by :func:`_hashes`.
_words = WordHashes()


def is_held_out(doc_id: Column, modulus: int = 7, remainder: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves ``remainder``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def _split(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts, A-Z lower-cased, and the number of each text."""
    # bytes.lower() and bytes.split() know ASCII letters and the six ASCII blanks only.
    split = [t.lower().split() if t else [] for t in texts.cast(pa.binary()).to_pylist()]
    return [w for ws in split for w in ws], np.array([len(ws) for ws in split], dtype=np.int64)


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


class Tally:
    """Counts of integer keys as sorted arrays; what comes in waits until merging it is worth the while."""

    def __init__(self, kind):
        self.keys, self.counts = np.zeros(0, dtype=kind), np.zeros(0, dtype=np.int64)
        self.waiting, self.size = [], 0

    def add(self, keys: np.ndarray) -> None:
        fresh, counts = np.unique(keys, return_counts=True)
        self.waiting.append((fresh, counts))
        self.size += len(fresh)

    def full(self) -> bool:
        """Whether the tally, merged by now, holds more than it should."""
        if self.size > HELD // 4:
            self.merge()
        return len(self.keys) > HELD

    def merge(self) -> None:
        both = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
        counts = np.concatenate([self.counts, *(n for _, n in self.waiting)])
        order = np.argsort(both, kind="stable")
        both, counts = both[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, dtype=int)
        self.keys, self.counts = both[first], np.add.reduceat(counts, first) if len(first) else counts
        self.waiting, self.size = [], 0

    def rows(self) -> pa.RecordBatch:
        self.merge()
        keys = self.keys.view(np.int64) if self.keys.dtype == np.uint64 else self.keys.astype(np.int64)
        batch = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(self.counts)], ["key", "n"])
        self.__init__(self.keys.dtype)
        return batch


def _tallied(keys_of, kind):
    """Count ``keys_of(texts)`` over the batches of a task, passing on what is counted when it gets large."""

    def run(arrow_batches):
        tally = Tally(kind)
        for batch in arrow_batches:
            tally.add(keys_of(batch.column(0)))
            if tally.full():
                yield tally.rows()
        yield tally.rows()

    return run


def _fill_words(texts) -> np.ndarray:
    return _hashes(_split(texts)[0])


class WordIds:
    """Lexicon numbers of words (bytes), ``OTHER`` for the rest.

    Only words of the lexicon are remembered, at most as many as it has; the others are hashed whenever they come,
    a batch at a time, so that a stream of rare words neither fills the memory nor drives the frequent ones out.
    """

    def __init__(self, lexicon: tuple[np.ndarray, np.ndarray]):
        self.hashes, self.ids = lexicon
        self.seen: dict[bytes, int] = {}

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The numbers, the places of the words outside the lexicon, and their hashes."""
        numbers = np.fromiter(map(self.seen.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        places = np.flatnonzero(numbers < 0)
        fresh = [words[i] for i in places.tolist()]
        hashed = _hashes(fresh)
        at = np.searchsorted(self.hashes, hashed)
        listed = np.zeros(len(fresh), dtype=bool)
        inside = np.flatnonzero(at < len(self.hashes))
        listed[inside] = self.hashes[at[inside]] == hashed[inside]
        numbers[places] = OTHER
        found = self.ids[at[listed]]
        numbers[places[listed]] = found
        self.seen.update(zip((fresh[i] for i in np.flatnonzero(listed).tolist()), found.tolist()))
        return numbers, places[~listed], hashed[~listed]


def _pairs(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``context << 16 | word`` of every token, the end included, and the document of each."""
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    tokens = np.full(len(owner), END, dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    inner = np.ones(len(owner), dtype=bool)
    inner[ends] = False
    tokens[inner] = ids
    before = np.concatenate([[END], tokens[:-1]])
    return before << 16 | tokens, owner


def _fill_pairs(lexicon):
    known = None

    def fill(texts) -> np.ndarray:
        nonlocal known
        if known is None:
            known = WordIds(lexicon.value)
        words, lengths = _split(texts)
        return _pairs(known.of(words)[0], lengths)[0].astype(np.uint32)

    return fill


@dataclass
class WordModel:
    """Everything of the word model that has one number per lexicon entry, for each kept sample."""

    rest: np.ndarray  # samples x contexts
    parent: np.ndarray  # samples x words


@dataclass
class Rare:
    """The restaurant of the words outside the lexicon: its discount, customers and distinct words."""

    discount: float
    customers: float
    distinct: float

    def log10(self, counts: np.ndarray) -> np.ndarray:
        """Share of words by their training count; 0 stands for a word never seen."""
        new = THETA + self.discount * self.distinct
        return np.log10(np.where(counts > 0, counts - self.discount, new) / (THETA + self.customers))


@dataclass
class Fitted:
    counts: DataFrame  # hash, n of every training word
    model: DataFrame  # share, key, value: packed seen parts of the pairs, then packed counts of the words
    pair_shares: int
    word_shares: int
    lexicon: tuple[np.ndarray, np.ndarray]
    lexicon_counts: np.ndarray  # by lexicon number
    words: WordModel
    rare: Rare
    tokens: int
    distinct: int


def _shares(entries: int) -> int:
    """Number of shares; a context never leaves its share, so there are no more shares than contexts."""
    return int(min(max(-(-entries // SHARE_ENTRIES), LEAST_SHARES), 1 << 16))


def _context_shares(shares: int) -> np.ndarray:
    """Share of every context."""
    return (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(shares)).astype(np.int64)


def _word_share(hashes: np.ndarray, shares: int) -> np.ndarray:
    """Share of a word hash; it grows with the hash, so sorted hashes are sorted by share."""
    return ((hashes >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers byte by byte: the high bytes, nearly all equal, then compress well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _packed(share_rows: pa.Table) -> pa.Table:
    """One row for a share of the pairs: contexts stay together."""
    order = np.argsort(share_rows.column("key").to_numpy(), kind="stable")
    key, n = (share_rows.column(c).to_numpy()[order] for c in ("key", "n"))
    return pa.table({
        "share": pa.array([share_rows.column("share")[0].as_py()], pa.int32()),
        "key": pa.array([key.astype(np.uint32).tobytes()], pa.binary()),
        "n": pa.array([n.astype(np.int64).tobytes()], pa.binary()),
    })


def _with_shares(shares: int):
    """Add the piece of its context to every pair count; piece ``p`` belongs to share ``p % shares``."""
    piece = (mix(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 20)) % np.uint64(PIECES)).astype(np.int64)
    share_of = (piece * shares + _context_shares(shares)).astype(np.int32)

    def run(arrow_batches):
        for batch in arrow_batches:
            key = batch.column("key")
            yield pa.RecordBatch.from_arrays([pa.array(share_of[key.to_numpy() >> 16]), key, batch.column("n")], ["share", "key", "n"])

    return run


def _packed_words(rows: pa.Table) -> pa.Table:
    """One row for a share of the word counts, sorted by hash."""
    key = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return pa.table({
        "share": pa.array([rows.column("share")[0].as_py()], pa.int32()),
        "key": pa.array([key[order].tobytes()], pa.binary()),
        "value": pa.array([rows.column("n").to_numpy()[order].astype(np.float64).tobytes()], pa.binary()),
    })


def _word_rows(first: int, shares: int):
    def run(arrow_batches):
        for batch in arrow_batches:
            key = batch.column("key")
            share = (first + _word_share(key.to_numpy().view(np.uint64), shares)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(share), key, batch.column("n")], ["share", "key", "n"])

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["key"], dtype=np.uint32).astype(np.int64), np.frombuffer(row["n"], dtype=np.int64)


def _seat(round_number: int, log_parent, discount: float):
    """One sweep over every share; sends the state on, and the tables per word and per context."""

    def run(arrow_batches):
        for batch in arrow_batches:
            for row in batch.to_pylist():
                key, n = _unpack(row)
                # Keys are sorted, so a context's pairs lie together.
                word, first = key & 0xFFFF, _runs(key >> 16)[0]
                room = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(key))))
                t = np.ones(len(key), dtype=np.int64) if row["t"] is None else np.frombuffer(row["t"], dtype=np.int64)
                rng = np.random.default_rng([SEED, round_number, row["share"]])
                t = sweep(room, n, t, log_parent.value[word], len(first), discount, rng)
                yield pa.RecordBatch.from_pylist(
                    [{"share": row["share"], "key": row["key"], "n": row["n"], "t": t.tobytes()}], schema=batch.schema
                )

    return run


def _sums(contexts: bool):
    """Tables and customers of each share per word, and per context above 65,535."""

    def run(arrow_batches):
        for batch in arrow_batches:
            for row in batch.to_pylist():
                key, n = _unpack(row)
                t = np.frombuffer(row["t"], dtype=np.int64)
                for base, at in ((0, key & 0xFFFF), (1 << 16, key >> 16))[: 1 + contexts]:
                    total_t = np.bincount(at, weights=t, minlength=1 << 16)
                    total_n = np.bincount(at, weights=n, minlength=1 << 16)
                    used = np.flatnonzero(total_n)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((base + used).astype(np.int32)), pa.array(total_t[used].astype(np.int64)), pa.array(total_n[used].astype(np.int64))],
                        ["at", "t", "n"],
                    )

    return run


def _gathered(state: DataFrame, contexts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tables per word, tables per context and customers per context: at most 131,072 sums in one pass."""
    found = state.mapInArrow(_sums(contexts), "at int, t long, n long").groupBy("at").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    found = cut_lineage(found, "sums")
    # The shares travel one by one; the sums would be as many batches as rows if they did too.
    with batches(state.sparkSession, 1 << 17):
        table = found.toArrow()
    tables, customers = np.zeros(1 << 17), np.zeros(1 << 17)
    tables[table.column("at").to_numpy()] = table.column("t").to_numpy()
    customers[table.column("at").to_numpy()] = table.column("n").to_numpy()
    return tables[: 1 << 16], tables[1 << 16 :], customers[1 << 16 :]


def _averaged(customers, discount: float, names: list[str]):
    """Seen parts of all pairs, averaged over the samples ``names``; one row for each share."""

    def run(arrow_batches):
        for batch in arrow_batches:
            for row in batch.to_pylist():
                key, n = _unpack(row)
                t = sum(np.frombuffer(row[c], dtype=np.int64) for c in names) / len(names)
                value = seen_part(n, t, customers.value[key >> 16], discount)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["share"]], pa.int32()), pa.array([row["key"]], pa.binary()), pa.array([value.tobytes()], pa.binary())],
                    ["share", "key", "value"],
                )

    return run


_STATE = "share int, key binary, n binary, t binary"


def _discount(counts: DataFrame) -> float:
    few = {r["n"]: r["keys"] for r in counts.filter("n <= 2").groupBy("n").agg(F.count("*").alias("keys")).collect()}
    return discount_of(few.get(1, 0), few.get(2, 0))


def _fit_pairs(counts: DataFrame, words: int, shares: int) -> tuple[DataFrame, WordModel]:
    """Gibbs rounds over the packed pair counts (``key, n``)."""
    spark = counts.sparkSession
    shared = counts.select("key", "n").mapInArrow(_with_shares(shares), "share int, key long, n long")
    packed = shared.groupBy("share").applyInArrow(_packed, "share int, key binary, n binary")
    state = cut_lineage(packed.withColumn("t", F.lit(None).cast("binary")), "pair-state")
    discount = _discount(counts)
    root, rng = Root(words), np.random.default_rng(SEED)
    parent = np.full(1 << 16, 1.0 / words)
    rests, parents, kept = [], [], []
    customers = np.zeros(1 << 16)
    with batches(spark, 1):
        for number in range(ROUNDS):
            log_parent = spark.sparkContext.broadcast(np.log(parent))
            state = cut_lineage(state.mapInArrow(_seat(number, log_parent, discount), _STATE), "pair-state")
            kept_round = number >= ROUNDS - SAMPLES
            of_word, of_context, customers = _gathered(state, contexts=kept_round)
            parent = np.full(1 << 16, 1.0 / words)
            parent[:words] = root.reseat(of_word[:words], rng)
            if kept_round:
                rests.append(rest_part(customers, of_context, discount))
                parents.append(parent[:words])
                kept.append(state.select("share", F.col("t").alias(f"t{len(kept)}"), *(["key", "n"] if not kept else [])))
        together = kept[0]
        for more in kept[1:]:
            together = together.join(more, "share")
        names = [f"t{i}" for i in range(len(kept))]
        shared_customers = spark.sparkContext.broadcast(customers)
        averaged = together.mapInArrow(_averaged(shared_customers, discount, names), "share int, key binary, value binary")
        pairs = cut_lineage(averaged.withColumn("share", F.col("share") % shares), "pair-model")
    return pairs, WordModel(np.array(rests), np.array(parents))


def fit(docs: DataFrame) -> Fitted:
    """Learn from every row of ``docs``."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = docs.select("text")
    rows = "key long, n long"
    with batches(spark, BATCH):
        counted = texts.mapInArrow(_tallied(_fill_words, np.uint64), rows)
        counts = cut_lineage(counted.groupBy("key").agg(F.sum("n").alias("n")), "word-counts")
        known = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count("*").alias("distinct")).first()
        documents = texts.count()
        # At most LEXICON rows.
        frequent = counts.filter(F.col("n") >= MIN_COUNT).orderBy(F.desc("n"), "key").limit(LEXICON).toArrow()
        hashes, n = frequent.column("key").to_numpy().view(np.uint64), frequent.column("n").to_numpy()
        order = np.argsort(hashes)
        lexicon = (hashes[order], np.arange(FIRST, FIRST + len(hashes))[order])
        by_id = np.concatenate([[documents, 0], n])
        fill = _fill_pairs(sc.broadcast(lexicon))
        tallied = texts.mapInArrow(_tallied(fill, np.uint32), rows)
        pair_counts = cut_lineage(tallied.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
    pair_shares, word_shares = _shares(pair_counts.count()), _shares(known["distinct"])
    pairs, word_model = _fit_pairs(pair_counts, FIRST + len(hashes), pair_shares)
    sorted_counts = counts.mapInArrow(_word_rows(pair_shares, word_shares), "share int, key long, n long")
    packed_counts = sorted_counts.groupBy("share").applyInArrow(_packed_words, "share int, key binary, value binary")
    model = pairs.unionByName(cut_lineage(packed_counts, "word-model"))
    rare = Rare(_discount(counts), float(known["tokens"] - n.sum()), float(known["distinct"] - len(n)))
    return Fitted(counts, model, pair_shares, word_shares, lexicon, by_id, word_model, rare, known["tokens"] + documents,
                  known["distinct"] + (documents > 0))


_REQUEST = T.StructType([
    T.StructField("share", T.IntegerType()), T.StructField("group", T.LongType()), T.StructField("batch", T.LongType()),
    T.StructField("docs", T.IntegerType()), T.StructField("keys", T.BinaryType()), T.StructField("times", T.BinaryType()),
    T.StructField("owners", T.BinaryType()), T.StructField("known", T.BinaryType()),
    T.StructField("doc_id", T.ArrayType(T.LongType())), T.StructField("held_out", T.ArrayType(T.BooleanType())),
])
_REQUEST_ARROW = pa.schema([
    ("share", pa.int32()), ("group", pa.int64()), ("batch", pa.int64()), ("docs", pa.int32()), ("keys", pa.binary()),
    ("times", pa.binary()), ("owners", pa.binary()), ("known", pa.binary()), ("doc_id", pa.list_(pa.int64())),
    ("held_out", pa.list_(pa.bool_())),
])
_ANSWER = "batch long, sums binary, doc_id array<bigint>, held_out array<boolean>"
_ANSWER_ARROW = pa.schema([
    ("batch", pa.int64()), ("sums", pa.binary()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())),
])
#: Columns of a sum: tokens, known tokens, base score, score.
_SUMS = 4


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal keys start, and how long they are."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(key)))


def _cut(share: np.ndarray):
    """Slices of equal share."""
    first, length = _runs(share)
    for a, n in zip(first.tolist(), length.tolist()):
        yield int(share[a]), slice(a, a + n)


def _pair_requests(pairs: np.ndarray, owner: np.ndarray, share_of: np.ndarray):
    """For each share its distinct pairs, how often each occurs, and the document of each occurrence."""
    line = np.sort(share_of[pairs >> 16].astype(np.uint64) << np.uint64(40) | pairs.astype(np.uint64) << np.uint64(8) | owner.astype(np.uint64))
    for share, part in _cut((line >> np.uint64(40)).astype(np.int64)):
        key = (line[part] >> np.uint64(8)).astype(np.uint32)
        first, times = _runs(key)
        # Sorted keys as steps, which are small.
        yield share, _planes(np.diff(key[first], prepend=np.uint32(0))), _planes(times), (line[part] & np.uint64(255)).astype(np.uint8).tobytes()


def _word_requests(hashes: np.ndarray, owner: np.ndarray, shares: int):
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    for share, part in _cut(_word_share(hashes, shares)):
        first, times = _runs(hashes[part])
        yield share, hashes[part][first].tobytes(), _planes(times), owner[part].astype(np.uint8).tobytes()


def _requests(lexicon, by_id, total: int, distinct: int, pair_shares: int, word_shares: int):
    """Per batch: what the batch can sum alone, and its pairs and unlisted words for the shares of the model."""

    share_of = _context_shares(pair_shares)

    def run(arrow_batches):
        floor = np.log10(float(total) + distinct + 1)
        base_of = np.log10(by_id.value + 1.0) - floor
        known = WordIds(lexicon.value)
        for batch in arrow_batches:
            words, lengths = _split(batch.column("text"))
            ids, other, unlisted = known.of(words)
            pairs, owner = _pairs(ids, lengths)
            docs = len(lengths)
            token = pairs & 0xFFFF
            listed = token != OTHER
            sums = np.zeros((docs, _SUMS))
            sums[:, 0] = lengths + 1
            sums[:, 1] = np.bincount(owner, weights=listed & (by_id.value[token] > 0), minlength=docs)
            sums[:, 2] = np.bincount(owner, weights=np.where(listed, base_of[token], 0.0), minlength=docs)
            of_word = np.repeat(np.arange(docs), lengths)
            number = batch.column("batch")[0].as_py()
            head = {"group": int(mix(np.array([number], dtype=np.uint64))[0] >> np.uint64(1)), "batch": number, "docs": docs}
            out = [head | {
                "share": -1, "known": sums.tobytes(),
                "doc_id": batch.column("doc_id").to_pylist(), "held_out": batch.column("held_out").to_pylist(),
            }]
            for share, k, t, o in _pair_requests(pairs, owner, share_of):
                out.append(head | {"share": share, "keys": k, "times": t, "owners": o})
            # Only words outside the lexicon go by their hash.
            for share, k, t, o in _word_requests(unlisted, of_word[other], word_shares):
                out.append(head | {"share": pair_shares + share, "keys": k, "times": t, "owners": o})
            yield pa.RecordBatch.from_pylist(out, schema=_REQUEST_ARROW)

    return run


def _answers(word_model, rare: Rare, total: int, distinct: int, pair_shares: int):
    def run(requests: pa.Table, model: pa.Table) -> pa.Table:
        out, key, value = [], np.zeros(0, dtype=np.uint64), np.zeros(0)
        if len(model):
            pair = model.column("share")[0].as_py() < pair_shares
            kind = np.uint32 if pair else np.uint64
            key = np.concatenate([np.frombuffer(k.as_py(), dtype=kind) for k in model.column("key")])
            value = np.concatenate([np.frombuffer(v.as_py(), dtype=np.float64) for v in model.column("value")])
            order = np.argsort(key)
            key, value = key[order], value[order]
        for at in range(len(requests)):
            row = requests.slice(at, 1).to_pylist()[0]
            if row["share"] < 0:
                out.append({"batch": row["batch"], "sums": row["known"], "doc_id": row["doc_id"], "held_out": row["held_out"]})
                continue
            pair = row["share"] < pair_shares
            wanted = np.cumsum(_from_planes(row["keys"]), dtype=np.uint32) if pair else np.frombuffer(row["keys"], dtype=np.uint64)
            place = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
            found = np.where(key[place] == wanted, value[place], 0.0) if len(key) else np.zeros(len(wanted))
            owner, times = np.frombuffer(row["owners"], dtype=np.uint8), _from_planes(row["times"])
            sums = np.zeros((row["docs"], _SUMS))
            if pair:
                m = word_model.value
                inherited = (m.rest[:, wanted >> 16] * m.parent[:, wanted & 0xFFFF]).mean(axis=0)
                sums[:, 3] = np.bincount(owner, weights=np.repeat(np.log10(found + inherited), times), minlength=row["docs"])
            else:
                base = np.log10(found + 1.0) - np.log10(float(total) + distinct + 1)
                for column, value_of in ((1, found > 0), (2, base), (3, rare.log10(found))):
                    sums[:, column] = np.bincount(owner, weights=np.repeat(value_of, times), minlength=row["docs"])
            kept = sums[:, 3:] if pair else sums[:, 1:]
            out.append({"batch": row["batch"], "sums": kept.tobytes(), "doc_id": None, "held_out": None})
        return pa.Table.from_pylist(out, schema=_ANSWER_ARROW)

    return run


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _added(table: pa.Table) -> pa.Table:
    """The sums of one batch of documents."""
    rows = table.to_pylist()
    head = next(r for r in rows if r["doc_id"] is not None)
    docs = len(head["doc_id"])
    parts: list[list[np.ndarray]] = [[], [], []]
    for r in rows:
        values = np.frombuffer(r["sums"], dtype=np.float64)
        width = len(values) // docs
        parts[{4: 0, 3: 1, 1: 2}[width]].append(values.reshape(docs, width))
    total = parts[0][0].copy()
    # Sorted, so that the sum does not depend on the order of arrival.
    for values, cols in ((parts[1], slice(1, 4)), (parts[2], slice(3, 4))):
        if values:
            total[:, cols] += np.sort(np.array(values), axis=0).sum(axis=0)
    return pa.table({
        "doc_id": pa.array(head["doc_id"], pa.int64()), "held_out": pa.array(head["held_out"], pa.bool_()),
        "n_tokens": pa.array(total[:, 0].astype(np.int64)), "n_known": pa.array(np.rint(total[:, 1]).astype(np.int64)),
        "base_score": pa.array(total[:, 2]), "score": pa.array(total[:, 3]),
    })


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; logarithms to base 10.

    ``docs`` has ``doc_id`` (long), ``text`` and ``held_out``.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    numbered = docs.select(F.monotonically_increasing_id().alias("batch"), "doc_id", "held_out", "text")
    asked_by = _requests(
        sc.broadcast(model.lexicon), sc.broadcast(model.lexicon_counts), model.tokens, model.distinct,
        model.pair_shares, model.word_shares,
    )
    groups = max(1, -(-docs.count() // TOGETHER))
    with batches(spark, BATCH):
        requests = numbered.mapInArrow(asked_by, _REQUEST).withColumn("group", F.pmod("group", F.lit(groups)))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")
        shared = model.model.select("share", "key", "value", every)
        answers = requests.groupBy("share", "group").cogroup(shared.groupBy("share", "group")).applyInArrow(
            _answers(sc.broadcast(model.words), model.rare, model.tokens, model.distinct, model.pair_shares), _ANSWER
        )
        result = cut_lineage(answers.groupBy("batch").applyInArrow(_added, _RESULT), "lm-scores")
    return result.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and score all rows."""
    rows = tidy(docs).select("doc_id", "text").withColumn("held_out", is_held_out(F.col("doc_id")))
    return score(rows, fit(rows.filter(~F.col("held_out"))))
