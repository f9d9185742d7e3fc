"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else is one boundary; runs of two and three of these symbols are hashed into
``FEATURES`` classes. Document frequencies come from all learnable documents. The classifier is fitted on a
bounded sample, at most ``PER_LANG`` texts of a language and ``SAMPLE`` in all, those with the smallest hash, each once:
follow-the-regularised-leader updates with elastic-net penalties, which leave most weights at exactly zero.
A fifth of the sample is kept back to fit one temperature, so that the scores are calibrated
probabilities. Prediction reads whole texts: a text's score is linear in its n-gram shares, so each n-gram
costs one look-up and no count has to be kept.

Defined cases: NULL texts and texts without a letter are ``und`` with score 0; documents without a language
teach nothing; with no learnable document all are ``und``; a NULL doc_id has the remainder of an empty text;
ties go to the language first by code point; repeated rows are treated alike; an empty table gives no rows;
an input column named like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import batches, tidy
from gridloom.session import cut_lineage, per_key

FEATURES = 1 << 16
PER_LANG, SAMPLE = 1000, 20_000
EPOCHS, LEAST_UPDATES = 3, 1000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.3, 0.01
#: Scale of the n-gram shares, so that weights and penalties are of order one.
SCALE = 20.0
UNKNOWN = "und"
BATCH = 500

_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For every code point its value if it is a letter, else 0."""
    if not _tables:
        points = np.arange(0x110000, dtype=np.uint32)
        is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
        _tables.append(np.where(is_letter, points, 0).astype(np.uint32))
    return _tables[0]


def ngrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, one after the other, and the number for each text.

    A text without letters has none.
    """
    joined = " ".join((t or "").lower() for t in texts) + " "
    # The lengths are taken after lower-casing, which may change them.
    lengths = np.fromiter((len((t or "").lower()) for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    symbols = _letters()[raw]
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[: len(symbols)]
    # Boundaries: one 0 before each word; a document's last word is closed by the 0 that follows it.
    keep = symbols != 0
    keep[1:] |= symbols[:-1] != 0
    if len(keep):
        keep[0] = True
    s, o = symbols[keep], owner[keep]
    if not len(s):
        return np.zeros(0, dtype=np.uint16), np.zeros(len(texts), dtype=np.int64)
    with np.errstate(over="ignore"):
        a = s * np.uint32(0x9E3779B1)
        two = a[:-1] ^ (s[1:] * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F))
        three = two[:-1] * np.uint32(0xC2B2AE3D) + s[2:] * np.uint32(0x165667B1)
        two = ((two ^ (two >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
        three = ((three ^ (three >> np.uint32(13))) * np.uint32(0x297A2D39)) >> np.uint32(16)
    same2 = (o[:-1] == o[1:]) & ((s[:-1] != 0) | (s[1:] != 0))
    same3 = (o[:-2] == o[2:]) & (s[1:-1] != 0)
    h = np.concatenate([two[same2], three[same3]]).astype(np.uint16)
    who = np.concatenate([o[:-1][same2], o[:-2][same3]])
    order = np.argsort(who, kind="stable")
    return h[order], np.bincount(who, minlength=len(texts))


def is_held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    """Whether the CRC-32 of the id as text leaves ``remainder``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


@dataclass(frozen=True)
class Model:
    langs: list[str]
    weights: np.ndarray  # FEATURES x languages, document frequencies worked in
    bias: np.ndarray
    temperature: float


def _frequencies(arrow_batches):
    """Per task: in how many of its documents each feature occurs."""
    found = np.zeros(FEATURES, dtype=np.int64)
    for batch in arrow_batches:
        h, counts = ngrams(batch.column(0).to_pylist())
        for part in np.split(h, np.cumsum(counts)[:-1]):
            found[np.unique(part)] += 1
    at = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["feature", "documents"])


def _vectors(arrow_batches):
    """Sparse counts of each sampled text."""
    for batch in arrow_batches:
        h, counts = ngrams(batch.column("text").to_pylist())
        at, times = [], []
        for part in np.split(h, np.cumsum(counts)[:-1]):
            u, n = np.unique(part, return_counts=True)
            at.append(u.astype(np.int32))
            times.append(n.astype(np.int32))
        ends = np.concatenate([[0], np.cumsum([len(u) for u in at])]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(x))) for x in (at, times)]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("rank"), *lists], ["lang", "rank", "at", "times"])


class Ftrl:
    """Follow the regularised leader, one example at a time, with L1 and L2 penalties per weight."""

    def __init__(self, features: int, classes: int):
        self.z = np.zeros((classes, features + 1))
        self.n = np.zeros((classes, features + 1))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(w @ x)
        p[label] -= 1.0
        g = p[:, None] * x[None, :]
        n = self.n[:, at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[:, at] += g - sigma * w
        self.n[:, at] = n + g * g


def softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _fit(langs: list[str], idf: np.ndarray, sample: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Fit on four fifths of the sample, then the temperature on the rest; the last feature is the bias."""
    examples = [
        (label, np.append(at, FEATURES), np.append(times / times.sum() * idf[at] * SCALE, 1.0)) for label, at, times in sample
    ]
    # Fewer than 50 are all learned from, and the temperature stays 1.
    apart = len(examples) >= 50
    learn = [e for i, e in enumerate(examples) if i % 5 or not apart]
    check = [e for i, e in enumerate(examples) if not i % 5 and apart]
    model = Ftrl(FEATURES, len(langs))
    rng = np.random.default_rng(3)
    # A small sample is gone through more often.
    for _ in range(max(EPOCHS, -(-LEAST_UPDATES // max(1, len(learn))))):
        for i in rng.permutation(len(learn)):
            label, at, x = learn[i]
            model.learn(at, x, label)
    w = model.weights()
    temperature = 1.0
    if check:
        logits = np.array([w[:, at] @ x for _, at, x in check])
        labels = np.array([e[0] for e in check])

        def loss(log_t: float) -> float:
            p = softmax(logits / np.exp(log_t))
            return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-300)).mean()

        # The loss is convex in 1/t, so a ternary search finds the minimum.
        low, high = np.log(0.05), np.log(20.0)
        for _ in range(60):
            a, b = low + (high - low) / 3, high - (high - low) / 3
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        temperature = float(np.exp((low + high) / 2))
    return Model(langs, (w[:, :-1] * idf * SCALE).T.astype(np.float32), w[:, -1], temperature)


def _ranked(texts: DataFrame) -> DataFrame:
    """``lang, rank, text`` of the ``PER_LANG`` distinct texts of each language with the smallest hash, or all of them."""
    hashed = texts.select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("text", F.lit(29)).alias("_h"))
    # Copies count once, however many rows they are; the texts themselves are not shuffled for it.
    sizes = per_key(hashed.select("lang", "_h").distinct().groupBy("lang").agg(F.count("*").alias("_n")))
    # Of each language about twice as many distinct texts as wanted have a hash below the cut, whatever its size.
    below = F.pmod(F.col("_h"), F.lit(1 << 31)) < F.lit(float(1 << 32) * PER_LANG) / F.col("_n")
    few = hashed.join(sizes, "lang").filter(below).drop("_n").dropDuplicates(["lang", "_h"])
    place = Window.partitionBy("lang").orderBy(F.pmod(F.col("_h"), F.lit(1 << 31)), "_h")
    ranked = few.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= PER_LANG)
    return ranked.select("lang", "rank", "text")


def fit_languages(docs: DataFrame, learnable: Column) -> Model | None:
    """Learn from the rows where ``learnable`` holds; only text, language and the row choice are used."""
    spark = docs.sparkSession
    texts = docs.filter(learnable & F.col("text").isNotNull() & F.col("lang").isNotNull())
    with batches(spark, BATCH):
        found = texts.select("text").mapInArrow(_frequencies, "feature int, documents long")
        found = found.groupBy("feature").agg(F.sum("documents").alias("documents"))
        # At most FEATURES rows.
        table = found.toArrow()
        frequency = np.zeros(FEATURES)
        frequency[table.column("feature").to_numpy()] = table.column("documents").to_numpy()
        ranked = _ranked(texts)
        # Round-robin over the languages, should there be more of them than the sample can hold in full.
        sample = ranked.select("lang", "rank", "text").orderBy("rank", "lang").limit(SAMPLE)
        sample = cut_lineage(sample, "language-sample").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
        vectors = sample.mapInArrow(_vectors, "lang string, rank int, at array<int>, times array<int>").toArrow()
    rows = sorted(
        (r, lang, i) for i, (lang, r) in enumerate(zip(vectors.column("lang").to_pylist(), vectors.column("rank").to_pylist()))
    )
    at, times = vectors.column("at"), vectors.column("times")
    langs = sorted({lang for _, lang, _ in rows}, key=lambda s: [ord(c) for c in s])
    number = {lang: i for i, lang in enumerate(langs)}
    parts = [(number[lang], at[i].values.to_numpy(), times[i].values.to_numpy()) for _, lang, i in rows]
    parts = [p for p in parts if len(p[1])]
    if not parts:
        return None
    documents = max(frequency.max(), 1.0)
    idf = np.log((documents + 1) / (frequency + 1)) + 1
    return _fit(langs, idf, parts)


def _predict(shared):
    def run(arrow_batches):
        model: Model = shared.value
        for batch in arrow_batches:
            h, counts = ngrams(batch.column("text").to_pylist())
            sums = np.zeros((len(counts), len(model.langs)))
            full = np.flatnonzero(counts)
            if len(full):
                starts = (np.cumsum(counts) - counts)[full]
                sums[full] = np.add.reduceat(model.weights[h], starts, axis=0, dtype=np.float64)
            logits = sums / np.maximum(counts, 1)[:, None] + model.bias
            p = softmax(logits / model.temperature)
            best = p.argmax(axis=1)
            known = counts > 0
            names = [model.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            score = np.where(known, p[np.arange(len(best)), best], 0.0)
            yield pa.RecordBatch.from_arrays(
                [*[c for n, c in zip(batch.schema.names, batch.columns) if n != "text"], pa.array(names, pa.string()), pa.array(score)],
                names=[*[n for n in batch.schema.names if n != "text"], "lang_pred", "score"],
            )

    return run


def predict_languages(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with ``lang_pred`` and ``score``."""
    spark = docs.sparkSession
    rows = docs.select(*[c for c in keep if c != "text"], "text")
    if model is None:
        return rows.drop("text").withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    # FEATURES x languages of the bounded sample.
    shared = spark.sparkContext.broadcast(model)
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    with batches(spark, BATCH):
        return cut_lineage(rows.mapInArrow(_predict(shared), f"{kept}, lang_pred string, score double"), "languages")


def identify_languages(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Learn from the documents that are not held out, predict all: kept columns, ``held_out, lang_pred, score``."""
    rows = tidy(docs, ("doc_id", "text", "lang"), ("held_out", "lang_pred", "score"))
    model = fit_languages(rows, ~is_held_out(F.col("doc_id")))
    marked = rows.withColumn("held_out", is_held_out(F.col("doc_id")))
    return predict_languages(marked, model, tuple(dict.fromkeys([*keep, "held_out"])))
