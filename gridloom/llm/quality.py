"""Quality rules: base measures of a text, and a hashed n-gram log-likelihood ratio.

Words and word pairs are hashed into a fixed number of buckets. Two multinomials over the buckets are
estimated with add-one smoothing, one from trusted target documents and one from the whole raw corpus;
a document's score is the sum of log(target / raw) over its n-grams divided by their number. Documents
whose score is below a threshold fitted on labelled documents are rejected, all alike and without chance.

Every labelled document counts, for the trusted multinomial and for the threshold, and every document for the
raw one. Everything runs as DataFrame expressions over one row at a time. Of the texts only the trusted ones are
shuffled, to meet their labels; the threshold needs scores alone.

Defined cases: NULL texts have no words; a text without n-grams scores 0; a label row with a NULL doc_id
counts for nothing; documents that share a doc_id share its label; without trusted labels the target
is the raw corpus and all scores are 0; with labels of one kind only, nothing is rejected by score; an
empty table gives no rows; an input column named like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import GAP_CHARS, WORD, let, sieve, sifted, tidy, words
from gridloom.session import cut_lineage, per_key

BUCKETS = 1 << 16
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT = 20
#: Rejecting a trusted document weighs as much as keeping this many untrusted ones.
CARE = 20
#: Steps of the threshold search between the lowest and the highest labelled score.
STEPS = 4000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _windows(hashes: Column, n: int) -> Column:
    """Hash of every run of ``n`` entries of an array of hashes."""
    runs = F.transform(
        F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(n)])
    )
    return F.when(F.size(hashes) >= n, runs).otherwise(F.array().cast("array<bigint>"))


def _covered(runs: Column, n: int) -> Column:
    """Number of words inside windows that occur twice or more; ``runs`` are the window hashes."""

    def among(ordered: Column) -> Column:
        again = F.transform(
            ordered,
            lambda x, i: F.when(
                F.coalesce(F.get(ordered, i - 1)["h"] == x["h"], F.lit(False))
                | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False)),
                x["i"],
            ),
        )
        starts = F.sort_array(F.filter(again, lambda p: p.isNotNull()))
        return let(starts, lambda s: F.aggregate(
            F.transform(s, lambda p, k: F.least(F.lit(n), F.coalesce(F.get(s, k + 1) - p, F.lit(n)))),
            F.lit(0), lambda total, step: total + step,
        ))

    placed = F.sort_array(F.transform(runs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0)).otherwise(let(placed, among))


def ngram_buckets(hashes: Column, buckets: int) -> Column:
    """Buckets of the words and word pairs of a text, given the hashes of its words."""
    return F.concat(
        F.transform(hashes, lambda h: F.pmod(h, F.lit(buckets)).cast("int")),
        F.transform(_windows(hashes, 2), lambda h: F.pmod(h, F.lit(buckets)).cast("int")),
    )


def _hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def base_measures(text: Column) -> dict[str, Column]:
    """Measures that need no array of words; the word measures come from :func:`_word_struct`."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return {
        "word_chars": F.char_length(F.translate(text, GAP_CHARS, "")).cast("long"),
        "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long"),
    }


@dataclass(frozen=True)
class Rules:
    """A fitted model: one row with the bucket weights, and the threshold."""

    weights: DataFrame
    buckets: int
    threshold: float | None


def _flags(labels: DataFrame) -> DataFrame:
    """``doc_id, _good``: 1 for trusted documents, else 0 for those of low quality; no other rows."""
    trusted = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    good = F.when(trusted, 1).when(F.col("quality") == 0, 0)
    known = labels.select("doc_id", good.alias("_good")).filter("doc_id IS NOT NULL AND _good IS NOT NULL")
    return per_key(known.groupBy("doc_id").agg(F.max("_good").alias("_good")))


def _base_failed(n_words: str, n_repeat: str) -> Column:
    return (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat) > MAX_REPEAT * F.col(n_words))


def _word_struct(text: Column, weights: Column, buckets: int) -> Column:
    def from_hashes(h: Column) -> Column:
        def score(w: Column) -> Column:
            return F.aggregate(ngram_buckets(h, buckets), F.lit(0.0), lambda s, b: s + F.get(w, b))

        repeated = let(_windows(h, WINDOW), lambda g: _covered(g, WINDOW))
        return F.struct(
            F.size(h).cast("long").alias("n_words"), let(weights, score).alias("llr"), repeated.cast("long").alias("n_repeat_words")
        )

    return let(_hashed(text), from_hashes)


def _scored(rows: DataFrame, rules_weights: DataFrame, buckets: int) -> DataFrame:
    # The one-row model becomes a column by a scalar subquery; lambdas may not hold the subquery itself.
    with_model = rows.withColumn("_weights", rules_weights.scalar())
    # A generator of one row: filters on its result stay above it, so the words are gone through once.
    once = F.explode(F.array(_word_struct(F.col("text"), F.col("_weights"), buckets)))
    found = with_model.withColumn("_w", once).drop("_weights")
    n = F.col("_w.n_words")
    grams = F.greatest(2 * n - 1, F.lit(1))
    return found.withColumn("llr_score", F.col("_w.llr") / grams)


def _fit_weights(texts: DataFrame, flags: DataFrame, buckets: int) -> DataFrame:
    """Count both multinomials: one row with the weight of every bucket."""

    def counted(rows: DataFrame, name: str) -> DataFrame:
        grams = rows.select(F.explode(let(_hashed(F.col("text")), lambda h: ngram_buckets(h, buckets))).alias("b"))
        return grams.groupBy("b").agg(F.count("*").alias(name))

    good = flags.filter("_good = 1").select("doc_id")
    # Only the trusted texts are shuffled.
    trusted = sifted(texts, sieve(good, "doc_id"), "doc_id").join(good.hint("merge"), "doc_id", "left_semi")
    every = texts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b"))
    every = every.join(counted(texts, "raw"), "b", "left").join(counted(trusted, "target"), "b", "left").fillna(0)
    every = cut_lineage(every, "bucket-counts")
    total = every.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
    if total["target"]:
        ratio = F.log((F.col("target") + 1) / F.lit(float(total["target"] + buckets))) - F.log(
            (F.col("raw") + 1) / F.lit(float(total["raw"] + buckets))
        )
    else:
        ratio = F.lit(0.0)
    # One array of a fixed number of weights.
    weights = every.agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("b"), ratio.alias("w")))), lambda x: x["w"]).alias("weights")
    )
    return cut_lineage(weights, "bucket-weights")


def fit_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> Rules:
    """Count both multinomials over ``docs`` and fit the threshold on all labelled documents."""
    texts, flags = docs.select("doc_id", "text"), _flags(labels)
    weights = _fit_weights(texts, flags, buckets)
    scored = _scored(texts.join(flags, "doc_id"), weights, buckets)
    return Rules(weights, buckets, _fit_threshold(scored.select("_good", "llr_score", "_w.n_words", "_w.n_repeat_words")))


def _fit_threshold(labelled: DataFrame) -> float | None:
    # Only what the base rules leave to the score.
    sample = labelled.filter(~_base_failed("n_words", "n_repeat_words"))
    return _threshold(cut_lineage(sample.select("_good", F.col("llr_score").alias("s")), "labelled-scores"))


def _threshold(sample: DataFrame) -> float | None:
    """The score below which rejecting loses least, a lost trusted document counting ``CARE`` times.

    Both classes count as shares of their own rows. Among equally good cuts the middle one is taken.
    """
    ends = sample.agg(
        F.min("s").alias("low"), F.max("s").alias("high"), F.sum("_good").alias("good"), F.count("*").alias("n")
    ).first()
    if not ends["good"] or ends["good"] == ends["n"] or ends["low"] == ends["high"]:
        return None
    width = (ends["high"] - ends["low"]) / STEPS
    step = F.least(F.floor((F.col("s") - ends["low"]) / width), F.lit(STEPS - 1))
    # At most STEPS rows.
    found = {
        r["k"]: (r["good"], r["n"] - r["good"])
        for r in sample.groupBy(step.alias("k")).agg(F.sum("_good").alias("good"), F.count("*").alias("n")).collect()
    }
    lost, caught, best, cuts = 0, 0, 0.0, []
    for k in range(STEPS):
        gain = caught / (ends["n"] - ends["good"]) - CARE * lost / ends["good"]
        if gain > best + 1e-12:
            best, cuts = gain, [k]
        elif cuts and abs(gain - best) <= 1e-12 and k == cuts[-1] + 1:
            cuts.append(k)
        good, bad = found.get(k, (0, 0))
        lost, caught = lost + good, caught + bad
    return ends["low"] + width * (cuts[0] + cuts[-1]) / 2 if cuts else None


def _measured(docs: DataFrame, weights: DataFrame, buckets: int) -> DataFrame:
    """Every input row with the measures, ``base_failed`` and ``llr_score``."""
    rows = tidy(docs, taken=(*MEASURES, "base_failed", "llr_score", "kept", "_w", "_weights"))
    out = _scored(rows, weights, buckets)
    out = out.withColumns(base_measures(F.col("text"))).withColumns({
        "n_words": F.col("_w.n_words"), "n_repeat_words": F.col("_w.n_repeat_words"),
    }).drop("_w")
    return out.withColumn("base_failed", _base_failed("n_words", "n_repeat_words"))


def _verdict(measured: DataFrame, threshold: float | None) -> DataFrame:
    by_score = F.lit(True) if threshold is None else F.col("llr_score") >= F.lit(threshold)
    return measured.withColumn("kept", ~F.col("base_failed") & by_score)


def apply_rules(docs: DataFrame, rules: Rules) -> DataFrame:
    """Every input row with the base measures, ``base_failed``, ``llr_score`` and ``kept``."""
    return _verdict(_measured(docs, rules.weights, rules.buckets), rules.threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Fit on ``docs`` and ``labels`` and judge every document of ``docs``; each text is scored once."""
    flags = _flags(labels)
    weights = _fit_weights(tidy(docs).select("doc_id", "text"), flags, buckets)
    measured = cut_lineage(_measured(docs, weights, buckets), "measured")
    return _verdict(measured, _fit_threshold(measured.select("doc_id", "llr_score", "n_words", "n_repeat_words").join(flags, "doc_id")))
