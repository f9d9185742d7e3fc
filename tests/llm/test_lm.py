import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import lm
from gridloom.llm.pitman_yor import Root, log_stirling, sweep

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def check_base(rows, texts):
    """``texts``: list of (doc_id, text) in any order, doc_ids unique."""
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in texts}
    c = Counter()
    for d, t in texts:
        if not held[d]:
            c.update(lowered(t))
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    by_id = dict(texts)
    assert len(rows) == len(texts)
    for r in rows:
        tokens = lowered(by_id[r["doc_id"]]) + ["\n"]
        assert r["held_out"] == held[r["doc_id"]]
        assert r["n_tokens"] == len(tokens) and r["n_known"] == sum(c[t] > 0 for t in tokens)
        assert r["train_tokens"] == n
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens), rel=1e-9)
        assert r["score"] < 0


def pairs_of(model):
    out = {}
    for r in model.model.filter(F.col("share") < model.pair_shares).collect():
        out.update(zip(np.frombuffer(r["key"], dtype=np.uint32).tolist(), np.frombuffer(r["value"]).tolist()))
    return out


def test_contract_on_the_table(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    rows = lm.score_documents(docs).collect()
    check_base(rows, [(r["doc_id"], r["text"]) for r in docs.collect()])
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = lm.fit(docs)
    pairs = pairs_of(model)
    words = model.words.parent.shape[1]
    for context in (0, 1, 2, 5, words - 1):
        seen = np.zeros(words)
        for key, value in pairs.items():
            if key >> 16 == context:
                seen[key & 0xFFFF] = value
        rest = (model.words.rest[:, [context]] * model.words.parent).mean(axis=0)
        assert (seen + rest).sum() == pytest.approx(1, abs=1e-9)
    hashes = {int(h) for h in model.lexicon[0]}
    rare = np.array([r["n"] for r in model.counts.collect() if r["key"] & (2**64 - 1) not in hashes])
    shares = 10.0 ** model.rare.log10(np.append(rare, 0))
    assert len(rare) and shares.sum() == pytest.approx(1, abs=1e-9)


def test_scores_match_a_plain_walk(spark):
    texts = [(i, t) for i, t in enumerate(["a b a b c", "a b", "c a b", "a b c", "", "b b b"] * 5 + ["rare a", "a b c odd zz"])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    model = lm.fit(docs)
    pairs = pairs_of(model)
    hashes, ids = model.lexicon
    number = {int(h): int(i) for h, i in zip(hashes, ids)}
    counts = Counter(w for _, t in texts for w in lowered(t))
    texts += [(100, "a never zz"), (101, "never b")]
    marked = spark.createDataFrame(texts, "doc_id long, text string").withColumn("held_out", F.lit(False))
    for r in lm.score(marked, model).collect():
        total, before = 0.0, lm.END
        for w in [*lowered(dict(texts)[r["doc_id"]]), None]:
            at = lm.END if w is None else number.get(int(lm._words[w.encode()]), lm.OTHER)
            rest = (model.words.rest[:, before] * model.words.parent[:, at]).mean()
            total += math.log10(pairs.get(before << 16 | at, 0.0) + rest)
            if at == lm.OTHER:
                total += float(model.rare.log10(np.array([float(counts[w])]))[0])
            before = at
        assert r["score"] == pytest.approx(total, rel=1e-9)


def test_stirling_numbers_and_table_posterior():
    d = 0.4
    s = np.exp(log_stirling(d))
    assert s[2, 1] == pytest.approx(1 - d) and s[3, 2] == pytest.approx((1 - d) + (2 - 2 * d))
    # One word of three customers alone in a restaurant, against the enumerated posterior.
    p0, theta = 0.3, 1.0
    weight = np.array([s[3, t] * np.prod([theta + d * i for i in range(t)]) * p0**t for t in (1, 2, 3)])
    rng = np.random.default_rng(0)
    draws = 40000
    room = np.arange(draws)
    t = sweep(room, np.full(draws, 3), np.ones(draws, dtype=np.int64), np.full(draws, np.log(p0)), draws, d, rng)
    share = np.bincount(t, minlength=4)[1:] / draws
    assert np.abs(share - weight / weight.sum()).max() < 0.01


def test_many_customers_and_root():
    rng = np.random.default_rng(1)
    c = np.array([1, 2, 96, 97, 5000, 10**7])
    t = sweep(np.zeros(6, dtype=np.int64), c, np.ones(6, dtype=np.int64), np.full(6, -2.0), 1, 0.5, rng)
    assert (t >= 1).all() and (t <= c).all() and t[5] > t[2]
    root = Root(10)
    assert root.reseat(np.zeros(10), rng) == pytest.approx(0.1)
    assert root.reseat(np.array([5, 0, 900, 1, 0, 0, 0, 0, 0, 3.0]), rng).sum() == pytest.approx(1)


def test_odd_rows(spark, odd, none):
    rows = lm.score_documents(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    check_base(rows, list(texts.items()))
    assert len(lm.score_documents(odd).collect()) == odd.count()
    assert lm.score_documents(none).collect() == []
    held = spark.range(200).filter(lm.is_held_out(F.col("id"))).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text"))
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in lm.score_documents(held).collect())


def test_rare_words_leave_the_frequent_ones_remembered():
    """Numbers and hashes are those of a plain lookup; what is remembered is bounded by the lexicon."""
    frequent = [f"w{i}".encode() for i in range(50)]
    hashes = lm._hashes(frequent)
    order = np.argsort(hashes)
    known = lm.WordIds((hashes[order], np.arange(lm.FIRST, lm.FIRST + 50)[order]))
    number = dict(zip(frequent, range(lm.FIRST, lm.FIRST + 50)))
    for batch in range(20):
        words = [w for i in range(3000) for w in (f"rare {batch} {i}".encode(), frequent[i % 50])]
        ids, places, rare = known.of(words)
        assert ids.tolist() == [number.get(w, lm.OTHER) for w in words]
        assert [words[i] for i in places] == [w for w in words if w not in number]
        assert rare.tolist() == [lm._words[words[i]] for i in places]
    assert len(known.seen) == 50
    empty = lm.WordIds((np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)))
    ids, places, rare = empty.of([b"a", b"b"])
    assert ids.tolist() == [lm.OTHER] * 2 and places.tolist() == [0, 1] and len(empty.of([])[0]) == 0
