import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.llm.quality import MEASURES, apply_rules, fit_rules, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    runs = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    count = {}
    for r in runs:
        count[r] = count.get(r, 0) + 1
    covered = {i + k for i, r in enumerate(runs) if count[r] > 1 for k in range(5)}
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": n < 10 or 100 * len(covered) > 20 * n,
    }


@pytest.fixture(scope="module")
def judged(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality_rules(docs, labels).collect()


def test_base_measures_match_brute_force(judged):
    docs, _, rows = judged
    assert len(rows) == docs.count()
    for r in rows:
        assert {k: r[k] for k in brute(r["text"])} == brute(r["text"]), r["doc_id"]


def test_scores_match_a_plain_model(spark, judged):
    """The same model counted in Python, over the same hashed buckets."""
    docs, labels, rows = judged
    good = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"]}
    buckets = {}
    words = sorted({w for r in rows for w in WORD.findall(r["text"] or "")})
    for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect():
        buckets[r["w"]] = r["h"]
    pairs = sorted({(buckets[a], buckets[b]) for r in rows for ws in [WORD.findall(r["text"] or "")] for a, b in zip(ws, ws[1:])})
    of_pair = {
        (r["a"], r["b"]): r["h"]
        for r in spark.createDataFrame(pairs, "a long, b long").select("a", "b", F.xxhash64("a", "b").alias("h")).collect()
    }
    raw, target, grams = {}, {}, {}
    for r in rows:
        hs = [buckets[w] for w in WORD.findall(r["text"] or "")]
        g = [h % 65536 for h in hs] + [of_pair[p] % 65536 for p in zip(hs, hs[1:])]
        grams[r["doc_id"]] = g
        for b in g:
            raw[b] = raw.get(b, 0) + 1
            target[b] = target.get(b, 0) + (r["doc_id"] in good)
    n_raw, n_target = sum(raw.values()) + 65536, sum(target.values()) + 65536
    for r in rows:
        g = grams[r["doc_id"]]
        score = sum(math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw) for b in g) / max(1, len(g))
        assert r["llr_score"] == pytest.approx(score, abs=1e-9)


def test_verdict_follows_labels(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # a few hundred labels
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules(docs, labels).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows}
    long_enough = {r["doc_id"] for r in rows if not r["base_failed"]}
    good = [r["doc_id"] for r in labels.collect() if r["quality"] == 1 and not r["toxic"] and r["doc_id"] in long_enough]
    bad = [r["doc_id"] for r in labels.collect() if r["quality"] == 0]
    assert sum(kept[d] for d in good) >= 0.97 * len(good)
    assert sum(kept[d] for d in bad) <= 0.05 * len(bad)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (6, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_rules(odd, labels)
    rows = out.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(out.columns)
    for r in rows:
        assert {k: r[k] for k in brute(r["text"])} == brute(r["text"])
        assert r["kept"] in (True, False)
    assert quality_rules(none, labels).collect() == []
    rules = fit_rules(odd.select("doc_id", "text"), labels.filter("quality = 5"))
    assert rules.threshold is None
    assert all(r["llr_score"] == 0 for r in apply_rules(odd, rules).collect())
    clash = odd.withColumnRenamed("Size", "KEPT").withColumnRenamed("score", "n_words")
    assert [c.lower() for c in quality_rules(clash, labels).columns].count("kept") == 1
    assert set(MEASURES) <= set(quality_rules(clash, labels).columns)


def test_every_labelled_document_counts(spark):
    """With all documents trusted both multinomials are the same, however many there are."""
    docs = spark.range(20_100).select(F.col("id").alias("doc_id"), F.concat(F.lit("alpha w"), F.col("id") % 997).alias("text"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    worst = quality_rules(docs, labels).agg(F.max(F.abs("llr_score"))).first()[0]
    assert worst == pytest.approx(0, abs=1e-12)
