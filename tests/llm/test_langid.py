import zlib

import numpy as np
from pyspark.sql import functions as F

from gridloom.llm.langid import PER_LANG, Ftrl, _ranked, fit_languages, identify_languages, is_held_out, ngrams, softmax


def test_held_out_accuracy_and_contract(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    truth = {r["doc_id"]: r for r in docs.collect()}
    rows = identify_languages(docs).collect()
    assert len(rows) == len(truth)
    right, brier, held = 0, 0.0, 0
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["held_out"] and len(truth[r["doc_id"]]["text"]) > 40:
            held += 1
            good = r["lang_pred"] == truth[r["doc_id"]]["lang"]
            right += good
            brier += (r["score"] - good) ** 2
    assert right >= 0.95 * held and brier / held < 0.05


def test_ngrams_do_not_depend_on_neighbours():
    texts = ["Ab c", "", None, "é", "12 34", "xyz uvw!", "İstanbul ñ"]
    h, counts = ngrams(texts)
    parts = np.split(h, np.cumsum(counts)[:-1])
    for t, p in zip(texts, parts):
        alone, n = ngrams([t])
        assert n[0] == len(p) and sorted(alone) == sorted(p)
    assert [c > 0 for c in counts] == [True, False, False, True, False, True, True]


def test_penalties_leave_unused_weights_at_zero():
    rng = np.random.default_rng(0)
    model = Ftrl(50, 2)
    for _ in range(400):
        label = int(rng.integers(0, 2))
        at = np.array([label, *rng.choice(np.arange(2, 50), 4, replace=False), 50])
        model.learn(at, np.ones(len(at)), label)
    w = model.weights()
    assert softmax(w[:, [0]].T)[0, 0] > 0.6 and softmax(w[:, [1]].T)[0, 1] > 0.6
    assert (w[:, 2:50] == 0).mean() > 0.1
    assert np.abs(w[:, :2]).min() > np.abs(w[:, 2:50]).mean()


def test_only_learnable_rows_teach(spark):
    rows = [(i, "aaa bbb aab " * 3 if i % 2 else "xxx yyy xxy " * 3, ("l1" if i % 2 else "l2")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    flipped = docs.withColumn("lang", F.when(is_held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    out = identify_languages(flipped).collect()
    assert {r["lang_pred"] for r in out} == {"l1", "l2"}
    assert all(r["lang_pred"] == ("l1" if r["doc_id"] % 2 else "l2") for r in out)


def test_copies_do_not_thin_out_the_sample(spark):
    """Few distinct texts in many rows, beside a language of many distinct texts."""
    rows = spark.range(120_000)
    few = rows.select(F.col("id").alias("doc_id"), F.concat(F.lit("aaa bbb aab "), F.repeat(F.lit("ab "), (F.col("id") % 5 + 1).cast("int"))).alias("text"), F.lit("l1").alias("lang"))
    many = rows.limit(3000).select((F.col("id") + 200_000).alias("doc_id"), F.concat(F.lit("xxx yyy xxy "), F.translate(F.col("id").cast("string"), "0123456789", "pqrstuvwxy")).alias("text"), F.lit("l2").alias("lang"))
    docs = few.unionByName(many)
    sizes = {r["lang"]: r["n"] for r in _ranked(docs).groupBy("lang").agg(F.countDistinct("text").alias("n")).collect()}
    assert sizes == {"l1": 5, "l2": PER_LANG}
    model = fit_languages(docs, F.lit(True))
    assert model.langs == ["l1", "l2"]


def test_odd_rows(spark, odd, none):
    rows = identify_languages(odd).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["lang_pred"] == "und":
            assert r["score"] == 0
    by_text = identify_languages(odd, keep=("doc_id", "source")).collect()
    assert sum(r["lang_pred"] == "und" for r in by_text) == 4
    assert identify_languages(none).collect() == []
    assert fit_languages(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True)) is None
    assert all(r["lang_pred"] == "und" for r in identify_languages(odd.withColumn("lang", F.lit(None).cast("string"))).collect())
