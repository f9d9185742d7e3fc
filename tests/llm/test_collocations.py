import random
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from compare import connect, difference
from gridloom.llm import collocations as C
from gridloom.llm.queries import ORACLES, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, longest=3):
    found = defaultdict(Counter)
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            for n in range(1, longest + 1):
                found["und" if lang is None else lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    return found


def brute(rows, least=10, inside=50, best=2000, longest=3):
    out = []
    for lang, counts in counted(rows, longest).items():
        n = sum(f for p, f in counts.items() if len(p) == 1)
        frequent = {p: f for p, f in counts.items() if len(p) > 1 and f >= least}
        around = Counter()
        for p, f in frequent.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    around[p[i : i + m]] = max(around[p[i : i + m]], f)
        found = []
        for p, a in frequent.items():
            if around[p] and 100 * around[p] >= inside * a:
                continue
            score, k = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def result(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def texts(df):
    return [(r["text"], r["lang"]) for r in df.collect()]


def test_sql_and_brute_force_agree(spark, data):
    found = QUERIES["op13_collocations"](spark, data)
    diff, rows = difference(found, connect(data), ORACLES["op13_collocations"])
    assert diff is None and rows
    assert result(found) == brute(texts(spark.read.parquet(f"{data}/documents.parquet")))


def test_hot_passage_ties_and_longer_phrases(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["ü", "Öl", "the", "The", "a\tb", "x.y"]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(60))), rng.choice(["en", "fr", None, "und", ""])) for _ in range(900)]
    rows += [("All Work and no play; ALL work\nand no play all all all all", "en")] * 400
    docs = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    assert result(C.collocations(docs)) == brute(rows)
    assert result(C.collocations(docs, least=3, inside=80, best=7, longest=4)) == brute(rows, 3, 80, 7, 4)


def test_small_partitions_and_early_flushes(spark, monkeypatch):
    """Summaries of many small pieces in many hash partitions find the same."""
    rng = random.Random(4)
    rows = [(" ".join(f"v{min(rng.randrange(400), rng.randrange(400))}" for _ in range(200)), "en") for _ in range(300)]
    monkeypatch.setattr(C, "MASS", 2000)
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert result(C.collocations(docs)) == brute(rows)
    parts = [C.Words([t for t, _ in rows[i : i + 50]], ["en"] * 50).runs(2)[1] for i in range(0, 300, 50)]
    told = list(C._summaries(2, [], 5, 10)(iter([])))
    assert len(told) == 1 and told[0].num_rows == 0 and sum(map(len, parts)) == 300 * 199


@given(st.lists(st.lists(st.integers(0, 40), max_size=80), max_size=6), st.integers(1, 12))
@settings(max_examples=200, deadline=None)
def test_frequent_keys_survive_any_merge(lists, least):
    mass = sum(map(len, lists))
    whole = Counter(x for part in lists for x in part)
    for order in (lists, lists[::-1]):
        summary = C.MisraGries(mass // least + 1)
        for part in order:
            own = C.MisraGries(mass // least + 1)
            keys, counts = np.unique(np.array(part, dtype=np.uint32), return_counts=True)
            own.merge(keys, counts)
            summary.merge(own.keys, own.counts, own.error)
        assert summary.error < least and len(summary.keys) <= summary.capacity
        alive = set(summary.may_reach(least).tolist())
        assert {k for k, f in whole.items() if f >= least} <= alive
        got = dict(zip(summary.keys.tolist(), summary.counts.tolist()))
        assert all(f - summary.error <= got.get(k, 0) <= f for k, f in whole.items())


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(3_000_000_019, 4_000_000_007, 3_000_000_019), (9_007_199_254_740_993, 9_007_199_254_740_993, 9_007_199_254_740_995), (10, 10, 10)]
    found = spark.createDataFrame(rows, "a long, l long, r long").withColumn("s", C.exact_score()).collect()
    assert [r["s"] for r in found] == [10**6 * a * a // (x * y) for a, x, y in rows]


def test_words_are_those_of_the_rule():
    text = "Ab\tcD  e.f,,g\r\nÄB ü😀:h"
    words = C.Words([text, None, "", "cd e"], ["en", "en", None, "en"])
    assert [words.phrase(i, 1) for i in range(len(words.hash))] == ["ab", "cd", "e", "f", "g", "Äb", "ü😀", "h", "cd", "e"]
    first, hashes = words.runs(2)
    assert [words.phrase(i, 2) for i in first] == ["ab cd", "cd e", "Äb ü😀", "cd e"]
    assert hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3


def test_odd_rows(spark, odd, none):
    assert C.collocations(none).collect() == []
    assert result(C.collocations(odd)) == brute(texts(odd))
    long = spark.createDataFrame([("lorem ipsum dolor " * 300_000, None), ("solo", "de"), ("y" * 3_000_000, "de")], "text string, lang string")
    assert result(C.collocations(long)) == brute(texts(long))
