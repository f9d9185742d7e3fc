"""Similarity and pattern joins against tables: brute force, hot grams, no cross join."""

import random
import re
import string
import time

import pytest

from gridloom.functions.similarity import indel_ratio
from gridloom.operators import similar
from gridloom.operators.similar import match_dictionary, pattern_table_join, similar_pairs


def edited(rng, word):
    out = list(word)
    for _ in range(rng.randrange(4)):
        at = rng.randrange(len(out) + 1)
        if rng.random() < 0.5 and len(out) > 1:
            del out[min(at, len(out) - 1)]
        else:
            out.insert(at, rng.choice("abcdeü_"))
    return "".join(out)


def names(spark, values, column="name"):
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


@pytest.mark.parametrize("threshold", [70.0, 80.0, 92.5, 100.0])
def test_pairs_against_brute_force(spark, threshold):
    rng = random.Random(int(threshold))
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, 13))) for _ in range(120)] + ["a", "aa", "aaaa", "ü", "日本語", "x y"]
    asked = [edited(rng, rng.choice(words)) for _ in range(250)] + ["", None, "zz", "aaaaa"]
    found = {(r["name"], r["word"], r["score"]) for r in similar_pairs(names(spark, asked), names(spark, [*words, "", None, "a"], "word"), threshold).collect()}
    want = {(a, w, indel_ratio(a, w)) for a in asked if a for w in words if indel_ratio(a, w) >= threshold}
    assert found == want and want


def test_best_of_a_dictionary(spark):
    entries = [(0, "date", ["fecha", "dato"]), (1, "amount", ["monto", "data"]), (2, "day", ["dates", "fecha"])]
    rows = [(i, own, c, w) for i, c, ws in entries for own, w in enumerate([c, *ws])]
    dictionary = spark.createDataFrame(rows, "position int, own int, canonical string, word string")
    found = {r["name"]: (r["canonical"], r["score"], r["exact"]) for r in match_dictionary(names(spark, ["fecha", "fechas", "date", "datoa", "amoun", "zzz", "", None]), dictionary).collect()}
    assert found["fecha"] == ("date", 100.0, True) and found["date"] == ("date", 100.0, True)
    assert found["fechas"] == ("date", pytest.approx(1000 / 11), False)
    # A canonical name counts for equality only.
    assert "amoun" not in found and "zzz" not in found and len(found) == 4
    assert match_dictionary(names(spark, ["a"]).filter("name = 'b'"), dictionary).collect() == []


def test_many_names_and_a_hot_gram(spark):
    """100,000 names against 10,000 words that all begin alike, without trying all pairs."""
    rng = random.Random(9)
    tail = lambda n: "".join(rng.choice(string.ascii_lowercase) for _ in range(n))
    words = [f"item {tail(9)}" for _ in range(10_000)]
    asked = [edited(rng, rng.choice(words)) if i % 4 == 0 else f"item {tail(9)}" for i in range(100_000)]
    df = similar_pairs(names(spark, asked), names(spark, words, "word"), 85.0)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    start = time.time()
    found = df.groupBy("name").count().collect()
    assert len(found) >= 20_000 and time.time() - start < 300
    some = set(rng.sample(asked, 15))
    pairs = {(r["name"], r["word"]) for r in similar_pairs(names(spark, some), names(spark, words, "word"), 85.0).collect()}
    assert pairs == {(a, w) for a in some for w in words if indel_ratio(a, w) >= 85}


def like(pattern):
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        i += 1
    return re.compile(out, re.DOTALL)


def test_patterns_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc %_\\ü") for _ in range(rng.randrange(12))) for _ in range(300)] + [None, "", "100% sure", "a_b", "back\\slash"] * 3
    patterns = ["%", "", "_", "__", "_%", "%a%", "a%", "%ab_a%", "%abc%", "%c%a%", "%\\%%", "%\\_%", "%\\\\%", "100\\% sure", "%ü%", None, "%zzz%", "%a%", "%%%", "a\\_b"]
    patterns += ["%" + "".join(rng.choice("abc_%") for _ in range(rng.randrange(1, 6))) + "%" for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame(list(enumerate(patterns)), "k int, pattern string")
    found = sorted((r["id"], r["k"]) for r in pattern_table_join(rows, rows["text"], table).collect())
    want = [(i, k) for i, t in enumerate(texts) for k, p in enumerate(patterns) if t is not None and p is not None and like(p).fullmatch(t)]
    assert found == sorted(want)


def test_ten_thousand_patterns(spark):
    """Every text holds the hot stretch ``the item``; only a pattern's own number brings them together."""
    texts = spark.range(50_000).selectExpr("id", "concat('the item no ', id % 20000, ' in stock') AS text")
    patterns = spark.range(10_000).selectExpr("id AS k", "concat('%the item%no ', id, ' in%') AS pattern")
    df = pattern_table_join(texts, texts["text"], patterns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    start = time.time()
    assert df.count() == 30_000
    assert time.time() - start < 300


def test_hot_texts_are_dealt_out(spark, monkeypatch):
    """A result much larger than both tables is spread evenly; equal rows count each."""
    monkeypatch.setattr(similar, "GROUP_ROWS", 1000)
    rows = spark.range(2000).selectExpr("id % 1900 AS id", "if(id < 1990, 'hot text', 'other') AS text")
    patterns = spark.range(50).selectExpr("id AS k", "if(id < 49, '%ot te%', 'o%') AS pattern")
    df = pattern_table_join(rows, rows["text"], patterns)
    assert df.count() == 1990 * 49 + 10
    assert df.filter("text = 'hot text'").groupBy("k").count().filter("count <> 1990").isEmpty()
    sizes = [len(p) for p in df.select("k").rdd.glom().collect()]
    assert len(sizes) >= 97 and max(sizes) <= 10 * 1000
