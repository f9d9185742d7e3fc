import math
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from gridloom.llm.mixing import mix_sources, mixed_documents
from gridloom.llm.queries import ORACLES, QUERIES
from gridloom.operators.ordered import running_sum

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water_fill(sizes, weights=(1, 2, 3), most=3):
    """Targets by resharing step by step; sources in rank order."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, fixed = float(sum(sizes)), {}
    while True:
        left = total - sum(fixed.values())
        free = [i for i in range(len(sizes)) if i not in fixed]
        rate = left / sum(w[i] for i in free) if free else 0
        over = [i for i in free if rate * w[i] > most * sizes[i]]
        if not over:
            return [fixed.get(i, rate * w[i]) for i in range(len(sizes))]
        fixed.update({i: float(most * sizes[i]) for i in over})


def sources_of(rows):
    size, rank = defaultdict(int), {}
    for r in rows:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    return names, size


def check(rows, out):
    names, size = sources_of(rows)
    targets = dict(zip(names, water_fill([size[n] for n in names])))
    taken = defaultdict(int)
    for r in out:
        assert r["size"] == len(WORD.findall(r["text"] or ""))
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]], rel=1e-12)
        assert r["epochs"] * r["size"] <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    return targets, taken


def test_sql_agrees(spark, data):
    diff, rows = difference(QUERIES["op4_mixing"](spark, data), connect(data), ORACLES["op4_mixing"])
    assert diff is None and rows


def test_targets_and_budgets(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = mix_sources(docs).collect()
    targets, taken = check(docs.collect(), out)
    biggest = max(r["size"] for r in out)
    for s in targets:
        assert abs(taken[s] - targets[s]) <= min(biggest / 2, 0.05 * targets[s] + 20)


def test_one_long_document_does_not_shut_out_the_others(spark, monkeypatch):
    """Sources dominated by a long document, whatever its place; and the number of passes."""
    from gridloom.llm import mixing

    rng = random.Random(8)
    rows = [(i, "w " * rng.choice([1, 2, 3, 50, 400]), f"s{i % 6}") for i in range(1500)]
    rows += [(5000 + i, "w " * 30_000, f"s{i % 6}") for i in range(3)] + [(6000 + i, "w " * (1 << i), "powers") for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    passes = []
    monkeypatch.setattr(mixing, "running_sum", lambda df, *a, **k: passes.append(a[0]) or running_sum(df, *a, **k))
    for seed in (7,):
        passes.clear()
        out = mix_sources(docs, seed=seed).collect()
        targets, taken = check(docs.collect(), out)
        for s in targets:
            left = [r["size"] for r in out if r["source"] == s and not r["picked"]]
            # Within one remaining document, or within what is tolerated before documents are exchanged.
            assert abs(taken[s] - targets[s]) <= max(min(left, default=1), mixing.TOLERANCE * targets[s])
        # The two sums over the sources are not passes.
        assert sum(p == ["_src", "_none"] for p in passes) <= 30


def test_hot_source_and_capped_sources(spark):
    rows = [(i, "w " * (1 + i % 9), f"s{i % 7}" if i % 3 else "hot") for i in range(1200)]
    rows += [(5000 + i, "one two", "tiny") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mix_sources(docs).collect()
    targets, taken = check(docs.collect(), out)
    assert targets["tiny"] == 18 and taken["tiny"] == 18
    for s in targets:
        assert abs(taken[s] - targets[s]) <= 5


def sampled(weights, take, rng):
    """Plain weighted sampling without replacement: one draw after the other; the number of picks of each weight."""
    left, picks = dict(weights), defaultdict(int)
    for _ in range(take):
        at = rng.random() * sum(w * n for w, n in left.items())
        for w in left:
            at -= w * left[w]
            if at < 0:
                break
        left[w] -= 1
        picks[w] += 1
    return picks


def test_better_documents_come_first(spark):
    rows = [(i, ("word " * 10) if i % 2 else ("##$$ " * 10), "a" if i < 4000 else "b") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = [r for r in mix_sources(docs).collect() if r["source"] == "a"]
    good = sum(r["picked"] for r in out if r["doc_id"] % 2)
    bad = sum(r["picked"] for r in out if not r["doc_id"] % 2)
    # Two thirds of the source are drawn with the weights 1 and 0.2, as a plain sampler does it.
    runs = [sampled({1.0: 2000, 0.2: 2000}, good + bad, random.Random(i))[1.0] for i in range(20)]
    mean = sum(runs) / len(runs)
    spread = (sum((x - mean) ** 2 for x in runs) / len(runs)) ** 0.5
    assert good + bad == 2667 and abs(good - mean) <= 5 * spread + 5


def test_reruns_agree_and_copies_follow_taken(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    a, b = (sorted((r["doc_id"], r["taken"]) for r in mix_sources(docs).collect()) for _ in range(2))
    assert a == b
    copies = defaultdict(int)
    for r in mixed_documents(docs).collect():
        copies[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert {d: t for d, t in a if t} == {d: c for d, c in copies.items() if c}


def test_odd_rows(spark, odd, none):
    out = mix_sources(odd).collect()
    assert len(out) == odd.count()
    check(odd.collect(), out)
    assert mix_sources(none).collect() == []
    empty = odd.filter("text IS NULL OR text = ''")
    assert all(r["target"] == 0 and r["taken"] == 0 for r in mix_sources(empty).collect())
    assert all(math.isfinite(r["target"]) for r in out)
    same = spark.range(300).select(F.lit(1).alias("doc_id"), F.lit("a b").alias("text"), F.when(F.col("id") < 100, "x").otherwise("y").alias("source"))
    taken = defaultdict(int)
    for r in mix_sources(same).collect():
        taken[r["source"]] += r["taken"]
    assert taken == {"x": 200, "y": 400}
