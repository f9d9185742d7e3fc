import random
from collections import defaultdict

import numpy as np

from gridloom.llm.darts import signatures
from gridloom.llm.near_dups import drop_near_duplicates, near_duplicates


def shingle_set(text, n=5):
    words = (text or "").encode().split()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def brute(rows, least=0.8):
    """Connected components of all pairs of similar texts; rows are (doc_id, text)."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for ids in holders.values():
        for a in range(len(ids)):
            for b in range(a):
                common[ids[a], ids[b]] += 1
    for (i, j), c in common.items():
        if c >= least * (len(sets[i]) + len(sets[j]) - c):
            parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    return {frozenset(g) for g in groups.values()}


def found(out):
    groups = defaultdict(list)
    for r in out:
        groups[r["class_id"]].append(r["doc_id"])
    return {frozenset(g) for g in groups.values()}


def by_id(rows, groups):
    return {frozenset(rows[i][0] for i in g) for g in groups}


def test_signature_agreement_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    elements = rng.integers(1, 2**63, 400).astype(np.uint64)
    x, y = rng.integers(0, 5, 400).astype(float) / 2, rng.integers(0, 5, 400).astype(float) / 2
    y[:300] = x[:300]
    sim = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    e = np.concatenate([elements[x > 0], elements[y > 0]])
    w = np.concatenate([x[x > 0], y[y > 0]])
    o = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    s = signatures(e, w, o, 2, 4096)
    assert abs((s[0] == s[1]).mean() - sim) < 4 * np.sqrt(sim * (1 - sim) / 4096)
    for n in (1, 3, 30, 5000):
        e = rng.integers(1, 2**63, n).astype(np.uint64)
        assert (signatures(e, None, np.zeros(n, int), 2, 240)[0] < 2**64 - 1).all()
        assert (signatures(e, None, np.zeros(n, int), 2, 240)[1] == 2**64 - 1).all()


def test_classes_match_brute_force_on_the_table(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").select("doc_id", "text")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    out = near_duplicates(docs).collect()
    assert found(out) == by_id(rows, brute(rows))
    for r in out:
        assert r["representative"] == (r["doc_id"] == r["class_id"])


def test_large_group_of_edited_copies(spark):
    """Copies edited at different rates share buckets without being similar to each other."""
    rng = random.Random(4)
    base = [f"w{rng.randint(0, 500)}" for _ in range(80)]
    rows = []
    for i in range(500):
        words = [w if rng.random() > rng.choice([0, 0.02, 0.04, 0.08]) else f"x{rng.randint(0, 9999)}" for w in base]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base)) for i in range(300)]
    rows += [(2000 + i, " ".join(f"y{rng.randint(0, 9999)}" for _ in range(40))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(docs).collect()) == by_id(rows, brute(rows))


def test_chain_of_copies(spark):
    """Neighbours are similar, the ends are not: one class all the same."""
    words = [f"a{i}" for i in range(100)]
    rows = []
    for i in range(12):
        rows.append((i, " ".join(words)))
        for k in range(2):
            words[(i * 8 + k) % 100] = f"b{i}_{k}"
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(near_duplicates(docs).collect()) == by_id(rows, brute(rows))


def test_odd_rows(spark, odd, none):
    out = near_duplicates(odd).collect()
    assert len(out) == odd.count()
    sizes = defaultdict(int)
    for r in out:
        sizes[r["doc_id"], r["class_size"]] += 1
    assert sizes[1, 2] == 2 and sum(r["representative"] for r in out) == odd.count() - 1
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert near_duplicates(none).collect() == []
    weighted = near_duplicates(odd, weighted=True)
    assert weighted.count() == odd.count()


def test_repeated_passage_beside_a_central_text(spark):
    """A text and itself with the passage doubled, both nearer by rank to a centre they are not similar to."""
    rng = random.Random(11)
    rows = []
    for case in range(12):
        centre = [f"c{case}w{k}" for k in range(300)]

        def changed(words, places, tag):
            return [f"{tag}{k}" if k in places else w for k, w in enumerate(words)]

        outer = changed(centre, set(range(10, 290, 33)), f"e{case}x")
        texts = [centre, outer, outer + outer]
        texts += [changed(centre, {rng.randint(20, 280)}, f"d{case}n{i}x") for i in range(8)]
        rows += [(len(rows) + i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = by_id(rows, brute(rows))
    assert sorted(map(len, expected)) == [2] * 12 + [9] * 12
    assert found(near_duplicates(docs).collect()) == expected
    assert drop_near_duplicates(docs).count() == 24
