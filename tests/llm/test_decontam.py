import random

import numpy as np

from gridloom.llm.decontam import GAP, MATCH, MISMATCH, align, contaminated_texts, drop_contaminated, tokens


def plain_smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (MATCH if a[i - 1] == b[j - 1] else MISMATCH), h[i - 1, j] + GAP, h[i, j - 1] + GAP)
    return h.max()


def test_alignment_matches_plain_dynamic_programme():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, 25)).astype(np.uint64) for _ in range(2))
        score, first, last = align(a, b)
        assert score == plain_smith_waterman(a, b)
        if score:
            assert 0 <= first < last <= len(b)
            assert plain_smith_waterman(a, b[first:last]) == score


def brute(docs, items, least=0.5):
    out = set()
    for d, text in docs:
        t = tokens(text)
        for i, item in items:
            w = tokens(item)
            if len(w) < 4 or not t:
                continue
            ids = {x: k for k, x in enumerate(dict.fromkeys(w + t))}
            a, b = (np.array([ids[x] for x in s], dtype=np.uint64) for s in (w, t))
            if align(a, b)[0] >= least * MATCH * len(w):
                out.add((d, i))
    return out


def test_table_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    got = {(r["doc_id"], r["item_id"]) for r in contaminated_texts(docs, items).collect()}
    assert got and got == brute(rows, known)
    for d, i in got:
        assert any(d == a and i == b for a, b in got)
    left = {r["doc_id"] for r in drop_contaminated(docs, items).collect()}
    assert left == {d for d, _ in rows} - {d for d, _ in got}


def test_edited_copies_are_found_and_clean_texts_left(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(25, 60)))) for i in range(30)]
    items.append((99, "too short item"))
    docs, planted = [], set()
    for d in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 200))]
        if d % 3 == 0:
            i, text = rng.choice(items[:30])
            copy = []
            for w in text.split():
                u = rng.random()
                if u < 0.05:
                    continue
                copy.append(rng.choice(vocabulary) if u < 0.12 else w.upper() + ",")
            at = rng.randint(0, len(words))
            words[at:at] = copy
            planted.add((d, i))
        docs.append((d, " ".join(words)))
    out = contaminated_texts(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == planted
    texts = dict(docs)
    for r in out:
        inside = " ".join(tokens(texts[r["doc_id"]])[r["first_word"]:r["last_word"]])
        assert len(inside.split()) >= 15


def test_short_items_with_every_fifth_word_replaced(spark):
    """Copies without six words in a row of the item, whose last words are edited too."""
    rng = random.Random(3)
    items, docs = [], []
    for i in range(40):
        words = [f"i{i}w{k}" for k in range(rng.randint(15, 20))]
        items.append((i, " ".join(words)))
        at = rng.randint(0, 4)
        copy = [f"x{i}n{k}" if k % 5 == at or k == len(words) - 2 else w for k, w in enumerate(words)]
        around = [f"a{rng.randint(0, 99)}" for _ in range(40)]
        docs.append((i, " ".join(around[:20] + copy + around[20:])))
    expected = brute(docs, items)
    assert len(expected) == 40
    out = contaminated_texts(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == expected


def test_passage_in_a_third_of_all_texts(spark):
    item = " ".join(f"c{i}" for i in range(30))
    docs = [(i, f"start {i} " + (item if i % 3 == 0 else "nothing of it") + f" end {i}") for i in range(900)]
    out = contaminated_texts(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame([(1, item), (2, item), (3, None), (None, "x y z a b c")], "item_id long, text string"),
    ).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in out) == sorted((i, k) for i in range(0, 900, 3) for k in (1, 2))


def test_odd_rows(spark, odd, none):
    items = spark.createDataFrame([(1, "one two three four five six seven", "x")], "item_id long, text string, doc_id string")
    out = [(r["doc_id"], r["item_id"]) for r in contaminated_texts(odd, items).collect()]
    assert out == [(1, 1), (1, 1)]
    kept = drop_contaminated(odd, items)
    assert kept.count() == odd.count() - 2 and kept.columns == odd.columns
    assert contaminated_texts(none, items).collect() == []
    assert contaminated_texts(odd, items.filter("item_id = 0")).collect() == []
    assert drop_contaminated(odd, items.filter("item_id = 0")).count() == odd.count()
