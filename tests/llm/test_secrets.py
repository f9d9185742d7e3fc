import hashlib
import random
import re
import string

import pytest

from gridloom.llm.secrets import KINDS, find_secrets, mask_secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 24]
    return sorted(spans)


def base(row):
    return [tuple(s) for s in row["secrets"] if s["kind"] < 3]


def test_base_spans_match_brute_force(spark, data):
    data = data.replace("sf0.001", "sf0.01")  # the smallest tables hold no secrets
    rows = find_secrets(spark.read.parquet(f"{data}/documents.parquet")).collect()
    assert sum(len(base(r)) for r in rows) > 0
    for r in rows:
        assert base(r) == brute(r["text"]), r["doc_id"]


TRICKY = [
    "token: token: abcdef", "token=secret=abcdefgh", "PASSWORD = 'a.b-c/d+e=' x", "api_key:abc api-key:abcdefg apikey\"=\"zzzzzz",
    "é😀 secret=abcdef ñ " + "ab" * 12 + " " + "0" * 23, "AKIAAKIA" + "Z" * 11 + " AKIA" + "Z" * 16 + "az", "token=", "", None,
    "token==abcdefg token  :  'short' passwd:\n123456", "x" + "a1" * 12 + "secret:" + "f" * 30,
]


def test_tricky_base_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for r in find_secrets(docs).collect():
        assert base(r) == brute(r["text"]), r["text"]


def test_random_tokens_found_and_words_left(spark):
    rng = random.Random(5)
    letters = string.ascii_letters + string.digits + "+/"
    keys = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(60)]
    likely = "etaoinshrdlu" * 6 + "cmfwypvbgk"
    plain = ["".join(rng.choice(likely) for _ in range(rng.randint(20, 40))) for _ in range(300)]
    plain += ["abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 40, "0123456789" * 4, "/usr/local/share/lib/python/site-packages"]
    texts = [f"some text {k} more" for k in keys] + [f"some text {w} more" for w in plain]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: [s for s in r["secrets"] if s["kind"] == 3] for r in find_secrets(docs).collect()}
    hits = [i for i, s in found.items() if s]
    assert sum(i < 60 for i in hits) >= 54
    assert sum(i >= 60 for i in hits) <= 4
    assert all(texts[i][s["start"]:s["end"]] == keys[i] for i in hits if i < 60 for s in found[i])


def test_upper_case_hex_and_copies_of_plain_tokens(spark):
    """Keys of 32 and 40 upper-case hex digits; a plain token in most rows does not raise the bar for others."""
    rng = random.Random(9)
    keys = ["".join(rng.choice("0123456789ABCDEF") for _ in range(n)) for n in (32, 40) for _ in range(40)]
    plain = [f"{rng.randint(0, 10**30):031d}{rng.choice('ABCDEF')}" for _ in range(40)]
    plain += ["DEADBEEF" * 4, "0" * 31 + "A", "0123456789ABCDEF" * 2]
    short = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(20)) for _ in range(40)]
    texts = [f"some text {k} more" for k in keys + short + plain] + ["see ThisThisThisThisThis1 there"] * 20000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    hits = {r["doc_id"] for r in find_secrets(docs).collect() if any(s["kind"] == 3 for s in r["secrets"])}
    assert sum(i < 40 for i in hits) >= 30 and sum(40 <= i < 80 for i in hits) >= 34
    assert sum(80 <= i < 120 for i in hits) >= 30
    assert sum(i >= 120 for i in hits) <= 2


def test_digest_format(spark, data):
    data = data.replace("sf0.001", "sf0.01")
    from gridloom.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in QUERIES["op7_secret_scans"](spark, data).collect():
        spans = brute(texts[r["doc_id"]])
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in spans) for i in range(3))
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_odd_rows_and_mask(spark, odd, none):
    rows = find_secrets(odd).collect()
    assert len(rows) == odd.count()
    assert find_secrets(none).collect() == []
    docs = spark.createDataFrame([(1, "a secret=abcdef01 b " + "0a" * 14 + " c"), (2, None)], "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in mask_secrets(docs).collect()}
    assert masked == {1: "a [SECRET] b [SECRET] c", 2: None}


@pytest.mark.parametrize("n", [3000])
def test_many_spans_in_one_text(spark, n):
    text = " ".join("0123456789abcdef01234567" for _ in range(n))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert base(find_secrets(docs).collect()[0]) == brute(text)
