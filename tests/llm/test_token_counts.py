import base64

import tiktoken

from gridloom.llm.token_counts import PATTERN, VOCABULARY, answer_limits, length_histogram


def encoder():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(rows, lengths):
    n, total = len(lengths), sum(lengths)
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(lengths))
    for r in rows:
        limit = r["n_tokens"]
        assert r["n_docs"] == lengths.count(limit)
        assert r["docs_longer"] == sum(x > limit for x in lengths) and r["docs_upto"] == n - r["docs_longer"]
        assert r["quantile"] == r["docs_upto"] / n
        assert r["tokens_total"] == total
        assert r["tokens_kept"] == sum(min(x, limit) for x in lengths) and r["tokens_lost"] == total - r["tokens_kept"]


def test_histogram_matches_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    e = encoder()
    lengths = [len(e.encode_ordinary(r["text"])) for r in docs.collect()]
    found = length_histogram(docs)
    check(found.collect(), lengths)
    limits = [1, 100, 512, 10**6]
    answer = answer_limits(found, limits).first()
    assert answer["total"] == sum(lengths)
    assert [answer[f"kept_{x}"] for x in limits] == [sum(min(v, x) for v in lengths) for x in limits]


def test_odd_rows(odd, none):
    e = encoder()
    rows = length_histogram(odd).collect()
    check(rows, [len(e.encode_ordinary(r["text"] or "")) for r in odd.collect()])
    assert length_histogram(none).collect() == []
    assert len(e.encode_ordinary("<|endoftext|>")) > 1
