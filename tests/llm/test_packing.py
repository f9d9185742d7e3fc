import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridloom.llm.packing import RANKS, TOKENIZER, Encoder, cuts, pack_documents, padded_sequences


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def encoder():
    with open(TOKENIZER, "rb") as a, open(RANKS, "rb") as b:
        return Encoder(a.read(), b.read())


def check(rows, docs, tokenizer, capacity=2048, most_padding=0.0):
    """Every id in one piece, checksums, gapless places, and the padding."""
    want = defaultdict(list)
    for doc_id, text in docs:
        want[doc_id].append([*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 1])
    per_doc, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        per_doc[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(per_doc) == set(want)
    for key, ids in want.items():
        expected = sorted((len(x), i) for i, x in enumerate(ids))
        assert sorted({(r["doc_tokens"]) for r in per_doc[key]}) == sorted({n for n, _ in expected})
        if len(ids) == 1:
            at = 0
            for r in sorted(per_doc[key], key=lambda r: r["start"]):
                assert r["start"] == at
                part = ids[0][at : at + r["length"]]
                assert len(part) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
                at += r["length"]
            assert at == len(ids[0])
        assert sum(r["length"] for r in per_doc[key]) == sum(map(len, ids))
    total = padding = 0
    assert sorted(bins) == list(range(len(bins)))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert padding <= most_padding * total
    return bins


def test_registered_query(spark, data, tokenizer):
    from gridloom.llm.queries import QUERIES

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    bins = check(QUERIES["op12_packing"](spark, data).collect(), docs, tokenizer)
    total = sum(length for parts in bins.values() for _, length in parts)
    assert len(bins) <= total // 2048 + 11


def test_whole_rests_stay_in_harmonic_classes(spark, data, tokenizer):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = pack_documents(docs.repartition(5), cut=False).collect()
    bins = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, most_padding=1.0)
    for parts in bins.values():
        kinds = {2048 // length for _, length in parts}
        assert len(kinds) == 1 and len(parts) <= kinds.pop()
    short = sum(2048 // parts[0][1] != len(parts) for parts in bins.values())
    assert short <= len({2048 // parts[0][1] for parts in bins.values()})


def test_sequences_hold_the_ids(spark, odd, tokenizer):
    pieces = pack_documents(odd.repartition(3), capacity=64, with_ids=True)
    rows = {r["sequence_id"]: r for r in padded_sequences(pieces, 64, pad=9).collect()}
    for p in pieces.collect():
        ids = rows[p["sequence_id"]]["ids"][p["offset"] : p["offset"] + p["length"]]
        assert zlib.crc32(np.array(ids, dtype="<u4").tobytes()) == p["ids_crc32"]
    for r in rows.values():
        n = r["n_tokens"]
        assert len(r["ids"]) == (n if n & (n - 1) == 0 else 64) and r["ids"][n:] == [9] * r["padding"]
        assert [d["offset"] for d in r["documents"]][0] == 0


def test_odd_rows(spark, odd, none, tokenizer):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check(pack_documents(odd).collect(), docs, tokenizer)
    assert pack_documents(none).collect() == [] and pack_documents(none, cut=False).collect() == []
    long = spark.createDataFrame([(1, "lorem ipsum " * 400_000), (2, "a" * 30_000), (3, "x<|endoftext|>y"), (4, "日本語 😀 ​word")], "doc_id long, text string")
    check(pack_documents(long).collect(), [tuple(r) for r in long.collect()], tokenizer)
    with pytest.raises(ValueError):
        pack_documents(odd, capacity=100)


def test_fast_encoding_of_plain_characters_is_the_same(tokenizer, encoder):
    def same(text):
        assert encoder.ids(text) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)

    plain = [*range(0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F)]
    for point in plain:
        c = chr(point)
        same(f"ab{c}cd {c}{c}x1{c}2 {c} .{c}!{c}\n{c} {c}'s{c}")


@given(st.text(st.characters(codec="utf-8"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_is_encoded_the_same(tokenizer, encoder, text):
    assert encoder.ids(text) == (tokenizer.encode(text, add_special_tokens=False).ids if text else [])


def test_cuts():
    for n in (1, 2, 63, 64, 65, 1000, 4096, 5001):
        for cut in (True, False):
            starts, sizes = cuts(n, 64, cut)
            assert sizes.sum() == n and (np.cumsum(sizes) - sizes == starts).all()
            assert not cut or all(64 % s == 0 for s in sizes)
