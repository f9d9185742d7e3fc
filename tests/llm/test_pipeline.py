from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridloom.llm.decontam import tokens
from test_near_dups import brute, shingle_set
from test_quality import brute as base_measures


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    """What every stage returned, as the next one gets it."""
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"file://{root}/{i}"
        stage(spark, out[-1], data).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def ids(df):
    return [r["doc_id"] for r in df.select("doc_id").collect()]


def test_columns(steps):
    for df in steps[1:-1]:
        assert df.columns == steps[0].columns
    assert steps[-1].columns == [*steps[0].columns, "shard", "slot", "grown_shard"]


def test_quality_stage(steps):
    kept = set(ids(steps[1]))
    for r in steps[0].collect():
        if base_measures(r["text"])["base_failed"]:
            assert r["doc_id"] not in kept


def test_one_document_of_each_class_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    classes = brute(rows)
    assert sorted(ids(steps[2])) == sorted(min(rows[i][0] for i in c) for c in classes)


def test_no_test_item_is_left(steps, spark, data):
    items = [" ".join(tokens(r["text"])) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: " ".join(tokens(r["text"])) for r in steps[2].collect()}
    leaked = {d for d, t in texts.items() if any(i in t for i in items)}
    left = set(ids(steps[3]))
    assert not leaked & left and len(left) >= 0.8 * (len(texts) - len(leaked))


def test_mix_repeats_whole_documents(steps):
    before = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    times = defaultdict(int)
    for r in steps[4].collect():
        assert r["text"] == before[r["doc_id"]]
        times[r["doc_id"]] += 1
    assert max(times.values()) <= 3


def test_shards_hold_every_row_once(steps):
    rows = steps[5].collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(ids(steps[4]))
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages_in_order(spark, data, steps):
    assert sorted(ids(corpus_pipeline.run(spark, data))) == sorted(ids(steps[5]))


def test_stages_take_odd_rows(spark, data, odd, none):
    clash = odd.withColumns({"kept": F.lit(1), "SLOT_": F.lit(2), "_pos": F.lit(3), "fp": F.lit("x"), "class_id": F.lit(4), "target": F.lit(5.0)})
    for docs in (odd, clash, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, data)
            rows = out.count()
            assert rows <= 3 * docs.count(), name
            if name != "sharding":
                assert out.columns == docs.columns
    assert len(shingle_set(None)) == 0
