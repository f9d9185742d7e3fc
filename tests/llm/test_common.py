import pytest
from pyspark.sql import functions as F

from gridloom.llm.common import packed, sieve, sifted, tidy, uniform, unpacked, word_count


def test_tidy_keeps_one_column_of_a_name(spark):
    df = spark.createDataFrame([(1, "lower", "UPPER", 2, 3)], "doc_id long, text string, n string, size int, Other int")
    df = df.toDF("doc_id", "text", "TEXT", "Size", "Other")
    out = tidy(df, taken=("size",))
    assert out.columns == ["doc_id", "text", "Other"] and out.first()["text"] == "lower"
    swapped = df.toDF("doc_id", "TEXT", "text", "Size", "Other")
    assert tidy(swapped).select("text").first()[0] == "UPPER"
    with pytest.raises(ValueError, match="missing columns: text"):
        tidy(df.select("doc_id"))


def test_packed_columns_come_back(spark):
    df = spark.createDataFrame([(1, "a", 2, 3, None)], "doc_id long, text string, kept int, a int, b string").toDF(
        "doc_id", "text", "kept", "KEPT", "fp"
    )
    out = unpacked(packed(df).withColumn("kept", F.lit(9)), df.columns)
    assert out.columns == df.columns and tuple(out.first()) == (1, "a", 2, 3, None)
    more = unpacked(packed(df).withColumn("fp", F.lit("x")), df.columns, more=("fp",))
    assert more.columns == ["doc_id", "text", "kept", "KEPT", "fp"] and more.first()["fp"] == "x"
    bare = df.select("doc_id", "text")
    assert unpacked(packed(bare), bare.columns).first() == bare.first()


def test_sieve_lets_every_key_pass(spark):
    keys = spark.range(0, 30_000, 3).select(F.col("id").cast("string").alias("k"))
    bits = sieve(keys, "k")
    rows = spark.range(0, 30_000).select(F.col("id").cast("string").alias("k"))
    through = sifted(rows, bits, "k")
    assert through.join(keys, "k").count() == 10_000
    assert through.count() < 10_200
    assert sifted(rows, bits, "k", passing=False).count() == 30_000 - through.count()
    assert sifted(rows, sieve(keys.limit(0), "k"), "k").count() == 0


def test_words_and_uniform_numbers(spark):
    texts = [("a b", 2), (" a\t\x0bb\x0c\r\n", 2), ("", 0), (None, 0), ("é b c", 1)]
    got = [r["n"] for r in spark.createDataFrame(texts, "t string, w int").select(word_count(F.col("t")).alias("n")).collect()]
    assert got == [w for _, w in texts]
    u = [r["u"] for r in spark.range(4000).select(uniform(F.lit(1), F.col("id")).alias("u")).collect()]
    assert 0 < min(u) and max(u) <= 1 and abs(sum(u) / 4000 - 0.5) < 0.03
