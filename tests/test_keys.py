"""Minimal keys against brute force, and mergeable profiles."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from gridloom.operators import profile as P
from gridloom.operators.keys import minimal_keys


def brute(rows, columns, width):
    usable = [i for i in range(len(columns)) if all(r[i] is not None for r in rows)]
    found = []
    for size in range(1, width + 1):
        for c in combinations(usable, size):
            if not any(set(k) <= set(c) for k in found) and rows and len({tuple(r[i] for i in c) for r in rows}) == len(rows):
                found.append(c)
    return sorted("+".join(columns[i] for i in c) for c in found)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keys_against_brute_force(spark, seed):
    rng = random.Random(seed)
    columns = ["a", "b", "c", "d", "e"]
    sizes = [(7, 6, 5, 4, 3), (40, 3, 3, 3, 2), (60, 60, 2, 2, 2)][seed - 1]
    rows = list({tuple(rng.randrange(n) for n in sizes) for _ in range(60)})
    if seed == 3:
        rows = [(*r[:4], None if i == 5 else r[4]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    found = minimal_keys(df, columns).collect()
    assert sorted(r["key"] for r in found) == brute(rows, columns, 4)
    assert all(r["width"] == r["key"].count("+") + 1 for r in found)


def test_keys_of_odd_tables(spark):
    df = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 2.0), ("y", 1, 2.0)], "a string, b int, c double")
    assert [r["key"] for r in minimal_keys(df, ["a", "b", "c"]).collect()] == ["a+b"]
    assert minimal_keys(df, ["a", "b", "c"], width=1).collect() == []
    assert minimal_keys(df.unionByName(df), ["a", "b", "c"]).collect() == []
    assert minimal_keys(df.filter("b > 5"), ["a", "b"]).collect() == []
    assert [r["key"] for r in minimal_keys(df.limit(1), ["a", "b"]).collect()] == ["a", "b"]


def test_hot_value_is_stripped_step_by_step(spark):
    """Two thirds of the rows share three values; only all four columns tell them apart."""
    hot = spark.range(6000).selectExpr("0L AS a", "id % 20 AS b", "id div 20 % 20 AS c", "id div 400 AS d")
    cold = spark.range(3000).selectExpr("id + 1 AS a", "id % 7 AS b", "id % 5 AS c", "id % 3 AS d")
    found = minimal_keys(hot.unionByName(cold), ["a", "b", "c", "d"]).collect()
    assert [r["key"] for r in found] == ["a+b+c+d"]


def test_sketches_merge_in_any_order_and_keep_their_error(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"file{i % 5}", f"v{rng.randrange(20_000)}", None if i % 9 == 0 else f"{i % 37}") for i in range(30_000)]
    df = spark.createDataFrame(rows, "file string, many string, few string")
    parts = P.sketch_profile(df, ["many", "few"], "file")
    assert parts.count() == 10
    whole = {r["column"]: r for r in P.merged_profile(parts).collect()}
    backward = {r["column"]: r for r in P.merged_profile(parts.orderBy(F.desc("part")).repartition(1)).collect()}
    assert whole == backward
    for i, c in ((1, "many"), (2, "few")):
        exact = len({r[i] for r in rows if r[i] is not None})
        assert abs(whole[c]["distinct_values"] - exact) <= 4 * P.SKETCH_ERROR * exact + 1
        assert whole[c]["rows"] == 30_000 and whole[c]["nulls"] == sum(r[i] is None for r in rows)
        assert whole[c]["longest"] == max(len(r[i]) for r in rows if r[i] is not None)


def test_a_new_file_merges_without_a_second_look(spark, tmp_path):
    path = str(tmp_path / "profile")
    first = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "file string, v string")
    assert P.add_to_profile(path, first, ["v"], "file").count() == 2
    # File a comes again with other rows, which are not looked at; file c is new.
    more = spark.createDataFrame([("a", "changed"), ("c", "z"), ("c", None)], "file string, v string")
    merged = P.merged_profile(P.add_to_profile(path, more, ["v"], "file")).first()
    assert (merged["rows"], merged["nulls"], merged["distinct_values"], merged["longest"]) == (5, 1, 3, 1)
    assert P.merged_profile(P.sketch_profile(first.filter("v = 'q'"), ["v"], "file")).collect() == []


def test_common_type_of_stacked_sheets(spark):
    from gridloom.operators.discovery import common_types

    rows = [("a", "integer"), ("a", "decimal"), ("b", "integer"), ("b", "percentage"), ("c", "date"), ("c", "datetime"), ("d", "date"), ("d", "integer"),
            ("e", "boolean"), ("e", None), ("f", None), ("f", "unknown"), ("g", "currency"), ("g", "currency"), ("h", "boolean"), ("h", "string")]
    found = {r["canonical"]: (r["type"], r["sheets"], r["conflict"]) for r in common_types(spark.createDataFrame(rows, "canonical string, type string")).collect()}
    assert found == {"a": ("decimal", 2, True), "b": ("decimal", 2, True), "c": ("datetime", 2, True), "d": ("string", 2, True),
                     "e": ("boolean", 2, False), "f": ("string", 2, False), "g": ("currency", 2, False), "h": ("string", 2, True)}
