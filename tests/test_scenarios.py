"""Scenarios from a table."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import lookups


def grid(df, scenarios):
    return lookups.scenario_grid(df, ["flag"], scenarios, "name", lambda s: F.sum(F.col("v") * s["factor"]), "total")


def test_many_scenarios_in_groups(spark, monkeypatch):
    monkeypatch.setattr(lookups, "SCENARIOS_AT_ONCE", 7)
    df = spark.range(100).selectExpr("id % 3 AS flag", "CAST(id AS DOUBLE) AS v")
    scenarios = spark.range(30).selectExpr("concat('s', id) AS name", "id / 2 AS factor")
    found = {(r["name"], r["flag"]): (r["total"], r["n"]) for r in grid(df, scenarios).collect()}
    want = {(f"s{i}", f): (sum(v * i / 2 for v in range(f, 100, 3)), len(range(f, 100, 3))) for i in range(30) for f in range(3)}
    assert found == want


def test_no_scenarios_and_names_twice(spark):
    df = spark.range(5).selectExpr("id AS flag", "1.5D AS v")
    one = spark.createDataFrame([("a", 1.0)], "name string, factor double")
    assert grid(df, one.filter("name = 'b'")).collect() == []
    assert grid(df.filter("flag > 9"), one).collect() == []
    with pytest.raises(ValueError):
        grid(df, one.unionByName(one))
