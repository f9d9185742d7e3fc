"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import connect, difference
from gridloom.plans import load_all

REGISTRY = load_all()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql])
def test_matches_sql(name, spark, con, data):
    diff, rows = difference(REGISTRY[name](spark, data), con, REGISTRY[name].sql)
    assert diff is None, diff


def test_entry_contract(spark, data):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.queries()["fact_load_with_fallback"](spark, data).columns == [
        "product_id", "client_name", "quantity", "unit_price", "sale_date",
    ]
