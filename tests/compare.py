"""Compare registered queries with their SQL on the same parquet files."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{root}/{name}.parquet')")
    return con


def plain(value):
    """Value with its kind, so an int never equals a float by accident."""
    if value is None:
        return ("null", None)
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, int):
        return ("int", value)
    if isinstance(value, float):
        if math.isnan(value):
            return ("float", "nan")
        return ("float", value + 0.0)
    if isinstance(value, decimal.Decimal):
        return ("decimal", value.normalize())
    if isinstance(value, dt.datetime):
        return ("ts", value.replace(tzinfo=None).isoformat())
    if isinstance(value, dt.date):
        return ("date", value.isoformat())
    if isinstance(value, (list, tuple)):
        return ("list", tuple(plain(v) for v in value))
    return (type(value).__name__, value)


def normalise(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    out.sort(key=repr)
    return [columns[i] for i in order], out


def difference(spark_df, con, sql: str) -> tuple[str | None, int]:
    """None when equal, else a short description; with the row count."""
    left_cols, left = normalise(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    right_cols, right = normalise([d[0] for d in cur.description], cur.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} != {right_cols}", len(left)
    if len(left) != len(right):
        extra = [r for r in left if r not in set(right)][:2]
        missing = [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} != {len(right)} extra={extra} missing={missing}", len(left)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        pair = bad[0]
        cells = [(c, x, y) for c, x, y in zip(left_cols, *pair) if x != y]
        return f"{len(bad)} rows differ, first: {cells} in {pair[0]}", len(left)
    return None, len(left)


def main(argv: list[str]) -> int:
    from gridloom.plans import load_all
    from gridloom.session import get_session

    root = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    registry = load_all()
    names = []
    for arg in argv or list(registry):
        if arg.startswith("@"):
            module = f"gridloom.plans.{arg[1:]}"
            names += [n for n, q in registry.items() if q.build.__module__ == module]
        else:
            names.append(arg)
    spark = get_session("compare", cores=8)
    con = connect(root)
    failures = 0
    for name in names:
        q = registry[name]
        start = time.time()
        try:
            df = q(spark, root)
            if q.sql is None:
                rows = df.collect()
                print(f"rows  {name} {len(rows)} {time.time() - start:.1f}s {rows[:2] if rows else ''}"[:400])
                continue
            diff, n = difference(df, con, q.sql)
        except Exception as exc:  # noqa: BLE001 - a report, not a handler
            failures += 1
            text = str(exc) if os.environ.get("CHECK_LONG") else str(exc)[:700]
            print(f"ERROR {name}: {type(exc).__name__}: {text}")
            if os.environ.get("CHECK_LONG"):
                traceback.print_exc()
            continue
        if diff or n == 0:
            failures += 1
            print(f"DIFF  {name}: {diff if diff else 'empty result'}"[:1200])
        else:
            print(f"ok    {name} {n} {time.time() - start:.1f}s")
    print(f"{len(names)} checked, {failures} failed")
    return failures


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
