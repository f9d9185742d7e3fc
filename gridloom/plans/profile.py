"""Profiles, types, schema design and validation over the tables."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import profile as P
from gridloom.operators.keys import minimal_keys
from gridloom.plans.registry import query
from gridloom.session import cut_lineage
from gridloom.plans.staging import STAGING_SQL, products

_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "odd"]
#: Every tenth line's discount is replaced by NaN or an infinity.
_ODD_SQL = """CASE l_orderkey % 30 WHEN 0 THEN 'nan'::DOUBLE WHEN 10 THEN 'infinity'::DOUBLE WHEN 20 THEN '-infinity'::DOUBLE ELSE l_discount END"""
_DESCRIBE = f"WITH t AS (SELECT *, {_ODD_SQL} AS odd FROM lineitem), f AS (SELECT * FROM t WHERE isfinite(odd))" + " UNION ALL ".join(
    f""" SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) AS min,
        round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS q50, round(quantile_cont({c}, 0.75), 4) AS q75, max({c}) AS max,
        (SELECT count(*) FROM t WHERE NOT isfinite({c})) AS not_finite FROM {'f' if c == 'odd' else 't'}"""
    for c in _NUMERIC
)


@query("describe_numeric", _DESCRIBE)
def _(load):
    key = F.col("l_orderkey") % 30
    odd = F.when(key == 0, F.lit(float("nan"))).when(key == 10, F.lit(float("inf"))).when(key == 20, F.lit(float("-inf")))
    shown = P.describe_numeric(load("lineitem").withColumn("odd", odd.otherwise(F.col("l_discount"))), _NUMERIC)
    rounded = [F.round(c, 4).alias(c) for c in ("mean", "std", "q25", "q50", "q75")]
    return shown.select("column", "count", "min", "max", "not_finite", *rounded)


_SHAPES = {"orders": 6, "lineitem": 11, "customer": 5, "events": 6}


@query(
    "table_shape",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS rows, {n} AS cols FROM {t}" for t, n in _SHAPES.items()),
)
def _(load):
    return P.table_shapes({t: load(t) for t in _SHAPES})


def _holey_orders(load):
    """Orders as text with some values missing."""
    return load("orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(F.col("o_custkey") % 50 != 0, F.col("o_custkey").cast("string")).alias("o_custkey"),
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"),
        F.col("o_orderpriority"),
    )


_HOLEY_SQL = """holey AS (SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_custkey % 50 <> 0 THEN o_custkey::VARCHAR END AS o_custkey,
    nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderpriority FROM orders)"""
_HOLEY = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "column_profile",
    f"WITH {_HOLEY_SQL} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, max(length({c}))::INT AS longest,
            (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT {c} AS v FROM holey WHERE {c} IS NOT NULL ORDER BY 1 LIMIT 5)) AS samples FROM holey"""
        for c in _HOLEY
    ),
)
def _(load):
    return P.column_profile(_holey_orders(load), _HOLEY)


@query("key_candidates", "SELECT 'conv_id+turn' AS \"column\" UNION ALL SELECT 'o_orderkey' FROM (SELECT count(DISTINCT o_orderkey) = count(*) AS k FROM orders) WHERE k")
def _(load):
    talk = P.key_candidates(load("conversations"), ["conv_id", "turn", "role"], pairs=True)
    return talk.unionByName(P.key_candidates(load("orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]))


_KEY_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"]
_KEY_SETS = [c for n in range(1, 5) for c in combinations(range(len(_KEY_COLUMNS)), n)]
_KEYS_SQL = " UNION ALL ".join(
    f"""SELECT '{'+'.join(_KEY_COLUMNS[i] for i in s)}' AS key, {len(s)} AS width, {sum(1 << i for i in s)} AS bits,
        count(DISTINCT ({', '.join(_KEY_COLUMNS[i] for i in s)})) = count(*) AS is_key FROM l"""
    for s in _KEY_SETS
)


@query(
    "minimal_keys",
    f"""WITH l AS (SELECT * FROM lineitem WHERE l_returnflag <> 'A' AND l_orderkey % 5 = 0), k AS MATERIALIZED (SELECT * FROM ({_KEYS_SQL}) WHERE is_key)
        SELECT key, width FROM k WHERE NOT EXISTS (SELECT 1 FROM k o WHERE o.bits <> k.bits AND o.bits & k.bits = o.bits)""",
)
def _(load):
    lines = load("lineitem").filter("l_returnflag <> 'A' AND l_orderkey % 5 = 0")
    return minimal_keys(lines, _KEY_COLUMNS)


@query(
    "column_profile_sketch",
    f"WITH {_HOLEY_SQL} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, max(length({c}))::INT AS longest, true AS within FROM holey""" for c in _HOLEY
    ),
)
def _(load):
    # A part per year, sketched on its own; the merged estimate stands within four standard errors of the exact count.
    parts = _holey_orders(load).withColumn("part", F.col("o_orderkey").cast("bigint") % 7)
    estimate = P.merged_profile(P.sketch_profile(parts, _HOLEY, "part"))
    exact = P.column_profile(_holey_orders(load), _HOLEY).select("column", F.col("distinct_values").alias("exact"))
    within = F.abs(F.col("distinct_values") - F.col("exact")) <= F.col("exact") * 4 * P.SKETCH_ERROR + 1
    return estimate.join(exact, "column").select("column", "rows", "nulls", "longest", within.alias("within"))


@query(
    "duplicate_rows",
    "SELECT lang, text, count(*) AS copies FROM documents GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(load):
    return P.duplicate_rows(load("documents").select("lang", "text"))


@query(
    "max_text_length",
    """SELECT 'text' AS "column", max(length(text))::INT AS longest, 'TEXT' AS kind FROM documents
       UNION ALL SELECT 'lang', max(length(lang))::INT, 'VARCHAR(255)' FROM documents UNION ALL SELECT 'source', max(length(source))::INT, 'VARCHAR(255)' FROM documents""",
)
def _(load):
    columns = ["text", "lang", "source"]
    wide = load("documents").agg(*[F.max(F.length(c)).alias(c) for c in columns])
    return wide.unpivot([], columns, "column", "longest").withColumn("kind", F.when(F.col("longest") <= 255, "VARCHAR(255)").otherwise("TEXT"))


_FK = {
    "orders.o_custkey": ("orders", "o_custkey"), "customer.c_custkey": ("customer", "c_custkey"), "lineitem.l_orderkey": ("lineitem", "l_orderkey"),
    "orders.o_orderkey": ("orders", "o_orderkey"), "lineitem.l_suppkey": ("lineitem", "l_suppkey"), "supplier.s_suppkey": ("supplier", "s_suppkey"),
    "customer.c_nationkey": ("customer", "c_nationkey"), "nation.n_nationkey": ("nation", "n_nationkey"), "events.user_id": ("events", "user_id"),
}
_FK_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{k}' AS c, {col}::VARCHAR AS v FROM {t}" for k, (t, col) in _FK.items())


@query(
    "fk_candidates",
    f"""WITH t AS ({_FK_SQL}), s AS (SELECT c, count(*) AS total FROM t GROUP BY 1)
        SELECT a.c AS child, b.c AS parent, count(*) AS matched, any_value(total) AS total, count(*) / any_value(total) AS ratio
        FROM t a JOIN t b ON a.v = b.v AND a.c <> b.c JOIN s ON s.c = a.c GROUP BY 1, 2""",
)
def _(load):
    return P.fk_candidates({k: load(t).select(c) for k, (t, c) in _FK.items()})


def _typed_text(load):
    """Line items as text in which each column stands for one type."""
    return load("lineitem").select(
        F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("Order Key"),
        F.col("l_extendedprice").cast("decimal(12,2)").cast("string").alias("Price"),
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("Shipped"),
        F.when(F.col("l_linestatus") == "F", "yes").otherwise("No").alias("Final"),
        F.when(F.col("l_returnflag") == "N", "").otherwise(F.col("l_returnflag")).alias("Flag"),
        F.concat(F.lit("$"), F.format_number("l_extendedprice", 2)).alias("Amount ($)"),
        F.concat((F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("Discount %"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("Loaded-At"),
    )


_TYPED = ["Order Key", "Price", "Shipped", "Final", "Flag", "Amount ($)", "Discount %", "Loaded-At"]
# The text layouts above are fixed, so the expected types follow from them as long as there are rows.
_TYPES_SQL = """types AS (SELECT * FROM (VALUES ('Order Key', 'BIGINT', 'integer'), ('Price', 'NUMERIC(19,4)', 'decimal'), ('Shipped', 'TIMESTAMP', 'date'),
    ('Final', 'BOOLEAN', 'boolean'), ('Flag', 'VARCHAR(255)', 'string'), ('Amount ($)', 'VARCHAR(255)', 'currency'), ('Discount %', 'VARCHAR(255)', 'percentage'),
    ('Loaded-At', 'TIMESTAMP', 'datetime')) t("column", pg_type, logical) WHERE EXISTS (SELECT 1 FROM lineitem))"""


@query("infer_types", f'WITH {_TYPES_SQL} SELECT "column", pg_type FROM types')
def _(load):
    return P.infer_types(_typed_text(load), _TYPED).select("column", "pg_type")


@query("logical_types", f'WITH {_TYPES_SQL} SELECT "column", logical FROM types')
def _(load):
    return P.infer_types(_typed_text(load), _TYPED).select("column", "logical")


@query(
    "semantic_roles",
    """SELECT * FROM (VALUES ('Order Key', 'identifier'), ('Price', 'measure'), ('Shipped', 'dimension'), ('Final', 'dimension'), ('Flag', 'dimension'),
       ('Amount ($)', 'measure'), ('Discount %', 'measure'), ('Loaded-At', 'dimension')) t("column", role) WHERE EXISTS (SELECT 1 FROM lineitem)""",
)
def _(load):
    text = _typed_text(load)
    # Both sides count the same values.
    counts = cut_lineage(P.value_counts(text, _TYPED), "value-counts")
    return P.semantic_roles(P.column_profile(text, _TYPED, counts), P.infer_types(text, _TYPED, counts))


@query(
    "design_schema",
    f"""WITH {_HOLEY_SQL}, t AS (""" + " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) < count(*) AS nullable, count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_key,
            bool_and(regexp_full_match({c}, '[0-9]+')) AS ints FROM holey""" for c in _HOLEY
    ) + """) SELECT "column", "column" AS name, CASE WHEN ints THEN 'BIGINT' ELSE 'VARCHAR(255)' END AS pg_type, nullable, is_key FROM t""",
)
def _(load):
    return P.design_schema(_holey_orders(load), _HOLEY)


@query(
    "transform_columns",
    """SELECT l_orderkey AS order_key, l_extendedprice AS price, strftime(l_shipdate, '%Y-%m-%d') AS shipped, l_linestatus = 'F' AS final,
       nullif(l_returnflag, 'N') AS flag FROM lineitem""",
)
def _(load):
    text = _typed_text(load).select(*_TYPED[:5])
    typed = P.transform_columns(text, P.design_schema(text, _TYPED[:5]))
    return typed.withColumn("price", F.col("price").cast("double")).withColumn("shipped", F.date_format("shipped", "yyyy-MM-dd"))


@query(
    "table_from_paragraphs",
    """WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS content FROM documents)
       SELECT doc_id, content FROM l WHERE content <> '' UNION ALL
       SELECT doc_id, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l WHERE content <> '')""",
)
def _(load):
    return P.table_from_paragraphs(load("documents"), "doc_id", "text")


def _raw_orders(load):
    """Orders as text with missing customers, unreadable prices and unreadable dates."""
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    return load("orders").select(
        "o_orderkey",
        F.when(cust % 50 == 0, " ").otherwise(cust.cast("string")).alias("customer"),
        F.when(cust % 37 == 0, "TBD").otherwise(F.col("o_totalprice").cast("decimal(12,2)").cast("string")).alias("price"),
        F.when(key % 53 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("placed"),
    )


_NULLS_SQL = """SELECT o_orderkey AS row_number, 'customer' AS "column", NULL::VARCHAR AS value, 'null_violation' AS issue_type,
    'Null value in non-nullable column' AS message FROM orders WHERE o_custkey % 50 = 0"""
_MISMATCH_SQL = """SELECT o_orderkey AS row_number, 'price' AS "column", 'TBD' AS value, 'type_mismatch' AS issue_type, 'Not a NUMERIC(19,4)' AS message FROM orders WHERE o_custkey % 37 = 0
    UNION ALL SELECT o_orderkey, 'placed', 'soon', 'type_mismatch', 'Not a TIMESTAMP' FROM orders WHERE o_orderkey % 53 = 0"""


def _nulls(load):
    return P.null_violations(_raw_orders(load), "o_orderkey", ["customer", "placed"])


def _mismatches(load):
    return P.type_mismatches(_raw_orders(load), "o_orderkey", {"price": "NUMERIC(19,4)", "placed": "TIMESTAMP"})


@query("null_violations", _NULLS_SQL)
def _(load):
    return _nulls(load)


@query("type_mismatches", _MISMATCH_SQL)
def _(load):
    return _mismatches(load)


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS seen FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(load):
    return P.duplicate_keys(load("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphan_rows",
    f"WITH {STAGING_SQL} SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT product_id FROM products WHERE NOT is_deleted)",
)
def _(load):
    live = products(load).filter("NOT is_deleted")
    return P.orphan_rows(load("lineitem"), live, "l_partkey", "product_id").select("l_orderkey", "l_linenumber", "l_partkey")


_RULES_SQL = """SELECT l_orderkey AS row_number, 'shipped before ordered' AS rule FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
    UNION ALL SELECT l_orderkey, 'quantity below 0' FROM lineitem WHERE l_quantity - 5 < 0
    UNION ALL SELECT o_orderkey, 'lines do not add up' FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice::DECIMAL(12,2)) AS s FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
      WHERE o_totalprice::DECIMAL(12,2) <> coalesce(s, 0)"""


def _broken_rules(load):
    lines = load("lineitem").select("l_orderkey", "l_shipdate", (F.col("l_quantity") - 5).alias("net"), "l_extendedprice")
    orders = load("orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    dated = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    late = dated.filter("l_shipdate < o_orderdate").select(F.col("l_orderkey").alias("row_number"), F.lit("shipped before ordered").alias("rule"))
    negative = lines.filter("net < 0").select(F.col("l_orderkey").alias("row_number"), F.lit("quantity below 0").alias("rule"))
    sums = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).alias("s"))
    uneven = orders.join(sums, "o_orderkey", "left").filter(F.col("o_totalprice").cast("decimal(12,2)") != F.coalesce("s", F.lit(0)))
    return reduce(DataFrame.unionByName, [late, negative, uneven.select(F.col("o_orderkey").alias("row_number"), F.lit("lines do not add up").alias("rule"))])


@query("business_rules", _RULES_SQL)
def _(load):
    return _broken_rules(load)


_OUTLIER_SQL = """SELECT event_id, event_type, value FROM (SELECT *, (value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type) AS z FROM events)
    WHERE abs(z) > 2"""


@query("outlier_rows", _OUTLIER_SQL)
def _(load):
    return P.outlier_rows(load("events"), ["event_type"], "value").select("event_id", "event_type", "value")


def _issues(load):
    orphans = P.orphan_rows(_raw_orders(load).withColumn("customer", F.trim("customer").try_cast("bigint")),
                            load("customer").filter("c_acctbal >= 1000"), "customer", "c_custkey")
    orphan_issues = P.issue(orphans, "o_orderkey", "customer", F.col("customer"), "referential_integrity", F.lit("No parent row"))
    repeated = P.duplicate_keys(load("lineitem"), ["l_orderkey", "l_linenumber"])
    repeated_issues = P.issue(repeated, "l_orderkey", "l_linenumber", F.col("l_linenumber"), "duplicate_key",
                              F.concat(F.lit("Key seen "), F.col("seen"), F.lit(" times")))
    broken = _broken_rules(load)
    rule_issues = P.issue(broken, "row_number", "order", F.lit(None), "business_rule", F.col("rule"))
    odd = P.outlier_rows(load("orders"), ["o_orderpriority"], "o_totalprice")
    odd_issues = P.issue(odd, "o_orderkey", "o_totalprice", F.col("o_totalprice").cast("decimal(12,2)"), "outlier", F.lit("Far from the mean of its group"))
    return reduce(DataFrame.unionByName, [_nulls(load), _mismatches(load), orphan_issues, repeated_issues, rule_issues, odd_issues])


_ISSUES_SQL = f"""{_NULLS_SQL} UNION ALL {_MISMATCH_SQL} UNION ALL SELECT o_orderkey, 'customer', o_custkey::VARCHAR, 'referential_integrity', 'No parent row'
    FROM orders WHERE o_custkey % 50 <> 0 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 1000)
    UNION ALL SELECT l_orderkey, 'l_linenumber', l_linenumber::VARCHAR, 'duplicate_key', 'Key seen ' || count(*) || ' times' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
    UNION ALL SELECT row_number, 'order', NULL, 'business_rule', rule FROM ({_RULES_SQL})
    UNION ALL SELECT o_orderkey, 'o_totalprice', o_totalprice::DECIMAL(12,2)::VARCHAR, 'outlier', 'Far from the mean of its group' FROM (
      SELECT *, (o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_orderpriority)) / stddev_samp(o_totalprice) OVER (PARTITION BY o_orderpriority) AS z FROM orders) WHERE abs(z) > 2"""


@query("issue_log", _ISSUES_SQL)
def _(load):
    return _issues(load)


@query(
    "load_summary",
    f"""WITH i AS ({_ISSUES_SQL}), t AS (SELECT count(*) AS total FROM orders), b AS (SELECT count(DISTINCT row_number) AS invalid FROM i)
        SELECT total, invalid, total - invalid AS valid, invalid / total > 0.1 AS over_limit FROM t, b""",
)
def _(load):
    return P.load_summary(load("orders"), _issues(load))
