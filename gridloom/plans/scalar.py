"""Scalar functions over the sales tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import dates as D
from gridloom.functions import formulas as X
from gridloom.functions import logic as L
from gridloom.functions import numbers as N
from gridloom.functions import text as S
from gridloom.functions.criteria import criteria_match
from gridloom.plans.registry import query


def _money(name: str):
    return F.col(name).cast("decimal(19,4)")


@query(
    "round_half_even",
    """SELECT l_orderkey, l_extendedprice AS price,
              round_even(l_extendedprice, 1) AS rounded, round_even(l_quantity / 2, 0) AS half_qty
       FROM lineitem""",
)
def _(load):
    return load("lineitem").select(
        "l_orderkey",
        F.col("l_extendedprice").alias("price"),
        N.round_half_even(F.col("l_extendedprice"), 1).alias("rounded"),
        N.round_half_even(F.col("l_quantity") / 2, 0).alias("half_qty"),
    )


@query(
    "round_half_up",
    """SELECT l_orderkey, l_extendedprice AS price,
              round(l_extendedprice::DECIMAL(19,4), 1)::DOUBLE AS rounded, round(l_quantity / 2, 0) AS half_qty
       FROM lineitem""",
)
def _(load):
    return load("lineitem").select(
        "l_orderkey",
        F.col("l_extendedprice").alias("price"),
        N.round_half_up(_money("l_extendedprice"), 1).cast("double").alias("rounded"),
        N.round_half_up(F.col("l_quantity") / 2, 0).alias("half_qty"),
    )


_SIGNED = "(c_acctbal::DECIMAL(19,4) - 5000)"


@query(
    "round_up",
    f"""SELECT c_custkey, sign({_SIGNED}) * ceil(abs({_SIGNED}))::DOUBLE AS whole,
               sign({_SIGNED}) * ceil(abs({_SIGNED}) * 10)::DOUBLE / 10 AS tenth FROM customer""",
)
def _(load):
    signed = _money("c_acctbal") - 5000
    return load("customer").select(
        "c_custkey", N.round_up(signed).alias("whole"), N.round_up(signed, 1).alias("tenth")
    )


@query(
    "round_down",
    f"""SELECT c_custkey, sign({_SIGNED}) * floor(abs({_SIGNED}))::DOUBLE AS whole,
               sign({_SIGNED}) * floor(abs({_SIGNED}) * 10)::DOUBLE / 10 AS tenth FROM customer""",
)
def _(load):
    signed = _money("c_acctbal") - 5000
    return load("customer").select(
        "c_custkey", N.round_down(signed).alias("whole"), N.round_down(signed, 1).alias("tenth")
    )


@query(
    "abs_value",
    """SELECT c_custkey, abs((c_acctbal::DECIMAL(19,4) - 5000)::DOUBLE) AS magnitude, 0.0::DOUBLE AS of_text
       FROM customer""",
)
def _(load):
    signed = (_money("c_acctbal") - 5000).cast("string")
    return load("customer").select(
        "c_custkey",
        F.abs(N.number_or_zero(signed)).alias("magnitude"),
        F.abs(N.number_or_zero(F.col("c_name"))).alias("of_text"),
    )


@query(
    "arith_ops",
    """WITH t AS (SELECT l_orderkey,
                 CASE WHEN l_partkey % 11 = 0 THEN 0.0 ELSE l_quantity END AS a, l_discount AS b FROM lineitem)
       SELECT l_orderkey, a + b AS plus, a - b AS minus, a * b AS times,
              CASE WHEN b = 0 THEN 0.0 ELSE a / b END AS ratio, a * a AS power, -a AS negated FROM t""",
)
def _(load):
    typed = F.when(F.col("l_partkey") % 11 == 0, "n/a").otherwise(F.col("l_quantity").cast("string"))
    a, b = F.col("a"), F.col("b")
    return (
        load("lineitem")
        .select("l_orderkey", N.number_or_zero(typed).alias("a"), F.col("l_discount").alias("b"))
        .select(
            "l_orderkey",
            (a + b).alias("plus"),
            (a - b).alias("minus"),
            (a * b).alias("times"),
            N.safe_divide(a, b).alias("ratio"),
            F.pow(a, F.lit(2)).alias("power"),
            (-a).alias("negated"),
        )
    )


@query(
    "compare_ops",
    """SELECT l_orderkey, l_quantity = 25 AS eq, l_quantity <> 25 AS ne, l_quantity > 25 AS gt,
              l_quantity < 25 AS lt, l_quantity >= 25 AS ge, l_quantity <= 25 AS le FROM lineitem""",
)
def _(load):
    names = dict(zip(L.COMPARISONS, ("eq", "ne", "gt", "lt", "ge", "le")))
    return load("lineitem").select(
        "l_orderkey", *[L.compare(F.col("l_quantity"), op, F.lit(25)).alias(name) for op, name in names.items()]
    )


@query(
    "criteria_match",
    """SELECT o_orderkey, o_totalprice >= 250000 AS big, o_orderpriority ILIKE '%high' AS high,
              o_orderstatus <> 'F' AS not_f, o_orderstatus = 'O' AS open, o_custkey = 7 AS seven,
              o_orderpriority >= '3' AS late, o_orderpriority NOT ILIKE '4-%' AS specified FROM orders""",
)
def _(load):
    return load("orders").select(
        "o_orderkey",
        criteria_match(F.col("o_totalprice"), ">=250000", numeric=True).alias("big"),
        criteria_match(F.col("o_orderpriority"), "*high").alias("high"),
        criteria_match(F.col("o_orderstatus"), "<>F").alias("not_f"),
        criteria_match(F.col("o_orderstatus"), "O").alias("open"),
        criteria_match(F.col("o_custkey"), 7).alias("seven"),
        criteria_match(F.col("o_orderpriority"), ">=3").alias("late"),
        criteria_match(F.col("o_orderpriority"), "<>4-*").alias("specified"),
    )


@query(
    "if_branch",
    """SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END AS returned,
              CASE WHEN l_quantity >= 40 THEN 'bulk' WHEN l_quantity >= 20 THEN 'mid' ELSE 'small' END AS band
       FROM lineitem""",
)
def _(load):
    quantity = F.col("l_quantity")
    return load("lineitem").select(
        "l_orderkey",
        L.if_branch((F.col("l_returnflag") == "R", F.col("l_extendedprice")), otherwise=F.lit(0.0)).alias("returned"),
        L.if_branch((quantity >= 40, F.lit("bulk")), (quantity >= 20, F.lit("mid")), otherwise=F.lit("small")).alias("band"),
    )


@query(
    "logical_ops",
    """SELECT l_orderkey, (l_quantity > 25 AND l_discount > 0.05) AS both, (l_quantity > 25 OR l_discount > 0.05) AS either,
              NOT (l_returnflag = 'R') AS kept FROM lineitem""",
)
def _(load):
    many, cheap = F.col("l_quantity") > 25, F.col("l_discount") > 0.05
    return load("lineitem").select(
        "l_orderkey",
        L.all_of(many, cheap).alias("both"),
        L.any_of(many, cheap).alias("either"),
        L.negated(F.col("l_returnflag") == "R").alias("kept"),
    )


@query(
    "if_error",
    """SELECT l_orderkey, CASE WHEN l_discount = 0 THEN -1.0 ELSE l_tax / l_discount END AS ratio,
              CASE WHEN l_tax = 0 THEN 0.0 ELSE l_tax END AS not_nan FROM lineitem""",
)
def _(load):
    ratio = F.try_divide(F.col("l_tax"), F.col("l_discount"))
    broken = F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_tax"))
    return load("lineitem").select(
        "l_orderkey",
        N.if_error(ratio, F.lit(-1.0)).alias("ratio"),
        N.if_error(broken, F.lit(0.0)).alias("not_nan"),
    )


@query(
    "concat_text",
    """SELECT p_partkey, p_name || ' ' || p_brand || '/' || p_size AS title,
              'size:' || coalesce(nullif(p_size, 50)::VARCHAR, '') AS sized FROM part""",
)
def _(load):
    maybe = F.nullif(F.col("p_size"), F.lit(50))
    return load("part").select(
        "p_partkey",
        S.concat_text(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit("/"), F.col("p_size")).alias("title"),
        S.concat_text(F.lit("size:"), maybe).alias("sized"),
    )


@query(
    "text_slices",
    """SELECT p_partkey, left(p_name, 3) AS l, right(p_name, 4) AS r, substr(p_name, 2, 3) AS m,
              format('{:,.2f}', p_retailprice) AS shown FROM part""",
)
def _(load):
    return load("part").select(
        "p_partkey",
        S.left_of(F.col("p_name"), 3).alias("l"),
        S.right_of(F.col("p_name"), 4).alias("r"),
        S.middle_of(F.col("p_name"), 2, 3).alias("m"),
        S.shown_number(F.col("p_retailprice"), 2).alias("shown"),
    )


@query(
    "trim_lower_snake",
    """SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, lower(p_brand) AS low,
              trim(regexp_replace(lower(p_name || ' - ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS snake FROM part""",
)
def _(load):
    return load("part").select(
        "p_partkey",
        F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"),
        F.lower("p_brand").alias("low"),
        S.snake_name(F.concat_ws(" - ", "p_name", F.regexp_replace("p_brand", "#", "_"))).alias("snake"),
    )


# Every price is written in one of six styles; the value each style stands for is in the SQL.
def _styled_price():
    dot = F.format_number("l_extendedprice", 2)
    comma = F.translate(dot, ",.", ".,")
    plain = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    style = F.col("l_partkey") % 6
    return (
        F.when(style == 0, F.concat(F.lit("$"), dot))
        .when(style == 1, F.concat(comma, F.lit(" €")))
        .when(style == 2, F.concat(F.lit("MXN "), plain))
        .when(style == 3, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(",5%")))
        .when(style == 4, "n/a")
        .otherwise("  ")
    )


@query(
    "parse_locale_number",
    """SELECT l_orderkey, CASE l_partkey % 6 WHEN 3 THEN (l_quantity + 0.5) / 100 WHEN 4 THEN NULL WHEN 5 THEN 0.0
              ELSE l_extendedprice END AS number FROM lineitem""",
)
def _(load):
    return load("lineitem").select("l_orderkey", N.parse_locale_number(_styled_price()).alias("number"))


@query(
    "to_numeric_coerce",
    """SELECT l_orderkey, TRY_CAST(CASE WHEN l_partkey % 13 = 0 THEN 'x' ELSE l_extendedprice::DECIMAL(12,2)::VARCHAR END AS DECIMAL(19,4))::DOUBLE AS price,
              CASE WHEN l_partkey % 13 = 0 THEN NULL ELSE l_quantity::BIGINT END AS qty FROM lineitem""",
)
def _(load):
    bad = F.col("l_partkey") % 13 == 0
    price = F.when(bad, "x").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string"))
    qty = F.when(bad, "").otherwise(F.col("l_quantity").cast("int").cast("string"))
    return load("lineitem").select(
        "l_orderkey", N.to_decimal(price).cast("double").alias("price"), N.to_bigint(qty).alias("qty")
    )


def _styled_date():
    style = F.col("o_custkey") % 6
    day = F.col("o_orderdate")
    return (
        F.when(style == 0, F.date_format(day, "yyyy-MM-dd"))
        .when(style == 1, F.date_format(day, "dd/MM/yyyy"))
        .when(style == 2, F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(style == 3, F.date_format(day, "yyyyMMdd"))
        .when(style == 4, F.date_format(day, "MMM d, yyyy"))
        .otherwise("soon")
    )


@query(
    "to_timestamp_coerce",
    """SELECT o_orderkey, CASE WHEN o_custkey % 6 = 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS at
       FROM orders""",
)
def _(load):
    parsed = D.to_timestamp_coerce(_styled_date())
    return load("orders").select("o_orderkey", F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query(
    "to_boolean",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS flag FROM orders""",
)
def _(load):
    status = F.col("o_orderstatus")
    word = F.when(status == "F", " Yes").when(status == "O", "FALSE").otherwise("maybe")
    return load("orders").select("o_orderkey", N.to_boolean(word).alias("flag"))


@query(
    "sql_numeric_casts",
    """SELECT l_orderkey, round(l_extendedprice::DECIMAL(12,2), 0)::INT AS whole, l_extendedprice::DECIMAL(12,2)::DOUBLE AS price,
              strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem""",
)
def _(load):
    text = F.col("l_extendedprice").cast("decimal(12,2)").cast("string")
    return load("lineitem").select(
        "l_orderkey",
        N.rounded_int(text).alias("whole"),
        text.try_cast("decimal(19,4)").cast("double").alias("price"),
        F.date_format(F.col("l_shipdate").cast("string").try_cast("timestamp"), "yyyy-MM-dd").alias("shipped"),
    )


_DAY = "o_orderdate::DATE"


@query(
    "excel_serial",
    f"""SELECT o_orderkey, datediff('day', DATE '1899-12-30', {_DAY}) AS serial, strftime({_DAY}, '%Y-%m-%d') AS back
        FROM orders""",
)
def _(load):
    serial = D.excel_serial(F.to_date("o_orderdate"))
    return load("orders").select(
        "o_orderkey",
        serial.cast("bigint").alias("serial"),
        D.from_serial(serial).cast("string").alias("back"),
    )


@query(
    "date_parts",
    f"""SELECT o_orderkey, CASE WHEN o_custkey % 6 IN (0, 1, 2) THEN year({_DAY}) ELSE 1900 END AS y,
               CASE WHEN o_custkey % 6 IN (0, 1, 2) THEN month({_DAY}) ELSE 1 END AS m,
               CASE WHEN o_custkey % 6 IN (0, 1, 2) THEN day({_DAY}) ELSE 1 END AS d FROM orders""",
)
def _(load):
    style = F.col("o_custkey") % 6
    day = F.to_date("o_orderdate")
    text = (
        F.when(style == 0, day.cast("string"))
        .when(style == 1, D.excel_serial(day).cast("string"))
        .when(style == 2, F.concat(day.cast("string"), F.lit("T12:00:00")))
        .otherwise("next week")
    )
    when = D.date_of(text)
    return load("orders").select(
        "o_orderkey", F.year(when).alias("y"), F.month(when).alias("m"), F.dayofmonth(when).alias("d")
    )


@query(
    "date_build",
    """SELECT p_partkey, datediff('day', DATE '1899-12-30', make_date(1990 + p_size % 20, least(greatest(p_size % 16, 1), 12), greatest(p_size % 28, 1))) AS serial
       FROM part""",
)
def _(load):
    size = F.col("p_size")
    return load("part").select(
        "p_partkey", D.date_build(1990 + size % 20, size % 16, size % 28).cast("bigint").alias("serial")
    )


@query(
    "today_now",
    """SELECT event_id, 45292 - datediff('day', ts::DATE, DATE '2024-01-01') AS today,
              datediff('day', DATE '1899-12-30', ts::DATE)
              + (hour(ts) * 3600 + minute(ts) * 60 + second(ts)) / 86400.0::DOUBLE AS now FROM events""",
)
def _(load):
    # The clock is a parameter, here the time of each event, so that results repeat.
    return load("events").select(
        "event_id", D.today_serial(F.col("ts")).cast("bigint").alias("today"), D.now_serial(F.col("ts")).alias("now")
    )


@query(
    "date_dif",
    """WITH t AS (SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS a, o_orderdate::DATE + (l_partkey % 900)::INT AS b
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
       m AS (SELECT *, (year(b) - year(a)) * 12 + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS months FROM t)
       SELECT l_orderkey, l_linenumber, b - a AS days, months, months // 12 AS years, months % 12 AS ym,
              b - (a + to_months(months::INT))::DATE AS md, b - (a + to_months((months // 12 * 12)::INT))::DATE AS yd FROM m""",
)
def _(load):
    a, b = F.col("a"), F.col("b")
    joined = load("lineitem").join(load("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.to_date("o_orderdate")
    spans = joined.select(
        "l_orderkey", "l_linenumber", start.alias("a"),
        F.date_add(start, (F.col("l_partkey") % 900).cast("int")).alias("b"),
    )
    units = {"days": "D", "months": "M", "years": "Y", "ym": "YM", "md": "MD", "yd": "YD"}
    return spans.select(
        "l_orderkey", "l_linenumber", *[D.date_dif(a, b, u).cast("bigint").alias(n) for n, u in units.items()]
    )


@query(
    "end_of_month",
    f"""SELECT o_orderkey, last_day({_DAY} + to_months((o_custkey % 25 - 12)::INT))::DATE::VARCHAR AS eom FROM orders""",
)
def _(load):
    offset = (F.col("o_custkey") % 25 - 12).cast("int")
    return load("orders").select(
        "o_orderkey", D.end_of_month(F.to_date("o_orderdate"), offset).cast("string").alias("eom")
    )


# The public holidays of the worked example.
HOLIDAYS = ("1998-01-01", "1998-12-25", "1999-01-01", "2000-05-01")
_HOLIDAYS_SQL = ", ".join(f"DATE '{h}'" for h in HOLIDAYS)


@query(
    "workday_add",
    f"""WITH cal AS (SELECT d::DATE AS d, (isodow(d) <= 5 AND d::DATE NOT IN ({_HOLIDAYS_SQL})) AS w
                     FROM generate_series(DATE '1994-01-01', DATE '2003-12-31', INTERVAL 1 DAY) g(d)),
        c AS (SELECT d, w, sum(w::INT) OVER (ORDER BY d) AS i FROM cal),
        o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_custkey % 41 - 20 AS n FROM orders)
        SELECT o.o_orderkey, (CASE WHEN n = 0 THEN o.d ELSE f.d END)::VARCHAR AS workday
        FROM o JOIN c ON o.d = c.d
        LEFT JOIN c f ON f.w AND f.i = CASE WHEN n > 0 THEN c.i + n ELSE c.i - c.w::INT + n + 1 END""",
)
def _(load):
    orders = load("orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("placed"), (F.col("o_custkey") % 41 - 20).alias("n")
    )
    calendar = D.business_calendar(orders.sparkSession, "1994-01-01", "2003-12-31", HOLIDAYS)
    return D.workday_add(orders, "placed", F.col("n"), calendar).select(
        "o_orderkey", F.col("workday").cast("string").alias("workday")
    )


@query(
    "array_ops",
    """SELECT l_orderkey, 3 AS n, l_quantity + (CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE l_suppkey END) + 0.0 AS total
       FROM lineitem""",
)
def _(load):
    blank = F.when(F.col("l_partkey") % 5 == 0, "-").otherwise(F.col("l_suppkey").cast("string"))
    nested = F.array(F.array(F.col("l_quantity").cast("string"), blank), F.array(F.col("l_returnflag")))
    # The numbers are a column of their own, so that they are read once and not for each use.
    flat = load("lineitem").select("l_orderkey", N.flatten_numbers(nested).alias("flat"))
    return flat.select("l_orderkey", F.size("flat").alias("n"), N.array_sum(F.col("flat")).alias("total"))


# Each event's properties are damaged in one of six ways before they are repaired.
def _damaged_props():
    props = F.col("props")
    kind = F.col("event_id") % 6
    return (
        F.when(kind == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```")))
        .when(kind == 1, F.regexp_replace(props, r"\}$", ",}"))
        .when(kind == 2, F.regexp_replace(props, r"\}$", r', "path": "c:\\dir"}'))
        .when(kind == 3, F.regexp_replace(props, r"\}$", ', "note": "two\nlines"}'))
        .when(kind == 4, F.concat(F.lit("Result: "), props, F.lit(" and {more")))
        .otherwise("no object here")
    )


@query(
    "json_repair",
    """SELECT event_id, CASE WHEN event_id % 6 = 5 THEN NULL ELSE (props->>'$.k')::BIGINT END AS k,
              CASE event_id % 6 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 0 END AS attempt
       FROM events""",
)
def _(load):
    repaired = load("events").select("event_id", S.json_repair(_damaged_props()).alias("fixed"))
    return repaired.select(
        "event_id",
        F.get_json_object("fixed.json", "$.k").cast("bigint").alias("k"),
        F.col("fixed.attempt").alias("attempt"),
    )


@query(
    "json_extract",
    """SELECT event_id, (props->>'$.k')::BIGINT AS k, ('{"user_id": ' || user_id || '}')->>'$.user_id' AS owner FROM events""",
)
def _(load):
    claims = F.to_json(F.struct("user_id"))
    return load("events").select(
        "event_id",
        F.try_variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"),
        F.get_json_object(claims, "$.user_id").alias("owner"),
    )


@query(
    "truncate_text",
    """SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS t80,
              CASE WHEN length(text) > 500 THEN substr(text, 1, 500) || '...' ELSE text END AS t500 FROM documents""",
)
def _(load):
    return load("documents").select(
        "doc_id",
        S.truncate_text(F.col("text"), 80).alias("t80"),
        S.truncate_text(F.col("text"), 500).alias("t500"),
    )


@query(
    "phone_e164",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '+1555' || lpad(c_custkey::VARCHAR, 7, '0')
              WHEN 1 THEN '+52' || lpad(c_custkey::VARCHAR, 10, '0') WHEN 2 THEN '+1555' || lpad(c_custkey::VARCHAR, 7, '0')
              WHEN 3 THEN '+49' || lpad(c_custkey::VARCHAR, 9, '0') END AS phone FROM customer""",
)
def _(load):
    key = F.col("c_custkey").cast("string")
    local = F.lpad(key, 7, "0")
    kind = F.col("c_custkey") % 5
    written = (
        F.when(kind == 0, F.concat(F.lit("(555) "), F.substring(local, 1, 3), F.lit("-"), F.substring(local, 4, 4)))
        .when(kind == 1, F.concat(F.lit("+52 "), F.lpad(key, 10, "0")))
        .when(kind == 2, F.concat(F.lit("1-555-"), local))
        .when(kind == 3, F.concat(F.lit("0049 "), F.lpad(key, 9, "0")))
        .otherwise("ext. 12")
    )
    return load("customer").select("c_custkey", S.phone_e164(written).alias("phone"))


def _formula():
    return F.concat(
        F.lit("=IF($B$"), "l_linenumber", F.lit('>0,SUM(C1:C'), F.col("l_linenumber") + 3,
        F.lit(")*ROUND(Rates!D$2,2)+SUM(b1),"), F.lit('"A9 SUM(")'),
    )


@query(
    "formula_functions",
    """SELECT l_orderkey, l_linenumber, 'IF,SUM,ROUND' AS functions FROM lineitem""",
)
def _(load):
    return load("lineitem").select(
        "l_orderkey", "l_linenumber", F.array_join(X.formula_functions(_formula()), ",").alias("functions")
    )


@query(
    "formula_references",
    """SELECT l_orderkey, l_linenumber,
              'O' || l_orderkey || '!B' || l_linenumber || ',O' || l_orderkey || '!C1:C' || (l_linenumber + 3) || ',Rates!D2' AS refs
       FROM lineitem""",
)
def _(load):
    sheet = F.concat(F.lit("O"), "l_orderkey")
    return load("lineitem").select(
        "l_orderkey", "l_linenumber",
        F.array_join(X.formula_references(_formula(), sheet), ",").alias("refs"),
    )


@query(
    "time_bucket",
    """SELECT 'daily' AS granularity, o_orderdate::DATE::VARCHAR AS bucket, count(*) AS n FROM orders GROUP BY ALL
       UNION ALL SELECT 'weekly', date_trunc('week', o_orderdate)::DATE::VARCHAR, count(*) FROM orders GROUP BY ALL
       UNION ALL SELECT 'monthly', date_trunc('month', o_orderdate)::DATE::VARCHAR, count(*) FROM orders GROUP BY ALL
       UNION ALL SELECT 'yearly', date_trunc('year', o_orderdate)::DATE::VARCHAR, count(*) FROM orders GROUP BY ALL""",
)
def _(load):
    # Count by day first: the four granularities then work on a few thousand rows.
    daily = load("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    buckets = F.array(
        *[
            F.struct(F.lit(g).alias("granularity"), D.time_bucket(F.col("day"), g).alias("bucket"))
            for g in D.GRANULARITIES
        ]
    )
    return (
        daily.select(F.explode(buckets).alias("b"), "n")
        .groupBy("b.granularity", F.col("b.bucket").cast("string").alias("bucket"))
        .agg(F.sum("n").alias("n"))
    )


_AS_OF = "2000-03-15"


@query(
    "period_preset",
    f"""WITH t AS (SELECT o_orderdate::DATE AS d, o_totalprice::DECIMAL(19,4) AS v FROM orders),
        p AS (SELECT * FROM (VALUES ('last7', DATE '{_AS_OF}' - 6), ('last30', DATE '{_AS_OF}' - 29), ('mtd', DATE '2000-03-01'),
              ('ytd', DATE '2000-01-01'), ('last12', DATE '1999-03-16'), ('last24', DATE '1998-03-16')) p(preset, a))
        SELECT preset, count(*) AS n, sum(v)::DOUBLE AS total FROM p JOIN t ON d BETWEEN a AND DATE '{_AS_OF}' GROUP BY preset""",
)
def _(load):
    names = ("last7", "last30", "mtd", "ytd", "last12", "last24")
    day = F.col("o_orderdate")
    orders = load("orders").filter(
        F.expr(f"o_orderdate >= timestamp_ntz'1998-03-16' AND o_orderdate < timestamp_ntz'2000-03-16'")
    )
    hit = F.filter(
        F.array(*[F.when(D.period_preset(day, n, _AS_OF), F.lit(n)) for n in names]), lambda x: x.isNotNull()
    )
    return (
        orders.select(F.explode(hit).alias("preset"), _money("o_totalprice").alias("v"))
        .groupBy("preset")
        .agg(F.count("*").alias("n"), F.sum("v").cast("double").alias("total"))
    )
