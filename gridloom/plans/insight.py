"""Metrics and insights over orders, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import insights as I
from gridloom.operators.ordered import running_sum
from gridloom.operators.profile import outlier_rows
from gridloom.plans.registry import query
from gridloom.sources.sinks import report_lines

_MONTHLY_SQL = """m AS (SELECT o_orderpriority AS p, date_trunc('month', o_orderdate)::DATE AS month, sum(o_totalprice::DECIMAL(19,4))::DOUBLE AS v FROM orders GROUP BY 1, 2)"""
_CHANGE_SQL = f"""{_MONTHLY_SQL}, c AS (SELECT m.*, m.v - a.v AS mom_delta, (m.v - a.v) / a.v * 100 AS mom_percent, m.v - b.v AS yoy_delta, (m.v - b.v) / b.v * 100 AS yoy_percent
    FROM m LEFT JOIN m a ON a.p = m.p AND a.month + INTERVAL 1 MONTH = m.month LEFT JOIN m b ON b.p = m.p AND b.month + INTERVAL 12 MONTH = m.month)"""
_TURN_SQL = """t0 AS (SELECT *, sign(v - lag(v) OVER (PARTITION BY p ORDER BY month)) AS d FROM m),
    t1 AS (SELECT *, lag(d) OVER (PARTITION BY p ORDER BY month) AS was FROM t0), turns AS (SELECT p, month, v, d FROM t1 WHERE d * was < 0)"""


def _series(load):
    total = F.col("o_totalprice").cast("decimal(19,4)")
    return I.monthly(load("orders").withColumnRenamed("o_orderpriority", "p"), ["p"], "o_orderdate", total)


def _dated(df):
    return df.withColumn("month", F.col("month").cast("string"))


@query("period_change", f"WITH {_CHANGE_SQL} SELECT * REPLACE (month::VARCHAR AS month) FROM c")
def _(load):
    return _dated(I.period_change(_series(load), ["p"]))


@query("trend_reversal", f"WITH {_MONTHLY_SQL}, {_TURN_SQL} SELECT p, month::VARCHAR AS month, v, d::DOUBLE AS direction FROM turns")
def _(load):
    return _dated(I.trend_reversal(_series(load), ["p"]))


@query(
    "zscore_outliers",
    """SELECT event_id, user_id, value FROM (SELECT *, (value - avg(value) OVER (PARTITION BY user_id)) / stddev_samp(value) OVER (PARTITION BY user_id) AS z FROM events)
       WHERE abs(z) > 2""",
)
def _(load):
    return outlier_rows(load("events"), ["user_id"], "value").select("event_id", "user_id", "value")


_SUPPLIER_SQL = "s AS (SELECT l_returnflag, l_suppkey, sum(l_extendedprice::DECIMAL(19,4)) AS revenue FROM lineitem GROUP BY 1, 2)"
_SHARE_SQL = f"""{_SUPPLIER_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY revenue DESC, l_suppkey) AS place,
    sum(revenue) OVER (PARTITION BY l_returnflag) AS total FROM s),
    shares AS (SELECT *, (sum(revenue) OVER (PARTITION BY l_returnflag ORDER BY place))::DOUBLE / total::DOUBLE AS cumulative_share FROM r)"""
_TOP = 10


def _supplier_revenue(load):
    return load("lineitem").groupBy("l_returnflag", "l_suppkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(19,4)")).alias("revenue")
    )


@query("top_share", f"WITH {_SHARE_SQL} SELECT l_returnflag, l_suppkey, revenue::DOUBLE AS revenue, place, cumulative_share FROM shares WHERE place <= {_TOP}")
def _(load):
    found = I.top_share(_supplier_revenue(load), ["l_returnflag"], "l_suppkey", "revenue", _TOP)
    return found.withColumn("revenue", F.col("revenue").cast("double"))


@query(
    "cumulative_revenue",
    """SELECT o_orderkey, o_orderstatus, (sum(o_totalprice::DECIMAL(19,4)) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey))::DOUBLE AS upto FROM orders""",
)
def _(load):
    # Running totals in which one status may hold most of the orders.
    total = F.col("o_totalprice").cast("decimal(19,4)")
    orders = load("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    found = running_sum(orders, ["o_orderstatus"], [F.col("o_orderkey")], total, "upto")
    return found.select("o_orderkey", "o_orderstatus", F.col("upto").cast("double").alias("upto"))


@query("concentration", f"WITH {_SHARE_SQL} SELECT l_returnflag, max(cumulative_share) AS top_share, max(cumulative_share) > 0.5 AS at_risk FROM shares WHERE place <= {_TOP} GROUP BY 1")
def _(load):
    return I.concentration(_supplier_revenue(load), ["l_returnflag"], "l_suppkey", "revenue", _TOP)


# Each document opens with a line that names the matter it is about.
_OPENINGS = ("Revenue, income and profit margin", "Throughput and downtime of the plant", "Customer order quantity and discount",
             "Employee salary and headcount", "Warehouse stock and supplier lead time", "Miscellaneous")
_OPENING_SQL = "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(_OPENINGS)) + " END"
_DOMAIN_HITS = ", ".join(
    "(" + " + ".join(f"contains(x, '{w}')::INT" for w in words) + f") AS {d}" for d, words in I.DOMAIN_KEYWORDS.items()
)
_D = list(I.DOMAIN_KEYWORDS)


@query(
    "domain_scores",
    f"""WITH t AS (SELECT doc_id, lower({_OPENING_SQL} || chr(10) || text) AS x FROM documents), h AS (SELECT doc_id, {_DOMAIN_HITS} FROM t),
        b AS (SELECT *, greatest({', '.join(_D)}) AS best, {' + '.join(_D)} AS total FROM h)
        SELECT doc_id, CASE WHEN best = 0 THEN 'general' {' '.join(f"WHEN {d} = best THEN '{d}'" for d in _D)} END AS domain, best AS hits,
        CASE WHEN total = 0 THEN 0.0 ELSE best / total END AS confidence FROM b""",
)
def _(load):
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return I.domain_scores(load("documents"), "doc_id", F.concat_ws("\n", opening, "text"))


_SPANS = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


@query(
    "time_coverage",
    " UNION ALL ".join(f"SELECT '{t}' AS \"table\", min({c})::DATE::VARCHAR AS first_day, max({c})::DATE::VARCHAR AS last_day FROM {t}" for t, c in _SPANS.items()),
)
def _(load):
    return I.time_coverage({t: (load(t), c) for t, c in _SPANS.items()})


@query(
    "segment_revenue",
    """WITH k AS (SELECT o_custkey, sum(o_totalprice::DECIMAL(19,4)) AS v FROM orders GROUP BY 1), j AS (SELECT c_mktsegment, c_name, v FROM customer JOIN k ON c_custkey = o_custkey),
       r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY v DESC, c_name) AS place FROM j)
       SELECT c_mktsegment AS segment, 'all' AS member, sum(v)::DOUBLE AS revenue FROM j GROUP BY 1
       UNION ALL SELECT c_mktsegment, c_name, v::DOUBLE FROM r WHERE place <= 3""",
)
def _(load):
    # Orders shrink to one row per customer before they meet the customers.
    spent = load("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.col("o_totalprice").cast("decimal(19,4)")).alias("v"))
    named = load("customer").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment")).join(spent, "c_custkey")
    whole = named.groupBy("segment").agg(F.lit("all").alias("member"), F.sum("v").cast("double").alias("revenue"))
    best = I.top_members(named, ["segment"], "c_name", "v", 3)
    return whole.unionByName(best.select("segment", F.col("c_name").alias("member"), F.col("v").cast("double").alias("revenue")))


@query(
    "margin_analysis",
    """WITH l AS (SELECT l_partkey, sum(l_extendedprice::DECIMAL(12,2)) AS rev, sum(l_quantity::DECIMAL(12,2)) AS qty FROM lineitem GROUP BY 1),
       b AS (SELECT p_brand, sum(rev)::DOUBLE AS revenue, sum(qty * p_retailprice::DECIMAL(12,2))::DOUBLE AS expense FROM l JOIN part ON p_partkey = l_partkey GROUP BY 1)
       SELECT *, revenue - expense AS margin, (revenue - expense) / revenue AS ratio FROM b""",
)
def _(load):
    money = lambda c: F.col(c).cast("decimal(12,2)")
    sold = load("lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum(money("l_extendedprice")).alias("rev"), F.sum(money("l_quantity")).alias("qty")
    )
    brands = load("part").join(sold, "p_partkey").groupBy("p_brand").agg(
        F.sum("rev").cast("double").alias("revenue"), F.sum(F.col("qty") * money("p_retailprice")).cast("double").alias("expense")
    )
    margin = F.col("revenue") - F.col("expense")
    return brands.withColumn("margin", margin).withColumn("ratio", F.try_divide(margin, F.col("revenue")))


@query(
    "growth_series",
    f"""WITH {_CHANGE_SQL}, a AS (SELECT p, avg(v) AS overall FROM m GROUP BY 1), s AS (SELECT p, month(month) AS moy, avg(v) AS mean FROM m GROUP BY 1, 2)
        SELECT c.p, c.month::VARCHAR AS month, round(mom_percent, 6) AS mom_percent, round(yoy_percent, 6) AS yoy_percent, round(mean / overall, 6) AS season_index
        FROM c JOIN a ON a.p = c.p JOIN s ON s.p = c.p AND s.moy = month(c.month)""",
)
def _(load):
    series = _series(load)
    change = I.period_change(series, ["p"]).withColumn("moy", F.month("month"))
    joined = change.join(I.seasonality(series, ["p"]), ["p", "moy"])
    return _dated(joined.select("p", "month", *[F.round(c, 6).alias(c) for c in ("mom_percent", "yoy_percent", "season_index")]))


@query(
    "anomalies",
    f"WITH {_MONTHLY_SQL} SELECT p, month::VARCHAR AS month, v FROM (SELECT *, (v - avg(v) OVER (PARTITION BY p)) / stddev_samp(v) OVER (PARTITION BY p) AS z FROM m) WHERE abs(z) > 2",
)
def _(load):
    return _dated(outlier_rows(_series(load), ["p"], "v").drop("z"))


@query(
    "inventory_metrics",
    """WITH j AS (SELECT l_partkey, l_quantity::DECIMAL(12,2) AS ordered, greatest(l_quantity - l_linenumber % 3, 0)::DECIMAL(12,2) AS received, l_returnflag,
           l_shipdate::DATE - o_orderdate::DATE AS lead, l_shipdate::DATE AS shipped FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
       SELECT p_partkey, round(sum(ordered)::DOUBLE / p_size, 6) AS turnover, DATE '2001-12-31' - max(shipped) AS age_days, count(*) FILTER (l_returnflag = 'R') AS stockouts,
           round(sum(lead)::DOUBLE / count(*), 6) AS lead_time, (sum(ordered) - sum(received))::DOUBLE AS shortage
       FROM j JOIN part ON p_partkey = l_partkey GROUP BY p_partkey, p_size""",
)
def _(load):
    qty = F.col("l_quantity")
    lines = load("lineitem").join(load("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipped = F.col("l_shipdate").cast("date")
    per_part = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum(qty.cast("decimal(12,2)")).alias("ordered"),
        F.sum(F.greatest(qty - F.col("l_linenumber") % 3, F.lit(0.0)).cast("decimal(12,2)")).alias("received"),
        F.max(shipped).alias("last"), F.count_if(F.col("l_returnflag") == "R").alias("stockouts"),
        F.sum(F.datediff(shipped, F.col("o_orderdate").cast("date"))).alias("lead"), F.count("*").alias("n"),
    )
    return per_part.join(load("part").select("p_partkey", "p_size"), "p_partkey").select(
        "p_partkey", F.round(F.col("ordered").cast("double") / F.col("p_size"), 6).alias("turnover"),
        F.datediff(F.lit("2001-12-31").cast("date"), "last").cast("bigint").alias("age_days"), "stockouts",
        F.round(F.col("lead").cast("double") / F.col("n"), 6).alias("lead_time"),
        (F.col("ordered") - F.col("received")).cast("double").alias("shortage"),
    )


@query(
    "hr_metrics",
    """WITH d AS (SELECT ts::DATE AS day, count(*) FILTER (event_type = 'signup') AS joined, count(*) FILTER (event_type = 'error') AS left_ FROM events GROUP BY 1),
       h AS (SELECT *, sum(joined - left_) OVER (ORDER BY day)::BIGINT AS headcount FROM d),
       u AS (SELECT user_id, max(ts::DATE) - min(ts::DATE) AS days FROM events GROUP BY 1)
       SELECT day::VARCHAR AS day, joined, left_ AS departed, headcount, (SELECT round(sum(days)::DOUBLE / count(*), 6) FROM u) AS mean_tenure,
              CASE WHEN headcount + headcount - joined + left_ > 0 THEN round(2 * left_::DOUBLE / (headcount + headcount - joined + left_), 6) END AS turnover FROM h""",
)
def _(load):
    from pyspark.sql import Window

    events = load("events").withColumn("day", F.to_date("ts"))
    # One row per calendar day, so the running headcount needs no spreading.
    daily = events.groupBy("day").agg(
        F.count_if(F.col("event_type") == "signup").alias("joined"), F.count_if(F.col("event_type") == "error").alias("departed")
    )
    stay = events.groupBy("user_id").agg(F.datediff(F.max("day"), F.min("day")).alias("days"))
    mean = stay.agg(F.round(F.sum("days").cast("double") / F.count("*"), 6).alias("t")).scalar()
    upto = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        F.col("day").cast("string").alias("day"), "joined", "departed",
        F.sum(F.col("joined") - F.col("departed")).over(upto).alias("headcount"), mean.alias("mean_tenure"),
    ).withColumn("turnover", _turnover())


def _turnover():
    """Departures over the mean headcount of the day; NULL while nobody is there."""
    around = 2 * F.col("headcount") - F.col("joined") + F.col("departed")
    return F.when(around > 0, F.round(2 * F.col("departed").cast("double") / around, 6))


@query(
    "operational_metrics",
    """WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2),
       s AS (SELECT (epoch(max(hour)) - epoch(min(hour))) / 3600 + 1 AS hours FROM h)
       SELECT event_type, sum(n)::BIGINT AS events, round(sum(n)::DOUBLE / count(*), 6) AS per_busy_hour,
              round(count(*) / any_value(hours), 6)::DOUBLE AS utilisation, max(n) AS peak FROM h, s GROUP BY 1""",
)
def _(load):
    hourly = load("events").groupBy("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).agg(F.count("*").alias("n"))
    # The period is what the table covers, in whole hours.
    hours = hourly.agg(((F.max("hour").cast("long") - F.min("hour").cast("long")) / 3600 + 1).alias("h")).scalar()
    return hourly.groupBy("event_type").agg(
        F.sum("n").alias("events"), F.round(F.sum("n").cast("double") / F.count("*"), 6).alias("per_busy_hour"),
        F.round(F.count("*") / F.first(hours), 6).alias("utilisation"), F.max("n").alias("peak"),
    )


@query(
    "period_compare",
    """WITH t AS (SELECT o_orderstatus, coalesce(sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderdate::DATE BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'), 0)::DOUBLE AS period_a,
           coalesce(sum(o_totalprice::DECIMAL(19,4)) FILTER (o_orderdate::DATE BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'), 0)::DOUBLE AS period_b
         FROM orders GROUP BY 1) SELECT *, period_b - period_a AS delta, (period_b - period_a) / period_a * 100 AS percent FROM t""",
)
def _(load):
    total = F.col("o_totalprice").cast("decimal(19,4)")
    return I.period_compare(load("orders"), ["o_orderstatus"], "o_orderdate", total, ("1998-01-01", "1998-12-31"), ("1999-01-01", "1999-12-31"))


_ONE = "round({}, 1)::DECIMAL(38,1)::VARCHAR"
_MONEY = "round({}, 2)::DECIMAL(38,2)::VARCHAR"
_FIGURE = "rtrim(rtrim(round({}, 4)::DECIMAL(38,4)::VARCHAR, '0'), '.')"
_INSIGHTS_SQL = f"""{_CHANGE_SQL}, {_TURN_SQL}, {_SHARE_SQL},
  z AS (SELECT * FROM (SELECT *, (v - avg(v) OVER (PARTITION BY p)) / stddev_samp(v) OVER (PARTITION BY p) AS z FROM m) WHERE abs(z) > 2),
  sh AS (SELECT 'flag ' || l_returnflag AS p, max(cumulative_share) AS top_share FROM shares WHERE place <= {_TOP} GROUP BY 1),
  i AS (
    SELECT 'variance/' || p || '/' || month AS id, p AS report, 'Revenue of ' || p || ' changed ' || {_ONE.format('mom_percent')} || '% in ' || month AS headline, 'revenue' AS metric, v AS value,
      mom_percent AS delta_percent, CASE WHEN abs(mom_percent) > 25 THEN 'warning' ELSE 'info' END AS severity, abs(mom_percent) > 10 AS included, 'Check what drove the change.' AS implication,
      'From ' || {_MONEY.format('v - mom_delta')} || ' to ' || {_MONEY.format('v')} || ' in one month.' AS detail, mom_delta AS delta, 'line' AS hint
      FROM c WHERE mom_percent IS NOT NULL
    UNION ALL SELECT 'reversal/' || p || '/' || month, p, 'Trend of ' || p || ' turned ' || CASE WHEN d > 0 THEN 'up' ELSE 'down' END || ' in ' || month, 'revenue', v, NULL, 'info', true,
      'Watch whether the new direction holds.', 'Revenue reached ' || {_MONEY.format('v')} || '.', NULL, 'line' FROM turns
    UNION ALL SELECT 'anomaly/' || p || '/' || month, p, 'Unusual revenue of ' || p || ' in ' || month, 'revenue', v, NULL, CASE WHEN abs(z) > 3 THEN 'critical' ELSE 'warning' END, true,
      'Confirm the figures for this month.', 'Revenue was ' || {_MONEY.format('v')} || '.', NULL, 'bar' FROM z
    UNION ALL SELECT 'share/' || p, p, 'Top suppliers hold ' || {_ONE.format('top_share * 100')} || '% of ' || p, 'top_share', top_share, NULL, 'warning', top_share > 0.5, 'Losing one of them would hurt.',
      'Share of the top members: ' || {_ONE.format('top_share * 100')} || '%.', NULL, 'pie' FROM sh),
  q AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, abs(coalesce(delta_percent, 0.0)) DESC, id) AS place FROM i WHERE included)
"""


def _insights(load):
    shares = I.concentration(_supplier_revenue(load), ["l_returnflag"], "l_suppkey", "revenue", _TOP)
    named = shares.select(F.concat(F.lit("flag "), "l_returnflag").alias("p"), "top_share", "at_risk")
    series = load.shared("monthly_revenue", lambda: _series(load))
    return I.series_insights(series, "p").unionByName(I.share_insights(named, "p", "suppliers"))


def _flat(df, *extra):
    return df.select("id", "report", "headline", "evidence.metric", "evidence.value", "evidence.delta_percent", "severity", *extra)


@query("insight_table", f"""WITH {_INSIGHTS_SQL} SELECT id, report, 'sales' AS domain, headline, detail, metric, value, delta, delta_percent, implication,
       severity, hint AS visualization_hint, included FROM i""")
def _(load):
    return _flat(_insights(load), "domain", "detail", "evidence.delta", "implication", "visualization_hint", "included")


@query("included_only", f"WITH {_INSIGHTS_SQL} SELECT id, severity FROM i WHERE included")
def _(load):
    return I.included_only(_insights(load)).select("id", "severity")


@query("qualify_insights", f"WITH {_INSIGHTS_SQL} SELECT id, report, headline, metric, value, delta_percent, severity, place FROM q WHERE place <= 10")
def _(load):
    return _flat(I.qualify_insights(_insights(load)), "place")


@query("top_insights", f"WITH {_INSIGHTS_SQL} SELECT report, place, headline FROM q WHERE place <= 5")
def _(load):
    return I.qualify_insights(_insights(load), keep=5).select("report", "place", "headline")


@query(
    "report_lines",
    f"""WITH {_INSIGHTS_SQL}, k AS (SELECT * FROM q WHERE place <= 10), rep AS (SELECT DISTINCT report FROM k),
        parts AS (
          SELECT report, 0 AS part, 0 AS place, n, line FROM rep, (VALUES (0, 'Analysis Report'), (1, 'Domain: sales'), (2, ''), (3, repeat('=', 50)), (4, 'EXECUTIVE SUMMARY'), (5, repeat('=', 50)), (6, '')) t(n, line)
          UNION ALL SELECT report, 1, place, n, CASE n WHEN 0 THEN place || '. ' || headline WHEN 1 THEN '   ' || detail WHEN 2 THEN '   Implication: ' || implication ELSE '' END FROM k, (VALUES (0), (1), (2), (3)) t(n) WHERE place <= 5
          UNION ALL SELECT report, 2, 0, n, line FROM rep, (VALUES (0, repeat('=', 50)), (1, 'DETAILED INSIGHTS'), (2, repeat('=', 50)), (3, '')) t(n, line)
          UNION ALL SELECT report, 3, place, n, CASE n WHEN 0 THEN '• ' || headline WHEN 1 THEN '  ' || detail WHEN 2 THEN '  Evidence: ' || metric || ' = ' || {_FIGURE.format('value')}
              WHEN 3 THEN '  Change: ' || {_ONE.format('delta_percent')} || '%' WHEN 4 THEN '  Implication: ' || implication ELSE '' END FROM k, (VALUES (0), (1), (2), (3), (4), (5)) t(n)
              WHERE n <> 3 OR delta_percent IS NOT NULL)
        SELECT report, row_number() OVER (PARTITION BY report ORDER BY part, place, n) AS line_no, line FROM parts""",
)
def _(load):
    kept = I.qualify_insights(_insights(load)).select(
        "report", "domain", "place", "headline", "detail", "evidence.metric", "evidence.value", "evidence.delta_percent", "implication"
    )
    return report_lines(kept)
