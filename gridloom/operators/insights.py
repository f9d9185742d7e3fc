"""Trends, shares, anomalies and the insights drawn from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.profile import group_deviation


def monthly(df: DataFrame, by: list[str], day: str, value: Column) -> DataFrame:
    """Sum per group and month. Everything after this works on a few rows per group."""
    return df.groupBy(*by, F.trunc(F.col(day).cast("date"), "month").alias("month")).agg(
        F.sum(value).cast("double").alias("v")
    )


def period_change(series: DataFrame, by: list[str]) -> DataFrame:
    """Change against the month before and the same month a year before; gaps give NULL."""
    out = series
    for name, months in (("mom", 1), ("yoy", 12)):
        then = series.select(*by, F.add_months("month", months).alias("month"), F.col("v").alias("_then"))
        delta = F.col("v") - F.col("_then")
        out = (
            out.join(then, [*by, "month"], "left")
            .withColumn(f"{name}_delta", delta)
            .withColumn(f"{name}_percent", F.try_divide(delta, F.col("_then")) * 100)
            .drop("_then")
        )
    return out


def trend_reversal(series: DataFrame, by: list[str]) -> DataFrame:
    """Months in which the direction of change flips; one row per month and group at most."""
    w = Window.partitionBy(*by).orderBy("month")
    signed = series.withColumn("direction", F.signum(F.col("v") - F.lag("v").over(w)))
    flipped = signed.withColumn("_was", F.lag("direction").over(w))
    return flipped.filter(F.col("direction") * F.col("_was") < 0).drop("_was")


def seasonality(series: DataFrame, by: list[str]) -> DataFrame:
    """Mean of each month of the year relative to the mean of all months."""
    overall = series.groupBy(*by).agg(F.avg("v").alias("_all"))
    per_month = series.groupBy(*by, F.month("month").alias("moy")).agg(F.avg("v").alias("_mean"))
    return per_month.join(overall, by).select(*by, "moy", F.try_divide("_mean", "_all").alias("season_index"))


# Fixed value: share of the top members above which a total is at risk.
CONCENTRATION_SHARE = 0.5


def top_members(df: DataFrame, group: list[str], member: str, value: str, n: int) -> DataFrame:
    """The ``n`` largest members of each group; cut in every partition before the shuffle."""
    w = Window.partitionBy(*group).orderBy(F.desc(value), F.col(member))
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def top_share(df: DataFrame, group: list[str], member: str, value: str, n: int) -> DataFrame:
    """Top members with their cumulative share of the whole group."""
    totals = df.groupBy(*group).agg(F.sum(value).alias("_total"))
    upto = Window.partitionBy(*group).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        top_members(df, group, member, value, n)
        .withColumn("_upto", F.sum(value).over(upto))
        .join(totals, group)
        .withColumn("cumulative_share", F.try_divide(F.col("_upto").cast("double"), F.col("_total").cast("double")))
        .drop("_upto", "_total")
    )


def concentration(df: DataFrame, group: list[str], member: str, value: str, n: int) -> DataFrame:
    """Share held by the top ``n`` of each group, and whether that is a risk."""
    shares = top_share(df, group, member, value, n).groupBy(*group).agg(F.max("cumulative_share").alias("top_share"))
    return shares.withColumn("at_risk", F.col("top_share") > CONCENTRATION_SHARE)


def period_compare(df: DataFrame, by: list[str], day: str, value: Column, a: tuple[str, str], b: tuple[str, str]) -> DataFrame:
    """Sums of two date ranges (ends included) side by side, in one pass."""
    on = F.col(day).cast("date")
    inside = lambda r: on.between(F.lit(r[0]).cast("date"), F.lit(r[1]).cast("date"))
    first, second = inside(a), inside(b)
    sums = df.filter(first | second).groupBy(*by).agg(
        F.coalesce(F.sum(F.when(first, value)), F.lit(0)).cast("double").alias("period_a"),
        F.coalesce(F.sum(F.when(second, value)), F.lit(0)).cast("double").alias("period_b"),
    )
    delta = F.col("period_b") - F.col("period_a")
    return sums.withColumn("delta", delta).withColumn("percent", F.try_divide(delta, F.col("period_a")) * 100)


# Words that point at a domain, in order of preference.
DOMAIN_KEYWORDS: dict[str, tuple[str, ...]] = {
    "financial": (
        "revenue", "income", "expense", "balance", "p&l", "profit", "loss", "assets", "liabilities", "equity", "ebitda",
        "margin", "cash flow", "accounts receivable", "accounts payable", "depreciation",
    ),
    "operational": (
        "production", "output", "throughput", "efficiency", "capacity", "downtime", "yield", "scrap", "cycle time", "utilization",
    ),
    "sales": (
        "customer", "order", "quantity", "discount", "region", "territory", "pipeline", "conversion", "churn", "retention", "quota",
    ),
    "hr": (
        "employee", "salary", "headcount", "payroll", "hire date", "termination", "department", "title", "compensation",
        "benefits", "tenure",
    ),
    "inventory": (
        "stock", "warehouse", "reorder", "lead time", "supplier", "sku", "on hand", "committed", "available", "backorder",
    ),
}


def domain_scores(df: DataFrame, key: str, text: Column) -> DataFrame:
    """Best domain of each text with its keyword hits and their share; ``general`` without hits."""
    lowered = F.lower(text)
    hits = {
        d: sum((F.contains(lowered, F.lit(w)).cast("int") for w in words), F.lit(0)) for d, words in DOMAIN_KEYWORDS.items()
    }
    counted = df.select(key, *[h.alias(d) for d, h in hits.items()])
    best = F.greatest(*DOMAIN_KEYWORDS)
    total = sum((F.col(d) for d in DOMAIN_KEYWORDS), F.lit(0))
    winner = F.coalesce(*[F.when((F.col(d) == best) & (best > 0), d) for d in DOMAIN_KEYWORDS], F.lit("general"))
    return counted.select(
        key, winner.alias("domain"), best.alias("hits"), F.coalesce(F.try_divide(best, total), F.lit(0.0)).alias("confidence")
    )


def time_coverage(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """First and last day of each table."""
    spans = [
        df.agg(F.min(day).cast("date").cast("string").alias("first_day"), F.max(day).cast("date").cast("string").alias("last_day"))
        .select(F.lit(name).alias("table"), "first_day", "last_day")
        for name, (df, day) in tables.items()
    ]
    return reduce(DataFrame.unionByName, spans)


# What makes an insight worth keeping, and how many are kept.
VARIANCE_PERCENT = 10.0
STRONG_PERCENT = 25.0
MAX_INSIGHTS = 10
HEADLINE_CHARS, DETAIL_CHARS = 100, 300
SEVERITIES = ("critical", "warning", "info")


def one_decimal(value: Column) -> Column:
    return F.round(value, 1).cast("decimal(38,1)").cast("string")


def money(value: Column) -> Column:
    return F.round(value, 2).cast("decimal(38,2)").cast("string")


def insight(
    df: DataFrame, id_: Column, report: Column, domain: str, headline: Column, detail: Column, metric: str, value: Column,
    implication: str, severity: Column, hint: str, included: Column, delta: Column | None = None, percent: Column | None = None,
) -> DataFrame:
    """Rows of ``df`` as insight candidates of one schema; numeric evidence is a struct."""
    none = F.lit(None).cast("double")
    return df.select(
        id_.alias("id"), report.alias("report"), F.lit(domain).alias("domain"),
        F.substring(headline, 1, HEADLINE_CHARS).alias("headline"), F.substring(detail, 1, DETAIL_CHARS).alias("detail"),
        F.struct(
            F.lit(metric).alias("metric"), value.cast("double").alias("value"),
            (none if delta is None else delta).alias("delta"), (none if percent is None else percent).alias("delta_percent"),
        ).alias("evidence"),
        F.lit(implication).alias("implication"), severity.alias("severity"), F.lit(hint).alias("visualization_hint"),
        included.alias("included"),
    )


def series_insights(series: DataFrame, label: str, domain: str = "sales") -> DataFrame:
    """Variance, reversal and anomaly candidates of a monthly series per ``label``."""
    who, when = F.col(label), F.col("month").cast("string")
    change = period_change(series, [label]).filter("mom_percent IS NOT NULL")
    percent = F.col("mom_percent")
    variance = insight(
        change, F.concat_ws("/", F.lit("variance"), who, when), who, domain,
        F.concat(F.lit("Revenue of "), who, F.lit(" changed "), one_decimal(percent), F.lit("% in "), when),
        F.concat(F.lit("From "), money(F.col("v") - F.col("mom_delta")), F.lit(" to "), money(F.col("v")), F.lit(" in one month.")),
        "revenue", F.col("v"), "Check what drove the change.",
        F.when(F.abs(percent) > STRONG_PERCENT, "warning").otherwise("info"), "line",
        F.abs(percent) > VARIANCE_PERCENT, F.col("mom_delta"), percent,
    )
    turns = trend_reversal(series, [label])
    reversal = insight(
        turns, F.concat_ws("/", F.lit("reversal"), who, when), who, domain,
        F.concat(F.lit("Trend of "), who, F.lit(" turned "), F.when(F.col("direction") > 0, "up").otherwise("down"), F.lit(" in "), when),
        F.concat(F.lit("Revenue reached "), money(F.col("v")), F.lit(".")),
        "revenue", F.col("v"), "Watch whether the new direction holds.", F.lit("info"), "line", F.lit(True),
    )
    odd = group_deviation(series, [label], "v").filter(F.abs("z") > 2)
    anomaly = insight(
        odd, F.concat_ws("/", F.lit("anomaly"), who, when), who, domain,
        F.concat(F.lit("Unusual revenue of "), who, F.lit(" in "), when),
        F.concat(F.lit("Revenue was "), money(F.col("v")), F.lit(".")),
        "revenue", F.col("v"), "Confirm the figures for this month.", F.when(F.abs("z") > 3, "critical").otherwise("warning"),
        "bar", F.lit(True),
    )
    return reduce(DataFrame.unionByName, [variance, reversal, anomaly])


def share_insights(shares: DataFrame, label: str, what: str, domain: str = "sales") -> DataFrame:
    who, share = F.col(label), F.col("top_share")
    return insight(
        shares, F.concat_ws("/", F.lit("share"), who), who, domain,
        F.concat(F.lit(f"Top {what} hold "), one_decimal(share * 100), F.lit("% of "), who),
        F.concat(F.lit("Share of the top members: "), one_decimal(share * 100), F.lit("%.")),
        "top_share", share, "Losing one of them would hurt.", F.lit("warning"), "pie", F.col("at_risk"),
    )


def included_only(insights: DataFrame) -> DataFrame:
    return insights.filter("included")


def qualify_insights(insights: DataFrame, keep: int = MAX_INSIGHTS) -> DataFrame:
    """The strongest included insights of each report: by severity, size of change, then id."""
    rank = F.coalesce(*[F.when(F.col("severity") == s, i) for i, s in enumerate(SEVERITIES)])
    size = F.abs(F.coalesce("evidence.delta_percent", F.lit(0.0)))
    w = Window.partitionBy("report").orderBy(rank, size.desc(), "id")
    return included_only(insights).withColumn("place", F.row_number().over(w)).filter(F.col("place") <= keep)
