"""Dates: serial numbers, parts, differences, business days, buckets and presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SERIAL_BASE = "1899-12-30"

# Layouts a timestamp may have, each with the shape of text it is tried on.
TIMESTAMP_LAYOUTS = {
    "yyyy-MM-dd'T'HH:mm:ssXXX": r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(Z|[+-]\d\d:\d\d)$",
    "yyyy-MM-dd'T'HH:mm:ss": r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$",
    "yyyy-MM-dd": r"^\d{4}-\d\d-\d\d$",
    "dd/MM/yyyy HH:mm:ss": r"^\d\d/\d\d/\d{4} \d\d:\d\d:\d\d$",
    "dd/MM/yyyy": r"^\d\d/\d\d/\d{4}$",
    "dd-MM-yyyy": r"^\d\d-\d\d-\d{4}$",
    "yyyyMMdd": r"^(19|20)\d{6}$",
    "MMM d, yyyy": r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$",
}


def to_timestamp_coerce(text: Column, layouts: dict[str, str] = TIMESTAMP_LAYOUTS) -> Column:
    """Text in a known layout as a timestamp; NULL for anything else.

    The shape is tested first: a failed parse costs far more than a failed match.
    """
    value = F.trim(text)
    parsed = F.when(value.isNull(), F.lit(None).cast("timestamp"))
    if layouts is TIMESTAMP_LAYOUTS:
        # Every one of these layouts has a separator or eight characters: one cheap look rules most values out.
        marks = [F.contains(value, F.lit(m)) for m in ("-", "/", ",")]
        parsed = parsed.when(
            ~((F.length(value) == 8) | marks[0] | marks[1] | marks[2]) | (F.length(value) > 25), F.lit(None).cast("timestamp")
        )
    for layout, shape in layouts.items():
        parsed = parsed.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(layout)))
    return parsed


def excel_serial(day: Column) -> Column:
    """Days since the spreadsheet epoch (true serials, valid from 1900-03-01)."""
    return F.datediff(day, F.lit(SERIAL_BASE).cast("date"))


def today_serial(clock: Column) -> Column:
    """Serial of the day of ``clock``, which stands for the current time so that results repeat."""
    return excel_serial(F.to_date(clock))


def now_serial(clock: Column) -> Column:
    """Serial of ``clock`` with the time as a fraction of the day."""
    seconds = F.hour(clock) * 3600 + F.minute(clock) * 60 + F.second(clock)
    return today_serial(clock) + seconds / F.lit(86400.0)


def from_serial(serial: Column) -> Column:
    return F.date_add(F.lit(SERIAL_BASE).cast("date"), F.floor(serial).cast("int"))


def date_build(year: Column, month: Column, day: Column) -> Column:
    """Serial of (year, month, day); month is clamped to 1..12 and day to at least 1."""
    m = F.least(F.greatest(month, F.lit(1)), F.lit(12))
    d = F.greatest(day, F.lit(1))
    built = F.try_to_date(F.format_string("%04d-%02d-%02d", year, m, d), "yyyy-MM-dd")
    return excel_serial(built)


def date_of(text: Column) -> Column:
    """ISO text or a serial number as a date; anything else is 1900-01-01."""
    value = F.trim(text)
    from_iso = F.try_to_date(F.substring_index(value, "T", 1), "yyyy-MM-dd")
    from_number = F.when(
        value.rlike(r"^[0-9]{1,7}(\.[0-9]+)?$"), from_serial(value.try_cast("double"))
    )
    return F.coalesce(from_iso, from_number, F.lit("1900-01-01").cast("date"))


def _complete_months(start: Column, end: Column) -> Column:
    months = (F.year(end) - F.year(start)) * 12 + F.month(end) - F.month(start)
    return months - F.when(F.dayofmonth(end) < F.dayofmonth(start), 1).otherwise(0)


def date_dif(start: Column, end: Column, unit: str) -> Column:
    """Difference in ``D``, ``M``, ``Y``, ``MD``, ``YM`` or ``YD``, counting complete periods."""
    months = _complete_months(start, end)
    years = F.floor(months / 12).cast("int")
    return {
        "D": F.datediff(end, start),
        "M": months,
        "Y": years,
        "MD": F.datediff(end, F.add_months(start, months)),
        "YM": months - years * 12,
        "YD": F.datediff(end, F.add_months(start, years * 12)),
    }[unit.upper()]


def end_of_month(day: Column, months: Column | int) -> Column:
    return F.last_day(F.add_months(day, months))


def business_calendar(
    spark: SparkSession, first: str, last: str, holidays: tuple[str, ...] = ()
) -> DataFrame:
    """One row per day with a running count of business days.

    The size is fixed by the two dates (366 rows a year), so joins may broadcast it.
    """
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("day")
    )
    working = F.weekday("day") < 5
    if holidays:
        working = working & ~F.col("day").isin(*[F.lit(h).cast("date") for h in holidays])
    return days.select("day", working.cast("int").alias("works")).withColumn(
        "idx",
        F.sum("works").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)),
    )


def workday_add(
    df: DataFrame, day: str, offset: Column, calendar: DataFrame, out: str = "workday", outside: str = "error"
) -> DataFrame:
    """Add ``offset`` business days to ``day`` using a calendar from :func:`business_calendar`.

    A day or a result outside the calendar stops the job, or gives NULL with ``outside="null"``.
    """
    here = calendar.select(
        F.col("day").alias(day), F.col("works").alias("_works"), F.col("idx").alias("_idx")
    )
    there = calendar.filter("works = 1").select(
        F.col("idx").alias("_target"), F.col("day").alias("_found")
    )
    target = F.when(offset > 0, F.col("_idx") + offset).otherwise(
        F.col("_idx") - F.col("_works") + offset + 1
    )
    found = F.col("_found")
    if outside == "error":
        missing = F.col(day).isNotNull() & offset.isNotNull()
        told = F.concat(F.lit("outside the business calendar: "), F.col(day).cast("string"), F.lit(" "), offset.cast("string"))
        found = F.coalesce(found, F.when(missing, F.raise_error(told).cast("date")))
    return (
        df.join(F.broadcast(here), day, "left")
        .withColumn("_target", target)
        .join(F.broadcast(there), "_target", "left")
        .withColumn(out, F.when(offset == 0, F.col(day)).otherwise(found))
        .drop("_works", "_idx", "_target", "_found")
    )


# Bucket names and the units they truncate to.
GRANULARITIES = {"daily": "day", "weekly": "week", "monthly": "month", "yearly": "year"}


def time_bucket(day: Column, granularity: str) -> Column:
    return F.trunc(day, GRANULARITIES[granularity]) if granularity != "daily" else day.cast("date")


def period_preset(day: Column, preset: str, as_of: str) -> Column:
    """Is ``day`` inside the named period that ends on ``as_of``?"""
    end = F.lit(as_of).cast("date")
    start = {
        "last7": F.date_sub(end, 6),
        "last30": F.date_sub(end, 29),
        "mtd": F.trunc(end, "month"),
        "ytd": F.trunc(end, "year"),
        "last12": F.date_add(F.add_months(end, -12), 1),
        "last24": F.date_add(F.add_months(end, -24), 1),
    }[preset]
    return day.cast("date").between(start, end)
