"""Column profiles, keys, types, schema design and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.dates import to_timestamp_coerce
from gridloom.functions.numbers import to_bigint, to_boolean, to_decimal
from gridloom.functions.text import null_if_blank, snake_name
from gridloom.operators.keys import minimal_keys
from gridloom.operators.quantiles import exact_quantiles, finite
from gridloom.session import cut_lineage, per_key


def describe_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles of the finite values; one row per column.

    ``not_finite`` counts the NaN and infinite values, which no other figure includes.
    """
    quartiles = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("column"), F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v.cast("double")).alias("min"), F.max(v.cast("double")).alias("max"),
            (F.count(c) - F.count(v)).alias("not_finite"),
        ).alias(c)
        for c, v in ((c, F.when(finite(F.col(c)), F.col(c))) for c in columns)
    ])
    points = df.sparkSession.createDataFrame(
        [(c, *[quartiles.get((c, p)) for p in (0.25, 0.5, 0.75)]) for c in columns],
        "column string, q25 double, q50 double, q75 double",
    )
    rows = stats.select(F.explode(F.array(*columns)).alias("s")).select("s.*")
    return rows.join(F.broadcast(points), "column")


def table_shapes(tables: dict[str, DataFrame]) -> DataFrame:
    shapes = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows", F.lit(len(df.columns)).alias("cols"))
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, shapes)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, n)`` with values as text; equal values merge before the shuffle."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


SAMPLES = 5


def column_profile(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """Rows, nulls, distinct values, longest text and the five smallest values of each column.

    ``counts`` are the :func:`value_counts` of the same columns, where the caller has written them already.
    """
    if counts is None:
        counts = cut_lineage(value_counts(df, columns), "value-counts")
    present = F.col("value").isNotNull()
    stats = counts.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(~present, F.col("n")).otherwise(0)).alias("nulls"),
        F.count_if(present).alias("distinct_values"),
        F.max(F.length("value")).alias("longest"),
    )
    smallest = Window.partitionBy("column").orderBy("value")
    samples = (
        counts.filter(present).withColumn("k", F.row_number().over(smallest)).filter(F.col("k") <= SAMPLES)
        .groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("samples"))
    )
    return stats.join(samples, "column", "left")


def key_candidates(df: DataFrame, columns: list[str], pairs: bool = False) -> DataFrame:
    """Columns, and optionally pairs of other columns, whose values are all present and distinct."""
    if pairs:
        return minimal_keys(df, columns, 2).select(F.col("key").alias("column"))
    return column_profile(df, columns).filter("nulls = 0 AND distinct_values = rows").select("column")


#: Of a distinct-count sketch: 2 ** 14 registers, 16 kB at most.
SKETCH_BITS = 14
#: Relative standard error that goes with it.
SKETCH_ERROR = 1.04 / 2 ** (SKETCH_BITS / 2)


def sketch_profile(df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """A mergeable profile per ``by`` (such as the file) and column: rows, nulls, longest text, and a sketch of the values.

    Values count as text, as in :func:`column_profile`. Each part is one small row a column, so it can be kept
    beside the file and merged later without reading the file again.
    """
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    long = df.select(F.col(by).alias("part"), F.explode(F.array(*pairs)).alias("p")).select("part", "p.column", "p.value")
    return long.groupBy("part", "column").agg(
        F.count("*").alias("rows"), F.count_if(F.col("value").isNull()).alias("nulls"), F.max(F.length("value")).alias("longest"),
        F.hll_sketch_agg("value", F.lit(SKETCH_BITS)).alias("sketch"),
    )


def add_to_profile(path: str, df: DataFrame, columns: list[str], by: str) -> DataFrame:
    """Sketch the parts of ``df`` that the profile kept at ``path`` does not hold yet, append them, and return it.

    A part that is there already is not read: parts are compared first, values only of new ones.
    """
    spark = df.sparkSession
    fresh = df
    # The profile may not exist yet.
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(path).select(F.col("part").alias(by)).distinct()
        fresh = df.join(per_key(known), by, "left_anti")
    sketch_profile(fresh, columns, by).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def merged_profile(sketches: DataFrame) -> DataFrame:
    """One row per column from any number of parts, in any order; ``distinct_values`` is an estimate.

    Its relative standard error is ``SKETCH_ERROR``, whatever the number of parts; all else is exact.
    """
    merged = sketches.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("nulls").alias("nulls"), F.max("longest").alias("longest"),
        F.hll_union_agg("sketch").alias("s"),
    )
    return merged.select("column", "rows", "nulls", F.hll_sketch_estimate("s").alias("distinct_values"), "longest")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that occur more than once, with how often."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("copies")).filter("copies > 1")


def fk_candidates(columns: dict[str, DataFrame]) -> DataFrame:
    """Share of each column's distinct values that another column also holds.

    ``columns`` maps a name to a one-column table. A value gathers only the set of column names that
    hold it, which is bounded by the number of columns.
    """
    tagged = reduce(DataFrame.unionByName, [
        df.select(F.lit(name).alias("column"), F.col(df.columns[0]).cast("string").alias("value")).filter("value IS NOT NULL").distinct()
        for name, df in columns.items()
    ])
    holders = tagged.groupBy("value").agg(F.collect_set("column").alias("cols")).groupBy("cols").agg(F.count("*").alias("n"))
    both = holders.select(F.explode("cols").alias("child"), "cols", "n").select("child", F.explode("cols").alias("parent"), "n")
    sizes = tagged.groupBy(F.col("column").alias("child")).agg(F.count("*").alias("total"))
    return (
        both.filter("child <> parent").groupBy("child", "parent").agg(F.sum("n").alias("matched"))
        .join(sizes, "child").withColumn("ratio", F.col("matched") / F.col("total"))
    )


def conformance(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    """How many values of each text column read as each type: one row per column.

    Equal values are tested once, in long form, so that the tests compile once and not once per column. ``counts`` are
    the :func:`value_counts` of the same columns, where the caller has them already.
    """
    text = F.col("text")
    number = r"[0-9.,]+"
    tally = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    known = value_counts(df, columns) if counts is None else counts
    return (
        known.select("column", null_if_blank(F.col("value")).alias("text"), "n")
        .groupBy("column")
        .agg(
            tally(text.isNotNull()).alias("filled"),
            tally(to_bigint(text).isNotNull()).alias("ints"),
            tally(to_decimal(text).isNotNull()).alias("numbers"),
            tally(to_timestamp_coerce(text).isNotNull()).alias("moments"),
            tally(to_boolean(text).isNotNull()).alias("flags"),
            tally(text.rlike(rf"^-?[$€£¥]\s?{number}$|^-?{number}\s?[$€£¥]$")).alias("money"),
            tally(text.rlike(rf"^-?{number}\s?%$")).alias("percents"),
            tally(text.rlike(r"[0-9]:[0-9]{2}")).alias("timed"),
            F.max(F.length(text)).alias("longest"),
        )
    )


def storage_type() -> Column:
    """Most specific storage type that every filled value fits."""
    filled = F.col("filled")
    return (
        F.when(filled == 0, "VARCHAR(255)")
        .when(F.col("ints") == filled, "BIGINT")
        .when(F.col("numbers") == filled, "NUMERIC(19,4)")
        .when(F.col("moments") == filled, "TIMESTAMP")
        .when(F.col("flags") == filled, "BOOLEAN")
        .when(F.col("longest") <= 255, "VARCHAR(255)")
        .otherwise("TEXT")
    )


def logical_type() -> Column:
    filled = F.col("filled")
    return (
        F.when(filled == 0, "string")
        .when(F.col("ints") == filled, "integer")
        .when(F.col("numbers") == filled, "decimal")
        .when(F.col("percents") == filled, "percentage")
        .when(F.col("money") == filled, "currency")
        .when((F.col("moments") == filled) & (F.col("timed") > 0), "datetime")
        .when(F.col("moments") == filled, "date")
        .when(F.col("flags") == filled, "boolean")
        .otherwise("string")
    )


def infer_types(df: DataFrame, columns: list[str], counts: DataFrame | None = None) -> DataFrame:
    return conformance(df, columns, counts).select("column", storage_type().alias("pg_type"), logical_type().alias("logical"))


def semantic_roles(profile: DataFrame, types: DataFrame) -> DataFrame:
    """identifier, measure, dimension, metadata or unknown, from distinctness, type and name."""
    joined = profile.join(types, "column")
    filled = F.col("rows") - F.col("nulls")
    named_id = F.lower("column").rlike(r"(^id$|_id$|key$|^sku$|code$|num$)")
    role = (
        F.when(filled == 0, "unknown")
        .when(named_id | ((F.col("distinct_values") == filled) & F.col("logical").isin("integer", "string") & (F.col("longest") <= 64)), "identifier")
        .when(F.col("logical").isin("decimal", "currency", "percentage", "integer"), "measure")
        .when(F.col("logical").isin("date", "datetime", "boolean"), "dimension")
        .when(F.col("longest") > 255, "metadata")
        .otherwise("dimension")
    )
    return joined.select("column", role.alias("role"))


def design_schema(df: DataFrame, columns: list[str]) -> DataFrame:
    """Column definitions: name, type, nullability and whether the column can be the key."""
    blank = df.select(*[null_if_blank(F.col(c)).alias(c) for c in columns])
    profile = column_profile(blank, columns)
    types = conformance(df, columns).select("column", storage_type().alias("pg_type"))
    return profile.join(types, "column").select(
        "column", snake_name(F.col("column")).alias("name"), "pg_type", (F.col("nulls") > 0).alias("nullable"),
        ((F.col("nulls") == 0) & (F.col("distinct_values") == F.col("rows"))).alias("is_key"),
    )


def cast_to(text: Column, pg_type: str) -> Column:
    return {
        "BIGINT": to_bigint, "NUMERIC(19,4)": to_decimal, "TIMESTAMP": to_timestamp_coerce, "BOOLEAN": to_boolean,
    }.get(pg_type, lambda c: c)(null_if_blank(text))


def transform_columns(df: DataFrame, design: DataFrame) -> DataFrame:
    """Rename and cast every column to its design; the design has one row per column."""
    wanted = {r["column"]: r for r in design.collect()}
    return df.select(*[cast_to(F.col(c), wanted[c]["pg_type"]).alias(wanted[c]["name"]) for c in df.columns])


def table_from_paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One ``content`` row per non-blank line; a text without any stays one row."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(x)), lambda x: x != "")
    return docs.select(key, F.explode(F.when(F.size(lines) > 0, lines).otherwise(F.array(F.col(text)))).alias("content"))


def issue(df: DataFrame, row: str, column: str, value: Column, kind: str, message: Column) -> DataFrame:
    return df.select(
        F.col(row).alias("row_number"), F.lit(column).alias("column"), value.cast("string").alias("value"),
        F.lit(kind).alias("issue_type"), message.alias("message"),
    )


def null_violations(df: DataFrame, row: str, required: list[str]) -> DataFrame:
    """One issue per missing value in a required column; a single pass over the rows."""
    missing = F.filter(F.array(*[F.when(null_if_blank(F.col(c).cast("string")).isNull(), F.lit(c)) for c in required]), lambda x: x.isNotNull())
    return df.select(F.col(row).alias("row_number"), F.explode(missing).alias("column")).select(
        "row_number", "column", F.lit(None).cast("string").alias("value"), F.lit("null_violation").alias("issue_type"),
        F.lit("Null value in non-nullable column").alias("message"),
    )


def type_mismatches(df: DataFrame, row: str, types: dict[str, str]) -> DataFrame:
    """One issue per value that is present but does not read as its type."""
    bad = [
        F.when(null_if_blank(F.col(c)).isNotNull() & cast_to(F.col(c), t).isNull(),
               F.struct(F.lit(c).alias("column"), F.col(c).alias("value"), F.lit(f"Not a {t}").alias("message")))
        for c, t in types.items()
    ]
    hits = F.filter(F.array(*bad), lambda x: x.isNotNull())
    return df.select(F.col(row).alias("row_number"), F.explode(hits).alias("h")).select(
        "row_number", "h.column", "h.value", F.lit("type_mismatch").alias("issue_type"), "h.message"
    )


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys seen more than once with their counts; counting combines before the shuffle."""
    return df.groupBy(*key).agg(F.count("*").alias("seen")).filter("seen > 1")


def orphan_rows(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is present but has no parent."""
    keyed = child.filter(F.col(child_key).isNotNull())
    return keyed.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def group_deviation(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Add each row's distance from its group's mean in sample deviations.

    The group statistics are aggregated and joined back, so a large group is not gathered.
    """
    stats = per_key(df.groupBy(*by).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_dev")))
    return df.join(stats, by).withColumn("z", F.try_divide(F.col(value) - F.col("_mean"), F.col("_dev"))).drop("_mean", "_dev")


# Fixed value: values beyond this many deviations are outliers.
OUTLIER_SIGMA = 2.0


def outlier_rows(df: DataFrame, by: list[str], value: str) -> DataFrame:
    return group_deviation(df, by, value).filter(F.abs("z") > OUTLIER_SIGMA)


# Fixed value: share of bad rows above which a load is reported.
INVALID_SHARE = 0.10


def load_summary(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows, distinct bad rows and whether their share passes the limit."""
    total = rows.agg(F.count("*").alias("total")).scalar()
    return issues.agg(F.countDistinct("row_number").alias("invalid")).select(
        total.alias("total"), "invalid", (total - F.col("invalid")).alias("valid"),
        (F.col("invalid") / total > INVALID_SHARE).alias("over_limit"),
    )
