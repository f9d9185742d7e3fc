"""Readers and writers over files that Spark writes from the tables."""

from __future__ import annotations

import uuid
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.plans.blobs import customer_books, document_blobs
from gridloom.plans.registry import query
from gridloom.session import scratch_path
from gridloom.sources import delimited, documents, encodings, fact_store, files, sinks, workbook

_STYLES = {"comma": ",", "tab": "\t", "pipe": "|", "semicolon": ";", "colon": ":"}
_CLEAN = "regexp_replace(c_name, '#', ' #')"


def _delimited_files(load) -> str:
    """Every customer in one of five delimited styles.

    Some records are too long, some too short, some names go over two lines, the first one is a megabyte long,
    and the files of the last style are Latin-1.
    """
    path = scratch_path(load.spark, "delimited")
    key = F.col("c_custkey")
    for i, (style, sep) in enumerate(_STYLES.items()):
        name = F.concat(
            F.lit('"'), F.regexp_replace("c_name", "#", f" {sep}#"), F.when(key % 13 == 0, "\nsecond line").otherwise(""),
            F.when(key == 1, F.repeat(F.lit("x"), 1_000_000)).otherwise(""), F.lit(' é"'),
        )
        full = [key.cast("string"), name, F.col("c_acctbal").cast("decimal(12,2)").cast("string"),
                F.when(key % 23 == 0, "").otherwise(F.col("c_mktsegment"))]
        line = (
            F.when(key % 31 == 0, F.concat_ws(sep, *full, F.lit("x"), F.lit("y")))
            .when(key % 29 == 0, F.concat_ws(sep, *full[:3])).otherwise(F.concat_ws(sep, *full))
        )
        header = sep.join(["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
        # The writer takes lines; those of one record stay together in their partition.
        rows = load("customer").filter(key % len(_STYLES) == i).repartition(2).select(F.explode(F.split(line, "\n")).alias(header))
        rows.write.option("header", True).option("sep", "\u0001").option("quote", "").option(
            "ignoreTrailingWhiteSpace", False
        ).option("encoding", "ISO-8859-1" if style == "colon" else "UTF-8").csv(f"{path}/{style}")
    return path


@query(
    "read_delimited",
    """SELECT c_custkey::VARCHAR AS c1, replace(c_name, '#', ' ' || CASE c_custkey % 5 WHEN 0 THEN ',' WHEN 1 THEN chr(9) WHEN 2 THEN '|' WHEN 3 THEN ';' ELSE ':' END || '#') ||
              CASE WHEN c_custkey % 13 = 0 THEN chr(10) || 'second line' ELSE '' END || CASE WHEN c_custkey = 1 THEN repeat('x', 1000000) ELSE '' END || ' é' AS c2,
              c_acctbal::DECIMAL(12,2)::VARCHAR AS c3, CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN '' ELSE c_mktsegment END AS c4
       FROM customer WHERE c_custkey % 31 <> 0""",
)
def _(load):
    grid = delimited.read_delimited(load.spark, _delimited_files(load))
    return grid.filter(F.col("cells")[0] != "c_custkey").select(*[F.col("cells")[i].alias(f"c{i + 1}") for i in range(4)])


@query(
    "skipped_records",
    "SELECT c_custkey::VARCHAR AS c1, 4 AS width, 6 AS cells FROM customer WHERE c_custkey % 31 = 0",
)
def _(load):
    skipped = delimited.skipped_records(load.spark, _delimited_files(load))
    return skipped.select(F.col("cells")[0].alias("c1"), "width", F.size("cells").alias("cells"))


@query(
    "detect_delimiter",
    "SELECT * FROM (VALUES ('comma', ',', 2), ('tab', chr(9), 2), ('pipe', '|', 2), ('semicolon', ';', 2), ('colon', ':', 2)) t(style, delimiter, files)",
)
def _(load):
    lines = delimited.file_lines(load.spark, _delimited_files(load))
    found = delimited.detect_delimiters(lines)
    return found.select(F.element_at(F.split("file", "/"), -2).alias("style"), "delimiter").groupBy("style", "delimiter").agg(
        F.count("*").cast("int").alias("files")
    )


@query(
    "detect_encoding",
    "SELECT * FROM (VALUES ('plain', 'utf-8', 3), ('marked', 'utf-8-sig', 3), ('western', 'latin-1', 3)) t(style, encoding, files)",
)
def _(load):
    path = scratch_path(load.spark, "encodings")
    line = F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "lang")
    kinds = {"plain": (line, "UTF-8"), "marked": (F.concat(F.lit("﻿"), line), "UTF-8"), "western": (F.concat(F.lit("é "), line), "ISO-8859-1")}
    for style, (text, encoding) in kinds.items():
        load("documents").select(text.alias("line")).repartition(3).write.option("encoding", encoding).csv(f"{path}/{style}")
    blobs = load.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(path)
    return blobs.filter("length > 0").select(
        F.element_at(F.split("path", "/"), -2).alias("style"), delimited.detect_encoding(F.col("content")).alias("encoding")
    ).groupBy("style", "encoding").agg(F.count("*").cast("int").alias("files"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщ"
#: How a file of each style is made of a document, and the encoding it must be told to have.
_CODED = {
    "plain": ("utf-8", "{t}", "'utf-8'"), "wide": ("utf-16", "{t}", "'utf-16'"), "unmarked": ("utf-16-le", "{t}", "'utf-16-le'"),
    "western": ("latin-1", "{t}", "CASE WHEN regexp_matches(substr(text, 1, 4096), '[^\\x00-\\x7F]') THEN 'latin-1' ELSE 'utf-8' END"),
    "windows": ("cp1252", "“{t}” – 5 €", "'cp1252'"), "cyrillic": ("cp1251", "{t}", "'cp1251'"),
}
# Running text: a few letters, or one word over and over, do not tell the two Cyrillic pages apart.
_COMMON_WORDS = "(^| )(the|and|of|que|der|und|le|la|et)( |$)"
_PROSE = f"length(text) >= 100 AND regexp_matches(lower(text), '{_COMMON_WORDS}')"
_ENCODED_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{style}' AS style, {told} AS encoding FROM documents WHERE {_PROSE}" for style, (_, _, told) in _CODED.items()
)


@query("detect_encoding_confidence", f"SELECT doc_id, style, encoding, true AS sure FROM ({_ENCODED_SQL})")
def _(load):
    rows = load("documents").filter((F.char_length("text") >= 100) & F.lower("text").rlike(_COMMON_WORDS))
    files = []
    for style, (encoding, frame, _) in _CODED.items():
        text = F.translate(F.lower("text"), _LETTERS, _CYRILLIC) if style == "cyrillic" else F.col("text")
        before, _, after = frame.partition("{t}")
        files.append(rows.select("doc_id", F.lit(style).alias("style"), F.concat(F.lit(before), text, F.lit(after)).alias("text"), F.lit(encoding).alias("as")))
    made = reduce(DataFrame.unionByName, files).withColumn("content", _encoded("text", "as"))
    return made.select("doc_id", "style", encodings.guess_encoding(F.col("content")).alias("g")).select(
        "doc_id", "style", "g.encoding", (F.col("g.confidence") > encodings.SURE).alias("sure")
    )


@F.pandas_udf(T.BinaryType())
def _encoded(text: pd.Series, encoding: pd.Series) -> pd.Series:
    return pd.Series([t.encode(e, "replace") for t, e in zip(text, encoding)], dtype=object)


_BOOK_SQL = """SELECT 'book' || (c_custkey // 200) || '.xlsx' AS path, c_custkey % 200 + 2 AS r, * FROM customer"""
_CELLS_SQL = f"""WITH b AS ({_BOOK_SQL}), c AS (
    SELECT path, r AS "row", 1 AS col, c_name AS value, 'text' AS value_type, NULL AS formula, false AS bold, false AS merged_anchor FROM b
    UNION ALL SELECT path, r, 2, c_acctbal::DECIMAL(12,2)::VARCHAR, 'number', NULL, false, false FROM b
    UNION ALL SELECT path, r, 3, '0', 'number', '=B' || r || '*2', false, false FROM b
    UNION ALL SELECT path, r, 4, CASE WHEN c_custkey % 2 = 1 THEN 'True' ELSE 'False' END, 'bool', NULL, false, false FROM b
    UNION ALL SELECT DISTINCT path, 1, 1, 'Name', 'text', NULL, true, true FROM b
    UNION ALL SELECT DISTINCT path, 1, 2, 'Balance', 'text', NULL, false, false FROM b)"""


@query("read_workbook_cells", f"{_CELLS_SQL} SELECT *, 'Data' AS sheet FROM c")
def _(load):
    found = workbook.read_workbook_cells(customer_books(load))
    return found.select("path", "sheet", "row", "col", "value", "value_type", "formula", "bold", "merged_anchor")


@query("read_workbook_inputs_only", f"""{_CELLS_SQL} SELECT path, "row", col, CASE WHEN formula IS NULL THEN value ELSE '' END AS value FROM c""")
def _(load):
    return workbook.inputs_only(workbook.read_workbook_cells(customer_books(load))).select("path", "row", "col", "value")


_LINES_SQL = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"""


@query(
    "read_text_lines",
    f"WITH {_LINES_SQL} SELECT doc_id, line_no, trim(line) AS line, length(line) AS n_chars FROM l",
)
def _(load):
    return documents.stripped(documents.text_lines(load("documents"), "doc_id").withColumn("n_chars", F.length("line")))


@query(
    "read_markdown_lines",
    f"WITH {_LINES_SQL} SELECT doc_id, line_no, trim(line) AS line FROM l WHERE trim(line) <> ''",
)
def _(load):
    return documents.stripped(documents.text_lines(load("documents"), "doc_id"), markdown=True)


@query(
    "preview_text",
    f"WITH {_LINES_SQL} SELECT doc_id, line_no, substr(trim(line), 1, 500) AS line, length(trim(line)) > 500 AS cut FROM l WHERE line_no < 50",
)
def _(load):
    return documents.preview(documents.text_lines(load("documents"), "doc_id"))


@query(
    "preview_markdown",
    f"WITH {_LINES_SQL} SELECT doc_id, line_no, substr(trim(line), 1, 500) AS line, length(trim(line)) > 500 AS cut FROM l WHERE line_no < 50 AND trim(line) <> ''",
)
def _(load):
    return documents.preview(documents.text_lines(load("documents"), "doc_id"), markdown=True)


@query(
    "read_docx_paragraphs",
    f"WITH {_LINES_SQL} SELECT doc_id || '.docx' AS path, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS para_no, line AS text FROM l WHERE trim(line) <> ''",
)
def _(load):
    return documents.read_docx_paragraphs(document_blobs(load))


def mixed_files(load) -> str:
    path = scratch_path(load.spark, "arrivals")
    sinks.in_files(load("customer"), 4).write.option("header", True).csv(f"{path}/customers")
    sinks.in_files(load("documents").select("text"), 3).write.text(f"{path}/notes")
    sinks.in_files(load("orders"), 2).write.json(f"{path}/orders")
    return path


_REGISTRY_SQL = "(VALUES ('customers', 'csv', 'tabular', 4), ('notes', 'plain_text', 'narrative', 3), ('orders', NULL, NULL, 2)) t(folder, file_type, route, files)"


@query("file_registry", f"SELECT folder, file_type, file_type IS NOT NULL AS accepted, files FROM {_REGISTRY_SQL}")
def _(load):
    registry = files.file_registry(load.spark, mixed_files(load))
    both = files.accepted(registry).withColumn("accepted", F.lit(True)).unionByName(
        files.rejected(registry).drop("reason").withColumn("accepted", F.lit(False))
    )
    return both.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder"), "file_type", "accepted").agg(
        F.count("*").cast("int").alias("files")
    )


@query("route_files", f"SELECT folder, route, files FROM {_REGISTRY_SQL}")
def _(load):
    registry = files.file_registry(load.spark, mixed_files(load))
    return registry.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder"), files.route(F.col("file_type")).alias("route")).agg(
        F.count("*").cast("int").alias("files")
    )


@query("read_null_marked", "SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS segment, c_acctbal AS balance FROM customer")
def _(load):
    path = scratch_path(load.spark, "marked") + ".tsv"
    rows = load("customer").select("c_custkey", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING")).alias("segment"), F.col("c_acctbal").alias("balance"))
    rows.write.option("header", True).option("sep", "\t").option("nullValue", "\\N").csv(path)
    return delimited.read_null_marked(load.spark, path, "c_custkey bigint, segment string, balance double")


def _orders_csv(load) -> str:
    path = scratch_path(load.spark, "orders")
    sinks.write_csv(load("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")), path)
    return path


@query("read_inferred", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def _(load):
    return delimited.read_inferred(load.spark, _orders_csv(load)).withColumn("day", F.col("day").cast("string"))


@query("staging_text_load", "SELECT o_orderkey::VARCHAR AS col0, o_custkey::VARCHAR AS client_num, o_totalprice::DECIMAL(12,2)::VARCHAR AS price FROM orders")
def _(load):
    path = scratch_path(load.spark, "staging")
    price = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    sinks.write_csv(load("orders").select("o_orderkey", "o_custkey", price.alias("price")), path)
    return delimited.staging_text_load(load.spark, path, ["col0", "client_num", "price"])


@query("write_csv", "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand FROM part")
def _(load):
    path = scratch_path(load.spark, "parts")
    sinks.write_csv(load("part").select("p_partkey", "p_name", "p_brand"), path)
    return load.spark.read.option("header", True).csv(path)


@query(
    "write_warehouse",
    """SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, (SELECT 2 * count(*) FROM orders) AS written,
       count(*) FILTER (o_custkey % 50 = 0) AS missing FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders) GROUP BY 1""",
)
def _(load):
    path = scratch_path(load.spark, "warehouse")
    value = F.when(F.col("o_custkey") % 50 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice"))
    rows = load("orders").select("o_orderkey", value.alias("price"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    written = sinks.write_warehouse(rows, path, truncate=True, partition_by=["month"])
    written += sinks.write_warehouse(rows, path, partition_by=["month"])
    stored = load.spark.read.schema("o_orderkey bigint, price double, month string").parquet(path)
    return stored.groupBy("month").agg(F.count("*").alias("n"), F.lit(written).cast("bigint").alias("written"), F.count_if(F.col("price").isNull()).alias("missing"))


@query(
    "bucketed_fact",
    """WITH f AS (SELECT o_orderkey, o_custkey, o_orderdate, CASE WHEN strftime(o_orderdate, '%Y-%m') = '1998-03' THEN 2 ELSE 1 END * o_totalprice::DECIMAL(18,2) AS price
         FROM orders WHERE strftime(o_orderdate, '%Y-%m') <> '1998-03' OR o_orderkey % 2 = 0)
       SELECT c_mktsegment AS segment, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, sum(price)::DOUBLE AS price FROM f JOIN customer ON c_custkey = o_custkey
       WHERE o_orderdate >= '1998-02-10' GROUP BY 1, 2""",
)
def _(load):
    # Loaded whole, then one month again with other rows; recent sales join the dimension on the bucket key.
    moment = F.col("o_orderdate").cast("timestamp").alias("sold")
    rows = load("orders").select("o_orderkey", "o_custkey", moment, F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    name = f"fact_{uuid.uuid4().hex}"
    fact_store.create_fact(rows, name, "sold", "o_custkey", buckets=8, path=scratch_path(load.spark, "fact"))
    march = rows.filter((F.date_format("sold", "yyyy-MM") == "1998-03") & (F.col("o_orderkey") % 2 == 0))
    fact_store.reload_months(march.withColumn("price", (F.col("price") * 2).cast("decimal(18,2)")), name, "sold", "o_custkey", buckets=8)
    recent = fact_store.recent_sales(load.spark.table(name), "sold", "1998-02-10")
    members = load("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return recent.join(members, "o_custkey").groupBy("segment", "month").agg(
        F.count("*").alias("n"), F.sum("price").cast("double").alias("price")
    )


_BAL = "CASE c_custkey % 7 WHEN 3 THEN NULL WHEN 5 THEN to_json('infinity') WHEN 6 THEN to_json('-infinity') ELSE to_json(c_acctbal) END"


@query(
    "result_json",
    f"""SELECT 'customers' AS name, (SELECT count(*) FROM customer) AS rows, 3 AS cols, 'c_custkey,c_name,balance' AS columns,
        '[' || (SELECT string_agg(to_json({{'c_custkey': c_custkey, 'c_name': c_name, 'balance': {_BAL}}})::VARCHAR, ',' ORDER BY c_custkey) FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 10)) || ']' AS sample
        UNION ALL SELECT 'orders', (SELECT count(*) FROM orders), 2, 'o_orderkey,o_orderdate',
        '[' || (SELECT string_agg(to_json({{'o_orderkey': o_orderkey, 'o_orderdate': strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S')}})::VARCHAR, ',' ORDER BY o_orderkey) FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)) || ']'""",
)
def _(load):
    kind = F.col("c_custkey") % 7
    special = (
        F.when(kind == 3, F.lit(float("nan"))).when(kind == 5, F.lit(float("inf"))).when(kind == 6, F.lit(float("-inf"))).otherwise(F.col("c_acctbal"))
    )
    customers = load("customer").select("c_custkey", "c_name", special.alias("balance"))
    orders = load("orders").select("o_orderkey", "o_orderdate")
    return reduce(DataFrame.unionByName, [
        sinks.result_json("customers", customers, [F.col("c_custkey")]), sinks.result_json("orders", orders, [F.col("o_orderkey")])
    ])
