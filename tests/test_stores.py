"""The partitioned and bucketed fact, and exactly-once loading of arriving files."""

import uuid

import pytest
from pyspark.sql import functions as F

from gridloom.session import scratch_path
from gridloom.sources import fact_store as S
from gridloom.sources import sinks
from gridloom.streaming.arrivals import ArrivalTable


@pytest.fixture
def fact(spark, tmp_path):
    name = f"fact_{uuid.uuid4().hex}"
    rows = spark.range(6000).selectExpr("id AS sale_id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS product_id", "id * 1.5 AS price",
                                        "timestamp'2020-11-15' + make_interval(0, CAST(id % 6 AS INT)) AS sold")
    S.create_fact(rows, name, "sold", "product_id", buckets=8, path=str(tmp_path / "fact"))
    yield name
    spark.sql(f"DROP TABLE {name}")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_recent_rows_read_their_months_only(spark, fact):
    recent = S.recent_sales(spark.table(fact), "sold", "2021-01-10")
    assert recent.count() == 4000 and len(recent.inputFiles()) < len(spark.table(fact).inputFiles())
    filters = [line for line in recent._jdf.queryExecution().executedPlan().toString().splitlines() if "PartitionFilters" in line]
    assert filters and "month" in filters[0].split("PartitionFilters:")[1].split("]")[0] and "2021-01" in filters[0]
    assert {f.split("month=")[1].split("/")[0] for f in recent.inputFiles()} == {"2021-01", "2021-02", "2021-03", "2021-04"}


def test_join_on_the_bucket_key_moves_only_the_dimension(spark, fact):
    dim = spark.range(50).selectExpr("id AS product_id", "concat('p', id) AS label")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = spark.table(fact).join(dim, "product_id")
        plan = plan_of(joined)
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
        # The only exchange stands above the dimension's range, not above the fact's files.
        assert "Range" in plan.split("Exchange")[1] and "FileScan" not in plan.split("Exchange")[1]
        assert joined.count() == 6000
        summed = spark.table(fact).groupBy("product_id").agg(F.sum("price"))
        assert "Exchange" not in plan_of(summed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_loading_a_month_again_leaves_the_others(spark, fact):
    table = spark.table(fact)
    files = {f for f in table.inputFiles() if "month=2021-02" not in f}
    again = spark.range(10).selectExpr("id AS sale_id", "7L AS product_id", "1.5 * id AS price", "timestamp'2021-02-03' AS sold")
    S.reload_months(again.withColumn("price", F.col("price").cast(table.schema["price"].dataType)).withColumn("product_id", F.col("product_id").cast(table.schema["product_id"].dataType)), fact, "sold", "product_id", buckets=8)
    spark.catalog.refreshTable(fact)
    table = spark.table(fact)
    assert table.filter("month = '2021-02'").count() == 10 and table.count() == 5010
    assert {f for f in table.inputFiles() if "month=2021-02" not in f} == files
    assert "Exchange" not in plan_of(table.groupBy("product_id").count())


class Killed(Exception):
    pass


def test_each_row_once_through_crashes_and_a_lost_checkpoint(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()

    def arrive(name, *rows):
        (inbox / name).write_text("id,price,sold,note\n" + "".join(r + "\n" for r in rows))

    table = ArrivalTable(spark, str(tmp_path / "table"), "id bigint, price decimal(19,4), sold timestamp, note string")
    checkpoint = scratch_path(spark, "arrivals")
    assert table.rows().collect() == [] and table.ledger().collect() == []
    arrive("a.csv", "1,10.50,2024-01-02,first", "2,oops,never,", ",,,")
    arrive("b.csv", "3,1250.00,2024-02-03 10:00:00,x")

    def die():
        raise Killed

    # Killed between the rows and the ledger: nothing counts yet.
    with pytest.raises(Exception, match="Killed"):
        table.load(str(inbox), checkpoint, files_per_batch=1, before_commit=die)
    assert table.rows().count() == 0 and table.ledger().count() == 0
    table.load(str(inbox), checkpoint, files_per_batch=1)
    rows = {r["id"]: r for r in table.rows().collect()}
    assert table.rows().count() == 4 and rows[1]["note"] == "first" and rows[2]["unreadable"] == 2 and rows[2]["price"] is None
    assert str(rows[3]["price"]) == "1250.0000" and rows[3]["unreadable"] == 0
    assert sorted((r["file"].rsplit("/", 1)[1], r["rows"]) for r in table.ledger().collect()) == [("a.csv", 3), ("b.csv", 1)]
    # Nothing new, then a new file, then a checkpoint that was lost: each row stays once.
    table.load(str(inbox), checkpoint)
    arrive("c.csv", "4,1,2024-03-04,y")
    table.load(str(inbox), checkpoint)
    table.load(str(inbox), scratch_path(spark, "fresh"))
    assert sorted(r["id"] or 0 for r in table.rows().collect()) == [0, 1, 2, 3, 4]


def test_a_batch_that_died_after_its_commit_is_left_alone(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    (inbox / "a.csv").write_text("id\n1\n2\n")
    table = ArrivalTable(spark, str(tmp_path / "table"), "id int")
    batch = spark.read.option("header", True).csv(str(inbox)).withColumn("file", F.lit("a.csv"))
    for _ in range(2):
        table._write(batch, "run-0", lambda: None)
    # The same file in another batch, with a new one beside it.
    more = batch.unionByName(spark.createDataFrame([("3", "b.csv")], "id string, file string"))
    table._write(more, "run-1", lambda: None)
    assert sorted(r["id"] for r in table.rows().collect()) == [1, 2, 3]
    assert sorted((r["batch"], r["file"], r["rows"]) for r in table.ledger().collect()) == [("run-0", "a.csv", 2), ("run-1", "b.csv", 1)]


def test_rows_dealt_to_a_fixed_number_of_files(spark):
    """Every row arrives once, no file stays empty, and what one task reads is less than the rows take in a shuffle."""
    rows = spark.range(0, 30_000, 1, 5).selectExpr(
        "id", "if(id % 7 = 0, NULL, concat('some words of a note ', id, '\\nand more')) AS text", "id / 4 AS price",
        "timestamp'2020-11-15' + make_interval(0, 0, 0, CAST(id % 900 AS INT)) AS sold", "array(id, NULL) AS list",
    )
    dealt = sinks.in_files(rows, 3)
    assert dealt.schema == rows.schema and dealt.exceptAll(rows).isEmpty() and dealt.count() == 30_000
    sizes = [len(p) for p in dealt.select("id").rdd.glom().collect()]
    assert len(sizes) == 3 and min(sizes) > 9_000
    for few, files in ((1, 1), (2, 2), (3, 3), (50, 3)):
        sizes = [len(p) for p in sinks.in_files(spark.range(0, few, 1, 1), 3).rdd.glom().collect()]
        assert sum(sizes) == few and sum(s > 0 for s in sizes) == files
    assert sinks.in_files(rows.limit(0), 2).count() == 0
    packed = rows.mapInArrow(sinks._pack(3), "file int, block binary").selectExpr("sum(length(block))").first()[0]
    assert packed * 4 < rows.selectExpr("sum(8 + 8 + 8 + 16 + coalesce(length(text), 0))").first()[0]
