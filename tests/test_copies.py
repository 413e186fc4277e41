"""Queries over tables that hold the same rows several times under keys of their own."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check_queries import compare, connect
from emberlog.functions.fields import int_or_null
from emberlog.functions.sql import register_sql_functions
from emberlog.plans.base import Tables
from emberlog.streaming.importer import _lines_of_bad_rows
from conftest import plan_of

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def doubled(spark, tmp_path_factory):
    """A folder with each event twice, under another id but at the same time."""
    folder = str(tmp_path_factory.mktemp("doubled"))
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    more = events.withColumn("event_id", F.col("event_id") + 1_000_001)
    events.union(more).coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


def test_events_of_one_time_stay_apart(spark, doubled):
    db = connect(FOLDER)
    db.execute("drop view events")
    db.execute(f"create view events as select * from read_parquet('{doubled}/events.parquet/*.parquet')")
    problem, rows = compare("import_repeated_lines", spark, db, doubled)
    assert not problem and rows > 1000


def test_other_texts_than_integers_are_not_cast(spark):
    texts = ["7", " +007\t", "-2147483648", "2147483648", "99999999999", "7.0", "1e3", "", "x", "-"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    found = frame.select(int_or_null(F.col("t")).alias("i"))
    assert [r.i for r in found.collect()] == [7, 7, -(2**31)] + [None] * 7
    # a failing cast builds an error, so a pattern stands before it
    assert "RLIKE" in plan_of(found)
    register_sql_functions(spark)
    assert [r[0] for r in frame.selectExpr("to_number_or_null(t)").collect()] == [
        r.i for r in found.collect()
    ]


def test_integers_are_counted_where_a_text_is_read(spark):
    assert "Generate" not in plan_of(entry.queries()["int_or_null"](spark, FOLDER))


@pytest.mark.parametrize(
    "name",
    ["flatten_deep", "render_fields", "import_reasons", "message_swap", "structured_data"],
)
def test_rows_of_one_row_group_become_many_tasks(spark, name):
    assert "REPARTITION_BY_NUM" in plan_of(entry.queries()[name](spark, FOLDER))


def test_streamed_lines_become_many_tasks(spark):
    schema = spark.read.parquet(f"{FOLDER}/events.parquet").schema
    lines = Tables(spark, FOLDER).raw_lines(spark.readStream.schema(schema).parquet(FOLDER))
    plan = lines._jdf.queryExecution().analyzed().toString()
    assert "Repartition" in plan and lines.isStreaming


def test_a_batch_keeps_the_lines_of_rejected_rows(spark):
    rows = spark.createDataFrame([("a", None), ("b", "bad")], "value string, reason string")
    assert [r.value for r in _lines_of_bad_rows(rows).orderBy("reason").collect()] == [None, "b"]
