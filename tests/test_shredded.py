"""Stored documents with a column per frequent key."""

import glob
import json

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions.fields import field_text
from emberlog.schema import LOG_COLUMNS, SHREDDED_COLUMNS
from emberlog.sources.logtable import read_logs, write_logs

from conftest import plan_of

VALUES = [
    "1", "-0", "1.0", "1.50", "0.10", "1e2", "1.5e3", "0.00", "123456789.0", "12345678901234567890",
    "0.1234567890123456789", "1e-7", "true", "false", "null", '"a"', '"42"', '" 42 "', '"é\\n\\"x"', '"1.0"',
    "[1, 2]", '["a", "b"]', '{"a": 1}', "[]", "[42]", "42", "42.0", "4.2e1", "42.5", '"x%y"', "2147483648",
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shredded") / "logs")
    rows = [(k, json.dumps({"n": k})[:-1] + f', "x": {v}, "vars.k": {k % 7}, "pad": "{"p" * 200}{k}"}}')
            for k, v in enumerate(VALUES * 40)]
    logs = spark.createDataFrame(rows, "id long, doc string").select(
        "id",
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("tstamp"),
        "doc",
        F.parse_json("doc").alias("doc_v"),
        F.array().cast("array<string>").alias("search"),
    )
    write_logs(logs, path, promoted=())
    return path, read_logs(spark, path, promoted=())


def test_texts_are_those_of_the_document(stored):
    logs = stored[1].select(
        "doc", field_text("x").alias("want"), field_text("x", SHREDDED_COLUMNS).alias("got")
    )
    assert [r for r in logs.collect() if r.got != r.want] == []


PREDICATES = [
    lambda c: P.eq("x", 1, c), lambda c: P.eq("x", 1.0, c), lambda c: P.eq("x", 42, c), lambda c: P.eq("x", "42", c),
    lambda c: P.eq("x", [1], c), lambda c: P.lt("x", 42, cols=c), lambda c: P.ge("x", 41.5, "double", c),
    lambda c: P.gt("x", 1, cols=c), lambda c: P.le("x", 100, "double", c), lambda c: P.like("x", "%4%", c),
    lambda c: P.in_list("x", [1, 42, "a"], c), lambda c: P.in_list("x", [], c), lambda c: P.eq("absent", 1, c),
    lambda c: ~P.eq("x", 1, c),
]


@pytest.mark.parametrize("make", PREDICATES)
def test_predicates_agree(stored, make):
    logs = stored[1].select(make(LOG_COLUMNS).alias("want"), make(SHREDDED_COLUMNS).alias("got"))
    assert [r for r in logs.collect() if r.got != r.want] == []


def test_whole_and_fraction_are_equal(stored):
    found = {VALUES[r.id % len(VALUES)] for r in stored[1].where(P.eq("x", 1.0, SHREDDED_COLUMNS)).collect()}
    assert found == {"1", "1.0", "[1, 2]"}


def test_scans_read_one_key(stored):
    path, logs = stored
    hit = P.eq("vars.k", 3, SHREDDED_COLUMNS) & P.lt("vars.k", 5, cols=SHREDDED_COLUMNS)
    plan = plan_of(logs.where(hit).select("id"))
    assert "ReadSchema: struct<id:bigint,doc_v:struct<0:variant>>" in plan
    sizes: dict[str, int] = {}
    for file in glob.glob(f"{path}/*/*.parquet"):
        group = pq.ParquetFile(file).metadata.row_group(0)
        for k in range(group.num_columns):
            column = group.column(k)
            sizes[column.path_in_schema] = sizes.get(column.path_in_schema, 0) + column.total_compressed_size
    whole = sum(n for name, n in sizes.items() if name.startswith("doc"))
    read = sum(n for name, n in sizes.items() if "vars.k" in name or name == "doc_v.metadata")
    assert any("vars.k" in name for name in sizes) and 5 * read < whole
