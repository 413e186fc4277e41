"""Filters as text: one definition, columns pushed down, awkward literals."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions import text as X
from emberlog.functions.filters import condition_of
from emberlog.functions.sql import register_sql_functions
from emberlog.operators.postings import build_positions, lookup_phrase, phrase_hits, write_positions
from emberlog.schema import LOG_COLUMNS, STORED_COLUMNS
from emberlog.sources.logtable import read_logs, write_logs
from emberlog.sources.views import logs_from_documents

from conftest import plan_of

VALUES = [
    "0.1234567890123456788", "0.1234567890123456789", "0.12345678901234567890", "1", "1.0", "01", "1e0", "-0", "0", "0.0",
    "-5", "-5.50", "12345678901234567890", "12345678901234567891", "1e2", "100", '"100"', '"a_b"', '"a%b"', "true",
    "null", "[1, 100]", '["x", "100"]', "2147483648", '"é"', '"it\'s"', '"b\\\\c"',
]
NUMBERS = [
    "0.1234567890123456788", "0.1234567890123456789", "0.12345678901234567890", "1", "1.0", "1.00", "0", "-0", "-5",
    "-5.5", "-5.50", "12345678901234567890", "12345678901234567891", "100", "100.0", "0.5", "99.99", "2147483648",
]


@pytest.fixture(scope="module")
def docs(spark):
    register_sql_functions(spark)
    rows = [(k, f'{{"x": {v}, "hostname": "web{k % 3}"}}') for k, v in enumerate(VALUES) if v != "01"]
    logs = spark.createDataFrame(rows, "id long, doc string")
    search = F.split(F.lit("the end of the line"), " ").alias("search")
    return logs.select("id", "doc", F.parse_json("doc").alias("doc_v"), search).cache()


def differing(docs, pairs):
    """Names of the pairs of Columns that differ on any row."""
    columns = [(~a.eqNullSafe(b)).cast("int").alias(f"c{k}") for k, (_, a, b) in enumerate(pairs)]
    sums = docs.select(*columns).groupBy().sum().first()
    return [name for (name, _, _), n in zip(pairs, sums) if n]


def test_numbers_are_equal_in_text_and_columns(docs):
    """The SQL function itself, the text filter, and the Column, for each literal."""
    pairs = []
    for n in NUMBERS:
        column = P.eq("x", Decimal(n))
        pairs.append((f"sql {n}", F.expr(f"log_eq_number(doc_v, 'x', '{n}')"), column))
        pairs.append((f"filter {n}", condition_of(f"log_eq_number(doc_v, 'x', {n})"), column))
    assert differing(docs, pairs) == []
    hit = docs.where("log_eq_number(doc_v, 'x', '0.1234567890123456789')")
    assert sorted(r.id for r in hit.collect()) == [1, 2]


FILTERS = {
    "log_eq(doc_v, 'x', 'it''s')": lambda: P.eq("x", "it's"),
    "log_eq(doc_v, 'x', '100') OR log_eq_number(doc_v, 'x', -5.5)": lambda: P.eq("x", "100") | P.eq("x", -5.5),
    "NOT log_eq(doc_v, 'x', 'é')": lambda: ~P.eq("x", "é"),
    "log_has_all(doc_v, 'x', array('x', '100'))": lambda: P.eq("x", ["x", "100"]),
    "log_has_all_numbers(doc_v, 'x', array(100, 1.0))": lambda: P.eq("x", [100, 1.0]),
    "log_lt(doc, 'x', 100) AND log_ge(doc, 'x', -5)": lambda: P.lt("x", 100) & P.ge("x", -5),
    r"log_like(doc, 'x', 'a\\_%')": lambda: P.like("x", r"a\_%"),
    "log_in(doc, 'x', array('1', 'a%b', '0'))": lambda: P.in_list("x", ["1", "a%b", "0"]),
    "log_int(doc, 'x') = 100 AND id > 3": lambda: (P.field_number("x") == 100) & (F.col("id") > 3),
    "log_text(doc, 'x') IS NULL": lambda: P.field_text("x").isNull(),
    "log_all(search, array('the', 'end')) AND log_none(search, array('x'))": lambda: X.text_all("the", "end") & X.text_none("x"),
    "log_phrase(search, 'Of the') AND log_any(search, array('y', 'line'))": lambda: X.text_phrase("Of the") & X.text_any("y", "line"),
    "id IN (1, 2) OR length(doc) > 30": lambda: F.col("id").isin(1, 2) | (F.length("doc") > 30),
}


@pytest.mark.parametrize("text", list(FILTERS))
def test_text_is_the_column(docs, text):
    assert differing(docs, [(text, condition_of(text), FILTERS[text]())]) == []
    assert differing(docs, [(text, F.expr(text), FILTERS[text]())]) == []


def test_text_reaches_the_reader(spark, tmp_path):
    rows = [(k, json.dumps({"hostname": f"web{k}", "x": k})) for k in range(20)]
    logs = spark.createDataFrame(rows, "id long, doc string").select(
        "id",
        F.lit("2024-01-02 03:04:05").cast("timestamp").alias("tstamp"),
        "doc",
        F.parse_json("doc").alias("doc_v"),
        F.array().cast("array<string>").alias("search"),
    )
    write_logs(logs, str(tmp_path / "t"))
    stored = read_logs(spark, str(tmp_path / "t"))
    found = stored.where(condition_of("log_eq(doc_v, 'hostname', 'web1') AND id < 5", STORED_COLUMNS))
    assert "EqualTo(hostname,web1)" in plan_of(found) and found.count() == 1


def test_bad_filters(docs):
    with pytest.raises(ValueError):
        condition_of("log_eq(doc_v, 'not a name', 'x')")
    own = condition_of("log_eq(other, 'x', '100')", LOG_COLUMNS)  # another column: left to SQL
    assert docs.withColumn("other", F.col("doc_v")).where(own).count() == 2


PHRASES = ["of the", "The", "de la", "the the", "of the of", "e le", "no such words here"]


@pytest.fixture(scope="module")
def words(spark):
    return logs_from_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).cache()


@pytest.mark.parametrize("phrase", PHRASES)
def test_phrases_by_position(words, phrase):
    found = sorted(r.id for r in lookup_phrase(words, build_positions(words), phrase).collect())
    assert found == sorted(r.id for r in words.where(X.text_phrase(phrase)).collect())


def test_phrase_reads_no_text(spark, words, tmp_path):
    write_positions(words, str(tmp_path / "p"), partitions=4)
    words.write.parquet(str(tmp_path / "w"))
    positions, logs = (spark.read.parquet(str(tmp_path / n)) for n in "pw")
    plan = plan_of(lookup_phrase(logs, positions, "of the").select("id"))
    assert "search" not in plan and "EqualTo(token,of)" in plan and "EqualTo(token,the)" in plan
    assert phrase_hits(positions, "of the").columns == ["id"]
    with pytest.raises(ValueError):
        lookup_phrase(logs, positions, "--")
