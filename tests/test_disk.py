"""What a large import puts on disk: lines, shuffled columns and shuffled documents."""

import re
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from emberlog.operators.ingest import import_events
from emberlog.operators.postings import build_postings, lookup
from emberlog.plans.base import Tables
from emberlog.sources.jsonlines import LINES_PER_FILE, read_json_lines, write_json_lines
from emberlog.sources.logtable import prepare_logs, read_logs, write_logs
from conftest import plan_of


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder with an event table over two months."""
    path = str(tmp_path_factory.mktemp("events"))
    kinds = ["view", "click", "error"]
    rows = [
        (k, datetime(2024, 1, 15) + timedelta(hours=k), k % 50, kinds[k % 3], k / 4, f'{{"k": {k % 9}}}')
        for k in range(900)
    ]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


@pytest.fixture(scope="module")
def good(spark, folder):
    return import_events(Tables(spark, folder).raw_lines())[0]


def nodes(plan: str, name: str) -> list[str]:
    """The details of a plan's operators of one name."""
    return re.findall(rf"^\(\d+\) {name}\n((?:.+\n)*)", plan, re.M)


def test_lines_are_compressed_files_of_bounded_length(spark, tmp_path):
    texts = F.format_string('{"msg":"a line like the others","n":%s}', F.col("id"))
    many = 2 * LINES_PER_FILE + 1
    lines = spark.range(0, many, 1, 1).select(texts.alias("value"))
    write_json_lines(lines, str(tmp_path / "lines"))
    files = list((tmp_path / "lines").glob("part-*"))
    assert len(files) == 3
    size = lines.agg(F.sum(F.length("value") + 1)).first()[0]
    assert sum(f.stat().st_size for f in files) < size / 5
    found = read_json_lines(spark, str(tmp_path / "lines"))
    assert found.count() == many and found.select("value").exceptAll(lines).isEmpty()


def test_repeated_lines_are_stored_compressed(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(Tables, "work_folder", lambda self: str(tmp_path))
    found = entry.queries()["import_repeated_lines"](spark, folder)
    want = [k for k in range(900) if k % 50 % 9 != 8]
    rows = sorted((r.tstamp, r.n, r.ids, r.found) for r in found.collect())
    assert rows == [
        (datetime(2024, 1, 15) + timedelta(hours=k), 1 + k % 3, 1 + k % 3, 2 if k % 3 == 1 else 0)
        for k in want
    ]
    files = list(Path(tmp_path, "lines").glob("part-*"))
    assert files and all(f.suffix == ".gz" for f in files)


def test_columns_that_follow_from_the_document_are_not_shuffled(good):
    def moved(logs):
        exchanges = nodes(plan_of(prepare_logs(logs)), "Exchange")
        (columns,) = [e.split("\n")[0] for e in exchanges if "REBALANCE" in e]
        return re.findall(r"(\w+)#", columns)

    assert moved(good) == ["id", "tstamp", "doc", "doc_v", "search", "p_month"]
    assert moved(good.drop("doc_v")) == ["id", "tstamp", "doc", "search", "p_month"]


def test_a_variant_that_is_left_out_is_the_parsed_document(spark, good, tmp_path):
    shown = ["id", "tstamp", "doc", F.to_json("doc_v"), "search", "hostname", "p_month"]
    found = []
    for name, rows in ("whole", good), ("short", good.drop("doc_v")):
        write_logs(rows, str(tmp_path / name))
        found.append(read_logs(spark, str(tmp_path / name)).select(*shown).orderBy("id").collect())
    assert found[0] == found[1] and len(found[0]) == good.count()


def test_a_lookup_moves_the_columns_that_are_asked_for(spark, good, tmp_path):
    write_logs(good, str(tmp_path / "logs"))
    logs = read_logs(spark, str(tmp_path / "logs"))
    found = lookup(logs, build_postings(logs), ["user", "click"])
    plan = plan_of(found.select("id"))
    assert "ReadSchema: struct<id:bigint,search:array<string>>" in plan and "doc" not in plan
    # the words are checked behind the join, in the generator
    assert not any("array_contains" in node for node in nodes(plan, "Filter"))
    assert any("array_contains" in node for node in nodes(plan, "Generate"))
    shown = [F.to_json(c).alias(c) if c == "doc_v" else c for c in logs.columns]
    want = logs.where(F.array_contains("search", "click")).select(*shown)
    assert found.columns == logs.columns
    assert sorted(found.select(*shown).collect()) == sorted(want.collect())
