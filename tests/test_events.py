"""Newest events, field summary, metadata, JSON documents and lines."""

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions.predicates import eq, gt
from emberlog.functions.render import event_line, field_line
from emberlog.operators.events import field_summary, field_values, latest_events, range_metadata
from emberlog.operators.responses import (
    counts_response,
    event_json_lines,
    events_response,
)
from emberlog.sources.logtable import as_logs
from emberlog.sources.views import logs_from_events
from emberlog.streaming.tail import tail_lines

from conftest import plan_of

DOCS = [
    '{"a":"x","n":1.0,"t":["p","p","q"]}',
    '{"a":"x","n":1,"t":[]}',
    '{"a":null,"o":{"k":1},"t":"p"}',
    '{"a":"[1]","n":"1","t":[null]}',
]


@pytest.fixture(scope="module")
def logs(events):
    return logs_from_events(events)


@pytest.fixture(scope="module")
def small(spark):
    rows = [(n, f"2024-01-01 00:00:0{n}", d) for n, d in enumerate(DOCS)]
    df = spark.createDataFrame(rows, "id long, t string, doc string")
    return as_logs(df.select("id", F.col("t").cast("timestamp").alias("tstamp"), "doc"))


def test_latest(events, logs):
    got = latest_events(logs, "2024-01-03", "2024-01-20", gt("user_id", 3), limit=7)
    pdf = events.where("ts between '2024-01-03' and '2024-01-20' and user_id > 3").toPandas()
    want = pdf.sort_values("ts", ascending=False).event_id[:7].tolist()
    assert [r.id for r in got.collect()] == want
    assert got.columns == ["id", "timestamp", "source"]
    assert latest_events(logs, "2024-01-03", "2024-01-20").count() == events.where(
        "ts between '2024-01-03' and '2024-01-20'"
    ).count()
    assert latest_events(logs, "2024-01-03", "2024-01-20", limit=0).count() == 0
    with pytest.raises(ValueError):
        latest_events(logs, "2024-01-03", "2024-01-20", limit=-1)
    assert "TakeOrderedAndProject" in plan_of(got)


def test_range_is_inclusive(small):
    got = latest_events(small, "2024-01-01T00:00:01Z", "2024-01-01T01:00:02+01:00")
    assert [r.id for r in got.collect()] == [2, 1]


def test_field_values(small):
    got = Counter((r.field, r.value) for r in field_values(small).collect())
    assert got == Counter(
        {
            ("a", "x"): 2, ("a", ""): 1, ("a", "[1]"): 1,
            ("n", "1.0"): 1, ("n", "1"): 2, ("o", '{"k":1}'): 1,
            ("t", "p"): 3, ("t", "q"): 1, ("t", ""): 1,
        }
    )


def test_field_summary(small):
    got = field_summary(small, "2024-01-01", "2024-01-02", k=2).collect()
    assert {(r.field, r["rank"]): (r.value, r.n) for r in got} == {
        ("a", 1): ("x", 2), ("a", 2): ("", 1), ("n", 1): ("1", 2), ("n", 2): ("1.0", 1),
        ("o", 1): ('{"k":1}', 1), ("t", 1): ("p", 3), ("t", 2): ("", 1),
    }
    newest = field_summary(small, "2024-01-01", "2024-01-02", sample=1).collect()
    assert {(r.field, r.value) for r in newest} == {("a", "[1]"), ("n", "1"), ("t", "")}


def test_field_summary_plan(logs):
    plan = plan_of(field_summary(logs, "2024-01-01", "2024-02-01", sample=None))
    assert "WindowGroupLimit" in plan


def test_metadata(events, logs):
    got = range_metadata(logs, "2024-01-03", "2024-01-05").collect()
    count = events.where("ts between '2024-01-03' and '2024-01-05'").count()
    assert {r.key: r.value for r in got} == {"event_count": count, "counts_interval_sec": 1800}


def test_events_response(small):
    row = events_response(small, "2024-01-01", "2024-01-02", limit=2).collect()
    (text,) = [r.json for r in row]
    doc = json.loads(text)
    assert list(doc) == ["events", "fields", "metadata"]
    assert [e["id"] for e in doc["events"]] == [3, 2]
    assert doc["events"][1] == {
        "timestamp": "2024-01-01T00:00:02Z", "id": 2, "source": json.loads(DOCS[2]),
    }
    assert doc["fields"]["a"] == {"x": 2, "": 1, "[1]": 1}
    assert doc["metadata"] == {"counts_interval_sec": 1800, "event_count": 4}
    nothing = events_response(small, "2023-01-01", "2023-01-02", limit=2).first().json
    assert json.loads(nothing) == {
        "events": None, "fields": None,
        "metadata": {"counts_interval_sec": 1800, "event_count": 0},
    }
    lines = [r.json for r in events_response(small, "2024-01-01", "2024-01-02").collect()]
    whole = json.loads("".join(lines))
    assert [e["id"] for e in whole.pop("events")] == [3, 2, 1, 0] and len(lines) == 6
    assert whole == {k: v for k, v in doc.items() if k != "events"}
    lines = [r.json for r in events_response(small, "2023-01-01", "2023-01-02").collect()]
    assert json.loads("".join(lines)) == json.loads(nothing)


def test_json_lines(small):
    lines = event_json_lines(latest_events(small, "2024-01-01", "2024-01-02")).collect()
    assert [json.loads(r.value)["id"] for r in lines] == [3, 2, 1, 0]
    assert '"n":1.0' in lines[3].value


def test_counts_response(small):
    text = counts_response(small, "2024-01-01", "2024-01-01T00:00:03").first().json
    assert json.loads(text) == {
        "metadata": {"counts_interval_sec": 1},
        "counts": {f"2024-01-01T00:00:0{n}Z": {"value": 1} for n in range(4)},
    }
    text = counts_response(
        small, "2024-01-01", "2024-01-01T00:00:03", split_by="a", max_buckets=1,
        value="n", aggregate="sum",
    ).first().json
    assert set(json.loads(text)["counts"]["2024-01-01T00:00:02Z"]) == {"(null)"}
    nothing = counts_response(
        small, "2024-01-01", "2024-01-01T00:00:03", eq("a", "no"), split_by="a", max_buckets=1
    ).first().json
    assert json.loads(nothing)["counts"] is None
    args = (small, "2024-01-01", "2024-01-01T00:00:03")
    lines = [r.json for r in counts_response(*args, split_by="a").collect()]
    one = counts_response(*args, split_by="a", max_buckets=99).first().json
    assert json.loads("".join(lines)) == json.loads(one) and len(lines) > 3
    lines = [r.json for r in counts_response(*args, eq("a", "no"), split_by="a").collect()]
    assert json.loads("".join(lines)) == json.loads(nothing)


def test_lines(spark):
    doc = '{"hostname":"web1","msg":"hi","syslogtag":null,"vars.a":[1,"x"],"o":{"k":{"z":1}}}'
    df = spark.createDataFrame([(doc,), ('{"msg":"hi"}',)], "doc string")
    df = as_logs(df.withColumn("tstamp", F.lit("2024-01-02 03:04:05.9").cast("timestamp")))
    assert [r[0] for r in df.select(event_line()).collect()] == [
        "2024-01-02 03:04:05 web1 null hi", "2024-01-02 03:04:05 hi",
    ]
    assert [r[0] for r in df.select(field_line()).collect()] == [
        "2024-01-02 03:04:05 web1 null hi", "2024-01-02 03:04:05 None None hi",
    ]
    assert [r[0] for r in df.select(field_line(["vars.a", "o", "nope"])).collect()] == [
        '2024-01-02 03:04:05 =[1,"x"] k.z=1 None', "2024-01-02 03:04:05 None None None",
    ]


def test_tail_lines(events, logs):
    now = datetime(2024, 1, 20)
    pdf = events.where("ts > '2024-01-18'").toPandas().sort_values("event_id")
    got = tail_lines(
        logs, max_age=timedelta(days=2), max_lines=5, fields=["event_type", "nope"],
        now=now, by_id=True,
    ).collect()
    assert [r.id for r in got] == pdf.event_id[-5:].tolist()
    last = pdf.iloc[-1]
    assert got[-1].line == f"{last.ts:%Y-%m-%d %H:%M:%S} {last.event_type} None"
    later = tail_lines(logs, max_age=timedelta(days=2), now=now, last_id=got[2].id, by_id=True)
    assert [r.id for r in later.collect()] == [r.id for r in got[3:]]
    assert "TakeOrderedAndProject" in plan_of(later)
    # the age as text, which still folds to one literal
    by_text = tail_lines(logs, max_age="1 day 24 hours", max_lines=None, now=now)
    assert by_text.count() == len(pdf)
    assert "GreaterThan(ts,2024-01-18T00:00)" in plan_of(by_text)
