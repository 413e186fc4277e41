"""Newest events, estimates and rollups of committed tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.operators.events import latest_events
from emberlog.operators.histogram import time_histogram
from emberlog.operators.rollup import Rollup
from emberlog.operators.stored import latest_stored, periods_newest_first, range_estimate
from emberlog.operators.timerange import time_range
from emberlog.schema import SHREDDED_COLUMNS as COLS
from emberlog.schema import LOG_SCHEMA
from emberlog.sources.committed import log_table
from emberlog.sources.views import logs_from_events

START, END = "2024-01-01", "2024-02-01"


@pytest.fixture(scope="module")
def logs(events):
    rows = logs_from_events(events).select("id", "tstamp", "doc", "doc_v", "search")
    return rows.withColumn("tstamp", F.col("tstamp").cast("timestamp")).cache()


@pytest.fixture(scope="module")
def table(spark, logs, tmp_path_factory):
    table = log_table(spark, str(tmp_path_factory.mktemp("t") / "logs"), ["day"], promoted=())
    for part in range(2):
        table.append(logs.where(F.pmod("id", F.lit(2)) == part))
    return table


def rows(frame):
    return [tuple(r) for r in frame.collect()]


@pytest.mark.parametrize("limit", [0, 1, 30, 100, 100_000, None])
@pytest.mark.parametrize("where", [None, lambda: P.eq("event_type", "error", COLS), lambda: F.lit(False)])
def test_newest_events_are_the_same(table, logs, limit, where):
    where = where and where()
    want = latest_events(logs, START, "2024-01-20T12:00:00", where, limit)
    got = latest_stored(table, START, "2024-01-20T12:00:00", where, limit, COLS)
    order = [(r.id, r.timestamp) for r in got.collect()]
    assert order == [(r.id, r.timestamp) for r in want.collect()]


def test_older_days_stay_unread(table, logs):
    per_day = {r.day: r["count"] for r in logs.groupBy(F.to_date("tstamp").alias("day")).count().collect()}
    days = sorted(per_day, reverse=True)
    frame = latest_stored(table, START, END, limit=per_day[days[0]], cols=COLS)
    assert {f.split("p_day=")[1].split("/")[0] for f in frame.inputFiles()} == {str(days[0])}
    periods = periods_newest_first(table, "2024-01-03", "2024-01-05 23:59:59")
    assert [p[0].split("p_day=")[1] for p in periods] == ["2024-01-05", "2024-01-04", "2024-01-03"]
    with pytest.raises(ValueError):
        latest_stored(table, START, END, limit=-1, cols=COLS)


def test_newest_events_of_an_empty_table(spark, tmp_path):
    table = log_table(spark, str(tmp_path / "none"), ["month", "day"], promoted=())
    assert latest_stored(table, START, END, limit=5, cols=COLS).collect() == []
    assert rows(range_estimate(table, START, END)) == [(0, 0)]


RANGES = [(START, END), ("2024-01-05", "2024-01-09"), ("2024-01-07 11:00:00", "2024-01-07 11:00:00")]
RANGES += [("2023-01-01", "2023-02-01"), ("2024-01-09", "2024-01-05"), ("2024-01-03 04:05:06.5", "2024-01-28")]


@pytest.mark.parametrize("start, end", RANGES)
def test_small_directories_are_counted_exactly(table, start, end):
    assert rows(range_estimate(table, start, end)) == [(time_range(table.read(), start, end).count(), 0)]


def many(spark, n):
    seconds = F.lit(1704067200) + F.col("id") % 10 * 86_400 + (F.xxhash64("id") % 43_200 + 43_200)
    made = spark.range(n).select("id", F.timestamp_seconds(seconds).alias("tstamp"), F.lit("{}").alias("doc"))
    made = made.withColumns({"doc_v": F.parse_json("doc"), "search": F.array(F.lit("a"))})
    return made.select(*LOG_SCHEMA.names)


def test_estimates_are_close_and_read_statistics_alone(spark, tmp_path):
    table = log_table(spark, str(tmp_path / "big"), ["day"], promoted=())
    table.append(many(spark, 60_000))
    table.append(many(spark, 30_000))
    for k in range(5):
        start, end = f"2024-01-0{1 + k} 0{k}:30:00", f"2024-01-0{5 + k} 1{k}:45:00"
        exact = time_range(table.read(), start, end).count()
        frame = range_estimate(table, start, end)
        n, bound = rows(frame)[0]
        assert abs(n - exact) <= bound and 0 < bound < 0.02 * exact
        assert all("/_times/" in f for f in table.statistics().inputFiles())
    before = table.statistics().count()
    table.compact()
    assert table.statistics().count() == before // 2
    assert rows(range_estimate(table, START, END)) == [(90_000, 0)]
    table.vacuum(0)
    assert rows(range_estimate(table, START, END)) == [(90_000, 0)]
    assert len(table.storage.names("_times")) == 1


def rounded(frame):
    return [(a, b, c if c is None else round(c, 6)) for a, b, c in rows(frame)]


SPANS = [(START, END), ("2024-01-03 05:17:09.25", "2024-01-25 21:43:10"), ("2024-01-04 10:00:30", "2024-01-04 10:01:10")]


@pytest.fixture(scope="module")
def rollup(table, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("r") / "rollup")
    rollup = Rollup(table, path, "event_type", "value", "hour", cols=COLS)
    assert rollup.refresh() == 0
    return rollup


@pytest.mark.parametrize("start, end", SPANS)
@pytest.mark.parametrize("aggregate", [None, "count", "sum", "avg", "min", "max"])
def test_rollup_equals_rows(rollup, logs, start, end, aggregate):
    value = None if aggregate is None else "value"
    want = rounded(time_histogram(logs, start, end, None, "event_type", 3, value, aggregate))
    assert rounded(rollup.histogram(start, end, 3, aggregate)) == want


def test_rollup_without_a_refresh_reads_rows(table, logs, tmp_path):
    found = Rollup(table, str(tmp_path / "rollup"), cols=COLS).histogram(START, END)
    assert rounded(found) == rounded(time_histogram(logs, START, END))


def test_rollup_follows_the_log(spark, logs, tmp_path):
    table = log_table(spark, str(tmp_path / "logs"), ["day"], promoted=())
    rollup = Rollup(table, str(tmp_path / "rollup"), cols=COLS)
    assert rollup.refresh() is None and rollup.covered == -1
    table.append(logs.where("tstamp < '2024-01-10'"))
    assert rollup.refresh() == 0 and rollup.refresh() is None
    first = set(rollup.table.state().directories)
    late = logs.where("tstamp >= '2024-01-08' and tstamp < '2024-01-12'")
    table.append(late)
    table.compact()

    def total():
        return rounded(rollup.histogram(START, "2024-01-31 07:08:09"))

    want = rounded(time_histogram(table.read(), START, "2024-01-31 07:08:09"))
    assert total() == want
    assert rollup.refresh() == 1 and total() == want
    added = {d.split("p_day=")[1] for d in set(rollup.table.state().directories) - first}
    assert added == {"2024-01-08", "2024-01-09", "2024-01-10", "2024-01-11"}
    rollup.table.compact()
    assert total() == want


def test_rollup_reads_no_rows_inside_the_range(rollup):
    plan = rollup.histogram("2024-01-02 00:00:00", "2024-01-30 23:59:59.999999")
    assert all("/rollup/" in f for f in plan.inputFiles())
    cut = rollup.histogram("2024-01-02 00:00:00.000001", "2024-01-30 23:59:59.999999")
    assert any("/logs/" in f for f in cut.inputFiles())


def test_a_failed_refresh_counts_once(table, tmp_path):
    rollup = Rollup(table, str(tmp_path / "rollup"), cols=COLS)
    rollup.table.stage(rollup.table.prepare(rollup._cells(table.read())), f"log-{1:012d}")
    rollup.refresh()
    assert sum(r.n for r in rollup.table.read().collect()) == table.read().count()
    for wrong in ({"aggregate": "sum"}, {"max_buckets": -1}):
        with pytest.raises(ValueError):
            rollup.histogram(START, END, **wrong)
    with pytest.raises(ValueError):
        Rollup(table, str(tmp_path / "r"), unit="day")


def test_whole_cells():
    rollup = Rollup.__new__(Rollup)
    rollup.unit = "minute"
    at = datetime(2024, 1, 1, 10, 0)
    tick, minute = timedelta(microseconds=1), timedelta(minutes=1)
    assert rollup._whole(at, at + minute - tick) == (at, at + minute)
    assert rollup._whole(at + tick, at + minute) == (at + minute, at + minute)
