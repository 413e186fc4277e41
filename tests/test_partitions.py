"""Time partitions: bounds, names, pruning, round trip."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from emberlog.functions.buckets import (
    PERIODS,
    partition_name,
    period_ceiling,
    period_floor,
)
from emberlog.functions.predicates import eq
from emberlog.operators.events import latest_events
from emberlog.operators.ingest import import_events
from emberlog.operators.partitions import partition_bounds, with_partitions
from emberlog.operators.timerange import time_range
from emberlog.schema import STORED_COLUMNS
from emberlog.sources.logtable import partition_summary, read_logs, write_logs
from emberlog.sources.views import logs_from_events

from conftest import plan_of
from test_ingest import event, raw

# time -> (floor, ceiling) per period, None where it is plain
TIMES = [
    "2024-01-31 10:20:30", "2024-03-31 00:00:00", "2024-12-30 12:00:00",
    "2021-01-01 00:00:00", "2023-12-31 23:59:59",
]


def bounds_of(at, unit):
    day = datetime(at.year, at.month, at.day)
    if unit == "year":
        return datetime(at.year, 1, 1), datetime(at.year + 1, 1, 1)
    if unit in ("quarter", "month"):
        size = 3 if unit == "quarter" else 1
        month = (at.month - 1) // size * size
        end = at.year * 12 + month + size
        return datetime(at.year, month + 1, 1), datetime(end // 12, end % 12 + 1, 1)
    seconds = {"week": 7 * 86400, "day": 86400, "hour": 3600, "minute": 60}[unit]
    if unit == "week":
        lower = datetime.fromordinal(day.toordinal() - day.weekday())
    else:
        passed = (at - day).seconds // seconds * seconds
        lower = datetime.fromtimestamp(day.timestamp() + passed)
    return lower, datetime.fromtimestamp(lower.timestamp() + seconds)


def test_bounds(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string").select(
        "t", F.col("t").cast("timestamp").alias("tstamp")
    )
    for unit in PERIODS:
        rows = df.select(
            "t",
            period_floor(F.col("tstamp"), unit).cast("timestamp_ntz"),
            period_ceiling(F.col("tstamp"), unit).cast("timestamp_ntz"),
        ).collect()
        for t, lower, upper in rows:
            assert (lower, upper) == bounds_of(datetime.fromisoformat(t), unit), (t, unit)
    with pytest.raises(ValueError):
        period_floor(F.col("tstamp"), "decade")


def test_offsets_count_in_utc(spark):
    good, _ = import_events(raw(spark, event(timereported="2023-12-31T23:30:00-02:00")))
    row = with_partitions(good, ["year", "day", "hour", "minute"]).first()
    assert (row.p_year, row.p_day) == (date(2024, 1, 1), date(2024, 1, 1))
    assert (row.p_hour, row.p_minute) == (2024010101, 202401010130)


def test_names(spark):
    df = spark.createDataFrame([("2024-03-05 07:08:09",)], "t string")
    at = F.col("t").cast("timestamp")
    names = ["logs_[year]_[month]", "[day]-[hour]:[minute]:[second] x", "plain"]
    got = df.select(*[partition_name(at, n).alias(str(i)) for i, n in enumerate(names)]).first()
    assert list(got) == ["logs_2024_03", "05-07:08:09 x", "plain"]
    for bad in ("[nope]", "[year"):
        with pytest.raises(ValueError):
            partition_name(at, bad)


def test_partition_bounds(events):
    logs = logs_from_events(events)
    got = partition_bounds(logs, "week", "logs_[year]_[month]_[day]").collect()
    assert sum(r.n for r in got) == events.count()
    assert {r.name for r in got} >= {"logs_2024_01_01", "logs_2024_01_08"}
    assert all((r.upper - r.lower).days == 7 for r in got)


def test_levels_must_get_finer(events):
    logs = logs_from_events(events)
    for bad in ([], ["day", "month"], ["day", "day"], ["century"]):
        with pytest.raises(ValueError):
            with_partitions(logs, bad)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A table of imported events, two per hour over three months."""
    lines = [
        event(
            timereported=f"2024-{m:02d}-{d:02d}T{h:02d}:00:00Z", hostname=f"web{d % 3}", msg=f"m{h}"
        )
        for m in (1, 2, 3) for d in (1, 2, 15) for h in (0, 23)
    ]
    good, _ = import_events(raw(spark, *lines))
    path = str(tmp_path_factory.mktemp("table") / "logs")
    levels = ["month", "day", "hour"]
    write_logs(good, path, levels)
    return good.orderBy("id"), read_logs(spark, path, levels), path


def test_round_trip(stored):
    good, table, _ = stored
    columns = ["id", "tstamp", "doc", "search"]
    assert table.select(columns).orderBy("id").collect() == good.select(columns).collect()
    assert table.where(eq("vars.net.port", 4022)).count() == 18
    assert partition_summary(table).count() == 18


def test_pruning(stored):
    _, table, _ = stored
    rows = time_range(table, "2024-02-01T12:00:00", "2024-02-15T00:00:00")
    assert sorted(r.tstamp for r in rows.collect()) == [
        datetime(2024, 2, 1, 23), datetime(2024, 2, 2, 0), datetime(2024, 2, 2, 23),
        datetime(2024, 2, 15, 0),
    ]
    plan = plan_of(rows)
    filters = next(line for line in plan.splitlines() if line.startswith("PartitionFilters"))
    for name in ("p_month", "p_day", "p_hour"):
        assert name in filters
    assert "PushedFilters: [IsNotNull(tstamp)" in plan
    assert len(rows.inputFiles()) >= 4


def test_promoted_filter_is_pushed(stored):
    _, table, _ = stored
    condition = eq("hostname", "web1", STORED_COLUMNS)
    hit = latest_events(table, "2024-01-01", "2024-12-31", condition, 5)
    assert hit.count() == 5
    assert "EqualTo(hostname,web1)" in plan_of(hit)
    assert table.where(eq("hostname", "web1")).count() == 6


def test_append_adds_partitions(spark, tmp_path):
    path = str(tmp_path / "logs")
    for month in (1, 2):
        good, _ = import_events(raw(spark, event(timereported=f"2024-0{month}-05T00:00:00Z")))
        write_logs(good, path)
    assert read_logs(spark, path).select("p_month").distinct().count() == 2
