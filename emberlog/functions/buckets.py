"""Time arithmetic: range literals, bucket widths and partition periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DAY = 24 * 3600
_MONTH = 30 * _DAY
_YEAR = 365 * _DAY


@dataclass(frozen=True)
class BucketWidth:
    """A histogram step: nominal seconds, truncation unit, steps of that unit."""

    seconds: int
    unit: str
    count: int

    @property
    def is_calendar(self) -> bool:
        return self.unit in ("month", "year")

    @property
    def months(self) -> int:
        return self.count * (12 if self.unit == "year" else 1)

    @property
    def label(self) -> str:
        return f"{self.count} {self.unit}"


_UNIT_SECONDS = {
    "second": 1,
    "minute": 60,
    "hour": 3600,
    "day": _DAY,
    "week": 7 * _DAY,
    "month": _MONTH,
    "year": _YEAR,
}

# The widths a histogram may have, narrowest first.
_LADDER = {
    "second": [1, 2, 5, 10, 30],
    "minute": [1, 2, 5, 10, 30],
    "hour": [1, 2, 5, 10],
    "day": [1, 2],
    "week": [1, 2],
    "month": [1, 2, 3, 4, 6],
    "year": [1, 2, 5, 10, 20, 50],
}
MAX_BUCKETS = 120
WIDTHS = [
    BucketWidth(_UNIT_SECONDS[unit] * n, unit, n)
    for unit, counts in _LADDER.items()
    for n in counts
]
WIDEST = BucketWidth(100 * _YEAR, "year", 100)


def bucket_width(start: datetime | str, end: datetime | str) -> BucketWidth:
    """Narrowest width that gives fewer than 120 buckets for the range."""
    span = abs(as_utc(end) - as_utc(start))
    seconds = span.days * _DAY + span.seconds
    for width in WIDTHS:
        if seconds // width.seconds < MAX_BUCKETS:
            return width
    return WIDEST


def bucket_seconds(duration_seconds: Column) -> Column:
    """Width in seconds for a duration column, by the same rule."""
    span = F.abs(duration_seconds)
    chosen = F.when(span < WIDTHS[0].seconds * MAX_BUCKETS, WIDTHS[0].seconds)
    for width in WIDTHS[1:]:
        chosen = chosen.when(span < width.seconds * MAX_BUCKETS, width.seconds)
    return chosen.otherwise(WIDEST.seconds).cast("long")


def as_utc(value: datetime | str) -> datetime:
    """A point in time as naive UTC; naive input and text without offset are UTC."""
    if isinstance(value, str):
        value = datetime.fromisoformat(value)
    if value.tzinfo is not None:
        value = value.astimezone(UTC).replace(tzinfo=None)
    return value


def time_literal(value: datetime | str, data_type: str) -> Column:
    """Literal of the same type as the time column, so that filters push down."""
    text = as_utc(value).isoformat(sep=" ")
    if data_type == "timestamp_ntz":
        return F.lit(text).cast("timestamp_ntz")
    return F.lit(text + "Z").cast("timestamp")


def micros(value: datetime | str) -> int:
    return (as_utc(value) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


# Partition periods, coarse to fine.
PERIODS = ("year", "quarter", "month", "week", "day", "hour", "minute")
_PERIOD_STEP = {
    "year": "INTERVAL 1 YEAR",
    "quarter": "INTERVAL 3 MONTH",
    "month": "INTERVAL 1 MONTH",
    "week": "INTERVAL 7 DAY",
    "day": "INTERVAL 1 DAY",
    "hour": "INTERVAL 1 HOUR",
    "minute": "INTERVAL 1 MINUTE",
}


def check_period(unit: str) -> str:
    if unit not in PERIODS:
        raise ValueError(f"unknown period {unit!r}, one of {PERIODS}")
    return unit


def period_floor(tstamp: Column, unit: str) -> Column:
    """Start of the period that holds the time, inclusive."""
    return F.date_trunc(check_period(unit), tstamp)


def period_ceiling(tstamp: Column, unit: str) -> Column:
    """Start of the next period, exclusive."""
    return period_floor(tstamp, unit) + F.expr(_PERIOD_STEP[unit])


def period_bounds(tstamp: Column, unit: str) -> Column:
    return F.struct(
        period_floor(tstamp, unit).alias("lower"),
        period_ceiling(tstamp, unit).alias("upper"),
    )


# Components of a partition name template.
_TEMPLATE_PARTS = {
    "[year]": "yyyy",
    "[month]": "MM",
    "[day]": "dd",
    "[hour]": "HH",
    "[minute]": "mm",
    "[second]": "ss",
    "[ordinal]": "DDD",
}


def partition_name(tstamp: Column, template: str) -> Column:
    """Time through a name template such as ``logs_[year]_[month]``."""
    parts, rest = [], template
    while rest:
        literal, bracket, tail = rest.partition("[")
        if literal:
            parts.append(F.lit(literal))
        if not bracket:
            break
        name, closed, rest = tail.partition("]")
        component = f"[{name}]"
        if not closed or component not in _TEMPLATE_PARTS:
            raise ValueError(f"unknown template component {component!r}")
        parts.append(F.date_format(tstamp, _TEMPLATE_PARTS[component]))
    return F.concat(*parts) if parts else F.lit("")


def floor_micros(value: datetime | str, unit: str) -> int:
    """Epoch microseconds of a time cut down to a fixed-length unit."""
    size = _UNIT_SECONDS[unit] * 1_000_000
    # weeks start on Monday, the epoch was a Thursday
    shift = 3 * _DAY * 1_000_000 if unit == "week" else 0
    return (micros(value) + shift) // size * size - shift
