"""Time filter that prunes partitions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.functions.buckets import PERIODS, as_utc, time_literal
from emberlog.functions.filters import as_condition
from emberlog.schema import LOG_COLUMNS, LogColumns

# Hours and minutes are kept as sortable numbers, longer periods as dates.
_NUMBER_FORMAT = {"hour": ("yyyyMMddHH", "%Y%m%d%H"), "minute": ("yyyyMMddHHmm", "%Y%m%d%H%M")}


def partition_column(unit: str) -> str:
    return f"p_{unit}"


def partition_value(tstamp: Column, unit: str) -> Column:
    """Value of the partition column of a period; grows with the time."""
    if unit in _NUMBER_FORMAT:
        return F.date_format(tstamp, _NUMBER_FORMAT[unit][0]).cast("long")
    return F.date_trunc(unit, tstamp).cast("date")


def _partition_literal(value: datetime | str, unit: str) -> Column:
    if unit in _NUMBER_FORMAT:
        return F.lit(int(as_utc(value).strftime(_NUMBER_FORMAT[unit][1])))
    return F.date_trunc(unit, time_literal(value, "timestamp_ntz")).cast("date")


def period_path(spark: SparkSession, value: datetime | str, units: Sequence[str]) -> str:
    """Directory of the period that holds a time; as text it grows with the time."""
    if not units:
        return ""
    texts = [_partition_literal(value, unit).cast("string") for unit in units]
    found = spark.range(1).select(*texts).first()
    return "/".join(f"{partition_column(unit)}={text}" for unit, text in zip(units, found))


def periods_from(df: DataFrame, oldest: Column) -> Column:
    """Condition on the period columns of a frame that no row since ``oldest`` fails."""
    found = F.lit(True)
    for unit in PERIODS:
        if partition_column(unit) in df.columns:
            found = found & (F.col(partition_column(unit)) >= partition_value(oldest, unit))
    return found


def partition_columns(df: DataFrame) -> list[str]:
    """The period columns a log frame has, coarse to fine."""
    return [partition_column(u) for u in PERIODS if partition_column(u) in df.columns]


def time_type(df: DataFrame, cols: LogColumns = LOG_COLUMNS) -> str:
    kind = df.schema[cols.tstamp].dataType.simpleString()
    if kind not in ("timestamp", "timestamp_ntz"):
        raise ValueError(f"{cols.tstamp} must be a timestamp, not {kind}")
    return kind


def time_range(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """Rows with ``start <= tstamp <= end`` and the filter.

    Bounds on the period columns are added where the frame has them, because a
    filter on the time alone does not prune directories derived from it.
    """
    kind = time_type(logs, cols)
    in_range = F.col(cols.tstamp).between(time_literal(start, kind), time_literal(end, kind))
    for unit in PERIODS:
        name = partition_column(unit)
        if name in logs.columns:
            in_range = in_range & F.col(name).between(
                _partition_literal(start, unit), _partition_literal(end, unit)
            )
    rows = logs.where(in_range)
    return rows if where is None else rows.where(as_condition(where, cols))
