"""Zero-filled time histogram with optional split and aggregate.

One scan, one aggregation on (id, bucket) with map-side combine, one small
regrouping per id. Buckets come from integer arithmetic, so no range join, cross
join or broadcast is involved; a hot id shrinks to at most one row per bucket
and task before anything is shuffled.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.buckets import (
    BucketWidth,
    as_utc,
    bucket_seconds,
    bucket_width,
    floor_micros,
    micros,
    time_literal,
)
from emberlog.functions.fields import field_text
from emberlog.operators.timerange import time_range, time_type
from emberlog.schema import LOG_COLUMNS, LogColumns

# The id without a split and the id of rows without the split field.
NO_SPLIT_ID = "value"
NO_FIELD_ID = "(null)"

AGGREGATES = ("count", "sum", "avg", "min", "max")


class Spine:
    """Bucket positions ``0..last`` of a range, each labelled by its upper edge.

    A row goes to the first position whose edge is not before its truncated
    time. With ``compat`` a row on an edge also goes to the next position, and
    there is no position for rows after the last whole step.
    """

    def __init__(
        self, start: datetime | str, end: datetime | str, width: BucketWidth, compat: bool
    ) -> None:
        self.width, self.compat = width, compat
        self.start, self.end = as_utc(start), as_utc(end)
        self.is_empty = self.end < self.start
        if width.is_calendar:
            self.step, origin = width.months, self._months(self.start)
            span = tail = self._months(self.end) - origin
        else:
            self.step, origin = width.seconds * 1_000_000, micros(self.start)
            span = micros(self.end) - origin
            tail = floor_micros(self.end, width.unit) - origin
        self.origin = origin
        self.last = span // self.step
        if not compat and tail > self.last * self.step:
            self.last += 1

    def _months(self, at: datetime) -> int:
        return at.year * 12 + (at.month - 1 if self.width.unit == "month" else 0)

    def offset(self, tstamp: Column) -> Column:
        """Truncated time as distance from the first edge, in months or micros."""
        at = F.date_trunc(self.width.unit, tstamp.cast("timestamp"))
        if not self.width.is_calendar:
            return F.unix_micros(at) - F.lit(self.origin)
        months = F.year(at).cast("long") * 12
        if self.width.unit == "month":
            months = months + F.month(at) - 1
        return months - F.lit(self.origin)

    def positions(self, offset: Column) -> Column:
        """Array of the positions of a row; the first one is its own."""
        up = F.call_function("div", offset + F.lit(self.step - 1), F.lit(self.step))
        own = F.when(offset > 0, up).otherwise(F.lit(0)).cast("int")
        if not self.compat:
            return F.array(own)
        on_edge = (offset >= 0) & (offset % F.lit(self.step) == 0)
        return F.when(on_edge, F.array(own, own + 1)).otherwise(F.array(own))

    def label(self, position: Column) -> Column:
        if self.width.is_calendar:
            first = F.date_trunc(self.width.unit, time_literal(self.start, "timestamp"))
            return first + F.make_ym_interval(F.lit(0), position * F.lit(self.step))
        edge = F.timestamp_micros(
            F.lit(self.origin) + position.cast("long") * F.lit(self.step)
        )
        return F.date_trunc(self.width.unit, edge)


def _measures(aggregate: str, x: Column | None, rows: Column | None) -> dict[str, Column]:
    """Mergeable measures of ``x`` over the rows that ``rows`` selects."""
    if x is None:
        return {"n": F.count(F.lit(1)) if rows is None else F.count(F.when(rows, 1))}
    kept = x if rows is None else F.when(rows, x)
    return {
        "count": {"n": F.count(kept)},
        "sum": {"s": F.sum(kept)},
        "avg": {"n": F.count(kept), "s": F.sum(kept)},
        "min": {"v": F.min(kept)},
        "max": {"v": F.max(kept)},
    }[aggregate]


def _cell_value(aggregate: str, suffix: str = "") -> Column:
    n, s, v = (F.col(name + suffix) for name in ("n", "s", "v"))
    return {"count": n, "sum": s, "avg": F.try_divide(s, n), "min": v, "max": v}[aggregate]


def _total(aggregate: str, suffix: str = "") -> Column:
    n, s, v = (F.col(name + suffix) for name in ("n", "s", "v"))
    return {
        "count": lambda: F.sum(n),
        "sum": lambda: F.sum(s),
        "avg": lambda: F.try_divide(F.sum(s), F.sum(n)),
        "min": lambda: F.min(v),
        "max": lambda: F.max(v),
    }[aggregate]()


def time_histogram(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    split_by: str | None = None,
    max_buckets: int | None = None,
    value: str | None = None,
    aggregate: str | None = None,
    missing_is_zero: bool = False,
    compat: bool = False,
    ordered: bool = True,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """``(tstamp, id, value)``: one row per bucket and split id.

    ``split_by`` names a field; ``max_buckets`` keeps the ids with the largest
    totals over the range. Without ``value`` rows are counted; with it,
    ``aggregate`` of the numeric field is taken, NULL in empty buckets unless
    ``missing_is_zero``. Counts are always zero-filled.
    """
    if value is not None and aggregate is None:
        raise ValueError("value needs an aggregate")
    if value is None:
        aggregate = "count"
    if aggregate not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate!r}, one of {AGGREGATES}")
    if max_buckets is not None and max_buckets < 0:
        raise ValueError("max_buckets must not be negative")

    spine = Spine(start, end, bucket_width(start, end), compat)
    keys = [] if split_by is None else ["id"]

    rows = time_range(logs, start, end, where, cols).select(
        *([F.coalesce(field_text(split_by, cols), F.lit(NO_FIELD_ID)).alias("id")] if keys else []),
        *([field_text(value, cols).try_cast("double").alias("x")] if value else []),
        spine.positions(spine.offset(F.col(cols.tstamp))).alias("positions"),
    )
    x = F.col("x") if value else None
    if compat:
        placed = rows.select(
            *keys, *(["x"] if value else []), F.posexplode("positions").alias("nth", "bucket")
        )
        own = _measures(aggregate, x, F.col("nth") == 0)
        extra = [m.alias(name + "_own") for name, m in own.items()]
        suffix = "_own"
    else:
        placed = rows.withColumn("bucket", F.col("positions")[0])
        extra, suffix = [], ""
    cells = placed.groupBy(*keys, "bucket").agg(
        *[m.alias(name) for name, m in _measures(aggregate, x, None).items()], *extra
    )

    return zero_filled(
        cells, spine, keys, aggregate, max_buckets, missing_is_zero, suffix, time_type(logs, cols), ordered
    )


def zero_filled(
    cells: DataFrame,
    spine: Spine,
    keys: list[str],
    aggregate: str,
    max_buckets: int | None,
    missing_is_zero: bool,
    suffix: str = "",
    kind: str = "timestamp",
    ordered: bool = True,
) -> DataFrame:
    """The histogram of ``cells``: one row per key and bucket, with its measures."""
    # At most one entry per position of the spine, so the map is small.
    per_id = cells.groupBy(*keys).agg(
        F.map_from_entries(
            F.collect_list(F.struct("bucket", _cell_value(aggregate).alias("value")))
        ).alias("cells"),
        _total(aggregate, suffix).alias("total"),
    )
    if not keys:
        per_id = per_id.withColumn("id", F.lit(NO_SPLIT_ID))
    if max_buckets is not None:
        per_id = per_id.orderBy(F.desc_nulls_first("total"), "id").limit(max_buckets)

    found = F.col("cells")[F.col("bucket")]
    if aggregate == "count" or missing_is_zero:
        found = F.coalesce(found, F.lit(0))
    positions = F.sequence(F.lit(0), F.lit(max(spine.last, 0)))
    result = (
        per_id.where(F.lit(not spine.is_empty))
        .select("id", "cells", F.explode(positions).alias("bucket"))
        .select(spine.label(F.col("bucket")).cast(kind).alias("tstamp"), "id", found.alias("value"))
    )
    return result.orderBy("tstamp", "id") if ordered else result


def counts_metadata(logs: DataFrame, start: datetime | str, end: datetime | str) -> DataFrame:
    """One row ``(key, value)``: the bucket width of a histogram in seconds."""
    return logs.sparkSession.range(1).select(
        F.lit("counts_interval_sec").alias("key"),
        F.lit(bucket_width(start, end).seconds).cast("long").alias("value"),
    )


def counts_metadata_of(logs: DataFrame, cols: LogColumns = LOG_COLUMNS) -> DataFrame:
    """The same for the time that the rows take up, whole seconds apart; one scan."""

    def second(at: Column) -> Column:
        return F.unix_seconds(F.date_trunc("second", at).cast("timestamp"))

    span = second(F.max(cols.tstamp)) - second(F.min(cols.tstamp))
    width = logs.agg(bucket_seconds(span).alias("value"))
    return width.select(F.lit("counts_interval_sec").alias("key"), "value")
