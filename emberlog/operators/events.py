"""Search: newest events, top values per field, range metadata."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlog.functions.buckets import bucket_width
from emberlog.functions.fields import is_array
from emberlog.operators.timerange import time_range
from emberlog.schema import LOG_COLUMNS, LogColumns

# Sample of the field summary and values kept per field.
SUMMARY_SAMPLE = 500
SUMMARY_VALUES = 5


def _newest(rows: DataFrame, limit: int | None, cols: LogColumns) -> DataFrame:
    """The newest rows, in order.

    With a limit the time of the last row to keep is found first, from times and ids
    alone; whole rows are then read only from that time on.
    """
    if limit is not None and limit < 0:
        raise ValueError("limit must not be negative")
    order = F.desc(cols.tstamp), F.desc(cols.id)
    if limit is None:
        return rows.orderBy(*order)
    kept = rows.select(cols.tstamp, cols.id).orderBy(*order).limit(limit)
    oldest = kept.agg(F.min(cols.tstamp)).scalar()
    return rows.where(F.col(cols.tstamp) >= oldest).orderBy(*order).limit(limit)


def latest_events(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    limit: int | None = None,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """``(id, timestamp, source)``, newest first; ``limit=None`` gives all."""
    rows = time_range(logs, start, end, where, cols)
    return _newest(rows, limit, cols).select(
        F.col(cols.id).alias("id"),
        F.col(cols.tstamp).alias("timestamp"),
        F.col(cols.doc).alias("source"),
    )


def field_values(rows: DataFrame, cols: LogColumns = LOG_COLUMNS) -> DataFrame:
    """``(field, value)``: one row per field value, arrays unnested.

    An empty array gives no row; JSON null gives an empty text.
    """
    texts = F.from_json(F.col(cols.doc), "map<string,string>")
    kinds = F.col(cols.doc_v).cast("map<string,variant>")
    pairs = F.map_zip_with(
        texts,
        kinds,
        lambda _, t, v: F.when(is_array(v), F.from_json(t, "array<string>")).otherwise(F.array(t)),
    )
    return rows.select(F.explode(pairs).alias("field", "items")).select(
        "field", F.explode("items").alias("item")
    ).select("field", F.coalesce("item", F.lit("")).alias("value"))


def field_summary(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    sample: int | None = SUMMARY_SAMPLE,
    k: int = SUMMARY_VALUES,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """``(field, value, n, rank)``: the ``k`` most frequent values of each field.

    Looks at the newest ``sample`` events, or at all of them with
    ``sample=None``. Values are counted before the ranking, and Spark keeps
    only ``k`` per field and task before it shuffles for the rank.
    """
    rows = time_range(logs, start, end, where, cols)
    if sample is not None:
        rows = _newest(rows.select(cols.tstamp, cols.id, cols.doc, cols.doc_v), sample, cols)
    counted = field_values(rows, cols).groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))
    by_count = Window.partitionBy("field").orderBy(F.desc("n"), "value")
    return counted.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= k)


def range_metadata(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """``(key, value)`` rows: exact ``event_count`` and ``counts_interval_sec``.

    The count takes the time range only, unless a filter is given.
    """
    count = time_range(logs, start, end, where, cols).agg(
        F.lit("event_count").alias("key"), F.count(F.lit(1)).alias("value")
    )
    width = logs.sparkSession.range(1).select(
        F.lit("counts_interval_sec").alias("key"),
        F.lit(bucket_width(start, end).seconds).cast("long").alias("value"),
    )
    return count.union(width).distinct()
