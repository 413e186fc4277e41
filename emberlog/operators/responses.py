"""Nested JSON documents for clients: thin layers over the flat results.

A document is one row, so everything collected into it is bounded: events by
``limit``, field values by ``k``, histogram cells by buckets times ids. Results
without a bound are lines; see :func:`events_response_lines`.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.buckets import bucket_width
from emberlog.functions.flatten import json_quote
from emberlog.functions.syslog import format_rfc3339
from emberlog.operators.events import field_summary, latest_events, range_metadata
from emberlog.operators.histogram import time_histogram
from emberlog.schema import LOG_COLUMNS, LogColumns


def _event_json() -> Column:
    # the stored document is canonical JSON text and goes in as it is
    return F.concat(
        F.lit('{"timestamp":"'),
        format_rfc3339(F.col("timestamp")),
        F.lit('","id":'),
        F.col("id"),
        F.lit(',"source":'),
        F.col("source"),
        F.lit("}"),
    )


def event_json_lines(events: DataFrame) -> DataFrame:
    """One JSON object ``{timestamp,id,source}`` per event, for any number."""
    return events.select(_event_json().alias("value"))


def events_document(events: DataFrame) -> DataFrame:
    """``json``: array of the events, newest first; null when there are none."""
    # sorted inside the row, as collect_list has no order of its own
    items = F.collect_list(
        F.struct(F.col("timestamp").alias("t"), F.col("id").alias("i"), _event_json().alias("j"))
    )
    texts = F.transform(F.sort_array(items, asc=False), lambda e: e["j"])
    return events.agg(
        F.when(
            F.size(texts) > 0, F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]"))
        )
        .otherwise("null")
        .alias("json")
    )


def _object(key: Column, json: Column) -> Column:
    """Aggregate of keys and JSON texts to one JSON object, sorted by key."""
    entries = F.array_sort(
        F.collect_list(F.struct(key.alias("k"), F.coalesce(json, F.lit("null")).alias("j")))
    )
    texts = F.transform(entries, lambda e: F.concat(json_quote(e["k"]), F.lit(":"), e["j"]))
    return F.when(
        F.size(texts) > 0, F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}"))
    ).otherwise("null")


def fields_document(summary: DataFrame) -> DataFrame:
    """``json``: ``{field: {value: count}}`` of a field summary."""
    per_field = summary.groupBy("field").agg(
        _object(F.col("value"), F.col("n").cast("string")).alias("json")
    )
    return per_field.agg(_object(F.col("field"), F.col("json")).alias("json"))


def metadata_document(metadata: DataFrame) -> DataFrame:
    """``json``: ``{key: value}`` of range metadata."""
    return metadata.agg(_object(F.col("key"), F.col("value").cast("string")).alias("json"))


def counts_document(histogram: DataFrame) -> DataFrame:
    """``json``: ``{tstamp: {id: value}}`` of a histogram."""
    per_time = histogram.groupBy("tstamp").agg(
        _object(F.col("id"), F.col("value").cast("string")).alias("json")
    )
    time = format_rfc3339(F.col("tstamp"))
    return per_time.agg(_object(time, F.col("json")).alias("json"))


def _join_documents(parts: dict[str, DataFrame]) -> DataFrame:
    """One-row frames to one JSON object, in the given order."""
    rows = None
    for n, (name, frame) in enumerate(parts.items()):
        row = frame.select(F.lit(n).alias("n"), F.concat(F.lit(f'"{name}":'), "json").alias("j"))
        rows = row if rows is None else rows.union(row)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("n", "j"))), lambda p: p["j"])
    return rows.agg(F.concat(F.lit("{"), F.array_join(texts, ","), F.lit("}")).alias("json"))


def events_response(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    limit: int | None = None,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """``{"events":[..],"fields":{..},"metadata":{..}}`` as one row ``json``.

    Without a limit the document is given as rows ``json`` in order, which are its text
    one after the other; see :func:`events_response_lines`.
    """
    if limit is None:
        return events_response_lines(logs, start, end, where, cols).select("json")
    return _join_documents(
        {
            "events": events_document(latest_events(logs, start, end, where, limit, cols)),
            "fields": fields_document(field_summary(logs, start, end, where, cols=cols)),
            "metadata": metadata_document(range_metadata(logs, start, end, cols=cols)),
        }
    )


def events_response_lines(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """``(part, timestamp, id, json)`` in order: the document of all events as lines.

    Part 1 has a line per event, so no row holds more than one; the lines before and
    after have what the summaries bound. Every event but the newest begins with a comma.
    """
    events = latest_events(logs, start, end, where, cols=cols)
    newest = events.agg(F.max(F.struct("timestamp", "id")).alias("first"))
    first = F.struct("timestamp", "id") == newest.scalar()
    lines = events.select(
        F.lit(1).alias("part"),
        "timestamp",
        "id",
        F.concat(F.when(first, "").otherwise(","), _event_json()).alias("json"),
    )
    rest = _join_documents(
        {
            "fields": fields_document(field_summary(logs, start, end, where, cols=cols)),
            "metadata": metadata_document(range_metadata(logs, start, end, cols=cols)),
        }
    )

    def edge(part: int, frame: DataFrame, json: Column) -> DataFrame:
        none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("timestamp", "id")]
        return frame.select(F.lit(part).alias("part"), *none, json.alias("json"))

    some = F.col("first").isNotNull()
    opening = F.concat(F.lit('{"events":'), F.when(some, "[").otherwise("null"))
    closing = F.concat(
        F.when(newest.scalar().isNotNull(), "],").otherwise(","), F.substr("json", F.lit(2))
    )
    return (
        edge(0, newest, opening)
        .union(lines)
        .union(edge(2, rest, closing))
        .orderBy("part", F.desc("timestamp"), F.desc("id"))
    )


def counts_response(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    **options,
) -> DataFrame:
    """``{"metadata":{..},"counts":{..}}`` as one row ``json``.

    Split without ``max_buckets``, the document is given as rows ``json`` in order, which
    are its text one after the other; see :func:`counts_response_lines`.
    """
    if options.get("split_by") is not None and options.get("max_buckets") is None:
        return counts_response_lines(logs, start, end, where, **options).select("json")
    histogram = time_histogram(logs, start, end, where, ordered=False, **options)
    seconds = bucket_width(start, end).seconds
    return counts_document(histogram).select(
        F.concat(
            F.lit(f'{{"metadata":{{"counts_interval_sec":{seconds}}},"counts":'),
            "json",
            F.lit("}"),
        ).alias("json")
    )


def counts_response_lines(
    logs: DataFrame,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    **options,
) -> DataFrame:
    """``(part, tstamp, id, json)`` in order: the document of a histogram as lines.

    Part 1 has a line per time and id. The first id of a time opens the time's object;
    there are only as many times as the width of the buckets allows.
    """
    histogram = time_histogram(logs, start, end, where, ordered=False, **options)
    firsts = histogram.groupBy("tstamp").agg(F.min("id").alias("first_id"))
    earliest = firsts.agg(F.min("tstamp").alias("first"))
    opens = F.concat(
        F.when(F.col("tstamp") == earliest.scalar(), "").otherwise("},"),
        F.lit('"'),
        format_rfc3339(F.col("tstamp")),
        F.lit('":{'),
    )
    value = F.coalesce(F.col("value").cast("string"), F.lit("null"))
    lines = histogram.join(firsts, "tstamp").select(
        F.lit(1).alias("part"),
        "tstamp",
        "id",
        F.concat(
            F.when(F.col("id") == F.col("first_id"), opens).otherwise(","),
            json_quote(F.col("id")),
            F.lit(":"),
            value,
        ).alias("json"),
    )
    seconds = bucket_width(start, end).seconds
    some, head = F.col("first").isNotNull(), f'{{"metadata":{{"counts_interval_sec":{seconds}}},'
    edges = [
        F.concat(F.lit(head + '"counts":'), F.when(some, "{").otherwise("null")),
        F.when(some, "}}}").otherwise("}"),
    ]
    for part, json in zip((0, 2), edges):
        none = [F.lit(None).cast(lines.schema[c].dataType).alias(c) for c in ("tstamp", "id")]
        edge = earliest.select(F.lit(part).alias("part"), *none, json.alias("json"))
        lines = lines.union(edge)
    return lines.orderBy("part", "tstamp", "id")
