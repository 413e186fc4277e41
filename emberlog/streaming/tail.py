"""Tail: new matching events as text lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import UTC, datetime, timedelta
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.functions.buckets import as_utc, time_literal
from emberlog.functions.filters import as_condition
from emberlog.functions.render import field_line
from emberlog.operators.timerange import periods_from, time_type
from emberlog.schema import LOG_COLUMNS, LogColumns
from emberlog.session import checkpoint_folder

# Poll interval, lines per poll and greatest age of a line.
POLL_MS = 500
MAX_LINES = 1000
MAX_AGE = "1 hour"


def after_id(logs: DataFrame, last_id: int, cols: LogColumns = LOG_COLUMNS) -> DataFrame:
    """Cursor filter for polls of a table: rows past the last seen id."""
    return logs.where(F.col(cols.id) > last_id)


def younger_than(
    logs: DataFrame,
    max_age: timedelta | str,
    now: datetime | str | None = None,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """Rows with ``tstamp > now - max_age``; the age may be interval text.

    Bounds on the period columns keep the scan to the directories of that time.
    """
    current = as_utc(now if now is not None else datetime.now(UTC))
    kind = time_type(logs, cols)
    if isinstance(max_age, timedelta):
        oldest = time_literal(current - max_age, kind)
    else:
        oldest = time_literal(current, kind) - F.lit(max_age).cast("interval")
    return logs.where((F.col(cols.tstamp) > oldest) & periods_from(logs, oldest))


def tail_lines(
    logs: DataFrame,
    where: Column | str | None = None,
    max_age: timedelta | str = MAX_AGE,
    max_lines: int | None = MAX_LINES,
    fields: Sequence[str] | None = None,
    last_id: int | None = None,
    now: datetime | str | None = None,
    by_id: bool = False,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """``(id, tstamp, line)`` of the newest ``max_lines`` matches, oldest first.

    Newest is by time, then id; ``by_id`` goes by id alone, for tables whose ids
    follow the order of arrival. ``max_lines=None`` shows all.
    """
    rows = younger_than(logs, max_age, now, cols)
    if last_id is not None:
        rows = after_id(rows, last_id, cols)
    if where is not None:
        rows = rows.where(as_condition(where, cols))
    # the document is rendered only for the rows that are kept
    order = [cols.id] if by_id else [cols.tstamp, cols.id]
    if max_lines is not None:
        rows = rows.orderBy(*[F.desc(c) for c in order]).limit(max_lines)
    return rows.select(
        F.col(cols.id).alias("id"),
        F.col(cols.tstamp).alias("tstamp"),
        field_line(fields, cols).alias("line"),
    ).orderBy(*(["id"] if by_id else ["tstamp", "id"]))


def print_lines(lines: DataFrame, _: int) -> None:
    """Print a poll; it has at most ``max_lines`` rows."""
    for row in lines.select("line").toLocalIterator():
        print(row.line, flush=True)


def start_tail(
    logs: DataFrame,
    where: Column | str | None = None,
    max_age: timedelta | str = MAX_AGE,
    max_lines: int | None = MAX_LINES,
    fields: Sequence[str] | None = None,
    on_lines: Callable[[DataFrame, int], None] = print_lines,
    checkpoint: str | None = None,
    trigger: dict | None = None,
    by_id: bool = False,
    cols: LogColumns = LOG_COLUMNS,
) -> StreamingQuery:
    """Follow a log stream; ``on_lines(lines, batch_id)`` gets each poll.

    The stream's own offsets are the cursor, so no row is skipped or seen twice
    between polls; the cap only applies to what one poll shows. Without a
    checkpoint a new one below the session's shared folder is used.
    """

    def poll(batch: DataFrame, batch_id: int) -> None:
        on_lines(
            tail_lines(batch, where, max_age, max_lines, fields, by_id=by_id, cols=cols),
            batch_id,
        )

    folder = checkpoint or checkpoint_folder(logs.sparkSession, f"tail-{uuid4()}")
    return (
        logs.writeStream.foreachBatch(poll)
        .option("checkpointLocation", folder)
        .trigger(**(trigger or {"processingTime": f"{POLL_MS} milliseconds"}))
        .start()
    )
