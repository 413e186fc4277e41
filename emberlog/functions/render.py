"""Log rows as text lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.fields import field_printable
from emberlog.schema import LOG_COLUMNS, LogColumns

# Fields of a line and how a missing one is shown.
LINE_FIELDS = ("hostname", "syslogtag", "msg")
MISSING = "None"
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def line_time(cols: LogColumns = LOG_COLUMNS) -> Column:
    return F.date_format(F.col(cols.tstamp), TIME_FORMAT)


def event_line(cols: LogColumns = LOG_COLUMNS) -> Column:
    """``time host tag msg``; absent parts are left out."""
    return F.concat_ws(" ", line_time(cols), *[field_printable(f, cols) for f in LINE_FIELDS])


def field_line(
    fields: Sequence[str] | None = None, cols: LogColumns = LOG_COLUMNS
) -> Column:
    """``time`` and the chosen fields; an absent field prints ``None``."""
    shown = [
        F.coalesce(field_printable(f, cols), F.lit(MISSING)) for f in fields or LINE_FIELDS
    ]
    return F.concat_ws(" ", line_time(cols), *shown)
