"""Decoding of raw syslog values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.schema import FACILITIES, SEVERITIES

# Fixed value: the accepted timestamp spelling (RFC 3339).
RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"


def _lookup(code: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.create_map(*pairs)[code]


def severity_name(code: Column) -> Column:
    """``"0"``..``"7"`` to its name, NULL for anything else."""
    return _lookup(code, SEVERITIES)


def facility_name(code: Column) -> Column:
    """``"0"``..``"23"`` to its name, NULL for anything else."""
    return _lookup(code, FACILITIES)


def parse_rfc3339(text: Column) -> Column:
    """RFC 3339 text to an instant, NULL for any other spelling."""
    return F.when(text.rlike(RFC3339), F.translate(text, "tz", "TZ").try_cast("timestamp"))


def format_rfc3339(tstamp: Column) -> Column:
    """Instant as UTC text, without trailing zeros in the fraction."""
    full = F.date_format(tstamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.rtrim(F.rtrim(full, F.lit("0")), F.lit(".")), F.lit("Z"))


def trim_first_space(msg: Column) -> Column:
    """Remove one leading space."""
    return F.regexp_replace(msg, "^ ", "")
