"""Questions that a committed log table answers from few of its files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.buckets import PERIODS, micros
from emberlog.operators.events import latest_events
from emberlog.operators.timerange import partition_column, period_path, time_range
from emberlog.schema import STORED_COLUMNS, LogColumns
from emberlog.sources.committed import RANK_ERROR, SKETCH_SIZE, CommittedTable


def periods_newest_first(
    table: CommittedTable, start: datetime | str, end: datetime | str
) -> list[list[str]]:
    """Directories of the periods that a range touches, by period; opens no file."""
    units = [name.removeprefix(partition_column("")) for name in table.partitions]
    if any(unit not in PERIODS for unit in units):
        raise ValueError(f"not stored by period: {table.partitions}")
    first, last = (period_path(table.spark, at, units) for at in (start, end))
    found: dict[str, list[str]] = {}
    for directory in table.state().directories.values():
        if first <= directory.period <= last:
            found.setdefault(directory.period, []).append(directory.path)
    return [sorted(found[period]) for period in sorted(found, reverse=True)]


def latest_stored(
    table: CommittedTable,
    start: datetime | str,
    end: datetime | str,
    where: Column | str | None = None,
    limit: int | None = None,
    cols: LogColumns = STORED_COLUMNS,
) -> DataFrame:
    """:func:`latest_events` of a stored table, from its newest periods only.

    A row of a period is older than all rows of later periods, so once ``limit`` matches
    are found no older period can add one. Periods are tried from the newest, twice as
    many at a time, and only the filter's columns are read for it; a match that is rare
    costs a job per doubling, and at worst each period is read once before the result.
    """
    periods = periods_newest_first(table, start, end)
    taken, step = len(periods), 1
    if limit is not None:
        taken, matches = 0, 0
        while taken < len(periods) and matches < limit:
            paths = sum(periods[taken : taken + step], [])
            hits = time_range(table.scan(paths), start, end, where, cols)
            matches += hits.select(cols.id).limit(limit - matches).count()
            taken, step = min(taken + step, len(periods)), step * 2
    return latest_events(table.scan(sum(periods[:taken], [])), start, end, where, limit, cols)


def range_estimate(table: CommittedTable, start: datetime | str, end: datetime | str) -> DataFrame:
    """One row ``(n, max_error)``: about how many rows a range has, from statistics alone.

    Directories inside the range count exactly. Those that an end of the range cuts are
    estimated by their sketch of time; ``max_error`` bounds the error with 99 % confidence
    an end. No log file is opened. A range that ends before it starts has no rows.
    """
    lower, upper = F.lit(micros(start) - 1), F.lit(micros(end))
    cuts = (F.col("oldest") <= lower).cast("int") + (F.col("newest") > upper).cast("int")
    rank = F.kll_sketch_get_rank_bigint
    share = F.greatest(rank("times", upper) - rank("times", lower), F.lit(0.0))
    inexact = F.when(F.col("rows") > SKETCH_SIZE, F.ceil(F.col("rows") * RANK_ERROR) * cuts)
    touched = table.statistics().where((F.col("newest") > lower) & (F.col("oldest") <= upper))
    return touched.select(
        F.when(cuts == 0, F.col("rows")).otherwise(F.round(F.col("rows") * share)).alias("n"),
        F.coalesce(inexact, F.lit(0)).alias("max_error"),
    ).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n", "max_error")]
    )
