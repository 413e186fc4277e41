"""Time partitions of log rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.buckets import PERIODS, check_period, partition_name, period_bounds
from emberlog.operators.timerange import partition_column, partition_value
from emberlog.schema import LOG_COLUMNS, LogColumns


def check_levels(levels: Sequence[str]) -> list[str]:
    """Periods from root to leaf; each must be finer than the one before."""
    for unit in levels:
        check_period(unit)
    places = [PERIODS.index(unit) for unit in levels]
    if not levels or places != sorted(set(places)):
        raise ValueError(f"levels must go from coarse to fine: {list(levels)}")
    return list(levels)


def with_partitions(
    logs: DataFrame, levels: Sequence[str] = ("month",), cols: LogColumns = LOG_COLUMNS
) -> DataFrame:
    """Add one ``p_<period>`` column per level."""
    return logs.withColumns(
        {
            partition_column(unit): partition_value(F.col(cols.tstamp), unit)
            for unit in check_levels(levels)
        }
    )


def partition_bounds(
    logs: DataFrame,
    unit: str = "month",
    template: str | None = None,
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """``(lower, upper[, name], n)`` of every partition the rows fall into."""
    bounds = period_bounds(F.col(cols.tstamp), unit)
    counted = (
        logs.select(bounds.alias("bounds"))
        .groupBy("bounds")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("bounds.lower", "bounds.upper", "n")
    )
    if template is None:
        return counted
    return counted.withColumn("name", partition_name(F.col("lower"), template))
