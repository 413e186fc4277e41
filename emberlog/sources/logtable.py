"""The log table: partitioned Parquet, read in batch or as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.fields import field_text
from emberlog.operators.partitions import check_levels, with_partitions
from emberlog.operators.timerange import partition_column, partition_columns
from emberlog.schema import DEFAULT_PROMOTED, LOG_SCHEMA


def log_schema(
    levels: Sequence[str] = ("month",), promoted: Sequence[str] = DEFAULT_PROMOTED
) -> T.StructType:
    """Schema of a stored log table."""
    periods = [
        T.StructField(
            partition_column(u), T.LongType() if u in ("hour", "minute") else T.DateType()
        )
        for u in check_levels(levels)
    ]
    columns = [T.StructField(name, T.StringType()) for name in promoted]
    return T.StructType([*LOG_SCHEMA.fields, *columns, *periods])


def prepare_logs(
    logs: DataFrame,
    levels: Sequence[str] = ("month",),
    promoted: Sequence[str] = DEFAULT_PROMOTED,
) -> DataFrame:
    """Log rows as they are stored: promoted fields and period columns added,
    gathered by period and sorted by time.

    The rebalance hint lets adaptive execution split a period that holds much of
    the data over many tasks and merge small ones, so no period becomes one task.
    What follows from the document is computed after that, so it is neither shuffled nor
    sorted: the promoted fields, and ``doc_v`` where ``logs`` has none.
    """
    given = [c for c in LOG_SCHEMA.names if c != "doc_v" or c in logs.columns]
    periods = [partition_column(u) for u in check_levels(levels)]
    gathered = (
        with_partitions(logs.select(*given), levels)
        .hint("rebalance", *[F.col(p) for p in periods])
        .sortWithinPartitions(*periods, "tstamp")
    )
    if "doc_v" not in given:
        gathered = as_logs(gathered)
    fields = [field_text(name).alias(name) for name in promoted]
    return gathered.select(*LOG_SCHEMA.names, *fields, *periods)


def write_logs(
    logs: DataFrame,
    path: str,
    levels: Sequence[str] = ("month",),
    promoted: Sequence[str] = DEFAULT_PROMOTED,
    mode: str = "append",
) -> None:
    """Append log rows; directories of new periods appear by themselves. ``doc_v`` may be left
    out where it is the parsed ``doc``."""
    prepared = prepare_logs(logs, levels, promoted)
    periods = [partition_column(u) for u in levels]
    prepared.write.mode(mode).option("compression", "zstd").partitionBy(*periods).parquet(path)


def read_logs(
    spark: SparkSession,
    path: str,
    levels: Sequence[str] = ("month",),
    promoted: Sequence[str] = DEFAULT_PROMOTED,
) -> DataFrame:
    """Scan of a stored log table, without schema inference."""
    return spark.read.schema(log_schema(levels, promoted)).parquet(path)


def stream_logs(
    spark: SparkSession,
    path: str,
    levels: Sequence[str] = ("month",),
    promoted: Sequence[str] = DEFAULT_PROMOTED,
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """New rows of a stored log table as a stream."""
    reader = spark.readStream.schema(log_schema(levels, promoted))
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def as_logs(frame: DataFrame) -> DataFrame:
    """Give a frame with ``id, tstamp, doc`` the derived log columns."""
    return frame.withColumns({"doc_v": F.parse_json("doc")})


def partition_summary(logs: DataFrame) -> DataFrame:
    """Rows per stored partition; answered from period columns alone."""
    periods = partition_columns(logs)
    return logs.groupBy(*periods).agg(F.count(F.lit(1)).alias("n"))
