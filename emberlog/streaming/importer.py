"""Continuous import: raw lines to the log table, with quarantine."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from emberlog.operators.ingest import parse_events, split_events
from emberlog.schema import DEFAULT_PROMOTED
from emberlog.sources.committed import CommittedTable, log_table
from emberlog.sources.logtable import write_logs


def _lines_of_bad_rows(batch: DataFrame) -> DataFrame:
    """A batch without the lines of its usable rows, which nobody needs any more: they are a
    good part of what is kept for the writes."""
    return batch.withColumn("value", F.when(F.col("reason").isNotNull(), F.col("value")))


def start_import(
    raw: DataFrame,
    table_path: str,
    quarantine_path: str,
    checkpoint: str,
    levels: Sequence[str] = ("month",),
    promoted: Sequence[str] = DEFAULT_PROMOTED,
    trigger: dict | None = None,
    **options,
) -> StreamingQuery:
    """Start the import of a raw line stream.

    Progress is kept in the checkpoint, on storage all executors share; keep the
    same one to go on after a restart. A batch is acknowledged only after both writes are done, so rows are
    stored at least once; a row stored twice has the same hash id both times.
    """

    numbered = "id" in raw.columns
    # parsing is part of the stream's own plan, so it is built only once
    parsed = parse_events(raw, **options)

    def store(batch: DataFrame, number: int) -> None:
        if not numbered:  # equal lines get ids of their own
            place = F.monotonically_increasing_id()
            batch = batch.withColumn("id", F.xxhash64("id", F.lit(number), place))
        batch = _lines_of_bad_rows(batch)
        # kept for the two writes; lost blocks are computed again
        batch.persist()
        try:
            good, quarantine = split_events(batch)
            write_logs(good, table_path, levels, promoted)
            quarantine.write.mode("append").parquet(quarantine_path)
        finally:
            batch.unpersist()

    return (
        parsed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "500 milliseconds"}))
        .start()
    )


def stream_name(checkpoint: str) -> str:
    """The name by which a table knows the batches of the stream with a checkpoint."""
    return hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]


def start_committed_import(
    raw: DataFrame,
    table_path: str,
    quarantine_path: str,
    checkpoint: str,
    levels: Sequence[str] = ("month",),
    promoted: Sequence[str] = DEFAULT_PROMOTED,
    trigger: dict | None = None,
    before_commit: Callable[[], None] | None = None,
    **options,
) -> StreamingQuery:
    """As :func:`start_import`, but each line is stored exactly once.

    Both tables are committed ones (``sources/committed.py``). A batch becomes visible by
    one commit per table under its number, and Spark gives a batch that it repeats after a
    failure the same lines and number: what is committed is skipped, what is not is staged
    anew. ``before_commit`` is called between staging and commit.
    """
    table = log_table(raw.sparkSession, table_path, levels, promoted)
    quarantine = CommittedTable(raw.sparkSession, quarantine_path)
    stream, numbered = stream_name(checkpoint), "id" in raw.columns
    parsed = parse_events(raw, **options)

    def store(rows: DataFrame, number: int) -> None:
        batch = stream, number
        if table.has_batch(*batch) and quarantine.has_batch(*batch):
            return
        if not numbered:
            place = F.monotonically_increasing_id()
            rows = rows.withColumn("id", F.xxhash64("id", F.lit(number), place))
        rows = _lines_of_bad_rows(rows)
        rows.persist()
        try:
            good, bad = split_events(rows)
            quarantine.append(bad, batch)
            table.append(good, batch, before_commit)
        finally:
            rows.unpersist()

    return (
        parsed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "500 milliseconds"}))
        .start()
    )
