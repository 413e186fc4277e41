"""Kept partial aggregates of a committed log table, for histograms of long ranges.

A rollup stores, per cell of time and split value, the mergeable measures of a histogram:
rows, values, sum, least and greatest. It follows the log's versions: a refresh aggregates
the rows of new commits alone and commits them as one batch, so it is neither lost nor
counted twice if it fails midway and is repeated. Cells of the same time from several
refreshes stand beside each other and are merged when read; ``table.compact()`` merges
their files.

A histogram takes whole cells from the rollup, the rows of the cells that the range cuts
from the log, and rows that came after the last refresh from their commits. It equals the
histogram of the rows at any time; only how much it reads depends on the refreshes.
Refresh before ``vacuum`` deletes commits that were compacted but are not rolled up yet.
"""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberlog.functions.buckets import as_utc, bucket_width, check_period, floor_micros
from emberlog.functions.fields import field_text
from emberlog.operators.histogram import AGGREGATES, NO_FIELD_ID, NO_SPLIT_ID, Spine, zero_filled
from emberlog.operators.timerange import partition_column, partition_value, time_range
from emberlog.schema import STORED_COLUMNS, LogColumns
from emberlog.sources.committed import CommittedTable

STREAM = "log"
#: Lengths of cells, shortest first, with their seconds.
CELLS = {"second": 1, "minute": 60, "hour": 3600}
MEASURES = "cell timestamp, id string, n bigint, n_values bigint, total double, least double, greatest double"
TICK = timedelta(microseconds=1)
EPOCH = datetime(1970, 1, 1)


class Rollup:
    """Measures of one split field and one value field of a log, by cell of time.

    Rows without a time are in no cell. ``unit`` is the length of a cell: histograms whose
    buckets are counted in shorter units read rows. ``level`` is the period of directories.
    """

    def __init__(
        self,
        logs: CommittedTable,
        path: str,
        split_by: str | None = None,
        value: str | None = None,
        unit: str = "minute",
        level: str = "day",
        cols: LogColumns = STORED_COLUMNS,
    ) -> None:
        if unit not in CELLS:
            raise ValueError(f"unknown cell {unit!r}, one of {tuple(CELLS)}")
        self.logs, self.split_by, self.value = logs, split_by, value
        self.unit, self.level, self.cols = unit, check_period(level), cols
        number = level in ("hour", "minute")
        period = T.StructField(partition_column(level), T.LongType() if number else T.DateType())
        cells = T.StructType.fromDDL(MEASURES)
        self.table = CommittedTable(
            logs.spark, path, T.StructType([*cells.fields, period]), [period.name], self._prepare, ["cell", "id"]
        )

    def _prepare(self, cells: DataFrame) -> DataFrame:
        name = partition_column(self.level)
        return (
            cells.withColumn(name, partition_value(F.col("cell"), self.level))
            .hint("rebalance", F.col(name))
            .sortWithinPartitions(name, "cell", "id")
        )

    @property
    def covered(self) -> int:
        """The last version of the log that is rolled up."""
        return self.table.state().batches.get(STREAM, -1)

    def refresh(self) -> int | None:
        """Roll up the commits since the last refresh; the version made, if any."""
        upto, after = self.logs.state().version, self.covered
        if upto <= after:
            return None
        return self.table.append(self._cells(self.logs.added(after, upto)), (STREAM, upto))

    def _cells(self, rows: DataFrame) -> DataFrame:
        split = F.lit(NO_SPLIT_ID)
        if self.split_by is not None:
            split = F.coalesce(field_text(self.split_by, self.cols), F.lit(NO_FIELD_ID))
        x = F.lit(None).cast("double")
        if self.value is not None:
            x = field_text(self.value, self.cols).try_cast("double")
        cell = F.date_trunc(self.unit, F.col(self.cols.tstamp))
        return (
            rows.select(cell.alias("cell"), split.alias("id"), x.alias("x"))
            .where("cell is not null")
            .groupBy("cell", "id")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.count("x").alias("n_values"),
                F.sum("x").alias("total"),
                F.min("x").alias("least"),
                F.max("x").alias("greatest"),
            )
        )

    def _whole(self, start: datetime, end: datetime) -> tuple[datetime, datetime]:
        """Edges of the cells that lie wholly in a range."""
        length = timedelta(seconds=CELLS[self.unit])
        first = EPOCH + timedelta(microseconds=floor_micros(start, self.unit))
        last = EPOCH + timedelta(microseconds=floor_micros(end + TICK, self.unit))
        return first if first == start else first + length, last

    def _parts(self, start: datetime, end: datetime, by_cells: bool) -> list[DataFrame]:
        """Cells that together are those of the rows of a range."""
        first, last = self._whole(start, end)
        covered, version = self.covered, self.logs.state().version

        def rows(frame: DataFrame, since: datetime, upto: datetime) -> DataFrame:
            return time_range(frame, since, upto, cols=self.cols)

        if not by_cells or covered < 0 or first >= last:
            return [self._cells(rows(self.logs.read(version), start, end))]
        at_cell = LogColumns(tstamp="cell")
        stored = time_range(self.table.read(), first, last - TICK, cols=at_cell)
        loose = []
        if start < first:
            loose.append(rows(self.logs.read(version), start, first - TICK))
        if last <= end:
            loose.append(rows(self.logs.read(version), last, end))
        if covered < version:
            loose.append(rows(self.logs.added(covered, version), first, last - TICK))
        names = T.StructType.fromDDL(MEASURES).names
        return [part.select(*names) for part in (stored, *map(self._cells, loose))]

    def histogram(
        self,
        start: datetime | str,
        end: datetime | str,
        max_buckets: int | None = None,
        aggregate: str | None = None,
        missing_is_zero: bool = False,
        ordered: bool = True,
    ) -> DataFrame:
        """``(tstamp, id, value)`` as ``time_histogram`` gives it for the log's rows.

        Without ``aggregate`` rows are counted, with it the rollup's value is aggregated.
        """
        if aggregate is not None and self.value is None:
            raise ValueError("aggregate needs a rollup of a value")
        if aggregate not in (None, *AGGREGATES):
            raise ValueError(f"unknown aggregate {aggregate!r}, one of {AGGREGATES}")
        if max_buckets is not None and max_buckets < 0:
            raise ValueError("max_buckets must not be negative")
        width = bucket_width(start, end)
        spine = Spine(start, end, width, compat=False)
        by_cells = width.unit not in CELLS or CELLS[self.unit] <= CELLS[width.unit]
        parts = self._parts(as_utc(start), as_utc(end), by_cells)
        keys = [] if self.split_by is None else ["id"]
        measures = {
            None: {"n": F.sum("n")},
            "count": {"n": F.sum("n_values")},
            "sum": {"s": F.sum("total")},
            "avg": {"n": F.sum("n_values"), "s": F.sum("total")},
            "min": {"v": F.min("least")},
            "max": {"v": F.max("greatest")},
        }[aggregate]
        cells = (
            reduce(DataFrame.unionByName, parts)
            .withColumn("bucket", spine.positions(spine.offset(F.col("cell")))[0])
            .groupBy(*keys, "bucket")
            .agg(*[measure.alias(name) for name, measure in measures.items()])
        )
        return zero_filled(
            cells, spine, keys, aggregate or "count", max_buckets, missing_is_zero, ordered=ordered
        )
