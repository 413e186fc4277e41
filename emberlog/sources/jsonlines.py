"""JSON-lines input: one event per line, blank lines skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Fixed value: a compressed file cannot be split, so this is the least share of a task that
# reads it.
LINES_PER_FILE = 25_000


def _lines(frame: DataFrame) -> DataFrame:
    return frame.where(F.col("value").rlike(r"\S"))


def read_json_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(value, source_file, source_row)`` of the non-blank lines.

    ``source_row`` grows along the lines of a task and differs for every line, also for
    equal ones; reading the same files in the same splits gives the same numbers.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.monotonically_increasing_id().alias("source_row"),
    )
    return _lines(lines)


def write_json_lines(lines: DataFrame, path: str) -> None:
    """Store the ``value`` column as text files, one line per row, in gzip: lines repeat their
    keys. However many rows a task has, its files stay small, so many tasks can read them."""
    writer = lines.select("value").write.option("maxRecordsPerFile", LINES_PER_FILE)
    writer.option("compression", "gzip").text(path)


def stream_json_lines(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """``(value, source_file)`` as a stream over a directory that receives files."""
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(path)
    return _lines(lines.select("value", F.col("_metadata.file_path").alias("source_file")))
