"""Token postings: a reverse index of the ``search`` column as a table.

Postings are ``(token, period columns, id)``, range-partitioned by all of these, so
a token that a third of the rows hold spreads over many tasks and files, and a
lookup reads only the row groups whose token range fits. Positional postings have a row
per occurrence with its place in the row, and answer phrases without the rows' text.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import check_words, text_all, text_any, tokens
from emberlog.operators.timerange import partition_columns
from emberlog.schema import LOG_COLUMNS, LogColumns


def build_postings(logs: DataFrame, cols: LogColumns = LOG_COLUMNS) -> DataFrame:
    """``(token, p_.., id)``, one row per distinct token of a log row."""
    return logs.select(
        F.explode(F.array_distinct(cols.search)).alias("token"),
        *partition_columns(logs),
        F.col(cols.id).alias("id"),
    )


def write_postings(
    logs: DataFrame,
    path: str,
    partitions: int | None = None,
    mode: str = "overwrite",
    cols: LogColumns = LOG_COLUMNS,
) -> None:
    """Store the postings sorted by token."""
    _write_sorted(build_postings(logs, cols), path, partitions, mode)


def _write_sorted(found: DataFrame, path: str, partitions: int | None, mode: str) -> None:
    count = [] if partitions is None else [partitions]
    ranged = found.repartitionByRange(*count, *found.columns)
    ranged.sortWithinPartitions(*found.columns).write.mode(mode).parquet(path)


def build_positions(logs: DataFrame, cols: LogColumns = LOG_COLUMNS) -> DataFrame:
    """``(token, p_.., id, position)``, one row per occurrence of a token in a log row."""
    occurrences = logs.select(
        F.posexplode(cols.search).alias("position", "token"),
        *partition_columns(logs),
        F.col(cols.id).alias("id"),
    )
    return occurrences.select("token", *partition_columns(logs), "id", "position")


def write_positions(
    logs: DataFrame,
    path: str,
    partitions: int | None = None,
    mode: str = "overwrite",
    cols: LogColumns = LOG_COLUMNS,
) -> None:
    """Store the positional postings sorted by token."""
    _write_sorted(build_positions(logs, cols), path, partitions, mode)


def phrase_tokens(positions: DataFrame, phrase: str) -> list[str]:
    """The tokens of a phrase, cut as the text was."""
    if not any(c.isalnum() for c in phrase):
        raise ValueError(f"phrase without words: {phrase!r}")
    return positions.sparkSession.range(1).select(tokens(F.lit(phrase)).alias("t")).first().t


def phrase_hits(positions: DataFrame, phrase: str) -> DataFrame:
    """``(p_.., id)`` of the rows in which the phrase's tokens stand next to each other.

    A token's positions are shifted back by its place in the phrase; where the tokens meet,
    the phrase begins. Each token reads its own range of the postings, and the join is on
    row and place, so a word that is everywhere is spread over all tasks.
    """
    keys = [*partition_columns(positions), "id"]

    def begins(place: int, token: str) -> DataFrame:
        found = positions.where(F.col("token") == token)
        return found.select(*keys, (F.col("position") - place).alias("begin"))

    wanted = phrase_tokens(positions, phrase)
    hits = begins(0, wanted[0])
    for place, token in enumerate(wanted[1:], start=1):
        hits = hits.join(begins(place, token), [*keys, "begin"])
    return hits.select(*keys).distinct()


def lookup_phrase(
    logs: DataFrame, positions: DataFrame, phrase: str, cols: LogColumns = LOG_COLUMNS
) -> DataFrame:
    """Log rows that hold a phrase, from the positions alone: ids tell rows apart, and the
    ``search`` column is read only if it is asked for."""
    hits = phrase_hits(positions, phrase)
    rows = logs if cols.id == "id" else logs.withColumn("id", F.col(cols.id))
    return rows.join(hits, hits.columns, "left_semi").select(*logs.columns)


def lookup(
    logs: DataFrame,
    postings: DataFrame,
    words: Iterable[str],
    match: str = "all",
    cols: LogColumns = LOG_COLUMNS,
) -> DataFrame:
    """Log rows that hold all (or any) of the words, found through the postings."""
    wanted = check_words(words)
    if match not in ("all", "any"):
        raise ValueError("match must be 'all' or 'any'")
    if not wanted:
        raise ValueError("nothing to look up")
    keys = [c for c in partition_columns(logs) if c in postings.columns]
    hits = postings.where(F.col("token").isin(wanted)).select(*keys, "id", "token")
    if match == "all" and len(wanted) > 1:
        hits = (
            hits.groupBy(*keys, "id")
            .agg(F.collect_set("token").alias("found"))  # at most the wanted words
            .where(F.size("found") == len(wanted))
            .drop("found")
        )
    rows = logs if cols.id == "id" else logs.withColumn("id", F.col(cols.id))
    found = rows.join(hits, [*keys, "id"], "left_semi")
    # ids may be hashes: the words themselves decide
    check = text_all if match == "all" else text_any
    # a filter would be pushed below the join, and look at every row of the table; the columns
    # stay outside the generator, so the join ships only those that are asked for
    held = F.explode(F.when(check(*wanted, cols=cols), F.array(F.lit(True)))).alias("_held")
    return found.select("*", held).select(*[F.col(f"`{c}`") for c in logs.columns])
