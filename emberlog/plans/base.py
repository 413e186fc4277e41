"""Catalogue of ready-made queries over the sample tables.

Each entry is a DataFrame query and, where SQL can say the same, an equivalent
statement for a plain SQL engine over the same Parquet files.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.session import checkpoint_folder, configure
from emberlog.sources import views


class Tables:
    """The sample tables of one scale, and the log views derived from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def spread(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows dealt by their key over the session's shuffle partitions, for work that is
        dear per row: a file of narrow rows is read by few tasks, one per row group."""
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(tasks, key)

    def raw_lines(self, events: DataFrame | None = None, **options) -> DataFrame:
        """The events as raw lines, spread for the import."""
        rows = self.events if events is None else events
        return views.raw_lines_from_events(self.spread(rows, "event_id"), **options)

    @property
    def logs(self) -> DataFrame:
        return views.logs_from_events(self.events)

    @property
    def words(self) -> DataFrame:
        return views.logs_from_documents(self.documents)

    def work_folder(self) -> str:
        """A new folder for stored results and stream progress."""
        name = f"emberlog/{uuid4()}"
        if self.spark.conf.get("spark.checkpoint.dir", None):
            return checkpoint_folder(self.spark, name)
        if not self.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        return str(Path(mkdtemp()) / name)


@dataclass(frozen=True)
class Query:
    build: Callable[[Tables], DataFrame]
    sql: str | None


CATALOGUE: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with its SQL form."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in CATALOGUE:
            raise ValueError(f"two queries named {name}")
        CATALOGUE[name] = Query(build, sql)
        return build

    return register


def run(name: str, spark: SparkSession, folder: str) -> DataFrame:
    """Build a query; instants come out as UTC wall-clock times."""
    configure(spark)
    result = CATALOGUE[name].build(Tables(spark, folder))
    instants = [f.name for f in result.schema if f.dataType.simpleString() == "timestamp"]
    return result.withColumns({c: F.col(c).cast("timestamp_ntz") for c in instants})


# SQL forms of the derived views.
LOGS_SQL = """(
  select event_id as id, ts as tstamp, event_type, user_id, value,
         cast(json_extract_string(props, '$.k') as int) as k,
         cast(json_object('event_type', event_type, 'user_id', user_id, 'value', value,
              'vars.k', cast(json_extract_string(props, '$.k') as int)) as varchar) as doc
  from events
)"""


def tokens_sql(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), "
        "lambda t: t <> '')"
    )


WORDS_SQL = f"(select doc_id as id, text, {tokens_sql('text')} as search from documents)"
