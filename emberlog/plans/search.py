"""Newest events, field summaries, metadata, lines, documents and tailing."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions.fields import field_json, field_number, is_array, is_object
from emberlog.functions.render import event_line, field_line
from emberlog.functions.text import tokens
from emberlog.operators.events import field_summary, field_values, latest_events, range_metadata
from emberlog.operators.responses import (
    event_json_lines,
    events_response,
    events_response_lines,
)
from emberlog.operators.stored import latest_stored, range_estimate
from emberlog.operators.timerange import time_range
from emberlog.plans.base import LOGS_SQL, WORDS_SQL, query
from emberlog.plans.histograms import END, START
from emberlog.schema import SHREDDED_COLUMNS
from emberlog.sources.committed import log_table
from emberlog.sources.logtable import as_logs, read_logs, stream_logs, write_logs
from emberlog.sources.views import EVENT_COLUMNS
from emberlog.streaming.tail import POLL_MS, start_tail, tail_lines

_NEWEST = f"select id, tstamp as timestamp, doc as source from {LOGS_SQL}"


@query("latest_events", f"{_NEWEST} order by tstamp desc, id desc limit 100")
def latest(t):
    return latest_events(t.logs, START, END, limit=100)


@query("latest_events_filtered", f"""
  {_NEWEST} where tstamp between timestamp '2024-01-08' and timestamp '2024-01-25 06:30:00'
    and event_type in ('click', 'view') and k >= 50
  order by tstamp desc, id desc limit 50
""")
def latest_filtered(t):
    condition = P.in_list("event_type", ["click", "view"], EVENT_COLUMNS) & P.ge(
        "vars.k", 50, cols=EVENT_COLUMNS
    )
    return latest_events(t.logs, "2024-01-08", "2024-01-25T06:30:00Z", condition, 50)


@query("latest_events_all", f"{_NEWEST} where event_type = 'error'")
def latest_all(t):
    """Without a limit every match is returned, newest first."""
    return latest_events(t.logs, START, END, P.eq("event_type", "error", EVENT_COLUMNS))


def _summary_sql(rows: str, k: int = 5) -> str:
    return f"""
      select field, value, n, rank from (
        select *, row_number() over (partition by field order by n desc, value) as rank
        from (select field, value, count(*) as n from {rows} group by field, value)
      ) where rank <= {k}
    """


def _event_fields(rows: str) -> str:
    return f"""(
      select unnest([
        {{'field': 'event_type', 'value': event_type}},
        {{'field': 'user_id', 'value': cast(user_id as varchar)}},
        {{'field': 'value', 'value': cast(value as varchar)}},
        {{'field': 'vars.k', 'value': cast(k as varchar)}}
      ], recursive := true) from {rows}
    )"""


_SAMPLE = f"(select * from {LOGS_SQL} order by tstamp desc, id desc limit 500)"


@query("field_summary", _summary_sql(_event_fields(_SAMPLE)))
def summary(t):
    """Of the newest 500 events, the sample the operator is defined on."""
    return field_summary(t.logs, START, END)


@query("field_summary_all", _summary_sql(_event_fields(LOGS_SQL), 10))
def summary_all(t):
    return field_summary(t.logs, START, END, sample=None, k=10)


_DOCUMENT_FIELDS = f"""(
  select 'words' as field, unnest(search) as value from {WORDS_SQL}
  union all select 'lang', lang from documents
  union all select 'source', source from documents
)"""


def _document_logs(t):
    fields = F.struct("lang", "source", tokens(F.col("text")).alias("words"))
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.to_json(fields).alias("doc"),
        F.to_variant_object(fields).alias("doc_v"),
    )


@query("field_values_arrays", _summary_sql(_DOCUMENT_FIELDS, 20).replace(", rank from", " from"))
def values_arrays(t):
    """Array elements count one by one: the most frequent words."""
    logs = _document_logs(t).withColumn("tstamp", F.to_timestamp_ntz(F.lit(START)))
    return field_summary(logs, START, END, sample=None, k=20).drop("rank")


@query("json_types", f"""
  select id, true as words_is_array, false as lang_is_array, true as doc_is_object
  from {WORDS_SQL}
""")
def json_types(t):
    return _document_logs(t).select(
        "id",
        is_array(field_json("words")).alias("words_is_array"),
        is_array(field_json("lang")).alias("lang_is_array"),
        is_object(F.col("doc_v")).alias("doc_is_object"),
    )


@query("range_metadata", """
  select 'event_count' as key, count(*) as value from events
  union select 'counts_interval_sec', 36000
""")
def metadata(t):
    return range_metadata(t.logs, START, END)


@query("range_metadata_filtered", f"""
  select 'event_count' as key, count(*) as value from {LOGS_SQL} where k < 20
  union select 'counts_interval_sec', 36000
""")
def metadata_filtered(t):
    return range_metadata(t.logs, START, END, P.lt("vars.k", 20, cols=EVENT_COLUMNS))


def _rendered(t):
    """Events under the field names a line is made of."""
    doc = F.to_json(
        F.struct(
            F.concat(F.lit("web"), F.col("user_id")).alias("hostname"),
            F.when(F.col("user_id") % 2 == 0, F.col("event_type")).alias("syslogtag"),
            F.col("value").alias("msg"),
            F.array("user_id", "event_id").alias("vars.ids"),
            F.struct(F.struct("user_id").alias("by"), F.col("event_type").alias("a")).alias("o"),
        )
    )
    events = t.spread(t.events, "event_id")
    return as_logs(
        events.select(F.col("event_id").alias("id"), F.col("ts").alias("tstamp"), doc.alias("doc"))
    )


_TIME = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query("render_line", f"""
  select event_id as id,
         concat_ws(' ', {_TIME}, 'web' || user_id,
                   case when user_id % 2 = 0 then event_type end, cast(value as varchar)) as line
  from events
""")
def render_line(t):
    return _rendered(t).select("id", event_line().alias("line"))


@query("render_fields", f"""
  select event_id as id,
         {_TIME} || ' ' || case when user_id % 2 = 0 then event_type else 'None' end
         || ' =[' || user_id || ',' || event_id || '] a="' || event_type || '" by.user_id=' || user_id
         || ' None' as line
  from events
""")
def render_fields(t):
    return _rendered(t).select(
        "id", field_line(["syslogtag", "vars.ids", "o", "none"]).alias("line")
    )


_JSON_TIME = (
    "regexp_replace(strftime(tstamp, '%Y-%m-%dT%H:%M:%S.%f') || 'Z', '(\\.0{6}|0+)Z$', 'Z')"
)
_EVENT_JSON = (
    f"'{{\"timestamp\":\"' || {_JSON_TIME} || '\",\"id\":' || id || ',\"source\":' || doc || '}}'"
)


@query("event_json_lines", f"select {_EVENT_JSON} as value from {LOGS_SQL}")
def json_lines(t):
    return event_json_lines(latest_events(t.logs, START, END))


@query("events_response", f"""
  with summary as ({_summary_sql(_event_fields(_SAMPLE))}),
  events_part as (
    select '[' || string_agg({_EVENT_JSON}, ',' order by tstamp desc, id desc) || ']' as j
    from (select * from {LOGS_SQL} order by tstamp desc, id desc limit 25)
  ),
  fields_part as (
    select '{{' || string_agg('"' || field || '":' || j, ',' order by field) || '}}' as j from (
      select field, '{{' || string_agg('"' || value || '":' || n, ',' order by value) || '}}' as j
      from summary group by field
    )
  )
  select '{{"events":' || e.j || ',"fields":' || f.j
         || ',"metadata":{{"counts_interval_sec":36000,"event_count":'
         || (select count(*) from events) || '}}}}' as json
  from events_part e cross join fields_part f
""")
def response(t):
    return events_response(t.logs, START, END, limit=25)


@query("events_response_all", f"""
  with summary as ({_summary_sql(_event_fields(_SAMPLE))}),
  fields_part as (
    select '{{' || string_agg('"' || field || '":' || j, ',' order by field) || '}}' as j from (
      select field, '{{' || string_agg('"' || value || '":' || n, ',' order by value) || '}}' as j
      from summary group by field
    )
  )
  select 0 as part, cast(null as bigint) as id, '{{"events":[' as json
  union all
  select 1, id, case when row_number() over (order by tstamp desc, id desc) > 1 then ',' else '' end
         || {_EVENT_JSON} from {LOGS_SQL}
  union all
  select 2, null, '],"fields":' || f.j || ',"metadata":{{"counts_interval_sec":36000,"event_count":'
         || (select count(*) from events) || '}}}}' from fields_part f
""")
def response_all(t):
    """The lines that together are the document of all events."""
    return events_response_lines(t.logs, START, END).select("part", "id", "json")


_NOW = "2024-01-31T00:00:00"
_TAIL = f"""
  select id, tstamp, strftime(tstamp, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || k
         || ' None' as line
  from {LOGS_SQL}
  where tstamp > timestamp '2024-01-31' - interval 20 days and event_type <> 'view'
"""


@query("tail_batch", f"{_TAIL} order by id desc limit 1000")
def tail_batch(t):
    return tail_lines(
        t.logs,
        ~P.eq("event_type", "view"),
        max_age=timedelta(days=20),
        fields=["event_type", "vars.k", "none"],
        now=_NOW,
        by_id=True,
    )


@query("tail_after_id", f"{_TAIL} and id > 5000 order by tstamp desc, id desc limit 200")
def tail_after_id(t):
    return tail_lines(
        t.logs,
        ~P.eq("event_type", "view"),
        max_age="20 days",
        max_lines=200,
        fields=["event_type", "vars.k", "none"],
        last_id=5000,
        now=_NOW,
    )


@query("tail_stream", f"""
  select id, strftime(tstamp, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || k as line
  from {LOGS_SQL} where k < 50
""")
def tail_stream(t):
    """The event table stored as a log table and followed as a stream to its end."""
    query, lines = _followed(t, {"availableNow": True})
    query.awaitTermination()
    return lines()


def _followed(t, trigger):
    """A tail of the stored event table, and its lines so far as ``() -> DataFrame``."""
    folder = t.work_folder()
    write_logs(t.logs.withColumn("tstamp", F.col("tstamp").cast("timestamp")), f"{folder}/logs")
    query = start_tail(
        stream_logs(t.spark, f"{folder}/logs"),
        P.lt("vars.k", 50),
        max_age=timedelta(days=36500),
        max_lines=None,
        fields=["event_type", "vars.k"],
        on_lines=lambda lines, _: lines.write.mode("append").parquet(f"{folder}/lines"),
        checkpoint=f"{folder}/checkpoint",
        trigger=trigger,
    )
    return query, lambda: t.spark.read.parquet(f"{folder}/lines").select("id", "line")


@query("tail_polled", f"""
  select id, strftime(tstamp, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' ' || k as line
  from {LOGS_SQL} where k < 50
""")
def tail_polled(t):
    """The same by polls at a fixed interval, stopped once all that is stored was shown."""
    query, lines = _followed(t, {"processingTime": f"{POLL_MS} milliseconds"})
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return lines()


@query("stored_range", f"""
  select id, tstamp, k from {LOGS_SQL}
  where tstamp between timestamp '2024-01-10 06:00:00' and timestamp '2024-01-20 18:00:00'
""")
def stored_range(t):
    """A range of a stored table, read from the partitions it touches."""
    folder = t.work_folder()
    levels = ["month", "day"]
    write_logs(
        t.logs.withColumn("tstamp", F.col("tstamp").cast("timestamp")), folder, levels, promoted=()
    )
    rows = time_range(
        read_logs(t.spark, folder, levels, promoted=()),
        "2024-01-10T06:00:00",
        "2024-01-20T18:00:00",
    )
    return rows.select("id", "tstamp", field_number("vars.k").alias("k"))


def _stored(t):
    """The logs in a stored table whose documents are shredded."""
    folder = t.work_folder()
    logs = t.logs.withColumn("tstamp", F.col("tstamp").cast("timestamp"))
    write_logs(logs, folder, ["month"], promoted=())
    return read_logs(t.spark, folder, ["month"], promoted=())


@query("stored_eq", f"""
  select id, tstamp from {LOGS_SQL} where k = 42 or event_type = 'click' and user_id = 7
""")
def stored_eq(t):
    """Equality on fields of a stored table; reads a column per field, no documents."""
    hit = P.eq("vars.k", 42, SHREDDED_COLUMNS) | (
        P.eq("event_type", "click", SHREDDED_COLUMNS) & P.eq("user_id", 7.0, SHREDDED_COLUMNS)
    )
    return _stored(t).where(hit).select("id", "tstamp")


@query("stored_compare", f"""
  select id, tstamp from {LOGS_SQL}
  where k >= 90 and value < 50.5 and event_type like 'p%' or k in (3, 5) and event_type <> 'view'
""")
def stored_compare(t):
    """Comparisons, LIKE and membership on fields of a stored table."""
    cols = SHREDDED_COLUMNS
    first = P.ge("vars.k", 90, cols=cols) & P.lt("value", 50.5, "double", cols)
    other = P.in_list("vars.k", [3, 5], cols) & ~P.eq("event_type", "view", cols)
    return _stored(t).where(first & P.like("event_type", "p%", cols) | other).select("id", "tstamp")


@query("compacted_range", f"""
  select id, tstamp, k from {LOGS_SQL}
  where tstamp between timestamp '2024-01-10 06:00:00' and timestamp '2024-01-20 18:00:00'
""")
def compacted_range(t):
    """A range of a table that was stored in several commits and then compacted."""
    table = log_table(t.spark, t.work_folder(), ["month", "day"], promoted=())
    logs = t.logs.withColumn("tstamp", F.col("tstamp").cast("timestamp"))
    for part in range(4):
        table.append(logs.where(F.pmod("id", F.lit(4)) == part))
    table.compact()
    rows = time_range(table.read(), "2024-01-10T06:00:00", "2024-01-20T18:00:00")
    return rows.select("id", "tstamp", field_number("vars.k", cols=SHREDDED_COLUMNS).alias("k"))


def _committed(t, commits=3):
    """The logs in a table of daily directories, stored by several commits."""
    table = log_table(t.spark, t.work_folder(), ["day"], promoted=())
    logs = t.logs.withColumn("tstamp", F.col("tstamp").cast("timestamp"))
    for part in range(commits):
        table.append(logs.where(F.pmod("id", F.lit(commits)) == part))
    return table


@query("latest_stored", f"""
  {_NEWEST} where tstamp <= timestamp '2024-01-25 06:30:00' and event_type = 'click'
  order by tstamp desc, id desc limit 100
""")
def latest_of_stored(t):
    """The newest matches of a stored table; days before those that hold them stay unread."""
    match = P.eq("event_type", "click", SHREDDED_COLUMNS)
    return latest_stored(_committed(t), START, "2024-01-25T06:30:00", match, 100, SHREDDED_COLUMNS)


_RANGES = [
    (f"2024-01-{1 + k:02d} {2 * k:02d}:{5 * k:02d}:00", f"2024-01-{20 + k:02d} {22 - k:02d}:30:00")
    for k in range(10)
]


@query("range_estimate", " union all ".join(
    f"select {k} as range_no, count(*) as n, true as close from events "
    f"where ts between timestamp '{start}' and timestamp '{end}'"
    for k, (start, end) in enumerate(_RANGES)
))
def estimates(t):
    """Exact counts of ten ranges, and whether the estimates from statistics are within 2 %."""
    table = _committed(t)
    exact = F.count(F.lit(1)).alias("n")
    found = []
    for k, (start, end) in enumerate(_RANGES):
        n = time_range(table.read(), start, end).agg(exact)
        guess = range_estimate(table, start, end).select(F.col("n").alias("guess"))
        near = F.abs(F.col("guess") - F.col("n")) <= F.col("n") * 0.02
        # one row each
        both = n.join(guess, F.lit(True))
        found.append(both.select(F.lit(k).alias("range_no"), "n", near.alias("close")))
    return reduce(DataFrame.unionAll, found)
