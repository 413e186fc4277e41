"""Time histograms; the SQL form joins a spine of bucket edges by range."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions.buckets import bucket_seconds
from emberlog.operators.histogram import counts_metadata_of, time_histogram
from emberlog.operators.responses import counts_response, counts_response_lines
from emberlog.operators.rollup import Rollup
from emberlog.plans.base import LOGS_SQL, query
from emberlog.schema import SHREDDED_COLUMNS
from emberlog.sources.committed import log_table
from emberlog.sources.views import EVENT_COLUMNS as EVENTS
from emberlog.sources.views import ORDER_COLUMNS, logs_from_lineitem, logs_from_orders

START, END = "2024-01-01T00:00:00", "2024-02-01T00:00:00"

ORDERS_SQL = (
    "(select o_orderkey as id, o_orderdate as tstamp, o_orderpriority as priority, "
    "o_totalprice as total from orders)"
)
LINEITEM_SQL = "(select l_shipdate as tstamp from lineitem)"


def histogram_sql(
    rows: str = LOGS_SQL,
    first: str = START,
    points: int = 75,
    step: str = "10 hours",
    unit: str = "hour",
    split: str | None = None,
    limit: int | None = None,
    where: str = "true",
    value: str = "count(l.lt)",
    total: str = "count(*)",
    lower: str = ">",
) -> str:
    """``points`` is the number of steps after the first edge."""
    split_id = "'value'" if split is None else f"coalesce(cast({split} as varchar), '(null)')"
    ids = "select 'value' as series"
    if split is not None:
        ids = f"select series from l group by series order by {total} desc nulls first, series"
        ids += "" if limit is None else f" limit {limit}"
    return f"""
      with l as (
        select *, {split_id} as series, date_trunc('{unit}', tstamp) as lt from {rows} where {where}
      ),
      spine as (
        select timestamp '{first}' + n * interval '{step}' as g from range({points} + 1) r(n)
      ),
      ids as ({ids})
      select cast(date_trunc('{unit}', g) as timestamp) as tstamp, ids.series as id,
             {value} as value
      from spine cross join ids
      left join l
        on l.series = ids.series and l.lt {lower} g - interval '{step}' and l.lt <= g
      group by g, ids.series
    """


def rounded(df, digits=2):
    return df.withColumn("value", F.round("value", digits))


@query("hist_total", histogram_sql())
def hist_total(t):
    return time_histogram(t.logs, START, END, cols=EVENTS)


@query("hist_split_topn", histogram_sql(split="event_type", limit=3))
def hist_split_topn(t):
    return time_histogram(t.logs, START, END, cols=EVENTS, split_by="event_type", max_buckets=3)


@query("hist_split_document", histogram_sql(split="event_type", limit=3))
def hist_split_document(t):
    """The same, with the field taken from the document."""
    return time_histogram(t.logs, START, END, split_by="event_type", max_buckets=3)


@query("hist_split_all", histogram_sql(split="user_id"))
def hist_split_all(t):
    return time_histogram(t.logs, START, END, cols=EVENTS, split_by="user_id")


@query("hist_split_sum", histogram_sql(
    split="k", limit=10, value="round(sum(l.value), 2)", total="sum(value)",
))
def hist_split_sum(t):
    return rounded(
        time_histogram(
            t.logs, START, END, cols=EVENTS, split_by="vars.k", max_buckets=10, value="value", aggregate="sum"
        )
    )


def _aggregate_query(aggregate: str, sql: str) -> None:
    @query(f"hist_value_{aggregate}", histogram_sql(value=sql))
    def build(t):
        return rounded(time_histogram(t.logs, START, END, cols=EVENTS, value="value", aggregate=aggregate), 4)


_aggregate_query("sum", "round(sum(l.value), 4)")
_aggregate_query("avg", "round(avg(l.value), 4)")
_aggregate_query("min", "round(min(l.value), 4)")
_aggregate_query("max", "round(max(l.value), 4)")
_aggregate_query("count", "count(l.value)")


@query("hist_compat", histogram_sql(points=74, lower=">="))
def hist_compat(t):
    """Both edges of a bucket count."""
    return time_histogram(t.logs, START, END, compat=True)


@query("hist_compat_split", histogram_sql(points=74, lower=">=", split="event_type", limit=2))
def hist_compat_split(t):
    return time_histogram(
        t.logs, START, END, cols=EVENTS, split_by="event_type", max_buckets=2, compat=True
    )


@query("hist_unaligned", histogram_sql(first="2023-12-31 17:42:11.5", points=75))
def hist_unaligned(t):
    return time_histogram(t.logs, "2023-12-31T17:42:11.5", "2024-01-31T23:17:42")


@query("hist_day", histogram_sql(first="2023-12-15", points=91, step="1 day", unit="day"))
def hist_day(t):
    return time_histogram(t.logs, "2023-12-15", "2024-03-15")


@query("hist_week", histogram_sql(first="2023-06-01", points=83, step="7 days", unit="week"))
def hist_week(t):
    return time_histogram(t.logs, "2023-06-01", "2024-12-31")


@query("hist_two_weeks", histogram_sql(first="2022-01-01", points=79, step="14 days", unit="week"))
def hist_two_weeks(t):
    return time_histogram(t.logs, "2022-01-01", "2025-01-01")


@query("hist_month", histogram_sql(
    rows=ORDERS_SQL, first="1994-12-01", points=84, step="1 month", unit="month",
))
def hist_month(t):
    return time_histogram(logs_from_orders(t.orders), "1994-12-31T12:00:00", "2001-12-31")


@query("hist_month_split", histogram_sql(
    rows=ORDERS_SQL, first="1995-01-01", points=83, step="1 month", unit="month",
    split="priority", limit=3, value="round(sum(l.total), 2)", total="sum(total)",
))
def hist_month_split(t):
    return rounded(
        time_histogram(
            logs_from_orders(t.orders), "1995-01-01", "2001-12-31",
            split_by="priority", max_buckets=3, value="total", aggregate="sum",
            cols=ORDER_COLUMNS,
        )
    )


@query("hist_year", histogram_sql(
    rows=LINEITEM_SQL, first="1900-01-01", points=62, step="2 years", unit="year",
))
def hist_year(t):
    return time_histogram(logs_from_lineitem(t.lineitem), "1900-01-01", "2024-01-01")


@query("hist_zero_fill", histogram_sql(
    where="event_type = 'purchase' and k < 3",
    value="coalesce(round(sum(l.value), 2), 0)",
))
def hist_zero_fill(t):
    rare = P.eq("event_type", "purchase", EVENTS) & P.lt("vars.k", 3, cols=EVENTS)
    return rounded(
        time_histogram(
            t.logs, START, END, rare, value="value", aggregate="sum",
            missing_is_zero=True, cols=EVENTS,
        )
    )


@query("hist_no_match", histogram_sql(where="event_type = 'none such'"))
def hist_no_match(t):
    return time_histogram(t.logs, START, END, P.eq("event_type", "none such", EVENTS))


@query("counts_response", f"""
  select '{{"metadata":{{"counts_interval_sec":36000}},"counts":{{' || string_agg(
    '"' || strftime(tstamp, '%Y-%m-%dT%H:%M:%SZ') || '":{{"value":' || value || '}}', ',' order by tstamp
  ) || '}}}}' as json from ({histogram_sql()})
""")
def counts_response_query(t):
    return counts_response(t.logs, START, END)


@query("counts_response_all", f"""
  with h as ({histogram_sql(split="user_id")})
  select 0 as part, cast(null as varchar) as id,
         '{{"metadata":{{"counts_interval_sec":36000}},"counts":{{' as json
  union all
  select 1, id, case when row_number() over (partition by tstamp order by id) > 1 then ','
      else case when tstamp > (select min(tstamp) from h) then '}},' else '' end
           || '"' || strftime(tstamp, '%Y-%m-%dT%H:%M:%SZ') || '":{{' end
    || '"' || id || '":' || value from h
  union all
  select 2, null, '}}}}}}'
""")
def counts_response_all(t):
    """The lines that together are the document of all split ids."""
    lines = counts_response_lines(t.logs, START, END, split_by="user_id", cols=EVENTS)
    return lines.select("part", "id", "json")


_LADDER_SQL = """
  case when s < 120 then 1 when s < 240 then 2 when s < 600 then 5 when s < 1200 then 10
       when s < 3600 then 30 when s < 7200 then 60 when s < 14400 then 120 when s < 36000 then 300
       when s < 72000 then 600 when s < 216000 then 1800 when s < 432000 then 3600
       when s < 864000 then 7200 when s < 2160000 then 18000 when s < 4320000 then 36000
       when s < 10368000 then 86400 when s < 20736000 then 172800 when s < 72576000 then 604800
       when s < 145152000 then 1209600 when s < 311040000 then 2592000 else 5184000 end
"""


@query("counts_metadata", f"""
  select 'counts_interval_sec' as key, cast({_LADDER_SQL} as bigint) as value from (
    select date_diff('second', date_trunc('second', min(ts)), date_trunc('second', max(ts))) as s
    from events
  )
""")
def counts_metadata_query(t):
    """The width for the time that the events take up."""
    return counts_metadata_of(t.logs)


@query("bucket_ladder", f"""
  select event_id, cast({_LADDER_SQL} as bigint) as seconds from (
    select event_id, date_diff('second', timestamp '2024-01-01', date_trunc('second', ts)) as s
    from events
  )
""")
def bucket_ladder(t):
    """Width for the time from the start of the year to each event."""
    since = F.unix_seconds(F.col("ts").cast("timestamp")) - F.lit(1704067200)
    return t.events.select("event_id", bucket_seconds(since).alias("seconds"))


@query("bucket_ladder_days", f"""
  select l_orderkey, l_linenumber, cast({_LADDER_SQL} as bigint) as seconds from (
    select l_orderkey, l_linenumber,
           abs(date_diff('second', timestamp '1998-06-01', date_trunc('second', l_shipdate))) as s
    from lineitem
  )
""")
def bucket_ladder_days(t):
    """The same over years, before and after a fixed day."""
    since = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.lit(896659200)
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", bucket_seconds(since).alias("seconds")
    )


def _rollup(t, value=None):
    """A rollup by event type of the logs, two commits of which it has and one not yet."""
    logs = t.logs.withColumn("tstamp", F.col("tstamp").cast("timestamp"))
    table = log_table(t.spark, t.work_folder(), ["day"], promoted=())
    rollup = Rollup(table, t.work_folder(), "event_type", value, unit="hour", cols=SHREDDED_COLUMNS)
    for part in range(3):
        table.append(logs.where(F.pmod("id", F.lit(3)) == part))
        if part < 2:
            rollup.refresh()
    return rollup


@query("hist_from_rollup", histogram_sql(split="event_type", limit=3))
def hist_from_rollup(t):
    """hist_split_topn from kept partials, and the rows of the commit they lack."""
    return _rollup(t).histogram(START, END, max_buckets=3)


@query("hist_rollup_sum", histogram_sql(
    split="event_type", first="2024-01-03 05:17:00", points=109, step="5 hours", value="round(sum(l.value), 2)",
    where="tstamp between timestamp '2024-01-03 05:17:00' and timestamp '2024-01-25 21:43:10'",
))
def hist_rollup_sum(t):
    """A range that cuts cells: their rows are read."""
    found = _rollup(t, "value").histogram("2024-01-03 05:17:00", "2024-01-25 21:43:10", aggregate="sum")
    return rounded(found)
