"""Import of raw lines, normalisation and time partitions."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from emberlog.functions.buckets import PERIODS, partition_name, period_ceiling, period_floor
from emberlog.functions.flatten import flatten_json
from emberlog.functions.syslog import (
    facility_name,
    format_rfc3339,
    parse_rfc3339,
    severity_name,
    trim_first_space,
)
from emberlog.functions.fields import field_text
from emberlog.operators.ingest import import_events, parse_events, preprocessing
from emberlog.operators.normalize import normalize_messages
from emberlog.operators.partitions import partition_bounds, with_partitions
from emberlog.operators.postings import build_postings, lookup
from emberlog.plans.base import query
from emberlog.schema import FACILITIES, SEVERITIES, SHREDDED_COLUMNS, LogColumns
from emberlog.session import release_shuffles
from emberlog.sources.committed import log_table
from emberlog.sources.jsonlines import read_json_lines, write_json_lines
from emberlog.sources.logtable import read_logs, write_logs
from emberlog.streaming.importer import start_committed_import, start_import


def _case(code: str, names: dict[str, str]) -> str:
    whens = " ".join(f"when '{k}' then '{v}'" for k, v in names.items())
    return f"case {code} {whens} end"


@query("severity_decode", f"""
  select event_id, {_case("cast(user_id % 10 as varchar)", SEVERITIES)} as severity from events
""")
def severity_decode(t):
    code = (F.col("user_id") % 10).cast("string")
    return t.events.select("event_id", severity_name(code).alias("severity"))


@query("facility_decode", f"""
  select event_id, {_case("cast(user_id % 26 as varchar)", FACILITIES)} as facility from events
""")
def facility_decode(t):
    code = (F.col("user_id") % 26).cast("string")
    return t.events.select("event_id", facility_name(code).alias("facility"))


_K = "cast(json_extract_string(props, '$.k') as int)"
_TIME_TEXT = (
    "regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z', '(\\.0{6}|0+)Z$', 'Z')"
)


@query("rfc3339", f"""
  select event_id, case when user_id % 3 = 0 then ts when user_id % 3 = 1 then ts - interval 150 minutes
         end as parsed,
         case when user_id % 3 = 0 then {_TIME_TEXT} end as formatted
  from events
""")
def rfc3339(t):
    """Event times in UTC, with an offset, and in a spelling that is not accepted."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    spelled = (
        F.when(F.col("user_id") % 3 == 0, F.concat(text, F.lit("Z")))
        .when(F.col("user_id") % 3 == 1, F.concat(text, F.lit("+02:30")))
        .otherwise(text)
    )
    parsed = parse_rfc3339(F.col("spelled"))
    return t.events.select("event_id", "user_id", spelled.alias("spelled")).select(
        "event_id",
        parsed.alias("parsed"),
        F.when(F.col("user_id") % 3 == 0, format_rfc3339(parsed)).alias("formatted"),
    )


@query("flatten_vars", f"""
  select event_id, unnest([
    {{'key': 'vars.k', 'json': cast({_K} as varchar)}},
    {{'key': 'vars.tags', 'json': '["' || event_type || '",{{"n":' || user_id || '}}]'}},
    {{'key': 'vars.u.id', 'json': cast(user_id as varchar)}},
    {{'key': 'vars.u.more.kind', 'json': '"' || event_type || '"'}},
    {{'key': 'vars.v', 'json': cast(value as varchar)}}
  ], recursive := true) from events
""")
def flatten_vars(t):
    text = F.format_string(
        '{"v":%s,"u":{"more":{"kind":"%s","empty":{}},"id":%s},"tags":["%s",{"n":%s}],"k":%s}',
        *[F.col(c).cast("string") for c in ("value", "event_type", "user_id")],
        *[F.col(c).cast("string") for c in ("event_type", "user_id")],
        F.get_json_object("props", "$.k"),
    )
    entries = flatten_json(F.col("text"), F.parse_json("text"), "vars")
    return (
        t.events.select("event_id", text.alias("text"))
        .select("event_id", F.explode(entries).alias("entry"))
        .select("event_id", "entry.key", "entry.json")
    )


# The import of the raw lines, spelled out.
_HOST = "'web' || (user_id % 10)"
_MSG = f"concat_ws(' ', 'user', user_id, event_type, '#', {_K})"
_TAG = "event_type || '[' || user_id || ']:'"
_DOC = f"""
  '{{"app_name":"' || event_type || '","fromhost":"' || {_HOST} || '","fromhost_ip":"10.0.0.'
  || (user_id % 250) || '","hostname":"' || {_HOST} || '","inputname":"imudp","msg":"' || {_MSG}
  || '","procid":' || case when event_type = 'view' then 'null' else '"' || user_id || '"' end
  || ',"programname":"' || event_type || '","protocol_version":"1","syslogfacility":"'
  || {_case("cast(user_id % 24 as varchar)", FACILITIES)} || '","syslogseverity":"'
  || {_case("cast(user_id % 9 as varchar)", SEVERITIES)} || '","syslogtag":"' || {_TAG}
  || '","timegenerated":"' || {_TIME_TEXT} || '","timereported":"' || {_TIME_TEXT}
  || '","vars.k":' || {_K} || ',"vars.tags":["' || event_type || '","t' || {_K}
  || '"],"vars.user.id":' || user_id || ',"vars.user.kind":"' || event_type || '"}}'
"""
_SEARCH = f"""
  concat_ws(' ', {_HOST}, 'user', user_id, event_type, {_K}, event_type, user_id,
            'vars k', {_K}, 'vars tags', event_type, 't' || {_K}, 'vars user id', user_id,
            'vars user kind', event_type)
"""


@query("import_good", f"select event_id as id, ts as tstamp, {_DOC} as doc from events where user_id % 9 <> 8")
def import_good(t):
    good, _ = import_events(t.raw_lines(), columns=["id", "tstamp", "doc"])
    return good


@query("import_quarantine", """
  select event_id as id, 'invalid syslogseverity' as reason from events where user_id % 9 = 8
""")
def import_quarantine(t):
    _, quarantine = import_events(t.raw_lines())
    return quarantine.select("id", "reason")


@query("import_reasons", """
  select event_id as id, case event_id % 6
    when 0 then 'missing hostname' when 1 then 'hostname is not a string'
    when 2 then 'invalid timereported' when 3 then 'not a JSON object'
    when 4 then 'invalid syslogseverity'
    when 5 then case when user_id % 9 = 8 then 'invalid syslogseverity' end end as reason
  from events
""")
def import_reasons(t):
    """Lines broken in different ways."""
    line, kind = F.col("value"), F.col("id") % 6
    broken = (
        F.when(kind == 0, F.regexp_replace(line, '"hostname":"[^"]*",', ""))
        .when(kind == 1, F.regexp_replace(line, '"hostname":"[^"]*"', '"hostname":7'))
        .when(kind == 2, F.regexp_replace(line, '("timereported":"....-..-..)T', "$1 "))
        .when(kind == 3, F.concat(line, F.lit("}")))
        .when(kind == 4, F.regexp_replace(line, '"syslogseverity":"."', '"syslogseverity":"8"'))
        .otherwise(line)
    )
    lines = t.raw_lines().select("id", broken.alias("value"))
    return parse_events(lines).select("id", "reason")


@query("import_repeated_lines", """
  select ts as tstamp, 1 + event_id % 3 as n, 1 + event_id % 3 as ids,
         case when event_type = 'click' then 1 + event_id % 3 else 0 end as found
  from events where user_id % 9 <> 8
""")
def import_repeated_lines(t):
    """Events written one to three times as equal lines of text files: rows, distinct
    ids, and rows that a word lookup finds. Events may share their time and all else, so
    the lines of one are known by the event's number, which they carry as ``uuid``."""
    folder = t.work_folder()
    lines = t.raw_lines()
    numbered = F.replace(
        F.col("value"), F.lit('{"msg"'), F.concat(F.lit('{"uuid":"'), "id", F.lit('","msg"'))
    )
    copies = F.explode(F.sequence(F.lit(0), F.col("id") % 3))
    write_json_lines(
        lines.select(numbered.alias("value"), copies.alias("copy")), f"{folder}/lines"
    )
    good, _ = import_events(
        read_json_lines(t.spark, f"{folder}/lines"), columns=["id", "tstamp", "doc", "search"]
    )
    write_logs(good, f"{folder}/logs")
    release_shuffles(t.spark)
    logs = read_logs(t.spark, f"{folder}/logs")
    hits = lookup(logs, build_postings(logs), ["user", "click"]).select("id").distinct()
    event = field_text("uuid", SHREDDED_COLUMNS).alias("event")
    rows = logs.select("id", "tstamp", event)
    counted = rows.groupBy("event").agg(
        F.min("tstamp").alias("tstamp"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("ids"),
    )
    found = rows.join(hits, "id").groupBy("event").agg(F.count(F.lit(1)).alias("found"))
    return counted.join(found, "event", "left").select(
        "tstamp", "n", "ids", F.coalesce("found", F.lit(0)).alias("found")
    )


@query("import_repeated_keys", f"""
  select event_id as id, case when event_id % 3 = 2 then 'repeated hostname'
    when user_id % 9 = 8 then 'invalid syslogseverity' end as reason,
    case when event_id % 3 <> 2 and user_id % 9 <> 8 then {_K} end as k
  from events
""")
def import_repeated_keys(t):
    """Keys given twice: inside the variables, unknown ones, and known ones."""
    kind, line = F.col("id") % 3, F.col("value")
    twice = (
        F.when(kind == 0, F.replace(line, F.lit('"$!":{'), F.lit('"$!":{"k":-1,')))
        .when(kind == 1, F.replace(line, F.lit('{"msg"'), F.lit('{"x":1,"x":{"a":2},"msg"')))
        .otherwise(F.replace(line, F.lit('{"msg"'), F.lit('{"hostname":"other","msg"')))
    )
    lines = t.raw_lines().select("id", twice.alias("value"))
    return parse_events(lines).select(
        "id", "reason", F.get_json_object("doc", "$['vars.k']").cast("int").alias("k")
    )


@query("flatten_deep", """
  select s_suppkey, 'vars' || repeat('.a', cast(100 + s_suppkey % 100 as int)) as key,
         '"{}' || s_suppkey || '"' as json
  from supplier
""")
def flatten_deep(t):
    """Objects nested to 200 levels, with braces inside a text."""
    n = (F.lit(100) + F.col("s_suppkey") % 100).cast("int")
    text = F.concat(
        F.repeat(F.lit('{"a":'), n), F.lit('"{}'), "s_suppkey", F.lit('"'), F.repeat(F.lit("}"), n)
    )
    entries = flatten_json(F.col("text"), F.parse_json("text"), "vars")
    return (
        t.spread(t.supplier, "s_suppkey")
        .select("s_suppkey", text.alias("text"))
        .select("s_suppkey", F.explode(entries).alias("entry"))
        .select("s_suppkey", "entry.key", "entry.json")
    )


@query("search_text", f"""
  select event_id as id, {_SEARCH} as search from events where user_id % 9 <> 8
""")
def search_text(t):
    good, _ = import_events(t.raw_lines(), columns=["id", "search"])
    return good.select("id", F.array_join("search", " ").alias("search"))


@query("message_swap", f"""
  select event_id as id,
         case when user_id % 2 = 0 then 'short ' || event_type else {_MSG} end as msg,
         case when user_id % 2 = 0 then {_MSG} end as vars_msg
  from events where user_id % 9 <> 8
""")
def message_swap(t):
    short = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("short "), "event_type"))
    good, _ = import_events(t.raw_lines(replacement=short), columns=["id", "doc"])
    return good.select(
        "id", field_text("msg").alias("msg"), field_text("vars.msg").alias("vars_msg")
    )


@query("first_space", "select event_id, event_type || ' ' || user_id as msg from events")
def first_space(t):
    padded = F.concat(
        F.when(F.col("user_id") % 2 == 0, " ").otherwise(""), "event_type", F.lit(" "), "user_id"
    )
    return t.events.select("event_id", trim_first_space(padded).alias("msg"))


@query("structured_data", """
  select event_id as id, event_type as name, cast(user_id as varchar) as user_id,
         'say "' || event_type || '" \\ ]' as quoted
  from events where user_id % 9 <> 8
""")
def structured_data(t):
    data = F.format_string(
        r'[ev@1 Name="%s" q="say \"%s\" \\ \]"][u id="%s"]',
        "event_type", "event_type", F.col("user_id").cast("string"),
    )
    lines = t.raw_lines(structured_data=data)
    good, _ = import_events(lines, columns=["id", "doc"], **preprocessing())
    return good.select(
        "id",
        F.get_json_object("doc", "$['vars.rfc5424-sd.ev@1.name']").alias("name"),
        F.get_json_object("doc", "$['vars.rfc5424-sd.u.id']").alias("user_id"),
        F.get_json_object("doc", "$['vars.rfc5424-sd.ev@1.q']").alias("quoted"),
    )


# Messages of each family, made from event columns; {} takes the SQL dialect's text cast.
_IP = "concat('10.0.', user_id % 200, '.', event_id % 250)"
_PORT = "cast(1024 + event_id % 5000 as {s})"
_FAMILIES = {
    "iptables": (
        f"concat('[', user_id, '.5] iptables: IN=eth', user_id % 4, ' OUT= SRC=', {_IP}, "
        "case when event_type = 'view' then ' DF' else '' end, ' LEN=', event_id % 1500)"
    ),
    "ssh": (
        f"case event_id % 5 when 0 then concat('Failed password for ', event_type, ' from ', {_IP}, "
        f"' port ', {_PORT}, ' ssh2') "
        f"when 1 then concat('Failed password for invalid user ', event_type, ' from ', {_IP}, "
        f"' port ', {_PORT}, ' ssh2') "
        f"when 2 then concat('Received disconnect from ', {_IP}, ' port ', {_PORT}, ':11: Bye ', event_type) "
        f"when 3 then concat('Disconnected from authenticating user ', event_type, ' ', {_IP}, "
        f"' port ', {_PORT}, ' [preauth]') "
        f"else concat('Accepted password for ', event_type, ' from ', {_IP}) end"
    ),
    "pam": (
        "concat('pam_unix(', event_type, ':auth): ', case event_id % 7 "
        f"when 0 then concat('authentication failure; logname= uid=', user_id, ' euid=0 tty=ssh ruser= rhost=', {_IP}, ' ') "
        f"when 1 then concat('authentication failure; logname=x uid=', user_id, ' euid=0 tty=ssh ruser=y rhost=', {_IP}, '  user=u', user_id) "
        "when 2 then concat('session closed for user u', user_id) "
        "when 3 then concat('session opened for user u', user_id, ' by (uid=0)') "
        "when 4 then concat('session opened for user u(uid=', user_id, ') by (uid=0)') "
        "when 5 then 'check pass; user unknown' else 'check pass; user known' end)"
    ),
    "smartd": (
        "concat('Device: /dev/sd', user_id % 20, ' [SAT], SMART Usage Attribute: ', user_id, ' ', event_type, "
        "' changed from ', event_id % 100, ' to ', event_id % 90)"
    ),
    "dnsmasq": (
        f"concat('DHCP', upper(event_type), '(eth', user_id % 3, ') ', {_IP}, ' 00:1a:2b:3c:4d:', "
        "10 + user_id % 90, case when event_id % 2 = 0 then concat(' pc', user_id) else '' end)"
    ),
    "postfix": (
        "concat('statistics: max connection ', case when event_id % 2 = 0 "
        "then concat('rate ', user_id, '/60s') else concat('count ', user_id) end, "
        f"' for (', event_type, ':', {_IP}, ') at Jan ', 10 + event_id % 20, ' 03:04:05')"
    ),
}


def _messages(family: str, dialect: str) -> str:
    return _FAMILIES[family].replace("{s}", "string" if dialect == "spark" else "varchar")


def _extract(rule: str, regex: str, names: list[str], when: str = "true") -> str:
    """SQL rows ``(event_id, rule, key, value)`` of one pattern."""
    items = ", ".join(
        f"{{'key': '{n}', 'value': regexp_extract(msg, '{regex}', {i})}}"
        for i, n in enumerate(names, 1)
    )
    return f"""
      select event_id, '{rule}' as rule, unnest([{items}], recursive := true) from m
      where regexp_full_match(msg, '{regex}') and {when}
    """


def _family(family: str, *parts: str) -> None:
    messages = f"(select event_id, event_type, {_messages(family, 'duckdb')} as msg from events)"
    sql = f"with m as (select * from {messages}) " + " union all ".join(f"({p})" for p in parts)

    @query(f"normalize_{family}", sql)
    def build(t):
        rows = t.events.select(
            "event_id", F.expr(_messages(family, "spark")).alias("msg")
        )
        # the outer form adds no filter on the fields, which would compute them twice
        return (
            normalize_messages(rows)
            .select("event_id", "rule", F.explode_outer("vars").alias("key", "value"))
            .where(F.col("key").isNotNull())
        )


_family(
    "iptables",
    _extract(
        "iptables",
        r"\[([^\]]*)\] iptables: IN=(\S*) OUT=(\S*) SRC=(\S*)(?: DF)? LEN=(\d+)",
        ["uptime", "IN", "OUT", "SRC", "LEN"],
    ),
    "select event_id, 'iptables', 'DF', null from m where event_type = 'view'",
)
_ADDRESS = r"(\d+\.\d+\.\d+\.\d+)"
_LOGIN = ["user", "address", "port", "protocol"]
_family(
    "ssh",
    _extract("ssh_failed", rf"Failed password for (\S+) from {_ADDRESS} port (\d+) (\S+)", _LOGIN),
    _extract(
        "ssh_failed_invalid_user",
        rf"Failed password for invalid user (\S+) from {_ADDRESS} port (\d+) (\S+)",
        _LOGIN,
    ),
    _extract(
        "ssh_received_disconnect",
        rf"Received disconnect from {_ADDRESS} port (\d+):11: .*",
        ["address", "port"],
    ),
    _extract(
        "ssh_disconnected_preauth",
        rf"Disconnected from authenticating user (\S+) {_ADDRESS} port (\d+) \[preauth\]",
        ["user", "address", "port"],
    ),
)
_PREFIX = r"(\w+)\((\w+):(\w+)\): "
_FAILED = r"authentication failure; logname=(\w*) uid=(\d+) euid=(\d+) tty=(\w*) ruser=(\w*) rhost="
_PAM = ["module", "source", "step"]
_PAM_FAILED = [*_PAM, "logname", "uid", "euid", "tty", "ruser", "rhost"]
_family(
    "pam",
    _extract("pam_auth_failure", _PREFIX + _FAILED + _ADDRESS + " +", _PAM_FAILED),
    _extract("pam_auth_failure_user", _PREFIX + _FAILED + _ADDRESS + r"  user=\S+", _PAM_FAILED),
    # a pattern may have nine groups there, so the tenth comes from a second one
    _extract("pam_auth_failure_user", r"pam.* authentication failure; .*  user=(\S+)", ["user"]),
    _extract("pam_session_closed", _PREFIX + r"session closed for user (\w+)", [*_PAM, "user"]),
    _extract(
        "pam_session_opened",
        _PREFIX + r"session opened for user (\w+) by \(uid=(\d+)\)",
        [*_PAM, "user", "old-uid"],
    ),
    _extract(
        "pam_session_opened_uid",
        _PREFIX + r"session opened for user (\w+)\(uid=(\d+)\) by \(uid=(\d+)\)",
        [*_PAM, "user", "uid", "old-uid"],
    ),
    _extract("pam_check_pass", _PREFIX + "check pass; user unknown", _PAM),
)
_family(
    "smartd",
    _extract(
        "smartd_attribute",
        r"Device: (\S+) \[(\w+)\], SMART (\w+) Attribute: (\d+) (\w+) changed from (\d+) to (\d+)",
        ["device", "type", "attr-type", "attr-id", "attr-name", "old-value", "new-value"],
    ),
)
_LEASE = rf"DHCP(\w+)\((\w+)\) {_ADDRESS} ([0-9a-f:]{{17}})"
_LEASED = ["action", "device", "ip", "mac"]
_family(
    "dnsmasq",
    _extract("dnsmasq_dhcp", _LEASE, _LEASED),
    _extract("dnsmasq_dhcp_host", _LEASE + r" (\S+)", [*_LEASED, "host"]),
)
_PEAK = rf" for \((\w+):{_ADDRESS}\) at (\w+ \d+ [0-9:]+)"
_family(
    "postfix",
    _extract(
        "postfix_max_rate",
        r"statistics: max connection rate (\d+)/60s" + _PEAK,
        ["per-minute", "transport", "address", "date"],
    ),
    _extract(
        "postfix_max_count",
        r"statistics: max connection count (\d+)" + _PEAK,
        ["connections", "transport", "address", "date"],
    ),
)


_INTERVALS = {
    "year": "1 year", "quarter": "3 months", "month": "1 month", "week": "7 days",
    "day": "1 day", "hour": "1 hour", "minute": "1 minute",
}


def _periods_sql(shift: bool, column: str, key: str, table: str) -> str:
    return f"select {key}, " + ", ".join(
        f"cast(date_trunc('{u}', {column}) {f'+ interval {chr(39)}{step}{chr(39)}' if shift else ''} "
        f"as timestamp) as {u}_at"
        for u, step in _INTERVALS.items()
    ) + f" from {table}"


@query("partition_floor", _periods_sql(False, "ts", "event_id", "events"))
def partition_floors(t):
    return t.events.select(
        "event_id", *[period_floor(F.col("ts"), u).alias(f"{u}_at") for u in PERIODS]
    )


@query("partition_ceiling", _periods_sql(True, "ts", "event_id", "events"))
def partition_ceilings(t):
    return t.events.select(
        "event_id", *[period_ceiling(F.col("ts"), u).alias(f"{u}_at") for u in PERIODS]
    )


@query("partition_floor_orders", _periods_sql(False, "o_orderdate", "o_orderkey", "orders"))
def partition_floor_orders(t):
    return t.orders.select(
        "o_orderkey", *[period_floor(F.col("o_orderdate"), u).alias(f"{u}_at") for u in PERIODS]
    )


@query("partition_ceiling_orders", _periods_sql(True, "o_orderdate", "o_orderkey", "orders"))
def partition_ceiling_orders(t):
    return t.orders.select(
        "o_orderkey", *[period_ceiling(F.col("o_orderdate"), u).alias(f"{u}_at") for u in PERIODS]
    )


@query("partition_name", """
  select event_id, strftime(ts, 'logs_%Y_%m') as month_name,
         strftime(ts, 'logs_%Y%m%d-%H:%M') as minute_name
  from events
""")
def partition_names(t):
    at = F.col("ts")
    return t.events.select(
        "event_id",
        partition_name(at, "logs_[year]_[month]").alias("month_name"),
        partition_name(at, "logs_[year][month][day]-[hour]:[minute]").alias("minute_name"),
    )


@query("partition_bounds", """
  select cast(date_trunc('quarter', o_orderdate) as timestamp) as lower,
         cast(date_trunc('quarter', o_orderdate) + interval '3 months' as timestamp) as upper,
         count(*) as n, strftime(date_trunc('quarter', o_orderdate), 'orders_%Y_%m') as name
  from orders group by all
""")
def partition_bounds_query(t):
    cols = LogColumns(tstamp="o_orderdate")
    return partition_bounds(t.orders, "quarter", "orders_[year]_[month]", cols)


@query("partition_columns", """
  select l_orderkey, l_linenumber, cast(date_trunc('year', l_shipdate) as timestamp) as p_year,
         cast(date_trunc('month', l_shipdate) as timestamp) as p_month,
         cast(strftime(l_shipdate, '%Y%m%d%H') as bigint) as p_hour
  from lineitem
""")
def partition_columns_query(t):
    rows = with_partitions(
        t.lineitem, ["year", "month", "hour"], LogColumns(tstamp="l_shipdate")
    )
    dates = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("p_year", "p_month")]
    return rows.select("l_orderkey", "l_linenumber", *dates, "p_hour")


@query("import_stream", f"""
  select event_id as id, ts as tstamp, {_DOC} as doc from events where user_id % 9 <> 8
""")
def import_stream(t):
    """The raw lines as a stream into a stored table, followed to its end."""
    folder = t.work_folder()
    lines = t.spark.readStream.schema(t.events.schema).option(
        "pathGlobFilter", "events.parquet"
    ).parquet(t.folder)
    start_import(
        t.raw_lines(lines),
        f"{folder}/logs",
        f"{folder}/quarantine",
        f"{folder}/checkpoint",
        levels=["month", "day"],
        trigger={"availableNow": True},
    ).awaitTermination()
    return read_logs(t.spark, f"{folder}/logs", ["month", "day"]).select("id", "tstamp", "doc")


@query("import_replayed", f"""
  select event_id as id, ts as tstamp, {_DOC} as doc from events where user_id % 9 <> 8
""")
def import_replayed(t):
    """The raw lines as a stream into a committed table. The first run stops between the
    write and the commit of a batch, the second repeats the batch, the third finds nothing."""
    folder = t.work_folder()

    def follow(before_commit=None):
        lines = t.spark.readStream.schema(t.events.schema).option(
            "pathGlobFilter", "events.parquet"
        ).parquet(t.folder)
        start_committed_import(
            t.raw_lines(lines),
            f"{folder}/logs",
            f"{folder}/quarantine",
            f"{folder}/checkpoint",
            levels=["month", "day"],
            trigger={"availableNow": True},
            before_commit=before_commit,
        ).awaitTermination()

    def stop():
        raise InterruptedError("between write and commit")

    try:
        follow(stop)
    except StreamingQueryException:
        follow()
    follow()
    return log_table(t.spark, f"{folder}/logs", ["month", "day"]).read().select("id", "tstamp", "doc")
