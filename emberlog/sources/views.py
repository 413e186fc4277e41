"""Log tables derived from other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.text import tokens
from emberlog.schema import LogColumns


# The attributes of the event table stand for the fields of its documents.
EVENT_COLUMNS = LogColumns().promote_from(
    {
        "event_type": ("event_type", "string"),
        "user_id": ("user_id", "bigint"),
        "value": ("value", "double"),
        "vars.k": ("k", "int"),
    }
)


def logs_from_events(events: DataFrame) -> DataFrame:
    """An event table as a log table: its attributes become the document.

    The attributes stay columns as well; queries that are given
    ``EVENT_COLUMNS`` use these and never build the document.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    fields = F.struct("event_type", "user_id", "value", k.alias("vars.k"))
    return events.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("tstamp"),
        F.to_json(fields).alias("doc"),
        F.to_variant_object(fields).alias("doc_v"),
        tokens(F.concat_ws(" ", "event_type", k)).alias("search"),
        "event_type",
        "user_id",
        "value",
        k.alias("k"),
    )


def logs_from_documents(documents: DataFrame) -> DataFrame:
    """A document table as searchable rows (no time)."""
    return documents.select(
        F.col("doc_id").alias("id"), F.col("text"), tokens(F.col("text")).alias("search")
    )


ORDER_COLUMNS = LogColumns().promote_from(
    {"priority": ("priority", "string"), "total": ("total", "double")}
)


def logs_from_orders(orders: DataFrame) -> DataFrame:
    """Orders as log rows by order date."""
    priority = F.col("o_orderpriority").alias("priority")
    total = F.col("o_totalprice").alias("total")
    fields = F.struct(priority, total)
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("tstamp"),
        F.to_json(fields).alias("doc"),
        F.to_variant_object(fields).alias("doc_v"),
        priority,
        total,
    )


def logs_from_lineitem(lineitem: DataFrame) -> DataFrame:
    """Line items as log rows by ship date."""
    fields = F.struct(F.col("l_returnflag").alias("flag"))
    return lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_shipdate").alias("tstamp"),
        F.to_json(fields).alias("doc"),
        F.to_variant_object(fields).alias("doc_v"),
    )


def raw_lines_from_events(
    events: DataFrame,
    replacement: Column | None = None,
    structured_data: Column | None = None,
) -> DataFrame:
    """``(id, value)``: each event as a raw JSON syslog line with variables.

    A ninth of the users send an unknown severity, so their lines are rejected.
    ``replacement`` becomes the variable ``msg``; NULL leaves it out.
    """
    absent = F.lit(None).cast("string")
    # a column, because it is used many times
    numbered = events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("_k")
    user = F.col("user_id").cast("string")
    host = F.concat(F.lit("web"), (F.col("user_id") % 10).cast("string"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    variables = F.struct(
        (absent if replacement is None else replacement).alias("msg"),
        k.alias("k"),
        F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("kind")).alias("user"),
        F.array(F.col("event_type"), F.concat(F.lit("t"), k)).alias("tags"),
    )
    raw = {
        "msg": F.concat_ws(" ", F.lit("user"), user, F.col("event_type"), F.lit("#"), k),
        "timereported": time,
        "timegenerated": time,
        "hostname": host,
        "syslogtag": F.concat(F.col("event_type"), F.lit("["), user, F.lit("]:")),
        "inputname": F.lit("imudp"),
        "fromhost": host,
        "fromhost-ip": F.concat(F.lit("10.0.0."), (F.col("user_id") % 250).cast("string")),
        "syslogseverity": (F.col("user_id") % 9).cast("string"),
        "syslogfacility": (F.col("user_id") % 24).cast("string"),
        "programname": F.col("event_type"),
        "protocol-version": F.lit("1"),
        "app-name": F.col("event_type"),
        "procid": F.when(F.col("event_type") != "view", user),
        "structured-data": absent if structured_data is None else structured_data,
        "$!": variables,
    }
    line = F.to_json(F.struct(*[c.alias(name) for name, c in raw.items()]))
    return numbered.select(F.col("event_id").alias("id"), line.alias("value"))
