"""Field predicates, getters and full text over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberlog.functions import predicates as P
from emberlog.functions.fields import (
    field_json,
    field_number,
    field_printable,
    field_text,
    int_or_null,
)
from emberlog.functions.filters import as_condition
from emberlog.functions.sql import register_sql_functions
from emberlog.functions.text import (
    text_all,
    text_any,
    text_none,
    text_phrase,
    text_search,
    text_websearch,
    tokens,
)
from emberlog.operators.postings import (
    build_postings,
    lookup,
    lookup_phrase,
    write_positions,
)
from emberlog.operators.timerange import time_range
from emberlog.plans.base import LOGS_SQL, WORDS_SQL, query
from emberlog.schema import LogColumns
from emberlog.sources.logtable import as_logs
from emberlog.sources.views import EVENT_COLUMNS as EVENTS
from emberlog.sources.views import logs_from_lineitem


def _where(name: str, condition, sql: str) -> None:
    """A query for the ids of the events a condition keeps."""

    @query(name, f"select id, k from {LOGS_SQL} where {sql}")
    def build(t):
        return t.logs.where(condition()).select("id", field_number("vars.k").alias("k"))


def _value(name: str, sql: str, **conditions) -> None:
    """A query for what conditions say of each event: true, false or NULL."""

    @query(name, f"select id, {sql} from {LOGS_SQL}")
    def build(t):
        said = [condition().alias(column) for column, condition in conditions.items()]
        return t.logs.select("id", *said)


_where("eq_scalar", lambda: P.eq("event_type", "click"), "event_type = 'click'")
_where("eq_number", lambda: P.eq("vars.k", 42.0), "k = 42")
_where("eq_fraction", lambda: P.eq("value", 12.5), "value = 12.5")
_value(
    "eq_type_matters",
    "false as as_text, k = 42 as as_number",
    as_text=lambda: P.eq("vars.k", "42"),
    as_number=lambda: P.eq("vars.k", 42),
)
_where("lt", lambda: P.lt("vars.k", 7), "k < 7")
_where("le", lambda: P.le("vars.k", 7), "k <= 7")
_where("gt", lambda: P.gt("vars.k", 92.5), "k > 92.5")
_where("ge", lambda: P.ge("vars.k", 93), "k >= 93")
_value(
    "gt_fraction_is_null",
    "cast(null as boolean) as as_int, value > 1 as as_double",
    as_int=lambda: P.gt("value", 1),
    as_double=lambda: P.gt("value", 1, numeric="double"),
)
_where("gt_double", lambda: P.gt("value", 99.5, numeric="double"), "value > 99.5")
_where("like", lambda: P.like("event_type", r"%i_k"), "event_type like '%i_k'")
_value(
    "like_escape",
    "event_type like 'c%' as plain, event_type like 'c%^_%' escape '^' as escaped",
    plain=lambda: P.like("event_type", r"\c%"),
    escaped=lambda: P.like("event_type", r"\c%\_%"),
)
_where("in_text", lambda: P.in_list("vars.k", [3, "5", 7.0]), "cast(k as varchar) in ('3', '5', '7.0')")
_value(
    "in_empty",
    "false as of_none, k = 3 as of_one",
    of_none=lambda: P.in_list("vars.k", []),
    of_one=lambda: P.in_list("vars.k", [3]),
)
_where(
    "and_or_not",
    lambda: ~P.eq("event_type", "view") & (P.lt("vars.k", 10) | P.gt("vars.k", 90)),
    "not event_type = 'view' and (k < 10 or k > 90)",
)
_where("match_all", lambda: as_condition(None), "true")

def _promoted(name: str, condition, sql: str) -> None:
    """The same on the columns that stand for the fields."""

    @query(name, f"select id, event_type from {LOGS_SQL} where {sql}")
    def build(t):
        return t.logs.where(condition()).select("id", "event_type")


_promoted("promoted_eq", lambda: P.eq("event_type", "click", EVENTS), "event_type = 'click'")
_promoted("promoted_number", lambda: P.eq("user_id", 7, EVENTS), "user_id = 7")
_promoted(
    "promoted_mixed",
    lambda: ~P.eq("event_type", "view", EVENTS)
    & (P.lt("vars.k", 10, cols=EVENTS) | P.gt("value", 90, "double", EVENTS)),
    "event_type <> 'view' and (k < 10 or value > 90)",
)

_SOMETIMES = """(
  select event_id as id, case when user_id % 3 = 1 then 'a' when user_id % 3 = 2 then 'b' end as f
  from events
)"""


def _sometimes(t):
    """Logs whose field ``f`` is absent for a third of the users."""
    f = F.when(F.col("user_id") % 3 == 1, "a").when(F.col("user_id") % 3 == 2, "b")
    return as_logs(
        t.events.select(
            F.col("event_id").alias("id"),
            F.col("ts").alias("tstamp"),
            F.to_json(F.struct(f.alias("f"))).alias("doc"),
        )
    )


@query("not_null_logic", f"""
  select id, cast(f = 'a' as varchar) as is_a, cast(not f = 'a' as varchar) as is_not_a,
         cast(f = 'a' and f = 'b' as varchar) as both, cast(f = 'a' or f = 'b' as varchar) as either
  from {_SOMETIMES}
""")
def not_null_logic(t):
    a, b = P.eq("f", "a"), P.eq("f", "b")
    outcomes = {"is_a": a, "is_not_a": ~a, "both": a & b, "either": a | b}
    return _sometimes(t).select(
        "id", *[c.cast("string").alias(name) for name, c in outcomes.items()]
    )


@query("not_drops_absent", f"select id from {_SOMETIMES} where not f = 'a'")
def not_drops_absent(t):
    return _sometimes(t).where(~P.eq("f", "a")).select("id")


def _document_logs(t):
    """Documents whose field ``words`` is the array of their tokens."""
    fields = F.struct("lang", "n_chars", tokens(F.col("text")).alias("words"))
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.to_json(fields).alias("doc"),
        F.to_variant_object(fields).alias("doc_v"),
    )


@query("eq_any_element", f"select id from {WORDS_SQL} where list_contains(search, 'the')")
def eq_any_element(t):
    return _document_logs(t).where(P.eq("words", "the")).select("id")


@query("eq_list", f"""
  select id from {WORDS_SQL} where list_contains(search, 'the') and list_contains(search, 'is')
""")
def eq_list(t):
    return _document_logs(t).where(P.eq("words", ["the", "is", "the"])).select("id")


@query("eq_empty_list", f"select id from {WORDS_SQL}")
def eq_empty_list(t):
    return _document_logs(t).where(P.eq("words", [])).select("id")


@query("eq_list_on_scalar", f"""
  select id, false as listed, d.lang = 'en' as plain
  from {WORDS_SQL} w join documents d on d.doc_id = w.id
""")
def eq_list_on_scalar(t):
    return _document_logs(t).select(
        "id", P.eq("lang", ["en"]).alias("listed"), P.eq("lang", "en").alias("plain")
    )


@query("between_range", """
  select l_orderkey, l_linenumber from lineitem
  where l_shipdate between timestamp '1996-03-01' and timestamp '1997-02-28 12:00:00'
""")
def between_range(t):
    cols = LogColumns(tstamp="l_shipdate")
    rows = time_range(t.lineitem, "1996-03-01", "1997-02-28T12:00:00", cols=cols)
    return rows.select("l_orderkey", "l_linenumber")


@query("field_getters", f"""
  select id, event_type as text, cast(value as varchar) as number_text, cast(k as int) as number,
         cast(null as varchar) as absent, event_type as printable, cast(k as varchar) as json
  from {LOGS_SQL}
""")
def field_getters(t):
    return t.logs.select(
        "id",
        field_text("event_type").alias("text"),
        field_text("value").alias("number_text"),
        field_number("vars.k").alias("number"),
        field_text("none").alias("absent"),
        field_printable("event_type").alias("printable"),
        field_json("vars.k").cast("string").alias("json"),
    )


@query("int_or_null", """
  select doc_id, count(*) as n_words, count(i) as n_ints, cast(coalesce(sum(i), 0) as bigint) as total
  from (
    select doc_id,
           case when regexp_full_match(w, '[+-]?[0-9]+') then try_cast(w as int) end as i
    from (select doc_id, unnest(regexp_split_to_array(text, '[ \\n\\t\\r]+')) as w from documents)
  )
  group by doc_id
""")
def int_or_null_query(t):
    words = F.split("text", "[ \n\t\r]+")
    numbers = F.filter(F.transform("words", int_or_null), lambda i: i.isNotNull())
    total = F.aggregate("ints", F.lit(0).cast("long"), lambda so_far, i: so_far + i)
    # a text is counted where it is read; a shuffle gets one row of it
    counted = (
        t.documents.where(F.col("text").isNotNull())
        .select("doc_id", words.alias("words"))
        .select("doc_id", F.size("words").alias("n_words"), numbers.alias("ints"))
        .select("doc_id", "n_words", F.size("ints").alias("n_ints"), total.alias("total"))
    )
    return counted.groupBy("doc_id").agg(
        F.sum("n_words").alias("n_words"),
        F.sum("n_ints").alias("n_ints"),
        F.sum("total").alias("total"),
    )


@query("sql_functions", f"""
  select id, event_type from {LOGS_SQL}
  where event_type = 'click' and k > 50 or event_type like 'v%' and k in (1, 2, 3)
""")
def sql_functions(t):
    register_sql_functions(t.spark)
    condition = """
      log_eq(doc_v, 'event_type', 'click') AND log_gt(doc, 'vars.k', 50)
      OR log_like(doc, 'event_type', 'v%') AND log_in(doc, 'vars.k', array('1', '2', '3'))
    """
    return t.logs.where(as_condition(condition)).select(
        "id", field_text("event_type").alias("event_type")
    )


@query("sql_number_functions", f"""
  select id, k = 42 as same, k < 42 as lt, k <= 42 as le, k > 42 as gt, k >= 42 as ge,
         k = 41 as above_fraction, event_type like 'c%' as escaped, false as scalar_has_all
  from {LOGS_SQL}
""")
def sql_number_functions(t):
    """What the SQL functions on numbers and patterns say of each event."""
    register_sql_functions(t.spark)
    said = {"same": "log_eq_number(doc_v, 'vars.k', 42.0)"}
    said |= {name: f"log_{name}(doc, 'vars.k', 42)" for name in ("lt", "le", "gt", "ge")}
    # no rounding: 40.9999999999 < k < 41.0000000001
    said["above_fraction"] = (
        "log_gt(doc, 'vars.k', 40.9999999999) AND log_lt(doc, 'vars.k', 41.0000000001)"
    )
    said["escaped"] = r"log_like(doc, 'event_type', '\\c%')"
    said["scalar_has_all"] = "log_has_all_numbers(doc_v, 'vars.k', array('42'))"
    return t.logs.select("id", *[F.expr(text).alias(name) for name, text in said.items()])


@query("sql_text_functions", f"""
  select id from {WORDS_SQL}
  where list_contains(search, 'the') and not list_contains(search, 'und')
    and contains(' ' || array_to_string(search, ' ') || ' ', ' of the ')
""")
def sql_text_functions(t):
    register_sql_functions(t.spark)
    condition = (
        "log_all(search, array('the')) AND log_none(search, array('und')) "
        "AND log_phrase(search, 'of the')"
    )
    return t.words.where(condition).select("id")


def _text(name: str, condition, sql: str) -> None:
    @query(name, f"select id from {WORDS_SQL} where {sql}")
    def build(t):
        return t.words.where(condition()).select("id")


_FRAMED = "(' ' || array_to_string(search, ' ') || ' ')"
_text("text_all", lambda: text_all("the", "of", "that"),
      "list_contains(search, 'the') and list_contains(search, 'of') and list_contains(search, 'that')")
_text("text_any", lambda: text_any("und", "les", "los"),
      "list_contains(search, 'und') or list_contains(search, 'les') or list_contains(search, 'los')")
_text("text_none", lambda: text_none("the", "a"),
      "not list_contains(search, 'the') and not list_contains(search, 'a')")
_text("text_phrase", lambda: text_phrase("In THE"), f"contains({_FRAMED}, ' in the ')")
_text(
    "text_search",
    lambda: text_search(["the"], ["that", "und"], ["los"], ["of the"]),
    f"list_contains(search, 'the') and contains({_FRAMED}, ' of the ') and "
    "(list_contains(search, 'that') or list_contains(search, 'und')) "
    "and not list_contains(search, 'los')",
)
_text(
    "text_websearch",
    lambda: text_websearch('The -"of the" -una or ÉÉ or "et le" la-de or los -"de la"'),
    f"(list_contains(search, 'the') and not contains({_FRAMED}, ' of the ') "
    "and not list_contains(search, 'una')) or list_contains(search, 'éé') "
    f"or (contains({_FRAMED}, ' et le ') and contains({_FRAMED}, ' la de ')) "
    f"or (list_contains(search, 'los') and not contains({_FRAMED}, ' de la '))",
)


@query("tokens", f"""
  select id, len(search) as n, array_to_string(search, ' ') as joined from {WORDS_SQL}
""")
def tokens_query(t):
    return t.words.select(
        "id", F.size("search").cast("long").alias("n"), F.array_join("search", " ").alias("joined")
    )


@query("postings", f"""
  select token, count(*) as n, min(id) as first_id, max(id) as last_id
  from (select id, unnest(list_distinct(search)) as token from {WORDS_SQL}) group by token
""")
def postings_query(t):
    """The index, summed up per token."""
    return (
        build_postings(t.words)
        .groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("id").alias("first_id"),
            F.max("id").alias("last_id"),
        )
    )


@query("postings_rows", f"""
  select id, unnest(list_distinct(list_value(event_type, cast(k as varchar)))) as token
  from {LOGS_SQL}
""")
def postings_rows(t):
    return build_postings(t.logs)


@query("postings_lookup", f"""
  select id from {WORDS_SQL} where list_contains(search, 'the') and list_contains(search, 'that')
""")
def postings_lookup(t):
    return lookup(t.words, build_postings(t.words), ["the", "that"]).select("id")


@query("postings_lookup_any", f"""
  select id from {WORDS_SQL}
  where list_contains(search, 'und') or list_contains(search, 'los')
""")
def postings_lookup_any(t):
    return lookup(t.words, build_postings(t.words), ["und", "los"], "any").select("id")


@query("postings_phrase", f"select id from {WORDS_SQL} where contains({_FRAMED}, ' of the ')")
def postings_phrase(t):
    """A phrase found by shifted positions in stored postings."""
    path = t.work_folder()
    write_positions(t.words, path)
    return lookup_phrase(t.words, t.spark.read.parquet(path), "Of THE").select("id")


@query("sql_filter", f"""
  select id, k from {LOGS_SQL} where event_type = 'click' and k = 42 and user_id < 500
    or event_type like 'v%' and k in (1, 2) and not (value > 60) or id = 17
""")
def sql_filter(t):
    """A filter as text, rewritten onto the columns that stand for fields."""
    text = """
      log_eq(doc_v, 'event_type', 'click') AND log_eq_number(doc_v, 'vars.k', 42.0)
        AND log_lt(doc, 'user_id', 500)
      OR log_like(doc, 'event_type', 'v%') AND log_in(doc, 'vars.k', array(1, '2')) AND NOT (value > 60)
      OR id = 17
    """
    return t.logs.where(as_condition(text, EVENTS)).select("id", "k")


@query("ship_date_flags", """
  select date_trunc('month', l_shipdate)::timestamp as month, l_returnflag as flag, count(*) as n
  from lineitem where l_returnflag in ('A', 'R') group by all
""")
def ship_date_flags(t):
    """A filter on the document of another table, counted by month."""
    logs = logs_from_lineitem(t.lineitem).where(P.in_list("flag", ["A", "R"]))
    return logs.groupBy(
        F.date_trunc("month", "tstamp").alias("month"), field_text("flag").alias("flag")
    ).agg(F.count(F.lit(1)).alias("n"))
