"""Raw JSON events to log rows; unusable lines go to quarantine with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.flatten import (
    bind_once,
    flatten_nodes,
    json_quote,
    merge_entries,
    node_entries,
)
from emberlog.functions.syslog import (
    facility_name,
    format_rfc3339,
    parse_rfc3339,
    severity_name,
    trim_first_space,
)
from emberlog.functions.text import tokens
from emberlog.operators.normalize import (
    RULES,
    Rule,
    json_entries,
    matched_rule,
    rule_fields,
    structured_data_entries,
)
from emberlog.schema import (
    LOG_SCHEMA,
    OPTIONAL_KEYS,
    RAW_EVENT_SCHEMA,
    REQUIRED_KEYS,
    STRUCTURED_DATA_KEY,
    VARIABLES_KEY,
)

# Names of the flattened variables and of the replacement message.
VARS = "vars"
VARS_MSG = "vars.msg"


def parse_events(
    raw: DataFrame,
    trim_message: bool = False,
    structured_data: bool = False,
    rules: Sequence[Rule] | None = None,
    swap_message: bool = True,
    line: str = "value",
) -> DataFrame:
    """All columns of ``raw`` plus the log columns and ``reason``.

    ``reason`` is NULL for a usable event and says what is wrong otherwise; the
    log columns are then NULL. Blank lines are skipped. An ``id`` column of
    ``raw`` is kept; without one the id is a hash of the line, its file and its
    place in the source, so that equal lines have ids of their own. A stream has no
    places; its importer adds them (see ``streaming/importer.py``).

    The three preprocessing steps work as in a syslog daemon in front of the
    import: remove one leading space, take variables from RFC 5424 structured
    data, take variables from the first pattern rule that matches.
    """
    kept = [c for c in raw.columns if c not in ("id", "reason", *LOG_SCHEMA.names)]
    origin = [F.col(c) for c in ("source_file", "source_row") if c in raw.columns]
    if "source_row" not in raw.columns and not raw.isStreaming:
        origin.append(F.monotonically_increasing_id())
    row_id = F.col("id").cast("long") if "id" in raw.columns else F.xxhash64("_line", *origin)
    usable = F.col("reason").isNull()
    # one select per step, because a step's columns are used many times in the next
    return (
        raw.where(_trimmed(line) != "")
        .withColumn("_line", _trimmed(line))
        .withColumn("_v", _sealed_variant())
        .select(
            *kept,
            row_id.alias("id"),
            (F.col("_line").startswith("{") & _is_sealed()).alias("_is_object"),
            F.from_json("_line", RAW_EVENT_SCHEMA).alias("_e"),
            _repeated_key().alias("_repeated"),
            _known_members().alias("_m"),
        )
        .select(
            "*",
            parse_rfc3339(F.col("_e.timereported")).alias("_reported"),
            parse_rfc3339(F.col("_e.timegenerated")).alias("_generated"),
            severity_name(F.col("_e.syslogseverity")).alias("_severity"),
            facility_name(F.col("_e.syslogfacility")).alias("_facility"),
            _own_variables().alias("_own"),
        )
        .select("*", flatten_nodes(F.col("_e")[VARIABLES_KEY], F.col("_own"), VARS).alias("_nodes"))
        .select(
            "*",
            _reject_reason().alias("reason"),
            (trim_first_space(F.col("_e.msg")) if trim_message else F.col("_e.msg")).alias("_msg"),
        )
        .select("*", _rule(rules).alias("_rule"))
        .select("*", _all_variables(structured_data, rules).alias("_vars"))
        .select("*", _replacement().alias("_replacement"))
        .select("*", *_message_and_variables(swap_message))
        .select("*", _document().alias("_doc"), _search_text().alias("_search"))
        .select(
            *kept,
            "id",
            F.when(usable, F.col("_reported")).alias("tstamp"),
            F.when(usable, F.col("_doc")).alias("doc"),
            F.when(usable, F.parse_json("_doc")).alias("doc_v"),
            F.when(usable, tokens(F.col("_search"))).alias("search"),
            "reason",
        )
    )


def _trimmed(line: str) -> Column:
    return F.btrim(F.col(line), F.lit(" \t\r\n\f"))


def _sealed_variant() -> Column:
    """The line as VARIANT, together with its own hash: ``[line, hash]``.

    The JSON reader ignores what follows the first value of a text. If the hash
    comes out again, the line was exactly one value.
    """
    line = F.col("_line")
    return F.try_parse_json(
        F.concat(F.lit("["), line, F.lit(","), F.xxhash64(line), F.lit("]"))
    )


def _is_sealed() -> Column:
    seal = F.try_variant_get("_v", "$[1]", "long")
    return F.coalesce(seal == F.xxhash64("_line"), F.lit(False))


def _known_members() -> Column:
    """The values of the known keys as VARIANTs, in one extraction."""
    keys = (*REQUIRED_KEYS, *OPTIONAL_KEYS, VARIABLES_KEY)
    return F.try_variant_get("_v", "$[0]", f"struct<{', '.join(f'`{k}`:variant' for k in keys)}>")


def _member(key: str) -> str:
    return f"_m.`{key}`"


def _repeated_key() -> Column:
    """A known key that the line gives more than once, NULL if there is none."""
    known = [F.lit(k) for k in (*REQUIRED_KEYS, *OPTIONAL_KEYS, VARIABLES_KEY)]
    keys = F.filter(F.json_object_keys("_line"), lambda k: k.isin(*known))

    def again(found: Column) -> Column:
        def before(k: Column, i: Column) -> Column:
            return F.array_position(found, k) <= i

        return F.when(
            F.size(F.array_distinct(found)) < F.size(found), F.get(F.filter(found, before), F.lit(0))
        )

    return bind_once(keys, again)


def _own_variables() -> Column:
    """The event's variables as VARIANT; a JSON null counts as absent."""
    own = _member(VARIABLES_KEY)
    return F.expr(f"CASE WHEN NOT is_variant_null({own}) THEN {own} END")


def _reject_reason() -> Column:
    """What is wrong with a parsed line, NULL when nothing is."""

    def kind(key: str) -> str:
        return f"schema_of_variant({_member(key)})"

    cases = {
        "NOT _is_object": "'not a JSON object'",
        "_repeated IS NOT NULL": "concat('repeated ', _repeated)",
    }
    for key in REQUIRED_KEYS:
        cases[f"coalesce({kind(key)}, '') <> 'STRING'"] = (
            f"if({_member(key)} IS NULL, 'missing {key}', '{key} is not a string')"
        )
    for key in OPTIONAL_KEYS:
        cases[f"{kind(key)} NOT IN ('STRING', 'VOID')"] = f"'{key} is not a string'"
    cases |= {
        "_reported IS NULL": "'invalid timereported'",
        "_generated IS NULL": "'invalid timegenerated'",
        "_severity IS NULL": "'invalid syslogseverity'",
        "_facility IS NULL": "'invalid syslogfacility'",
    }
    whens = " ".join(f"WHEN {test} THEN {reason}" for test, reason in cases.items())
    return F.expr(f"CASE {whens} END")


def _rule(rules: Sequence[Rule] | None) -> Column:
    return matched_rule(F.col("_msg"), rules) if rules else F.lit(None).cast("string")


def _all_variables(structured_data: bool, rules: Sequence[Rule] | None) -> Column:
    """Entries of the event's own variables and of the preprocessing steps."""
    found = [node_entries(F.col("_nodes"))]
    extra = []
    if structured_data:
        extra.append(structured_data_entries(F.col("_e")[STRUCTURED_DATA_KEY]))
    if rules:
        extra.append(json_entries(rule_fields(F.col("_msg"), F.col("_rule"), rules)))
    for entries in extra:
        found.append(
            F.transform(
                entries,
                lambda e: F.struct(
                    F.concat(F.lit(VARS + "."), e["key"]).alias("key"), e["json"].alias("json")
                ),
            )
        )
    empty = F.array().cast("array<struct<key:string,json:string>>")
    found = [F.coalesce(e, empty) for e in found]
    return merge_entries(F.concat(*found) if extra else found[0])


def _printable(json: Column) -> Column:
    """Display text of a leaf given as JSON text."""
    return (
        F.when(json.startswith('"'), F.get_json_object(json, "$"))
        .when(json.startswith("["), F.concat(F.lit("="), json))
        .otherwise(json)
    )


def _replacement() -> Column:
    """JSON text of ``vars.msg``, NULL when absent."""
    return F.get(F.filter("_vars", lambda e: e["key"] == VARS_MSG), F.lit(0))["json"]


def _message_and_variables(swap: bool) -> list[Column]:
    """Final message and variables: exchanged where ``vars.msg`` is present."""
    msg, variables = F.col("_msg"), F.col("_vars")
    if not swap:
        return [msg.alias("_final_msg"), variables.alias("_final_vars")]
    replacement = F.col("_replacement")
    swapped = F.transform(
        variables,
        lambda e: F.when(
            e["key"] == VARS_MSG, F.struct(e["key"].alias("key"), json_quote(msg).alias("json"))
        ).otherwise(e),
    )
    return [
        F.coalesce(_printable(replacement), msg).alias("_final_msg"),
        F.when(replacement.isNotNull(), swapped).otherwise(variables).alias("_final_vars"),
    ]


def _members(optional: bool = False, **fields: Column) -> Column:
    """``"key":"text"`` parts sorted by key; an absent text prints null, or
    nothing if ``optional``."""
    named = F.struct(*[value.alias(key) for key, value in sorted(fields.items())])
    json = F.to_json(named, {"ignoreNullFields": str(optional).lower()})
    return F.nullif(F.btrim(json, F.lit("{}")), F.lit("")) if optional else F.substr(
        json, F.lit(2), F.length(json) - F.lit(2)
    )


def _document() -> Column:
    """Canonical document text: keys in alphabetical order, variables last."""
    event = F.col("_e")
    parts = [
        _members(
            app_name=event["app-name"],
            fromhost=event["fromhost"],
            fromhost_ip=event["fromhost-ip"],
            hostname=event["hostname"],
            inputname=event["inputname"],
            msg=F.col("_final_msg"),
        ),
        _members(optional=True, msgid=event["msgid"]),
        _members(
            procid=event["procid"],
            programname=event["programname"],
            protocol_version=event["protocol-version"],
            syslogfacility=F.col("_facility"),
            syslogseverity=F.col("_severity"),
            syslogtag=event["syslogtag"],
            timegenerated=format_rfc3339(F.col("_generated")),
            timereported=format_rfc3339(F.col("_reported")),
        ),
        _members(optional=True, uuid=event["uuid"]),
    ]
    variables = F.transform(
        F.col("_final_vars"), lambda e: F.concat(json_quote(e["key"]), F.lit(":"), e["json"])
    )
    return F.concat(F.lit("{"), F.concat_ws(",", *parts, variables), F.lit("}"))


def _search_text() -> Column:
    event = F.col("_e")
    variables = F.transform(
        F.filter(F.col("_final_vars"), lambda e: e["key"].startswith(VARS + ".")),
        lambda e: F.concat(e["key"], F.lit("="), e["json"]),
    )
    return F.concat_ws(
        " ",
        json_quote(event["hostname"]),
        json_quote(F.col("_final_msg")),
        json_quote(event["syslogtag"]),
        variables,
    )


def _emit_where(parsed: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """``parsed.where(condition).select(columns)``, evaluated after the parsing.

    A plain filter would be pushed below the steps it depends on, which repeats
    their expressions in the filter and parses a line many times over.
    """
    row = F.struct(*columns)
    return parsed.select(F.inline(F.when(condition, F.array(row))))


def split_events(
    parsed: DataFrame, line: str = "value", columns: Sequence[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(good, quarantine)`` of parsed events. Of the log columns those named are given and
    the others are not computed; a later select alone does not spare them."""
    extra = [c for c in ("source_file",) if c in parsed.columns]
    reason = F.col("reason")
    return (
        _emit_where(parsed, reason.isNull(), list(columns or LOG_SCHEMA.names)),
        _emit_where(parsed, reason.isNotNull(), ["id", line, "reason", *extra]),
    )


def import_events(
    raw: DataFrame, line: str = "value", columns: Sequence[str] | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Raw lines to ``(good, quarantine)``; ``columns`` as in :func:`split_events`, options as
    in :func:`parse_events`."""
    return split_events(parse_events(raw, line=line, **options), line, columns)


def preprocessing(rules: Sequence[Rule] = RULES) -> dict:
    """Options that turn all preprocessing steps on."""
    return {"trim_message": True, "structured_data": True, "rules": rules}


def with_sequence_id(df: DataFrame, first: int = 1, name: str = "id") -> DataFrame:
    """Growing unique ids from ``first``, with gaps, without a shuffle.

    Give the largest stored id plus one to continue a table. Ids are unique
    within one run of the job; a hash id (see :func:`parse_events`) is also stable
    between runs.
    """
    return df.withColumn(name, F.monotonically_increasing_id() + F.lit(first))
