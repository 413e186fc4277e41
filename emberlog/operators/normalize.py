"""Message normalisation: pattern rules and structured data to variables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.functions.flatten import json_quote, merge_entries
from emberlog.functions.syslog import trim_first_space

# Field types of the patterns.
_WORD = r"\S+"
_NUMBER = r"\d+"
_IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"
_MAC48 = r"[0-9a-fA-F]{2}(?:[:-][0-9a-fA-F]{2}){5}"
_DATE3164 = r"[A-Z][a-z]{2} [ \d]\d \d{2}:\d{2}:\d{2}"


@dataclass(frozen=True)
class Rule:
    """A message family: the regular expression and the names of its groups.

    ``hint`` is text every match contains; it spares most rows the expression.
    With ``pairs`` one more group holds ``K=v`` words that become fields too.
    """

    name: str
    hint: str
    regex: str
    fields: tuple[str, ...]
    pairs: bool = False

    @property
    def full_regex(self) -> str:
        return rf"^(?:{self.regex})\z"


_PAM = r"([^(]*)\(([^:]*):([^)]*)\): "
_PAM_FIELDS = ("module", "source", "step")
_PAM_FAILURE = (
    r"authentication failure; logname=([^ :]*) uid=(\d+) euid=(\d+) "
    rf"tty=([^ :]*) ruser=([^ :]*) rhost=({_IPV4})"
)
_PAM_FAILURE_FIELDS = ("logname", "uid", "euid", "tty", "ruser", "rhost")
_DHCP = rf"DHCP([^(]*)\(([^)]*)\) ({_IPV4}) ({_MAC48})"
_POSTFIX = rf"for \(([^:]*):({_IPV4})\) at ({_DATE3164})"

# The rules, first match wins. The session form with a uid stands
# before the plain one, whose user word would swallow the uid.
RULES = (
    Rule(
        "iptables", "] iptables: ", r"\[([^\]]*)\] iptables: ((?:[A-Z]+(?:=\S*)?)(?: [A-Z]+(?:=\S*)?)+) ?",
        ("uptime",), pairs=True,
    ),
    Rule(
        "ssh_failed", "Failed password for ",
        rf"Failed password for ({_WORD}) from ({_IPV4}) port (\d+) ({_WORD})",
        ("user", "address", "port", "protocol"),
    ),
    Rule(
        "ssh_failed_invalid_user", "Failed password for invalid user ",
        rf"Failed password for invalid user ({_WORD}) from ({_IPV4}) port (\d+) ({_WORD})",
        ("user", "address", "port", "protocol"),
    ),
    Rule(
        "ssh_received_disconnect", "Received disconnect from ",
        rf"Received disconnect from ({_IPV4}) port (\d+):11: .*",
        ("address", "port"),
    ),
    Rule(
        "ssh_disconnected_preauth", "Disconnected from authenticating user ",
        rf"Disconnected from authenticating user ({_WORD}) ({_IPV4}) port (\d+) \[preauth\]",
        ("user", "address", "port"),
    ),
    Rule(
        "pam_auth_failure", "authentication failure; ",
        _PAM + _PAM_FAILURE + r"\s+",
        _PAM_FIELDS + _PAM_FAILURE_FIELDS,
    ),
    Rule(
        "pam_auth_failure_user", "authentication failure; ",
        _PAM + _PAM_FAILURE + rf"  user=({_WORD})",
        (*_PAM_FIELDS, *_PAM_FAILURE_FIELDS, "user"),
    ),
    Rule(
        "pam_session_closed", "session closed for user ",
        _PAM + rf"session closed for user ({_WORD})",
        (*_PAM_FIELDS, "user"),
    ),
    Rule(
        "pam_session_opened_uid", "session opened for user ",
        _PAM + r"session opened for user ([^(]*)\(uid=(\d+)\) by \(uid=(\d+)\)",
        (*_PAM_FIELDS, "user", "uid", "old-uid"),
    ),
    Rule(
        "pam_session_opened", "session opened for user ",
        _PAM + rf"session opened for user ({_WORD}) by \(uid=(\d+)\)",
        (*_PAM_FIELDS, "user", "old-uid"),
    ),
    Rule(
        "pam_check_pass", "check pass; user unknown",
        _PAM + "check pass; user unknown",
        _PAM_FIELDS,
    ),
    Rule(
        "smartd_attribute", "SMART ",
        rf"Device: ({_WORD}) \[([^\]]*)\], SMART ({_WORD}) Attribute: (\d+) ({_WORD}) "
        r"changed from (\d+) to (\d+)",
        ("device", "type", "attr-type", "attr-id", "attr-name", "old-value", "new-value"),
    ),
    Rule("dnsmasq_dhcp", "DHCP", _DHCP, ("action", "device", "ip", "mac")),
    Rule(
        "dnsmasq_dhcp_host", "DHCP", _DHCP + rf" ({_WORD})",
        ("action", "device", "ip", "mac", "host"),
    ),
    Rule(
        "postfix_max_rate", "statistics: max connection rate ",
        r"statistics: max connection rate (\d+)/60s " + _POSTFIX,
        ("per-minute", "transport", "address", "date"),
    ),
    Rule(
        "postfix_max_count", "statistics: max connection count ",
        r"statistics: max connection count (\d+) " + _POSTFIX,
        ("connections", "transport", "address", "date"),
    ),
)

def matched_rule(msg: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Name of the first rule that matches the whole message, NULL without one."""
    return F.coalesce(
        *[F.when(msg.contains(r.hint) & msg.rlike(r.full_regex), F.lit(r.name)) for r in rules]
    )


def _field(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def _rule_fields(msg: Column, rule: Rule) -> Column:
    """Fields of a message that matches the rule, unique and sorted by name."""
    groups = sorted((name, n) for n, name in enumerate(rule.fields, start=1))
    fields = F.array(
        *[_field(F.lit(name), F.regexp_extract(msg, rule.full_regex, n)) for name, n in groups]
    )
    if not rule.pairs:
        return fields
    words = F.split(F.regexp_extract(msg, rule.full_regex, len(rule.fields) + 1), " ")
    named = F.transform(
        words,
        lambda w: _field(
            F.substring_index(w, "=", 1),
            F.when(w.contains("="), F.substr(w, F.locate("=", w) + F.lit(1))),
        ),
    )
    return merge_entries(F.concat(fields, named))


def rule_fields(msg: Column, rule: Column, rules: Sequence[Rule] = RULES) -> Column:
    """``array<struct<key, value>>`` of a message whose rule is known.

    A flag without ``=`` has a NULL value; without a rule the array is NULL.
    """
    found = F.when(rule == rules[0].name, _rule_fields(msg, rules[0]))
    for other in rules[1:]:
        found = found.when(rule == other.name, _rule_fields(msg, other))
    return found


def json_entries(fields: Column) -> Column:
    """(key, value) fields to (key, JSON text) entries."""
    return F.transform(
        fields,
        lambda f: F.struct(
            f["key"].alias("key"), F.coalesce(json_quote(f["value"]), F.lit("null")).alias("json")
        ),
    )


# RFC 5424 structured data, ``[id key="value" ...]``.
STRUCTURED_DATA_PREFIX = "rfc5424-sd"
_SD_PARAMETER = r'[^\s=\]"]+="(?:[^"\\\]]|\\.)*"'
_SD_ELEMENT = rf"\[([^\s=\]\"]+)((?:\s+{_SD_PARAMETER})*)\s*\]"


def structured_data_entries(text: Column) -> Column:
    """Structured data to ``rfc5424-sd.<id>.<name>`` entries, NULL for ``-``."""
    elements = F.regexp_extract_all(text, F.lit(f"({_SD_ELEMENT})"), F.lit(1))

    def of_element(element: Column) -> Column:
        name = F.lower(F.regexp_extract(element, _SD_ELEMENT, 1))
        parameters = F.regexp_extract_all(element, F.lit(f"({_SD_PARAMETER})"), F.lit(1))

        def of_parameter(p: Column) -> Column:
            at = F.locate("=", p)
            raw = F.substr(p, at + F.lit(2), F.length(p) - at - F.lit(2))
            return _field(
                F.concat_ws(
                    ".",
                    F.lit(STRUCTURED_DATA_PREFIX),
                    name,
                    F.lower(F.substring_index(p, "=", 1)),
                ),
                F.regexp_replace(raw, r'\\([\\"\]])', "$1"),
            )

        return F.transform(parameters, of_parameter)

    fields = F.flatten(F.transform(elements, of_element))
    well_formed = text.rlike(rf"^(?:{_SD_ELEMENT})+\z")
    return F.when(well_formed, json_entries(merge_entries(fields)))


def normalize_messages(
    df: DataFrame, rules: Sequence[Rule] = RULES, msg: str = "msg", trim: bool = True
) -> DataFrame:
    """Add ``rule`` (name of the matching rule) and ``vars`` (its fields).

    ``vars`` is ``map<string,string>``, NULL where no rule matches. With
    ``trim`` one leading space of the message is removed first.
    """
    text = trim_first_space(F.col(msg)) if trim else F.col(msg)
    return (
        df.withColumn(msg, text)
        .withColumn("rule", matched_rule(F.col(msg), rules))
        .withColumn("vars", F.map_from_entries(rule_fields(F.col(msg), F.col("rule"), rules)))
    )
