"""Import: decoding, flattening, message swap, quarantine, preprocessing."""

import json

import pytest
from pyspark.sql import functions as F

from emberlog.functions.flatten import flatten_json
from emberlog.functions.syslog import facility_name, format_rfc3339, parse_rfc3339, severity_name
from emberlog.operators.ingest import (
    import_events,
    parse_events,
    preprocessing,
    with_sequence_id,
)
from emberlog.operators.postings import build_postings, lookup
from emberlog.schema import FACILITIES, LOG_SCHEMA, SEVERITIES
from emberlog.sources.jsonlines import read_json_lines

EVENT = {
    "msg": "Failed password for root from 10.0.0.9 port 4022 ssh2",
    "timereported": "2024-01-02T03:04:05Z",
    "timegenerated": "2024-01-02T03:04:06.250+01:00",
    "hostname": "web1",
    "syslogtag": "sshd[77]:",
    "inputname": "imudp",
    "fromhost": "web1",
    "fromhost-ip": "10.0.0.1",
    "syslogseverity": "6",
    "syslogfacility": "10",
    "programname": "sshd",
    "protocol-version": "1",
    "app-name": "sshd",
    "procid": "77",
    "$!": {"user": "root", "net": {"port": 4022}, "tags": ["a", "b"]},
}


def event(**changes):
    """The event with changes; a value of ``...`` removes the key."""
    out = {**EVENT, **changes}
    return {k: v for k, v in out.items() if v is not ...}


def raw(spark, *lines):
    texts = [x if isinstance(x, str) else json.dumps(x) for x in lines]
    return spark.createDataFrame([(t,) for t in texts], "value string")


def docs(spark, *lines, **options):
    good, _ = import_events(raw(spark, *lines), **options)
    return [json.loads(r.doc) for r in good.select("doc").collect()]


def reasons(spark, *lines, **options):
    parsed = parse_events(raw(spark, *lines), **options)
    return {r.value: r.reason for r in parsed.select("value", "reason").collect()}


def test_good_event(spark):
    good, quarantine = import_events(raw(spark, EVENT))
    assert quarantine.count() == 0
    assert good.schema.names == LOG_SCHEMA.names
    row = good.select("id", "tstamp", "doc", F.to_json("doc_v").alias("v"), "search").first()
    assert str(row.tstamp) == "2024-01-02 03:04:05"
    doc = json.loads(row.doc)
    assert list(doc) == sorted(doc)
    assert doc == json.loads(row.v) == {
        "msg": EVENT["msg"],
        "timereported": "2024-01-02T03:04:05Z",
        "timegenerated": "2024-01-02T02:04:06.25Z",
        "hostname": "web1",
        "syslogtag": "sshd[77]:",
        "inputname": "imudp",
        "fromhost": "web1",
        "fromhost_ip": "10.0.0.1",
        "syslogseverity": "info",
        "syslogfacility": "authpriv",
        "programname": "sshd",
        "protocol_version": "1",
        "app_name": "sshd",
        "procid": "77",
        "vars.user": "root",
        "vars.net.port": 4022,
        "vars.tags": ["a", "b"],
    }
    assert row.search == (
        "web1 failed password for root from 10 0 0 9 port 4022 ssh2 sshd 77 "
        "vars net port 4022 vars tags a b vars user root"
    ).split()


def test_optional_keys(spark):
    (doc,) = docs(spark, event(procid=..., **{"$!": ...}))
    assert doc["procid"] is None and "msgid" not in doc and "uuid" not in doc
    (doc,) = docs(spark, event(procid=None, msgid="ID47", uuid="u-1", unknown=[1]))
    assert (doc["procid"], doc["msgid"], doc["uuid"]) == (None, "ID47", "u-1")
    assert "unknown" not in doc


def test_flatten(spark):
    variables = '{"a":{"b":1,"c":{}},"d":[1,{"e":2}],"n":null,"f":1.0,"x":1e2,"s":"{\\"q\\":1}"}'
    line = json.dumps(event(**{"$!": "@"})).replace('"@"', variables)
    good, _ = import_events(raw(spark, line))
    text = good.first().doc
    for part in (
        '"vars.a.b":1,', '"vars.d":[1,{"e":2}]', '"vars.n":null', '"vars.f":1.0', '"vars.x":100.0',
        '"vars.s":"{\\"q\\":1}"',
    ):
        assert part in text
    assert "vars.a.c" not in text and '"vars.a"' not in text


@pytest.mark.parametrize(
    "number,stored",
    [
        ("1.0", "1.0"), ("10.00", "10.0"), ("6.55", "6.55"), ("1.50", "1.5"), ("1e2", "100.0"),
        ("-0.5", "-0.5"), ("42", "42"), ("12.5E-1", "1.25"), ("0.1000000000000000055", "0.1000000000000000055"),
        ("100.05", "100.05"),
    ],
)
def test_number_spelling(spark, number, stored):
    for text in ('{"a":@}', '{"a":{"b":[@,2]}}', "[@]", "@"):
        line = json.dumps(event(**{"$!": "?"})).replace('"?"', text.replace("@", number))
        good, _ = import_events(raw(spark, line))
        doc = good.first().doc
        assert text.replace("@", stored).strip('{"ab:}') in doc
        assert f"{stored}," in doc or f"{stored}]" in doc or f"{stored}}}" in doc


def test_flatten_scalars_and_collisions(spark):
    assert docs(spark, event(**{"$!": 5}))[0]["vars"] == 5
    assert docs(spark, event(**{"$!": [1, 2]}))[0]["vars"] == [1, 2]
    assert "vars" not in docs(spark, event(**{"$!": None}))[0]
    (doc,) = docs(spark, event(**{"$!": {"a.b": 1, "a": {"b": 2}}}))
    assert doc["vars.a.b"] == 1
    (doc,) = docs(spark, event(**{"$!": {}}))
    assert not [k for k in doc if k.startswith("vars")]


def test_flatten_deep(spark):
    def nest(depth):
        value = 1
        for _ in range(depth):
            value = {"k": value}
        return value

    (doc,) = docs(spark, event(**{"$!": nest(40)}))
    assert doc["vars" + ".k" * 40] == 1
    (doc,) = docs(spark, event(**{"$!": nest(200)}))
    assert doc["vars" + ".k" * 200] == 1
    # the JSON reader's own limit is the only one
    assert list(reasons(spark, event(**{"$!": nest(1100)})).values()) == ["not a JSON object"]


def test_flatten_column(spark):
    df = raw(spark, '{"a":{"b":1},"c":"x"}').select(
        flatten_json(F.col("value"), F.parse_json("value")).alias("e"),
        flatten_json(F.lit("[1]"), F.parse_json(F.lit("[1]"))).alias("bare"),
    )
    row = df.first()
    assert [tuple(e) for e in row.e] == [("a.b", "1"), ("c", '"x"')]
    assert [tuple(e) for e in row.bare] == [("", "[1]")]


def test_message_swap(spark):
    changed = event(**{"$!": {"msg": "short", "n": 1}})
    (doc,) = docs(spark, changed)
    assert (doc["msg"], doc["vars.msg"]) == ("short", EVENT["msg"])
    (doc,) = docs(spark, changed, swap_message=False)
    assert (doc["msg"], doc["vars.msg"]) == (EVENT["msg"], "short")
    (doc,) = docs(spark, EVENT)
    assert doc["msg"] == EVENT["msg"] and "vars.msg" not in doc
    for value, text in ((None, "null"), (7, "7"), (True, "true"), ([1, "a"], '=[1,"a"]')):
        (doc,) = docs(spark, event(**{"$!": {"msg": value}}))
        assert (doc["msg"], doc["vars.msg"]) == (text, EVENT["msg"])


def test_rejects(spark):
    broken = json.dumps(EVENT)[:-3]
    cases = {
        json.dumps(event(hostname=...)): "missing hostname",
        json.dumps(event(hostname=None)): "hostname is not a string",
        json.dumps(event(syslogseverity="8")): "invalid syslogseverity",
        json.dumps(event(syslogseverity=3)): "syslogseverity is not a string",
        json.dumps(event(syslogseverity="06")): "invalid syslogseverity",
        json.dumps(event(syslogfacility="24")): "invalid syslogfacility",
        json.dumps(event(timereported="2021-10-01")): "invalid timereported",
        json.dumps(event(timegenerated="2021-10-01 10:00:00Z")): "invalid timegenerated",
        json.dumps(event(timereported="2021-13-01T00:00:00Z")): "invalid timereported",
        json.dumps(event(msgid=4)): "msgid is not a string",
        broken: "not a JSON object",
        json.dumps(EVENT) + " x": "not a JSON object",
        json.dumps(EVENT) + "}": "not a JSON object",
        json.dumps(EVENT) + ",0]": "not a JSON object",
        "[" + json.dumps(EVENT) + "]": "not a JSON object",
        '"text"': "not a JSON object",
    }
    assert reasons(spark, *cases) == cases
    good, quarantine = import_events(raw(spark, "", "  \t", EVENT, *cases))
    assert good.count() == 1
    assert {r.value: r.reason for r in quarantine.collect()} == cases


def test_surrounding_space_is_trimmed(spark):
    assert len(docs(spark, "  " + json.dumps(EVENT) + " \t\r")) == 1


def test_escapes_survive(spark):
    text = 'quote " back \\ tab \t nul \u0001 é \U0001f600 / </x>'
    (doc,) = docs(spark, event(msg=text, **{"$!": {'k"\\': text}}))
    assert doc["msg"] == text
    assert doc['vars.k"\\'] == text


def test_decoding(spark):
    codes = spark.createDataFrame([(str(n),) for n in range(26)] + [("x",)], "c string")
    rows = codes.select("c", severity_name(F.col("c")), facility_name(F.col("c"))).collect()
    assert {r[0]: r[1] for r in rows if r[1]} == SEVERITIES
    assert {r[0]: r[2] for r in rows if r[2]} == FACILITIES


def test_rfc3339(spark):
    texts = {
        "2024-01-02T03:04:05Z": "2024-01-02T03:04:05Z",
        "2024-01-02t03:04:05z": "2024-01-02T03:04:05Z",
        "2024-01-02T23:30:00-02:00": "2024-01-03T01:30:00Z",
        "2024-01-02T03:04:10.5000Z": "2024-01-02T03:04:10.5Z",
        "2024-01-02T03:04:05.123456789Z": "2024-01-02T03:04:05.123456Z",
        "2024-01-02": None,
        "2024-01-02T03:04:05": None,
        "2024-01-02 03:04:05Z": None,
        "2024-02-30T03:04:05Z": None,
        "": None,
    }
    df = raw(spark, *texts)
    got = df.select("value", format_rfc3339(parse_rfc3339(F.col("value")))).collect()
    assert {r[0]: r[1] for r in got} == texts


def test_ids(spark):
    lines = raw(spark, *[event(msg=f"m{n}") for n in range(20)])
    first = [r.id for r in import_events(lines)[0].select("id").orderBy("id").collect()]
    again = import_events(lines)[0].select("id").orderBy("id")
    assert first == [r.id for r in again.collect()] and len(set(first)) == 20
    equal = raw(spark, *[event()] * 30)
    assert import_events(equal)[0].select("id").distinct().count() == 30
    numbered = with_sequence_id(lines, 100)
    ids = [r.id for r in import_events(numbered)[0].select("id").collect()]
    assert len(set(ids)) == 20 and min(ids) == 100


def test_preprocessing(spark):
    line = event(
        msg=" Failed password for bob from 10.0.0.9 port 22 ssh2",
        **{"$!": {"user": "old"}, "structured-data": '[ex@1 Key="a\\"b"][o x="1" y="2"]'},
    )
    (doc,) = docs(spark, line, **preprocessing())
    assert doc["msg"] == "Failed password for bob from 10.0.0.9 port 22 ssh2"
    assert doc["vars.user"] == "bob" and doc["vars.port"] == "22"
    assert doc["vars.rfc5424-sd.ex@1.key"] == 'a"b'
    assert doc["vars.rfc5424-sd.o.y"] == "2"
    (doc,) = docs(spark, event(**{"structured-data": "-", "$!": ...}, msg="plain"), **preprocessing())
    assert not [k for k in doc if k.startswith("vars")]


@pytest.mark.parametrize("value", ["x", 1, None])
def test_structured_data_of_any_type_is_accepted(spark, value):
    assert len(docs(spark, event(**{"structured-data": value}), **preprocessing())) == 1


def test_repeated_keys(spark):
    text = json.dumps(event())
    twice = text.replace('"$!": {', '"$!": {"user": "old", ')
    (doc,) = docs(spark, twice)
    assert doc["vars.user"] == "root"
    (doc,) = docs(spark, '{"other": 1, "other": {"a": 1, "a": 2}, ' + text[1:])
    assert doc["hostname"] == "web1"
    for key in ("hostname", "uuid", "$!"):
        line = f'{{"{key}": "x", "{key}": "y", ' + text[1:].replace(f'"{key}"', '"z"')
        assert list(reasons(spark, line).values()) == [f"repeated {key}"]


def test_equal_lines_of_a_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text((json.dumps(event(msg="hello world")) + "\n") * 3)
    lines = read_json_lines(spark, str(tmp_path))
    good, _ = import_events(lines)
    ids = [r.id for r in good.select("id").collect()]
    assert len(set(ids)) == 3 and sorted(ids) == sorted(r.id for r in good.select("id").collect())
    assert lookup(good, build_postings(good), ["hello", "world"]).count() == 3
