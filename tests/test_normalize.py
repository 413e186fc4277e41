"""One matching and one near-miss line per rule, and structured data."""

import pytest
from pyspark.sql import functions as F

from emberlog.operators.normalize import RULES, normalize_messages, structured_data_entries

PAM = "pam_unix(sshd:auth): "
FAILURE = PAM + "authentication failure; logname= uid=0 euid=0 tty=ssh ruser= rhost=10.0.0.9"
FAILURE_VARS = {
    "module": "pam_unix", "source": "sshd", "step": "auth", "logname": "", "uid": "0",
    "euid": "0", "tty": "ssh", "ruser": "", "rhost": "10.0.0.9",
}
PAM_VARS = {"module": "pam_unix", "source": "sshd", "step": "auth"}
DHCP = "DHCPACK(eth0) 10.0.0.7 00:1a:2b:3c:4d:5e"
DHCP_VARS = {"action": "ACK", "device": "eth0", "ip": "10.0.0.7", "mac": "00:1a:2b:3c:4d:5e"}

# rule -> (matching line, its fields, a line that just misses it)
CASES = {
    "iptables": (
        "[12.5] iptables: IN=eth0 OUT= SRC=10.0.0.1 LEN=60 DF LEN=40",
        {"uptime": "12.5", "IN": "eth0", "OUT": "", "SRC": "10.0.0.1", "LEN": "40", "DF": None},
        "[12.5] iptables: IN=eth0",
    ),
    "ssh_failed": (
        "Failed password for root from 10.0.0.9 port 4022 ssh2",
        {"user": "root", "address": "10.0.0.9", "port": "4022", "protocol": "ssh2"},
        "Failed password for root from 10.0.0.9 port x ssh2",
    ),
    "ssh_failed_invalid_user": (
        "Failed password for invalid user bob from 10.0.0.9 port 4022 ssh2",
        {"user": "bob", "address": "10.0.0.9", "port": "4022", "protocol": "ssh2"},
        "Failed password for invalid user bob from host port 4022 ssh2",
    ),
    "ssh_received_disconnect": (
        "Received disconnect from 10.0.0.9 port 4022:11: Bye Bye [preauth]",
        {"address": "10.0.0.9", "port": "4022"},
        "Received disconnect from 10.0.0.9 port 4022:14: Bye",
    ),
    "ssh_disconnected_preauth": (
        "Disconnected from authenticating user root 10.0.0.9 port 4022 [preauth]",
        {"user": "root", "address": "10.0.0.9", "port": "4022"},
        "Disconnected from authenticating user root 10.0.0.9 port 4022",
    ),
    "pam_auth_failure": (FAILURE + " ", FAILURE_VARS, FAILURE),
    "pam_auth_failure_user": (
        FAILURE + "  user=bob", {**FAILURE_VARS, "user": "bob"}, FAILURE + " user=bob",
    ),
    "pam_session_closed": (
        PAM + "session closed for user bob", {**PAM_VARS, "user": "bob"},
        "sshd: session closed for user bob",
    ),
    "pam_session_opened": (
        PAM + "session opened for user bob by (uid=0)",
        {**PAM_VARS, "user": "bob", "old-uid": "0"},
        PAM + "session opened for user bob by uid=0",
    ),
    "pam_session_opened_uid": (
        PAM + "session opened for user bob(uid=1000) by (uid=0)",
        {**PAM_VARS, "user": "bob", "uid": "1000", "old-uid": "0"},
        PAM + "session opened for user bob(uid=1000)",
    ),
    "pam_check_pass": (
        PAM + "check pass; user unknown", PAM_VARS, PAM + "check pass; user unknown!",
    ),
    "smartd_attribute": (
        "Device: /dev/sda [SAT], SMART Usage Attribute: 194 Temperature_Celsius changed from 64 to 65",
        {
            "device": "/dev/sda", "type": "SAT", "attr-type": "Usage", "attr-id": "194",
            "attr-name": "Temperature_Celsius", "old-value": "64", "new-value": "65",
        },
        "Device: /dev/sda [SAT], SMART Usage Attribute: 194 Temperature changed from 64",
    ),
    "dnsmasq_dhcp": (DHCP, DHCP_VARS, "DHCPACK(eth0) 10.0.0.7 00:1a:2b:3c:4d"),
    "dnsmasq_dhcp_host": (DHCP + " pc1", {**DHCP_VARS, "host": "pc1"}, DHCP + " pc1 x"),
    "postfix_max_rate": (
        "statistics: max connection rate 3/60s for (smtp:10.0.0.9) at Jan  2 03:04:05",
        {"per-minute": "3", "transport": "smtp", "address": "10.0.0.9", "date": "Jan  2 03:04:05"},
        "statistics: max connection rate 3/30s for (smtp:10.0.0.9) at Jan  2 03:04:05",
    ),
    "postfix_max_count": (
        "statistics: max connection count 2 for (smtp:10.0.0.9) at Jan 12 03:04:05",
        {"connections": "2", "transport": "smtp", "address": "10.0.0.9", "date": "Jan 12 03:04:05"},
        "statistics: max connection count 2 for (smtp:10.0.0.9) at 12 Jan 03:04:05",
    ),
}


def test_every_rule_has_a_case():
    assert sorted(CASES) == sorted(r.name for r in RULES) and len(RULES) == 16


def test_rules(spark):
    lines = [(name, True, hit) for name, (hit, _, _) in CASES.items()]
    lines += [(name, False, miss) for name, (_, _, miss) in CASES.items()]
    df = spark.createDataFrame(lines, "name string, matches boolean, msg string")
    for row in normalize_messages(df).collect():
        if row.matches:
            assert (row.rule, row.vars) == (row.name, CASES[row.name][1])
        else:
            assert row.rule is None and row.vars is None, row.msg


def test_leading_space(spark):
    df = spark.createDataFrame([(" " + DHCP,), ("  " + DHCP,)], "msg string")
    rows = normalize_messages(df).collect()
    assert [r.rule for r in rows] == ["dnsmasq_dhcp", None]
    assert [r.msg for r in rows] == [DHCP, " " + DHCP]
    assert normalize_messages(df, trim=False).first().rule is None


@pytest.mark.parametrize(
    "text,want",
    [
        ('[a x="1"]', {"rfc5424-sd.a.x": '"1"'}),
        (
            '[a X="1" y=""][B z="q\\"\\]\\\\"]',
            {"rfc5424-sd.a.x": '"1"', "rfc5424-sd.a.y": '""', "rfc5424-sd.b.z": '"q\\"]\\\\"'},
        ),
        ('[a y="]"]', "absent"),
        ("-", "absent"),
        ("[a x=1]", "absent"),
        ("[a]", {}),
        (None, "absent"),
    ],
)
def test_structured_data(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(structured_data_entries(F.col("t")).alias("e")).first().e
    if want == "absent":
        assert got is None
        return
    assert {e.key: e.json for e in got} == want
