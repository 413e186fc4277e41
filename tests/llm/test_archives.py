import hashlib

import pytest

from check_queries import compare, connect
from emberlog.llm import archives as A

PAGE = "page_id long, url string, html string"


def brute(rows):
    """Digest, size, type and refers-to of pages without repeated rows."""
    first = {}
    for page, _, html in rows:
        if len((html or "").encode()) >= A.REVISIT_BYTES:
            first[html] = min(first.get(html, page), page)
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        refers = first.get(html) if first.get(html) != page else None
        kind = "response" if refers is None else "revisit"
        out.add((page, len(data), hashlib.sha256(data).hexdigest(), kind, refers))
    return out


def answer(frame, most=A.ARCHIVE_BYTES):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return A.archive_pages(frame, most).select(*names).collect()


def test_query_against_sql(spark, sf):
    problem, count = compare("op5_warc", spark, connect(sf), sf)
    assert not problem and count


def test_awkward_payloads(spark):
    record = A.page_record(
        {"block": "HTTP/1.0 200 OK\r\n\r\nx", "refers_to_id": None, "record_id": "r", "date": "d"}
        | {"uri": "u", "address": "a", "digest": "x"}
    ).decode()
    long = "é" * 200 + "\r\n\r\n" + record + "\n\nhttp://x 0.0.0.0 20240101000000 text/html 5\nabcde\n"
    html = [long, long, "short", "short", "", None, "a" * 99, "a" * 99, "b" * 100, "b" * 100, "\n\n\r\n"]
    urls = ["http://a/", "http://b c\nd", None, "", "http://é/"]
    rows = [(k, urls[k % 5], h) for k, h in enumerate(html, start=3)]
    frame = spark.createDataFrame(rows, PAGE)
    for most in (1, 600, 1 << 20):
        assert {tuple(r) for r in answer(frame, most)} == brute(rows)


def test_many_copies_and_repeated_rows(spark):
    rows = [(k % 50, "http://a", "x" * 150) for k in range(200)] + [(None, "u", "x" * 150)]
    frame = spark.createDataFrame(rows, PAGE, verifySchema=False).repartition(3)
    got = answer(frame)
    assert len(got) == 201
    assert sum(r.record_type == "response" for r in got) == 1
    assert {r.refers_to for r in got if r.record_type == "revisit"} == {0}
    assert [r.record_type for r in got if r.page_id is None] == ["revisit"]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    page = {"page_id": 4, "url": "http://a b", "html": "line\nline"}
    content = A.arc_version_block(version) + A.arc_record(version, page)
    [(at, header, body)] = A.arc_records(content)
    assert header["URL"] == "http://a%20b" and header["Archive-date"] == A.CAPTURED
    assert ("Result-code" in header) == (version == 2)
    row = A.converted("f.arc", at, header, body)
    assert row["page_id"] == 4 and row["date"] == "2024-01-01T00:00:00Z"
    assert row["digest"] == hashlib.sha256(b"line\nline").hexdigest()
    assert row == A.converted("f.arc", at, header, body)  # identifiers are stable


def test_broken_archives_are_errors():
    content = A.arc_version_block(1) + A.arc_record(1, {"page_id": 1, "url": "u", "html": "abc"})
    with pytest.raises(ValueError, match="declared length"):
        list(A.arc_records(content[:-4]))
    with pytest.raises(ValueError, match="version"):
        list(A.arc_records(content.replace(b"u 0.0.0.0", b"u u 0.0.0.0")))


def test_extra_columns_and_empty_table(spark):
    frame = spark.createDataFrame(
        [(1, "u", "h", "x", "y")], f"{PAGE}, record_type string, digest string"
    )
    assert {tuple(r) for r in answer(frame)} == brute([(1, "u", "h")])
    assert answer(frame.limit(0)) == []
