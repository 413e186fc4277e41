"""Legacy ARC archives to WARC, and both ways of reading and writing them.

ARC comes in two versions with different header lines; the version block at the start of
an archive says which. The converter walks an archive by the declared lengths, so a
payload may hold anything, also lines that look like headers. For each ARC record it
synthesises a WARC record: an identifier from archive, place and digest, the ISO time, the
type, and the digests of block and payload. Records with equal payloads of at least
``REVISIT_BYTES`` become one response and revisits of it.

Archives are files of bounded size below the shared folder, written and read by Spark. A
page whose html is null has an empty payload. A null page id is written without one and
read back as null; it comes after all ids when the response is chosen. Of repeated rows
one is the response and the others revisit it. White space and control characters in an
address are percent-encoded, a null address is written as ``about:blank``. No pages give
no archives and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlog.llm.batches import struct_type
from emberlog.llm.store import new_path

#: Bytes of records after which an archive is closed.
ARCHIVE_BYTES = 8 << 20

#: Smaller payloads are always responses.
REVISIT_BYTES = 100

#: Fixed values of the formats.
ARC_VERSIONS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset "
    "Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
NAMESPACE = uuid.NAMESPACE_URL

CAPTURED = "20240101000000"
ADDRESS = "0.0.0.0"
PAGE_HEADER = b"X-Page-Id"

ARCHIVE = [("archive", "string")]
RECORDS = [
    ("record_id", "string"),
    ("page_id", "bigint"),
    ("uri", "string"),
    ("date", "string"),
    ("address", "string"),
    ("digest", "string"),
    ("payload_bytes", "bigint"),
    ("block", "string"),
]
READ = [
    ("page_id", "bigint"),
    ("payload_bytes", "bigint"),
    ("payload_digest", "string"),
    ("record_type", "string"),
    ("record_id", "string"),
    ("refers_to_id", "string"),
    ("uri", "string"),
    ("date", "string"),
]


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def one_line(url: str | None) -> str:
    """An address without white space or control characters, never empty."""
    escaped = re.sub(
        r"[\x00-\x20\x7f]|\s",
        lambda m: "".join(f"%{b:02X}" for b in m[0].encode()),
        url or "about:blank",
    )
    return escaped


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that one archive or page is in work."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(i)[k].as_py() for i, name in enumerate(batch.schema.names)}


def batch_of(rows: list[dict], fields: list[tuple[str, str]]) -> pa.RecordBatch:
    from emberlog.llm.batches import KINDS

    schema = pa.schema([(name, KINDS[kind][0]) for name, kind in fields])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def archived(first: bytes, records: Iterator[bytes], most: int) -> Iterator[pa.RecordBatch]:
    """Records joined into archives that begin with ``first``; one row is one archive."""
    held, size = [first], len(first)
    for record in records:
        held.append(record)
        size += len(record)
        if size >= most:
            yield batch_of([{"archive": b"".join(held).decode("utf-8")}], ARCHIVE)
            held, size = [first], len(first)
    if len(held) > 1:
        yield batch_of([{"archive": b"".join(held).decode("utf-8")}], ARCHIVE)


def write_archives(archives: DataFrame, path: str) -> None:
    """One compressed file per row."""
    # the writer ends a row with a line separator: an empty line after the last record
    archives.write.option("maxRecordsPerFile", 1).option("compression", "gzip").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


# -- ARC -------------------------------------------------------------------------------


def arc_version_block(version: int) -> bytes:
    body = f"{version} 0 emberlog\n{ARC_VERSIONS[version]}\n".encode()
    return arc_line(version, "filedesc://emberlog.arc", "text/plain", len(body)) + body + b"\n"


def arc_line(version: int, uri: str, kind: str, size: int, digest: str = "-") -> bytes:
    middle = "" if version == 1 else f"200 {digest} - 0 emberlog.arc "
    return f"{uri} {ADDRESS} {CAPTURED} {kind} {middle}{size}\n".encode()


def http_message(page_id: int | None, payload: bytes) -> bytes:
    own = b"" if page_id is None else PAGE_HEADER + b": %d\r\n" % page_id
    head = b"HTTP/1.0 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    return head + own + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def arc_record(version: int, page: dict) -> bytes:
    payload = (page["html"] or "").encode()
    message = http_message(page["page_id"], payload)
    digest = sha256(payload) if version == 2 else "-"
    return arc_line(version, one_line(page["url"]), "text/html", len(message), digest) + message + b"\n"


def pages_to_arc(pages: DataFrame, path: str, most: int = ARCHIVE_BYTES) -> None:
    """Write pages as ARC archives; both versions occur, by the address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[bytes]] = {1: [], 2: []}
        sizes = {1: 0, 2: 0}
        for page in rows_of(batches):
            version = 1 + len(page["url"] or "") % 2
            record = arc_record(version, page)
            waiting[version].append(record)
            sizes[version] += len(record)
            if sizes[version] >= most:
                yield from archived(arc_version_block(version), iter(waiting[version]), 1 << 62)
                waiting[version], sizes[version] = [], 0
        for version, records in waiting.items():
            yield from archived(arc_version_block(version), iter(records), 1 << 62)

    found = pages.select("page_id", "url", "html").mapInArrow(run, struct_type(ARCHIVE))
    write_archives(found, path)


def arc_records(content: bytes) -> Iterator[tuple[int, dict, bytes]]:
    """Place, header fields and body of each record, walked by the declared lengths."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        values = data[at:end].decode("utf-8").rstrip("\r").split(" ")
        size = int(values[-1])
        body = data[end + 1 : end + 1 + size]
        if len(body) != size:
            raise ValueError(f"ARC record at {at} ends before its declared length")
        if names is None:  # the version block names the fields of the header lines
            version = int(body.split(b" ", 1)[0])
            names = ARC_VERSIONS[version].split(" ")
        elif len(values) != len(names):
            raise ValueError(f"ARC header at {at} does not fit its version")
        else:
            yield at, dict(zip(names, values)), body
        at = end + 1 + size


def iso_time(date: str) -> str:
    """The 14 digits of an ARC date as WARC time; shorter dates are filled up."""
    d = date + "00000101000000"[len(date) :] if len(date) < 14 else date
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def http_parts(message: bytes) -> tuple[bytes, bytes]:
    """Head with its empty line, and payload; a body without a head is all payload."""
    if not message.startswith(b"HTTP/"):
        return b"", message
    end = message.find(b"\r\n\r\n")
    return (message, b"") if end < 0 else (message[: end + 4], message[end + 4 :])


def http_field(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        key, found, value = line.partition(b":")
        if found and key.strip().lower() == name.lower():
            return value.strip()
    return None


def converted(path: str, place: int, header: dict, body: bytes) -> dict:
    """The WARC fields synthesised for one ARC record."""
    head, payload = http_parts(body)
    digest = sha256(payload)
    page = http_field(head, PAGE_HEADER)
    own = uuid.uuid5(NAMESPACE, f"{path}#{place}:{digest}")
    return {
        "record_id": f"<urn:uuid:{own}>",
        "page_id": None if page is None else int(page),
        "uri": header["URL"],
        "date": iso_time(header["Archive-date"]),
        "address": header["IP-address"],
        "digest": digest,
        "payload_bytes": len(payload),
        "block": body.decode("utf-8"),
    }


def arc_to_records(archives: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    names = [name for name, _ in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in rows_of(batches):
            found = (converted(archive["path"], *r) for r in arc_records(archive["content"]))
            rows = [{name: row[name] for name in names} for row in found]
            if rows:
                yield batch_of(rows, fields)

    return archives.mapInArrow(run, struct_type(fields))


# -- WARC ------------------------------------------------------------------------------


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [f"{name}: {value}" for name, value in fields]
    lines += [f"WARC-Block-Digest: sha256:{sha256(block)}", f"Content-Length: {len(block)}"]
    return ("WARC/1.0\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def warc_info() -> bytes:
    block = b"software: emberlog\r\nformat: WARC File Format 1.0\r\n"
    own = uuid.uuid5(NAMESPACE, sha256(block))
    fields = [
        ("WARC-Type", "warcinfo"),
        ("WARC-Record-ID", f"<urn:uuid:{own}>"),
        ("WARC-Date", iso_time(CAPTURED)),
        ("Content-Type", "application/warc-fields"),
    ]
    return warc_record(fields, block)


def page_record(row: dict) -> bytes:
    """The response or revisit record of one converted row."""
    block, refers = row["block"].encode(), row["refers_to_id"]
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", row["record_id"]),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["uri"]),
        ("WARC-IP-Address", row["address"]),
        ("WARC-Payload-Digest", f"sha256:{row['digest']}"),
    ]
    if refers is not None:
        fields += [("WARC-Refers-To", refers), ("WARC-Profile", REVISIT_PROFILE)]
        block = http_parts(block)[0]
    return warc_record([*fields, ("Content-Type", "application/http; msgtype=response")], block)


def convert(spark: SparkSession, arc_path: str, warc_path: str, most: int = ARCHIVE_BYTES) -> None:
    """Convert the ARC archives below one path to WARC archives below another.

    Digests are compared first, without payloads; of equal ones the record with the
    smallest page id is the response. The minimum combines before the shuffle, and the
    join back to the records is one that Spark can split where a digest is very frequent.
    """
    archives = read_archives(spark, arc_path)
    brief = [f for f in RECORDS if f[0] in ("record_id", "page_id", "digest", "payload_bytes")]
    first = (
        arc_to_records(archives, brief)
        .filter(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("digest")
        .agg(
            F.min(F.struct(F.col("page_id").isNull(), "page_id", "record_id")).alias("first"),
            F.count(F.lit(1)).alias("n"),
        )
        .filter("n > 1")
        .select("digest", F.col("first.record_id").alias("first_id"))
    )
    refers = F.when(F.col("first_id") != F.col("record_id"), F.col("first_id"))
    records = (
        arc_to_records(archives, RECORDS)
        .join(first, "digest", "left")
        .withColumn("refers_to_id", refers)
        .drop("first_id", "payload_bytes")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from archived(warc_info(), (page_record(row) for row in rows_of(batches)), most)

    write_archives(records.mapInArrow(run, struct_type(ARCHIVE)), warc_path)


def warc_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields and block of each record, walked by the declared lengths."""
    data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    at = 0
    while at < len(data):
        if data[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        pairs = (line.partition(":") for line in lines)
        header = {name.strip().lower(): value.strip() for name, _, value in pairs}
        size = int(header["content-length"])
        block = data[end + 4 : end + 4 + size]
        if len(block) != size:
            raise ValueError(f"WARC record at {at} ends before its declared length")
        yield header, block
        at = end + 4 + size


def read_record(header: dict, block: bytes) -> dict:
    """One page record read back; digests that do not fit the block are an error."""
    head, payload = http_parts(block)
    page = http_field(head, PAGE_HEADER)
    digest = header["warc-payload-digest"].removeprefix("sha256:")
    size = len(payload)
    if header["warc-block-digest"] != f"sha256:{sha256(block)}":
        raise ValueError(f"block of {header['warc-record-id']} does not fit its digest")
    if header["warc-type"] == "revisit":
        size = int(http_field(head, b"Content-Length") or 0)
    elif sha256(payload) != digest:
        raise ValueError(f"payload of {header['warc-record-id']} does not fit its digest")
    return {
        "page_id": None if page is None else int(page),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": header["warc-type"],
        "record_id": header["warc-record-id"],
        "refers_to_id": header.get("warc-refers-to"),
        "uri": header["warc-target-uri"],
        "date": header["warc-date"],
    }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The page records of all archives, without payloads, with ``refers_to`` resolved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for archive in rows_of(batches):
            found = warc_records(archive["content"])
            rows = [read_record(h, b) for h, b in found if h["warc-type"] != "warcinfo"]
            if rows:
                yield batch_of(rows, READ)

    records = read_archives(spark, path).mapInArrow(run, struct_type(READ))
    revisited = records.filter("refers_to_id is not null")
    revisited = revisited.select(F.col("refers_to_id").alias("record_id")).distinct()
    names = records.join(revisited, "record_id", "left_semi")
    names = names.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return records.join(names, "refers_to_id", "left")


def archive_pages(pages: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages to ARC, converted to WARC, and read back."""
    spark = pages.sparkSession
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    pages_to_arc(pages, arc, most)
    convert(spark, arc, warc, most)
    return read_warc(spark, warc)
