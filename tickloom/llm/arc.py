"""Legacy web archives: ARC files to WARC files, and both to rows.

``read_arc`` parses either version of the ARC format: the version block names the fields of the header lines that
follow, the last of which declares the length of a record's body. ``convert`` turns files of such records into
WARC files with synthesised identifiers, timestamps, types and digests: of equal payloads the record with the
greatest number (an HTTP header, ``X-Page-Id``) is a response, the others are revisits that name it and carry no
payload. ``read_warc`` reads them back.

Archives are gzip files that Spark writes as rows of text and commits as it does any table, so a retried task
leaves no half-written archive; a file holds the rows of one task. They are read with ``binaryFile`` and
inflated as a stream, record by record.

Defined cases: a null html is an empty payload; payloads of any length, also empty ones, are compared; a null
number can't be chosen as response unless all of its group are null (then all are responses); rows that share
the chosen number are all responses; a null url becomes ``urn:page:<number>``, and white space and control
characters in a url are percent-encoded, as header lines are split at spaces. An empty table gives files
without records and an empty result. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tickloom.staging import new_folder, stage

FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length",
          2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
NUMBER = b"X-Page-Id"
DATE = "20260101000000"       # archive date of records made from a table without one
AT_ONCE = 4_000_000           # bytes of a batch of records
ORIGIN = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")       # the URL namespace of RFC 4122


class ArcRecord(NamedTuple):
    version: int
    fields: dict[str, str]
    body: bytes


class WarcRecord(NamedTuple):
    headers: dict[str, str]
    block: bytes


# --- ARC -------------------------------------------------------------------------------------------------------

def arc_version_block(version: int, name: str, date: str = DATE) -> bytes:
    body = f"{version} 0 tickloom\n{FIELDS[version]}\n"
    between = "" if version == 1 else f"200 - - 0 {name} "
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {between}{len(body)}\n{body}".encode()


def arc_record(version: int, url: str, mime: str, body: bytes, name: str = "-", date: str = DATE) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    between = "" if version == 1 else f"200 - - 0 {name} "
    return f"{url} 0.0.0.0 {date} {mime} {between}{len(body)}\n".encode() + body


def read_arc(stream: BinaryIO) -> Iterator[ArcRecord]:
    """The records of an inflated ARC file, version blocks included; a short body raises."""
    version, names = 1, FIELDS[1].split()
    while line := stream.readline():
        if not line.strip():
            continue
        line = line.rstrip(b"\r\n")
        length = int(line.rpartition(b" ")[2])
        body = stream.read(length)
        if len(body) < length:
            raise ValueError(f"record {line[:80]!r} ends after {len(body)} of {length} bytes")
        if line.startswith(b"filedesc://"):
            lines = body.decode("utf-8", "replace").split("\n")
            version, names = int(lines[0].split()[0]), lines[1].split()
            yield ArcRecord(version, {"URL": line.split(b" ")[0].decode("utf-8", "replace"),
                                      "Archive-date": line.split(b" ")[2].decode()}, body)
            continue
        # a url with spaces in it, which old writers let pass, keeps them
        values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
        if len(values) < len(names):
            raise ValueError(f"a version {version} header needs {len(names)} fields: {line[:80]!r}")
        yield ArcRecord(version, dict(zip(names, values)), body)


# --- WARC ------------------------------------------------------------------------------------------------------

def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Head (with its blank line) and payload of an HTTP message."""
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[:end + 4], block[end + 4:])


def head_field(head: bytes, name: bytes) -> bytes | None:
    found = re.search(rb"(?mi)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1] if found else None


def record_id(number: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(ORIGIN, f'{number} {digest}')}>"


def iso_date(digits: str) -> str:
    d = (re.sub("[^0-9]", "", digits) + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def warc_record(headers: dict[str, str], block: bytes) -> bytes:
    """A record without its two closing line ends, which the writer adds."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def read_warc(stream: BinaryIO) -> Iterator[WarcRecord]:
    """The records of an inflated WARC file; a short block raises."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip()] = value.strip()
        length = int(headers["Content-Length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError(f"record {headers.get('WARC-Record-ID')} ends after {len(block)} of {length} bytes")
        yield WarcRecord(headers, block)


# --- jobs ------------------------------------------------------------------------------------------------------

def _batched(rows: Iterable[tuple], names: list[str], kinds: list[pa.DataType], size_at: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[size_at] or b"") + 100
        if size > AT_ONCE:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[BinaryIO]:
    for batch in batches:
        for content in batch.column(0):
            raw = io.BytesIO(content.as_buffer())
            yield io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("content")


def write_arc(pages: DataFrame, folder: str, number: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Archive the rows as HTTP responses: files of version 1 and, every second, of version 2."""
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version, name = 1 + TaskContext.get().partitionId() % 2, f"pages-{TaskContext.get().partitionId()}.arc"

        def rows() -> Iterator[tuple]:
            yield (arc_version_block(version, name),)
            for batch in batches:
                for no, address, payload in zip(*(c for c in batch.columns)):
                    no, payload = no.as_py(), payload.as_py() or b""
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                    head += b"" if no is None else b"%b: %d\r\n" % (NUMBER, no)
                    head += b"Content-Length: %d\r\n\r\n" % len(payload)
                    yield (arc_record(version, address.as_py() or f"urn:page:{no}", "text/html", head + payload,
                                      name),)

        yield from _batched(rows(), ["record"], [pa.binary()], 0)

    records = pages.select(F.col(number).cast("long"), F.col(url).cast("string"), F.col(html).cast("binary"))
    (records.mapInArrow(apply, "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", "\n").option("compression", "gzip").text(folder))


def arc_rows(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """(version, url, date, mime, number, digest, head, payload) of every record but the version blocks.

    Bodies that aren't HTTP messages have an empty head. Without ``payloads`` the last two are null.
    """
    names = ["version", "url", "date", "mime", "number", "digest", "head", "payload"]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary()]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for stream in _inflated(batches):
                for r in read_arc(stream):
                    if r.fields["URL"].startswith("filedesc://"):
                        continue
                    head, payload = split_http(r.body) if r.body.startswith(b"HTTP/") else (b"", r.body)
                    no = head_field(head, NUMBER)
                    yield (r.version, r.fields["URL"], r.fields["Archive-date"], r.fields["Content-type"],
                           None if no is None else int(no), payload_digest(payload),
                           head if payloads else None, payload if payloads else None)

        yield from _batched(rows(), names, kinds, 7)

    return _files(spark, folder).mapInArrow(
        apply, "version int, url string, date string, mime string, number long, digest string, head binary, payload binary")


def convert(spark: SparkSession, arc_folder: str, warc_folder: str) -> None:
    """Write a WARC record for every record of the ARC files."""
    # equal payloads only: of those, the number of the record that keeps its payload
    keepers = stage(arc_rows(spark, arc_folder, payloads=False).groupBy("digest")
                    .agg(F.max("number").alias("keeper"), F.count("*").alias("n"))
                    .where("n > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "keepers")
    joined = arc_rows(spark, arc_folder).join(keepers, "digest", "left").select(
        "url", "date", "mime", "number", "digest", "head", "payload", "keeper")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            info = b"software: tickloom\r\nformat: WARC File Format 1.0\r\n"
            yield (warc_record({"WARC-Type": "warcinfo", "WARC-Date": iso_date(DATE),
                                "WARC-Record-ID": record_id("info", str(TaskContext.get().partitionId())),
                                "Content-Type": "application/warc-fields"}, info),)
            for batch in batches:
                for url, date, mime, no, digest, head, payload, keeper in zip(*(c.to_pylist() for c in batch.columns)):
                    revisit = keeper is not None and keeper != no
                    headers = {"WARC-Type": "revisit" if revisit else "response" if head else "resource",
                               "WARC-Target-URI": url, "WARC-Date": iso_date(date),
                               "WARC-Record-ID": record_id(no, digest), "WARC-Payload-Digest": f"sha1:{digest}",
                               "Content-Type": "application/http; msgtype=response" if head else mime}
                    if revisit:
                        headers |= {"WARC-Refers-To": record_id(keeper, digest),
                                    "WARC-Profile": "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"}
                    yield (warc_record(headers, head if revisit else head + payload),)

        yield from _batched(rows(), ["record"], [pa.binary()], 0)

    (joined.mapInArrow(apply, "record binary").select(F.col("record").cast("string"))
     .write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_folder))


def warc_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(number, payload_bytes, payload_digest, record_type, record_id, refers_to_id) of all but the file heads.

    A response's payload is measured and must have the digest that its header states; a revisit's are those of
    the payload it stands for.
    """
    names = ["number", "payload_bytes", "payload_digest", "record_type", "record_id", "refers_to_id"]
    kinds = [pa.int64(), pa.int64()] + [pa.string()] * 4

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for stream in _inflated(batches):
                for headers, block in read_warc(stream):
                    kind = headers["WARC-Type"]
                    if kind == "warcinfo":
                        continue
                    http = headers["Content-Type"].startswith("application/http")
                    head, payload = split_http(block) if http else (b"", block)
                    no = head_field(head, NUMBER)
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    size = int(head_field(head, b"Content-Length") or 0) if kind == "revisit" else len(payload)
                    if kind != "revisit" and payload_digest(payload) != digest:
                        raise ValueError(f"record {headers['WARC-Record-ID']} has another payload than its digest")
                    yield (None if no is None else int(no), size, digest, kind, headers["WARC-Record-ID"],
                           headers.get("WARC-Refers-To"))

        yield from _batched(rows(), names, kinds, 2)

    return _files(spark, folder).mapInArrow(
        apply, "number long, payload_bytes long, payload_digest string, record_type string, record_id string, "
               "refers_to_id string")


def archived(pages: DataFrame, number: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows archived as ARC, converted to WARC and read back: (number, payload_bytes, payload_digest, record_type,
    refers_to)."""
    spark = pages.sparkSession
    old, new = new_folder(spark, "arc"), new_folder(spark, "warc")
    write_arc(pages, old, number, url, html)
    convert(spark, old, new)
    rows = stage(warc_rows(spark, new), "warc-rows")
    kept = (rows.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"),
                                                          F.col("number").alias("refers_to")).distinct())
    revisits = rows.where("refers_to_id IS NOT NULL").join(kept, "refers_to_id", "left")
    plain = rows.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    shown = [F.col("number").alias(number), "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return plain.select(*shown).unionByName(revisits.select(*shown))


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT page_id, html, array_to_string(list_transform(range(1, 41), lambda i:
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'][
      instr('0123456789abcdef', hex[i])]), '') AS b
  FROM p),
digests AS (
  SELECT page_id, html, array_to_string(list_transform(range(0, 32), lambda i:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
      1 + 16 * CAST(b[5*i+1] AS INT) + 8 * CAST(b[5*i+2] AS INT) + 4 * CAST(b[5*i+3] AS INT)
        + 2 * CAST(b[5*i+4] AS INT) + CAST(b[5*i+5] AS INT)]), '') AS payload_digest
  FROM bits),
k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keeper FROM digests)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN keeper = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN keeper = page_id THEN NULL ELSE keeper END AS refers_to
FROM k
"""
