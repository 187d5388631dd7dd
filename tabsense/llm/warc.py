"""Conversion of legacy ARC archives to WARC, with duplicate payloads as revisits.

An ARC archive is a version block (``filedesc://``), whose body names the fields
of the header lines that follow, and URL records: one header line, then as many
bytes as its last field declares. Versions 1 and 2 differ in those fields. Each
record becomes a WARC response or, if an equal payload has a smaller id, a
revisit that refers to it.

Record ids are version-8 UUIDs made from the page id alone: a task that runs
again writes the same ids, and a reader finds the id it refers to without a join.
Which payloads occur twice is decided on their digests; only digests that do
occur twice are joined back, so unique payloads need no partner and a hot payload
can be split by Spark's skew join.

Archives are written by Spark as gzipped files of about ``archive_bytes`` (before
compression) into a shared folder, and are read back by declared lengths.

Defined cases: null html is an empty payload, null url an empty one, a null page
id stays null; rows that tie for the smallest id of a payload are all responses;
an empty table gives an empty result; other columns are not read.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch

CRLF = b"\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: field names of the header lines by ARC version (fixed by the format)
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum",
        "Location", "Offset", "Filename", "Archive-length"],
}
ARC_DATE = "20240101000000"
UNSAFE = re.compile("[\\x00-\\x20\\x7f\\x85\\xa0\\u2028\\u2029]")


# ---- ARC -----------------------------------------------------------------

def arc_line(version: int, url: str, kind: str, length: int, date: str = ARC_DATE) -> bytes:
    """A header line; spaces and control characters of the URL are escaped."""
    safe = UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
    middle = [] if version == 1 else ["200", "-", "-", "0", "pages.arc"]
    return " ".join([safe, "0.0.0.0", date, kind, *middle, str(length)]).encode() + b"\n"


def arc_archive(version: int, records: list[tuple[str, bytes]]) -> bytes:
    """An ARC file of (url, network document) records."""
    about = f"{version} 0 tabsense\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    out = [arc_line(version, "filedesc://pages.arc", "text/plain", len(about)), about]
    for url, doc in records:
        out += [arc_line(version, url, "text/html", len(doc)), doc, b"\n"]
    return b"".join(out)


def arc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, network document) of each URL record of an ARC file.
    The version block says which fields its header lines have."""
    fields, at = ARC_FIELDS[1], 0
    while at < len(data):
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8", "replace").strip("\r")
        at = end + 1
        if not line:
            continue
        values = line.split(" ")
        length = int(values[-1])
        body = data[at:at + length]
        if len(body) < length:
            raise ValueError(f"ARC record of {values[0]} is cut off")
        at += length
        if values[0].startswith("filedesc:"):
            version = int(body.split(None, 1)[0])
            fields = body.split(b"\n")[1].decode().split() or ARC_FIELDS[version]
        else:
            # a URL with raw spaces leaves more values than fields
            extra = len(values) - len(fields)
            yield dict(zip(fields, [" ".join(values[:extra + 1]), *values[extra + 1:]],
                           strict=True)), body


# ---- WARC ----------------------------------------------------------------

def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A version-8 UUID that holds the 64 bits of a page id (null: all zero)."""
    n = 0 if page_id is None else (page_id & (1 << 64) - 1) | 1 << 64
    return str(uuid.UUID(int=n >> 62 << 64 | 0x8 << 76 | 0x2 << 62 | n & (1 << 62) - 1))


def page_of(name: str) -> int | None:
    n = uuid.UUID(name).int
    bits = (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    if not bits >> 64:
        return None
    value = bits & (1 << 64) - 1
    return value - (1 << 64) if value >> 63 else value


def warc_record(page_id: int | None, fields: dict[str, str], doc: bytes,
                first: int | None) -> bytes:
    """The WARC record for an ARC record, without its last line end. ``first``:
    the page whose response it revisits, null for a response. A revisit keeps
    the HTTP header only."""
    head, _, payload = doc.partition(CRLF * 2)
    when = fields["Archive-date"]
    block = doc if first is None else head + CRLF * 2
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_id(page_id)}>",
        f"WARC-Date: {when[:4]}-{when[4:6]}-{when[6:8]}T{when[8:10]}:{when[10:12]}:{when[12:14]}Z",
        f"WARC-Target-URI: {fields['URL']}",
        f"WARC-IP-Address: {fields['IP-address']}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if first is not None:
        lines += [f"WARC-Refers-To: <urn:uuid:{record_id(first)}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + CRLF * 2 + block + CRLF


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(named fields, block) of each record of a WARC file."""
    at = 0
    while at < len(data):
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        end = data.index(CRLF * 2, at)
        fields = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
        at = end + 4
        length = int(fields["Content-Length"])
        yield fields, data[at:at + length]
        at += length + 4


def http_header(block: bytes) -> dict[str, str]:
    head = block.partition(CRLF * 2)[0].decode("utf-8", "replace")
    return dict(x.split(": ", 1) for x in head.split("\r\n")[1:])


# ---- Spark ---------------------------------------------------------------

def archive_rows(pages: DataFrame) -> DataFrame:
    """page_id, sha (of the payload) and arc: an ARC archive of the page, in
    version 1 or 2 by the parity of its id; its network document is an HTTP
    response that declares the payload's length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, html in zip(b[0].to_pylist(), b[1].to_pylist(),
                                          b[2].cast(pa.binary()).to_pylist(), strict=True):
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" \
                       f"Content-Length: {len(html)}\r\n\r\n"
                out.append(arc_archive(1 + (page_id or 0) % 2, [(url, head.encode() + html)]))
            yield pa.record_batch([b[0], b[3], pa.array(out, pa.binary())],
                                  ["page_id", "sha", "arc"])

    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"),
        F.sha1(F.encode(html, "UTF-8")).alias("sha")) \
        .mapInArrow(run, "page_id long, sha string, arc binary")


def first_of_payload(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """sha and the smallest page id of every payload that occurs twice or more.
    Reads digests only; copies meet as partial minima."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.octet_length(html).alias("n"),
                        F.sha1(F.encode(html, "UTF-8")).alias("sha")) \
        .filter(F.col("n") >= least_bytes).groupBy("sha") \
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies")) \
        .filter("copies > 1").drop("copies")


def write_archives(arcs: DataFrame, path: str, archive_bytes: int = 16 << 20) -> None:
    """Converts rows (page_id, arc, first_id) and writes WARC files of about
    ``archive_bytes`` each. A task numbers its archives itself; the rows are not
    shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            numbers, texts = [], []
            for page_id, arc, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                for fields, doc in arc_records(arc):
                    record = warc_record(page_id, fields, doc, first)
                    numbers.append(total // archive_bytes)
                    texts.append(record)
                    total += len(record)
            yield pa.record_batch([pa.array(numbers, pa.int32()),
                                   pa.array(texts, pa.binary()).cast(pa.string())],
                                  ["archive", "value"])

    revisited = F.when(F.col("first_id") != F.col("page_id"), F.col("first_id"))
    rows = arcs.select("page_id", "arc", revisited.alias("first_id")) \
        .mapInArrow(run, "archive int, value string")
    # a record ends with two line ends: one its own, one the writer's
    rows.write.partitionBy("archive").option("lineSep", "\r\n") \
        .option("compression", "gzip").text(path)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to. A response's length and digest are taken from the
    payload it holds and must agree with what it declares."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b[0]:
                rows = []
                for fields, block in warc_records(gzip.decompress(data.as_py())):
                    name = fields["WARC-Record-ID"][10:-1]
                    declared = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    length, other = int(http_header(block)["Content-Length"]), None
                    if fields["WARC-Type"] == "response":
                        payload = block.partition(CRLF * 2)[2]
                        if (len(payload), digest(payload)) != (length, declared):
                            raise ValueError(f"record {name} is damaged")
                    else:
                        other = page_of(fields["WARC-Refers-To"][10:-1])
                    rows.append((page_of(name), fields["WARC-Target-URI"], length, declared,
                                 fields["WARC-Type"], other))
                cols = list(zip(*rows, strict=True)) if rows else [()] * 6
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                      names)

    # the schema is given, so that an empty table's archive folder can be read too
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true") \
        .option("pathGlobFilter", "*.gz").schema(T.StructType([
            T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
            T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])).load(path)
    return files.select("content").mapInArrow(
        run, "page_id long, url string, payload_bytes long, payload_digest string, "
             "record_type string, refers_to long")


def pages_to_warc(pages: DataFrame, path: str | None = None, archive_bytes: int = 16 << 20,
                  least_bytes: int = 0) -> DataFrame:
    """Pages as ARC archives, converted, written below ``path`` and read back."""
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    arcs = archive_rows(pages).join(first_of_payload(pages, least_bytes), "sha", "left")
    write_archives(arcs, path, archive_bytes)
    return read_archives(spark, path)
