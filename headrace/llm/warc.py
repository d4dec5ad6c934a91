"""Operator 6: legacy ARC archives parsed by declared lengths and rewritten as WARC, duplicates as revisits."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headrace.llm.common import shared_folder

#: Bytes of records after which an archive is closed; one longer record makes one longer archive.
ARCHIVE_BYTES = 8 << 20
#: Payloads below this are never revisits.
LEAST_REVISIT = 100
#: Fields of an ARC record's header line by version.
ARC_FIELDS = {
    b"1": (b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Archive-length"),
    b"2": (b"URL", b"IP-address", b"Archive-date", b"Content-type", b"Result-code", b"Checksum", b"Location", b"Offset",
           b"Filename", b"Archive-length"),
}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = re.compile(rb"[\x00-\x20\x7f]")
_RECORD = "page_id long, uri string, date string, mime string, http binary, payload binary, digest string, record_id string"


def arc_header(version: bytes, name: str, date: str) -> bytes:
    """The version block that opens an archive."""
    body = version + b" 0 headrace\n" + b" ".join(ARC_FIELDS[version]) + b"\n"
    first = f"filedesc://{name} 0.0.0.0 {date} text/plain".encode()
    if version == b"2":
        first += b" 200 - - 0 " + name.encode()
    return first + b" %d\n" % len(body) + body + b"\n"


def arc_record(version: bytes, uri: str | None, date: str, mime: str, block: bytes, name: str, at: int) -> bytes:
    """Header line and block. White space in the address is escaped; a missing address is '-'."""
    address = _SPACE.sub(lambda m: b"%%%02X" % m[0][0], (uri or "-").encode()) or b"-"
    line = address + f" 0.0.0.0 {date} {mime}".encode()
    if version == b"2":
        line += b" 200 %s - %d %s" % (hashlib.md5(block).hexdigest().encode(), at, name.encode())
    return line + b" %d\n" % len(block) + block + b"\n"


def read_arc(data: bytes) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of each record after the version block, by declared lengths.

    The address may hold blanks, so fields are taken from the right. Bad lines and lengths raise.
    """
    at, fields = 0, None
    while at < len(data):
        stop = data.index(b"\n", at)
        line = data[at:stop].rstrip(b"\r")
        if not line:  # records may be parted by further line ends
            at = stop + 1
            continue
        length = int(line.rsplit(b" ", 1)[1])
        block, at = data[stop + 1:stop + 1 + length], stop + 1 + length
        if len(block) != length:
            raise ValueError("the archive ends within a record")
        if fields is None:
            version = block.split(b" ", 1)[0]
            if not line.startswith(b"filedesc://") or version not in ARC_FIELDS:
                raise ValueError("not an archive of a known version")
            fields = ARC_FIELDS[version]
            continue
        parts = line.rsplit(b" ", len(fields) - 1)
        if len(parts) != len(fields):
            raise ValueError(f"bad header line {line[:80]!r}")
        yield dict(zip(fields, parts)), block


def iso_date(date: str) -> str:
    """WARC date of a legacy date of 8, 12 or 14 digits; missing parts are zero."""
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_arc(pages: DataFrame, version: bytes = b"1", date: str = "20000101000000") -> DataFrame:
    """Legacy archives (arc binary) of pages: each html in UTF-8 (NULL: empty) behind a short HTTP head."""
    def archives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size, name = [], 0, "pages.arc"
        for b in batches:
            for page, uri, html in zip(b["page_id"], b["url"], b["html"]):
                body = (html or "").encode()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {page or ''}\r\n\r\n"
                parts = parts or [arc_header(version, name, date)]
                parts.append(arc_record(version, uri, date, "text/html", head.encode() + body, name, size))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"arc": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"arc": [b"".join(parts)]})

    return pages.select(F.col("page_id").cast("string"), "url", "html").mapInPandas(archives, "arc binary")


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """Records for WARC from legacy archives: identifiers, dates, types and digests are made from what the archive has.

    record_id: a name-based UUID of address, date, page and digest, so that a repeated run gives the same.
    """
    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for arc in b["arc"]:
                rows = []
                for head, block in read_arc(bytes(arc)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    page = _number(_field(http, b"x-page-id"))
                    digest, uri, date = hashlib.sha256(payload).hexdigest(), head[b"URL"].decode(), iso_date(head[b"Archive-date"].decode())
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{uri} {date} {page} {digest}")
                    rows.append((page, uri, date, head[b"Content-type"].decode(), http + b"\r\n\r\n", payload, digest, f"urn:uuid:{name}"))
                frame = pd.DataFrame(rows, columns=["page_id", "uri", "date", "mime", "http", "payload", "digest", "record_id"])
                yield frame.astype({"page_id": "Int64"})

    return archives.mapInPandas(records, _RECORD)


def _field(head: bytes, name: bytes) -> bytes:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name:
            return value.strip()
    return b""


def _number(value: bytes) -> int | None:
    return int(value) if value else None


def mark_revisits(records: DataFrame) -> DataFrame:
    """Add ``first``: the least page_id with the same payload if that is another page, else NULL.

    Minima and counts are taken before the shuffle; only digests that repeat are joined back, so a
    frequent payload is one row of the small side.
    """
    long = records.filter(F.octet_length("payload") >= LEAST_REVISIT)
    firsts = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter("n > 1").select("digest", "first")
    joined = records.join(firsts, "digest", "left")
    return joined.withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")))


def warc_record(uri, date, mime, http, payload, digest, record_id, first) -> bytes:
    """One WARC record; a revisit keeps the HTTP head only."""
    revisit = first is not None
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id}>",
             f"WARC-Date: {date}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Identified-Payload-Type: {mime}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT}", f"Refers-To-Page: {first}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(marked: DataFrame, path: str) -> None:
    """WARC files of some MB of records, each a gzip member of its own, through Spark's writer: one text row a
    file. The writer's line end is an empty member, so a file is nothing but members."""
    def files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for b in batches:
            for row in b.itertuples(index=False):
                record = warc_record(*row)
                parts.append(gzip.compress(record, mtime=0))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield pd.DataFrame({"data": [b"".join(parts)]})
                    parts, size = [], 0
        if parts:
            yield pd.DataFrame({"data": [b"".join(parts)]})

    rows = marked.select("uri", "date", "mime", "http", "payload", "digest", "record_id", F.col("first").cast("string"))
    rows.mapInPandas(files, "data binary").select(F.col("data").cast("string").alias("value")).write.option(
        "maxRecordsPerFile", 1).option("encoding", "ISO-8859-1").option("lineSep", gzip.compress(b"", mtime=0).decode("latin-1")).text(path)


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a gzip file, by declared lengths."""
    data, at = gzip.GzipFile(fileobj=io.BytesIO(data)).read(), 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        version, *lines = data[at:stop].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        length, start = int(fields["content-length"]), stop + 4
        block = data[start:start + length]
        if len(block) != length or data[start + length:start + length + 4] != b"\r\n\r\n":
            raise ValueError("bad length of a record")
        yield fields, block
        at = start + length + 4


def read_warcs(spark, path: str) -> DataFrame:
    """Records of the files at ``path``, one task a file: page_id, uri, record_id, payload_bytes, digests, type, refers_to.

    A response's payload is hashed anew and must match its header.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for data in b["content"]:
                out = []
                for fields, block in read_warc(bytes(data)):
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError("a payload differs from its digest")
                    first = fields.get("refers-to-page")
                    out.append((_number(_field(http, b"x-page-id")), int(_field(http, b"content-length")), digest, kind,
                                int(first) if first else None, fields["warc-record-id"], fields["warc-target-uri"], fields["warc-date"]))
                frame = pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
                                                   "record_id", "uri", "date"])
                yield frame.astype({"page_id": "Int64", "refers_to": "Int64"})

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return found.mapInPandas(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                                   "record_id string, uri string, date string")


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """Pages as legacy archives, converted, deduplicated, written as WARC and read back: one row per page.

    NULL html is an empty payload, a NULL address '-', a NULL page_id stays NULL and is no revisit's target. Rows that repeat a page_id with the same
    payload all count as that page. No pages: no rows. Extra columns are ignored.
    """
    spark = pages.sparkSession
    path = shared_folder(spark)
    write_warc(mark_revisits(arc_to_warc(to_arc(pages))), path)
    return read_warcs(spark, path)
