"""Web archives: legacy ARC files, their conversion to WARC, and reading both back.

Archives are written and read by Spark's own text and binary-file sources, so they can lie in any store Spark knows.
A row of an archive table is a segment: some records, at most ``SEGMENT`` bytes unless one record is larger; a file
holds at most ``SEGMENTS`` of them.  Records are found by their declared lengths, never by searching for separators.

The converter parses ARC headers of version 1 (url, IP, date, type, length) and version 2 (five more fields between)
as each segment's version block declares, and synthesises what WARC asks for beyond them: a record identifier (a UUID
of version 8 that holds the page's id and a hash of the record's place in the archive, which no other record has), an
ISO date, the record type and SHA-1 digests of block and payload.  Payloads are read, hashed and written where they
are; what is shuffled is digests and places.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calorine.llm.common import Steps

SEGMENT, SEGMENTS = 4 << 20, 16
#: Archive date of records made from a table that has none.
DATE = "20240101000000"
FIELDS = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
BREAK = b"\r\n\r\n"
#: Digests of repeated payloads that are broadcast to where payloads are; of more, the payloads are shuffled to them.
BROADCAST = 200_000


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    body: bytes
    opens: bool = False  # a version block


def arc_opening(version: int, origin: str = "calorine") -> bytes:
    """The version block that begins an ARC file."""
    block = f"{version} 0 {origin}\n{FIELDS[version]}\n\n".encode()
    tail = f"{len(block)}" if version == 1 else f"200 - - 0 {origin}.arc {len(block)}"
    return f"filedesc://{origin}.arc 0.0.0.0 {DATE} text/plain {tail}\n".encode() + block + b"\n"


def arc_record(version: int, url: str, body: bytes) -> bytes:
    tail = f"{len(body)}" if version == 1 else f"200 {hashlib.md5(body).hexdigest()} - 0 calorine.arc {len(body)}"
    return f"{url} 0.0.0.0 {DATE} text/html {tail}\n".encode() + body + b"\n"


def parse_arc(raw: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, its version blocks among them; a version holds until the next version block.

    A version block is a plain text of a ``filedesc`` url that names a version and its header fields; a page of such a
    url is none.  A header line whose field count isn't the version's, or a length past the end, raises ValueError.
    """
    at, version = 0, 1
    while at < len(raw):
        end = raw.find(b"\n", at)
        line = raw[at:] if end < 0 else raw[at:end]
        if not line.strip():
            at += len(line) + 1
            continue
        fields = line.decode().split(" ")
        length, start = int(fields[-1]), at + len(line) + 1
        body = raw[start : start + length]
        if len(body) != length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(body)} are left")
        opening = re.match(rb"([12]) \d+ [^\n]*\n([^\n]*)\n", body) if fields[0].startswith("filedesc://") and fields[3:4] == ["text/plain"] else None
        opens = opening is not None and opening[2].decode() == FIELDS[int(opening[1])]
        if opens:
            version = int(opening[1])
        if len(fields) != len(FIELDS[version].split()):
            raise ValueError(f"record at {at} has {len(fields)} header fields, version {version} has {len(FIELDS[version].split())}")
        yield ArcRecord(*fields[:4], body, opens)
        at = start + length


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, place: str) -> str:
    """A version-8 UUID: the 64 bits of the page's id (0 for none), then 58 bits of a hash of the record's place."""
    pid = (page_id or 0) & (1 << 64) - 1
    part = int.from_bytes(hashlib.sha1(place.encode()).digest()[:8], "big") >> 6
    bits = (pid >> 16) << 80 | 8 << 76 | (pid >> 4 & 0xFFF) << 64 | 2 << 62 | (pid & 0xF) << 58 | part
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def page_of(record: str) -> int:
    bits = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    pid = (bits >> 80) << 16 | (bits >> 64 & 0xFFF) << 4 | bits >> 58 & 0xF
    return pid - (1 << 64) if pid >> 63 else pid


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its empty line, and payload; no head where there is none."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    end = body.find(BREAK)
    return (body, b"") if end < 0 else (body[: end + 4], body[end + 4 :])


def headers_of(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def warc_record(url: str, date: str, head: bytes, payload: bytes, digest: str, own: str, target: str | None) -> bytes:
    """A response, or with ``target`` (the identifier of the record it repeats) a revisit, which keeps the HTTP head alone."""
    block = head if target is not None else head + payload
    iso = f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"
    kind = "revisit" if target is not None else "response" if head else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {own}", f"WARC-Date: {iso}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if target is not None:
        lines += [f"WARC-Refers-To: {target}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else 'application/octet-stream'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + BREAK + block


def warc_opening(place: str) -> bytes:
    block = b"software: calorine\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, place)}\r\nWARC-Date: {DATE[:4]}-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}"
    return head.encode() + BREAK + block


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record, by declared lengths."""
    at = 0
    while at < len(raw):
        if raw[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = raw.find(BREAK, at)
        if end < 0 or raw[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at {at}")
        headers = headers_of(raw[at:end])
        length = int(headers["content-length"])
        block = raw[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(block)} are left")
        yield headers, block
        at = end + 4 + length


def _inflate(raw: bytes) -> bytes:
    """Gzip members one after another."""
    if raw[:2] != b"\x1f\x8b":
        return raw
    out = []
    while raw:
        member = zlib.decompressobj(31)
        out.append(member.decompress(raw))
        raw = member.unused_data
    return b"".join(out)


def _segments(stream: Iterator[pa.RecordBatch], opening, record, mark: bytes) -> Iterator[pa.RecordBatch]:
    """Records of the rows, joined by ``mark`` into segments that begin with an opening."""
    made, parts, size = 0, [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([mark.join([opening(made), *parts]).decode()], pa.large_string()).cast(pa.string())], ["value"])

    for batch in stream:
        columns = batch.columns
        for i in range(batch.num_rows):
            row = [c[i].as_py() for c in columns]
            part = record(made, *row)
            if parts and size + len(part) > SEGMENT:
                yield flush()
                made, parts, size = made + 1, [], 0
                part = record(made, *row)  # the next segment may be of another version
            parts.append(part)
            size += len(part)
    if parts:
        yield flush()


def _url(url: str | None) -> str:
    """A url as one field of a header: white space escaped; ``-`` for null or empty."""
    return "".join(f"%{ord(c):02X}" if c.isspace() else c for c in url or "") or "-"


def write_arc(pages: DataFrame, path: str) -> None:
    """ARC files of pages (page_id, url, html), by turns of version 1 and 2; a null html is an empty payload."""

    def record(made: int, page_id: int | None, url: str | None, text: str | None) -> bytes:
        payload = (text or "").encode()
        own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()
        return arc_record(1 + made % 2, _url(url), head + payload).removesuffix(b"\n")

    def batches(stream):
        return _segments(stream, lambda made: arc_opening(1 + made % 2).removesuffix(b"\n"), record, b"\n")

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(batches, "value string")
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", SEGMENTS).text(path)


CONVERTED = "place string, page_id bigint, url string, date string, payload_digest string, payload_bytes bigint, head binary, payload binary"


def convert_arc(spark, path: str, payloads: bool = True) -> DataFrame:
    """CONVERTED rows of the ARC files under ``path``; without ``payloads`` the last two columns are null.

    place: the number of the file and that of the record in it.
    """

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.binary())
        names = [c.split(" ")[0] for c in CONVERTED.split(", ")]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        for batch in stream:
            for i in range(batch.num_rows):
                rows: list[tuple] = []
                size = 0
                name = re.search(r"part-(\d+)[^/]*?(-c\d+)?[.\w]*$", batch.column(0)[i].as_py())
                for number, r in enumerate(parse_arc(_inflate(batch.column(1)[i].as_py()))):
                    if r.opens:
                        continue
                    head, payload = split_http(r.body)
                    pid = headers_of(head[:-4]).get("x-page-id")
                    rows.append((f"{name[1]}{name[2] or ''}/{number}", None if pid is None else int(pid), r.url, r.date, base32_sha1(payload), len(payload), head if payloads else None, payload if payloads else None))
                    size += len(payload) if payloads else 100
                    if size > SEGMENT:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return _files(spark, path).mapInArrow(batches, CONVERTED)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_warc(arc_path: str, path: str, spark, least_bytes: int = 0, most_broadcast: int = BROADCAST) -> None:
    """Convert the ARC files to WARC files.

    Of records with equal payloads of ``least_bytes`` or more, that with the largest page id is a response and the
    others revisit it; records without a page id, and smaller ones, are responses.  Of repeated rows of the largest
    page id, all are responses and the others revisit one of them.
    """
    steps = Steps(spark, "warc")
    found = convert_arc(spark, arc_path, payloads=False).where((F.col("payload_bytes") >= least_bytes) & F.col("page_id").isNotNull())
    latest = found.groupBy("payload_digest").agg(F.max(F.struct("page_id", "place")).alias("t"), F.count(F.lit(1)).alias("n")).where("n > 1")
    latest = steps.write(latest.select("payload_digest", F.col("t.page_id").alias("latest"), F.col("t.place").alias("latest_place")))
    known = F.broadcast(latest) if latest.count() <= most_broadcast else latest
    rows = convert_arc(spark, arc_path).join(known, "payload_digest", "left")
    again = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") < F.col("latest"))

    def record(_: int, url: str, date: str, head: bytes, payload: bytes, digest: str, page_id: int | None, place: str, target: int | None, target_place: str | None) -> bytes:
        return warc_record(url, date, head, payload, digest, record_id(page_id, place), None if target is None else record_id(target, target_place))

    def batches(stream):
        task = TaskContext.get().partitionId()
        return _segments(stream, lambda made: warc_opening(f"warcinfo/{task}/{made}"), record, BREAK)

    # The text writer ends each segment by the mark between records.
    rows = rows.select("url", "date", "head", "payload", "payload_digest", "page_id", "place", F.when(again, F.col("latest")).alias("target"), F.when(again, F.col("latest_place")).alias("target_place")).mapInArrow(batches, "value string")
    rows.write.option("compression", "gzip").option("maxRecordsPerFile", SEGMENTS).option("lineSep", BREAK.decode()).text(path)
    steps.drop(latest)


def read_warc(spark, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records, each block's digest checked."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for i in range(batch.num_rows):
                rows = []
                for headers, block in parse_warc(_inflate(batch.column(1)[i].as_py())):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
                        raise ValueError(f"the block of {headers['warc-record-id']} is not what its digest says")
                    head, payload = split_http(block)
                    http = headers_of(head[:-4])
                    pid, target = http.get("x-page-id"), headers.get("warc-refers-to")
                    size = len(payload) if kind != "revisit" else int(http["content-length"])
                    digest = base32_sha1(payload) if kind != "revisit" else headers["warc-payload-digest"].removeprefix("sha1:")
                    rows.append((None if pid is None else int(pid), headers["warc-target-uri"], size, digest, kind, None if target is None else page_of(target)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return _files(spark, path).mapInArrow(batches, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def archive(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as ARC files, convert those to WARC files, and read the WARC files back.

    Each row of ``pages`` gives one record; nulls: an html is an empty payload, a url is ``-``, a page id stays null
    and such a record is a response.  An empty table gives no records.
    """
    spark = pages.sparkSession
    write_arc(pages, f"{folder}/arc")
    write_warc(f"{folder}/arc", f"{folder}/warc", spark, least_bytes)
    return read_warc(spark, f"{folder}/warc")
