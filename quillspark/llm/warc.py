"""Legacy archive converter: ARC 1 and ARC 2 to WARC 1.1, with repeated payloads as revisits.

``parse_arc`` reads the version block, then each record by its version-specific header line and
its declared length. ``convert`` turns the records into WARC fields: identifiers are name-based
UUIDs of place and content, 14-digit dates become ISO times, HTTP content becomes ``response`` and
anything else ``resource``, and payload and block digests are SHA-256. ``assign`` makes each later
record with the payload of an earlier one a ``revisit``; ``write`` writes archives with Spark's
text writer (records end with two line ends, as the format asks), ``read_back`` parses them again.

Defined results: a null document is an empty payload; a null URL becomes ``urn:record:ID``, blanks
in a URL are percent-encoded; rows without an id never win over rows with one; repeated rows of the
winning id are all responses; a declared length beyond the end gives a record with
``WARC-Truncated``; lines where a header line should stand but doesn't are skipped up to the next
header line and counted (``malformed``); a very long document is one record; other columns are not looked
at; an empty table gives no archive and no row.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, read, scratch_path, slices, small_batches

MIN_PAYLOAD = 100
#: Bounds of an archive: records, and bytes of payload before compression.
RECORDS_PER_FILE = 1000
FILE_BYTES = 256_000_000
END = b"\r\n\r\n"
#: Fields after the URL on a header line, by version (fixed values of the format).
FIELDS = {1: ("ip", "date", "mime", "length"), 2: ("ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
COLUMN_LINE = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}


class ArcRecord(NamedTuple):
    url: str
    date: str
    mime: str
    offset: int
    content: bytes
    truncated: bool


def arc_header(version: int, url: str, date: str, mime: str, length: int, status: int = 200, name: str = "-") -> bytes:
    url = re.sub(r"[\s\x00-\x1f]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)
    more = f" {status} - - 0 {name}" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} {mime}{more} {length}\n".encode()


def arc_file(version: int, name: str, date: str, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An archive of (url, date, mime, content) records behind its version block."""
    block = f"{version} 0 quill\n{COLUMN_LINE[version]}\n".encode()
    parts = [arc_header(version, f"filedesc://{name}", date, "text/plain", len(block), name=name), block, b"\n"]
    for url, when, mime, content in records:
        parts += [arc_header(version, url, when, mime, len(content), name=name), content, b"\n"]
    return b"".join(parts)


def parse_arc(raw: bytes, skipped: list[int] | None = None) -> Iterator[ArcRecord]:
    """Records of an archive; the version block says which header lines follow.

    A line that is no header line is an error, or, with ``skipped``, noted there by its place; reading
    goes on at the next line that is one.
    """
    at, version = 0, 0
    while at < len(raw):
        if raw[at] in b"\r\n":  # separators between records
            at += 1
            continue
        end = raw.find(b"\n", at)
        end = len(raw) if end < 0 else end
        line = raw[at:end].decode("utf-8", "replace").rstrip("\r")
        if not version:
            declared = line.rpartition(" ")[2]
            if declared.isdecimal():
                length = int(declared)
                first = raw[end + 1 : end + 1 + length].split(None, 1)
                version = int(first[0]) if first and first[0] in (b"1", b"2") else 1
                at = end + 1 + length
                continue
        else:
            fields = line.rsplit(" ", len(FIELDS[version]))
            found = dict(zip(FIELDS[version], fields[1:], strict=True)) if len(fields) == len(FIELDS[version]) + 1 else {}
            if found.get("length", "").isdecimal():
                length = int(found["length"])
                content = raw[end + 1 : end + 1 + length]
                yield ArcRecord(fields[0], found["date"], found["mime"], at, content, len(content) < length)
                at = end + 1 + length
                continue
        if skipped is None:
            raise ValueError(f"no ARC header line at byte {at}")
        skipped.append(at)
        at = end + 1


def iso_date(date: str) -> str:
    """14 digits, or fewer from the left, as an ISO time; anything else is the epoch."""
    if not re.fullmatch(r"\d{4,14}", date):
        return "1970-01-01T00:00:00Z"
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Header part with its blank line, and payload; content that isn't HTTP is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    at = content.find(END)
    return (content, b"") if at < 0 else (content[: at + 4], content[at + 4 :])


RECORD = "record_id string, target_uri string, warc_date string, warc_type string, key long, payload_bytes long, payload_digest string, truncated boolean"


def convert(batches: Iterator[pa.RecordBatch], with_block: bool) -> Iterator[pa.RecordBatch]:
    """(path, content) batches of ARC files as WARC fields, with header and payload bytes on request."""
    for b in slices(batches):
        rows = []
        for path, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            for r in parse_arc(raw, []):
                head, payload = split_http(r.content)
                digest = hashlib.sha256(payload).hexdigest()
                key = re.search(rb"\r\nX-Document-Id: (-?\d+)\r\n", head)
                ident = uuid.uuid5(uuid.NAMESPACE_URL, f"{path}\n{r.offset}\n{r.url}\n{r.date}\n{digest}")
                rows.append((f"<urn:uuid:{ident}>", r.url, iso_date(r.date), "response" if head else "resource", int(key[1]) if key else None, len(payload), digest, r.truncated, head, payload))
        kinds = [pa.string()] * 4 + [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")] + ["head", "payload"]
        n = len(names) if with_block else len(names) - 2
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(n)], names[:n])


def records(arcs: DataFrame, with_block: bool = True) -> DataFrame:
    """WARC fields of the records in ARC files given as (path, content)."""
    return arcs.select("path", "content").mapInArrow(lambda it: convert(it, with_block), RECORD + ", head binary, payload binary" * with_block)


def malformed(arcs: DataFrame) -> DataFrame:
    """(path, lines): the lines of each ARC file that stand where a header line should and are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts = []
            for raw in b.column("content").to_pylist():
                skipped: list[int] = []
                for _ in parse_arc(raw, skipped):
                    pass
                counts.append(len(skipped))
            yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(counts, pa.int64())], ["path", "lines"])

    return arcs.select("path", "content").mapInArrow(run, "path string, lines long").where("lines > 0")


def winners(keys: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """For each payload that several records share: the record that stays a response."""
    first = F.min(F.struct(F.col("key").isNull().alias("no_key"), "key", "record_id", "target_uri", "warc_date")).alias("first")
    return keys.where(F.col("payload_bytes") >= min_payload).groupBy("payload_digest").agg(F.count("*").alias("n"), first).where("n > 1").select(F.col("payload_digest").alias("first_digest"), "first")


def assign(found: DataFrame, first: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """Adds ``first`` (null for responses). The digest join is a plain equi-join: a hot payload's
    records may be split over tasks at run time, since nothing above needs them together."""
    joined = found.join(first, (F.col("payload_digest") == F.col("first_digest")) & (F.col("payload_bytes") >= min_payload), "left")
    later = F.col("first").isNotNull() & ~F.col("first.key").eqNullSafe(F.col("key"))
    return joined.withColumn("first", F.when(later, F.col("first"))).drop("first_digest")


def warc_record(r: dict) -> bytes:
    """One record without the two line ends that close it."""
    head, payload, first = r["head"] or b"", r["payload"] or b"", r["first"]
    block = head if first else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if first else r['warc_type']}", f"WARC-Record-ID: {r['record_id']}", f"WARC-Date: {r['warc_date']}", f"WARC-Target-URI: {r['target_uri']}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}"]
    if first:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {first['record_id']}", f"WARC-Refers-To-Target-URI: {first['target_uri']}", f"WARC-Refers-To-Date: {first['warc_date']}", f"X-Payload-Length: {r['payload_bytes']}"]
        if first["key"] is not None:
            lines.append(f"X-Refers-To-Document: {first['key']}")
    if r["truncated"]:
        lines.append("WARC-Truncated: unspecified")
    lines += [f"Content-Type: {'application/http; msgtype=response' if head else 'application/octet-stream'}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


def write(assigned: DataFrame, path: str, compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE, file_bytes: int = FILE_BYTES, largest: int | None = None) -> None:
    """Archives of at most ``records_per_file`` records and some ``file_bytes`` bytes, so that a reader
    holds a bounded file: records larger than the mean share of a file go to archives of their own size class,
    each class with as many records for each file as fit. A single record beyond the bound is a file.
    ``largest`` is the largest payload, if it is known."""
    if largest is None:
        largest = assigned.agg(F.max("payload_bytes")).first()[0] or 0
    share, classes = file_bytes // records_per_file, []
    while share < largest:
        classes.append(share)
        share *= 64
    for k, most in enumerate([*classes, share]):
        part = assigned.where(F.col("payload_bytes") <= most) if k == 0 else assigned.where((F.col("payload_bytes") > classes[k - 1]) & (F.col("payload_bytes") <= most))
        _write(part, f"{path}/class-{k}", compression, max(1, min(records_per_file, file_bytes // most)))


def _write(assigned: DataFrame, path: str, compression: str, records_per_file: int) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([warc_record(r) for r in b.to_pylist()], pa.binary())], ["record"])

    rows = assigned.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    with small_batches(assigned.sparkSession):
        rows.write.option("lineSep", END.decode()).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record, by declared length."""
    at = 0
    while (at := raw.find(b"WARC/", at)) >= 0:
        end = raw.index(END, at)
        lines = raw[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        length = int(headers["content-length"])
        yield headers, raw[end + 4 : end + 4 + length]
        at = end + 4 + length


def read_back(spark, path: str) -> DataFrame:
    """One row for each record of the archives, payload digests of responses computed anew."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for raw in b.column("content").to_pylist():
                rows = []
                for h, block in parse_warc(gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw):
                    head, payload = split_http(block)
                    doc = re.search(rb"\r\nX-Document-Id: (-?\d+)\r\n", head)
                    revisit = h["warc-type"] == "revisit"
                    digest = h["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    size = int(h["x-payload-length"]) if revisit else len(payload)
                    rows.append((int(doc[1]) if doc else None, size, digest, h["warc-type"], int(h["x-refers-to-document"]) if "x-refers-to-document" in h else None, h["warc-record-id"], h.get("warc-refers-to"), h["warc-target-uri"], h["warc-date"]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * 4
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "refers_to_record", "target_uri", "warc_date"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    before = spark.conf.get(key)
    spark.conf.set(key, "1")  # an archive at a time
    try:
        return materialise(files.mapInArrow(run, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, refers_to_record string, target_uri string, warc_date string"), "warc-index")
    finally:
        spark.conf.set(key, before)


def as_arc(docs: DataFrame, id_col: str, url_col: str, text_col: str) -> DataFrame:
    """Each row as a one-record ARC file (path, content): even ids version 1, others version 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            paths, raws = [], []
            for key, url, text in zip(*(b.column(c).to_pylist() for c in (id_col, url_col, text_col)), strict=True):
                body = (text or "").encode()
                ident = "" if key is None else f"X-Document-Id: {key}\r\n"
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{ident}Content-Length: {len(body)}\r\n\r\n".encode()
                version = 1 + (key or 0) % 2
                paths.append(f"{key}.arc")
                raws.append(arc_file(version, f"{key}.arc", "20240101000000", [(url or f"urn:record:{key}", "20240101000000", "text/html", head + body)]))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(raws, pa.binary())], ["path", "content"])

    return docs.select(id_col, url_col, text_col).mapInArrow(run, "path string, content binary")


def op1_legacy_archive_converter(spark, sf_dir):
    arcs = as_arc(read(spark, sf_dir, "pages"), "page_id", "url", "html")
    with small_batches(spark):
        keys = materialise(records(arcs, with_block=False), "record-keys")
    path = scratch_path(spark, "warc")
    write(assign(records(arcs), winners(keys)), path, largest=keys.agg(F.max("payload_bytes")).first()[0] or 0)
    return read_back(spark, path).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest FROM p),
w AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN w.first_id < d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.first_id < d.page_id THEN w.first_id END AS refers_to
FROM d LEFT JOIN w ON d.payload_digest = w.payload_digest AND d.payload_bytes >= 100
"""
