"""ARC archives to WARC archives: version-specific header lines, declared lengths, synthesised WARC fields.

An ARC record is a header line and as many bytes as the line declares; version 1 has five fields, version 2 ten.
The converter reads both, splits an HTTP response into header and payload, and makes what WARC wants beyond:
record ids, ISO dates, types, block and payload digests. Payloads stay the bytes they are, and HTTP headers are read as
ISO-8859-1, which keeps every byte, so declared lengths hold for any content. What is no record is counted and passed
over up to the next line that looks like a record's header. Archives are written by Spark's text writer in files of bounded
size and read back whole files at a time, cut by declared lengths only.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curalume.plans.tables import delete, saved, session_dir

_V1 = "URL IP-address Archive-date Content-type Archive-length"
_V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = "record_id string, uri string, ip string, date string, http string, payload binary, payload_bytes long, payload_digest string"
#: A line that can start a record: a URL, an address, a date, and a length at its end.
_LIKELY = re.compile(rb"^[a-z][a-z0-9+.-]*:[^\n]* (?:-|[0-9a-f.:]+) \d{4,17} [^\n]*\d\r?$", re.I | re.M)


def arc_header(version: int, name: str, date: str) -> bytes:
    """The version block that starts an ARC file and says how its header lines are laid out."""
    body = f"{version} 0 curalume\n{_V1 if version == 1 else _V2}\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body)


def arc_record(version: int, url: str, ip: str, date: str, kind: str, body: bytes) -> bytes:
    fields = [url, ip, date, kind] + (["200", "-", "-", "0", "-"] if version == 2 else []) + [str(len(body))]
    return " ".join(fields).encode() + b"\n" + body + b"\n"


def parse_arc(data: bytes) -> Iterator[tuple[dict[str, str] | None, bytes]]:
    """The records behind the version block, as header fields and content; None and the bytes passed over where a header or a length is wrong."""
    at, names = 0, _V1.split()
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        stop = data.find(b"\n", at)
        line = data[at : stop if stop >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        fields = line.split(" ")
        size = int(fields[-1]) if fields[-1].isascii() and fields[-1].isdigit() and len(fields) >= 5 else -1
        if stop < 0 or size < 0 or stop + 1 + size > len(data):
            next_ = _LIKELY.search(data, stop + 1) if stop >= 0 else None
            to = next_.start() if next_ else len(data)
            yield None, data[at:to]
            at = to
            continue
        body = data[stop + 1 : stop + 1 + size]
        at = stop + 1 + size
        if line.startswith("filedesc:"):
            layout = body.decode("utf-8", "replace").split("\n")
            names = _V2.split() if layout[0].startswith("2") else _V1.split()
            continue
        if len(fields) > len(names):  # a URL with spaces
            extra = len(fields) - len(names)
            fields = [" ".join(fields[: extra + 1]), *fields[extra + 1 :]]
        yield dict(zip(names, fields, strict=False)), body


def _iso(date: str) -> str:
    d = (date + "00000000000000")[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def convert(data: bytes) -> Iterator[tuple]:
    """RECORD_SCHEMA rows of one ARC archive. Content without an HTTP header is all payload."""
    for fields, body in parse_arc(data):
        if fields is None:
            continue
        head, payload = b"", body
        if body.startswith(b"HTTP/"):
            cut = body.find(b"\r\n\r\n")
            head, payload = (body, b"") if cut < 0 else (body[: cut + 4], body[cut + 4 :])
        digest = hashlib.sha256(payload).hexdigest()
        name = hashlib.sha256(b"\n".join((fields["URL"].encode(), fields["Archive-date"].encode(), head, digest.encode()))).digest()
        yield f"urn:uuid:{uuid.UUID(bytes=name[:16], version=5)}", fields["URL"], fields["IP-address"], _iso(fields["Archive-date"]), head.decode("latin-1"), payload, len(payload), digest


def _records(rows: list[tuple], with_payload: bool = True) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * 8
    names = [x.split()[0] for x in RECORD_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c if with_payload or n != "payload" else [None] * len(rows), pa.int64() if n == "payload_bytes" else pa.binary() if n == "payload" else pa.string()) for n, c in zip(names, cols, strict=True)], names=names)


def arc_records(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """RECORD_SCHEMA rows of `archives`, whose first column holds whole ARC archives (binary)."""

    def run(batches):
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for r in convert(data.as_py() or b""):
                    rows.append(r)
                    size += r[6]
                    if size > 1 << 23:
                        yield _records(rows, with_payload)
                        rows, size = [], 0
                yield _records(rows, with_payload)

    return archives.mapInArrow(run, RECORD_SCHEMA)


def broken_records(archives: DataFrame) -> DataFrame:
    """One row (n_records, n_broken) of `archives`, whose first column holds whole ARC archives: records read, and stretches that are none."""

    def run(batches):
        for batch in batches:
            found = [[f is not None for f, _ in parse_arc(data.as_py() or b"")] for data in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(x) for x in found], pa.int64()), pa.array([len(x) - sum(x) for x in found], pa.int64())], names=["good", "bad"])

    return archives.mapInArrow(run, "good long, bad long").agg(F.coalesce(F.sum("good"), F.lit(0)).alias("n_records"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_broken"))


def unpacked_files(spark: SparkSession, path: str) -> DataFrame:
    """(arc) the whole files under a path; .gz files are unpacked, member by member."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content")

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([unpacked(x.as_py()) for x in batch.column(0)], pa.binary())], names=["arc"])

    return raw.mapInArrow(run, "arc binary")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """RECORD_SCHEMA rows of the ARC files under a path."""
    return arc_records(unpacked_files(spark, path))


def unpacked(data: bytes) -> bytes:
    """The members of a gzip file one after the other, up to what is damaged; other data as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data[:2] == b"\x1f\x8b":
        d = zlib.decompressobj(31)
        try:
            for i in range(0, len(data), 1 << 16):
                out.append(d.decompress(d.unconsumed_tail + data[i : i + (1 << 16)]))
                if d.eof:
                    break
        except zlib.error:
            break
        if not d.eof:
            break
        data = d.unused_data + data[i + (1 << 16) :]
    return b"".join(out)


def page_archives(pages: DataFrame, version: int = 1, date: str = "20240101000000", block_bytes: int = 1 << 22) -> DataFrame:
    """ARC archives (binary) of pages(page_id, url, html): each an HTTP response whose header names the page."""

    def run(batches):
        def done(parts):
            return pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["arc"])

        head = arc_header(version, "pages.arc", date)
        parts, size = [head], 0
        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = (html or "").encode()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'' if page is None else page}\r\n\r\n".encode()
                parts.append(arc_record(version, "%20".join((url or "unknown:").split()), "0.0.0.0", date, "text/html", http + body))
                size += len(body)
                if size > block_bytes:
                    yield done(parts)
                    parts, size = [head], 0
        yield done(parts)

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "arc binary")


def page_of(http):
    """The page that a record's HTTP header names."""
    return F.nullif(F.regexp_extract(http, r"\nX-Page-Id: (-?\d+)\r", 1), F.lit("")).cast("long")


def first_copies(records: DataFrame, least_bytes: int = 100) -> DataFrame:
    """(record_id, refers_to): for each record whose payload of `least_bytes` or more a smaller page has, the record id of the smallest such page."""
    known = records.where(F.col("payload_bytes") >= least_bytes).select(page_of("http").alias("page_id"), "payload_digest", "record_id").where("page_id is not null")
    first = known.groupBy("payload_digest").agg(F.min(F.struct("page_id", "record_id")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return known.join(first, "payload_digest").where(F.col("page_id") > F.col("first.page_id")).select("record_id", F.col("first.record_id").alias("refers_to")).distinct()


def write_warc(records: DataFrame, path: str, file_bytes: int = 1 << 25) -> None:
    """Write RECORD_SCHEMA rows with refers_to (a record id or null) as gzipped WARC 1.1 files of about `file_bytes` before packing, or of one larger record: a revisit keeps its HTTP header but no payload."""

    def run(batches):
        info = "software: curalume\r\nformat: WARC File Format 1.1\r\n"
        end = _END.encode()

        def lead():
            return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}".encode()

        def file(parts):  # bytes as a string column, which the text writer writes as they are
            return pa.RecordBatch.from_arrays([pa.array([end.join(parts)], pa.binary()).view(pa.string())], names=["value"])

        parts, held = [lead()], 0
        for batch in batches:
            for id_, uri, ip, date, http, payload, n, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = http.encode("latin-1")
                block = head if refers else head + payload
                if held and held + len(block) > file_bytes:
                    yield file(parts)
                    parts, held = [lead()], 0
                kind = "revisit" if refers else "response" if http else "resource"
                more = f"WARC-Refers-To: <{refers}>\r\nWARC-Profile: {_PROFILE}\r\n" if refers else ""
                mime = "application/http; msgtype=response" if http else "application/octet-stream"
                parts.append(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{id_}>\r\nWARC-Target-URI: {uri}\r\nWARC-IP-Address: {ip}\r\nWARC-Date: {date}\r\nWARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}\r\nWARC-Payload-Digest: sha256:{digest}\r\n{more}Content-Type: {mime}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block)
                held += len(block) + 600
        yield file(parts)

    rows = records.select("record_id", "uri", "ip", "date", "http", "payload", "payload_bytes", "payload_digest", "refers_to")
    rows.mapInArrow(run, "value string").write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of an unpacked archive."""
    at = 0
    while at < len(data):
        if data[at] in b"\r\n":
            at += 1
            continue
        cut = data.find(b"\r\n\r\n", at)
        if cut < 0:
            return
        lines = data[at:cut].decode("utf-8", "replace").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields.get("content-length", "0"))
        yield fields, data[cut + 4 : cut + 4 + n]
        at = cut + 4 + n


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, record_type, uri, date, http, payload_bytes, payload_digest, refers_to) of response, resource and revisit records.

    A response's payload is measured and hashed from its block; a revisit, which has none, gives what it declares.
    """
    schema = "record_id string, record_type string, uri string, date string, http string, payload_bytes long, payload_digest string, refers_to string"

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                out = []
                for f, block in parse_warc(unpacked(content.as_py())):
                    kind = f.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    cut = block.find(b"\r\n\r\n") + 4 if block.startswith(b"HTTP/") else 0
                    http = block[:cut].decode("latin-1")
                    if kind == "revisit":
                        declared = [x.partition(":")[2].strip() for x in http.split("\r\n") if x.lower().startswith("content-length:")]
                        n, digest = int(declared[0]) if declared else None, f.get("warc-payload-digest", "").rpartition(":")[2]
                    else:
                        n, digest = len(block) - cut, hashlib.sha256(memoryview(block)[cut:]).hexdigest()
                    out.append((f.get("warc-record-id", "").strip("<>"), kind, f.get("warc-target-uri"), f.get("warc-date"), http, n, digest, f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None))
                cols = list(zip(*out, strict=True)) or [()] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i == 5 else pa.string()) for i, c in enumerate(cols)], names=[x.split()[0] for x in schema.split(", ")])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(run, schema)


def archived_pages(pages: DataFrame, version: int = 1) -> DataFrame:
    """Pages as ARC archives, converted and written as WARC, and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Of equal payloads of 100 bytes or more the smallest page is the response, later pages revisit it. A repeated row is
    a second response or revisit with the same record id; rows of one page with different html are records of their
    own, each response or revisit by its own payload. A null html is an empty
    payload, a null url is written as unknown:, a null page_id reads back as null and is never referred to.
    Other columns are ignored; an empty table gives no rows. The archives are removed when they have been read back.
    """
    spark = pages.sparkSession
    archives = page_archives(pages, version)
    first = first_copies(arc_records(archives, with_payload=False))
    records = arc_records(archives).withColumn("page_id", page_of("http"))
    path = f"{session_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(records.join(first, "record_id", "left"), path)
    back = saved(read_warc(spark, path).withColumn("page_id", page_of("http")).drop("http", "uri", "date"), "records")
    delete(spark, path)
    revisits = back.where("refers_to is not null")  # responses refer to none and stay where they are
    ids = back.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("of")).join(revisits.select("refers_to").distinct(), "refers_to").distinct()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    return back.where("refers_to is null").select(*columns, F.lit(None).cast("long").alias("refers_to")).unionByName(revisits.join(ids, "refers_to", "left").select(*columns, F.col("of").alias("refers_to")))
