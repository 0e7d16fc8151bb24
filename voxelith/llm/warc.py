"""Legacy archive converter: ARC files, versions 1 and 2, to WARC/1.1.

An archive is a row (path, content), the schema of Spark's binaryFile source.
``read_arc`` parses it, ``assign_revisits`` finds identical payloads,
``write_warc`` writes archives through Spark's text writer (record separator
CRLFCRLF, so any Hadoop file system takes them) and ``read_warc`` parses them.

Defined results: null content gives no record; an archive cut short or with a
malformed header line gives the records before that point and one with
``error`` set; records without a key are always responses; two records with
the same key and payload are both responses; empty archives and empty tables
give no rows.
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

from .common import fresh_path, materialise

KEY_HEADER = b"X-Record-Key"
RECORD = "path string, offset long, arc_version int, url string, ip string, date string, mime string, key long, head binary, payload binary, payload_bytes long, digest string, error string"
ENTRY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string, verified boolean"
#: Fields after the URL in a header line, from the right, by ARC version.
ARC_FIELDS = {
    1: ("ip", "date", "mime", "length"),
    2: ("ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _plain(content: bytes) -> bytes:
    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _uri(url: str | None, key: int | None) -> str:
    """A URL fit for a header line: controls, blanks and DEL are percent-encoded."""
    if not url:
        return f"urn:record:{key}"
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def arc_header(version: int, url: str, date: str, mime: str, length: int, ip: str = "0.0.0.0", status: int = 200, offset: int = 0, filename: str = "-", checksum: str = "-") -> bytes:
    if version == 1:
        line = f"{url} {ip} {date} {mime} {length}\n"
    else:
        line = f"{url} {ip} {date} {mime} {status} {checksum} - {offset} {filename} {length}\n"
    return line.encode()


def arc_archive(name: str, version: int, records: list[tuple[int | None, str | None, bytes]], date: str = "20240101000000") -> bytes:
    """One ARC file with its version block; records are (key, url, payload)."""
    names = "URL IP-address Archive-date Content-type Archive-length" if version == 1 else "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    about = f"{version} 0 converter\n{names}\n".encode()
    out = [arc_header(version, f"filedesc://{name}", date, "text/plain", len(about), filename=name), about]
    size = sum(map(len, out))
    for key, url, payload in records:
        mark = b"" if key is None else KEY_HEADER + b": %d\r\n" % key
        body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + mark + b"Content-Length: %d\r\n\r\n" % len(payload) + payload
        head = arc_header(version, _uri(url, key), date, "text/html", len(body), offset=size + 1, filename=name)
        out += [b"\n", head, body]
        size += 1 + len(head) + len(body)
    return b"".join(out)


def _http(body: bytes) -> tuple[bytes, bytes]:
    """Header block (with its blank line) and payload of an HTTP message; no header block: all payload."""
    if body[:5] != b"HTTP/":
        return b"", body
    for gap in (b"\r\n\r\n", b"\n\n"):
        at = body.find(gap)
        if at >= 0:
            return body[: at + len(gap)], body[at + len(gap) :]
    return body, b""


def _field(head: bytes, name: bytes) -> bytes | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return m[1] if m else None


def parse_arc(path: str, content: bytes) -> Iterator[dict]:
    """Records of one ARC file. Lengths are the declared ones; the version is that of its version block."""
    data, at, version = _plain(content), 0, 1
    while True:
        while data[at : at + 1] in (b"\n", b"\r"):
            at += 1
        if at >= len(data):
            return
        start, end = at, data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        if line.startswith("filedesc://"):
            about = data[end + 1 : end + 80].lstrip()
            version = 2 if about[:1] == b"2" else 1
        names = ARC_FIELDS[version]
        parts = line.rsplit(" ", len(names))
        f = dict(zip(names, parts[1:], strict=False))
        if end < 0 or len(parts) <= len(names) or not f["length"].isdigit() or not re.fullmatch(r"\d{8,14}", f["date"]):
            yield {"path": path, "offset": start, "arc_version": version, "error": "malformed header line"}
            return
        at = end + 1 + int(f["length"])
        body = data[end + 1 : at]
        if len(body) < int(f["length"]):
            yield {"path": path, "offset": start, "arc_version": version, "url": parts[0], "error": "archive cut short"}
            return
        if line.startswith("filedesc://"):
            continue
        head, payload = _http(body)
        key = _field(head, KEY_HEADER)
        yield {
            "path": path, "offset": start, "arc_version": version, "url": parts[0], "ip": f["ip"], "date": f["date"], "mime": f["mime"],
            "key": int(key) if key and re.fullmatch(rb"-?\d{1,19}", key) else None, "head": head, "payload": payload, "payload_bytes": len(payload), "digest": sha1_base32(payload), "error": None,
        }


_ARROW = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("arc_version", pa.int32()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("mime", pa.string()), ("key", pa.int64()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("error", pa.string())])
_BATCH_BYTES = 8 << 20


def read_arc(archives: DataFrame, columns: tuple[str, ...] = ()) -> DataFrame:
    """Rows of RECORD for archives (path, content); only the named columns, if any are."""
    schema = pa.schema([f for f in _ARROW if not columns or f.name in columns])
    kinds = dict(x.strip().split(" ") for x in RECORD.split(","))

    def parse(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, size = [], 0
                for r in parse_arc(path.as_py(), content.as_py() or b""):
                    rows.append({f.name: r.get(f.name) for f in schema})
                    size += r.get("payload_bytes", 0) if "payload" in schema.names else 100
                    if size > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return archives.select("path", "content").mapInArrow(parse, ", ".join(f"{f.name} {kinds[f.name]}" for f in schema))


def assign_revisits(archives: DataFrame, min_bytes: int = 0) -> DataFrame:
    """All readable records with ``refers_key``: of records with equal payloads of at least min_bytes, the largest key; null for that record itself, smaller payloads and records without a key.

    The payload digests are counted first, without payloads and summed before the shuffle; only digests that occur twice are joined, from a written table, so a hot one can be split.
    """
    small = read_arc(archives, ("key", "payload_bytes", "digest"))
    twice = (
        small.where(F.col("key").isNotNull() & (F.col("payload_bytes") >= min_bytes))
        .groupBy("digest")
        .agg(F.max("key").alias("last_key"), F.min("key").alias("first_key"))
        .where("first_key < last_key")
        .select("digest", "last_key")
    )
    twice = materialise(twice, "warc-digests")
    records = read_arc(archives).where("error IS NULL")
    return records.join(twice, "digest", "left").withColumn("refers_key", F.expr("CASE WHEN key < last_key THEN last_key END")).drop("last_key")


def record_uuid(key: int | None, where: str) -> str:
    """A name for a record: version 8 carries its key, version 5 a hash of its place."""
    seed = int.from_bytes(hashlib.sha1(where.encode()).digest()[:16], "big")
    if key is None:
        n = seed & ~(0xF << 76) & ~(3 << 62) | 5 << 76 | 2 << 62
    else:
        k = key & (1 << 64) - 1
        n = (k >> 16) << 80 | 8 << 76 | (k >> 4 & 0xFFF) << 64 | 2 << 62 | (k & 15) << 58 | seed & (1 << 58) - 1
    return f"urn:uuid:{uuid.UUID(int=n)}"


def uuid_key(name: str | None) -> int | None:
    if not name:
        return None
    n = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if n >> 76 & 15 != 8:
        return None
    k = (n >> 80) << 16 | (n >> 64 & 0xFFF) << 4 | n >> 58 & 15
    return k - (1 << 64) if k >> 63 else k


def warc_date(date: str) -> str:
    d = date.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_record(r: dict) -> bytes:
    """The WARC record of a parsed ARC record, without the CRLFCRLF that ends it. Bodies that aren't HTTP become resource records."""
    revisit, http = r["refers_key"] is not None, bool(r["head"])
    block = r["head"] if revisit else r["head"] + r["payload"]
    kind = "revisit" if revisit else "response" if http else "resource"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_uuid(r['key'], 'record')}>" if r["key"] is not None else f"WARC-Record-ID: <{record_uuid(None, f'{r['path']}:{r['offset']}')}>",
        f"WARC-Date: {warc_date(r['date'])}", f"WARC-Target-URI: {r['url']}", f"WARC-IP-Address: {r['ip']}", f"WARC-Payload-Digest: sha1:{r['digest']}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}", f"X-Payload-Length: {r['payload_bytes']}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_uuid(r['refers_key'], 'record')}>"]
    lines += ["Content-Type: " + ("application/http;msgtype=response" if http else r["mime"]), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str) -> None:
    """Writes gzip-compressed archives, one a partition, each after a warcinfo record."""

    def build(batches):
        about = b"software: voxelith ARC converter\r\nformat: WARC File Format 1.1\r\n"
        first = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <" + record_uuid(None, "warcinfo").encode() + b">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: %d\r\n\r\n" % len(about) + about
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.binary())], ["value"])
        for batch in batches:
            names = batch.schema.names
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns = [c.to_pylist() for c in part.columns]
                yield pa.RecordBatch.from_arrays([pa.array([warc_record(dict(zip(names, row, strict=True))) for row in zip(*columns, strict=True)], pa.binary())], ["value"])

    rows = records.select("path", "offset", "url", "ip", "date", "mime", "key", "head", F.expr("CASE WHEN refers_key IS NULL THEN payload END").alias("payload"), "payload_bytes", "digest", "refers_key")
    rows.mapInArrow(build, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_warc(content: bytes) -> Iterator[dict]:
    """Entries of one WARC file, warcinfo left out; digests of whole payloads are verified."""
    data, at = _plain(content), 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
        at = end + 4 + int(head["Content-Length"])
        if head["WARC-Type"] == "warcinfo":
            continue
        _, payload = _http(data[end + 4 : at])
        digest, revisit = head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"] == "revisit"
        yield {
            "page_id": uuid_key(head["WARC-Record-ID"]), "payload_bytes": int(head["X-Payload-Length"]) if revisit else len(payload), "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": uuid_key(head.get("WARC-Refers-To")),
            "record_id": head["WARC-Record-ID"].strip("<>"), "warc_date": head["WARC-Date"], "target_uri": head["WARC-Target-URI"], "verified": revisit or sha1_base32(payload) == digest,
        }


_ENTRY = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("warc_date", pa.string()), ("target_uri", pa.string()), ("verified", pa.bool_())])


def read_warc(archives: DataFrame) -> DataFrame:
    def parse(batches):
        for batch in batches:
            for content in batch["content"]:
                rows = []
                for r in parse_warc(content.as_py()):
                    rows.append(r)
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_pylist(rows, _ENTRY)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ENTRY)

    return archives.select("content").mapInArrow(parse, ENTRY)


def pages_as_arc(pages: DataFrame, records: int = 1000, limit: int = 16 << 20) -> DataFrame:
    """ARC files (path, content) that hold the pages, of at most so many records and about so many bytes each; versions 1 and 2 by turns."""

    def pack(batches):
        from pyspark import TaskContext

        part, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, size = [], 0
            for key, url, html in zip(batch["page_id"], batch["url"], batch["html"], strict=True):
                rows.append((key.as_py(), url.as_py(), (html.as_py() or "").encode()))
                size += len(rows[-1][2])
                if len(rows) == records or size > limit:
                    yield _archive(part, k, rows)
                    rows, size, k = [], 0, k + 1
            if rows:
                yield _archive(part, k, rows)
                k += 1

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(pack, "path string, content binary")


def _archive(part: int, k: int, rows: list) -> pa.RecordBatch:
    name = f"pages-{part:05d}-{k:05d}.arc"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_archive(name, 1 + k % 2, rows)], pa.binary())], ["path", "content"])


def convert(archives: DataFrame, out: str | None = None, min_bytes: int = 0) -> DataFrame:
    """ARC files to WARC files in ``out`` (a new shared folder if none), read back as rows of ENTRY."""
    spark = archives.sparkSession
    out = out or fresh_path(spark, "warc")
    write_warc(assign_revisits(archives, min_bytes), out)
    return read_warc(spark.read.format("binaryFile").load(out))
