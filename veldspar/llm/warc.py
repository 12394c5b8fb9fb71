"""WARC archives: a writer with revisit records, and a salvage reader (operator 1).

Writing: one gzip member per record, through Spark's own text writer, so that files commit like any other Spark output.
Of records with equal payloads of at least `least` bytes the one with the largest id is the response; the others are
revisits that refer to it and carry no payload.

Reading: members (or plain records) are checked: gzip checksum, version line, content length, closing blank lines,
SHA-1 of block and payload. After a failed check the reader searches for the next valid member or version line, goes on there,
and logs the bytes between as a quarantined gap with the reason. Within a sound member of several records the search goes by
version lines of the inflated bytes.

Defined results: a null payload is empty; null or line-broken urls are percent-encoded or left out; repeated rows with
the largest id are responses all; a null id is a record of its own without a number; empty tables write no record;
a torn, overwritten or concatenated file gives the records outside the damage. Other columns are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.llm.common import fits, materialise, shared_dir

#: Equal payloads below this many bytes stay responses.
LEAST = 1000
#: Records a file holds at most: keeps files small enough to be read one by one.
FILE_RECORDS = 20_000
#: Payload bytes of a file, about.
FILE_BYTES = 64 << 20
#: Tasks that share the pages of one payload where repeated payloads are too many for a broadcast.
SALTS = 64
_EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()
_DATE = "2024-01-01T00:00:00Z"


def _record(page_id: int | None, url: str | None, digest: str, size: int, refers: int | None, payload: bytes | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = payload is None
    block = http if revisit else http + payload
    b32 = lambda h: base64.b32encode(h).decode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Payload-Digest: sha1:{b32(bytes.fromhex(digest))}", f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if out[-1] == 0 else out + _EMPTY_MEMBER  # every row ends with the byte that the writer puts after it


def write_warc(pages: DataFrame, path: str, least: int = LEAST, file_records: int = FILE_RECORDS) -> None:
    """pages: page_id, url, html. Writes archives of gzip members under path (each about FILE_BYTES of payload and at most file_records records); which record of equal payloads is
    the response is decided by a narrow aggregate."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    long = rows.where(F.octet_length("html") >= least).groupBy("digest").agg(F.max("page_id").alias("newest"), F.count(F.lit(1)).alias("n"))
    twice = materialise(long.where("n > 1 and newest is not null").select("digest", "newest"))
    if fits(twice):
        rows = rows.join(F.broadcast(twice), "digest", "left")
    else:  # salted, so that the pages of the commonest payload don't meet in one task
        twice = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(twice, ["digest", "salt"], "left")
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 0.0
    file_records = max(1, min(file_records, int(FILE_BYTES / max(mean, 1.0))))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes] = []
            held = 0
            for page_id, url, html, digest, newest in zip(*(b.column(n) for n in ("page_id", "url", "html", "digest", "newest")), strict=True):
                payload = html.as_py().encode("utf-8", "surrogatepass")
                page, newest = page_id.as_py(), newest.as_py()
                revisit = newest is not None and page != newest
                out.append(_member(_record(page, url.as_py(), digest.as_py(), len(payload), newest, None if revisit else payload))[:-1])
                held += len(out[-1])
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(out, pa.binary())], ["member"])
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(out, pa.binary())], ["member"])

    members = rows.select("page_id", "url", "html", "digest", "newest").mapInArrow(build, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", file_records).text(path)


# --- salvage reader ---------------------------------------------------------------------------------------------

_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_GZIP = b"\x1f\x8b\x08"


class Damage(Exception):
    pass


def _headers(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.split(b"\n"):
        name, colon, value = line.rstrip(b"\r").partition(b":")
        if not colon:
            raise Damage("header line without a colon")
        out[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    return out


def _sha1_matches(said: str | None, data: bytes) -> bool:
    if not said or not said.lower().startswith("sha1:"):
        return True
    own, value = hashlib.sha1(data), said[5:]
    return value.upper() == base64.b32encode(own.digest()).decode() or value.lower() == own.hexdigest()


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, Any], int]:
    """The checked record at a version line, and where it ends."""
    m = _VERSION.match(data, at)
    if not m:
        raise Damage("no version line")
    stop = re.compile(rb"\r?\n\r?\n").search(data, m.end())
    if not stop:
        raise Damage("headers don't end")
    head = _headers(data[m.end() : stop.start()])
    if not head.get("content-length", "").isdigit():
        raise Damage("no content length")
    end = stop.end() + int(head["content-length"])
    if end > len(data):
        raise Damage("block is cut short")
    block = data[stop.end() : end]
    close = re.compile(rb"\r?\n\r?\n").match(data, end)
    if not close:
        raise Damage("no blank lines after the block")
    if not _sha1_matches(head.get("warc-block-digest"), block):
        raise Damage("block digest differs")
    http, _, payload = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    kind = head.get("warc-type", "")
    if kind != "revisit" and not _sha1_matches(head.get("warc-payload-digest"), payload):
        raise Damage("payload digest differs")
    size = len(payload)
    if kind == "revisit" and (n := re.search(rb"(?im)^content-length:\s*(\d+)", http)):
        size = int(n[1])
    said = head.get("warc-payload-digest", "")
    digest = hashlib.sha1(payload).hexdigest()
    if kind == "revisit" and said.lower().startswith("sha1:"):
        digest = said[5:].lower() if len(said) == 45 else base64.b32decode(said[5:].upper()).hex()
    return {"record_id": head.get("warc-record-id"), "record_type": kind, "url": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to"), "payload": payload if kind != "revisit" else None, "payload_bytes": size, "payload_digest": digest}, close.end()


def _inflate(data: bytes, at: int) -> tuple[bytes, int]:
    z = zlib.decompressobj(31)
    try:
        out = z.decompress(data[at:] if at + (1 << 16) >= len(data) else data[at : at + (1 << 16)])
        fed = at + (1 << 16)
        parts = [out]
        while not z.eof and fed < len(data):
            parts.append(z.decompress(data[fed : fed + (1 << 20)]))
            fed += 1 << 20
        if not z.eof:
            raise Damage("member is cut short")
        return b"".join(parts), min(fed, len(data)) - len(z.unused_data)
    except zlib.error as e:
        raise Damage(f"member: {str(e)[:60]}") from None


def _next(data: bytes, at: int) -> int:
    """Where the next member or version line may begin."""
    m = _VERSION.search(data, at)
    found = [x for x in (data.find(_GZIP, at), m.start() if m else -1) if x >= 0]
    return min(found, default=len(data))


def _inner(data: bytes) -> Iterator[dict[str, Any]]:
    """Records and gaps of a member whose checksum is right; a gap takes the member's place, its reason names the inflated bytes."""
    at, bad, reason = 0, -1, ""
    gap = lambda end: {"kind": "gap", "reason": f"inflated bytes {bad} to {end}: {reason}"}
    while at < len(data):
        try:
            record, end = parse_record(data, at)
        except Damage as e:
            if bad < 0:
                bad, reason = at, str(e)
            m = _VERSION.search(data, at + 1)
            at = m.start() if m else len(data)
            continue
        if bad >= 0:
            yield gap(at)
            bad = -1
        yield {"kind": "record"} | record
        at = end
    if bad >= 0:
        yield gap(len(data))


def salvage(data: bytes) -> Iterator[dict[str, Any]]:
    """Records (kind "record") and quarantined byte gaps (kind "gap": offset, length, reason) of one archive, in order."""
    at, bad, reason = 0, -1, ""
    while at < len(data):
        begin = at
        try:
            if data.startswith(_GZIP, at):
                inner, end = _inflate(data, at)
                found = list(_inner(inner))
                if inner and not any(r["kind"] == "record" for r in found):
                    raise Damage(f"member without a valid record: {found[0]['reason']}")
            else:
                record, end = parse_record(data, at)
                found = [{"kind": "record"} | record]
        except Damage as e:
            if bad < 0:
                bad, reason = at, str(e)
            at = _next(data, at + 1)
            continue
        at = end
        if bad >= 0:
            yield {"kind": "gap", "offset": bad, "length": begin - bad, "reason": reason}
            bad = -1
        yield from ({"offset": begin, "length": at - begin} | r for r in found)
    if bad >= 0:
        yield {"kind": "gap", "offset": bad, "length": len(data) - bad, "reason": reason}


_FIELDS = [("kind", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("reason", pa.string()), ("record_id", pa.string()), ("record_type", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
_SCHEMA = "kind string, file string, offset long, length long, reason string, record_id string, record_type string, url string, refers_to string, payload binary, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives under path (each file is read by one task, up to Spark's limit for binary files)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                rows: list[dict[str, Any]] = []
                held = 0
                for r in salvage(content.as_py() or b""):
                    held += len(r.get("payload") or b"") if payloads else 0
                    rows.append({**r, "file": name.as_py(), **({} if payloads else {"payload": None})})
                    if held > 8 << 20 or len(rows) > 20_000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(read, _SCHEMA)


def round_trip(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Writes the archives into the shared folder and reads them back: a row per record, without payloads."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path, least)
    rows = read_warc(pages.sparkSession, path, payloads=False).where("kind = 'record'")
    page = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    return rows.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("record_type") == "revisit", page(F.col("refers_to"))).alias("refers_to"))
