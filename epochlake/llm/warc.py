"""WARC archives: a writer of records and a splittable reader of gzipped ones.

Writer. Each page becomes one record in a gzip member of its own. Of pages with
equal payloads of at least `min_bytes`, the one with the largest page_id is a
response and the others are revisits without payload that refer to it. Archives go
through Spark's text sink, whose commit protocol leaves no half-written files when
a task is repeated; the sink puts a separator after each row, and the last byte of
a gzip member of less than 16 MB is always zero, so the separator is that byte.

Reader. The files' lengths give byte ranges. A task scans its range for the gzip
magic, tries to inflate what starts there and keeps it if a WARC header comes out:
the magic also occurs inside compressed data, and there the try fails. It owns the
records that start in its range and reads on beyond the range to end the last one.
Files are opened with pyarrow's file systems, through the URI that Spark lists.

Nulls and edge cases: a null html is an empty payload; a null url is left out of
the header; a null page_id is written as none, is never referred to, and its page
is a response unless an equal payload has a page_id; rows that repeat the largest
page_id of a payload are all responses; an empty table makes archives without
records; payloads of any length are written and read whole, by a task that holds one of them
in both forms; other columns are ignored, whatever their names. A record whose member is cut off or damaged, or whose payload
hasn't the digest that its header names, is a row with `error`, and what its header says as far as it can be read; the records after it are read on.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, looked_up, scratch

MAGIC = b"\x1f\x8b\x08"
CHUNK = 1 << 20
RECORD = "page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, error string"


def member(record: bytes) -> bytes:
    """A gzip member, without time or name; a second, empty one follows where the last byte isn't zero."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1]:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += z.flush()
    return out


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    identity = lambda p: uuid.uuid5(uuid.NAMESPACE_URL, f"page:{p}:{digest}").urn
    revisit = refers_to is not None
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{identity(page_id)}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Refers-To", f"<{identity(refers_to)}>" if revisit else None),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Writes a record for each row of pages (page_id, url, html) into archives under path."""
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    held = held.withColumn("key", F.sha2("payload", 256))
    # only keys that occur twice have anything to refer to; payloads of other rows aren't shuffled
    firsts = cut(held.filter(F.octet_length("payload") >= min_bytes).groupBy("key").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 AND first IS NOT NULL"))
    total = pages.count()
    found = looked_up(held, firsts, "key", "n", total).withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")))

    def run(batches):
        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([member(record(*r))[:-1] for r in rows], pa.binary())], names=["bytes"])

    members = found.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "bytes binary")
    # rows of text are written byte for byte, so binary may be passed as a string
    members.select(F.col("bytes").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


class Broken(bytes):
    """What could be inflated of a record's member that is cut off or damaged."""


def parse(raw: bytes) -> tuple | None:
    """A RECORD row of an inflated member, or None where it is no response or revisit."""
    error = "a member that is cut off or damaged" if isinstance(raw, Broken) else None
    raw = bytes(raw)
    if not raw.startswith(b"WARC/"):
        return None
    header, _, rest = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in header.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    kind = fields.get("warc-type")
    number = lambda k: int(fields[k]) if fields.get(k, "").removeprefix("-").isdigit() else None
    if error and kind in ("response", "revisit", None):
        return number("x-page-id"), kind, number("x-refers-to-page-id"), fields.get("warc-target-uri"), None, None, None, error
    if kind not in ("response", "revisit"):
        return None
    block = rest[: int(fields.get("content-length", len(rest)))]
    http, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    if kind == "response":
        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
        said = fields.get("warc-payload-digest", "")
        if said.startswith("sha1:") and said[5:].upper() != digest:
            error = f"record {fields.get('warc-record-id')}: its payload doesn't have the digest {said}"
    else:
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:").upper() or None
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
        size, body = int(m[1]) if m else None, None
    return number("x-page-id"), kind, number("x-refers-to-page-id"), fields.get("warc-target-uri"), size, digest, body, error


class Window:
    """Bytes of a file from a position on, read in chunks and given back from the front."""

    def __init__(self, file, start: int):
        self.file, self.start, self.data = file, start, bytearray()
        file.seek(start)

    def to(self, position: int) -> bool:
        """Has the bytes up to position been read? False at the end of the file."""
        while self.start + len(self.data) < position:
            more = self.file.read(CHUNK)
            if not more:
                return False
            self.data += more
        return True

    def drop(self, position: int) -> None:
        if position - self.start > CHUNK:
            del self.data[: position - self.start]
            self.start = position


def inflated_head(chunk: bytes, step: int = 64) -> bytes:
    """What the bytes of a damaged member give before the damage."""
    z, out = zlib.decompressobj(31), b""
    for i in range(0, len(chunk), step):
        try:
            out += z.decompress(chunk[i : i + step])
        except zlib.error:
            break
        if len(out) >= 5 and not out.startswith(b"WARC/"):
            break
    return out


def inflate(window: Window, at: int) -> tuple[bytes, int] | None:
    """What the member at a position holds and where it ends; None if no WARC record or padding starts there.

    Broken, and the next position, if a record starts there and its member then ends early or can't be inflated.
    """
    z, out, size, position = zlib.decompressobj(31), [], 0, at
    while not z.eof:
        if not window.to(position + 1):
            return (Broken(b"".join(out)), at + 1) if out else None  # the file ends first
        front = position - window.start
        chunk = window.data[front : front + CHUNK]
        try:
            got = z.decompress(chunk)
        except zlib.error:
            # the chunk as far as it can be inflated: a magic that is none fails at once
            head = b"".join(out) or inflated_head(chunk)
            return (Broken(head), at + 1) if head.startswith(b"WARC/") else None
        position += len(chunk)
        if got:
            if not size and not b"WARC/".startswith(got[:5]) and not got.startswith(b"WARC/"):
                return None  # a header decoded, but not of a record
            out.append(got)
            size += len(got)
    return b"".join(out), position - len(z.unused_data)


def records_in(file, start: int, end: int):
    """Inflated records whose member starts in [start, end)."""
    window, at = Window(file, start), start
    while at < end:
        window.drop(at)
        window.to(min(end, at + CHUNK) + len(MAGIC) - 1)
        found = window.data.find(MAGIC, at - window.start)
        if found < 0 or window.start + found >= end:
            at = max(at + 1, window.start + len(window.data) - len(MAGIC) + 1)
            if not window.to(at + len(MAGIC)):
                return
            if found >= 0:
                return
            continue
        at = window.start + found
        member_ = inflate(window, at)
        if member_ is None:
            at += 1
            continue
        if member_[0]:
            yield member_[0]
        at = member_[1]


def read(spark: SparkSession, path: str, range_bytes: int = 32 << 20) -> DataFrame:
    """RECORD rows of all responses and revisits in the archives under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.filter("length > 0").select("path", starts.alias("start")).withColumn("end", F.col("start") + range_bytes)
    schema = spark.createDataFrame([], RECORD).schema

    def run(batches):
        from pyarrow import fs

        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        give = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=schema.names)
        for b in batches:
            for uri, start, end in zip(*(c.to_pylist() for c in b.columns), strict=True):
                # Spark lists local files as file:/x
                system, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))
                rows, size = [], 0
                with system.open_input_file(name) as f:
                    for raw in records_in(f, start, end):
                        row = parse(raw)
                        if row:
                            rows.append(row)
                            size += len(raw)
                        if size > 8 << 20:
                            yield give(rows)
                            rows, size = [], 0
                if rows:
                    yield give(rows)

    parts = max(1, spark.sparkContext.defaultParallelism)
    return ranges.repartition(parts, "path", "start").mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of archives written from pages and read back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write(pages, path, min_bytes)
    back = read(spark, path)
    # archives that were just written have no damage
    sound = F.when(F.col("error").isNotNull(), F.raise_error("error").cast("long")).otherwise(F.col("page_id"))
    return back.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")
