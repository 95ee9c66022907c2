"""WARC archives: a writer with revisit records, and a reader that salvages damaged files.

The writer makes one gzip member per record (or plain records), in files of bounded size. A task
names its files anew on every attempt, and only the names that reach the committed manifest are
read, so a lost executor leaves nothing wrong behind. The reader walks a file record by record,
holding one record at a time. Where a check fails (gzip checksum, version line, lengths, payload
digest) it looks for the next place at which a whole valid record starts, goes on from there, and
reports the bytes between as quarantined.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from emberlog.llm.common import stored, text_of
from emberlog.session import scratch_dir

#: Payloads from this size on are stored once; equal ones later become revisits.
REVISIT_BYTES = 100
#: A file is closed once it has so many bytes.
FILE_BYTES = 256 << 20
#: Bytes read at a time.
BLOCK = 1 << 16
#: Longest header block of a record.
HEADER_BYTES = 1 << 16
GZIP_LEVEL = 4

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE = "urn:x-page:"
#: Fields that every record has.
MANDATORY = ("warc-type", "warc-record-id", "warc-date")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
MANIFEST = "file string, records bigint, bytes bigint"
FOUND = pa.schema([
    ("file", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("problem", pa.string()), ("record_type", pa.string()),
    ("page_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
FOUND_SQL = ("file string, start bigint, stop bigint, problem string, record_type string, page_id bigint, url string, "
             "refers_to bigint, payload_digest string, payload binary")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder, and the folder's path in it."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    if urlsplit(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlsplit(uri).path
    return pafs.FileSystem.from_uri(uri)


# Writing

def with_types(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, refers_to``: of equal payloads of at least REVISIT_BYTES bytes the
    smallest ``page_id`` is stored, and the others refer to it. Null html is empty; a page without
    an id is never referred to, and is stored itself if no equal page has one."""
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", text_of("html").alias("html"))
    own = own.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = own.where(F.octet_length("html") >= REVISIT_BYTES)
    shared = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return own.join(shared, "digest", "left").select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = f"{PAGE}{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{digest} {url}')}"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>",
             "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
             "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=_PLAIN)}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{PAGE}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_PLAIN = "".join(chr(c) for c in range(33, 127))


def write_archives(pages: DataFrame, folder: str, compress: bool = True, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row of ``pages(page_id, url, html)`` into the shared ``folder``; returns the
    manifest ``file, records, bytes`` of the files that hold them. An empty table writes no file."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = filesystem(folder)
        files.create_dir(root, recursive=True)
        out, name, records, size = None, "", 0, 0

        def closed():
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64()), pa.array([size], pa.int64())],
                                              ["file", "records", "bytes"])
        for batch in batches:
            for page_id, url, html, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                raw = record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), refers_to.as_py())
                if compress:
                    packer = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                    raw = packer.compress(raw) + packer.flush()
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc{'.gz' if compress else ''}", 0, 0
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                out.write(raw)
                records, size = records + 1, size + len(raw)
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()
    return stored(with_types(pages).mapInArrow(run, MANIFEST), "warc-manifest")


# Reading

class Damaged(Exception):
    """No valid record starts here."""


def parse(raw: bytes) -> dict:
    """The fields of one whole record; Damaged if a check fails."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not re.match(rb"WARC/1\.[01]\r\n", head):
        raise Damaged("version line")
    fields = _fields(head)
    if not fields.get("content-length", "").isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise Damaged("length")
    if missing := [name for name in MANDATORY if not fields.get(name)]:
        raise Damaged(f"no {missing[0]}")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "")
    payload = rest[:-4].partition(b"\r\n\r\n")[2] if kind == "response" else None
    if payload is not None and digest != f"sha256:{hashlib.sha256(payload).hexdigest()}":
        raise Damaged("payload digest")
    return {"record_type": kind, "page_id": _page(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
            "refers_to": _page(fields.get("warc-refers-to")), "payload_digest": digest.removeprefix("sha256:"), "payload": payload}


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _page(name: str | None) -> int | None:
    found = re.fullmatch(rf"<{PAGE}(-?\d+)>", name or "")
    return int(found[1]) if found else None


def _record_at(f, at: int, size: int) -> tuple[dict, int]:
    """The record that starts at a place of the file, and where it ends."""
    start = f.read_at(BLOCK, at)
    if start.startswith(b"\x1f\x8b\x08"):
        unpack, pieces, place = zlib.decompressobj(31), [], at
        block = start
        while block:
            try:
                pieces.append(unpack.decompress(block))
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            place += len(block)
            if unpack.eof:
                return parse(b"".join(pieces)), place - len(unpack.unused_data)
            if not pieces[0].startswith(b"WARC/"[:len(pieces[0])]):
                raise Damaged("version line")
            block = f.read_at(BLOCK, place) if place < size else b""
        raise Damaged("cut off")
    head = start.find(b"\r\n\r\n", 0, HEADER_BYTES)
    if head < 0 or not start.startswith(b"WARC/1."):
        raise Damaged("version line")
    length = _fields(start[:head]).get("content-length", "")
    stop = at + head + 8 + int(length) if length.isdigit() else size + 1
    if stop > size or f.read_at(4, stop - 4) != b"\r\n\r\n":
        raise Damaged("length")
    return parse(f.read_at(stop - at, at)), stop


def _next_start(f, at: int, size: int) -> int:
    """The next place that looks like the start of a record, or the end of the file."""
    while at < size:
        block = f.read_at(BLOCK, at)
        if found := START.search(block):
            return at + found.start()
        if at + len(block) >= size:
            break
        at += len(block) - 8
    return size


def salvage(f) -> Iterator[tuple[int, int, str | None, dict]]:
    """(start, stop, problem, record) over a whole file: a record without problem, or a quarantined gap."""
    size, at = f.size(), 0
    while at < size:
        try:
            found, stop = _record_at(f, at, size)
            yield at, stop, None, found
            at = stop
            continue
        except Damaged as e:
            problem = str(e)
        start, after = at, None
        while after is None:
            at = _next_start(f, at + 1, size)
            if at >= size:
                break
            try:
                found, after = _record_at(f, at, size)
            except Damaged:
                continue
        yield start, at, problem, {}
        if after is not None:
            yield at, after, None, found
            at = after


def read_archives(files: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """Every record and every quarantined gap of the ``files(file)`` in ``folder``.

    Records have a null ``problem``; gaps have one, and only ``file, start, stop`` besides. A file is
    read by one task from front to back. Without ``payload`` its bytes are checked but not returned."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{root}/{name}") as f:
                    rows, held = [], 0
                    for start, stop, problem, found in salvage(f):
                        rows.append({"file": name, "start": start, "stop": stop, "problem": problem} | found)
                        held += len(found.get("payload") or b"")
                        if not payload and found:
                            rows[-1]["payload"] = None
                        if len(rows) >= 5000 or payload and held > 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, FOUND)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, FOUND)
    n = max(1, files.count())
    return files.select("file").repartition(n).mapInArrow(run, FOUND_SQL)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of a page each, as read back
    from archives written to the shared folder. Revisits take their payload's size from the record
    they refer to. The order of rows, extra columns and repeated rows do not matter."""
    folder = scratch_dir(spark, "warc")
    files = write_archives(pages, folder)
    sized = read_archives(files, folder).where("problem is null").select(
        "page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"))
    records = stored(sized, "warc-records")
    sizes = records.where("record_type = 'response' and page_id is not null").groupBy(
        F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("stored_bytes"))
    own = records.where("record_type = 'response'").withColumn("stored_bytes", F.lit(None).cast("bigint"))
    other = records.where("record_type <> 'response'").join(sizes, ["refers_to", "payload_digest"], "left")
    return own.unionByName(other).select("page_id", F.coalesce("payload_bytes", "stored_bytes").alias("payload_bytes"), "payload_digest",
                                         "record_type", "refers_to")
