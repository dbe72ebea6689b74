"""WARC archives (operator 12): a writer, and a reader that splits compressed archives.

Writing: every page becomes a record in a gzip member of its own.  Of pages with equal
payloads of at least `least` bytes the one with the largest id is a response, the others are
revisits without a payload that refer to it; which ones they are is found on hashes before any
payload moves.  Every task writes files of its own under names of their own, and the rows
it returns (path, bytes, records) are the list of files: what a lost or repeated task
left behind is on no list and never read.

Reading: the files' byte ranges are dealt over tasks.  A task looks for the gzip magic from the
start of its range on, takes a place as a member if what it decompresses to is a WARC
record (version line, headers, a block of the length they give, a right checksum), and goes
on from its end; it owns the records that start inside its range and reads the last
of them beyond it.  A payload may hold an archive itself, whose members can stand
uncompressed inside a record; a range that begins there would take them for records.
So a first pass notes where each range's first record starts and its last ends; a range
that starts inside a record of an earlier range is scanned again from that record's end,
until none is left.

Nulls: a null payload is empty; a null id is the least, is written as an empty name, and
is null again when read; a null URL is left out.  Of equal payloads with the same largest id (repeated rows)
all are responses.  Control characters and spaces of a URL are written as %XX.  Bytes that are no
record (damaged members) are passed over up to the next one.  Payloads of any
length are handled whole, one at a time.  An empty table gives no archive and no records.  Only the columns
named are read, whatever others are called.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .storage import checkpointed, shared_folder, stored

LEAST = 1000
#: Bytes of a file, and of a range that one task reads.
FILE_BYTES = 1 << 30
RANGE_BYTES = 1 << 24
DATE = "2000-01-01T00:00:00Z"
_MAGIC = b"\x1f\x8b\x08"
_FILES = "path string, n_bytes bigint, n_records bigint"
RECORDS = "path string, offset bigint, end bigint, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, headers map<string,string>, http map<string,string>, payload binary"


def _store(path: str):
    """The file system of a path and its name there: local folders, and the stores that pyarrow reads (hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))


# -- writing ------------------------------------------------------------------


def with_revisits(pages: DataFrame, id_col: str, payload_col: str, least: int = LEAST) -> DataFrame:
    """`pages` with refers_to: the largest id among equal payloads of `least` bytes, where it is not the row's own."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    # payloads that are too short meet nothing, so they go by their ids
    key = F.when(F.octet_length(payload) >= least, F.sha2(payload, 256)).otherwise(F.concat(F.lit("-"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    keyed = pages.withColumn("_payload", key)
    groups = keyed.filter(~F.startswith("_payload", F.lit("-"))).groupBy("_payload").agg(F.max(id_col).alias("_latest"), F.count("*").alias("_n"))
    groups = stored(groups.filter("_n > 1").drop("_n"))  # written, so that the join may split a payload that very many pages have
    latest = F.when(F.col(id_col).eqNullSafe(F.col("_latest")), None).otherwise(F.col("_latest"))
    return keyed.join(groups, "_payload", "left").withColumn("refers_to", latest).drop("_payload", "_latest")


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A gzip member with one record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _name(page_id: object) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object, date: str = DATE) -> bytes:
    """The response or revisit record of a page."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page_id)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return record(headers, http + (payload if refers_to is None else b""))


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of `pages` in a folder (by default a new one in the shared folder): (path, n_bytes, n_records) of each file, once all are written."""
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    rows = with_revisits(pages.select(id_col, url_col, payload_col), id_col, payload_col, least).select(id_col, url_col, payload_col, "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = _store(folder)
        out, path, size, n = None, None, 0, 0
        fs.create_dir(place, recursive=True)

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "n_bytes", "n_records"])

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, path, size, n = fs.open_output_stream(f"{place}/{name}", compression=None), f"{folder}/{name}", 0, 0
                member = page_record(page_id.as_py(), url.as_py(), (payload.as_py() or "").encode(), refers_to.as_py())
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return stored(rows.mapInArrow(run, _FILES))


# -- reading ------------------------------------------------------------------


class Member:
    """One decompressed record: its place in the file, its headers, and its block if kept."""

    __slots__ = ("offset", "end", "headers", "block")

    def __init__(self, offset: int, end: int, headers: dict[str, str], block: bytes):
        self.offset, self.end, self.headers, self.block = offset, end, headers, block


def _headers(raw: bytes) -> dict[str, str]:
    """Fields of a header by lower-case name; the first line under the empty name."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    return {"": first} | {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines) if v or k}


class Archive:
    """Members of one file, found from any place on."""

    def __init__(self, path: str, n_bytes: int, chunk: int = 1 << 20):
        fs, place = _store(path)
        self.file, self.n_bytes, self.chunk = fs.open_input_file(place), n_bytes, chunk
        self.base, self.held = 0, b""

    def _bytes(self, at: int, n: int) -> bytes:
        """Up to n bytes from a place on; chunks are read ahead and held one at a time."""
        if not self.base <= at < at + n <= self.base + len(self.held):
            self.file.seek(at)
            self.base, self.held = at, self.file.read(max(n, self.chunk))
        return self.held[at - self.base : at - self.base + n]

    def candidate(self, at: int, end: int) -> int | None:
        """The first gzip magic that starts in [at, end)."""
        while at < end:
            part = self._bytes(at, min(1 << 16, self.n_bytes - at))
            found = part.find(_MAGIC)
            if found >= 0:
                return at + found if at + found < end else None
            at += max(1, len(part) - len(_MAGIC) + 1)
        return None

    def member(self, at: int, keep: bool) -> Member | None:
        """The record whose member starts at a place, if it is one from end to end."""
        inflate, parts, size, head, fed, step = zlib.decompressobj(31), [], 0, None, at, 512
        try:
            while not inflate.eof and fed < self.n_bytes:
                piece = self._bytes(fed, min(step, self.n_bytes - fed))
                fed, step = fed + len(piece), 1 << 16
                data = inflate.decompress(piece)
                size += len(data)
                if head is None or keep:
                    parts.append(data)
                if head is None:
                    start = b"".join(parts)
                    if not start[:7].startswith(b"WARC/1."[: len(start)]):
                        return None
                    cut = start.find(b"\r\n\r\n")
                    if cut >= 0:
                        head, parts = _headers(start[:cut]), [start[cut + 4 :]] if keep else []
                        expected = cut + 4 + int(head["content-length"]) + 4
        except (zlib.error, KeyError, ValueError):
            return None
        if not inflate.eof or head is None or size != expected:
            return None
        return Member(at, fed - len(inflate.unused_data), head, b"".join(parts)[:-4] if keep else b"")

    def members(self, start: int, end: int, keep: bool = True) -> Iterator[Member]:
        """The records that start in [start, end), one after another; what is no record is passed over."""
        at = start
        while at < end and (at := self.candidate(at, end)) is not None:
            if (found := self.member(at, keep)) is None:
                at += 1
                continue
            yield found
            at = found.end


def ranges(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, n_bytes, start, stop, first, last): ranges of all files, where their first record starts and their last one ends.

    `first` and `last` are null where no record starts in a range.
    """
    at = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))).alias("start")
    parts = files.select("path", "n_bytes", at).withColumn("stop", F.least("n_bytes", F.col("start") + range_bytes))
    known = checkpointed(_spread(parts.withColumn("begin", F.col("start"))).mapInArrow(_bounds, "path string, n_bytes bigint, start bigint, stop bigint, first bigint, last bigint"))
    while True:
        earlier = F.max("last").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1))  # a file's ranges, 64 a gigabyte
        seen = known.withColumn("_from", earlier)
        wrong = checkpointed(seen.filter(F.col("first") < F.col("_from")))
        if wrong.isEmpty():
            return known
        again = _spread(wrong.select("path", "n_bytes", "start", "stop", F.col("_from").alias("begin"))).mapInArrow(_bounds, known.schema)
        known = checkpointed(known.join(wrong.select("path", "start"), ["path", "start"], "left_anti").unionByName(again))


def _spread(parts: DataFrame) -> DataFrame:
    """One range a task, up to a number of tasks that a scheduler bears."""
    return parts.repartition(min(max(1, parts.count()), 100_000), "path", "start")


def _bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            first = last = None
            for m in Archive(r["path"], r["n_bytes"]).members(max(r["start"], r["begin"]), r["stop"], keep=False):
                first, last = m.offset if first is None else first, m.end
            r["first"], r["last"] = first, last
            del r["begin"]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), *((c, pa.int64()) for c in ("n_bytes", "start", "stop", "first", "last"))]))


def _hex(digest: str | None) -> str | None:
    """A labelled SHA-1 digest in lower-case hex."""
    kind, _, value = (digest or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def _row(path: str, m: Member) -> tuple:
    head, http, payload = m.headers, {}, m.block
    if head.get("content-type", "").startswith("application/http") and (cut := payload.find(b"\r\n\r\n")) >= 0:
        http, payload = _headers(payload[:cut]), payload[cut + 4 :]
    name = lambda k: head[k].strip("<>") if k in head else None
    return path, m.offset, m.end, head.get("warc-type"), name("warc-record-id"), head.get("warc-target-uri"), name("warc-refers-to"), _hex(head.get("warc-payload-digest")), list(head.items()), list(http.items()), payload


def read(files: DataFrame, range_bytes: int = RANGE_BYTES, batch_bytes: int = 1 << 22) -> DataFrame:
    """Every record of the files (path, n_bytes): see RECORDS. Header names are in lower case, the first line under ''."""
    pairs = pa.map_(pa.string(), pa.string())
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("end", pa.int64()), *((c, pa.string()) for c in ("record_type", "record_id", "target_uri", "refers_to", "payload_digest")), ("headers", pairs), ("http", pairs), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for m in Archive(r["path"], r["n_bytes"]).members(r["first"], r["stop"]):
                    rows.append(_row(r["path"], m))
                    size += len(m.block) + 500
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return _spread(ranges(files.sparkSession, files, range_bytes).filter("first is not null")).mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of `pages`, written as archives and read back.

    A response is measured by its payload as read, a revisit by what its headers say of the payload it stands for.
    """
    kind = pages.schema["page_id"].dataType
    page = lambda c: F.nullif(F.regexp_extract(c, "^urn:page:(.*)$", 1), F.lit("")).cast(kind)
    answered = F.col("record_type") == "response"
    return read(write(pages), range_bytes).select(
        page("record_id").alias("page_id"),
        F.when(answered, F.octet_length("payload")).otherwise(F.try_element_at("http", F.lit("content-length")).cast("long")).cast("long").alias("payload_bytes"),
        F.when(answered, F.sha1("payload")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
