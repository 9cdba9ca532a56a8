"""WARC archives as a Python data source, and writing and reading back a crawl's pages.

``spark.read.format("warc").load(dir)`` plans one partition for each file or for several small ones,
and reads a record's header block first. Predicates on its columns (record_type, page_id, target_uri,
payload_digest, refers_to) are pushed to the scan; a record that fails them, and every payload if the
option ``payload`` is false, is skipped: without being inflated where the member's length is known, and
without being gathered in other files, plain or of any division into gzip members.

``df.write.format("warc").save(dir)`` writes one gzip member per record, with the member's length in
the gzip header so that readers can step over it, and starts a new file after ``roll_bytes``. Only
files that committed tasks name in ``_manifest.json`` count, so retried tasks leave no double records.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import shared_dir, written

SCHEMA = "record_type string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
NAMES = ["record_type", "page_id", "target_uri", "payload_digest", "payload_bytes", "refers_to", "payload"]
KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
ROLL_BYTES, PARTITION_BYTES, BATCH_BYTES = 128 << 20, 64 << 20, 8 << 20
#: Payloads from this size on are stored once; records with an equal one revisit it.
REVISIT_FROM = 100
#: Columns of the WARC header block; payload_bytes stands in the HTTP header behind it.
PUSHED = ("record_type", "page_id", "target_uri", "payload_digest", "refers_to")
#: Digests that several pages share are sent to every executor up to this number (about 100 MB in memory).
MOST_DIGESTS_SENT = 1_000_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:page:"
_GZIP = struct.Struct("<4sIBBHBBHQ")  # magic and flags, time, extra flags, system, extra length, two id bytes, length of the field, member length


def _member(record: bytes) -> bytes:
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush() + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    return _GZIP.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, ord("S"), ord("L"), 8, len(body)) + body


def _record(kind: str, page: int | None, uri: str | None, digest: str, size: int, refers: int | None, payload: bytes) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_ID}{'' if page is None else page}>"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_ID}{refers}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


@dataclass
class Files(InputPartition):
    paths: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict) -> None:
        self.uri, self.roll = options["path"], int(options.get("roll_bytes", ROLL_BYTES))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(path, recursive=True)
        files, out, name, size = [], None, "", 0
        for batch in iterator:
            columns = [batch.column(c) for c in NAMES]
            for i in range(batch.num_rows):
                if out is None:
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                kind, page, uri, digest, n, refers, payload = (c[i].as_py() for c in columns)
                size += out.write(_member(_record(kind, page, uri, digest, n, refers, payload or b"")))
                if size >= self.roll:
                    out.close()
                    files.append((name, size))
                    out = None
        if out is not None:
            out.close()
            files.append((name, size))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/_manifest.json") as out:
            out.write(json.dumps([f for m in messages if m for f in m.files]).encode())


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.uri, self.payload = options["path"], options.get("payload", "true").lower() == "true"
        self.split = int(options.get("partition_bytes", PARTITION_BYTES))
        self.equal: list[tuple[str, frozenset]] = []
        self.prefix: list[tuple[str, str]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull)) else None
            if column not in PUSHED or isinstance(f, IsNotNull):
                yield f
            elif isinstance(f, EqualTo):
                self.equal.append((column, frozenset([f.value])))
            elif isinstance(f, In):
                self.equal.append((column, frozenset(f.value)))
            else:
                self.prefix.append((column, f.value))

    def partitions(self) -> list[Files]:
        fs, path = pafs.FileSystem.from_uri(self.uri)
        if fs.get_file_info(f"{path}/_manifest.json").type == pafs.FileType.File:
            with fs.open_input_stream(f"{path}/_manifest.json") as f:
                files = json.loads(f.read())
        else:
            files = [(x.base_name, x.size) for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith((".warc", ".warc.gz"))]
        groups, size = [], self.split
        for name, n in sorted(files):
            if size + n > self.split:
                groups.append([])
                size = 0
            groups[-1].append(f"{path}/{name}")
            size += n
        return [Files(g) for g in groups] or [Files([])]

    def _wanted(self, head: dict) -> bool:
        return all(head[c] in values for c, values in self.equal) and all((head[c] or "").startswith(p) for c, p in self.prefix)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.uri)
        rows, size = [], 0
        for path in partition.paths:
            with fs.open_input_file(path) as raw:
                for head, payload in records(io.BufferedReader(raw, 1 << 20), self._wanted, self.payload):
                    rows.append((*(head[c] for c in NAMES[:-1]), payload))
                    size += len(payload or b"") + 100
                    if size >= BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(KINDS)], NAMES)


def _number(value: str) -> int | None:
    value = value.strip()
    return int(value) if value.isascii() and value.isdigit() else None


def _header(block: bytes) -> dict:
    """The columns of a header block, and the length of what follows it (None if that can't be read)."""
    h = {}
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        key, _, value = line.partition(":")
        h[key.strip().lower()] = value.strip()

    def page(key: str) -> int | None:
        value = h.get(key, "").strip("<>").removeprefix(_ID)
        return int(value) if value.lstrip("-").isdigit() else None

    digest = h.get("warc-payload-digest")
    return {
        "record_type": h.get("warc-type"), "page_id": page("warc-record-id"), "target_uri": h.get("warc-target-uri"),
        "payload_digest": digest and digest.partition(":")[2], "payload_bytes": None, "refers_to": page("warc-refers-to"),
        "length": _number(h.get("content-length", "0")),
    }


#: What parts header and body; some writers leave out the carriage returns.
_GAP = re.compile(rb"\r?\n\r?\n")


def _finish(head: dict, block: bytes, payload: bool) -> tuple[dict, bytes | None]:
    """Takes the HTTP header off the block; its Content-Length is the full payload's size, also for a revisit."""
    gap = _GAP.search(block)
    http, body = (block[: gap.start()], block[gap.end() :]) if gap else (block, b"")
    for line in http.splitlines():
        if line.lower().startswith(b"content-length:"):
            head["payload_bytes"] = _number(line.partition(b":")[2].decode("latin-1"))
    return head, body if payload and head["record_type"] == "response" else None


class _Inflated(io.RawIOBase):
    """The content of the gzip members that follow in f, one after another; never more than a piece of it is held."""

    def __init__(self, f: io.BufferedReader) -> None:
        self.f, self.z, self.raw = f, zlib.decompressobj(31), b""

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while True:
            self.raw = self.raw or self.f.read1(1 << 16)
            ended = not self.raw
            if self.z.eof:
                if ended:
                    return 0
                self.raw = self.raw.lstrip(b"\0")  # some writers pad members
                if not self.raw:
                    continue
                if not self.raw.startswith(b"\x1f"):
                    return 0  # what follows the last member is none
                self.z = zlib.decompressobj(31)
            try:
                out = self.z.decompress(self.raw, len(buffer))
            except zlib.error:
                return 0  # what follows a broken place can't be read
            self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if out:
                buffer[: len(out)] = out
                return len(out)
            if ended and not self.z.eof:
                return 0  # cut off


def _known_length(f: io.BufferedReader) -> int | None:
    """Length of the rest of a member that gives it in its header, which is read; else nothing is read."""
    fixed = f.peek(_GZIP.size)[: _GZIP.size]
    if len(fixed) == _GZIP.size and fixed[:4] == b"\x1f\x8b\x08\x04" and _GZIP.unpack(fixed)[4:8] == (12, ord("S"), ord("L"), 8):
        f.read(_GZIP.size)
        return _GZIP.unpack(fixed)[-1]
    return None


def records(f: io.BufferedReader, wanted=lambda head: True, payload: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """Records of one archive, plain or gzip, whose header columns are wanted.

    Archives are read as far as they go: a record whose length can't be read is skipped up to the next line that
    begins a record, a member that can't be inflated is skipped, and bytes that belong to no record are passed over.
    A malformed HTTP length leaves payload_bytes null. Header and body may be parted by bare line feeds.
    """
    while start := f.peek(2)[:2]:
        if start != b"\x1f\x8b":
            yield from _walk(f, wanted, payload)
        elif (left := _known_length(f)) is None:
            yield from _walk(io.BufferedReader(_Inflated(f), 1 << 16), wanted, payload)
        else:
            left -= 8  # checksum and size
            inflate, text, found = zlib.decompressobj(-15), b"", None
            try:
                while left > 0 and b"\r\n\r\n" not in text:
                    part = f.read(min(left, 1024))
                    left -= len(part) or left
                    text += inflate.decompress(part)
                block, _, rest = text.partition(b"\r\n\r\n")
                head = _header(block)
                if head["length"] is not None and wanted(head):
                    if payload or not _GAP.search(rest):
                        rest += inflate.decompress(f.read(max(left, 0))) + inflate.flush()
                        left = 0
                    found = _finish(head, rest[: head["length"]], payload)
            except zlib.error:
                found = None
            if found:
                yield found
            f.seek(max(left, 0) + 8, io.SEEK_CUR)


def _walk(f: io.BufferedReader, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records of a stream of plain text up to its end."""
    while line := f.readline(1 << 16):
        if not line.startswith(b"WARC/"):
            continue  # blank lines between records, or what belongs to none
        lines = [line.rstrip(b"\r\n")]
        while (line := f.readline()) not in (b"", b"\r\n", b"\n"):
            lines.append(line.rstrip(b"\r\n"))
        head = _header(b"\r\n".join(lines))
        left, block = head["length"] or 0, []
        if head["length"] is not None and wanted(head):
            while left and (payload or not block or block[-1] not in (b"\r\n", b"\n")):  # without payloads, up to the end of the HTTP header
                block.append(f.read(left) if payload else f.readline(min(left, 1 << 16)))
                left -= len(block[-1])
                if not block[-1]:
                    break
            yield _finish(head, b"".join(block), payload)
        while left and (skipped := f.read(min(left, 1 << 16))):
            left -= len(skipped)


class WarcSource(DataSource):
    """Options: path (a folder's URI), payload, partition_bytes, roll_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets Spark push predicates to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def page_records(pages: DataFrame) -> DataFrame:
    """A WARC record for every row of pages (page_id, url, html), in the columns of SCHEMA.

    Of records with equal payloads of at least 100 bytes, that with the smallest page_id is a response
    and the others revisit it; rows that repeat this page_id and payload are responses all. A null
    html is an empty payload. A null page_id revisits if any equal payload has a page_id, and else is
    a response. Smaller payloads are always responses.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("target_uri"), F.sha2(html, 256).alias("payload_digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"), html.cast("binary").alias("payload"),
    )
    first, _ = written(
        rows.select("page_id", "payload_digest", "payload_bytes").where(F.col("payload_bytes") >= REVISIT_FROM)
        .groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "digests",
    )
    if first.limit(MOST_DIGESTS_SENT + 1).count() <= MOST_DIGESTS_SENT:
        first = F.broadcast(first)  # so that payloads stay where they are
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(first, "payload_digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri", "payload_digest", "payload_bytes",
        F.when(again, F.col("first")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages as WARC archives to the shared folder and reads them back: a row for each page with
    page_id, payload_bytes, payload_digest, record_type, refers_to. Size and digest of a response are
    those of the payload as read; a revisit's come from its headers."""
    spark = pages.sparkSession
    register(spark)
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    page_records(pages).write.format("warc").mode("append").save(path)
    read = spark.read.format("warc").load(path)
    return read.select(
        "page_id", F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )
