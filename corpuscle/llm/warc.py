"""WARC archives as a PySpark data source, and pages written to and read back from them.

``spark.read.format("warc")`` and ``df.write.format("warc")`` work on a folder of archives in any file system that pyarrow knows by its
address. Written records are gzip members of their own, whose extra field "sl" holds their packed and unpacked lengths.

Writing: each task writes a file of its own name; the driver's commit lists them in a manifest of its own, so files of lost or repeated
tasks are never read, and what is appended stands beside what was there. Overwriting replaces the manifests. Reading: the files of all
manifests, or in a folder without one all ``*.warc.gz`` and ``*.warc`` below it, or one such file. Files of members with lengths are planned
into byte ranges of ``split_bytes``; a range's first record is found by the fixed bytes that such a member starts with, so no index is
needed. Other archives (plain gzip members, one gzip stream, or uncompressed) are a partition a file and are streamed. Predicates on the
record type and on header columns are pushed to the reader. It unpacks a record only as far as its headers, tests them, and skips the rest,
by the length in the extra field where there is one; with option ``payload`` false no payload is kept at all. Payloads that are unpacked
are held against their digest if it is one of SHA-256 in hex, or of SHA-1 in base 32.

A payload is what follows the head of an HTTP message, else the whole block; its bytes are those its head's Content-Length states, else
those there are. payload_digest is without "sha256:"; other algorithms keep their names.

Nulls: a null html is an empty payload, a null url no target. Record ids are made of page ids; a null page_id has none. Of repeated rows
with the smallest page_id of equal payloads each is a response. An empty table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

from corpuscle.llm.tables import load, shared_path

SCHEMA = "record_id string, warc_type string, target_uri string, warc_date string, payload_digest string, refers_to string, content_length long, payload_bytes long, payload binary"
ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
HEADERS = {"record_id": "warc-record-id", "warc_type": "warc-type", "target_uri": "warc-target-uri", "warc_date": "warc-date", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
#: Fixed values of the formats: the profile of revisits, the start of a member with an "sl" extra field of 8 bytes.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MEMBER = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x0c\0sl\x08\0"
MANIFEST = "_committed"
#: Names of the writer's own files.
OWN = re.compile(r"part-[0-9a-f]{32}\.warc\.gz")
LEVEL = 1
AHEAD = 1 << 20
BATCH_BYTES = 8 << 20


class BadWarc(ValueError):
    """An archive that breaks its format, or a payload that differs from its digest."""


def member(data: bytes) -> bytes:
    """``data`` as a gzip member whose extra field tells its packed and unpacked lengths."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    packed = packer.compress(data) + packer.flush()
    total = len(MEMBER) + 8 + len(packed) + 8
    return MEMBER + struct.pack("<II", total, len(data)) + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str | None, warc_type: str, uri: str | None, date: str | None, digest: str, refers_to: str | None, payload: bytes, payload_bytes: int) -> bytes:
    """One record: an HTTP message of a page, or for a revisit its head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = head if warc_type == "revisit" else head + payload
    fields = {
        "WARC-Type": warc_type,
        "WARC-Record-ID": record_id and f"<{record_id}>",
        "WARC-Target-URI": uri,
        "WARC-Date": date,
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Refers-To": refers_to and f"<{refers_to}>",
        "WARC-Profile": PROFILE if warc_type == "revisit" else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def headers(raw: bytes) -> dict[str, str]:
    """Fields of a record's head by lower-case name; angle brackets and the digest's algorithm go."""
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise BadWarc(f"a record starts with {first[:40]!r}")
    out = {}
    for line in lines:
        name, _, value = line.partition(":")
        value = value.strip()
        out[name.strip().lower()] = value[1:-1] if value[:1] == "<" and value[-1:] == ">" else value.removeprefix("sha256:")
    if not {"warc-type", "content-length"} <= out.keys():
        raise BadWarc("a record without type or length")
    return out


class _Ahead:
    """Reads of a file at any place, through a buffer."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not (self.at <= at and at + n <= self.at + len(self.data)):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(n, AHEAD))
        return self.data[at - self.at : at - self.at + n]


@dataclass
class WarcRange(InputPartition):
    """Bytes of a file whose members tell their lengths; ``end`` -1: a whole file of any other kind."""

    path: str
    start: int
    end: int


@dataclass
class WarcFile(WriterCommitMessage):
    name: str | None
    size: int = 0


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", 32 << 20))
        self.payload = options.get("payload", "true").lower() == "true"
        self.tests: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keep the tests that headers can answer; give back the rest."""
        for f in filters:
            name = HEADERS.get(f.attribute[0]) if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            kind = next((k for k, c in (("is", EqualTo), ("in", In), ("starts", StringStartsWith), ("some", IsNotNull), ("none", IsNull)) if isinstance(f, c)), None)
            if name and kind:
                self.tests.append((kind, name, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        own: list[tuple[str, int]] = []
        if fs.get_file_info(root).type == pafs.FileType.File:
            found = [(root, fs.get_file_info(root).size)]
        else:
            inside = [i for i in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if i.type == pafs.FileType.File]
            manifests = [i.path for i in inside if i.base_name.startswith(MANIFEST)]
            found = [(i.path, i.size) for i in inside if i.base_name.lower().endswith((".warc.gz", ".warc"))]
            if manifests:  # of the writer's own files those that were committed; beside them other archives
                found = [(path, size) for path, size in found if not OWN.fullmatch(path.rpartition("/")[2])]
                for path in manifests:
                    with fs.open_input_stream(path) as file:
                        own += [(f"{root}/{f['name']}", f["size"]) for f in json.loads(file.read())]
        ranges = [WarcRange(path, a, min(a + self.split, size)) for path, size in sorted(own) for a in range(0, size, self.split)]
        for path, size in sorted(found):
            known = False
            if size > self.split:  # smaller ones are a partition each, of whatever kind
                with fs.open_input_file(path) as file:
                    known = file.read(len(MEMBER)) == MEMBER
            ranges += [WarcRange(path, a, min(a + self.split, size)) for a in range(0, size, self.split)] if known else [WarcRange(path, 0, -1)]
        return ranges or [WarcRange("", 0, 0)]

    def wanted(self, fields: dict[str, str]) -> bool:
        for kind, name, value in self.tests:
            have = fields.get(name)
            if kind == "none":
                ok = have is None
            else:
                ok = have is not None and (kind == "some" or (have == value if kind == "is" else have in value if kind == "in" else have.startswith(value)))
            if not ok:
                return False
        return True

    def read(self, partition: WarcRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.path) as file:
            for row in self.streamed(file) if partition.end < 0 else self.records(_Ahead(file), partition, file.size()):
                rows.append(row)
                held += 200 + len(row[-1] or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ARROW, strict=True)], schema=ARROW)

    def records(self, file: _Ahead, part: WarcRange, size: int) -> Iterator[tuple]:
        """Rows of the records that start in ``part``."""
        at = part.start
        while at < part.end:  # the first start of a member
            window = file.read(at, min(AHEAD, size - at))
            found = window.find(MEMBER)
            if found >= 0:
                at += found
                break
            at += max(len(window) - len(MEMBER) + 1, 1)
        while at < part.end:
            start = file.read(at, len(MEMBER) + 8)
            if start[:-8] != MEMBER:
                raise BadWarc(f"no record at {at}")
            total, unpacked = struct.unpack("<II", start[-8:])
            body, end = at + len(start), at + total - 8
            unpack, head = zlib.decompressobj(-15), b""
            packed = file.read(body, min(2048, end - body))
            while b"\r\n\r\n" not in head:  # headers first
                more = unpack.decompress(packed, 1024)
                if not more and unpack.eof:
                    raise BadWarc(f"no end of headers at {at}")
                head += more
                packed = unpack.unconsumed_tail
                if not packed and b"\r\n\r\n" not in head:
                    body += min(2048, end - body)
                    packed = file.read(body, min(2048, end - body))
            raw, _, _ = head.partition(b"\r\n\r\n")
            fields = headers(raw)
            if self.wanted(fields):
                length, block = int(fields["content-length"]), None
                if self.payload or fields["warc-type"] == "revisit":  # a revisit's block is a head of some bytes
                    whole = file.read(at, total)
                    data = zlib.decompress(whole[len(MEMBER) + 8 : -8], -15, unpacked)
                    if len(data) != unpacked or zlib.crc32(data) != struct.unpack("<I", whole[-8:-4])[0]:
                        raise BadWarc("a record differs from its checksum")
                    block = data[len(raw) + 4 : len(raw) + 4 + length]
                yield self.row(fields, length, block)
            at += total

    def streamed(self, file) -> Iterator[tuple]:
        """Rows of a file of plain gzip members, of one gzip stream, or uncompressed; blocks of records not wanted are passed over."""
        stream = _Stream(file)
        while raw := stream.head():
            fields = headers(raw)
            length = int(fields["content-length"])
            if not self.wanted(fields):
                stream.skip(length)
            elif self.payload or fields["warc-type"] == "revisit":
                yield self.row(fields, length, stream.take(length))
            else:
                stream.skip(length)
                yield self.row(fields, length, None)

    def row(self, fields: dict[str, str], length: int, block: bytes | None) -> tuple:
        """The row of a record, of whose ``block`` nothing is known if it is None."""
        payload, n, kind = None, None, fields["warc-type"]
        if block is not None:
            http, gap, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
            told = next((x.partition(b":")[2].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")), b"")
            n, sent = int(told) if told.isdigit() else len(payload), payload
            if kind == "revisit":
                payload = None
            else:
                payload = decoded(http, payload)
                n = n if payload == sent else len(payload)
                bare = unchunked(sent) if coded(http, b"transfer-encoding") else sent
                if kind in ("response", "resource") and not any(matches(fields.get("warc-payload-digest"), x) for x in (bare, sent)):
                    raise BadWarc("a payload differs from its digest")
        return (*(fields.get(h) for h in HEADERS.values()), length, n, payload if self.payload else None)


def coded(http: bytes, name: bytes) -> list[bytes]:
    """The codings that a header of an HTTP head names, in the order they were applied."""
    found = [x.partition(b":")[2] for x in http.lower().split(b"\r\n")[1:] if x.startswith(name + b":")]
    return [c for f in found for c in f.replace(b" ", b"").split(b",") if c not in (b"", b"identity")]


def unchunked(body: bytes) -> bytes:
    """A chunked body's bytes; one that isn't in chunks stays as it is."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        size = body[at:end].partition(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9a-fA-F]+", size):
            return body
        n = int(size, 16)
        if not n:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n


def decoded(http: bytes, body: bytes) -> bytes:
    """A body without the codings that its head names; from one that isn't known here, or fails, on it stays as it is."""
    if coded(http, b"transfer-encoding")[-1:] == [b"chunked"]:
        body = unchunked(body)
    for coding in reversed(coded(http, b"content-encoding")):
        try:
            if coding in (b"gzip", b"x-gzip"):
                body = zlib.decompress(body, 31)
            elif coding == b"deflate":
                body = zlib.decompress(body, 15 if body[:1] == b"\x78" else -15)
            else:
                return body
        except zlib.error:
            return body
    return body


def matches(digest: str | None, payload: bytes) -> bool:
    """Whether a payload has this digest; one of an algorithm that isn't known here says nothing."""
    algorithm, _, value = (digest or "").rpartition(":")
    if algorithm.lower() == "sha1":
        return base64.b32encode(hashlib.sha1(payload).digest()).decode() == value.upper()
    return algorithm != "" or len(value) != 64 or hashlib.sha256(payload).hexdigest() == value.lower()


class _Stream:
    """The bytes of an archive in order, unpacked if they are packed, a piece at a time."""

    def __init__(self, file):
        self.file, self.held = file, b""
        self.source = file.read(AHEAD)
        self.unpack = zlib.decompressobj(31) if self.source.startswith(b"\x1f\x8b") else None

    def _more(self) -> bool:
        """Get more bytes; false at the end."""
        if self.unpack is None:
            self.held, self.source = self.held + self.source, b""
            if not self.held:
                return False
            self.source = self.file.read(AHEAD)
            return bool(self.source)
        while True:
            self.source = self.source or self.file.read(AHEAD)
            if not self.source:
                return False
            if self.unpack.eof:
                self.unpack = zlib.decompressobj(31)
            got = self.unpack.decompress(self.source, AHEAD)
            self.source = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
            if got:
                self.held += got
                return True

    def take(self, n: int) -> bytes:
        while len(self.held) < n and (self._more() or len(self.held) >= n):
            pass
        if len(self.held) < n:
            raise BadWarc("an archive ends within a record")
        found, self.held = self.held[:n], self.held[n:]
        return found

    def skip(self, n: int) -> None:
        while n:
            if not self.held and not self._more() and not self.held:
                raise BadWarc("an archive ends within a record")
            part = min(n, len(self.held))
            self.held, n = self.held[part:], n - part

    def head(self) -> bytes:
        """The head of the next record; empty at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            at = self.held.find(b"\r\n\r\n")
            if self.held and at >= 0:
                raw, self.held = self.held[:at], self.held[at + 4 :]
                return raw
            before = len(self.held)
            if not self._more() and len(self.held) == before:
                if self.held:
                    raise BadWarc("an archive ends within a head")
                return b""


class WarcWriter(DataSourceArrowWriter):
    """Columns: record_id, warc_type, target_uri, warc_date, payload_digest, refers_to, payload_bytes, payload."""

    def __init__(self, options: dict[str, str], overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WarcFile:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        name, size, file = f"part-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in iterator:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("record_id", "warc_type", "target_uri", "warc_date", "payload_digest", "refers_to", "payload", "payload_bytes")]
            for i in range(batch.num_rows):
                values = [c[i].as_py() for c in columns]
                data = member(record(*values[:6], values[6] or b"", values[7]))
                file = file or fs.open_output_stream(f"{root}/{name}", compression=None)
                file.write(data)
                size += len(data)
        if file:
            file.close()
        return WarcFile(name if file else None, size)

    def commit(self, messages: list[WarcFile | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        before = [i.path for i in fs.get_file_info(pafs.FileSelector(root)) if i.base_name.startswith(MANIFEST)] if self.overwrite else []
        with fs.open_output_stream(f"{root}/{MANIFEST}-{uuid.uuid4().hex}.json") as file:
            file.write(json.dumps([{"name": m.name, "size": m.size} for m in messages if m and m.name]).encode())
        for path in before:
            fs.delete_file(path)

    def abort(self, messages: list[WarcFile | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for m in messages:
            if m and m.name:
                fs.delete_file(f"{root}/{m.name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"


def page_records(pages: DataFrame) -> DataFrame:
    """Records of ``pages`` (page_id, url, html): the first of equal payloads a response, the others revisits of it."""
    payload = F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary")
    hashed = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"payload_digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload").cast("long")}
    )
    long = hashed.where(F.col("payload_bytes") >= LEAST_REVISIT)
    firsts = long.groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first_id")
    revisit = F.coalesce(F.col("first_id") != F.col("page_id"), F.col("first_id").isNotNull())
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return hashed.join(firsts, "payload_digest", "left").select(
        urn(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        F.col("url").alias("target_uri"),
        F.lit(DATE).alias("warc_date"),
        "payload_digest",
        F.when(revisit, urn(F.col("first_id"))).alias("refers_to"),
        "payload_bytes",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = shared_path(spark, "warc")
    page_records(load(spark, sf_dir, "pages")).write.format("warc").mode("append").save(path)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    read = lambda kind, payload: spark.read.format("warc").option("payload", payload).load(path).where(F.col("warc_type") == kind)
    responses = read("response", "true").select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), F.col("warc_type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = read("revisit", "false").select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), number("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)


OP6_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, strlen(coalesce(html, '')) as n, sha256(coalesce(html, '')) as d from pages
), f as (select d, min(page_id) as first_id from p where n >= 100 group by d)
select p.page_id, p.n as payload_bytes, p.d as payload_digest,
       case when f.first_id <> p.page_id then 'revisit' else 'response' end as record_type,
       case when f.first_id <> p.page_id then f.first_id end as refers_to
from p left join f on p.d = f.d and p.n >= 100
"""
