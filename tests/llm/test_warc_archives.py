"""WARC folders that grow, and archives that other programs wrote."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import warc


def pages(spark, ids):
    return spark.createDataFrame([(i, f"http://x.org/{i}", f"page {i} " * 40) for i in ids], "page_id long, url string, html string")


def write(spark, ids, path, mode):
    warc.page_records(pages(spark, ids)).write.format("warc").mode(mode).save(path)


def ids(spark, path):
    found = spark.read.format("warc").load(path).where(F.col("warc_type") == "response")
    return sorted(int(r["record_id"][9:]) for r in found.collect())


def test_appends_add_and_overwriting_replaces(spark, tmp_path):
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    write(spark, [1, 2], path, "append")
    write(spark, [3], path, "append")
    assert ids(spark, path) == [1, 2, 3]
    write(spark, [4, 5], path, "overwrite")
    assert ids(spark, path) == [4, 5]


def standard(payload: bytes, kind: str, n: int, digest: str = "") -> bytes:
    block = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + payload if kind == "response" else payload
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Target-URI: http://x.org/{n}\r\nContent-Length: {len(block)}\r\n"
    if digest == "sha1":
        head += f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}\r\n"
    if digest == "wrong":
        head += "WARC-Payload-Digest: sha1:" + "A" * 32 + "\r\n"
    return head.encode() + b"\r\n" + block + b"\r\n\r\n"


RECORDS = [(b"software: y\r\n", "warcinfo", 0, ""), (b"<p>one</p>" * 300, "response", 1, "sha1"), (b"GET / HTTP/1.1\r\n\r\n", "request", 2, ""), (b"\r\n\r\n two \xff" * 90_000, "response", 3, "sha1"), (b"", "response", 4, "")]


@pytest.mark.parametrize("form", ["members", "stream", "plain"])
def test_archives_of_other_programs(spark, tmp_path, form):
    warc.register(spark)
    raw = [standard(*r) for r in RECORDS]
    data = {"members": b"".join(map(gzip.compress, raw)), "stream": gzip.compress(b"".join(raw)), "plain": b"".join(raw)}[form]
    file = tmp_path / f"deep/a.warc{'' if form == 'plain' else '.gz'}"
    file.parent.mkdir()
    file.write_bytes(data)
    (tmp_path / "deep/notes.txt").write_text("no archive")
    for path in (tmp_path, file):
        got = spark.read.format("warc").load(f"file://{path}").orderBy("record_id").collect()
        assert [(r["record_id"], r["warc_type"]) for r in got] == [(f"urn:uuid:{n}", kind) for _, kind, n, _ in RECORDS]
        assert [bytes(r["payload"]) for r in got] == [p for p, *_ in RECORDS]
        assert [r["payload_bytes"] for r in got] == [len(p) for p, *_ in RECORDS]
    one = spark.read.format("warc").option("payload", "false").load(f"file://{tmp_path}").where(F.col("target_uri") == "http://x.org/3").collect()
    assert [(r["warc_type"], r["payload"]) for r in one] == [("response", None)]


def test_broken_archives_are_errors(spark, tmp_path):
    warc.register(spark)
    for name, data in (("cut", standard(b"x" * 50, "response", 1)[:-30]), ("wrong", standard(b"x" * 50, "response", 1, "wrong")), ("none", b"no archive at all\r\n\r\n")):
        (tmp_path / f"{name}.warc").write_bytes(data)
        with pytest.raises(Exception, match="BadWarc"):
            spark.read.format("warc").load(f"file://{tmp_path}/{name}.warc").collect()


def test_other_archives_beside_manifests(spark, tmp_path):
    """Read as well; a file of the writer's own that was not committed is not."""
    warc.register(spark)
    path = f"file://{tmp_path}/w"
    write(spark, [1, 2], path, "append")
    (tmp_path / "w/other.warc.gz").write_bytes(gzip.compress(standard(b"<p>one</p>", "response", 9)))
    (tmp_path / f"w/part-{'0' * 32}.warc.gz").write_bytes(b"half of a file that no manifest names")
    found = spark.read.format("warc").load(path).where(F.col("warc_type") == "response").collect()
    assert sorted(r["record_id"] for r in found) == sorted([*(f"urn:page:{i}" for i in (1, 2)), "urn:uuid:9"])


def test_coded_bodies(spark, tmp_path):
    """Chunks and content codings go; digests are those of the body as it was sent, or without its chunks."""
    warc.register(spark)
    page = b"<p>some page</p>" * 20
    chunks = lambda b: b"".join(f"{len(b[i : i + 50]):x};x=y\r\n".encode() + b[i : i + 50] + b"\r\n" for i in range(0, len(b), 50)) + b"0\r\n\r\n"
    cases = [("Transfer-Encoding: chunked", chunks(page), page), ("Transfer-Encoding: chunked\r\nContent-Encoding: gzip", chunks(gzip.compress(page)), gzip.compress(page)), ("Content-Encoding: gzip", gzip.compress(page), gzip.compress(page))]
    cases += [("Content-Encoding: odd", b"as it is", b"as it is"), ("Content-Encoding: gzip", b"no gzip", b"no gzip"), ("Transfer-Encoding: chunked", b"no chunks", b"no chunks")]
    raw = b""
    for n, (head, sent, told) in enumerate(cases):
        block = f"HTTP/1.1 200 OK\r\n{head}\r\n\r\n".encode() + sent
        digest = base64.b32encode(hashlib.sha1(told).digest()).decode()
        raw += f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{n}>\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(raw)
    got = spark.read.format("warc").load(f"file://{tmp_path}/a.warc").orderBy("record_id").collect()
    assert [bytes(r["payload"]) for r in got] == [page, page, page, b"as it is", b"no gzip", b"no chunks"]
    assert [r["payload_bytes"] for r in got][:3] == [len(page)] * 3
