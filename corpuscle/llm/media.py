"""Media columns: payloads as PNG in binary columns, read back through their chunks, and cosine-transform hashes of them.

Writing: bytes become 8-bit grey samples of a near-square image; rows are filtered (none, sub or up, by the least sum of absolute
differences), deflated with zlib and framed as IHDR, IDAT and IEND chunks with checksums. Reading walks the chunks, tests every
checksum, inflates with a size bound taken from the header, and undoes the filters with numpy: all five types, whole runs of rows
at once for none, sub and up. The feature is the sign pattern of the low-frequency coefficients of a 2-D cosine transform.

Nulls: a null text is an empty payload, which is one square of padding. Equal payloads give equal bytes and hashes everywhere. Very
long texts give taller images; an image lives in one task, one at a time. Repeated rows stay repeated; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm.tables import load, map_texts, small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Payloads are multiples of UNIT bytes: of squares of SIDE x SIDE samples.
UNIT, SIDE = 576, 24
PAD = 255
#: Side of the grey image that is transformed, and of the block of low frequencies kept.
GRID, LOW = 24, 8
NONE, SUB, UP, AVERAGE, PAETH = range(5)


class BadPng(ValueError):
    """A PNG that breaks its format: signature, checksum, order, size or filter."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def _cost(rows: np.ndarray) -> np.ndarray:
    """Sum of absolute values of each row, as signed bytes."""
    return np.abs(rows.view(np.int8).astype(np.int16)).sum(1, dtype=np.int64)


def width_for(payload_bytes: int) -> int:
    """Width of the squarest image of whole SIDE x SIDE squares."""
    units = payload_bytes // UNIT
    return SIDE * next(k for k in range(math.isqrt(units), 0, -1) if units % k == 0)


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """``payload``, a positive multiple of ``UNIT`` bytes, as an 8-bit grey PNG."""
    width = width_for(len(payload))
    raw = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = raw.copy(), raw.copy()
    sub[:, 1:] -= raw[:, :-1]
    up[1:] -= raw[:-1]
    tried = np.stack([raw, sub, up])
    best = np.argmin([_cost(x) for x in tried], axis=0)
    out = np.empty((len(raw), width + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = tried[best, np.arange(len(raw))]
    header = struct.pack(">IIBBBBB", width, len(raw), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(out.tobytes(), level)) + _chunk(b"IEND", b"")


def chunks(png: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, data) of every chunk; raises ``BadPng`` at a wrong signature, length or checksum, or a missing end."""
    if png[:8] != SIGNATURE:
        raise BadPng("signature")
    at = 8
    while at + 12 <= len(png):
        n, kind = struct.unpack_from(">I4s", png, at)
        data = png[at + 8 : at + 8 + n]
        if len(data) < n or at + 12 + n > len(png):
            raise BadPng("length")
        if zlib.crc32(data, zlib.crc32(kind)) != struct.unpack_from(">I", png, at + 8 + n)[0]:
            raise BadPng(f"checksum of {kind!r}")
        yield kind, data
        if kind == b"IEND":
            return
        at += 12 + n
    raise BadPng("no end")


def unfilter(lines: np.ndarray) -> np.ndarray:
    """Samples of filtered ``lines`` (first column: filter type), at one byte a pixel."""
    kinds, out = lines[:, 0], lines[:, 1:].copy()
    if kinds.size and kinds.max() > PAETH:
        raise BadPng("filter")
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for a, b in zip([0, *edges], [*edges, len(kinds)], strict=True):  # runs of rows of one type
        kind = kinds[a] if b > a else NONE
        if kind == SUB:
            np.cumsum(out[a:b], axis=1, dtype=np.uint8, out=out[a:b])
        elif kind == UP:
            first = max(a - 1, 0)
            out[first:b] = np.cumsum(out[first:b], axis=0, dtype=np.uint8)
        elif kind in (AVERAGE, PAETH):
            for y in range(a, b):
                above, left, corner = (out[y - 1].tolist() if y else [0] * out.shape[1]), 0, 0
                row = out[y].tolist()
                for x, over in enumerate(above):
                    if kind == AVERAGE:
                        guess = (left + over) >> 1
                    else:
                        p = left + over - corner
                        _, _, guess = min((abs(p - left), 0, left), (abs(p - over), 1, over), (abs(p - corner), 2, corner))
                    left, corner = (row[x] + guess) & 255, over
                    row[x] = left
                out[y] = row
    return out


def decode_png(png: bytes) -> np.ndarray:
    """Grey samples (height x width) of an 8-bit grey PNG without interlacing."""
    size, packed = None, []
    for kind, data in chunks(png):
        if kind == b"IHDR":
            width, height, *form = struct.unpack(">IIBBBBB", data)
            if form != [8, 0, 0, 0, 0]:
                raise BadPng(f"form {form}")
            size = height, width
        elif kind == b"IDAT":
            packed.append(data)
    if size is None:
        raise BadPng("no header")
    want = size[0] * (size[1] + 1)
    inflate = zlib.decompressobj()
    lines = inflate.decompress(b"".join(packed), want + 1)
    if len(lines) != want or not inflate.eof:
        raise BadPng("size")
    return unfilter(np.frombuffer(lines, np.uint8).reshape(size[0], size[1] + 1))


_K = np.arange(GRID)
_BASIS = np.cos(np.pi * (2 * _K[None, :] + 1) * np.arange(LOW + 1)[:, None] / (2 * GRID))


def _shrunk(image: np.ndarray, axis: int) -> np.ndarray:
    """``image`` brought to GRID cells along ``axis``: means of its slices, or repeats where it is shorter."""
    n = image.shape[axis]
    at = np.arange(GRID) * n // GRID
    if n < GRID:
        return np.take(image, at, axis=axis)
    return np.add.reduceat(image, at, axis=axis) / np.diff([*at, n]).reshape((-1, 1) if axis == 0 else (1, -1))


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies, without the constant ones, lie above their median."""
    small = _shrunk(_shrunk(image.astype(np.float64), 0), 1)
    low = np.round((_BASIS @ small @ _BASIS.T)[1:, 1:].ravel(), 6)
    return np.packbits(low > np.median(low)).tobytes()


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and those bytes padded to a positive multiple of UNIT."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data + bytes([PAD]) * ((-len(data)) % UNIT if data else UNIT)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary PNG) for every row of ``docs``."""

    def rows(ids: list, texts: list) -> dict[str, list]:
        made = [payload_of(t) for t in texts]
        return {"doc_id": ids, "n_bytes": [n for n, _ in made], "media": [encode_png(p) for _, p in made]}

    return map_texts(docs, "doc_id long, n_bytes long, media binary", rows)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, hash binary"


def media_features(media: DataFrame) -> DataFrame:
    """Read the binary column ``media`` back and compute digests and hashes; ``hash`` is binary, ``feature`` its hex."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(FEATURES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_batches(batch):
                made: list[list] = [[] for _ in schema]
                for doc_id, n, png in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    image = decode_png(png)
                    payload, code = image.tobytes(), cosine_hash(image)
                    values = doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(png), hashlib.sha256(png).hexdigest(), code.hex(), code
                    for column, value in zip(made, values, strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(made, schema, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, FEATURES)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(to_media(load(spark, sf_dir, "documents"))).drop("hash")
