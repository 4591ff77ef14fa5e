"""SimHash near-duplicates: pivot distance tables, verified, then connected components.

A document's fingerprint is the bitwise majority of the XXH64 values of its word triples. Two fingerprints link when
they differ in at most ``MAX_BITS`` bits. Linking works on distinct fingerprints only, so exact copies cost one row:

1. Every fingerprint gets a *pivot row*: its Hamming distances to ``PIVOTS`` fixed reference fingerprints.
2. Fingerprints meet in buckets. 64 bits are cut into ``BLOCKS`` blocks; with at most 3 differing bits two of five blocks
   agree whole, so a bucket for each pair of blocks misses no link (an exact way, without caps). Buckets are dealt out by
   key and streamed in sorted order.
3. In a bucket, Hamming distance being a metric, ``|d(x, p) - d(y, p)| <= d(x, y)`` for every pivot p: pairs whose largest
   coordinate difference exceeds ``MAX_BITS`` are discarded, the survivors verified by XOR and popcount.
4. A bucket emits a spanning forest of its links, never all pairs; components follow by alternating large and small stars
   over distributed edge tables.

Nulls: a null text has no words, like an empty one; fingerprint zero, linked like any other. A null doc_id keeps its row;
it never names a component unless all ids of the component are null. Repeated rows stay repeated. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.tables import keep, load, map_slices, map_texts

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Bit ranges of the blocks: five, of which any two fingerprints within three bits share two.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
BLOCK_PAIRS = tuple(combinations(BLOCKS, 2))
#: Reference fingerprints: XXH64 of their number, so that every task has the same ones.
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i), SEED) for i in range(16)], np.uint64)
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of a text's word triples; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only \x20\x09-\x0D split
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(SHINGLE, len(words))
    left, right = starts[: len(words) - width + 1], ends[width - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(left), HASHES_AT_ONCE):
        span = zip(left[at : at + HASHES_AT_ONCE].tolist(), right[at : at + HASHES_AT_ONCE].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in span], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(left), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) for every row of ``docs``."""

    def rows(ids: list, texts: list) -> dict[str, list]:
        return {"doc_id": ids, "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, "doc_id long, fp long", rows)


def pivot_rows(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to each pivot, as bytes."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.uint8)


def _bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct fingerprint into the bucket of each pair of blocks, with its pivot row."""
    for batch in batches:
        fps = batch.column(0).to_numpy().view(np.uint64)
        pivots = pivot_rows(fps)
        table = pa.array([x.tobytes() for x in pivots], pa.binary())
        for n, pair in enumerate(BLOCK_PAIRS):
            key = np.full(len(fps), n, np.uint64)
            for a, b in pair:
                key = (key << np.uint64(b - a)) | ((fps >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), table], names=["bucket", "fp", "pivots"])


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = int(p[i])
        return i

    def flat(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up


def forest_of_buckets(buckets: np.ndarray, fps: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked within each bucket. ``buckets`` is sorted; ``pivots`` has a row a fingerprint."""
    forest, left, right, pivots = _Forest(len(fps)), [], [], pivots.astype(np.int8)
    ends = np.searchsorted(buckets, buckets, side="right")
    at, step = np.arange(len(fps)), 0
    while True:
        step += 1
        at = at[at + step < ends[at]]  # rows with a partner `step` places on, in the same bucket
        if not len(at):
            return np.array(left, np.uint64), np.array(right, np.uint64)
        near = at
        for k in range(0, pivots.shape[1], 4):  # coordinates a few at a time: most pairs go early
            near = near[np.abs(pivots[near, k : k + 4] - pivots[near + step, k : k + 4]).max(1) <= MAX_BITS]
        near = near[np.bitwise_count(fps[near] ^ fps[near + step]) <= MAX_BITS]
        near = near[forest.parent[near] != forest.parent[near + step]]
        for i in near.tolist():
            a, b = forest.root(i), forest.root(i + step)
            if a != b:
                forest.parent[max(a, b)] = min(a, b)
                left.append(fps[i])
                right.append(fps[i + step])
        if len(near):
            forest.flat()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forests of the buckets of a partition sorted by bucket; the last bucket of a batch waits for the next one."""
    held: list[np.ndarray] | None = None

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        a, b = forest_of_buckets(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        pivots = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, len(PIVOTS))
        rows = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), pivots]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        cut = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0
        yield links([x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield links(held)


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that span every component of the distinct fingerprints in column fp."""
    distinct = fps.select("fp").where("fp is not null").distinct()
    dealt = distinct.mapInArrow(_bucketed, "bucket long, fp long, pivots binary").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_linked, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root (its component's smallest node) for every node of ``edges`` (a, b).

    Alternating stars: the large star hangs larger neighbours on the smallest one, the small star smaller neighbours and the
    node itself. Edge counts never grow, rounds are logarithmic in a component's diameter, and each round is kept as a table.
    """
    edges = keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(low, "a")
        small = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        new = keep(small.where("a <> b").distinct(), "edges")
        sizes = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first() for x in (edges, new)]
        if sizes[0] == sizes[1]:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        edges = new


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``: the smallest doc_id that a chain of links reaches."""
    fps = keep(fingerprints(docs), "fingerprints")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(fps))
    grouped = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = grouped.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (Spark's), root: the component of every row of ``docs``, by fingerprints as in ``near_duplicates``."""
    schema = T.StructType.fromDDL("doc_id long, text_hash long, fp long")

    def rows(part: pa.RecordBatch) -> dict:
        return {"doc_id": part.column(0), "text_hash": part.column(1), "fp": np.array([fingerprint(t) for t in part.column(2).to_pylist()], np.uint64).view(np.int64)}

    fps = keep(map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), schema, rows), "fingerprints")
    roots = components(links(fps)).withColumnRenamed("node", "fp")
    return fps.join(roots, "fp", "left").select("doc_id", "text_hash", F.coalesce("root", "fp").alias("root"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
