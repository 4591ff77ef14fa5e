"""Near copies by word shingles: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. A document's words are those of ``simhash``; a text of fewer than five words is one shingle. Documents of equal words are one node.
2. Nodes meet where a band of ``ROWS`` min-hashes agrees, in any of ``BANDS``: two nodes of similarity s meet nowhere with a chance of
   (1 - s ** ROWS) ** BANDS, which is 3 in a million at 0.8 and less above. Common lines alone bring no two documents together.
3. Nodes that met are compared by their sets, as 32-bit hashes of shingles: first all of a band's bucket with its hub, the node that meets
   most others: where copies were made of one text, that text. So a group of near copies costs a star and not its square.
4. Buckets that these links leave in several components are cut into blocks of ``BLOCK`` nodes, and each pair of blocks is a group of its
   own, of bounded size. In a group each node is held against all that are not connected to it yet, by one count over the group's shingles;
   it gives links that span its components, never its pairs.
5. Components as in ``simhash``.

Nulls: a null text has no words, like an empty one, and all of these are one node. Repeated rows stay repeated. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.llm.simhash import SEED, components
from corpuscle.llm.tables import keep, map_slices, small_batches

WIDTH = 5
LEAST = 0.8
BANDS, ROWS = 32, 5
_RANDOM = np.random.default_rng(SEED)
#: Odd factors and masks of the min-hashes; factors of the words of a shingle and of the min-hashes of a band.
FACTORS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
MASKS = _RANDOM.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
PLACES = _RANDOM.integers(0, 1 << 63, 64, np.uint64) << np.uint64(1) | np.uint64(1)
SHINGLES_AT_ONCE = 1 << 12
#: Nodes of a bucket in one block.
BLOCK = 256


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(words: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the shingles of ``words``."""
    if not words:
        return np.empty(0, np.uint32)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(w, SEED) for w in words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = _mixed(total * PLACES[0] + h[k : k + n])
    return np.unique((total >> np.uint64(32)).astype(np.uint32))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A key for each band of a set's min-hashes; none for the empty set, which is one node anyhow."""
    if not len(found):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), SHINGLES_AT_ONCE):
        part = found[at : at + SHINGLES_AT_ONCE]
        np.minimum(least, ((part[None, :] ^ MASKS[:, None]) * FACTORS[:, None]).min(1), out=least)
    rows, keys = least.reshape(BANDS, ROWS).astype(np.uint64), np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        keys = _mixed(keys * PLACES[1] + rows[:, k])
    return keys.view(np.int64)


def sets(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text_hash, node, shingles and bands for every row of ``docs``; the text hash is Spark's."""
    schema = T.StructType.fromDDL("doc_id long, text_hash long, node long, shingles binary, bands array<long>")

    def rows(part: pa.RecordBatch) -> dict:
        nodes, found = [], []
        for text in part.column(2).to_pylist():
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            nodes.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            found.append(shingles(words, width))
        node = pa.array(np.array(nodes, np.uint64).view(np.int64))
        return {"doc_id": part.column(0), "text_hash": part.column(1), "node": node, "shingles": [x.tobytes() for x in found], "bands": [band_keys(x) for x in found]}

    return map_slices(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), docs["text"].cast("string").alias("text")), schema, rows)


def similar(pairs: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets in ``nodes`` (node, shingles) are similar."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint32) for v in (x, y))
                fit = min(len(x), len(y)) >= least * max(len(x), len(y)) - 1e-9
                both = len(np.intersect1d(x, y, assume_unique=True)) if fit else 0
                good.append(fit and both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    of = lambda key: nodes.select(F.col("node").alias(key), F.col("shingles").alias(f"{key}_set"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(alike, "a long, b long")


def linked_in(nodes: np.ndarray, roots_: np.ndarray, sets_: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that span what is similar among ``nodes``, of which those of equal root are connected already."""
    sizes = np.array([len(x) for x in sets_])
    number = np.unique(np.concatenate(sets_), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    part, held, links = np.unique(roots_, return_inverse=True)[1], np.zeros(len(number), bool), []
    for i in range(len(nodes)):
        if (part == part[i]).all():
            continue
        own = number[starts[i] : starts[i] + sizes[i]]
        held[own] = True
        both = np.add.reduceat(held[number], starts, dtype=np.int64)
        held[own] = False
        near = np.flatnonzero((both >= least * (sizes + sizes[i] - both) - 1e-9) & (part != part[i]))
        for j in near.tolist():
            if part[j] != part[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                part[part == part[j]] = part[i]
    return links


def blocks_linked(apart: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """a, b: links within the buckets of ``apart`` (band, node, node_root), from groups of two blocks of a bucket."""
    sizes = apart.groupBy("band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(SEED)), "blocks").cast("int").alias("own")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = apart.join(sizes, "band").select("band", "node", "node_root", "blocks", own).select("band", "node", "node_root", "own", other)
    groups = placed.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "node_root").join(nodes, "node")
    rows = groups.select("band", "i", "j", "node", "node_root", "shingles").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def links() -> pa.RecordBatch:
            found = linked_in(np.array([h[0] for h in held]), np.array([h[1] for h in held]), [np.frombuffer(h[2], np.uint32) for h in held], least) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for part in small_batches(batch):
                for band, i, j, node, root, shingles_ in zip(*(part.column(k).to_pylist() for k in range(6)), strict=True):
                    if (band, i, j) != last:
                        yield links()
                        last, held = (band, i, j), []
                    held.append((node, root, shingles_))
        yield links()

    return rows.mapInArrow(run, "a long, b long")


def roots(found: DataFrame, least: float = LEAST) -> DataFrame:
    """node, root (its component's smallest node) for the nodes of ``found``, a table of ``sets``, that have a link."""
    met = found.select("node", F.explode("bands").alias("band")).distinct()
    sizes = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = keep(met.join(sizes, "band"), "met")
    degree = keep(met.groupBy("node").agg(F.sum("n").alias("degree")), "degree")  # a table, so that its size is known: sets of nodes that met no other aren't moved
    hubs = met.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("hub")).select("band", F.col("hub.node").alias("hub"))
    met = keep(met.select("band", "node").join(hubs, "band"), "hubs")
    nodes = keep(found.select("node", "shingles").join(degree.select("node"), "node", "left_semi").dropDuplicates(["node"]), "nodes")
    links = keep(similar(met.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), nodes, least), "links")
    first = keep(components(links), "roots")
    part = met.select("band", "node").join(first, "node", "left").select("band", "node", F.coalesce("root", "node").alias("node_root"))
    several = part.groupBy("band").agg(F.min("node_root").alias("low"), F.max("node_root").alias("high")).where("low <> high").select("band")
    apart = keep(part.join(several, "band", "left_semi"), "apart")
    more = keep(blocks_linked(apart, nodes, least), "links")
    return first if more.isEmpty() else components(links.unionByName(more))


def near_copies(docs: DataFrame, width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """doc_id, text_hash, root for every row of ``docs``: rows of one component have one root."""
    found = keep(sets(docs, width), "sets")
    linked = roots(found, least)
    return found.select("doc_id", "text_hash", "node").join(linked, "node", "left").select("doc_id", "text_hash", F.coalesce("root", "node").alias("root"))
