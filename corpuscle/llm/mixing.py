"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sizes: words of each document, kept as a small table (doc_id, source, hash of the text, size).
2. Targets: the sources, by code point with null last, weigh 5, 2, 1 in turn and share SHARE of all words; a target stops at MOST
   times its source's size, and what is over goes to the others by weight, until none is above.
3. A source's documents are dealt into shards by a seeded hash, about SHARD_WORDS words each, so no source is one group. A shard's
   documents, ordered by a seeded hash, are one run of words cut into blocks of BLOCK words, the last of which may be short.
4. Blocks go to the sources by highest quotients target / (2 seats + 1), then a source's seats the same way to regions of REGION shards
   and theirs to shards, by words: integer quotas for every shard. What short blocks and rounding to blocks leave is settled in words, so
   that every source gets its target, rounded to a word.
5. A shard takes all of its words as often as its quota holds them, then blocks by lowest seeded hash once more, of the last one as many
   words as are left. No quota exceeds MOST times its shard's words, so no document gives more than MOST times its size.

Only sources and their totals, one row each, reach the driver; over MOST_SOURCES (some 10 MB) are an error. Quotas are made in groups of
REGION rows at most, up to REGION * REGION * SHARD_WORDS = 8.8e12 words a source; selections in one shard each. Reruns agree: every order is
by hash of SEED, doc_id and text.

Nulls: a null text has no words; a null source is a source of its own, after all others; a null doc_id is hashed like a value, with its
text. Repeated rows are documents of their own, all of a row in one shard. Sources without words have target 0. An empty table gives none.
Documents without words take 0. Extra columns are carried along.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.tables import keep, load

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2
BLOCK = 64
SHARD_WORDS = 1 << 19
REGION = 4096
MOST_SOURCES = 100_000
SEED = 20


class TooManySources(ValueError):
    """More sources than may reach the driver."""


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Targets of sources of these ``sizes``, in order: ``share`` of all by weight, each capped, the excess reshared."""
    caps = [float(most * s) for s in sizes]
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), [i for i, c in enumerate(caps) if c > 0], share * sum(sizes)
    while open_:
        unit = left / sum(weight[i] for i in open_)
        over = [i for i in open_ if unit * weight[i] > caps[i]]
        for i in over or open_:
            out[i] = caps[i] if over else unit * weight[i]
            left -= out[i]
        open_ = [i for i in open_ if i not in set(over)] if over else []
    return out


def apportion(votes: list[float], seats: int, most: list[int]) -> list[int]:
    """Sainte-Lague: ``seats`` to the highest quotients votes / (2 n + 1), none above ``most``; ties to the first.

    The first guess gives every party its share rounded down; the heap settles what is left, seat by seat.
    """
    total = sum(votes)
    if not total:
        return [0] * len(votes)
    # Webster's divisor: a party has n seats when its quotient lies in [n - 1/2, n + 1/2); a slightly large one never gives too many.
    divisor = total / max(seats - len(votes) / 2, 1) if seats > len(votes) else float("inf")
    while True:
        won = [min(int(v / divisor + 0.5), m) if divisor != float("inf") else 0 for v, m in zip(votes, most, strict=True)]
        if sum(won) <= seats:
            break
        divisor *= 1.0 + max(1e-12, (sum(won) - seats) / max(seats, 1))
    heap = [(-v / (2 * n + 1), i) for i, (v, n, m) in enumerate(zip(votes, won, most, strict=True)) if v > 0 and n < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(won)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        won[i] += 1
        if won[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    return won


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, text_hash, size of every row."""
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64("text").alias("text_hash"), words.alias("size"))


def plan(sizes: DataFrame) -> DataFrame:
    """source, source_size, target, blocks (its seats), quota (its target in whole words), n_shards: a row a source."""
    spark = sizes.sparkSession
    totals = sizes.groupBy("source").agg(F.sum("size").alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise TooManySources(f"more than {MOST_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    words = [r["size"] for r in totals]
    goal = targets(words)
    seats = apportion(goal, round(sum(goal) / BLOCK), [MOST * -(-w // BLOCK) for w in words])
    rows = [(r["source"], w, g, s, min(round(g), MOST * w), max(-(-w // SHARD_WORDS), 1)) for r, w, g, s in zip(totals, words, goal, seats, strict=True)]
    return spark.createDataFrame(rows, "source string, source_size long, target double, blocks long, quota long, n_shards long")


def shares(words: list[int], blocks: int, quota: int) -> tuple[list[int], list[int]]:
    """Seats, and words, of parts of these ``words``: of ``blocks`` seats and ``quota`` words in all, at most MOST times its words each.

    A seat is a block, but a part's last block may be short; what that and the rounding to blocks leave is settled in words, first up to a
    block in each part, then wherever there is room."""
    won = apportion([float(w) for w in words], blocks, [MOST * -(-w // BLOCK) for w in words])
    taken = [min(n * BLOCK, MOST * w) for n, w in zip(won, words, strict=True)]
    left = quota - sum(taken)
    for step in (BLOCK, quota + sum(taken)):
        for i, w in enumerate(words):
            if not left:
                break
            more = max(-min(taken[i], step), min(left, MOST * w - taken[i], step))
            taken[i] += more
            left -= more
    return won, taken


def _shared(part: str):
    """Blocks and quotas of the rows of a group, from their words; ``part`` names the rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(part).reset_index(drop=True)
        pdf["part_blocks"], pdf["part_quota"] = shares(pdf["words"].tolist(), int(pdf["blocks"].iloc[0]), int(pdf["quota"].iloc[0]))
        return pdf[["name", "unnamed", "region", *(["shard"] if part == "shard" else []), "part_blocks", "part_quota"]]

    return run


def block_counts(n_words: int, quota: int, seed: int) -> tuple[np.ndarray, int, int]:
    """How often each block of a shard of ``n_words`` words is taken, and the words [a, b) taken once more, for ``quota`` words in all."""
    n = max(-(-n_words // BLOCK), 1)
    size = np.full(n, BLOCK, np.int64)
    size[-1] = n_words - (n - 1) * BLOCK
    whole, rest = divmod(quota, n_words) if n_words else (0, 0)
    times = np.full(n, whole, np.int64)
    mixed = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):  # the finisher of SplitMix64
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    order = np.argsort(mixed, kind="stable")
    upto = np.cumsum(size[order])
    full = int(np.searchsorted(upto, rest, side="right"))
    times[order[:full]] += 1
    rest -= int(upto[full - 1]) if full else 0
    start = int(order[full]) * BLOCK if rest else 0
    return times, start, start + rest


class Selection(NamedTuple):
    """Of one shard: the order of its rows, and by row in that order its first word's number; how often each block is taken, and what once more."""

    order: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    times: np.ndarray
    extra: tuple[int, int]

    def upto(self, at: np.ndarray) -> np.ndarray:
        """Words taken of those before ``at``."""
        before = np.concatenate(([0], np.cumsum(self.times * BLOCK)))
        block = np.minimum(at // BLOCK, len(self.times) - 1)
        return before[block] + self.times[block] * (at - block * BLOCK) + np.clip(at, *self.extra) - self.extra[0]

    def often(self, row: int) -> np.ndarray:
        """How often each word of a row is taken."""
        at = np.arange(self.starts[row], self.starts[row] + self.sizes[row])
        return self.times[at // BLOCK] + ((at >= self.extra[0]) & (at < self.extra[1]))


def selection(h: np.ndarray, text_hash: np.ndarray, sizes: np.ndarray, quota: int, seed: int) -> Selection:
    order = np.lexsort((sizes, text_hash, h))
    sizes = sizes[order]
    ends = np.cumsum(sizes)
    times, a, b = block_counts(int(ends[-1]), quota, seed)
    return Selection(order, ends - sizes, sizes, times, (a, b))


KEY = ("name", "unnamed", "shard")


def quotas(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """name, unnamed, shard, quota, seed of every shard that has rows; a source's quota goes to regions of REGION shards, theirs to shards."""
    shards = dealt(sizes, sources).groupBy(*KEY).agg(F.sum("size").alias("words"), F.first("blocks").alias("blocks"), F.first("quota").alias("quota"))
    shards = shards.withColumn("region", F.floor(F.col("shard") / REGION))
    regions = shards.groupBy("name", "unnamed", "region").agg(F.sum("words").alias("words"), F.first("blocks").alias("blocks"), F.first("quota").alias("quota"))
    parts = regions.groupBy("name", "unnamed").applyInPandas(_shared("region"), "name string, unnamed boolean, region long, part_blocks long, part_quota long")
    parts = parts.withColumnsRenamed({"part_blocks": "blocks", "part_quota": "quota"})
    parts = shards.drop("blocks", "quota").join(parts, ["name", "unnamed", "region"]).groupBy("name", "unnamed", "region")
    found = parts.applyInPandas(_shared("shard"), "name string, unnamed boolean, region long, shard long, part_blocks long, part_quota long")
    return found.select(*KEY, F.col("part_quota").alias("part_quota"), F.xxhash64(F.lit(SEED + 2), *KEY).alias("seed"))


def dealt(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, text_hash and others) with their source's columns, the hash that orders them, and their shard."""
    name = lambda df: (F.coalesce(df["source"].cast("string"), F.lit("")).alias("name"), df["source"].isNull().alias("unnamed"))
    named = sources.select(*name(sources), "source_size", "target", "blocks", "quota", "n_shards")  # bounded by MOST_SOURCES
    h = F.xxhash64("doc_id", "text_hash", F.lit(SEED))
    shard = F.pmod(F.xxhash64("doc_id", "text_hash", F.lit(SEED + 1)), "n_shards").alias("shard")
    return rows.select("*", *name(rows)).join(F.broadcast(named), ["name", "unnamed"]).select("*", h.alias("h"), shard)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


MIXED = "doc_id long, source string, size long, source_size long, target double, taken long"


def mixed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``."""
    sizes = keep(sized(docs), "sizes")
    sources = plan(sizes)

    def taken(table: pa.Table) -> pa.Table:
        s = selection(*(_column(table, c) for c in ("h", "text_hash", "size")), int(table.column("part_quota")[0].as_py()), int(table.column("seed")[0].as_py()))
        table = table.take(pa.array(s.order))
        return table.select(["doc_id", "source", "size", "source_size", "target"]).append_column("taken", pa.array(s.upto(s.starts + s.sizes) - s.upto(s.starts)))

    rows = dealt(sizes, sources).drop("blocks", "quota", "n_shards")
    return rows.join(quotas(sizes, sources), [*KEY]).groupBy(*KEY).applyInArrow(taken, MIXED)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def word_bounds(data: bytes) -> np.ndarray:
    """[start, end) of every word of ``data``, in bytes."""
    inside = np.concatenate(([False], ~_SPACE[np.frombuffer(data, np.uint8)], [False]))
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def passes(data: bytes, often: np.ndarray) -> list[str]:
    """The k-th text holds the words taken at least k times, as they stand, a line for each run."""
    bounds, out = word_bounds(data), []
    for k in range(1, int(often.max(initial=0)) + 1):
        runs = np.flatnonzero(np.diff(np.concatenate(([0], often >= k, [0])).astype(np.int8))).reshape(-1, 2)
        out.append(b"\n".join(data[bounds[a, 0] : bounds[b - 1, 1]] for a, b in runs.tolist()).decode("utf-8", "surrogatepass"))
    return out


def mixed_texts(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs`` with their texts cut to the words taken, one row for each time they are gone through.

    A document's k-th row holds its words taken at least k times, in order; other columns are its own, whatever their names. Rows of which
    nothing is taken go. The result holds ``taken`` words of a document in all. Texts move once, to their shard.
    """
    sizes = keep(sized(docs), "sizes")
    sources = plan(sizes)
    names = docs.columns

    def gone_through(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rows = table.column("row").chunk(0)
        data = [(t or "").encode("utf-8", "surrogatepass") for t in pa.compute.struct_field(rows, names.index("text")).to_pylist()]
        counts = np.array([len(word_bounds(d)) for d in data], np.int64)
        s = selection(_column(table, "h"), _column(table, "text_hash"), counts, int(table.column("part_quota")[0].as_py()), int(table.column("seed")[0].as_py()))
        made = [passes(data[i], s.often(k)) for k, i in enumerate(s.order.tolist())]
        again = pa.array(np.repeat(s.order, [len(m) for m in made]))
        columns = [pa.array([t for m in made for t in m], pa.string()) if c == "text" else pa.compute.struct_field(rows, i).take(again) for i, c in enumerate(names)]
        return pa.Table.from_arrays(columns, names=names)

    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64("text").alias("text_hash"))
    rows = dealt(rows, sources).select(*KEY, "row", "h", "text_hash")
    return rows.join(quotas(sizes, sources), [*KEY]).groupBy(*KEY).applyInArrow(gone_through, docs.schema)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
