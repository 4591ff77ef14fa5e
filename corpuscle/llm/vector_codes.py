"""Vector code compression: product quantisation whose nearest entries are found by ball trees, in whole numbers.

A vector's components become floor(4096 * x) and are cut into PARTS equal parts; each part position has a codebook of ENTRIES entries, refined
in ROUNDS by Lloyd's steps. At each position the entries form a ball tree: a node's entries lie within a radius of its centre, which
is one of them. A search carries the best entry so far; a ball is passed over only if no entry in it can be as near:

* radii and distances to centres are square roots, rounded away from the truth by UP and DOWN, so that rounding can't hide an entry;
* balls that may hold an entry exactly as near are visited too (non-strict), as ties go to the lower index;
* what is compared are squared distances as integers; roots only ever pass balls over.

Searches go through a tree in batches: rows that may find something in a ball are handed on together. Codebooks are all that tasks are sent
and send back (as sums and counts, added up by Spark): PARTS * ENTRIES entries, whatever the table's size. The vectors, as integers, are kept
as a table that each round reads.

Kept are rows whose vector holds numbers alone, finite ones, and can be cut: its length is a positive multiple of PARTS and, where the table
holds several such lengths, the most frequent one (ties: the shortest). Beyond LARGEST a component's squares don't fit the sums: an error. A
codebook starts from the smallest distinct vec_ids, null last; of rows of one vec_id from the smallest vector; with fewer ids it has fewer
entries. Rows with a null vec_id are coded like others, and null labels are one label. Repeated rows stay repeated. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.tables import keep, load, scratch

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Of a component, so that the squared differences of a vector of 2,000 components fit a long.
LARGEST = 1 << 25
#: Entries of a leaf.
LEAF = 2
#: Relative room for the rounding of a root, a sum and a difference.
UP, DOWN = 1 + 1e-12, 1 - 1e-12


class Ball:
    """A node: its centre is entry ``centre``; ``inside`` are the other entries' nodes, all within ``radius`` of it."""

    def __init__(self, entries: np.ndarray, members: np.ndarray):
        middle = entries[members].mean(0)
        at = int(np.argmin(((entries[members] - middle) ** 2).sum(1)))
        self.centre = int(members[at])
        rest = np.delete(members, at)
        squares = ((entries[rest] - entries[self.centre]) ** 2).sum(1)
        self.radius = float(np.sqrt(squares.max(initial=0)) * UP)
        self.inside: list[Ball] = []
        if len(rest) <= LEAF:
            self.inside = [Ball(entries, rest[i : i + 1]) for i in range(len(rest))]
        else:  # halves by distance from the entry that is farthest from the centre
            pole = entries[rest[int(np.argmax(squares))]]
            order = np.argsort(((entries[rest] - pole) ** 2).sum(1), kind="stable")
            half = len(rest) // 2
            self.inside = [Ball(entries, np.sort(rest[order[:half]])), Ball(entries, np.sort(rest[order[half:]]))]


class Search:
    """Nearest entries of ``parts`` (rows x components): ``best`` is the squared distance, ``index`` the entry."""

    def __init__(self, entries: np.ndarray, parts: np.ndarray, tree: Ball | None = None):
        self.entries, self.parts = entries, parts
        self.best = np.full(len(parts), np.iinfo(np.int64).max)
        self.index = np.full(len(parts), len(entries), np.int64)
        self.compared = 0
        if len(parts):
            every = np.arange(len(parts))
            tree = tree or Ball(entries, np.arange(len(entries)))
            self._visit(tree, every, self._squares(tree, every))

    def _squares(self, ball: Ball, rows: np.ndarray) -> np.ndarray:
        self.compared += len(rows)
        difference = self.parts[rows] - self.entries[ball.centre]
        return np.einsum("ij,ij->i", difference, difference)

    def _visit(self, ball: Ball, rows: np.ndarray, squares: np.ndarray) -> None:
        better = (squares < self.best[rows]) | ((squares == self.best[rows]) & (ball.centre < self.index[rows]))
        self.best[rows[better]], self.index[rows[better]] = squares[better], ball.centre
        if not ball.inside:
            return
        far = [self._squares(child, rows) for child in ball.inside]
        # Each row goes to the ball of the nearer centre first.
        first = np.argmin(far, 0)
        for turn in range(len(ball.inside)):
            for k, child in enumerate(ball.inside):
                mine = np.flatnonzero((first + turn) % len(ball.inside) == k)
                if len(mine):
                    least = np.sqrt(far[k][mine].astype(float)) * DOWN - child.radius
                    mine = mine[least * DOWN <= np.sqrt(self.best[rows[mine]].astype(float)) * UP]
                    if len(mine):
                        self._visit(child, rows[mine], far[k][mine])


def nearest(codebooks: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector and part position the nearest entry's index and squared distance: rows x PARTS each. ``codebooks``: PARTS x entries x components."""
    cut = vectors.reshape(len(vectors), PARTS, vectors.shape[1] // PARTS)
    found = [Search(codebooks[p], np.ascontiguousarray(cut[:, p])) for p in range(PARTS)]
    return np.stack([f.index for f in found], 1), np.stack([f.best for f in found], 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` that are kept, with column whole: the components as integers. ``vector`` is dropped."""
    x = F.col(vector)
    usable = rows.where(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % PARTS == 0) & F.forall(x, lambda v: F.coalesce((F.abs(v) < float("inf")) & ~F.isnan(v), F.lit(False))))
    lengths = usable.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    usable = usable.where(F.size(x) == (lengths[0]["n"] if lengths else 0))
    too_large = F.raise_error(F.lit(f"a component times {SCALE} is beyond {LARGEST}")).cast("long")
    scaled = lambda v: F.floor(v.cast("double") * SCALE)
    return usable.withColumn("whole", F.transform(x, lambda v: F.when(F.abs(v.cast("double")) <= LARGEST / SCALE, scaled(v)).otherwise(too_large))).drop(vector)


def first_codebooks(vectors: DataFrame, vec_id: str = "vec_id") -> np.ndarray:
    """The parts of the ENTRIES smallest ids: PARTS x entries x components."""
    seeds = vectors.groupBy(vec_id).agg(F.min("whole").alias("whole")).orderBy(F.col(vec_id).asc_nulls_last()).limit(ENTRIES).collect()
    size = len(seeds[0]["whole"]) // PARTS if seeds else 0
    return np.array([r["whole"] for r in seeds], np.int64).reshape(len(seeds), PARTS, size).transpose(1, 0, 2)


def _refined(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: parts to entries, entries to their parts' floored means; unused ones stay."""
    shared, width = vectors.sparkSession.sparkContext.broadcast(codebooks), int(np.prod(codebooks.shape[::2]))
    entries, size = codebooks.shape[1:]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((PARTS * entries, size), np.int64), np.zeros(PARTS * entries, np.int64)
        for batch in batches:
            rows = _matrix(batch.column(0), width)
            slots = nearest(shared.value, rows)[0] + entries * np.arange(PARTS)
            np.add.at(total, slots.ravel(), rows.reshape(-1, size))
            count += np.bincount(slots.ravel(), minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(used, pa.int64()), "n": count[used], "sums": pa.array(list(total[used]), pa.list_(pa.int64()))})

    parts = vectors.select("whole").mapInArrow(sums, "slot long, n long, sums array<long>")
    found = parts.groupBy("slot").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(size))).collect()  # a row an entry
    made = codebooks.copy()
    for r in found:
        made[r["slot"] // entries, r["slot"] % entries] = [r[f"s{i}"] // r["n"] for i in range(size)]
    shared.unpersist()
    return made


def fit(vectors: DataFrame, vec_id: str = "vec_id") -> np.ndarray:
    """Codebooks of the vectors in column whole, from all rows."""
    codebooks = first_codebooks(vectors, vec_id)
    for _ in range(ROUNDS if codebooks.size else 0):
        codebooks = _refined(vectors, codebooks)
    return codebooks


def encoded(vectors: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``vectors`` without whole, with code binary (an entry's index a part) and error long."""
    others = [c for c in vectors.columns if c != "whole"]
    shared, width = vectors.sparkSession.sparkContext.broadcast(codebooks), int(np.prod(codebooks.shape[::2]))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, square = nearest(shared.value, _matrix(batch.column(len(others)), width))
            made = [pa.array([x.tobytes() for x in index.astype(np.uint8)], pa.binary()), pa.array(square.sum(1), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *made], names=[*others, "code", "error"])

    schema = vectors.select(*others).schema.add("code", "binary").add("error", "long")
    return vectors.select(*others, "whole").mapInArrow(code, schema)


def decoded(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """``codes`` with column near: the vectors that their codes stand for, as integers."""
    books = [[[int(x) for x in entry] for entry in book] for book in codebooks]
    if not codebooks.size:
        return codes.withColumn("near", F.array().cast("array<long>"))
    table = [F.array(*(F.array(*map(F.lit, entry)) for entry in book)) for book in books]
    entry = lambda p: F.conv(F.hex(F.substring("code", p + 1, 1)), 16, 10).cast("int")
    return codes.withColumn("near", F.concat(*(F.get(table[p], entry(p)) for p in range(len(books)))))


def codebook_digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark):
        rows = load(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
        vectors = keep(whole_vectors(rows), "vectors")
        codebooks = fit(vectors)
        codes = keep(encoded(vectors, codebooks), "codes", outer=True)
        by_label = keep(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "labels", outer=True)
    found = codes.alias("c").join(by_label.alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
    return found.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebook_digest(codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same by brute force, each round a table: all distances, the least of (distance, index)."""
    sql = f"""WITH kept AS (
  SELECT vec_id, label, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS (SELECT r, p, list_slice(whole, p * len(whole) // {PARTS} + 1, (p + 1) * len(whole) // {PARTS}) AS x FROM kept, range({PARTS}) t(p)),
seed AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS (SELECT p, e, x AS y FROM part JOIN seed USING (r))"""
    square = "list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(ROUNDS + 1):
        sql += f""",
near{k} AS (SELECT r, p, min(({square}, e)) AS best, any_value(x) AS x FROM part JOIN book{k} USING (p) GROUP BY r, p)"""
        if k < ROUNDS:
            sql += f""",
mean{k} AS (SELECT p, e, list(m ORDER BY i) AS y FROM (
  SELECT p, best[2] AS e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m FROM near{k}, range(1, 1 + len(x)) u(i) GROUP BY ALL) GROUP BY p, e),
book{k + 1} AS (SELECT p, e, coalesce(n.y, o.y) AS y FROM book{k} o LEFT JOIN mean{k} n USING (p, e))"""
    return sql + f""",
code AS (SELECT r, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM near{ROUNDS} GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN code USING (r), digest"""


OP12_SQL = _sql()
