"""Quality by a byte-level convolutional network in numpy.

The bytes of a whole text, and pads after them up to whole blocks, go through learned filters WIDTH bytes wide. Their responses are
max-pooled over chunks of SPAN blocks that begin every STEP blocks, so that neighbouring chunks overlap and each byte is in one at least.
A second layer of filters looks at each chunk's pooled responses; its largest and mean values over a text's chunks are combined into one
probability. A bank of filters shows repetition, too: chunks in which few filters find anything.

The filters are sums over pairs of bytes of learned embeddings, so scoring looks responses up in tables of byte pairs: three look-ups a byte.
Texts go through in pieces of PIECE positions, of which a block's maxima are all that stays: memory does not grow with a text.

Training rows: TRAIN_DOCS labelled texts a class at most, lowest hash first, whole; a parameter. They are dealt to SHARDS by hash and stay
with the executors: in each of ROUNDS a shard takes Adam steps from the common weights and the driver averages the shards' weights, all it
ever sees of them. Where a class was cut down to TRAIN_DOCS, the constant is corrected by its share, so that scores stay probabilities.

Nulls: a null text is an empty one; an empty text is a block of pads and gets the score of that. Null labels and null ids are not learned
from, nor is the fold. With labels of one class, or none, every score is that class's share, or 0. Repeated rows stay repeated; equal texts
have equal scores. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.language_id import held_out
from corpuscle.llm.tables import keep, load, map_texts, scratch

TRAIN_DOCS = 1500
SEED = 23
#: Bytes of a filter (an even number), numbers of an embedding, filters, second filters.
WIDTH, EMBEDDING, FILTERS, SECOND = 6, 8, 32, 16
PAD = 256
SYMBOLS = PAD + 1
#: Positions of a block, blocks of a chunk, blocks from a chunk's start to the next one's.
BLOCK, SPAN, STEP = 64, 4, 2
#: Positions whose responses exist at a time: a multiple of BLOCK.
PIECE = 1 << 13
SHARDS, ROUNDS, STEPS, BATCH, RATE, DECAY = 8, 8, 48, 16, 0.01, 1e-4
THRESHOLD = 0.7


class Texts:
    """Texts as one array of symbols: each padded to whole blocks, with a block of pads after it that no chunk looks at."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.blocks = np.array([max(1, -(-len(b) // BLOCK)) for b in raw], np.int64)
        self.ends = np.cumsum(self.blocks + 1)
        self.first = self.ends - self.blocks - 1
        self.symbols = np.full(int(self.ends[-1]) * BLOCK + WIDTH, PAD, np.int32)
        for b, at in zip(raw, (self.first * BLOCK).tolist(), strict=True):
            self.symbols[at : at + len(b)] = np.frombuffer(b, np.uint8)
        # Chunks: their texts, and the SPAN blocks of each; where a text has fewer, its last one again.
        spare = np.maximum(self.blocks - SPAN, 0)
        self.chunks = 1 + -(-spare // STEP)
        self.chunk_first = np.cumsum(self.chunks) - self.chunks
        self.text = np.repeat(np.arange(len(raw)), self.chunks)
        nth = np.arange(len(self.text)) - self.chunk_first[self.text]
        start = np.minimum(nth * STEP, spare[self.text])
        self.members = self.first[self.text][:, None] + np.minimum(start[:, None] + np.arange(SPAN), self.blocks[self.text][:, None] - 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class ByteNetwork:
    """The network: weights by name, what it gives for texts, and its gradient. Sent to tasks; tables are each worker's own."""

    def __init__(self, weights: dict[str, np.ndarray] | None, constant: float = 0.0):
        self.weights, self.constant, self.tables = weights, constant, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"tables": None}

    @classmethod
    def start(cls) -> ByteNetwork:
        rng = np.random.default_rng(SEED)
        draw = lambda *shape, by: (rng.standard_normal(shape) / np.sqrt(by)).astype(np.float32)
        weights = {"embedding": draw(SYMBOLS, EMBEDDING, by=1), "filters": draw(WIDTH, EMBEDDING, FILTERS, by=WIDTH * EMBEDDING), "bias": np.zeros(FILTERS, np.float32)}
        weights |= {"second": draw(FILTERS, SECOND, by=FILTERS), "second_bias": np.zeros(SECOND, np.float32), "out": draw(2 * SECOND, by=2 * SECOND), "out_bias": np.zeros(1, np.float32)}
        return cls(weights)

    def responses(self) -> np.ndarray:
        """Of each offset in a filter's width, by symbol: the filters' responses."""
        return np.einsum("se,wef->wsf", self.weights["embedding"], self.weights["filters"])

    def pair_tables(self) -> list[np.ndarray]:
        if self.tables is None:
            by_symbol = self.responses()
            self.tables = [(by_symbol[w][:, None] + by_symbol[w + 1][None]).reshape(-1, FILTERS) for w in range(0, WIDTH, 2)]
        return self.tables

    def block_maxima(self, texts: Texts) -> np.ndarray:
        """The largest response of each filter in each block."""
        tables, symbols = self.pair_tables(), texts.symbols
        n = int(texts.ends[-1]) * BLOCK
        out = np.empty((n // BLOCK, FILTERS), tables[0].dtype)
        found, more = (np.empty((PIECE, FILTERS), tables[0].dtype) for _ in range(2))
        for at in range(0, n, PIECE):
            m = min(PIECE, n - at)
            piece = symbols[at : at + m + WIDTH]
            pairs = piece[:-1] * SYMBOLS + piece[1:]
            np.take(tables[0], pairs[:m], axis=0, out=found[:m], mode="clip")
            for k in range(1, len(tables)):
                np.take(tables[k], pairs[2 * k : 2 * k + m], axis=0, out=more[:m], mode="clip")
                found[:m] += more[:m]
            found[:m].reshape(-1, BLOCK, FILTERS).max(1, out=out[at // BLOCK : (at + m) // BLOCK])
        return out

    def above(self, texts: Texts, pooled: np.ndarray) -> tuple[np.ndarray, ...]:
        """What follows the pooled responses of chunks: first layer, second layer, its largest and mean values by text, log odds."""
        w = self.weights
        hidden = np.maximum(pooled + w["bias"], 0)
        second = np.maximum(hidden @ w["second"] + w["second_bias"], 0)
        top = np.maximum.reduceat(second, texts.chunk_first)
        mean = np.add.reduceat(second, texts.chunk_first) / texts.chunks[:, None]
        return hidden, second, top, mean, np.concatenate([top, mean], 1) @ w["out"] + w["out_bias"][0]

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        made = Texts(texts)
        odds = self.above(made, self.block_maxima(made)[made.members].max(1))[-1]
        return sigmoid(odds.astype(float) + self.constant)

    def gradient(self, texts: Texts, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by name of the weights."""
        w, by_symbol = self.weights, self.responses()
        n = int(texts.ends[-1]) * BLOCK
        maxima, place = np.empty((n // BLOCK, FILTERS), np.float32), np.empty((n // BLOCK, FILTERS), np.int64)
        for at in range(0, n, PIECE):
            m = min(PIECE, n - at)
            found = sum(by_symbol[k][texts.symbols[at + k : at + k + m]] for k in range(WIDTH)).reshape(-1, BLOCK, FILTERS)
            rows, where = slice(at // BLOCK, (at + m) // BLOCK), found.argmax(1)
            maxima[rows] = np.take_along_axis(found, where[:, None], 1)[:, 0]
            place[rows] = where + (at + BLOCK * np.arange(m // BLOCK))[:, None]
        inside = maxima[texts.members]
        which = inside.argmax(1)
        pooled = np.take_along_axis(inside, which[:, None], 1)[:, 0]
        where = np.take_along_axis(place[texts.members], which[:, None], 1)[:, 0]

        hidden, second, top, mean, odds = self.above(texts, pooled)
        d_odds = ((sigmoid(odds) - labels) / len(labels)).astype(np.float32)
        out = {"out": np.concatenate([top, mean], 1).T @ d_odds, "out_bias": d_odds.sum(keepdims=True)}
        d_both = d_odds[:, None] * w["out"]
        at_top = (second == top[texts.text]).astype(np.float32)
        at_top /= np.add.reduceat(at_top, texts.chunk_first)[texts.text]
        d_second = (at_top * d_both[texts.text, :SECOND] + (d_both[:, SECOND:] / texts.chunks[:, None])[texts.text]) * (second > 0)
        out |= {"second": hidden.T @ d_second, "second_bias": d_second.sum(0)}
        d_hidden = (d_second @ w["second"].T) * (hidden > 0)
        out["bias"] = d_hidden.sum(0)
        # Each filter learns from the place of its largest response in a chunk.
        chunk, which = np.nonzero(d_hidden)
        flow, where = d_hidden[chunk, which], where[chunk, which]
        d_symbol = [np.bincount(texts.symbols[where + k] * FILTERS + which, flow, SYMBOLS * FILTERS).reshape(SYMBOLS, FILTERS) for k in range(WIDTH)]
        out["embedding"] = sum(d @ f.T for d, f in zip(d_symbol, w["filters"], strict=True))
        out["filters"] = np.stack([w["embedding"].T @ d for d in d_symbol])
        return out

    def steps(self, texts: list[str], labels: list[float], seed: int, rate: float) -> ByteNetwork:
        """STEPS Adam steps on batches of the given rows, gone through as often as it takes."""
        rng = np.random.default_rng(seed)
        weights = {k: v.copy() for k, v in self.weights.items()}
        moving = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in weights.items()}
        labels, order = np.array(labels), np.empty(0, np.int64)
        for step in range(1, STEPS + 1):
            while len(order) < min(BATCH, len(texts)):
                order = np.concatenate([order, rng.permutation(len(texts))])
            batch, order = order[:BATCH], order[BATCH:]
            found = ByteNetwork(weights).gradient(Texts([texts[i] for i in batch]), labels[batch])
            for k, g in found.items():
                first, square = moving[k]
                first += 0.1 * (g - first)
                square += 0.01 * (g * g - square)
                weights[k] -= rate * (first / (1 - 0.9**step) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) + DECAY * weights[k])
        return ByteNetwork(weights)


def _sample(docs: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """shard, label, h, text of the training rows: equal texts of a label once, TRAIN_DOCS a class at most."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("known_id"), (F.col(column) > 0).alias("label"))
    by_id, by_text = F.xxhash64(F.lit(SEED), "known_id"), F.xxhash64(F.lit(SEED), "text")
    chosen = [known.where(F.col("label") == side).distinct().orderBy(by_id, "known_id").limit(TRAIN_DOCS) for side in (False, True)]
    chosen = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * TRAIN_DOCS ids
    texts = docs.where("text is not null").join(chosen, docs["doc_id"] == chosen["known_id"]).select("label", docs["text"].alias("text"), by_text.alias("h")).dropDuplicates(["label", "text"])
    kept = [texts.where(F.col("label") == side).orderBy("h", "text").limit(TRAIN_DOCS) for side in (False, True)]  # where ids are repeated
    return kept[0].unionByName(kept[1]).select((F.pmod("h", F.lit(SHARDS))).cast("int").alias("shard"), F.col("label").cast("double").alias("label"), "h", "text")


def train(docs: DataFrame, labels: DataFrame, column: str = "quality") -> ByteNetwork:
    """Learn ``column`` of ``labels`` (doc_id, column) outside the fold from the texts of ``docs`` (doc_id, text)."""
    usable = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    total = {bool(r["label"]): r["count"] for r in usable.groupBy((F.col(column) > 0).alias("label")).count().collect()}
    with scratch(docs.sparkSession):
        sample = keep(_sample(docs, labels, column), "quality")
        n = {r["label"] > 0: r["count"] for r in sample.groupBy("label").count().collect()}
        if len(n) < 2:
            return ByteNetwork(None, float(True in n))
        network = ByteNetwork.start()
        for turn in range(ROUNDS):
            network = _averaged(sample, network, turn)
    network.constant = float(np.log(total[True] / n[True]) - np.log(total[False] / n[False]))
    return network


def _averaged(sample: DataFrame, network: ByteNetwork, turn: int) -> ByteNetwork:
    """The shards' networks after their steps from ``network``, averaged by their rows."""
    shared = sample.sparkSession.sparkContext.broadcast(network)
    names = sorted(network.weights)

    def learn(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("h", "ascending"), ("label", "ascending"), ("text", "ascending")])
        rate = RATE * (1 - turn / ROUNDS)
        made = shared.value.steps(rows.column("text").to_pylist(), rows.column("label").to_pylist(), turn, rate).weights
        flat = np.concatenate([made[k].ravel() for k in names]).astype(np.float64)
        return pa.table({"shard": rows.column("shard")[:1], "n": [rows.num_rows], "weights": pa.array([flat], pa.list_(pa.float64()))})

    dealt = sample.repartition(2 * SHARDS, "shard")  # a number given is kept: small shards are not put into one task
    found = sorted(dealt.groupBy("shard").applyInArrow(learn, "shard int, n long, weights array<double>").collect())
    shared.unpersist()
    flat = np.average([r["weights"] for r in found], 0, [r["n"] for r in found]).astype(np.float32)
    cuts = np.cumsum([network.weights[k].size for k in names])[:-1]
    return ByteNetwork({k: x.reshape(network.weights[k].shape) for k, x in zip(names, np.split(flat, cuts), strict=True)})


def scores(docs: DataFrame, network: ByteNetwork) -> DataFrame:
    """doc_id, score for every row of ``docs``, in place."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def rows(ids: list, texts: list) -> dict[str, list]:
        found = [shared.value.score(texts[i : i + BATCH]) for i in range(0, len(texts), BATCH)]
        return {"doc_id": ids, "score": np.concatenate(found)}

    return map_texts(docs, "doc_id long, score double", rows)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = scores(docs, train(docs, load(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
