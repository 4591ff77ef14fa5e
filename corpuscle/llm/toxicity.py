"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text, window by window.

A window (some WINDOW bytes of whole words) that holds what toxic texts have in common compresses shorter with the toxic dictionary than
with the ordinary one. Both dictionaries begin with the same prose, trained on ordinary windows, so that only what sets the classes apart
makes a difference; each goes on with what is trained on its own class alone: the parts of words whose share of documents is higher there
by MARGIN standard errors. A text's features are its largest savings and the shares of windows that save at least a few bytes; a
logistic fit on the training rows calibrates them to a probability, of which THRESHOLD is the operating point.

Training rows: TRAIN_DOCS labelled rows a class at most, lowest hash first; a parameter. Everything is scored: whole texts, all rows, in
place. What reaches the driver is bounded by TRAIN_DOCS, GRAMS, SNIPPETS and WINDOWS.

Nulls: a null text is empty; empty texts have no savings and get the score of such features. Labels are learned from only outside the
fold; a null toxic is no label. With labels of one class, or none, every score is that class's share, or 0. Repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.language_id import held_out
from corpuscle.llm.tables import keep, load, map_texts

TRAIN_DOCS, WINDOWS, SNIPPETS, GRAMS = 1500, 20_000, 20_000, 4000
SEED = 12
WINDOW = 48
GRAM_SIZES = (4, 5, 6)
MARGIN, LEAST_DOCS = 4.5, 6
#: How many times as common a part must be in its own class's documents.
RATIO = 4
BASE_BYTES, CLASS_BYTES, LEVEL = 7168, 1024, 9
#: Bytes saved by a window: those whose shares are features, at least and exactly, and those that are counted.
AT_LEAST, EXACTLY, COUNTED = (2, 3, 4, 5, 6, 8), tuple(range(-2, 8)), (2, 3, 4, 5, 6, 7)
N_FEATURES = 4 + len(AT_LEAST) + len(EXACTLY) + len(COUNTED)
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None) -> list[bytes]:
    """The lower-cased text in runs of whole words of at least WINDOW bytes; a longer word stays whole."""
    out, run, n = [], [], 0
    for word in (text or "").lower().encode("utf-8", "surrogatepass").split():
        run.append(word)
        n += len(word) + 1
        if n >= WINDOW:
            out.append(b" ".join(run))
            run, n = [], 0
    if run:
        out.append(b" ".join(run))
    return out


def word_grams(word: str) -> list[str]:
    marked = " " + word
    return [marked[i : i + n] for n in GRAM_SIZES for i in range(len(marked) - n + 1)]


def leaning_parts(word: str, grams: set[str]) -> list[str]:
    """Parts of ``word`` that leaning grams cover, with the blank before it if that is covered."""
    marked, covered = " " + word, [False] * (len(word) + 1)
    for n in GRAM_SIZES:
        for i in range(len(marked) - n + 1):
            if marked[i : i + n] in grams:
                covered[i : i + n] = [True] * n
    return ["".join(c for c, _ in run) for run in _runs(zip(marked, covered, strict=True))]


def _runs(marks) -> Iterator[list]:
    run: list = []
    for mark in marks:
        if mark[1]:
            run.append(mark)
        elif run:
            yield run
            run = []
    if run:
        yield run


def trained(samples: list[bytes], size: int) -> bytes:
    """Content of a zstandard dictionary trained on ``samples``; where they are too few to train on, the samples themselves."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


class ToxicityModel:
    """Two dictionaries and a calibration. Sent to executors once; compressors are each worker's own."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary, toxic
        self.weights: np.ndarray | None = None
        self.centre, self.spread = np.zeros(N_FEATURES), np.ones(N_FEATURES)
        self.constant = 0.0
        self.compressors = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"compressors": None}

    def features(self, text: str | None) -> list[float]:
        if self.compressors is None:
            form = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            pair = []
            for content in (self.ordinary, self.toxic):
                words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                words.precompute_compress(compression_params=form)
                pair.append(zstandard.ZstdCompressor(dict_data=words, compression_params=form).compress)
            self.compressors = pair
        a, b = self.compressors
        cut = windows(text)
        saved = np.sort(np.array([len(a(w)) - len(b(w)) for w in cut] or [0], float))[::-1]
        share = [np.mean(saved >= n) for n in AT_LEAST] + [np.mean(saved == n) for n in EXACTLY]
        return [saved[0], saved[:3].mean(), saved.mean(), np.log1p(len(cut)), *share, *(np.log1p(np.sum(saved >= n)) for n in COUNTED)]

    def calibrate(self, features: np.ndarray, labels: np.ndarray, weight: np.ndarray | float = 1.0) -> None:
        """Logistic fit by Newton steps with a small ridge; ``weight`` makes the classes as common as among all labels."""
        weight = np.broadcast_to(weight, labels.shape)
        self.centre, self.spread = features.mean(0), features.std(0) + 1e-9
        x = np.column_stack([(features - self.centre) / self.spread, np.ones(len(features))])
        w = np.zeros(x.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w)), x.T @ (weight * (labels - p)) - 1e-2 * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        self.weights = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.constant)
        x = (np.array([self.features(t) for t in texts]) - self.centre) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)))


def fold(doc_id: str = "doc_id"):
    return held_out(doc_id, 3, 1)


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, toxic of the training rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~fold()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).distinct()
    order = Window.partitionBy("toxic").orderBy(F.xxhash64(F.lit(SEED), "doc_id"), "doc_id")
    chosen = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= TRAIN_DOCS).select(F.col("doc_id").alias("chosen_id"), "toxic")
    return docs.join(F.broadcast(chosen), docs["doc_id"] == chosen["chosen_id"]).select(docs["text"], "toxic")


def _pairs(df: DataFrame, schema: str, made) -> DataFrame:
    """``made(text)`` gives values for each row of ``df`` (text, toxic); rows (toxic, value)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, values = [], []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = made(text or "")
                toxic += [label] * len(found)
                values += found
            kind = pa.binary() if "binary" in schema else pa.string()
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.bool_()), pa.array(values, kind)], names=["toxic", "value"])

    return df.select("text", "toxic").mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    sample = keep(_sample(docs, labels).dropDuplicates(["text", "toxic"]), "toxicity")  # equal texts teach once
    n = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(n) < 2:
        model = ToxicityModel(b"", b"")
        model.constant = float(True in n)
        return model

    # Grams whose share of documents leans to one class.
    grams = _pairs(sample, "toxic boolean, value string", lambda t: list({g for w in set(_WORD.findall(t.lower())) for g in word_grams(w)}))
    by_gram = grams.groupBy("value").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o"))
    share = (F.col("t") + F.col("o") + 1) / (n[True] + n[False] + 2)
    z = (F.col("t") / n[True] - F.col("o") / n[False]) / F.sqrt(share * (1 - share) * (1 / n[True] + 1 / n[False]))
    leaning = by_gram.withColumn("z", z).where((F.abs("z") > MARGIN) & (F.greatest("t", "o") >= LEAST_DOCS)).orderBy(F.desc(F.abs("z")), "value").limit(GRAMS).collect()
    lean = {side: {r["value"] for r in leaning if (r["z"] > 0) == side} for side in (True, False)}

    # What each class's dictionary is trained on: those parts of its words that are its own; and, for the common part, ordinary windows.
    def parts_of(text: str) -> list[str]:
        words = set(_WORD.findall(text.lower()))
        return list({f"{side:d}{p}" for side in (True, False) if lean[side] for w in words for p in leaning_parts(w, lean[side])})

    parts = _pairs(sample, "toxic boolean, value string", parts_of).groupBy("value").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("o")).orderBy(F.desc(F.greatest("t", "o")), "value").limit(SNIPPETS).collect()
    prose = _pairs(sample.where(~F.col("toxic")), "toxic boolean, value binary", windows).orderBy(F.xxhash64("value"), "value").limit(WINDOWS).collect()
    lines = [bytes(r["value"]) for r in prose]
    base = trained([b" ".join(lines[i : i + 4]) for i in range(0, len(lines), 4)], BASE_BYTES)
    own = {}
    for side in (True, False):
        rate = {True: lambda r: (r["t"] / n[True], r["o"] / n[False]), False: lambda r: (r["o"] / n[False], r["t"] / n[True])}[side]
        count = "t" if side else "o"
        found = [r for r in parts if r["value"][0] == f"{side:d}" and rate(r)[0] > RATIO * (rate(r)[1] + 0.5 / n[not side]) and r[count] >= LEAST_DOCS]
        # A part as often as documents have it, four to a sample: what few documents share, as copies do, gives way.
        often = [(r["value"][1:] + " ").encode() for r in found for _ in range(r[count])]
        own[side] = trained([b"".join(often[i::-(-len(often) // 4)]) for i in range(-(-len(often) // 4))], CLASS_BYTES) if often else b""
    size = max(len(own[True]), len(own[False]))
    model = ToxicityModel(*(base + own[side].rjust(size, b"\0") for side in (False, True)))

    shared = sample.sparkSession.sparkContext.broadcast(model)

    def rows(labels_: list, texts: list) -> dict[str, list]:
        return {"doc_id": labels_, "f": [shared.value.features(t) for t in texts]}

    features = map_texts(sample.select(F.col("toxic").cast("long").alias("doc_id"), "text"), "doc_id long, f array<double>", rows).collect()
    y = np.array([r["doc_id"] for r in features], float)
    total = {r["toxic"]: r["count"] for r in labels.where(F.col("toxic").isNotNull() & ~fold()).groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    weight = np.where(y > 0, total[True] / n[True], total[False] / n[False])
    model.calibrate(np.array([r["f"] for r in features]), y, weight / weight.mean())
    return model


def scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, "doc_id long, score double", lambda ids, texts: {"doc_id": ids, "score": shared.value.score(texts)})


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = scores(docs, train(docs, load(spark, sf_dir, "labels")))
    return found.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
