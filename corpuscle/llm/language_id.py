"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a fixed public vocabulary; each language has a probability for every piece. A word's probability in a language
is the sum over all its segmentations into pieces of the product of their probabilities, which a forward pass computes exactly; a
text's is the product over its words, since no piece crosses one. The probabilities are learned by expectation maximisation, whose
expected piece counts come from the same forward pass and a backward one.

Training rows: TRAIN_DOCS documents a language at most, lowest hash first, and of their words the TRAIN_WORDS most frequent ones of fewer
than SHORT letters; all are parameters. Everything is scored: whole texts, all rows, words of any length, in place, without a shuffle. A word
is scored once while a bounded cache holds it. The model (pieces x languages) is bounded by the vocabulary and MAX_LANGUAGES; more
languages are an error. The evidence of a text counts as that of EVIDENCE words at most, which sets its score but not its language.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows with a null lang or doc_id, and fold rows, are not learned from.
Without any row to learn from everything is ``und``. Ties go to the first language by name. Repeated rows stay repeated.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import chain, groupby

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.llm.tables import load, map_texts

VOCABULARY = "piece_bpe_32k.model"
TRAIN_DOCS, TRAIN_WORDS, MAX_LANGUAGES = 600, 8000, 200
ROUNDS = 4
SEED = 11
#: Share of a language's probability that is spread over all pieces, and a letter's that no piece covers.
SMOOTH, UNKNOWN = 0.01, 1e-6
#: Words whose evidence counts at most: beyond, a text's score grows no surer.
EVIDENCE = 20
SHORT, GROUP, CACHE = 32, 4096, 200_000
#: More than any piece has letters.
LONGEST = 64
UND = "und"
#: Letters and numerals, such as a half or a Roman four; words are cut at numerals afterwards, as a class without them is slow to match.
WORD = re.compile(r"[^\W\d_]+")
START = "▁"


def vocabulary_pieces(path: str) -> list[str]:
    """Lower-case pieces of letters of a SentencePiece model, with the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)))
    return sorted({p for p in pieces if p == p.lower() and p.strip(START) and p.lstrip(START).isalpha()} | {START})


def words_of(text: str | None) -> Counter:
    """Lower-case runs of letters of a text, counted."""
    found = Counter(WORD.findall((text or "").lower()))
    for word in [w for w in found if not w.isalpha()]:
        n = found.pop(word)
        for letters, run in groupby(word, str.isalpha):
            if letters:
                found["".join(run)] += n
    return found


class TooManyLanguages(ValueError):
    """More languages than a model is made for."""


class Lattice:
    """All places of pieces in a group of words: rows (word, end, length, piece), ordered by end, then length."""

    def __init__(self, words: list[str], automaton, unknown: int):
        marked = [START + w for w in words]
        lengths = np.array([len(w) for w in marked])
        offsets = np.concatenate(([0], np.cumsum(lengths + 1)))
        found = np.fromiter(chain.from_iterable(automaton.iter("\n".join(marked))), np.int64).reshape(-1, 2)
        word = np.searchsorted(offsets, found[:, 0], side="right") - 1
        rows = np.stack([word, found[:, 0] - offsets[word] + 1, found[:, 1] % LONGEST, found[:, 1] // LONGEST], axis=1)
        # Letters that are no piece stand for themselves.
        width = int(lengths.max(initial=0))
        single = np.zeros((len(words), width + 1), bool)
        ones = rows[rows[:, 2] == 1]
        single[ones[:, 0], ones[:, 1]] = True
        single[:, 0] = True
        single |= np.arange(width + 1)[None, :] > lengths[:, None]
        bare = np.argwhere(~single)
        rows = np.concatenate([rows, np.stack([bare[:, 0], bare[:, 1], np.ones(len(bare), np.int64), np.full(len(bare), unknown)], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1]))]
        self.lengths, self.width = lengths, width
        key = self.rows[:, 1] * LONGEST + self.rows[:, 2]
        self.groups = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)])) if len(key) else np.array([0])

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all segmentations of each beginning of each word, by language, scaled; and the scales' logarithms.

        ``p``: pieces x languages. Every column is divided by the largest value so far, so that long words don't vanish.
        """
        alpha = np.zeros((self.width + 1, len(self.lengths), p.shape[1]))
        alpha[0] = 1
        scale = np.zeros((len(self.lengths), p.shape[1]))
        ends = np.zeros((len(self.lengths), p.shape[1]))
        at = 0
        for a, b in zip(self.groups, self.groups[1:], strict=False):
            word, end, n, piece = self.rows[a:b].T
            if end[0] != at:
                self._close(alpha, scale, ends, at)
                at = end[0]
            alpha[at, word] += alpha[at - n[0], word] * p[piece]
        self._close(alpha, scale, ends, at)
        return alpha, ends

    def _close(self, alpha, scale, ends, at) -> None:
        done = self.lengths == at
        if done.any():
            with np.errstate(divide="ignore"):
                ends[done] = np.log(alpha[at, done]) + scale[done]
        if at and at % 16 == 0:  # rescale what later columns read
            low = max(at - 16, 0)
            top = alpha[low : at + 1].max(0)
            top[top == 0] = 1
            alpha[low : at + 1] /= top
            scale += np.log(top)

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected piece counts of words seen ``counts`` times (words x languages): the E step. For words of SHORT letters."""
        alpha = np.zeros((self.width + 1, len(self.lengths), p.shape[1]))
        alpha[0] = 1
        spans = list(zip(self.groups, self.groups[1:], strict=False))
        for a, b in spans:
            word, end, n, piece = self.rows[a:b].T
            alpha[end[0], word] += alpha[end[0] - n[0], word] * p[piece]
        beta = np.zeros_like(alpha)
        beta[self.lengths, np.arange(len(self.lengths))] = 1
        total = alpha[self.lengths, np.arange(len(self.lengths))]
        weight = np.divide(counts, total, out=np.zeros_like(total), where=total > 0)
        out = np.zeros_like(p)
        for a, b in reversed(spans):
            word, end, n, piece = self.rows[a:b].T
            flow = beta[end[0], word] * p[piece]
            np.add.at(out, piece, alpha[end[0] - n[0], word] * flow * weight[word])
            beta[end[0] - n[0], word] += flow
        return out


class LanguageModel:
    """Piece probabilities by language, and scores of texts. Sent to executors once; caches are each worker's own."""

    def __init__(self, pieces: list[str], languages: list[str], p: np.ndarray):
        self.pieces, self.languages, self.p = pieces, languages, p
        self._start()

    def _start(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            self.automaton.add_word(piece, i * LONGEST + len(piece))
        self.automaton.make_automaton()
        self._forget()

    def _forget(self) -> None:
        """Empty the cache: a word's row in ``logs``."""
        self.cache: dict[str, int] = {}
        self.logs = np.empty((0, len(self.languages)))

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "languages": self.languages, "p": self.p}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._start()

    @classmethod
    def fit(cls, counts: dict[str, Counter], pieces: list[str]) -> LanguageModel:
        """Expectation maximisation on word counts by language."""
        languages = sorted(counts)
        start = np.full((len(pieces) + 1, len(languages)), 1 / len(pieces))
        start[-1] = UNKNOWN
        model = cls(pieces, languages, start)
        words = sorted({w for c in counts.values() for w in c if len(w) < SHORT})
        if not words:
            return model
        seen = np.array([[counts[x][w] for x in languages] for w in words], float)
        order = np.argsort([len(w) for w in words], kind="stable")
        groups = [order[i : i + GROUP] for i in range(0, len(order), GROUP)]
        lattices = [(Lattice([words[i] for i in g], model.automaton, len(pieces)), seen[g]) for g in groups]
        for _ in range(ROUNDS):
            found = sum(x.expected(model.p, n) for x, n in lattices)[:-1]
            total = found.sum(0)
            total[total == 0] = 1
            model.p[:-1] = (1 - SMOOTH) * found / total + SMOOTH / len(pieces)
        return model

    def learn(self, words: list[str]) -> None:
        """Put the log probabilities of ``words`` into the cache."""
        words.sort(key=len)
        short = [w for w in words if len(w) < SHORT]
        groups = [short[i : i + GROUP] for i in range(0, len(short), GROUP)] + [[w] for w in words[len(short) :]]
        if len(self.cache) + len(words) > len(self.logs):
            grown = np.empty((2 * (len(self.cache) + len(words)), len(self.languages)))
            grown[: len(self.cache)] = self.logs[: len(self.cache)]
            self.logs = grown
        for group in groups:
            at = len(self.cache)
            _, self.logs[at : at + len(group)] = Lattice(group, self.automaton, len(self.pieces)).forward(self.p)
            self.cache.update(zip(group, range(at, at + len(group)), strict=True))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        if len(self.cache) > CACHE:
            self._forget()
        counted = [words_of(t) for t in texts]
        new = {w for c in counted for w in c if w not in self.cache}
        if self.languages:
            self.learn(list(new))
        out = []
        for c in counted:
            if not c or not self.languages:
                out.append((UND, 0.0))
                continue
            n = np.fromiter(c.values(), float, len(c))
            rows = np.fromiter(map(self.cache.__getitem__, c), np.int64, len(c))
            logs = n @ self.logs[rows] * min(1, EVIDENCE / n.sum())
            shares = np.exp(logs - logs.max())
            best = int(np.argmax(logs))
            out.append((self.languages[best], float(shares[best] / shares.sum())))
        return out


def held_out(doc_id="doc_id", mod: int = 4, at: int = 2):
    """Fold of a document: crc32 of its id as text. A null id is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % mod == at, F.lit(False))


def train(docs: DataFrame, vocabulary: str | None = None) -> LanguageModel:
    """Learn from the rows of ``docs`` (doc_id, text, lang) outside the fold; their words are counted by Spark, the model fitted here."""
    import public_tokenizers

    pieces = vocabulary_pieces(vocabulary or public_tokenizers.path(VOCABULARY))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    usable = docs.where(F.col("lang").isNotNull() & ~held_out())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n_docs")).limit(MAX_LANGUAGES + 1).collect()
    if len(sizes) > MAX_LANGUAGES:
        raise TooManyLanguages(f"more than {MAX_LANGUAGES} languages")
    # Of a language with many documents only the lowest hashes are ranked: four times as many as are wanted, by expectation.
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 4 * TRAIN_DOCS / r["n_docs"])) for r in sizes], "lang string, share double")
    low = usable.select("doc_id", "lang", order.alias("h")).join(F.broadcast(shares), "lang").where(F.col("h").cast("double") / 2.0**64 + 0.5 <= F.col("share"))
    ranked = low.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("n") <= TRAIN_DOCS)
    chosen = ranked.select(F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang")).dropDuplicates()
    sample = usable.join(F.broadcast(chosen), (usable["doc_id"] == chosen["chosen_id"]) & (usable["lang"] == chosen["chosen_lang"])).select("lang", "text")

    def words(batches):
        import pyarrow as pa

        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text))
            rows = [(x, w, n) for x, c in counts.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    counted = sample.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    top = counted.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= TRAIN_WORDS)
    counts: dict[str, Counter] = {}
    for row in top.collect():  # TRAIN_WORDS * MAX_LANGUAGES at most
        counts.setdefault(row["lang"], Counter())[row["word"]] = row["n"]
    return LanguageModel.fit(counts, pieces)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(ids: list, texts: list) -> dict[str, list]:
        found = shared.value.score(texts)
        return {"doc_id": ids, "lang_pred": [x for x, _ in found], "score": [s for _, s in found]}

    return map_texts(docs, "doc_id long, lang_pred string, score double", rows)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
