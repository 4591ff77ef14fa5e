"""Cross-tokenizer alignment: groups of tokens of two tokenizers that end at the same byte, and how often their tokens are linked.

A text is encoded with a space before it by A, a byte-level BPE, and by B, a byte-fallback BPE. A label string has a letter for each byte:
whether no token ends there, one of A, one of B, or one of each. A regular expression scans it for spans up to each letter of the last kind;
the letters of a span tell how many tokens of A and of B make its group, and the two tokens at its end are a link.

Work is done by fragment: a text is cut where a character that is no white space is followed by white space. Neither tokenizer has a token
across such a place (A splits there by its pattern; B's pieces are looked through when it is loaded), so fragments are encoded alone, both
tokenizers have an end there and no group lies across. What a fragment gives is kept in a bounded cache. Texts for which that does not hold
(a white-space piece that B's vocabulary joins to what stands before it) are one fragment.

Counts of links are those of the whole corpus. Slices of documents, blocks, are counted as they are made: a block's row has each of its
distinct links once, so a link that every document has is one row a block when counts are shuffled, and comes back to each block once. There
documents look their links up. Nothing is broadcast or collected; a block holds as many documents as an Arrow batch has, TEXT_ROWS at most.

Nulls: null and empty texts have no tokens, nor have texts whose tokens' bytes differ from the text with its space, such as ones that hold
U+2581 themselves: zeros and an empty string. Strings of special tokens are plain text. Repeated rows stay repeated and are counted as often.
Rows with a null doc_id are treated like others. An empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm.bpe import ALPHABET, FOREIGN, vocabulary_path
from corpuscle.llm.tables import keep, load, scratch, small_batches

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Fragments that a Python worker keeps, the longest of them in characters, and how many are learned at a time.
CACHE, LONGEST, LEARN = 300_000, 64, 4096
#: Links that are kept, a fragment.
LINKS = 16
#: White space in the sense of A's pattern.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
FRAGMENT = re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
ACROSS = re.compile(f"[^{BLANK}][{BLANK}]")
#: Labels of a byte: no token ends there, one of A, one of B, one of each.
NONE, A_END, B_END, BOTH = range(4)
SPAN = re.compile(rb"[^%c]*%c" % (BOTH, BOTH))
SPACE = "\u2581"
#: A link is A's id, then B's in so many bits.
B_BITS = 32
#: A's pattern where all letters are below U+0250.
_SIGNS = {kind: re.escape("".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == kind)) for kind in "LN"}
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_SIGNS['L']}]+| ?[{_SIGNS['N']}]+| ?[^{BLANK}{_SIGNS['L']}{_SIGNS['N']}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+")


class Aligned(NamedTuple):
    """A text's groups: numbers of tokens, the groups as texts of one or more, the links in their order."""

    n_a: int
    n_b: int
    groups: list[str]
    links: np.ndarray


class Aligner:
    """Both tokenizers and the fragments seen: one a Python worker. A fragment's number leads to what it gives, which lies in flat arrays."""

    def __init__(self, a_path: str, b_path: str, cache: int = CACHE):
        import sentencepiece
        from tokenizers import Tokenizer, models

        self.a, self.b, self.cache = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), cache
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)["model"]
        self.a_words = models.BPE(vocab=spec["vocab"], merges=[tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in spec["merges"]])
        byte = {chr(shown): raw for raw, shown in ALPHABET.items()}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (1 + max(vocabulary.values()))
        for token, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.lengths = [np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes)]
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.space = self.b.piece_to_id(SPACE)
        # White space that some piece has after another character: fragments may not begin there.
        plain = [p.replace(SPACE, " ") for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        bound = {x[1] for p in plain for x in ACROSS.findall(p)}
        # Nor is B asked about a fragment alone that begins with white space which joins the space that B puts before it.
        bound |= {x[1] for p in plain for x in re.findall(f" [{BLANK}]", p) if x[1] != " "}
        self.bound = re.compile(f"[{re.escape(''.join(sorted(bound)))}]") if bound else None
        self._forget()

    def _forget(self) -> None:
        """No fragments: of the n-th one the numbers of tokens (-1: they don't spell it), its groups, and where its links end."""
        self.known: dict[str, int] = {}
        self.n_a, self.n_b, self.groups = array("q"), array("q"), []
        self.links, self.ends = array("q"), array("q", [0])

    def fragments(self, text: str) -> list[str]:
        """The text with a space before it, cut where neither tokenizer has a token across."""
        text = " " + text
        return [text] if self.bound and self.bound.search(text) else FRAGMENT.findall(text)

    def _a_ids(self, fragments: list[str]) -> list[list[int]]:
        """Words of letters below U+0250 go to A's merges at once; the library cuts others."""
        tokenize, out = self.a_words.tokenize, []
        for f in fragments:
            if FOREIGN.search(f):
                out.append(self.a.encode(f, add_special_tokens=False).ids)
            else:
                out.append([t.id for w in WORD.findall(f) for t in tokenize(w.encode().decode("latin-1").translate(ALPHABET))])
        return out

    def _b_ids(self, fragments: list[str]) -> list[list[int]]:
        """B puts a space before what it is given: that is the fragment's own first one, or it goes again."""
        found = self.b.encode([f[1:] if f[0] == " " else f for f in fragments], num_threads=1)
        for k, f in enumerate(fragments):
            if f == " ":
                found[k] = [self.space]  # an empty text gets no space before it
            elif f[0] != " ":
                found[k] = found[k][1:] if found[k][:1] == [self.space] else [self.b.unk_id()]
        return found

    def learn(self, fragments: list[str]) -> None:
        """Add ``fragments`` at the end of the arrays, in their order."""
        if fragments:
            raw = [f.encode("utf-8", "surrogatepass") for f in fragments]
            self._scan(raw, self._a_ids(fragments), self._b_ids(fragments))

    def _scan(self, raw: list[bytes], a: list[list[int]], b: list[list[int]]) -> None:
        """One label string and one scan for many fragments: both tokenizers have an end at the end of each."""
        a_all, b_all = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        joined, ends = b"".join(raw), np.cumsum([len(x) for x in raw])
        last = [np.cumsum(table[ids]) for table, ids in zip(self.lengths, (a_all, b_all), strict=True)]
        stops = [np.cumsum([len(x) for x in ids]) for ids in (a, b)]
        spelt = b"".join(map(self.a_bytes.__getitem__, a_all)) == joined == b"".join(map(self.b_bytes.__getitem__, b_all))
        if not (spelt and all((s[0] > 0) and (last_[s - 1] == ends).all() for s, last_ in zip(stops, last, strict=True))):
            if len(raw) > 1:  # some fragment's tokens don't spell it: which one?
                half = len(raw) // 2
                self._scan(raw[:half], a[:half], b[:half])
                self._scan(raw[half:], a[half:], b[half:])
            else:
                self.n_a.append(-1)
                self.n_b.append(-1)
                self.groups.append("")
                self.ends.append(self.ends[-1])
            return
        labels = np.zeros(len(joined), np.uint8)
        labels[last[0] - 1] = A_END
        labels[last[1] - 1] += B_END
        names, groups, i, j = self.names, [], 0, 0
        for span in SPAN.findall(labels.tobytes()):
            to_i, to_j = i + span.count(A_END) + 1, j + span.count(B_END) + 1
            x = names[a_all[i]] if to_i == i + 1 else ",".join([names[k] for k in a_all[i:to_i]])
            y = names[b_all[j]] if to_j == j + 1 else ",".join([names[k] for k in b_all[j:to_j]])
            groups.append(f"{x}|{y}")
            i, j = to_i, to_j
        both = np.flatnonzero(labels == BOTH) + 1
        at = [np.searchsorted(ends_, both) for ends_ in last]
        made = (np.array(a_all)[at[0]] << B_BITS) | np.array(b_all)[at[1]]
        cuts = np.searchsorted(both, ends, side="right")
        self.links.frombytes(made.astype(np.int64).tobytes())
        self.ends.frombytes((self.ends[-1] + cuts).astype(np.int64).tobytes())
        self.n_a.extend([len(x) for x in a])
        self.n_b.extend([len(x) for x in b])
        start = 0
        for cut in cuts.tolist():
            self.groups.append(groups[start] if cut == start + 1 else ";".join(groups[start:cut]))
            start = cut

    def align(self, texts: list[str | None]) -> list[Aligned]:
        """What each text gives; nothing where it has no tokens."""
        cut = [self.fragments(t) if t else [] for t in texts]
        if len(self.known) > self.cache or len(self.links) > LINKS * self.cache:  # long fragments leave links alone
            self._forget()
        known = self.known
        new = sorted(set().union(*cut) - known.keys())
        for at in range(0, len(new), LEARN):
            some = new[at : at + LEARN]
            known.update(zip(some, range(len(self.n_a), len(self.n_a) + len(some)), strict=True))
            self.learn(some)
        n_a, n_b, links, ends = (np.frombuffer(x, np.int64) for x in (self.n_a, self.n_b, self.links, self.ends))
        out = []
        for fs in cut:
            numbers = list(map(known.__getitem__, fs))
            at = np.array(numbers, np.int64)
            if not numbers or n_a[at].min() < 0:
                out.append(Aligned(0, 0, [], np.empty(0, np.int64)))
                continue
            counts = ends[at + 1] - ends[at]
            starts = np.cumsum(counts) - counts
            places = np.repeat(ends[at] - starts, counts) + np.arange(counts.sum())
            out.append(Aligned(int(n_a[at].sum()), int(n_b[at].sum()), list(map(self.groups.__getitem__, numbers)), links[places]))
        del n_a, n_b, links, ends  # arrays that are looked at can't grow
        for f in [f for f in new if len(f) > LONGEST]:
            self.groups[known.pop(f)] = ""
        return out


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and groups array<struct<a array<int>, b array<int>>> of every row: the groups themselves."""
    a_path, b_path = a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)
    schema = "doc_id long, groups array<struct<a:array<int>,b:array<int>>>"
    ids = lambda side: [int(x) for x in side.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
        for part in chain.from_iterable(map(small_batches, batches)):
            made = aligner(a_path, b_path).align(part.column(1).to_pylist())
            groups = [[dict(zip("ab", map(ids, g.split("|")), strict=True)) for f in t.groups for g in f.split(";")] for t in made]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(groups, kind)], names=["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


#: A row a document, and one a block (is_block) whose links are those of its documents together.
ROW = "is_block boolean, block long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<long>, times array<long>"
_LONG = pa.int64()
ARROW_ROW = pa.schema(list(zip(("is_block", "block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times"), (pa.bool_(), *[_LONG] * 5, pa.string(), pa.list_(_LONG), pa.list_(_LONG)), strict=True)))


def _blocks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Rows of ROW. A block's number is its partition's and its place there."""
    def rows(block: int, ids: list, texts: list) -> pa.RecordBatch:
        out = []
        for doc_id, found in zip(ids, aligner(a_path, b_path).align(texts), strict=True):
            links, times = np.unique(found.links, return_counts=True)
            digest = hashlib.sha256(";".join(found.groups).encode()).hexdigest() if found.groups else ""
            out.append((False, block, doc_id, found.n_a, found.n_b, len(found.links), digest, links, times))
        links, which = np.unique(np.concatenate([r[7] for r in out]), return_inverse=True)
        times = np.zeros(len(links), np.int64)
        np.add.at(times, which, np.concatenate([r[8] for r in out]))
        out.append((True, block, None, 0, 0, 0, None, links, times))
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), ARROW_ROW, strict=True)], schema=ARROW_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for part in chain.from_iterable(map(small_batches, batches)):
            if part.num_rows:
                yield rows(block, part.column(0).to_pylist(), part.column(1).to_pylist())
                block += 1

    return _texts(docs).mapInArrow(run, ROW)


def link_counts(blocks: DataFrame) -> DataFrame:
    """link, n (how many links of the corpus hold the pair), best (whether that is the highest of its B id)."""
    pairs = blocks.where("is_block").select(F.explode(F.arrays_zip("links", "times")).alias("x"))
    counts = pairs.groupBy(F.col("x.links").alias("link")).agg(F.sum(F.col("x.times").cast("long")).alias("n"))
    counts = counts.withColumn("b", F.col("link").bitwiseAND((1 << B_BITS) - 1))
    highest = counts.groupBy(F.col("b").alias("b_id")).agg(F.max("n").alias("highest"))
    return counts.join(highest, counts["b"] == highest["b_id"]).select("link", "n", (F.col("n") == F.col("highest")).alias("best"))


def _looked_up(docs: pa.Table, counts: pa.Table) -> pa.Table:
    """A block's documents with the counts of their links."""
    links, n, best = (counts.column(c).to_numpy(zero_copy_only=False) for c in ("link", "n", "best"))
    order = np.argsort(links)
    links, n, best = links[order], n[order], best[order]
    n_best, count_sum = [], []
    for found, times in zip(docs.column("links"), docs.column("times"), strict=True):
        times = times.values.to_numpy().astype(np.int64)
        at = np.searchsorted(links, found.values.to_numpy())
        n_best.append(int(times[best[at]].sum()))
        count_sum.append(int((times * n[at]).sum()))
    made = docs.select(["doc_id", "n_a", "n_b", "n_groups"])
    made = made.append_column("n_links", docs.column("n_groups")).append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return made.append_column("groups_sha256", docs.column("groups_sha256"))


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links (a link ends each group), n_best, count_sum, groups_sha256 for every row of ``docs``."""
    with scratch(docs.sparkSession):
        blocks = keep(_blocks(docs, a_path or vocabulary_path(A_FILE), b_path or vocabulary_path(B_FILE)), "aligned", outer=True)
        counts = keep(link_counts(blocks), "links", outer=True)
    asked = blocks.where("is_block").select(F.col("block").alias("to"), F.explode("links").alias("link"))
    answers = asked.join(counts, "link").select("to", "link", "n", "best")
    rows = blocks.where("not is_block").select("block", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(answers.groupBy("to")).applyInArrow(_looked_up, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(load(spark, sf_dir, "documents"))
