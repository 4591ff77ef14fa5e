"""BPE encoding and decoding by forced boundaries.

A pair of bytes that stands inside no vocabulary token can never be joined by a merge, so a text may be cut there for certain, the
fragments encoded independently and the ids concatenated. Cuts lie

* at white space, which this vocabulary's texts lose: no token holds any, and neither normaliser nor splitter looks across it;
* where the splitter ends a word: it forms each word alone;
* inside a word, at every pair of neighbouring bytes that the table of the vocabulary's inner pairs lacks.

The tokenizers library's merges encode a fragment; one that does not end its word goes to the same merges without the word-end
suffix. What a word gives is kept in a bounded cache. Texts of letters below U+0250 are lower-cased and split by a pattern here; at
other characters the library's normaliser and splitter do it, fragment by fragment. Vocabulary files are read at the path given, on
each executor.

Nulls: a null text is empty: no ids, an empty decoded text. Strings of special tokens in a text are those tokens, as in the library.
Repeated rows stay repeated; very long texts are one list of words at a time; an empty table gives none.
"""

from __future__ import annotations

import functools
import hashlib
import json
import operator
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer, models

from corpuscle.llm.tables import load, map_texts

VOCABULARY = "word_bpe_49k.json"
#: Words that a Python worker keeps.
CACHE = 200_000
#: White space in the sense of the file's patterns.
_BLANK = "\t\n\x0b\x0c\r \x85\xa0"
SPACE = re.compile(f"[{_BLANK}\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Characters whose composed form is themselves and whose lower case needs no context.
FOREIGN = re.compile("[^\x00-\u024f]")
_LETTER, _NUMBER = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_BLANK}{_LETTER}{_NUMBER}]+")
#: The byte alphabet of byte-level vocabularies: printable Latin-1 stands for itself, other bytes for U+0100 on.
_SELF = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: b if b in _SELF else 256 + n for n, b in enumerate([b for b in range(256) if b not in _SELF] + _SELF)}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """What each word gives, made when first asked for; emptied when full."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size = make, size

    def __missing__(self, word: str):
        found = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.size:
                self.clear()
            self[word] = found
        return found


class ForcedBoundaryBpe:
    """Encoder and decoder of a word-end BPE tokenizer file, by fragments."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        self.whole = Tokenizer.from_file(path)
        self.specials = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        vocab, merges = model["vocab"], [tuple(x) for x in model["merges"]]
        self.inside = models.BPE(vocab=vocab, merges=[x for x in merges if not x[1].endswith(self.end)])
        self.last = models.BPE(vocab=vocab, merges=merges, end_of_word_suffix=self.end)
        #: Neighbours inside some token: all other pairs are forced boundaries.
        self.pairs = {a + b for t in vocab for w in [t.removesuffix(self.end)] for a, b in zip(w, w[1:], strict=False)}
        self.tokens = {i: t for t, i in self.whole.get_vocab(with_added_tokens=True).items()}
        self.known = _Words(self.word_strings, cache)
        self.packed = _Words(self.word_bytes, cache)

    def words(self, text: str) -> list[str]:
        """Normalised words of ``text``, as the file's splitter forms them; special tokens as they stand."""
        if "<|" not in text and not FOREIGN.search(text):
            return WORD.findall(text.lower())
        out = []
        for fragment in SPACE.split(text):
            for piece in self.marks.split(fragment) if "<|" in fragment else [fragment]:
                if piece in self.specials:
                    out.append(piece)
                elif not FOREIGN.search(piece):
                    out += WORD.findall(piece.lower())
                else:
                    normal = self.whole.normalizer.normalize_str(piece)
                    out += (normal[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(normal))
        return out

    def cut(self, word: str) -> list[str]:
        """``word``, in the byte alphabet, cut at its forced boundaries."""
        pairs = self.pairs
        at = [i for i, p in enumerate(map(operator.add, word, word[1:]), 1) if p not in pairs]
        return [word[a:b] for a, b in zip([0, *at], [*at, len(word)], strict=True)] if at else [word]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of ``words``."""
        if word in self.specials:
            return [self.specials[word]]
        *heads, tail = self.cut(word if word.isascii() and word.isprintable() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(ALPHABET))
        return [t.id for x in heads for t in self.inside.tokenize(x)] + [t.id for t in self.last.tokenize(tail)]

    def word_strings(self, word: str) -> tuple[str, str]:
        """The ids and the tokens of a word, both joined by a space."""
        ids = self.encode_word(word)
        return " ".join(map(str, ids)), self.decode(ids)

    def word_bytes(self, word: str) -> bytes:
        """The ids of a word, four bytes each; the strings of a word, which digests need, take more."""
        return np.array(self.encode_word(word), np.int32).tobytes()

    def ids(self, text: str | None) -> np.ndarray:
        packed = self.packed
        return np.frombuffer(b"".join([packed[w] for w in self.words(text or "")]), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder: tokens joined by a space; ids without a token are passed over."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids; the ids joined by a space; the decoded text."""
        known = self.known
        parts = [known[w] for w in self.words(text or "")]
        ids = " ".join([p[0] for p in parts])
        return ids.count(" ") + 1 if ids else 0, ids, " ".join([p[1] for p in parts])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBpe:
    """One encoder a Python worker and file."""
    return ForcedBoundaryBpe(path)


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the encoding itself."""
    path = path or vocabulary_path()

    def rows(doc_ids: list, texts: list) -> dict[str, list]:
        ids = [encoder(path).encode(t) for t in texts]
        return {"doc_id": doc_ids, "ids": ids, "decoded": [encoder(path).decode(x) for x in ids]}

    return map_texts(docs, "doc_id long, ids array<int>, decoded string", rows)


def encoding_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encoded`` gives, as counts and hashes."""
    path = path or vocabulary_path()

    def rows(doc_ids: list, texts: list) -> dict[str, list]:
        made = [encoder(path).digest(t) for t in texts]
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        return {"doc_id": doc_ids, "n_tokens": [n for n, _, _ in made], "ids_sha256": [sha(x) for _, x, _ in made], "decoded_sha256": [sha(x) for _, _, x in made]}

    return map_texts(docs, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(load(spark, sf_dir, "documents"))
