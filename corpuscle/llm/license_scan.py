"""License scans: pigeonhole seeds locate candidates for short notices, bounded-error matching verifies them.

A text becomes its lower-cased words joined by single spaces. A notice may match with up to ``errors`` edits. It is cut into
``errors + PIECES`` pieces: an edit spoils one piece at most, so whatever matches holds PIECES of them unchanged, at offsets that
differ from their own by no more than the edits. One pass of an automaton finds the exact places of all pieces; where PIECES of a
notice lie together so, the regex library's best match within the edit bound gives the errors and the span. Phrases looked for word
by word (``PHRASES``) go through the same automaton, without edits.

Nulls: a null text is empty: no words, no labels, score 0. Repeated rows stay repeated; a very long text is scanned whole in its task;
an empty table gives none. Ties between overlapping matches of a notice go to the fewest errors, then the earliest.
"""

from __future__ import annotations

import functools

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from corpuscle.llm.tables import load, map_texts

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Short notices that may be misspelt, and their labels: one edit for each ERROR_EVERY characters.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("apache software license", "apache"),
    ("creative commons attribution", "cc-by"),
    ("licensed under the gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("released under the mit license", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("mozilla public license", "mpl"),
    ("all rights reserved", "proprietary"),
)
ERROR_EVERY = 15
#: Pieces that a match holds unchanged.
PIECES = 2
#: What is not part of a word becomes a space, A-Z become a-z, bytes of other characters stay.
_WORDS = bytes(b if b >= 128 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))


def word_line(text: str | None) -> tuple[int, str]:
    """Number of words; the words, each between single spaces, one character a byte."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    return len(words), (b" " + b" ".join(words) + b" ").decode("latin-1") if words else " "


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """``errors + PIECES`` pieces of ``notice`` of nearly equal length, with their offsets."""
    n = errors + PIECES
    at = [len(notice) * i // n for i in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(at, at[1:], strict=False)]


def windows(places: list[tuple[int, int]], length: int, errors: int) -> list[tuple[int, int]]:
    """Spans of a line that may hold a match, from sorted (start of the notice if unedited, offset of the piece)."""
    out, group = [], []
    for place in [*places, None]:
        if group and (place is None or place[0] - group[-1][0] > 2 * errors):
            if len({offset for _, offset in group}) >= PIECES:
                span = max(0, group[0][0] - errors), group[-1][0] + length + errors
                if out and span[0] <= out[-1][1]:
                    span = out.pop()[0], span[1]
                out.append(span)
            group = []
        group.append(place)
    return out


class Scanner:
    def __init__(self, phrases=PHRASES, notices=NOTICES):
        found: dict[str, list[tuple]] = {}
        for phrase, label in phrases:
            found.setdefault(f" {phrase} ", []).append((label, None, 0))
        self.notices = []
        for notice, label in notices:
            errors = max(1, len(notice) // ERROR_EVERY)
            pattern = regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}")
            for offset, piece in pieces(notice, errors):
                found.setdefault(piece, []).append((label, len(self.notices), offset))
            self.notices.append((label, len(notice), errors, pattern))
        self.automaton = ahocorasick.Automaton()
        for piece, what in found.items():
            self.automaton.add_word(piece, (len(piece), what))
        self.automaton.make_automaton()

    def scan(self, line: str) -> tuple[list[tuple[int, str]], list[tuple[str, int, int, int, float]]]:
        """Phrases as (first word, label); notices as (label, first word, last word, errors, likeness)."""
        phrases, seeds = [], {}
        blanks = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
        word = lambda at: int(np.searchsorted(blanks, at))  # blanks before a place
        for end, (n, what) in self.automaton.iter(line):
            for label, notice, offset in what:
                at = end - n + 1
                if notice is None:
                    phrases.append((word(at), label))
                else:
                    seeds.setdefault(notice, []).append((at - offset, offset))
        matches = []
        for notice, places in seeds.items():
            label, length, errors, pattern = self.notices[notice]
            for a, b in windows(sorted(places), length, errors):
                ranges = [(a, min(b, len(line)))]  # the best match of a range comes first; what lies before and after it is searched as well
                while ranges:
                    a, b = ranges.pop()
                    if b - a < length - errors or not (m := pattern.search(line, a, b)):
                        continue
                    wrong = sum(m.fuzzy_counts)
                    first, last = word(m.start() + (line[m.start()] == " ")) - 1, word(m.end() - (line[m.end() - 1] == " ")) - 1
                    matches.append((label, first, last, wrong, 1 - wrong / length))
                    ranges += [(a, m.start()), (m.end(), b)]
        return sorted(phrases), sorted(matches, key=lambda x: (x[1], x[2], x[0]))


@functools.lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


def licenses(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: n_words, the phrases (word, label) and the notices (label, words from and to, errors, score)."""

    def rows(ids: list, texts: list) -> dict[str, list]:
        lines = [word_line(t) for t in texts]
        found = [scanner().scan(line) for _, line in lines]
        return {
            "doc_id": ids,
            "n_words": [n for n, _ in lines],
            "phrases": [[{"word": w, "label": x} for w, x in p] for p, _ in found],
            "notices": [[{"label": x, "first": a, "last": b, "errors": e, "score": s} for x, a, b, e, s in m] for _, m in found],
        }

    return map_texts(docs, "doc_id long, n_words long, phrases array<struct<word: long, label: string>>, notices array<struct<label: string, first: long, last: long, errors: int, score: double>>", rows)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    found = licenses(load(spark, sf_dir, "documents"))
    joined = lambda labels: F.array_join(F.sort_array(F.array_distinct(labels)), ",")
    base, own = F.col("phrases.label"), F.col("notices.label")
    return found.select(
        "doc_id",
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min("phrases.word").alias("first_word"),
        F.array_max("phrases.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.coalesce(F.array_max("notices.score"), F.lit(0.0))).alias("score"),
        "notices",
    )
