"""Spans of notices that stand back to back."""

import random
import re

import numpy as np
import pytest

from corpuscle.llm import license_scan


@pytest.mark.parametrize("words", ["mozila public license mozilla public license", "mozilla public license mozila public license", "mozila public license mozilla public license mozila public license"])
def test_misspelt_notice_beside_an_exact_one(words):
    found = license_scan.Scanner().scan(license_scan.word_line(words)[1])[1]
    assert [(first, last, errors) for _, first, last, errors, _ in found] == [(3 * k, 3 * k + 2, int(w == "mozila")) for k, w in enumerate(words.split()[::3])]


def least_edits(notice, line):
    """Fewest edits that turn the notice into some part of the line: a row of the edit table for each letter of the notice."""
    row = np.zeros(len(line) + 1, int)
    letters, steps = np.array(list(line)), np.arange(len(line) + 1)
    for i, c in enumerate(notice, 1):
        new = np.concatenate(([i], np.minimum(row[:-1] + (letters != c), row[1:] + 1)))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


def test_notices_equal_edit_tables():
    """A label is found where an edit table has its notice within the bound, but for what holds fewer pieces unchanged than a seed needs: none here."""
    rng = random.Random(3)
    scanner, found = license_scan.Scanner(), 0
    for _ in range(250):
        notice, _label = rng.choice(license_scan.NOTICES)
        most = max(1, len(notice) // license_scan.ERROR_EVERY)
        letters = list(notice)
        for _ in range(rng.randint(0, most + 2)):
            at = rng.randrange(len(letters))
            letters[at] = rng.choice(["", "x", letters[at] + "q", letters[at]])
        n, line = license_scan.word_line(f"some words before {''.join(letters)} and after it")
        want = {(label, max(1, len(notice) // license_scan.ERROR_EVERY)) for notice, label in license_scan.NOTICES if least_edits(notice, line) <= max(1, len(notice) // license_scan.ERROR_EVERY)}
        got = scanner.scan(line)[1]
        assert {label for label, *_ in got} == {label for label, _ in want}
        for label, first, last, errors, likeness in got:
            assert 0 <= first <= last < n and 0 < likeness <= 1
            exact = [len(t) for t, x in license_scan.NOTICES if x == label and least_edits(t, line) == errors and likeness == 1 - errors / len(t)]
            assert exact
        found += len(got)
    assert found > 100


def test_query_against_words(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = license_scan.op9_licenses(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), docs[r["doc_id"]].encode()))
        places = sorted((i, label) for phrase, label in license_scan.PHRASES for p in [phrase.encode().split()] for i in range(len(words)) if words[i : i + len(p)] == p)
        labels = {label for _, label in places}
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted(labels))
        line = license_scan.word_line(docs[r["doc_id"]])[1]
        own = {x["label"] for x in r["notices"]}
        assert r["labels"] == ",".join(sorted(labels | own)) and 0 <= r["score"] <= 1
        if len(line) < 3000:
            assert own == {label for notice, label in license_scan.NOTICES if least_edits(notice, line) <= max(1, len(notice) // license_scan.ERROR_EVERY)}
