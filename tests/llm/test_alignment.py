"""Groups and links against both libraries on whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from corpuscle.llm import alignment

#: Letters, white space of all kinds, and what either tokenizer treats in its own way.
CHARACTERS = [*"abcde'sdt.,;!<>|0123 \n\t\r\x0b\x0c\x1c\x85\xa0    　\xe9\xf1日本\xaa\xb2́﻿ﬁ\x00", " ", " ", "  ", "\n\n", "\r\n", " '", "'ll", "<s>", "<|endoftext|>", "▁", "the", "The ", "<0x41>", "\U0001f469‍\U0001f469"]


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(alignment.vocabulary_path(alignment.A_FILE), alignment.vocabulary_path(alignment.B_FILE))


def plainly(aligner, text):
    """(a ids, b ids) of each group of a text, from encoding it whole; None where it has no tokens."""
    if not text:
        return None
    a, b = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text)
    raw = [[table[i] for i in ids] for table, ids in ((aligner.a_bytes, a), (aligner.b_bytes, b))]
    if not b"".join(raw[0]) == (" " + text).encode() == b"".join(raw[1]):
        return None
    ends = [[sum(map(len, tokens[: k + 1])) for k in range(len(tokens))] for tokens in raw]
    groups, i, j = [], 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        to_i, to_j = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:to_i], b[j:to_j]))
        i, j = to_i, to_j
    return groups


def written(groups):
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def test_any_characters(aligner):
    rng = random.Random(3)
    texts = ["".join(rng.choices(CHARACTERS, k=rng.randint(1, 25))) for _ in range(4000)]
    found = [";".join(t.groups) or None for t in aligner.align(texts)]
    want = [None if (g := plainly(aligner, t)) is None else written(g) for t in texts]
    assert found == want
    assert sum(w is None for w in want) > 100


def test_every_character_at_a_fragment_s_edge(aligner):
    signs = [chr(c) for c in range(0x2070)] + ["　", "﻿"]
    texts = [t for c in signs for t in (f"a{c} b", f"a {c}  b{c}", f"{c}\n{c} {c}")]
    found = [";".join(t.groups) or None for t in aligner.align(texts)]
    assert found == [None if (g := plainly(aligner, t)) is None else written(g) for t in texts]


def test_a_small_cache_changes_nothing(aligner, odd_rows):
    small = alignment.Aligner(alignment.vocabulary_path(alignment.A_FILE), alignment.vocabulary_path(alignment.B_FILE), cache=3)
    texts = [r[1] for r in odd_rows]
    for t in texts:
        (x,), (y,) = small.align([t]), aligner.align([t])
        assert x[:3] == y[:3] and x.links.tolist() == y.links.tolist()


def expected(aligner, rows):
    groups = [(i, plainly(aligner, t) or []) for i, t in rows]
    counts = Counter((a[-1], b[-1]) for _, g in groups for a, b in g)
    highest: dict = {}
    for (_, b), n in counts.items():
        highest[b] = max(highest.get(b, 0), n)
    out = []
    for i, g in groups:
        links = [(a[-1], b[-1]) for a, b in g]
        sha = hashlib.sha256(written(g).encode()).hexdigest() if g else ""
        out.append((i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(g), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


COLUMNS = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


@pytest.mark.parametrize("rows_at_once", [512, 3])
def test_odd_documents(spark, odd, none, odd_rows, aligner, monkeypatch, rows_at_once):
    monkeypatch.setattr("corpuscle.llm.tables.TEXT_ROWS", rows_at_once)
    extra = [(100, "▁ is no space"), (101, "two\rlines"), (102, "  spaces  about \n\n"), (103, "x"), (103, "x")]
    docs = odd.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(i, t, "en") for i, t in extra], "doc_id long, text string, lang string"))
    found = alignment.aligned(docs)
    assert found.columns == COLUMNS
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == expected(aligner, [(r[0], r[1]) for r in odd_rows] + extra)
    assert next(r for r in got if r[0] == 100)[1:] == (0, 0, 0, 0, 0, 0, "")
    assert alignment.aligned(none).count() == 0


def test_groups_as_arrays(odd, odd_rows, aligner):
    found = sorted((str(r.doc_id), [(list(g.a), list(g.b)) for g in r.groups]) for r in alignment.alignments(odd).collect())
    assert found == sorted((str(r[0]), plainly(aligner, r[1]) or []) for r in odd_rows)


def test_links_are_counted_once_a_block(odd):
    blocks = alignment._blocks(odd, alignment.vocabulary_path(alignment.A_FILE), alignment.vocabulary_path(alignment.B_FILE)).toPandas()
    for _, rows in blocks.groupby("block"):
        whole = rows[rows.is_block].iloc[0]
        assert len(set(whole.links)) == len(whole.links)
        assert sum(whole.times) == rows[~rows.is_block].n_groups.sum()
