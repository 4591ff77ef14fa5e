"""Near copies against brute force over five-word shingles."""

import random

import pandas as pd

import corpus_pipeline as pipeline
from corpuscle.llm import near_copies
from tests.llm.conftest import SCHEMA, prose, row


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def classes(texts):
    sets, parent = [grams(t) for t in texts], list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= 0.8 - 1e-9:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(texts))]


def edited(rng, text, n):
    """``text`` with ``n`` words changed, far from one another."""
    words = text.split()
    step = len(words) // n
    for k in range(n):
        words[k * step + rng.randrange(max(1, step - 5))] = f"changed{rng.randrange(10**9)}"
    return " ".join(words)


def test_stage_finds_copies_with_edited_words(spark):
    rng, texts = random.Random(5), []
    for k in range(12):
        base = prose(500 + k, 300)
        texts += [base, edited(rng, base, 2), edited(rng, base, 6), edited(rng, base, 16)]
    near = [jaccard(grams(texts[i]), grams(texts[i + k])) for i in range(0, len(texts), 4) for k in (1, 2)]
    assert min(near) < 0.85
    assert max(near) > 0.9
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = sorted(r.doc_id for r in pipeline.near_dedup_stage(spark, docs, "").collect())
    assert got == sorted(set(classes(texts)))
    assert len(got) == 24


def test_components_equal_brute_force(spark, none):
    """Chains whose ends are far apart, texts of few words and of none."""
    rng, texts = random.Random(8), ["one two", "One  two", "one three", "", None]
    for k in range(6):
        text = prose(700 + k, 120)
        for _ in range(8):
            text = edited(rng, text, rng.randint(1, 3))
            texts.append(text)
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = near_copies.near_copies(docs).toPandas()
    want = pd.Series(classes(texts))
    ids = got.groupby("root").doc_id.apply(lambda x: tuple(sorted(x)))
    assert sorted(ids) == sorted(want.groupby(want).apply(lambda x: tuple(sorted(x.index))))
    assert near_copies.near_copies(none).count() == 0


def test_a_row_of_each_component_stays_under_null_and_repeated_ids(spark):
    alone, pair, named = [prose(900 + k, 60) for k in range(5)], prose(910, 60), prose(911, 60)
    rows = [row(None, t) for t in alone] + [row(None, pair), row(None, "Tail " + pair), row(None, named), row(40, named)]
    # Two texts share id 7; one of them is the only representative of its component.
    shared, other = prose(912, 60), prose(913, 60)
    rows += [row(7, shared), row(7, other), row(9, other), row(7, other)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text.removeprefix("Tail ")) for r in pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == sorted([(-1, t) for t in alone] + [(-1, pair), (40, named), (7, shared), (7, other)])


def test_a_group_on_one_template(spark, monkeypatch):
    """Copies of a text that isn't among them, most of them just below the threshold to one another: blocks of a bucket meet pair by pair."""
    monkeypatch.setattr(near_copies, "BLOCK", 8)
    rng, base = random.Random(12), prose(950, 300)
    texts = [edited(rng, base, rng.choice([2, 4, 4, 5])) for _ in range(40)]
    docs = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], SCHEMA)
    got = near_copies.near_copies(docs).toPandas()
    want = pd.Series(classes(texts))
    assert sorted(got.groupby("root").doc_id.apply(lambda x: tuple(sorted(x)))) == sorted(want.groupby(want).apply(lambda x: tuple(sorted(x.index))))
    assert 1 < want.nunique() < 40
