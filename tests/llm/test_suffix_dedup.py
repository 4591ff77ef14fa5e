"""Suffix-array deduplication against brute force over all windows, by bytes and by words."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from corpuscle.llm import suffix_dedup
from corpuscle.llm.suffix_dedup import BYTES, PASSAGES, Rule
from tests.llm.conftest import prose


def kept(symbols, length):
    """Which symbols of each sequence a window covers that occurs again."""
    seen = Counter(tuple(s[i : i + length]) for s in symbols for i in range(len(s) - length + 1))
    out = []
    for s in symbols:
        gone = np.zeros(len(s), bool)
        for i in range(len(s) - length + 1):
            if seen[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


def split(text, rule):
    data = (text or "").encode()
    return data.split() if rule.words else data


def marks(doc_id, gone):
    return -1 if doc_id is None else doc_id, np.packbits(gone).tobytes()


@pytest.mark.parametrize("rules", [(BYTES,), (PASSAGES,), (BYTES, PASSAGES), (Rule(True, 6, 2), Rule(False, 40, 8))])
@pytest.mark.parametrize("most_kinds", [0, 2048])
def test_spans_of_odd_documents(odd, odd_rows, monkeypatch, rules, most_kinds):
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", most_kinds)
    rows = suffix_dedup.with_spans(odd, rules).select("doc_id", "text", "spans").collect()
    for n, rule in enumerate(rules):
        gone = kept([split(r[1], rule) for r in odd_rows], rule.length)
        have = sorted(marks(r["doc_id"], suffix_dedup.covered(len(split(r["text"], rule)), r["spans"], n)) for r in rows)
        assert have == sorted(marks(r[0], g) for r, g in zip(odd_rows, gone, strict=True)) and any(g.any() for g in gone)


def test_cut_texts_and_columns_of_clashing_names(spark, odd, odd_rows):
    clashing = odd.withColumns({c: F.lit(7) for c in ("spans", "key_id", "key_hash", "rule", "class", "span_id")})
    for rule in (BYTES, PASSAGES):
        gone = kept([split(r[1], rule) for r in odd_rows], rule.length)
        cut = suffix_dedup.deduplicated(clashing, rule)
        assert cut.columns == clashing.columns and cut.count() == len(odd_rows)
        assert cut.where("spans = 7 and key_id = 7 and key_hash = 7 and rule = 7 and class = 7 and span_id = 7 and _id = 2").count() == len(odd_rows)
        want = []
        for r, mask in zip(odd_rows, gone, strict=True):
            if rule.words or r[1] is None:
                continue
            at = np.cumsum([0] + [len(c.encode()) for c in r[1]])
            want.append("".join(c for c, a, b in zip(r[1], at, at[1:], strict=False) if not mask[a:b].all()))
        if not rule.words:
            assert sorted(r["text"] for r in cut.collect() if r["text"] is not None) == sorted(want)
    for rule in (BYTES, PASSAGES):
        assert suffix_dedup.deduplicated(odd.limit(0), rule).count() == 0


@pytest.mark.parametrize("n", [49, 50, 51, 52, 65, 80])
def test_passages_of_over_50_words_go(spark, n):
    passage = prose(1000 + n, n)
    rows = [(i, f"{prose(i, 30)} {passage}\n{prose(50 + i, 20)}") for i in range(3)] + [(9, prose(99, 300)), (10, None)]
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in pipeline.suffix_dedup_stage(spark, docs, "").collect()}
    assert got[9]["text"] == rows[3][1] and got[10]["text"] is None
    for i, text in rows[:3]:
        assert got[i]["text"] == (text if n <= 50 else text.replace(passage, ""))
        assert got[i]["n_chars"] == len(got[i]["text"])


def test_query_digests(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    data = [t.encode() for t in docs.values()]
    gone = dict(zip(docs, kept([bytes(d) for d in data], 400), strict=True))
    for r in suffix_dedup.op7_suffix_dedup(spark, sf).collect():
        d, mask = np.frombuffer(docs[r["doc_id"]].encode(), np.uint8), gone[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"]) == (len(d), mask.sum(), len(suffix_dedup.runs(mask)))
        assert r["kept_sha256"] == hashlib.sha256(d[~mask].tobytes()).hexdigest()


@pytest.mark.parametrize("rule", [BYTES, PASSAGES])
def test_one_line_in_many_contexts(spark, rule, monkeypatch):
    """A hot anchor: a line in a third of the rows, in other surroundings each, and one passage around it twice."""
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", 5)
    line = prose(3, 20)
    texts = [f"{prose(i, 60)} {line} {prose(500 + i, 60)}" for i in range(40)] + [prose(2000 + i, 90) for i in range(80)]
    texts[30] = f"{prose(4000, 8)} {' '.join(texts[3].split()[20:110])} {prose(4001, 8)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = kept([split(t, rule) for t in texts], rule.length)
    rows = suffix_dedup.with_spans(docs, (rule,)).collect()
    assert sorted(marks(r["doc_id"], suffix_dedup.covered(len(split(r["text"], rule)), r["spans"])) for r in rows) == sorted(marks(i, g) for i, g in enumerate(gone))
    assert sum(g.any() for g in gone) == 2


def test_shards_close_between_anchors(monkeypatch):
    rng = np.random.default_rng(0)
    a, b = (bytes(rng.integers(97, 123, 500, dtype=np.uint8)) for _ in range(2))
    # anchor, class, lead, symbols: the anchor's string stands at one place of each text
    rows = [(1, 10, 120, a), (1, 10, 120, a), (1, 11, 170, b[:50] + a[:450]), (2, 12, 110, b), (2, 13, 110, b + b"x"), (3, 14, 120, a)]
    monkeypatch.setattr(suffix_dedup, "SHARD_SYMBOLS", 900)
    columns = [[0] * 6, [r[0] for r in rows], [0] * 6, [r[1] for r in rows], [0] * 6, [r[2] for r in rows], [r[3] for r in rows]]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in suffix_dedup.SPANS.split(", ")])
    found: dict = {}
    for x in suffix_dedup._sorted_shards((BYTES,))(iter([batch])):
        for anchor, class_, start, end in (r.values() for r in x.to_pylist()):
            found.setdefault((anchor, class_), set()).update(range(start, end))
    assert found.keys() == {(1, 10), (1, 11), (2, 12), (2, 13)}
    assert found[1, 10] >= set(range(51)) and found[2, 12] == found[2, 13] - {101} == set(range(101))


@pytest.mark.parametrize(("rule", "passage"), [(BYTES, prose(71, 90)[:395]), (BYTES, prose(72, 100)[:450]), (BYTES, prose(73, 150)[:600]), (PASSAGES, prose(74, 55))])
def test_one_passage_in_a_third_of_the_rows(spark, monkeypatch, rule, passage):
    """In other surroundings each, so that spans differ: no group that is sorted holds more than MOST_KINDS of them."""
    monkeypatch.setattr(suffix_dedup, "MOST_KINDS", 6)
    texts = [f"{prose(i, 70)} {passage} {prose(500 + i, 70)}" for i in range(40)] + [prose(2000 + i, 90) for i in range(80)]
    texts[30] = f"{prose(4000, 8)} {' '.join(texts[3].split()[40:])} {prose(4001, 8)}"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sorted_shards = suffix_dedup._sorted_shards

    def shards(rules):
        run = sorted_shards(rules)

        def counted(batches):
            rows = list(batches)
            groups = Counter((r["anchor"], r["part"]) for b in rows for r in b.select(["anchor", "part"]).to_pylist())
            assert max(groups.values(), default=0) <= 6, groups.most_common(3)
            yield from run(iter(rows))

        return counted

    monkeypatch.setattr(suffix_dedup, "_sorted_shards", shards)
    gone = kept([split(t, rule) for t in texts], rule.length)
    rows = suffix_dedup.with_spans(docs, (rule,)).collect()
    assert sorted(marks(r["doc_id"], suffix_dedup.covered(len(split(r["text"], rule)), r["spans"])) for r in rows) == sorted(marks(i, g) for i, g in enumerate(gone))
    n = sum(g.any() for g in gone)
    assert n >= 40 if rule.words or len(passage) > 400 else 2 <= n < 20  # a letter of the surroundings may be alike by chance
