"""Mixing: every source at its target, to a word; documents within twice their size; the mix's texts as counted."""

import random
import re

import pytest
from pyspark.sql import functions as F

from corpuscle.llm import mixing
from tests.llm.conftest import prose

SCHEMA = "doc_id long, text string, source string, _row long, _size long, _n long, shard string, h string, name string, quota string"


def size(text):
    return len(re.findall(mixing.WORD, text or ""))


def check(spark, rows):
    docs = spark.createDataFrame([(*r, 333, 444, 555, "s", "h", "n", "q") for r in rows], SCHEMA).repartition(3)
    got = mixing.mixed(docs).toPandas()
    assert sorted(got["size"]) == sorted(size(r[1]) for r in rows)
    assert (got.taken <= 2 * got["size"]).all() and (got.taken >= 0).all()
    for source, g in got.groupby("source", dropna=False):
        assert g["size"].sum() == g.source_size.iloc[0] and g.target.nunique() == 1
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 0.5, source
    order = sorted({r[2] for r in rows}, key=lambda x: (x is None, x or ""))
    words = [sum(size(r[1]) for r in rows if r[2] == s) for s in order]
    want = dict(zip(order, mixing.targets(words), strict=True))
    assert all(want[None if s != s or s is None else s] == pytest.approx(t) for s, t in zip(got.source, got.target, strict=True))

    key = lambda df: sorted(map(str, df[["doc_id", "source", "size", "taken"]].astype(str).itertuples(index=False, name=None)))
    assert key(mixing.mixed(docs.repartition(5)).toPandas()) == key(got)
    texts = mixing.mixed_texts(docs)
    assert texts.columns == docs.columns
    assert texts.where("_row = 333 and _size = 444 and _n = 555 and shard = 's' and h = 'h' and name = 'n' and quota = 'q'").count() == texts.count()
    counted = texts.select("doc_id", F.regexp_count("text", F.lit(mixing.WORD)).alias("n")).toPandas()
    total = lambda df, c: {str(k): v for k, v in df.groupby(df.doc_id.astype("Int64").astype(str))[c].sum().items() if v}
    assert total(counted, "n") == total(got, "taken")
    have = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    for r in texts.where("doc_id is not null").collect():
        words = iter(have[r["doc_id"]])
        assert all(w in words for w in r["text"].split()), "the words of a document, in order"


def test_odd_documents(spark, odd_rows):
    check(spark, [(r[0], r[1], r[3]) for r in odd_rows if r[0] != 26])


def test_small_sources(spark):
    rng = random.Random(4)
    check(spark, [(i, prose(i, i + 1), f"s{i:02}") for i in range(50)])
    check(spark, [(i, prose(i, rng.choice([1, 3, 64, 65, 200])), rng.choice(["a", "b", None, "d"])) for i in range(60)])


def test_many_shards_and_regions(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 100)
    monkeypatch.setattr(mixing, "REGION", 3)
    rng = random.Random(5)
    check(spark, [(i, prose(i, rng.randint(1, 90)), rng.choice(["hot", "hot", "a", None])) for i in range(150)])


def test_null_and_repeated_ids(spark):
    rows = [(None, prose(i, 70), "a") for i in range(20)] + [(7, "the same text " * 20, "b")] * 12 + [(8, None, "c"), (9, "", None)]
    check(spark, rows)


def test_empty_table(none):
    assert mixing.mixed(none).count() == 0 == mixing.mixed_texts(none).count()


def test_shares_settle_in_words():
    assert mixing.shares([10, 10, 10], 0, 15) == ([0, 0, 0], [15, 0, 0])
    assert mixing.shares([130, 5], 3, 200)[1] in ([200, 0], [192, 8], [190, 10])
    for words, quota in (([64, 64, 1], 200), ([1] * 9, 18), ([500, 3], 0), ([40, 300], 680)):
        won, taken = mixing.shares(words, round(quota / mixing.BLOCK), quota)
        assert sum(taken) == quota and all(0 <= t <= 2 * w for t, w in zip(taken, words, strict=True))


@pytest.mark.parametrize("quota", [0, 1, 63, 64, 100, 150, 299, 300])
def test_blocks_of_a_shard_hold_the_quota(quota):
    times, a, b = mixing.block_counts(150, quota, 9)
    sizes = [64, 64, 22]
    assert sum(t * s for t, s in zip(times, sizes, strict=True)) + b - a == quota
    assert a // 64 == max(b - 1, a) // 64 and times.max() <= 2
