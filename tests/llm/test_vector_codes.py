"""Ball trees against all distances, the query against SQL and a plain version."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from corpuscle.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_all_distances(seed):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-4, 4, (int(rng.integers(1, 17)), 3)) if seed % 2 else rng.integers(-4000, 4000, (16, 8))
    entries = np.concatenate([entries, entries[:2]])  # entries that are equal
    parts = np.concatenate([rng.integers(entries.min() - 2, entries.max() + 2, (400, entries.shape[1])), entries])
    found = vector_codes.Search(entries, parts)
    squares = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (found.index == squares.argmin(1)).all()  # ties to the lower index
    assert (found.best == squares.min(1)).all()


def test_balls_are_passed_over():
    rng = np.random.default_rng(3)
    entries = rng.integers(-100, 100, (16, 8)) + 5000 * np.repeat(rng.integers(-3, 4, (4, 8)), 4, axis=0)
    parts = entries[rng.integers(0, 16, 1000)] + rng.integers(-50, 50, (1000, 8))
    assert vector_codes.Search(entries, parts).compared < 0.7 * 16 * 1000


def test_every_entry_lies_in_its_balls():
    entries = np.random.default_rng(4).integers(-9, 9, (16, 4))
    seen = []

    def below(ball):
        rows = [ball.centre] + [e for b in ball.inside for e in below(b)]
        assert all(((entries[e] - entries[ball.centre]) ** 2).sum() <= ball.radius**2 for e in rows)
        seen.append(ball.centre)
        return rows

    assert sorted(below(vector_codes.Ball(entries, np.arange(16)))) == sorted(seen) == list(range(16))


def plainly(rows):
    """rows (vec_id, vector, label) that are kept: codes, errors, codebooks."""
    whole = [[math.floor(4096 * x) for x in v] for _, v, _ in rows]
    size = len(whole[0]) // 8
    seeds = {}
    for (i, _, _), v in sorted(zip(rows, whole, strict=True), key=lambda r: (r[0][0] is None, r[0][0] or 0, r[1])):
        seeds.setdefault(i, v)
    seeds = list(seeds.values())[:16]
    books = [[s[p * size : (p + 1) * size] for s in seeds] for p in range(8)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    cut = [[v[p * size : (p + 1) * size] for p in range(8)] for v in whole]
    for _ in range(6):
        slots = [[best(p, v[p])[1] for p in range(8)] for v in cut]
        books = [[[sum(c) // len(c) for c in zip(*mine, strict=True)] if (mine := [v[p] for v, s in zip(cut, slots, strict=True) if s[p] == k]) else e for k, e in enumerate(books[p])] for p in range(8)]
    codes = [[best(p, v[p]) for p in range(8)] for v in cut]
    return ["".join(f"{k:02x}" for _, k in c) for c in codes], [sum(s for s, _ in c) for c in codes], np.array(books)


def odd_vectors():
    rng = np.random.default_rng(8)
    rows = [(i, np.float32(rng.normal(size=16) * (50 if i == 9 else 1)).tolist(), i % 3 if i % 4 else None) for i in range(40)]
    rows += [(5, rows[5][1], 1), (5, [0.0] * 16, 1), (None, rows[7][1], None), (41, [-0.00001] * 16, 2)]
    dropped = [(50, None, 1), (51, [], 1), (52, [1.0] * 15 + [None], 1), (53, [float("nan")] + [1.0] * 15, 1), (54, [float("-inf")] + [1.0] * 15, None), (55, [1.0] * 8, 1), (56, [1.0] * 15, 1)]
    return rows, dropped


def test_codes_of_odd_vectors(spark, tmp_path):
    rows, dropped = odd_vectors()
    spark.createDataFrame(rows + dropped, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = vector_codes.op12_vector_codes(spark, str(tmp_path)).toPandas()
    codes, errors, books = plainly(rows)
    by_label = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    want = [(i, c, e, by_label[x], vector_codes.codebook_digest(books)) for (i, _, x), c, e in zip(rows, codes, errors, strict=True)]
    got = [(None if pd.isna(r[0]) else int(r[0]), *r[1:]) for r in found[["vec_id", "code", "error", "label_error", "codebooks_sha256"]].itertuples(index=False, name=None)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_decoded_vectors_have_the_errors(spark):
    rows, dropped = odd_vectors()
    vectors = vector_codes.whole_vectors(spark.createDataFrame(rows + dropped, SCHEMA))
    books = vector_codes.fit(vectors)
    found = vector_codes.decoded(vector_codes.encoded(vectors, books), books).toPandas()
    whole = dict(zip([r[0] for r in rows], [np.floor(4096 * np.array(r[1])) for r in rows], strict=True))
    for r in found[found.vec_id.isin([0, 9, 20, 41])].itertuples():
        assert ((whole[r.vec_id] - np.array(r.near)) ** 2).sum() == r.error


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(7, [0.5] * 8, None)], [(2, [1.0, 2.0], 1)]])
def test_few_vectors(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = vector_codes.op12_vector_codes(spark, str(tmp_path)).collect()
    assert [(r.vec_id, r.code, r.error) for r in found] == [(7, "00" * 8, 0)] * (rows[:1] == [(7, [0.5] * 8, None)])


def test_components_too_large_for_sums_are_an_error(spark):
    with pytest.raises(Exception, match="beyond"):
        vector_codes.whole_vectors(spark.createDataFrame([(1, [1e30] * 8, 1)], SCHEMA)).collect()


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got, want = vector_codes.op12_vector_codes(spark, sf).toPandas(), con.sql(vector_codes.OP12_SQL).df()
    rows = lambda df: sorted(df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)
