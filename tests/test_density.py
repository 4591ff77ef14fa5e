"""Neighbour lists, merge trees and chosen clusters against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring
from corpuscle.operators import density, neighbours, ordered, vectors


def plain_lists(rows, k):
    """(a, b, distance, rank) from all pairs of (tenant, id, vector)."""
    out = []
    for t, a, x in rows:
        x = np.array(x, np.float64)
        near = []
        for u, b, y in rows:
            if u == t and b != a:
                y = np.array(y, np.float64)
                near.append((round(float(np.linalg.norm(x / np.linalg.norm(x) - y / np.linalg.norm(y))), 6), b))
        out += [(t, a, b, d, n + 1) for n, (d, b) in enumerate(sorted(near)[:k])]
    return out


def plain_clusters(lists):
    """Clusters of one tenant's lists by building the merge tree and going up it."""
    core = {}
    for _, a, _, d, rank in lists:
        if rank <= density.CORE:
            core[a] = max(core.get(a, 0), d)
    length = {}
    for _, a, b, d, _ in lists:
        e = (min(a, b), max(a, b))
        length[e] = max(min(d, length.get(e, (math.inf,))[0] if e in length else d), 0), 0
        length[e] = (d, 0)
    edges = sorted((max(d, core[a], core[b], density.FLOOR), a, b) for (a, b), (d, _) in length.items())
    root = {v: v for v in core}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    node = {v: (None, [v], None, None) for v in core}  # of each component: length, members, its two parts
    for w, a, b in edges:
        x, y = find(a), find(b)
        if x != y:
            node[x] = (w, node[x][1] + node[y][1], node[x], node[y])
            root[y] = x
    trees = [node[v] for v in core if find(v) == v]
    big = [t for t in trees if len(t[1]) > 1]

    def settle(part, born, eligible):
        """(best value, chosen member sets) of the cluster that starts at ``part``, split off at rate ``born``."""
        stability = 0.0
        while True:
            w, members, left, right = part
            rate = 1 / w
            sides = [s for s in (left, right) if len(s[1]) > 1]
            stability += (rate - born) * (len(left[1]) + len(right[1]) - sum(len(s[1]) for s in sides) if len(sides) < 2 else len(members))
            if len(sides) == 1:
                part = sides[0]
                continue
            below = [settle(s, rate, True) for s in sides]
            total = sum(b[0] for b in below)
            if eligible and stability >= total - 1e-9:
                return max(stability, total), None
            return total, below

    chosen = []

    def gather(part, found):
        if found[1] is None:
            chosen.append(set(part[1]))
            return
        while True:
            sides = [s for s in part[2:] if len(s[1]) > 1]
            if len(sides) != 1:
                break
            part = sides[0]
        for side, below in zip(sides, found[1], strict=True):
            gather(side, below)

    for t in big:
        gather(t, settle(t, 0.0, len(big) > 1))
    return chosen


def cases():
    rng = np.random.default_rng(7)
    rows = []
    for t, n in (("one", 60), ("many", 150), ("few", 3), ("pair", 2), ("single", 1)):
        centres = rng.normal(size=(6, 8))
        for i in range(n):
            spread = (0.05, 0.2, 0.6)[i % 3]
            x = centres[i % 6] + rng.normal(size=8) * spread if t != "few" else rng.normal(size=8)
            rows.append((t, len(rows), x.tolist()))
    return rows


@pytest.fixture
def apart(spark):
    """Small ranges stay parts of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("k", [200, 6])
def test_clusters_equal_the_merge_tree_s(spark, apart, k):
    """With whole lists, and with short ones that leave a tenant in several trees."""
    rng = random.Random(k)
    lists = []
    for t, rows in (("a", 40), ("b", 75), ("c", 2), ("d", 3)):
        points = {(t, i): [rng.gauss(3 * (i % 4), 1), rng.gauss(0, 1)] for i in range(rows)}
        base = {"a": 0, "b": 1000, "c": 2000, "d": 3000}[t]
        for (_, i), p in points.items():
            near = sorted((round(math.dist(p, q), 9), j) for (_, j), q in points.items() if j != i)
            lists += [(t, base + i, base + j, d, n + 1) for n, (d, j) in enumerate(near[:k])]
    graph = spark.createDataFrame(lists, "tenant string, a long, b long, distance double, rank int")
    found = density.density_clusters(graph).collect()
    assert len(found) == len({r[1] for r in lists})
    got = {}
    for r in found:
        if r["cluster_id"] is not None:
            got.setdefault(r["cluster_id"], set()).add(r["id"])
    want = [c for t in "abcd" for c in plain_clusters([r for r in lists if r[0] == t])]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))
    assert all(min(v) == c for c, v in got.items())
    assert len(got) > 5


def test_planted_groups_are_found(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(5, 16))
    rows = [("t", i, (centres[i % 5] + rng.normal(size=16) * 0.08).tolist()) for i in range(100)]
    rows += [("t", 200 + i, rng.normal(size=16).tolist()) for i in range(5)]
    found = density.density_clusters(neighbours.exact_neighbours(spark.createDataFrame(rows, "tenant string, id long, vector array<double>"))).toPandas()
    at = found[found.id < 100].dropna().groupby("cluster_id").id.apply(lambda x: set(x % 5))
    assert found[found.id < 100].cluster_id.notna().mean() > 0.9
    assert at.map(len).max() == 1  # no cluster mixes two groups
    assert found[found.id < 100].dropna().groupby(found.id % 5).cluster_id.nunique().max() <= 2


def test_copies_and_ties(spark):
    rows = [("t", i, [1.0, 0.0]) for i in range(8)] + [("t", 10 + i, [0.0, 1.0]) for i in range(6)] + [("t", 20, None), ("t", 21, [0.0, 0.0]), ("u", 30, [1.0, 1.0]), ("u", 31, [float("nan"), 1.0])]
    graph = neighbours.exact_neighbours(spark.createDataFrame(rows, "tenant string, id long, vector array<double>"))
    found = {r["id"]: r["cluster_id"] for r in density.density_clusters(graph).collect()}
    assert found == {i: 0 for i in range(8)} | {10 + i: 10 for i in range(6)}
    none = spark.createDataFrame([], "tenant string, id long, vector array<double>")
    assert density.density_clusters(neighbours.neighbours(none)).count() == 0


def test_exact_lists_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "EXACT_BLOCK", 20)
    rows = cases()
    got = neighbours.exact_neighbours(spark.createDataFrame(rows, "tenant string, id long, vector array<double>"), 4).collect()
    want = plain_lists(rows, 4)
    assert sorted((r["tenant"], r["a"], r["b"], r["rank"]) for r in got) == sorted((t, a, b, n) for t, a, b, _, n in want)


def test_exact_blocks_are_few(spark):
    """A row moves once for each block of its tenant: their number must not follow the rows where a task can hold more."""
    got = spark.createDataFrame([(n,) for n in (1, 1024, 5000, 65536, 150000)], "n long").select(neighbours.exact_blocks(F.col("n")).alias("b")).collect()
    assert [r["b"] for r in got] == [1, 1, 4, 4, 10]


def test_nearest_in_blocks_equals_all_pairs(spark, monkeypatch):
    """Blocks of queries are groups of one join, not branches of the plan; null, zero, odd and unlike vectors rank as with ``scoring.cosine``."""
    for name, size in (("QUERY_BLOCK", 4), ("VECTOR_BLOCK", 7), ("AT_ONCE", 40)):
        monkeypatch.setattr(vectors, name, size)
    r = random.Random(5)
    rows = [(i, [float(r.randint(-4, 4)) for _ in range(3)]) for i in range(30)] + [(30, None), (31, [0.0, 0.0, 0.0]), (32, [1.0, None, 2.0]), (33, [1.0, 2.0]), (34, [math.nan, 1.0, 1.0]), (35, [1.0, 2.0, 3.0]), (36, [2.0, 4.0, 6.0]), (37, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = v.where("vec_id % 3 = 0 or vec_id > 29")
    found = vectors.nearest(v, asked, 5)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()
    near = F.round(scoring.cosine(F.col("embedding"), F.col("q")), 5)
    pairs = v.join(asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), F.col("vec_id") != F.col("query_id")).select("query_id", "vec_id", near.alias("similarity"))
    want = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))).where("rank <= 5")
    plain = lambda df: sorted((x["query_id"], x["rank"], x["vec_id"], str(x["similarity"])) for x in df.collect())
    assert plain(found) == plain(want)


def test_approximate_lists_find_nine_in_ten(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.lit("all").alias("tenant"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = lambda g: {(r["a"], r["b"]) for r in g.where("rank <= 10").collect()}
    want = best(neighbours.exact_neighbours(e))
    found = neighbours.neighbours(e)
    assert len(want & best(found)) >= 0.9 * len(want)
    assert found.count() == 15 * e.count()  # every row is in the graph


def test_fuzzy_weights(spark):
    rows = cases()
    graph = neighbours.exact_neighbours(spark.createDataFrame(rows, "tenant string, id long, vector array<double>"), 5)
    got = {(r["a"], r["b"]): r["weight"] for r in neighbours.fuzzy_edges(graph).collect()}
    seen = {}
    lists = {}
    for r in graph.collect():
        lists.setdefault(r["a"], []).append((r["distance"], r["b"]))
    for a, near in lists.items():
        d = np.array([x for x, _ in near])
        beyond = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0), 0)
        low, high = 1e-9, 1e5
        for _ in range(200):
            rate = math.sqrt(low * high)
            low, high = (rate, high) if np.exp(-beyond / rate).sum() < np.log2(max(len(d), 2)) else (low, rate)
        for (_, b), w in zip(near, np.exp(-beyond / rate), strict=True):
            seen[a, b] = float(w)
    want = {}
    for (a, b), w in seen.items():
        v = seen.get((b, a), 0.0)
        want[min(a, b), max(a, b)] = w + v - w * v
    assert got.keys() == want.keys()
    assert all(got[e] == pytest.approx(want[e], abs=1e-5) for e in want)


def test_running_values_cross_ranges(spark, apart):
    rng = random.Random(4)
    rows = [(g, i, float(rng.randint(-5, 5)), None if i % 7 == 0 else i % 11) for g, n in (("hot", 400), ("b", 3), ("c", 1)) for i in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "g string, i long, x double, y long").repartition(5)
    got = ordered.running(df, ["g"], ["i"], {"sum": "x"}, {"most": "y"})
    want = []
    for g in ("hot", "b", "c"):
        total, most = 0.0, None
        for r in sorted(r for r in rows if r[0] == g):
            total, most = total + r[2], r[3] if most is None else most if r[3] is None else max(most, r[3])
            want.append((*r, total, most))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    parts = ordered.in_ranges(df, ["g"], ["i"])
    assert parts.where("g = 'hot'").select(ordered.PART).distinct().count() > 1


def test_every_file_has_a_cluster_and_its_importance(spark, sf):
    """Noise is a cluster of its own; a cluster has one primary file, its most central one."""
    from corpuscle.operators import vectors

    got = vectors.clu_density(spark, sf).toPandas()
    assert len(got) == got.vec_id.nunique() == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    noise = got.cluster_id.str.startswith("c_noise_")
    assert (got[noise].relevance == 1).all() and got[noise].is_primary.all() and (got[noise].cluster_id == "c_noise_" + got[noise].vec_id.astype(str)).all()
    real = got[~noise]
    assert real.groupby("cluster_id").is_primary.sum().eq(1).all() and real.groupby("cluster_id").size().min() >= 2
    assert real.groupby("cluster_id").tenant.nunique().eq(1).all()
    top = real.groupby("cluster_id").relevance.max()
    assert (real[real.is_primary].set_index("cluster_id").relevance.sort_index() == top.sort_index()).all()
    assert got.importance.between(0, 100).all() and set(got.importance_label) <= {"low", "medium", "high"}


def test_neighbours_are_exact_up_to_a_tenant_size(spark, monkeypatch):
    """Descent found 0.85 of the ten nearest among 51,282 rows of a tenant; all pairs of its blocks are less work there."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((900, 24))
    vectors = spark.createDataFrame([(int(i >= 600), i, v.tolist()) for i, v in enumerate(x)], "tenant long, id long, vector array<double>")
    rows = lambda df: {(r["tenant"], r["a"], r["b"], r["distance"], r["rank"]) for r in df.collect()}
    want = rows(neighbours.exact_neighbours(vectors, 10))
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    assert rows(neighbours.neighbours(vectors, 10, 0, 10)) == want
    monkeypatch.setattr(neighbours, "EXACT_ROWS", 400)  # the larger tenant by descent
    got = rows(neighbours.neighbours(vectors, 10))
    assert {r for r in got if r[0] == "1"} == {r for r in want if r[0] == "1"}
    large = lambda rows_: {r[:3] for r in rows_ if r[0] == "0"}
    assert len(large(got) & large(want)) >= 0.9 * len(large(want)) and {r[1] for r in got} == set(range(900))


def test_lists_of_a_large_tenant_are_exact(spark, monkeypatch):
    """Beyond EXACT_ROWS lists came from descent; now such a tenant's rows are met in several passes."""
    rng = np.random.default_rng(6)
    rows = [("large" if i < 300 else "small", i, x) for i, x in enumerate(rng.standard_normal((340, 12)).tolist())]
    for name, n in (("EXACT_BLOCK", 40), ("EXACT_ROWS", 80), ("BLOCK", 16)):
        monkeypatch.setattr(neighbours, name, n)
    got = neighbours.neighbours(spark.createDataFrame(rows, "tenant string, id long, vector array<double>"), 6, 0, 6).collect()
    assert sorted((r["tenant"], r["a"], r["b"], r["rank"]) for r in got) == sorted((t, a, b, n) for t, a, b, _, n in plain_lists(rows, 6))
