"""Folds over ranges against the same folds row by row, with a group of most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.operators import ordered
from corpuscle.operators.relational import running_averages


@pytest.fixture(autouse=True)
def apart(spark):
    """Small ranges stay parts of their own."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def rows(seed):
    rng = random.Random(seed)
    return [(g, i, rng.choice([None, -1.0, round(rng.random() * 90, 2)])) for g, n in (("hot", 700), ("b", 40), ("c", 1), ("d", 2)) for i in rng.sample(range(2000), n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_packing_over_ranges(spark, seed):
    """What doesn't fit is passed over and later rows may fit: a sum that no totals of parts can tell."""
    made = [(g, i, int(abs(x or 0) * 3)) for g, i, x in rows(seed)]
    df = spark.createDataFrame(made, "g string, i long, n int").repartition(6)
    for budget in (50, 2000, 100_000):
        got = ordered.folded(df, ["g"], ["i"], ["n"], budget, 0, lambda s, row, budget=budget: np.where(s + row[0] < budget, s + row[0], s))
        assert got.columns == ["g", "i", "n", "before", "after"]
        want = []
        for g in "hot", "b", "c", "d":
            used = 0
            for r in sorted(r for r in made if r[0] == g):
                before, used = used, used + r[2] if used + r[2] < budget else used
                want.append((*r, before, used))
        assert sorted(map(tuple, got.collect())) == sorted(want)
    parts = ordered.in_ranges(df, ["g"], ["i"]).groupBy("g").agg(F.count_distinct(ordered.PART).alias("n"))
    assert parts.where("g = 'hot'").first()["n"] > 2


@pytest.mark.parametrize("seed", [3, 4])
def test_averages_over_ranges(spark, seed):
    df = spark.createDataFrame(rows(seed), "g string, i long, value double").repartition(6)
    got = {(r["g"], r["i"]): r["average"] for r in running_averages(df, ["g"], ["i"], "value", 60.0, 30.0).collect()}
    for g in "hot", "b", "c", "d":
        average = 30.0
        for _, i, x in sorted(r for r in rows(seed) if r[0] == g):
            average = round(0.8 * average + 0.2 * min(x, 60.0), 2) if x is not None and x >= 0 else average
            assert got[g, i] == pytest.approx(average, abs=1e-9)
    assert len(got) == len(rows(seed))


def test_no_rows(spark):
    none = spark.createDataFrame([], "g string, i long, value double")
    assert running_averages(none, ["g"], ["i"], "value", 60.0, 30.0).count() == 0
    assert ordered.running(none, ["g"], ["i"], {"s": "value"}).count() == 0
