"""Suggestions against brute force over pairs of files."""

import random
from itertools import combinations

import pytest

from corpuscle.operators import admin, graph
from corpuscle.operators.graph import known_suggestions
from corpuscle.operators.relational import tag_pair_classes


def test_every_new_link_follows_from_classes_and_known_relations(spark):
    rng = random.Random(2)
    sets = {i: set(rng.sample("abcdefgh", 3)) for i in range(30)} | {100: {"x", "y"}, 101: {"x", "y"}, 102: {"x", "y"}}
    known = [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] + [(101, 100), (100, 5)]
    tags = spark.createDataFrame([(i, t) for i, ts in sets.items() for t in ts], "file_id long, tag string")
    classes, without = {}, set()
    for r in tag_pair_classes(tags).collect():
        classes.setdefault((r["tag_a"], r["tag_b"]), []).append(r["file_id"])
    for r in known_suggestions(tags, spark.createDataFrame(known, "source long, target long")).collect():
        without.add((r["source"], r["target"]))
        assert r["shared"] == len(sets[r["source"]] & sets[r["target"]]) >= 2
    got = {p for members in classes.values() for p in combinations(sorted(members), 2)} - without
    either = {frozenset(x) for x in known}
    want = {(i, j) for i, j in combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= 2 and frozenset((i, j)) not in either}
    assert got == want
    assert (101, 102) in got
    assert (100, 101) not in got


def test_neighbourhoods_take_the_frontier_to_the_edges(spark):
    """Edges are not dealt out for a frontier of a few nodes: joins with it broadcast it, below what makes the edges."""
    from corpuscle.operators.graph import QUERIES

    plan = QUERIES["grf_neighbourhood_edges"](spark, "/root/testdata/sf0.1")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2


def shuffled_rows(df):
    """Rows that the exchanges of ``df`` write, once it has run."""
    df.collect()
    found, open_ = 0, [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            open_.append(node.plan())
        else:
            if name == "Exchange":
                found += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            open_ += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_links_to_first_members_of_label_classes(spark, broadcast):
    """All links were turned both ways and dealt out; those that end at no first member needn't move."""
    rng = random.Random(3)
    entities = [(i, f"name {i % 7}" if i < 60 else f"own {i}") for i in range(200)] + [(300, None), (301, None)]
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(6000)] + [(0, 0), (None, 1), (300, 301)]
    pairs, first = set(links), {}
    for i, label in entities:
        first.setdefault(label, []).append(i)
    want = {(label, i, ids[0], len(ids), (i, ids[0]) in pairs or (ids[0], i) in pairs) for label, ids in first.items() if label and len(ids) > 1 for i in ids}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = admin.with_links(spark.createDataFrame(entities, "id long, label string"), spark.createDataFrame(links, "a long, b long"))
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want) and {w[4] for w in want} == {True, False}
        if broadcast != "-1":
            assert shuffled_rows(found) < len(links) / 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_suggestions_move_links_once(spark, broadcast):
    """Sets of tags were made three times and moved with each link."""
    rng = random.Random(4)
    tags = {i: sorted(rng.sample(range(9), rng.randrange(0, 6))) for i in range(150)}
    known = [(rng.randrange(150), rng.randrange(150)) for _ in range(3000)] + [(None, 3)]
    first = {}
    for i, ts in tags.items():
        for pair in combinations(ts, 2):
            first.setdefault(pair, i)
    links = {(first[p], i) for i, ts in tags.items() for p in combinations(ts, 2) if first[p] != i} - set(known)
    want = {(s, t, len(set(tags[s]) & set(tags[t]))) for s, t in links}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        found = graph.suggested(spark.createDataFrame(list(tags.items()), "file_id long, ts array<long>"), spark.createDataFrame(known, "source long, target long"))
        assert sorted(tuple(r) for r in found.collect()) == sorted(want) and max(w[2] for w in want) > 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
