"""Density clusters over a neighbour graph, as joins: a spanning forest, its merge tree as chains, clusters of greatest excess of mass.

1. Two rows' reachability is the largest of their distance and their core distances (that to the CORE-th neighbour). Edges of the neighbour
   graph have it as their length; a tenant with no more rows than the lists are long has all its pairs.
2. Borůvka's rounds give the minimum spanning forest: each component takes its shortest edge out, those that meet become one. Rounds are
   logarithmic, components are found by pointer doubling, and each round is a table.
3. The merge tree (which component joins which as the length grows) is never walked. An edge that was taken in round l joins, in the tree, a
   chain: that below the first edge of a later round, among those its component took, that is longer than it. Chains of round j hold what
   earlier rounds' chains hang on, so they are settled in that order; inside a chain, in order of length, what counts are running sums and
   maxima (``ordered.running``), which deal a long chain out over many tasks.
4. A cluster lives in a stretch of a chain between two splits, places where two parts of at least two rows join. Its stability is the sum over
   its rows of 1 / length at which they leave it, less 1 / length at which it splits off. It is chosen if that is no less than what the
   clusters below it come to together, and none above it is chosen. With f for the best below and h for what hangs on at a split,
   f = max(stability, f before + h), so along a chain f = (running sum of h) + max(0, running maximum of (stability - running sum of h)).

The whole of a tenant is no cluster, as is usual; but where its graph falls apart into several components of two rows or more, each may be one.
The smallest cluster has two rows. Lengths under FLOOR count as FLOOR, so copies are as dense as anything. Edges of equal length go by their ids.
Rows without an edge, and those outside the chosen clusters, are noise: cluster_id null. Clusters are named by their smallest id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.operators.ordered import running
from corpuscle.sources import store

CORE = 2
FLOOR = 1e-4


def _kept(df: DataFrame, label: str) -> DataFrame:
    return store.write_table(df, store.new_path(df.sparkSession, label))


def reachability(graph: DataFrame) -> DataFrame:
    """a, b (a < b), w: lengths of the edges of lists of nearest neighbours (a, b, distance, rank)."""
    core = graph.where(F.col("rank") <= CORE).groupBy(F.col("a").alias("id")).agg(F.max("distance").alias("core"))
    once = graph.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").groupBy("a", "b").agg(F.min("distance").alias("d"))
    of = lambda end: core.select(F.col("id").alias(end), F.col("core").alias(f"core_{end}"))
    return once.join(of("a"), "a").join(of("b"), "b", "left").select("a", "b", F.greatest("d", "core_a", F.coalesce("core_b", F.lit(0.0)), F.lit(FLOOR)).alias("w"))


def _roots(hooks: DataFrame) -> DataFrame:
    """x, root of a forest of pointers (x, root), roots pointing to themselves: doubled until nothing changes."""
    while True:
        up = hooks.select(F.col("x").alias("root"), F.col("root").alias("next"))
        new = _kept(hooks.join(up, "root").select("x", F.col("next").alias("root"), (F.col("root") != F.col("next")).alias("moved")), "roots")
        hooks = new.select("x", "root")
        if new.where("moved").isEmpty():
            return hooks


def spanning_forest(edges: DataFrame) -> list[DataFrame]:
    """A table a round: x (a component), the edge it took (w, a, b), root (what it is part of afterwards). Its edges together are the forest."""
    rounds = []
    open_ = _kept(edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "w", "a", "b"), "open")
    while not open_.isEmpty():
        both = open_.unionByName(open_.select(F.col("y").alias("x"), F.col("x").alias("y"), "w", "a", "b"))
        taken = _kept(both.groupBy("x").agg(F.min(F.struct("w", "a", "b", "y")).alias("e")).select("x", "e.w", "e.a", "e.b", "e.y"), "taken")
        back = taken.select(F.col("x").alias("y"), F.col("y").alias("back"))
        root = F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y"))  # of two that took the same edge, one is the root
        roots = _roots(_kept(taken.join(back, "y").select("x", root.alias("root")), "hooks"))
        rounds.append(_kept(taken.join(roots, "x").select("x", "w", "a", "b", "root"), "round"))
        to = lambda end: roots.select(F.col("x").alias(end), F.col("root").alias(f"{end}_"))  # noqa: E731, B023
        moved = open_.join(to("x"), "x").join(to("y"), "y").where("x_ <> y_")
        pair = moved.groupBy(F.least("x_", "y_").alias("x"), F.greatest("x_", "y_").alias("y")).agg(F.min(F.struct("w", "a", "b")).alias("e"))
        open_ = _kept(pair.select("x", "y", "e.w", "e.a", "e.b"), "open")
    return rounds


def chains(rounds: list[DataFrame]) -> DataFrame:
    """w, a, b, level (the round that took the edge), at (the chain's round), chain (the component there): a row an edge of the forest.

    A chain of round len(rounds) has no edge above it: its component is a whole tree of the forest.
    """
    top, waiting, placed = len(rounds), None, []
    for at in range(1, top + 1):
        fresh = rounds[at - 1].select("w", "a", "b", F.lit(at - 1).alias("level"), F.col("root").alias("chain")).distinct()
        waiting = fresh if waiting is None else waiting.unionByName(fresh)
        if at < top:
            above = rounds[at].select(F.col("x").alias("chain"), F.struct("w", "a", "b").alias("above"), "root")
            met = _kept(waiting.join(above, "chain", "left").withColumn("here", F.col("above") > F.struct("w", "a", "b")), "waiting")
            placed.append(met.where("here").select("w", "a", "b", "level", "chain", F.lit(at).alias("at")))
            placed.append(met.where("above is null").select("w", "a", "b", "level", "chain", F.lit(top).alias("at")))  # its tree is whole already
            waiting = met.where("not here").select("w", "a", "b", "level", F.col("root").alias("chain"))
        else:
            placed.append(waiting.withColumn("at", F.lit(top)))
    return _kept(reduce(DataFrame.unionByName, placed), "chains")


def density_clusters(graph: DataFrame) -> DataFrame:
    """id, cluster_id of every row that has a neighbour, from lists of nearest neighbours (tenant, a, b, distance, rank)."""
    spark = graph.sparkSession
    rounds = spanning_forest(reachability(graph))
    if not rounds:
        return spark.createDataFrame([], "id long, cluster_id long")
    edges, top = chains(rounds), len(rounds)
    leaves = rounds[0].groupBy("a", "b").agg(F.count("*").alias("leaves"))
    # Trees of a tenant: with one alone, its top stretch is the whole and no cluster.
    tenant = graph.select(F.col("a").alias("x"), "tenant").distinct()
    whole = edges.where(F.col("at") == top).select("chain").distinct().join(tenant.withColumnRenamed("x", "chain"), "chain").groupBy("tenant").agg(F.count("*").alias("trees"), F.min("chain").alias("chain"))
    alone = whole.where("trees = 1").select("chain")
    above = [None, *(r.select(F.col("x").alias("chain"), F.col("w").alias("up_w"), F.col("a").alias("up_a"), F.col("b").alias("up_b")) for r in rounds[1:])]

    hanging, elements, stretches = None, {}, {}
    for at in range(1, top + 1):
        rows = edges.where(F.col("at") == at).join(leaves, ["a", "b"], "left").fillna(0, ["leaves"])
        if hanging is None:
            rows = rows.select("*", F.lit(0).cast("long").alias("size_below"), F.lit(0.0).alias("best_below"))
        else:
            below = hanging.groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.sum("size").alias("size_below"), F.sum("best").alias("best_below"))
            rows = rows.join(below, ["a", "b"], "left").fillna(0, ["size_below", "best_below"])
        rows = rows.withColumn("joins", F.col("leaves") + F.col("size_below")).withColumn("splits", (F.col("level") > 0).cast("long"))
        rows = running(rows, ["chain"], ["w", "a", "b"], {"size": "joins", "stretch": "splits"})
        elements[at] = _kept(rows.select("chain", "w", "a", "b", "stretch", "leaves", "size", "splits", "best_below"), "elements")
        # Stretches: what leaves at each length, and the split it starts with.
        rate, split = 1 / F.col("w"), F.col("splits") == 1
        found = elements[at].groupBy("chain", "stretch").agg(
            F.sum(F.when(split, F.col("size") * rate).otherwise(F.col("leaves") * rate)).alias("leaving"), F.max("size").alias("size"),
            F.sum("best_below").alias("h"), F.max(F.when(split, rate)).alias("split_rate"),
        )
        nxt = found.where("split_rate is not null").select("chain", (F.col("stretch") - 1).alias("stretch"), F.col("split_rate").alias("born"))
        found = found.join(nxt, ["chain", "stretch"], "left")
        if at < top:
            found = found.join(above[at], "chain", "left").withColumn("born", F.coalesce("born", 1 / F.col("up_w")))
        else:
            none = F.lit(None)
            found = found.withColumns({"up_w": none.cast("double"), "up_a": none.cast("long"), "up_b": none.cast("long")})
            found = found.join(alone.withColumn("alone", F.lit(True)), "chain", "left").withColumn("whole", F.coalesce("alone", F.lit(False)) & F.col("born").isNull()).drop("alone")
            found = found.withColumn("born", F.coalesce("born", F.lit(0.0)))
        stability = F.col("leaving") - F.col("born") * F.col("size")
        if at == top:
            stability = F.when(~F.col("whole"), stability)  # the whole can't be chosen: no stability
        found = running(found.withColumn("stability", stability), ["chain"], ["stretch"], {"hung": "h"})
        found = running(found.withColumn("over", F.col("stability") - F.col("hung")), ["chain"], ["stretch"], {}, {"most": "over"})
        best = F.col("hung") + F.greatest(F.coalesce("most", F.lit(0.0)), F.lit(0.0))
        chosen = F.coalesce(F.col("over") >= F.greatest(F.col("most"), F.lit(0.0)), F.lit(False))
        stretches[at] = _kept(found.select("chain", "stretch", "size", best.alias("best"), chosen.alias("chosen"), "up_w", "up_a", "up_b"), "stretches")
        if at < top:
            last = stretches[at].groupBy("chain").agg(F.max(F.struct("stretch", "size", "best", "up_a", "up_b")).alias("x"))
            summed = _kept(last.select("x.size", "x.best", "x.up_a", "x.up_b"), "hanging")
            hanging = summed if hanging is None else hanging.unionByName(summed)

    # Downwards: a chain under a chosen cluster is inside it; else its topmost chosen stretch takes what is below.
    label = "struct<at:int,chain:bigint,stretch:bigint>"
    labelled = None
    for at in range(top, 0, -1):
        highest = stretches[at].groupBy("chain").agg(F.max(F.when(F.col("chosen"), F.col("stretch"))).alias("highest"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"))
        if labelled is None:
            highest = highest.withColumn("given", F.lit(None).cast(label))
        else:
            highest = highest.join(labelled.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("label").alias("given")), ["up_a", "up_b"], "left")
        own = F.when(F.col("stretch") <= F.col("highest"), F.struct(F.lit(at).alias("at"), F.col("chain").alias("chain"), F.col("highest").alias("stretch")).cast(label))
        here = _kept(elements[at].join(highest.select("chain", "highest", "given"), "chain").select("a", "b", F.coalesce("given", own).alias("label")), "labelled")
        labelled = here if labelled is None else labelled.unionByName(here)
    members = _kept(rounds[0].join(labelled, ["a", "b"]).select(F.col("x").alias("id"), "label"), "members")
    names = members.where("label is not null").groupBy("label").agg(F.min("id").alias("cluster_id"))
    return members.join(names, "label", "left").select("id", "cluster_id")
