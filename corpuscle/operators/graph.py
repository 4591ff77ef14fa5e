"""The knowledge graph: nodes and edges, neighbourhoods, suggestions and hygiene.

Traversal is a few joins of a frontier with the edges in both directions; the frontier is a distributed table, never a driver's list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import scoring
from corpuscle.operators.relational import EDGES_SQL, FILES_SQL, TAG_PAIRS_SQL, TAGS_SQL, tag_pair_classes
from corpuscle.sources import store
from corpuscle.sources.tables import as_of, cluster_map, edges, files, packs, table, tags

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Importance of the files that have a summary, at a middling centrality.
INSIGHTS_SQL = """ins as (select file_id, greatest(0, least(100, round_even(case when length(extracted_text) = 0 then 0 else least(40.0, 10 * log10(length(extracted_text))) end + 15 + case when d <= 7 then 15.0 when d >= 365 then 0.0 else 15.0 * (1 - (d - 7) / 358.0) end + case when sot then 10 else 0 end, 0)))::int as importance
 from (select *, floor((epoch(timestamp '2024-02-01') - epoch(uploaded_at)) / 86400) as d from files) where summarised)"""


def build_nodes(files_: DataFrame, clusters: DataFrame, tags_: DataFrame, total: DataFrame, packs_: DataFrame, entities: DataFrame, insights: DataFrame) -> DataFrame:
    """object_type, object_id, label, importance: files (by their insight, 0.5 without one), clusters, packs, tags of two files or more, entities.

    ``packs_``: pack_id, title; ``entities``: name; ``insights``: file_id, importance (0 to 100)."""
    node = lambda df, kind, key, label, weight: df.select(F.lit(kind).alias("object_type"), F.col(key).cast("string").alias("object_id"), label.alias("label"), weight.alias("importance"))
    used = tags_.groupBy("tag").agg(F.countDistinct("file_id").alias("n")).where("n >= 2").withColumn("total", total.scalar())
    known = files_.join(insights.select("file_id", "importance"), "file_id", "left")
    return (
        node(known, "source_file", "file_id", F.col("filename"), F.coalesce(F.col("importance") / 100, F.lit(0.5)))
        .unionByName(node(clusters, "cluster", "cluster_id", F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")), F.lit(0.7)))
        .unionByName(node(packs_, "context_pack", "pack_id", F.col("title"), F.lit(0.8)))
        .unionByName(node(used, "tag", "tag", F.col("tag"), F.round(F.least(F.lit(0.9), 0.3 + 0.6 * F.col("n") / F.greatest("total", F.lit(1))), 6)))
        .unionByName(node(entities.select("name").distinct(), "entity", "name", F.col("name"), F.lit(0.6)))
    )


def named_entities(files_: DataFrame) -> DataFrame:
    """name: capitalised words of the texts, which stand for a model's entities."""
    names = F.filter(F.split("extracted_text", " "), lambda x: x.rlike("^[A-Z][a-z]{3,}$"))
    return files_.select(F.explode(F.array_distinct(names)).alias("name")).distinct()


def file_insights(files_: DataFrame, now) -> DataFrame:
    """file_id, importance of the files that have a summary, at a middling centrality."""
    score = scoring.importance(F.length("extracted_text"), F.lit(0.5), F.col("uploaded_at"), now, F.col("source_of_truth"), F.lit(0))
    return files_.where("summarised").select("file_id", score.alias("importance"))


@query(f"""with {TAGS_SQL}, n as (select count(distinct file_id) as total from tags), {FILES_SQL},
{INSIGHTS_SQL},
mn as (select distinct unnest(list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[A-Z][a-z]{{3,}}'))) as name from documents)
select 'source_file' as object_type, f.file_id::varchar as object_id, filename as label, coalesce(importance / 100.0, 0.5)::double as importance from files f left join ins using (file_id)
union all select 'cluster', label::varchar, 'cluster ' || label, 0.7 from (select distinct label from embeddings)
union all select 'context_pack', o_orderkey::varchar, 'pack ' || o_orderkey, 0.8 from orders where o_orderkey in (select l_orderkey from lineitem)
union all select 'entity', name, name, 0.6 from mn
union all select 'tag', tag, tag, round(least(0.9, 0.3 + 0.6 * count(distinct file_id) / (select total from n)), 6) from tags group by tag having count(distinct file_id) >= 2""")
def grf_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of a graph, of five kinds; entities are the names that texts hold, and files with a summary have an insight."""
    t, f = tags(spark, sf_dir), files(spark, sf_dir)
    clusters = cluster_map(spark, sf_dir).select("cluster_id").distinct()
    return build_nodes(f, clusters, t, t.agg(F.countDistinct("file_id").alias("total")), packs(spark, sf_dir), named_entities(f), file_insights(f, as_of()))


@query("""select vec_id::varchar as source, label::varchar as target, 'contains' as edge_type, round(abs(embedding[1]), 6) as weight, 1.0::double as confidence from embeddings
union all select o_custkey::varchar, o_orderkey::varchar, 'derived_from', 0.9, 1.0 from orders
union all select l_orderkey::varchar, p_brand || ' ' || p_type, 'has_tag', 0.6, 0.9 from (select distinct l_orderkey, p_brand, p_type from lineitem join part on l_partkey = p_partkey)""")
def grf_edges(spark, sf_dir):
    """Edges from clusters, packs and tags; repeated topics give one edge."""
    edge = lambda df, source, target, kind, weight, sure: df.select(F.col(source).cast("string").alias("source"), F.col(target).cast("string").alias("target"), F.lit(kind).alias("edge_type"), weight.alias("weight"), F.lit(sure).alias("confidence"))
    contains = edge(cluster_map(spark, sf_dir), "file_id", "cluster_id", "contains", F.col("relevance").cast("double"), 1.0)
    derived = edge(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "derived_from", F.lit(0.9), 1.0)
    tagged = edge(tags(spark, sf_dir), "file_id", "tag", "has_tag", F.lit(0.6), 0.9)
    return contains.unionByName(derived).unionByName(tagged)


def neighbourhood(edges_: DataFrame, start: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` hops of ``start`` (node), with their hop; and the edges that an expanded node touches.

    An edge between two nodes of the last hop is not among them, as neither was expanded. Each hop is a table, whose known size lets Spark take a
    small one to the edges, and below what makes them, instead of dealing all edges out.
    """
    at = lambda end, nodes_: edges_.join(nodes_.select(F.col("node").alias(end)), end, "left_semi")
    kept = lambda df: store.write_table(df, store.new_path(df.sparkSession, "hop"))
    seen = frontier = kept(start.select("node", F.lit(0).alias("hop")))
    for hop in range(1, min(max(depth, 1), 3) + 1):
        reached = at("source", frontier).select(F.col("target").alias("node")).unionByName(at("target", frontier).select(F.col("source").alias("node"))).distinct()
        frontier = kept(reached.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop")))
        seen = seen.unionByName(frontier)
    expanded = seen.where(F.col("hop") < depth).select("node").distinct()
    touched = at("source", expanded).unionByName(at("target", expanded)).select(edges_.columns).distinct()
    return seen, touched


@query(f"""with recursive {EDGES_SQL}, both_ as (select source as node, target as other from edges union select target, source from edges),
walk as (select 'o1' as node, 0 as hop union select b.other, w.hop + 1 from walk w join both_ b using (node) where w.hop < 2) select node, min(hop)::int as hop from walk group by 1""")
def grf_neighbourhood(spark, sf_dir):
    """Nodes within two hops of an order."""
    return neighbourhood(edges(spark, sf_dir), spark.createDataFrame([("o1",)], "node string"), 2)[0]


@query(f"""with recursive {EDGES_SQL}, both_ as (select source as node, target as other from edges union select target, source from edges),
walk as (select 'o1' as node, 0 as hop union select b.other, w.hop + 1 from walk w join both_ b using (node) where w.hop < 2), ex as (select node from walk group by 1 having min(hop) < 2)
select edge_type, count(*) as n from edges where source in (select node from ex) or target in (select node from ex) group by 1""")
def grf_neighbourhood_edges(spark, sf_dir):
    """Edges that a neighbourhood's expanded nodes touch, by type."""
    touched = neighbourhood(edges(spark, sf_dir), spark.createDataFrame([("o1",)], "node string"), 2)[1]
    return touched.groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"""with {TAG_PAIRS_SQL}, c as (select tag_a, tag_b, min(file_id) as source from pairs group by 1, 2), links as (select distinct source, file_id as target from pairs join c using (tag_a, tag_b) where file_id <> source),
shared as (select source, target, count(*) as shared from links l join tags a on a.file_id = l.source join tags b on b.file_id = l.target and a.tag = b.tag group by 1, 2),
known as (select o_orderkey as x, o_custkey as y from orders union select o_custkey, o_orderkey from orders)
select source, target, shared, round(least(0.9, 0.4 + 0.1 * shared), 4)::double as confidence from shared where not exists (select 1 from known where x = source and y = target)""")
def grf_suggestions(spark, sf_dir):
    """Relations suggested by two shared tags or more, without those that exist either way: each file with the first file of each of its
    tag pairs. This is a star of each class, not all of its links: those follow from grf_suggestion_classes and grf_suggestion_known."""
    o = table(spark, sf_dir, "orders")
    known = o.select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target")).unionByName(o.select(F.col("o_custkey").alias("source"), F.col("o_orderkey").alias("target")))
    new = suggested(tag_sets(spark, sf_dir), known)
    return new.select("source", "target", "shared", F.round(F.least(F.lit(0.9), 0.4 + 0.1 * F.col("shared")), 4).alias("confidence"))


def tag_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, ts: the tags of each file, as ``tables.tags`` has them, once and in order; numbers stand for tags, in this table alone."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("tag"))
    numbers = store.write_table(parts.select("tag").distinct().withColumn("t", F.monotonically_increasing_id()), store.new_path(spark, "tags"))
    numbered = parts.join(numbers, "tag").select("p_partkey", "t")
    lines = table(spark, sf_dir, "lineitem").join(numbered, F.col("l_partkey") == F.col("p_partkey"))
    return store.write_table(lines.groupBy(F.col("l_orderkey").alias("file_id")).agg(F.sort_array(F.collect_set("t")).alias("ts")), store.new_path(spark, "sets"))


def suggested(sets: DataFrame, known: DataFrame) -> DataFrame:
    """source, target, shared: each file with the first file of each of its tag pairs, and how many tags they share, without ``known`` (source, target).

    Classes by tag pair bring the tags of their first file to the others, which have their own with them, so a link is counted where it is found. Classes
    are tables of known size: where they are few, no pair moves but for links that are the same."""
    kept = lambda df, label: store.write_table(df, store.new_path(df.sparkSession, label))
    first = sets.where(F.size("ts") > 1).select("file_id", "ts", F.posexplode("ts").alias("i", "tag_a"))
    pairs = first.select("file_id", "ts", "tag_a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("tag_b"))
    classes = kept(pairs.groupBy("tag_a", "tag_b").agg(F.min("file_id").alias("source"), F.count("*").alias("members")).where("members > 1").drop("members"), "classes")
    told = kept(classes.join(sets.select(F.col("file_id").alias("source"), F.col("ts").alias("source_ts")), "source"), "told")
    met = pairs.join(told, ["tag_a", "tag_b"]).where("file_id <> source")
    links = met.select("source", F.col("file_id").alias("target"), F.size(F.array_intersect("ts", "source_ts")).cast("long").alias("shared"))
    once = links.groupBy("source", "target").agg(F.max("shared").alias("shared"))
    return once.join(known.join(classes.select("source"), "source", "left_semi"), ["source", "target"], "left_anti")


def known_suggestions(tags_: DataFrame, known: DataFrame) -> DataFrame:
    """source, target, shared: relations of ``known`` (source, target) between files that share two tags or more, the smaller id first."""
    sets = tags_.groupBy("file_id").agg(F.collect_set("tag").alias("ts"))
    a, b = sets.select(F.col("file_id").alias("source"), F.col("ts").alias("a_ts")), sets.select(F.col("file_id").alias("target"), F.col("ts").alias("b_ts"))
    pairs = known.where("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()
    return pairs.join(a, "source").join(b, "target").select("source", "target", F.size(F.array_intersect("a_ts", "b_ts")).cast("long").alias("shared")).where("shared >= 2")


@query(f"""with {TAG_PAIRS_SQL}, c as (select tag_a, tag_b, min(file_id) as first_id, count(*) as members from pairs group by 1, 2 having count(*) > 1)
select tag_a, tag_b, file_id, first_id, members from pairs join c using (tag_a, tag_b)""")
def grf_suggestion_classes(spark, sf_dir):
    """All suggestions as classes by tag pair: any two files of a class, unless grf_suggestion_known has them."""
    return tag_pair_classes(tags(spark, sf_dir)).select("tag_a", "tag_b", "file_id", "first_id", "members")


@query(f"""with {TAGS_SQL}, k as (select distinct least(o_orderkey, o_custkey) as source, greatest(o_orderkey, o_custkey) as target from orders where o_orderkey <> o_custkey)
select source, target, count(*) as shared from k join tags a on a.file_id = source join tags b on b.file_id = target and a.tag = b.tag group by 1, 2 having count(*) >= 2""")
def grf_suggestion_known(spark, sf_dir):
    """The exceptions to grf_suggestion_classes: pairs of a class that have a relation either way."""
    return known_suggestions(tags(spark, sf_dir), table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.col("o_custkey").alias("target")))


@query(f"""with {EDGES_SQL}, gone as (select distinct 'p' || p_partkey as node from part where p_size > 40), kept as (select * from edges where source not in (select node from gone) and target not in (select node from gone))
select edge_type, count(*) as n, (select count(*) from edges e where e.edge_type = kept.edge_type) - count(*) as removed from kept group by 1""")
def grf_hygiene(spark, sf_dir):
    """What a sweep of deleted nodes leaves of the edges, and how many go. A second sweep removes none."""
    e = edges(spark, sf_dir)
    gone = table(spark, sf_dir, "part").where("p_size > 40").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("node"))
    kept = sweep(e, gone).groupBy("edge_type").agg(F.count("*").alias("n"))
    return e.groupBy("edge_type").agg(F.count("*").alias("all_")).join(kept, "edge_type").select("edge_type", "n", (F.col("all_") - F.col("n")).alias("removed"))


def sweep(edges_: DataFrame, gone: DataFrame) -> DataFrame:
    """``edges_`` without those at a node of ``gone``."""
    return edges_.join(gone, edges_["source"] == gone["node"], "left_anti").join(gone, F.col("target") == gone["node"], "left_anti")


@query(f"""with {EDGES_SQL}, d as (select target as node, count(*) as n from edges group by 1) select s.source as node, count(*) as out_edges, coalesce(any_value(d.n), 0) as in_edges,
 round(avg(s.weight), 4) as weight from edges s left join d on d.node = s.source group by 1""")
def grf_node_detail(spark, sf_dir):
    """Edges out of and into each node that has some going out."""
    e = edges(spark, sf_dir)
    inward = e.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("in_edges"))
    out = e.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("out_edges"), F.round(F.avg("weight"), 4).alias("weight"))
    return out.join(inward, "node", "left").select("node", "out_edges", F.coalesce("in_edges", F.lit(0)).alias("in_edges"), "weight")
