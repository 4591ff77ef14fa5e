"""Organising a library: clusters, titles, summaries, importance and the graph made of them, as one version of several tables.

Steps run as usual Spark jobs over what the version before holds; their tables become visible together, by the manifest of ``Versions``. A run that
fails at any step leaves readers with the version they have. Files that have a summary of their present text keep it, unless ``force`` is given; a
run in which every file has one changes nothing. Naming and summarising are functions handed in, with deterministic fallbacks: the name of a
cluster's most central file, the first characters of each part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.operators.enrich import map_reduce_summary
from corpuscle.operators.relational import FILES_SQL
from corpuscle.operators.vectors import hybrid_clusters
from corpuscle.sources.tables import as_of, files, table
from corpuscle.sources.versions import Versions

QUERIES: dict = {}
SQL: dict[str, str] = {}
SAMPLES = 3
USABLE = "extracted_text <> '' and file_kind = 'processed' and extraction_status = 'ok'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def first_characters(chunk: Column, n: int = 200) -> Column:
    return F.left(chunk, F.lit(n))


def pending(files_: DataFrame, versions: Versions, force: bool = False) -> DataFrame:
    """Usable files of ``files_`` without a summary of their present text."""
    usable = files_.where(USABLE).withColumn("hash", F.sha2("extracted_text", 256))
    if force or "summaries" not in versions.tables():
        return usable
    return usable.join(versions.read("summaries").select("file_id", "hash"), ["file_id", "hash"], "left_anti")


def titled(clustered: DataFrame, files_: DataFrame, name: Callable[[Column], Column] | None = None) -> DataFrame:
    """cluster_id, user_id, title, samples, members of ``clustered`` (vec_id, tenant, cluster_id, relevance): ``name`` is given the names of the most
    central files, SAMPLES of them; without it the first one is the title."""
    named = clustered.join(files_.select(F.col("file_id").alias("vec_id"), "filename"), "vec_id", "left")
    rank = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("relevance"), "vec_id"))
    top = named.withColumn("k", rank).where(F.col("k") <= SAMPLES).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("k", "filename"))).alias("x"))
    sizes = clustered.groupBy("cluster_id").agg(F.first("tenant").alias("user_id"), F.count("*").alias("members"))
    samples = F.col("x.filename")
    return sizes.join(top, "cluster_id").select("cluster_id", "user_id", (name(samples) if name else F.get(samples, F.lit(0))).alias("title"), samples.alias("samples"), "members")


def organise(files_: DataFrame, vectors: DataFrame, versions: Versions, now: Column, summarise=first_characters, name: Callable[[Column], Column] | None = None, force: bool = False) -> int:
    """Organise ``files_`` (as ``tables.files`` has them) by ``vectors`` (file_id, vector); returns the version that holds the result.

    Tables: summaries (file_id, hash, summary, n_parts, mode), cluster_files (file_id, cluster_id, relevance), clusters (see ``titled``), insights
    (file_id, importance, importance_label, is_primary), nodes (object_type, object_id, label, importance), edges (source, target, edge_type, weight).
    """
    base = versions.latest()
    new = pending(files_, versions, force)
    if new.isEmpty():
        return base
    usable = files_.where(USABLE)
    fresh = map_reduce_summary(new.select("file_id", "extracted_text"), summarise).join(new.select("file_id", "hash"), "file_id").select("file_id", "hash", "summary", "n_parts", "mode")
    summaries = fresh
    if base:
        kept = versions.read("summaries", base).join(usable.select("file_id", F.sha2("extracted_text", 256).alias("hash")), ["file_id", "hash"], "left_semi")
        summaries = fresh.unionByName(kept.join(new.select("file_id"), "file_id", "left_anti").select(fresh.columns))
    # Made on a line of versions of its own: each step reads what the one before wrote.
    work = versions.branch()
    work.commit({"summaries": summaries})
    asked = vectors.join(usable.select("file_id", "user_id"), "file_id").select(F.col("user_id").alias("tenant"), F.col("file_id").alias("vec_id"), F.col("vector").alias("embedding"))
    work.commit({"placed": hybrid_clusters(asked, usable, now)})
    placed = work.read("placed")
    clusters = titled(placed, usable, name)
    work.commit({"clusters": clusters})
    clusters = work.read("clusters")
    insights = placed.select(F.col("vec_id").alias("file_id"), "importance", "importance_label", "is_primary")
    node = lambda df, kind, key, label, weight: df.select(F.lit(kind).alias("object_type"), F.col(key).cast("string").alias("object_id"), F.col(label).alias("label"), weight.alias("importance"))
    known = usable.join(insights, "file_id", "left")
    nodes = node(known, "source_file", "file_id", "filename", F.coalesce(F.col("importance") / 100, F.lit(0.5))).unionByName(node(clusters, "cluster", "cluster_id", "title", F.lit(0.7)))
    edges = placed.select(F.col("vec_id").cast("string").alias("source"), F.col("cluster_id").alias("target"), F.lit("contains").alias("edge_type"), F.col("relevance").alias("weight"))
    return versions.commit(
        {
            "summaries": work.read("summaries"),
            "cluster_files": placed.select(F.col("vec_id").alias("file_id"), "cluster_id", "relevance"),
            "clusters": clusters,
            "insights": insights,
            "nodes": nodes,
            "edges": edges,
        },
        base=base,
    )


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("vector"))


def _summary_sql(where: str) -> str:
    return f"""with {FILES_SQL}, u as (select file_id, extracted_text as t, length(extracted_text) > 5500 as long from files where {USABLE} and {where}),
c as (select file_id, long, unnest(case when long then range(0, ceil(length(t) / 10000.0)::bigint) else [0] end) as i, t from u),
m as (select file_id, long, i, left(case when long then substr(t, i * 10000 + 1, 10000) else t end, 200) as mini from c)
select file_id, string_agg(mini, chr(10) order by i) as summary, count(*) as n_parts, case when any_value(long) then 'mapreduce' else 'simple' end as mode from m group by 1"""


@query(_summary_sql("true"))
def org_run(spark, sf_dir):
    """The summaries of a whole run over all tenants, after an incremental one over some of the files; clusters and graph are of the same version."""
    versions = Versions(spark)
    f = files(spark, sf_dir)
    organise(f.where("file_id % 4 = 0"), _vectors(spark, sf_dir).where("file_id % 4 = 0"), versions, as_of())
    organise(f, _vectors(spark, sf_dir), versions, as_of())
    return versions.read("summaries").select("file_id", "summary", "n_parts", "mode")


@query(_summary_sql("file_id % 2 = 0"))
def org_failed(spark, sf_dir):
    """What readers see after a run whose summaries failed: the run before."""
    versions = Versions(spark)
    f = files(spark, sf_dir)
    organise(f.where("file_id % 2 = 0"), _vectors(spark, sf_dir).where("file_id % 2 = 0"), versions, as_of())
    try:
        organise(f, _vectors(spark, sf_dir), versions, as_of(), lambda chunk: F.raise_error(F.lit("the model is away")).cast("string"))
    except Exception as e:  # the run's own failure is expected; any other is not
        if "the model is away" not in str(e):
            raise
    return versions.read("summaries").select("file_id", "summary", "n_parts", "mode")
