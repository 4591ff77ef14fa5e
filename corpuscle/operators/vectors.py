"""Dense vectors: nearest neighbours, centroids, centrality and density clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring
from corpuscle.operators import density, neighbours
from corpuscle.sources import store
from corpuscle.sources.tables import as_of, files, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Vectors and query vectors, about, of a group; cosines that are in memory at once.
VECTOR_BLOCK, QUERY_BLOCK, AT_ONCE = 8192, 4096, 1 << 21
#: Places of cosines that are not a number, or null, among negated ones.
_NAN, _NULL = -9.0, 9.0


def _by_length(column: pa.ChunkedArray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Length of each vector, -1 where it is null or holds a null; and by length the rows with their matrix."""
    column = column.combine_chunks().cast(pa.list_(pa.float64()))
    lengths, values = pc.fill_null(pc.list_value_length(column), 0).to_numpy(), column.flatten()
    starts = np.cumsum(lengths) - lengths
    holes = np.zeros(len(lengths), bool)
    holes[np.repeat(np.arange(len(lengths)), lengths)[pc.is_null(values).to_numpy(zero_copy_only=False)]] = True
    x = values.to_numpy(zero_copy_only=False)
    kinds = np.where(holes | column.is_null().to_numpy(zero_copy_only=False), -1, lengths)
    return kinds, {int(n): (rows, x[starts[rows][:, None] + np.arange(n)]) for n in np.unique(kinds[kinds > 0]) for rows in [np.flatnonzero(kinds == n)]}


def _negated_cosines(asked: tuple, told: tuple) -> np.ndarray:
    """``scoring.cosine`` of each pair to five places, negated; _NAN and _NULL as they rank."""
    squares = []
    for kinds, groups in (asked, told):
        square = np.zeros(len(kinds))
        for rows, x in groups.values():
            square[rows] = np.einsum("ij,ij->i", x, x)
        squares.append(square)
    norm = np.sqrt(np.outer(*squares))
    out = np.where((norm == 0) | (asked[0][:, None] < 0) | (told[0][None, :] < 0), 0.0, _NULL)
    for n, (rows, x) in asked[1].items():
        if n in told[1]:
            others, y = told[1][n]
            whole = len(rows) == len(out) and len(others) == out.shape[1]
            part = norm if whole else norm[np.ix_(rows, others)]
            near = np.divide(x @ y.T, part, out=np.zeros_like(part), where=part != 0)
            size = np.floor(np.abs(near) * 1e5 + 0.5) / 1e5
            cell = np.where(np.isnan(near), _NAN, np.where(near < 0, size, -size))
            if whole:
                return cell
            out[np.ix_(rows, others)] = cell
    return out


def nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, similarity, rank: the ``k`` nearest of ``vectors`` by cosine to each row of ``asked``, itself aside.

    A group is a block of vectors with a block of queries; it gives the k best of the block to each query. So a vector moves once for each
    QUERY_BLOCK queries, a query once for each VECTOR_BLOCK vectors, and the work of a pair is that of a product of matrices.
    """
    blocks = [max(-(-df.count() // size), 1) for df, size in ((asked, QUERY_BLOCK), (vectors, VECTOR_BLOCK))]
    id_, vector = (vectors.schema[c].dataType.simpleString() for c in ("vec_id", "embedding"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = asked.where("vec_id is not null").select(own(blocks[0]).alias("i"), every(blocks[1]).alias("j"), F.col("vec_id").cast(id_).alias("query_id"), F.col("embedding").cast(vector).alias("q"))
    held = vectors.where("vec_id is not null").select(every(blocks[0]).alias("to_i"), own(blocks[1]).alias("to_j"), "vec_id", "embedding")
    at_once = AT_ONCE

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("vec_id")
        told, ids, found = _by_length(right.column("embedding")), right.column("vec_id").combine_chunks(), []
        step = max(at_once // max(right.num_rows, 1), 1)
        for at in range(0, left.num_rows if right.num_rows else 0, step):
            some = left.slice(at, step)
            d = _negated_cosines(_by_length(some.column("q")), told)
            names = some.column("query_id").combine_chunks()
            d[names.to_numpy(zero_copy_only=False)[:, None] == ids.to_numpy(zero_copy_only=False)[None, :]] = np.inf
            i, j = neighbours.least(d, np.arange(right.num_rows), k)
            d = d[i, j]
            near = pa.array(np.where(d == _NAN, np.nan, 0.0 - d), mask=d == _NULL)
            found.append(pa.table({"query_id": names.take(pa.array(i)), "vec_id": ids.take(pa.array(j)), "similarity": near}))
        empty = pa.table({"query_id": left.column("query_id").slice(0, 0), "vec_id": right.column("vec_id").slice(0, 0), "similarity": pa.array([], pa.float64())})
        return pa.concat_tables(found or [empty])

    best = asking.groupBy("i", "j").cogroup(held.groupBy("to_i", "to_j")).applyInArrow(cell, f"query_id {id_}, vec_id {id_}, similarity double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


@query("""with p as (select q.vec_id as query_id, v.vec_id, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 5) as similarity from embeddings v, embeddings q where q.vec_id % 100 = 0 and v.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from p) select query_id, vec_id, similarity, rank from r where rank <= 5""")
def vec_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return nearest(e, e.where("vec_id % 100 = 0"), 5)


@query("""with x as (select label as cluster_id, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings) select cluster_id, i::int as dim, round(avg(v), 5) as centre from x group by all""")
def vec_centroids(spark, sf_dir):
    """Means of each cluster by dimension: an average a dimension, combined before the shuffle."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("cluster_id"), F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("cluster_id", (F.col("dim") + 1).alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 5).alias("centre"))


def centrality(vectors: DataFrame) -> DataFrame:
    """vec_id, cluster_id, centrality: 1 at the centre, 0 at the farthest member; 1 alone; 0.5 for noise (cluster -1)."""
    dims = vectors.select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", "dim").agg(F.avg(F.col("v").cast("double")).alias("c"))
    centres = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "c"))), lambda x: x["c"]).alias("centre"))
    apart = F.sqrt(F.aggregate(F.zip_with("embedding", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    placed = vectors.join(centres, "label").withColumn("d", apart).withColumns({"far": F.max("d").over(Window.partitionBy("label")), "n": F.count("*").over(Window.partitionBy("label"))})
    value = F.when(F.col("label") == -1, 0.5).when(F.col("n") == 1, 1.0).otherwise(1 - F.col("d") / F.when(F.col("far") > 0, F.col("far")).otherwise(1.0))
    return placed.select("vec_id", F.col("label").alias("cluster_id"), F.round(value, 4).alias("centrality"))


CENTRALITY_SQL = """x as (select label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), c as (select label, i, avg(v) as c from x group by all),
e as (select vec_id, label, generate_subscripts(embedding, 1) as i, unnest(embedding)::double as v from embeddings), d as (select vec_id, e.label, sqrt(sum((v - c) ** 2)) as d from e join c on e.label = c.label and e.i = c.i group by all),
cent as (select vec_id, label as cluster_id, round(case when label = -1 then 0.5 when count(*) over (partition by label) = 1 then 1 else 1 - d / case when max(d) over (partition by label) > 0 then max(d) over (partition by label) else 1 end end, 4) as centrality from d)"""


@query(f"with {CENTRALITY_SQL} select vec_id, cluster_id, centrality from cent")
def clu_centrality(spark, sf_dir):
    return centrality(table(spark, sf_dir, "embeddings"))


@query(f"with {CENTRALITY_SQL}, r as (select *, row_number() over (partition by cluster_id order by centrality desc, vec_id) as n from cent) select cluster_id, vec_id, n, n = 1 as is_primary from r where n <= 3")
def win_top_central(spark, sf_dir):
    """The three most central members of each cluster; the first is its primary."""
    n = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("centrality"), "vec_id"))
    return centrality(table(spark, sf_dir, "embeddings")).withColumn("n", n).where("n <= 3").select("cluster_id", "vec_id", "n", (F.col("n") == 1).alias("is_primary"))


def dimensions(n: int) -> int | None:
    """Dimensions to reduce ``n`` vectors to: none under five, else up to 30 and two fewer than there are."""
    return None if n < 5 else min(30, max(2, n - 2))


def hybrid_clusters(vectors: DataFrame, files_: DataFrame, now, k: int | None = None) -> DataFrame:
    """vec_id, tenant, cluster_id, relevance, importance, importance_label, is_primary of ``vectors`` (tenant, vec_id, embedding).

    Density clusters over the graph of each tenant's nearest neighbours; relevance is the centrality in the cluster. Noise is a cluster of its
    own: relevance 1, centrality 0.5. The most central file is its cluster's primary one; ties go to the smaller id. ``files_``: file_id,
    extracted_text, uploaded_at, source_of_truth. Vectors without a direction are in no cluster and left out.
    """
    asked = vectors.select(F.col("tenant").cast("string").alias("tenant"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    graph = neighbours.neighbours(asked, k or neighbours.K)
    found = vectors.join(density.density_clusters(graph).withColumnRenamed("id", "vec_id"), "vec_id", "left")
    usable = neighbours.unit_vectors(asked).select(F.col("id").alias("vec_id"))
    found = found.join(usable, "vec_id", "left_semi")
    grouped = store.write_table(found, store.new_path(vectors.sparkSession, "clustered"))
    central = centrality(grouped.where("cluster_id is not null").select("vec_id", F.col("cluster_id").alias("label"), "embedding")).select("vec_id", "centrality")
    placed = grouped.join(central, "vec_id", "left").join(files_.select(F.col("file_id").alias("vec_id"), F.length("extracted_text").alias("length"), "uploaded_at", "source_of_truth"), "vec_id", "left")
    score = scoring.importance(F.col("length"), F.coalesce("centrality", F.lit(0.5)), F.col("uploaded_at"), now, F.coalesce("source_of_truth", F.lit(False)), F.lit(0))
    noise = F.col("cluster_id").isNull()
    first = F.min(F.struct((-F.col("centrality")).alias("far"), "vec_id"))
    primary = central.join(grouped.select("vec_id", "cluster_id"), "vec_id").groupBy("cluster_id").agg(first.alias("x")).select("cluster_id", F.col("x.vec_id").alias("primary_id"))
    return placed.join(primary, "cluster_id", "left").select(
        "vec_id",
        "tenant",
        F.when(noise, F.concat(F.lit("c_noise_"), F.col("vec_id").cast("string"))).otherwise(F.concat(F.lit("c_"), F.col("cluster_id").cast("string"))).alias("cluster_id"),
        F.coalesce("centrality", F.lit(1.0)).alias("relevance"),
        score.alias("importance"),
        scoring.importance_label(score).alias("importance_label"),
        F.coalesce(F.col("vec_id") == F.col("primary_id"), noise).alias("is_primary"),
    )


def _tenants(spark: SparkSession, sf_dir: str, tenants: int = 4) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % tenants).alias("tenant"), "embedding")


@query()
def clu_density(spark, sf_dir, tenants: int = 4):
    """The density clusters of each tenant's vectors, with relevance and importance of their files; noise files are clusters of their own.

    SQL can't express it: tests hold clusters against merge trees, and neighbours against all pairs.
    """
    return hybrid_clusters(_tenants(spark, sf_dir, tenants), files(spark, sf_dir), as_of())


_PAIRS_SQL = """u as (select vec_id as id, vec_id % 4 as tenant, embedding::double[] as v from embeddings), p as (select a.tenant::varchar as tenant, a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as c from u a join u b on a.tenant = b.tenant and a.id <> b.id)"""


@query(f"""with {_PAIRS_SQL}, d as (select tenant, a, b, round(sqrt(greatest(2 - 2 * c, 0)), 6) as distance, row_number() over (partition by a order by round(sqrt(greatest(2 - 2 * c, 0)), 6), b) as rank from p) select tenant, a, b, distance, rank from d where rank <= 15""")
def vec_exact_graph(spark, sf_dir):
    """The fifteen nearest neighbours of each vector in its tenant, from all pairs in blocks."""
    graph = neighbours.exact_neighbours(_tenants(spark, sf_dir).select("tenant", F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    return graph.withColumn("rank", F.col("rank").cast("long"))


@query()
def vec_fuzzy_graph(spark, sf_dir):
    """Fuzzy weights of the neighbour graph's edges; tests hold lists against all pairs and weights against plain bisection."""
    return neighbours.fuzzy_edges(neighbours.neighbours(_tenants(spark, sf_dir).select("tenant", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))))
