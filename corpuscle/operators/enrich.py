"""Summaries by map and reduce, metadata, hashed embeddings, and smaller filters, sets and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring, text
from corpuscle.operators.relational import EDGES_SQL, EVENTS_SQL, FILES_SQL, TAGS_SQL, USERS_SQL
from corpuscle.sources.tables import as_of, edges, events, files, table, tags, users

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Texts beyond this many characters are summarised in chunks.
MAP_REDUCE_FROM = 5500


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def map_reduce_summary(docs: DataFrame, summarise, merge=None) -> DataFrame:
    """file_id, summary, n_parts, mode of ``docs`` (file_id, extracted_text).

    ``summarise`` is a function of a column, run on whole short texts or on the chunks of long ones, which are spread over tasks; ``merge``
    joins an ordered array of parts. A part that gives nothing stands as a placeholder.
    """
    merge = merge or (lambda parts: F.array_join(parts, "\n"))
    long = F.length("extracted_text") > MAP_REDUCE_FROM
    parts = F.when(long, text.slices(F.col("extracted_text"), 10000)).otherwise(F.array("extracted_text"))
    chunks = docs.select("file_id", long.alias("long"), F.posexplode(parts).alias("part", "chunk"))
    mini = chunks.withColumn("mini", F.coalesce(summarise(F.col("chunk")), F.lit("[part missing]")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", "mini"))), lambda x: x["mini"])
    return mini.groupBy("file_id").agg(merge(ordered).alias("summary"), F.count("*").alias("n_parts"), F.when(F.first("long"), "mapreduce").otherwise("simple").alias("mode"))


@query("""with c as (select doc_id, length(text) > 5500 as long, unnest(case when length(text) > 5500 then range(0, ceil(length(text) / 10000.0)::bigint) else [0] end) as i, text from documents),
m as (select doc_id, long, i, left(case when long then substr(text, i * 10000 + 1, 10000) else text end, 60) as mini from c) select doc_id as file_id, string_agg(mini, chr(10) order by i) as summary, count(*) as n_parts, case when any_value(long) then 'mapreduce' else 'simple' end as mode from m group by 1""")
def sum_map_reduce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with the first characters of a chunk for a model."""
    return map_reduce_summary(files(spark, sf_dir), lambda c: F.left(c, F.lit(60)))


@query(f"""with {FILES_SQL} select file_id, length(coalesce(case when summarised then left(extracted_text, 100) end, left(extracted_text, 1500))) as read_chars, case when sot then 'trusted' else 'plain' end as trust,
 case when d <= 7 then 'current' when d <= 30 then 'aging' else 'stale' end as freshness from (select *, floor((epoch(timestamp '2024-02-01') - epoch(uploaded_at)) / 86400) as d from files) where processing_status <> 'deleted_in_drive'""")
def enr_metadata(spark, sf_dir):
    """Metadata of files: what is read for it, trust, freshness."""
    source = F.coalesce(F.when(F.col("summarised"), F.left("extracted_text", F.lit(100))), F.left("extracted_text", F.lit(1500)))
    f = files(spark, sf_dir).where("processing_status <> 'deleted_in_drive'")
    return f.select("file_id", F.length(source).cast("long").alias("read_chars"), F.when(F.col("source_of_truth"), "trusted").otherwise("plain").alias("trust"), scoring.freshness(F.col("uploaded_at"), as_of()).alias("freshness"))


def hashed_embedding(docs: DataFrame, dims: int = 16) -> DataFrame:
    """file_id, dim, weight: token counts by a hash of the token, normed. Blank texts have none."""
    t = docs.select("file_id", F.explode(text.tokens(F.col("extracted_text"))).alias("term"))
    bucket = F.pmod(F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("long"), F.lit(dims)).cast("int")
    counts = t.groupBy("file_id", bucket.alias("dim")).agg(F.count("*").alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("file_id")))
    return counts.select("file_id", "dim", F.round(F.col("n") / norm, 6).alias("weight"))


@query(r"""with t as (select doc_id as file_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{0E00}-\x{0E7F}]+')) as term from documents),
c as (select file_id, (('0x' || md5(term)[1:6])::bigint % 16)::int as dim, count(*) as n from t group by all) select file_id, dim, round(n / sqrt(sum(n * n) over (partition by file_id)), 6) as weight from c""")
def emb_hashed(spark, sf_dir):
    """The default embedder: hashed token counts."""
    return hashed_embedding(files(spark, sf_dir))


@query("""select o_custkey as pack_id, count(*) as n from orders group by 1 having bool_or(o_orderkey % 500 = 1)""")
def flt_packs_with(spark, sf_dir):
    """Packs whose id array holds one of some ids: typed arrays, no text search."""
    packs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("pack_id")).agg(F.collect_list("o_orderkey").alias("ids"))
    return packs.where(F.exists("ids", lambda i: i % 500 == 1)).select("pack_id", F.size("ids").cast("long").alias("n"))


@query(f"""with {EDGES_SQL}, seen as (select 'p' || p_partkey as node from part where p_size < 10 union all select 's' || s_suppkey from supplier where s_acctbal > 0)
select source, target from edges where edge_type = 'derived_from' and source in (select node from seen) and target in (select node from seen)""")
def flt_visible_edges(spark, sf_dir):
    """Edges both of whose ends are visible: two semi joins."""
    node = lambda kind, key, df: df.select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("node"))
    seen = node("p", "p_partkey", table(spark, sf_dir, "part").where("p_size < 10")).union(node("s", "s_suppkey", table(spark, sf_dir, "supplier").where("s_acctbal > 0")))
    e = edges(spark, sf_dir).where("edge_type = 'derived_from'")
    return e.join(seen, e["source"] == seen["node"], "left_semi").join(seen, F.col("target") == seen["node"], "left_semi").select("source", "target")


@query("""select c_custkey as user_id, case when c_custkey % 5 = 0 then '' when c_custkey % 5 = 1 then '[]' when c_custkey % 5 = 2 then 'null' else '["x"]' end not in ('', '[]', 'null') as enriched, (c_custkey % 5 > 2 or c_acctbal < 0) as complete from customer""")
def flt_profiles(spark, sf_dir):
    """Whether something was enriched already, and whether a profile says anything."""
    k = F.col("c_custkey") % 5
    tags_ = F.when(k == 0, "").when(k == 1, "[]").when(k == 2, "null").otherwise('["x"]')
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), (~tags_.isin("", "[]", "null")).alias("enriched"), ((k > 2) | (F.col("c_acctbal") < 0)).alias("complete"))


@query(f"with {EDGES_SQL} select source, target, weight from edges order by weight desc, source, target limit 5000")
def srt_edge_cap(spark, sf_dir, asked: int = 5000, most: int = 50000):
    """The heaviest edges, up to what is asked for and a hard cap."""
    return edges(spark, sf_dir).orderBy(F.desc("weight"), "source", "target").limit(min(asked, most)).select("source", "target", "weight")


@query(f"""with {FILES_SQL}, newest as (select file_id, uploaded_at from files order by uploaded_at desc, file_id limit 20) select e.label as cluster_id, string_agg(n.file_id::varchar, ',' order by n.uploaded_at desc, n.file_id) as file_ids
from newest n left join embeddings e on e.vec_id = n.file_id group by 1""")
def agg_newest_by_cluster(spark, sf_dir):
    """The newest twenty files, grouped by their cluster."""
    newest = files(spark, sf_dir).orderBy(F.desc("uploaded_at"), "file_id").limit(20).select("file_id", "uploaded_at")
    e = table(spark, sf_dir, "embeddings")
    ids = F.transform(F.array_sort(F.collect_list(F.struct((-F.unix_timestamp("uploaded_at")).alias("newest"), "file_id"))), lambda x: x["file_id"].cast("string"))
    return newest.join(e, newest["file_id"] == e["vec_id"], "left").groupBy(F.col("label").alias("cluster_id")).agg(F.array_join(ids, ",").alias("file_ids"))


@query(f"""with {USERS_SQL} select user_id, epoch(case when status like 'starter%' and period_end is not null then period_end - interval 30 days else timestamp '2024-02-01' end)::bigint as counts_from, status in ('starter_canceled') and period_end <= timestamp '2024-02-01' as expired,
 (select count(*) from users a where a.is_admin and a.is_active) - case when is_admin and is_active then 1 else 0 end as other_admins from users""")
def dt_billing_start(spark, sf_dir):
    """From when a user's uses count: a billing period, or the month; whether a cancelled one has run out; and how many other admins there are."""
    u = users(spark, sf_dir)
    start = F.when(F.col("subscription_status").startswith("starter") & F.col("current_period_end").isNotNull(), F.col("current_period_end") - F.expr("interval 30 days")).otherwise(F.date_trunc("month", as_of()))
    admins = u.agg(F.count_if(F.col("is_admin") & F.col("is_active")).alias("admins"))
    own = F.when(F.col("is_admin") & F.col("is_active"), 1).otherwise(0)
    return u.withColumn("admins", admins.scalar()).select("user_id", F.unix_timestamp(start).alias("counts_from"), ((F.col("subscription_status") == "starter_canceled") & (F.col("current_period_end") <= as_of())).alias("expired"), (F.col("admins") - own).alias("other_admins"))


@query(f"""with {TAGS_SQL}, t as (select file_id, list_sort(list(tag)) as ts from tags group by 1) select a.file_id as source, b.file_id as target, len(list_intersect(a.ts, b.ts)) as shared, len(list_filter(a.ts, lambda x: not list_contains(b.ts, x))) as only_source from t a join t b on b.file_id = a.file_id + 1""")
def set_tag_overlap(spark, sf_dir):
    """Tag sets of neighbouring files: what they share and what only the first has."""
    t = tags(spark, sf_dir).groupBy("file_id").agg(F.collect_set("tag").alias("ts"))
    a, b = t.alias("a"), t.alias("b")
    return a.join(b, F.col("b.file_id") == F.col("a.file_id") + 1).select(F.col("a.file_id").alias("source"), F.col("b.file_id").alias("target"), F.size(F.array_intersect("a.ts", "b.ts")).cast("long").alias("shared"), F.size(F.array_except("a.ts", "b.ts")).cast("long").alias("only_source"))


@query(f"""with {EVENTS_SQL}, q as (select *, case when k % 3 = 0 then 1 when k % 3 = 1 then 2 else 3 end as class, row_number() over (partition by user_id order by created_at, event_id) as pos from ev where action in ('view', 'click'))
select event_id, user_id, class from q order by pos, class, created_at, event_id limit 40""")
def que_claim(spark, sf_dir, n: int = 40):
    """The next jobs to claim: fair by user, then by class, then by age."""
    q = events(spark, sf_dir).where(F.col("action").isin("view", "click"))
    class_ = F.when(F.col("k") % 3 == 0, 1).when(F.col("k") % 3 == 1, 2).otherwise(3)
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "event_id"))
    return q.withColumns({"class": class_, "pos": pos}).orderBy("pos", "class", "created_at", "event_id").limit(n).select("event_id", "user_id", "class")


@query("""with h as (select user_id, max(ts) as beat from events group by 1) select user_id, floor(epoch(timestamp '2024-01-30 12:00:00') - epoch(beat))::bigint as age, epoch(timestamp '2024-01-30 12:00:00') - epoch(beat) < 21600 as alive from h""")
def que_liveness(spark, sf_dir, seconds: int = 21600):
    """Which workers gave a sign of life lately."""
    age = F.unix_micros(as_of("2024-01-30 12:00:00")) / 1e6 - F.unix_micros(F.max("created_at")) / 1e6
    return events(spark, sf_dir).groupBy("user_id").agg(F.floor(age).alias("age"), (age < seconds).alias("alive"))
