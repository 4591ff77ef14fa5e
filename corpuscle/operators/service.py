"""Retrieval context, context memory, admission, queue health, recovery, packs and mutations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring, text
from corpuscle.operators.graph import INSIGHTS_SQL, file_insights
from corpuscle.operators.ordered import folded
from corpuscle.operators.relational import EVENTS_SQL, FILES_SQL, MEMORIES_SQL, USERS_SQL
from corpuscle.sources.tables import as_of, cluster_map, events, files, memories, packs, table, users

QUERIES: dict = {}
SQL: dict[str, str] = {}
BUDGET = 12000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def budget_fold(parts, budget: int = BUDGET):
    """Over an ordered array of structs with field n: what is taken. A part that does not fit is passed over, later ones may still fit."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<long>").alias("taken"))
    return F.aggregate(
        parts,
        start,
        lambda acc, p: F.when(acc["used"] + p["n"] < budget, F.struct((acc["used"] + p["n"]).alias("used"), F.concat(acc["taken"], F.array(p["id"].cast("long"))).alias("taken"))).otherwise(acc),
    )


@query(f"""with {FILES_SQL}, p as (select user_id, list({{'id': file_id, 'n': least(length(extracted_text), case file_id % 3 when 0 then 300 when 1 then 2000 else 6000 end)}} order by uploaded_at desc, file_id) as ps from files group by 1),
f as (select user_id, list_reduce(list_prepend({{'used': 0::bigint, 'ids': ''}}, list_transform(ps, lambda p: {{'used': p.n::bigint, 'ids': p.id::varchar}})), lambda acc, p: case when acc.used + p.used < 12000 then {{'used': acc.used + p.used, 'ids': acc.ids || ' ' || p.ids}} else acc end) as r from p)
select user_id, r.used as used_chars, trim(r.ids) as file_ids from f""")
def ret_budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context of each tenant: newest files first, as summary, excerpt or raw text, while the character budget lasts."""
    packed = budget_pack(files(spark, sf_dir))
    return packed.select("user_id", "used_chars", F.array_join(F.col("file_ids").cast("array<string>"), " ").alias("file_ids"))


def budget_pack(files_: DataFrame, budget: int = BUDGET) -> DataFrame:
    """user_id, used_chars, file_ids: what of each tenant's files is packed, newest first; a file that doesn't fit is passed over.

    A fold over ranges of the tenants' files: the state is the number of characters used."""
    mode = F.when(F.col("file_id") % 3 == 0, 300).when(F.col("file_id") % 3 == 1, 2000).otherwise(6000)
    f = files_.select("user_id", (-F.unix_micros("uploaded_at")).alias("newest"), "file_id", F.coalesce(F.least(F.length("extracted_text"), mode), F.lit(0)).alias("n"))
    used = folded(f.where("user_id is not null"), ["user_id"], ["newest", "file_id"], ["n"], budget, 0, lambda states, row: np.where(states + row[0] < budget, states + row[0], states))
    taken = F.when(F.col("before") + F.col("n") < budget, F.struct("newest", F.col("file_id").cast("long").alias("id")))
    packed = used.groupBy("user_id").agg(F.max("after").alias("used_chars"), F.array_sort(F.collect_list(taken)).alias("x"))
    return packed.select("user_id", "used_chars", F.col("x.id").alias("file_ids"))


@query(f"""with {FILES_SQL}, n as (select *, row_number() over (partition by user_id order by file_id) as k from files)
select user_id, string_agg('- ' || filename || ': ' || left(replace(extracted_text, chr(10), ' '), 40), chr(10) order by file_id) as inventory from n where k <= 5 group by 1""")
def ret_inventory(spark, sf_dir):
    """A tenant's inventory as text: a line each of its first files."""
    f = files(spark, sf_dir).withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("file_id"))).where("k <= 5")
    line = F.concat(F.lit("- "), "filename", F.lit(": "), F.left(F.replace("extracted_text", F.lit("\n"), F.lit(" ")), F.lit(40)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("file_id", line.alias("line")))), lambda x: x["line"])
    return f.groupBy("user_id").agg(F.array_join(lines, "\n").alias("inventory"))


@query(f"""with {MEMORIES_SQL}, g as (select *, case when epoch(updated_at) - lag(epoch(updated_at)) over w <= 7200 then 0 else 1 end as opens from memories window w as (partition by user_id, title order by updated_at, memory_id)),
s as (select *, sum(opens) over (partition by user_id, title order by updated_at, memory_id rows unbounded preceding) as part from g)
select user_id, title, part::bigint as part, count(*) as n, sum(length(content))::bigint as chars, min(memory_id) as first_id from s group by all""")
def mem_smart_merge(spark, sf_dir):
    """Memories of one title merge while each comes within two hours of the one before."""
    w = Window.partitionBy("user_id", "title").orderBy("updated_at", "memory_id")
    at = F.unix_timestamp("updated_at")
    m = memories(spark, sf_dir).withColumn("opens", F.when(at - F.lag(at).over(w) <= 7200, 0).otherwise(1))
    m = m.withColumn("part", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy("user_id", "title", "part").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"), F.min("memory_id").alias("first_id"))


@query(f"with {MEMORIES_SQL} select user_id, count(*) as active, count(*) filter (where is_pinned) as pinned, count(*) filter (where is_pinned) >= 3 as pins_full from memories group by 1")
def mem_counts(spark, sf_dir):
    m = memories(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("active"), F.count_if("is_pinned").alias("pinned"))
    return m.withColumn("pins_full", F.col("pinned") >= 3)


@query(f"""with {FILES_SQL}, {INSIGHTS_SQL}, c as (select vec_id as file_id, label from embeddings)
select f.user_id, 'file' as kind, f.file_id::varchar as id, '- ' || filename || ' (cluster: ' || coalesce('cluster ' || label, '-') || ', importance: ' || case when importance >= 70 then 'high' when importance >= 40 or importance is null then 'medium' else 'low' end || case when sot then ', trusted' else '' end || ')' as line
 from files f left join c using (file_id) left join ins using (file_id)
union all select f.user_id, 'cluster', label::varchar, '- cluster ' || label || ' (' || count(*) || ' files)' from files f join c using (file_id) group by f.user_id, label
union all select 'src' || o_orderkey % 20, 'pack', o_orderkey::varchar, '- pack ' || o_orderkey || ' (' || count(distinct l_partkey) || ' sources' || case when o_orderkey % 9 = 0 then ', locked' else '' end || ')' from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey""")
def ret_inventory_lines(spark, sf_dir):
    """All that a tenant has, as lines for a model that chooses sources: files with cluster, importance and trust, clusters with their size, packs with
    theirs. A row a line, so that no tenant's inventory is one value."""
    f = files(spark, sf_dir)
    members = cluster_map(spark, sf_dir).select("file_id", "cluster_id")
    text_ = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    label = F.when(F.col("importance").isNull(), "medium").otherwise(scoring.importance_label(F.col("importance")))
    cluster = F.coalesce(text_("cluster ", F.col("cluster_id").cast("string")), F.lit("-"))
    known = f.join(members, "file_id", "left").join(file_insights(f, as_of()), "file_id", "left")
    trust = F.when(F.col("source_of_truth"), ", trusted").otherwise("")
    file_lines = known.select("user_id", F.lit("file").alias("kind"), F.col("file_id").cast("string").alias("id"), text_("- ", F.col("filename"), " (cluster: ", cluster, ", importance: ", label, trust, ")").alias("line"))
    sizes = f.join(members, "file_id").groupBy("user_id", "cluster_id").agg(F.count("*").alias("n"))
    name = F.col("cluster_id").cast("string")
    cluster_lines = sizes.select("user_id", F.lit("cluster").alias("kind"), name.alias("id"), text_("- cluster ", name, " (", F.col("n").cast("string"), " files)").alias("line"))
    p = packs(spark, sf_dir).withColumn("n", F.size(F.from_json("source_file_ids", "array<long>")))
    locked = F.when(F.col("is_locked"), ", locked").otherwise("")
    pack_lines = p.select("user_id", F.lit("pack").alias("kind"), F.col("pack_id").cast("string").alias("id"), text_("- ", F.col("title"), " (", F.col("n").cast("string"), " sources", locked, ")").alias("line"))
    return file_lines.unionByName(cluster_lines).unionByName(pack_lines)


@query(f"""with {MEMORIES_SQL}, r as (select *, row_number() over (partition by user_id order by updated_at desc, memory_id) as n from memories)
select user_id, memory_id, title, is_pinned, row_number() over (partition by user_id order by is_pinned desc, n) as place from r where is_pinned or n = 1""")
def mem_profile_bundle(spark, sf_dir):
    """What a profile carries of its memories: the pinned ones, newest first, and the latest one if it is not pinned; titles, no contents."""
    newest = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "memory_id"))
    m = memories(spark, sf_dir).withColumn("n", newest).where("is_pinned or n = 1")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("is_pinned"), "n"))
    return m.select("user_id", "memory_id", "title", "is_pinned", place.cast("long").alias("place"))


@query(f"""with {FILES_SQL}, r as (select *, strlen(extracted_text) / 1024.0 as kb, row_number() over (partition by user_id order by file_id) as k, sum(strlen(extracted_text)) over (partition by user_id order by file_id rows unbounded preceding) as total from files)
select file_id, case when extracted_text = '' then 'empty' when kb > 20 then 'too_large' when k > 50 then 'too_many' when total > 100000 then 'storage_full' else 'ok' end as verdict from r""")
def ten_upload_allowed(spark, sf_dir):
    """The first rule that an upload breaks: emptiness, size, number, storage."""
    w = Window.partitionBy("user_id").orderBy("file_id")
    size = F.octet_length("extracted_text")
    f = files(spark, sf_dir).withColumns({"k": F.row_number().over(w), "total": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    verdict = F.when(F.col("extracted_text") == "", "empty").when(size / 1024.0 > 20, "too_large").when(F.col("k") > scoring.PLAN_LIMITS["free"]["files"], "too_many").when(F.col("total") > 100000, "storage_full").otherwise("ok")
    return f.select("file_id", verdict.alias("verdict"))


@query(f"""with {EVENTS_SQL}, u as (select user_id, count(*) filter (where action = 'view') as v, count(*) filter (where action = 'click') as c, count(*) filter (where action = 'signup') as s from ev where created_at >= timestamp '2024-01-01' group by 1), p as (select * from planned)
, {USERS_SQL} select u.user_id, p.plan, v < case p.plan when 'admin' then 999999 when 'starter' then 1000 else 50 end as may_summarise, s < case p.plan when 'admin' then 999999 when 'starter' then 50 else 5 end as may_share, greatest(case p.plan when 'admin' then 999999 when 'starter' then 3000 else 100 end - c, 0) as exports_left
from u join planned p using (user_id)""".replace(", p as (select * from planned)\n", "\n"))
def ten_quota_gates(spark, sf_dir):
    """What each user may still do this period, by the limits of the plan in effect."""
    since = events(spark, sf_dir).where(F.col("created_at") >= F.lit("2024-01-01").cast("timestamp"))
    used = since.groupBy("user_id").agg(*[F.count_if(F.col("action") == a).alias(n) for a, n in (("view", "v"), ("click", "c"), ("signup", "s"))])
    plan = scoring.effective_plan(F.col("is_admin"), F.col("subscription_status"), F.col("current_period_end"), as_of())
    u = used.join(users(spark, sf_dir).select("user_id", plan.alias("plan")), "user_id")
    limit = lambda what: scoring.plan_limit(F.col("plan"), what)
    return u.select("user_id", "plan", (F.col("v") < limit("summaries")).alias("may_summarise"), (F.col("s") < limit("shares")).alias("may_share"), F.greatest(limit("exports") - F.col("c"), F.lit(0)).alias("exports_left"))


@query(f"""with {EVENTS_SQL} select count(*) filter (where action = 'view') as queued, count(*) filter (where action = 'error') as failed, count(*) filter (where action = 'purchase') as done,
 (floor(epoch(timestamp '2024-01-31')) - floor(epoch(min(created_at) filter (where action = 'view'))))::bigint as oldest_seconds, (floor(epoch(timestamp '2024-01-31')) - floor(epoch(min(created_at) filter (where action = 'view')))) > 300 as alert from ev where created_at >= timestamp '2024-01-29'""")
def que_health(spark, sf_dir):
    """Queue counts, the oldest job's age and whether that calls for an alert: one pass of conditional aggregates."""
    e = events(spark, sf_dir).where(F.col("created_at") >= F.lit("2024-01-29").cast("timestamp"))
    n = lambda a: F.count_if(F.col("action") == a)
    age = F.unix_timestamp(as_of("2024-01-31 00:00:00")) - F.unix_timestamp(F.min(F.when(F.col("action") == "view", F.col("created_at"))))
    return e.agg(n("view").alias("queued"), n("error").alias("failed"), n("purchase").alias("done"), age.alias("oldest_seconds"), (age > 300).alias("alert"))


@query(f"""with {EVENTS_SQL} select event_id, case when action = 'view' then 'queued' when action = 'click' and value > 50 then 'uploaded' when action = 'click' then 'error' else 'unchanged' end as new_status, k < 3 and action = 'error' as retry,
 least(30.0, 2 * 2.0 ** (k % 5))::double as wait_seconds from ev""")
def que_recover(spark, sf_dir):
    """What becomes of jobs that a restart finds: half-read ones queue again, finished ones stand, phantoms fail; and which retry, when."""
    e = events(spark, sf_dir)
    status = F.when(F.col("action") == "view", "queued").when((F.col("action") == "click") & (F.col("value") > 50), "uploaded").when(F.col("action") == "click", "error").otherwise("unchanged")
    return e.select("event_id", status.alias("new_status"), ((F.col("k") < 3) & (F.col("action") == "error")).alias("retry"), scoring.backoff_seconds(F.col("k") % 5).alias("wait_seconds"))


@query("""with new as (select s_suppkey as id, s_acctbal + 1 as v from supplier where s_suppkey % 4 = 0 union all select s_suppkey + 100000, 0.5 from supplier where s_suppkey % 10 = 0)
select coalesce(n.id, o.s_suppkey) as id, coalesce(n.v, o.s_acctbal) as v, n.id is not null as changed from supplier o full join new n on n.id = o.s_suppkey""")
def snk_upsert(spark, sf_dir):
    """An upsert as a new snapshot: changed rows over old ones, new rows added."""
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    new = old.where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal") + 1).alias("v")).unionByName(old.where("s_suppkey % 10 = 0").select((F.col("s_suppkey") + 100000).alias("id"), F.lit(0.5).alias("v")))
    return old.join(new, old["s_suppkey"] == new["id"], "full_outer").select(F.coalesce("id", "s_suppkey").alias("id"), F.coalesce("v", "s_acctbal").alias("v"), F.col("id").isNotNull().alias("changed"))


@query("""select o_custkey as pack_id, sha256('src9' || chr(31) || o_orderkey)[1:12] as new_id, o_orderkey as source_id from orders where o_orderstatus <> 'F'""")
def snk_clone_pack(spark, sf_dir):
    """Rows cloned to another tenant under derived ids, locked ones left out."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'")
    return o.select(F.col("o_custkey").alias("pack_id"), F.substring(F.sha2(F.concat_ws("\u001f", F.lit("src9"), F.col("o_orderkey").cast("string")), 256), 1, 12).alias("new_id"), F.col("o_orderkey").alias("source_id"))


@query(f"with {FILES_SQL} select file_id, regexp_replace(user_id || '_' || file_id || ' summary', '[^A-Za-z0-9_.-]', '_', 'g') as name, '---' || chr(10) || 'file: ' || filename || chr(10) || '---' || chr(10) || left(extracted_text, 100) as body from files where summarised")
def snk_summary_markdown(spark, sf_dir):
    """Summary files: a safe name, front matter and a body."""
    f = files(spark, sf_dir).where("summarised")
    name = text.safe_filename(F.concat("user_id", F.lit("_"), F.col("file_id").cast("string"), F.lit(" summary.md")))
    return f.select("file_id", name.alias("name"), F.concat(F.lit("---\nfile: "), "filename", F.lit("\n---\n"), F.left("extracted_text", F.lit(100))).alias("body"))


@query("""select role as platform, count(*) as n, sum(case when text ilike '%http%' then 1 else 0 end)::bigint as with_url, round(avg(length(text)), 3) as chars from conversations group by 1""")
def agg_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(F.col("role").alias("platform")).agg(F.count("*").alias("n"), F.count_if(F.col("text").ilike("%http%")).alias("with_url"), F.round(F.avg(F.length("text")), 3).alias("chars"))
