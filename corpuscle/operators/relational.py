"""Filters, joins, aggregates, rankings and pages of the entity tables, and the queries that apply them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring, text
from corpuscle.operators.ordered import folded
from corpuscle.sources.tables import as_of, cluster_map, edges, events, files, memories, table, tags, users

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The views that the SQL of several queries starts with.
FILES_SQL = """files as (
  select d.doc_id as file_id, d.source as user_id, d.source || '/' || d.doc_id || '.' || d.lang as filename, d.lang as filetype,
         timestamp '2024-01-01' + to_hours(d.doc_id::int) as uploaded_at, d.text as extracted_text, coalesce(l.quality = 1, false) as sot,
         l.quality is not null as summarised, case when d.doc_id % 7 = 0 then 'vault_only' else 'processed' end as file_kind,
         case when length(d.text) < 50 then 'empty' when d.doc_id % 11 = 0 then 'ocr_failed' else 'ok' end as extraction_status,
         case when d.doc_id % 13 = 0 then 'deleted_in_drive' when l.quality is not null then 'ready' else 'uploaded' end as processing_status
  from documents d left join labels l using (doc_id))"""
EVENTS_SQL = "ev as (select event_id, ts as created_at, user_id, event_type as action, value, (props->>'$.k')::bigint as k from events)"
USERS_SQL = """users as (
  select c_custkey as user_id, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '.', 'g')) || '@example.org' as email, c_custkey % 97 = 0 as is_admin, c_custkey % 10 <> 3 as is_active,
         case c_mktsegment when 'AUTOMOBILE' then 'starter_active' when 'MACHINERY' then 'starter_past_due' when 'HOUSEHOLD' then 'starter_canceled' else 'free' end as status,
         case when c_custkey % 2 = 0 then timestamp '2024-03-01' else timestamp '2024-01-15' end as period_end,
         timestamp '2024-02-01' - to_days((c_custkey % 60)::int) as created_at, c_acctbal as balance from customer),
planned as (select *, case when is_admin then 'admin' when status in ('starter_active', 'starter_past_due') then 'starter'
                           when status = 'starter_canceled' and period_end > timestamp '2024-02-01' then 'starter' else 'free' end as plan from users)"""
EDGES_SQL = """edges as (
  select 'o' || l_orderkey as source, 'p' || l_partkey as target, 'contains' as edge_type, round(max(l_quantity) / 50, 6) as weight from lineitem group by all
  union all select distinct 'p' || l_partkey, 's' || l_suppkey, 'derived_from', 0.9 from lineitem)"""
TAGS_SQL = "tags as (select distinct l_orderkey as file_id, p_brand || ' ' || p_type as tag from lineitem join part on l_partkey = p_partkey)"
MEMORIES_SQL = """memories as (
  select conv_id || '-' || turn as memory_id, 'topic ' || conv_id % 25 as title, 'src' || conv_id % 20 as user_id, conv_id, turn, role as platform, text as content,
         timestamp '2024-01-01' + to_days(conv_id::int) + to_minutes((turn * 45 + case when turn >= 3 then 180 else 0 end)::bigint) as updated_at,
         (conv_id + turn) % 10 = 0 as is_pinned from conversations)"""


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Filters and pages


@query(f"with {FILES_SQL} select file_id, user_id, filename, filetype from files where file_kind = 'processed' and processing_status <> 'deleted_in_drive'")
def flt_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a kind, without those deleted elsewhere."""
    f = files(spark, sf_dir)
    return f.where((F.col("file_kind") == "processed") & (F.col("processing_status") != "deleted_in_drive")).select("file_id", "user_id", "filename", "filetype")


@query(f"with {FILES_SQL} select file_id, user_id from files where extracted_text <> '' and file_kind = 'processed' and extraction_status = 'ok'")
def flt_organizable(spark, sf_dir):
    """Files that can be organised: with text, processed, extracted well."""
    return files(spark, sf_dir).where("extracted_text <> '' and file_kind = 'processed' and extraction_status = 'ok'").select("file_id", "user_id")


@query(f"with {MEMORIES_SQL} select memory_id, user_id from memories where title ilike '%topic 1%' or content ilike '%the%'")
def flt_context_search(spark, sf_dir):
    """Case-insensitive search over titles and contents."""
    return memories(spark, sf_dir).where(F.col("title").ilike("%topic 1%") | F.col("content").ilike("%the%")).select("memory_id", "user_id")


@query("""select doc_id as file_id, substr(text, 101, 500) as page, length(text) as total_chars, length(text) > 600 as has_more,
       case when length(text) > 600 then 600 end as next_offset from documents""")
def flt_page_window(spark, sf_dir, offset: int = 100, limit: int = 500):
    """A window of characters of each text; limits are clamped to 100..10,000."""
    limit, offset = min(max(limit, 100), 10000), max(offset, 0)
    more = F.length("text") > offset + limit
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.substring("text", offset + 1, limit).alias("page"), F.length("text").cast("long").alias("total_chars"), more.alias("has_more"), F.when(more, F.lit(offset + limit)).alias("next_offset"))


@query(f"with {EVENTS_SQL} select event_id, user_id, action, value from ev where action = 'error' and value > 100 and k is not null")
def flt_tool_log(spark, sf_dir):
    """Log rows by tool and status; each condition is optional."""
    return events(spark, sf_dir).where((F.col("action") == "error") & (F.col("value") > 100) & F.col("k").isNotNull()).select("event_id", "user_id", "action", "value")


@query(f"with {USERS_SQL} select user_id, email, plan from planned where email ilike '%customer%' and is_active and plan = 'starter' order by created_at desc, user_id limit 20 offset 20")
def srt_user_page(spark, sf_dir, page: int = 2, size: int = 20):
    """A page of accounts, newest first; the plan filters before the page is cut."""
    u = users(spark, sf_dir)
    plan = scoring.effective_plan(F.col("is_admin"), F.col("subscription_status"), F.col("current_period_end"), as_of())
    found = u.withColumn("plan", plan).where(F.col("email").ilike("%customer%") & F.col("is_active") & (F.col("plan") == "starter"))
    return found.orderBy(F.desc("created_at"), "user_id").offset((page - 1) * size).limit(size).select("user_id", "email", "plan")


# Joins


@query(f"with {FILES_SQL} select file_id, user_id from files f where not exists (select 1 from labels l where l.doc_id = f.file_id)")
def jn_unsummarised(spark, sf_dir):
    """Files without a summary."""
    f, s = files(spark, sf_dir), table(spark, sf_dir, "labels")
    return f.join(s, f["file_id"] == s["doc_id"], "left_anti").select("file_id", "user_id")


@query("select v.vec_id as node_id, v.label as cluster_id from embeddings v left join labels l on l.doc_id = v.vec_id where l.doc_id is null")
def jn_orphan_nodes(spark, sf_dir):
    """Nodes whose file is gone."""
    nodes, known = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels")
    return nodes.join(known, nodes["vec_id"] == known["doc_id"], "left_anti").select(F.col("vec_id").alias("node_id"), F.col("label").alias("cluster_id"))


@query("select n_nationkey as cluster_id, n_name as title from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 7000)")
def jn_empty_clusters(spark, sf_dir):
    """Clusters without members."""
    members = table(spark, sf_dir, "supplier").where("s_acctbal > 7000")
    n = table(spark, sf_dir, "nation")
    return n.join(members, n["n_nationkey"] == members["s_nationkey"], "left_anti").select(F.col("n_nationkey").alias("cluster_id"), F.col("n_name").alias("title"))


@query(f"""with {EDGES_SQL}, nodes as (select source as node from edges union select target from edges)
select node from nodes n where node like 'p%' and exists (select 1 from edges e where (e.source = n.node and e.target like 's1%') or (e.target = n.node and e.source like 'o1%'))""")
def jn_anchored_entities(spark, sf_dir):
    """Nodes with an edge, in either direction, to an anchor. Both directions become one table first, so the join is by key."""
    e = edges(spark, sf_dir)
    both = e.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("other")))
    nodes = both.select("node").distinct().where("node like 'p%'")
    outward = e.where("target like 's1%'").select(F.col("source").alias("node"))
    inward = e.where("source like 'o1%'").select(F.col("target").alias("node"))
    return nodes.join(outward.union(inward), "node", "left_semi")


@query("""select e.vec_id as file_id, string_agg(n.n_name, ', ' order by n.n_name) as titles, count(*) as n_clusters
from (select vec_id, label from embeddings union all select vec_id, (vec_id % 10)::int from embeddings) e join nation n on n.n_nationkey = e.label group by 1""")
def jn_file_clusters(spark, sf_dir):
    """The cluster titles of each file."""
    e = table(spark, sf_dir, "embeddings")
    bridge = e.select("vec_id", "label").union(e.select("vec_id", (F.col("vec_id") % 10).cast("int")))
    n = table(spark, sf_dir, "nation")
    joined = bridge.join(n, bridge["label"] == n["n_nationkey"])
    return joined.groupBy(F.col("vec_id").alias("file_id")).agg(F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("titles"), F.count("*").alias("n_clusters"))


@query("select vec_id as file_id, e.label as cluster_id, first_id, n_links from embeddings e join (select label, min(vec_id) as first_id, count(*) - 1 as n_links from embeddings group by 1 having count(*) > 1) using (label)")
def jn_comember_pairs(spark, sf_dir):
    """Links of files of one cluster: each file with its cluster's first one and the number of its links; all of a cluster are linked."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    classes = e.groupBy("label").agg(F.min("vec_id").alias("first_id"), (F.count("*") - 1).alias("n_links")).where("n_links > 0")
    return e.join(classes, "label").select(F.col("vec_id").alias("file_id"), F.col("label").alias("cluster_id"), "first_id", "n_links")


#: Files by pairs of their tags.
TAG_PAIRS_SQL = f"{TAGS_SQL}, pairs as (select a.file_id, a.tag as tag_a, b.tag as tag_b from tags a join tags b on a.file_id = b.file_id and a.tag < b.tag)"


def tag_pair_classes(tags_: DataFrame) -> DataFrame:
    """tag_a, tag_b, file_id, first_id, members: two files share two tags or more where they share a pair of tags, so such links are
    the classes of files by tag pair. A file of k tags is in k (k - 1) / 2 classes; classes of one file are left out."""
    of_file = tags_.groupBy("file_id").agg(F.array_sort(F.collect_set("tag")).alias("ts"))
    first = of_file.select("file_id", "ts", F.posexplode("ts").alias("i", "tag_a"))
    pairs = first.select("file_id", "tag_a", F.explode(F.slice("ts", F.col("i") + 2, F.size("ts"))).alias("tag_b"))
    classes = pairs.groupBy("tag_a", "tag_b").agg(F.min("file_id").alias("first_id"), F.count("*").alias("members")).where("members > 1")
    return pairs.join(classes, ["tag_a", "tag_b"])


@query(f"with {TAG_PAIRS_SQL}, c as (select tag_a, tag_b, min(file_id) as first_id, count(*) as members from pairs group by 1, 2 having count(*) > 1) select tag_a, tag_b, file_id, first_id, members from pairs join c using (tag_a, tag_b)")
def jn_shared_tag_pairs(spark, sf_dir):
    """Files that share two tags or more, as classes by tag pair with their first file."""
    return tag_pair_classes(tags(spark, sf_dir)).select("tag_a", "tag_b", "file_id", "first_id", "members")


@query("""select p_partkey as entity, first_id, n_links from part join (select lower(p_name) as label, min(p_partkey) as first_id, count(*) - 1 as n_links from part group by 1 having count(*) > 1) on lower(p_name) = label""")
def jn_same_label_pairs(spark, sf_dir):
    """Entities whose labels are equal but for case: each with the first of them and the number of its links."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("label"))
    classes = p.groupBy("label").agg(F.min("p_partkey").alias("first_id"), (F.count("*") - 1).alias("n_links")).where("n_links > 0")
    return p.join(classes, "label").select(F.col("p_partkey").alias("entity"), "first_id", "n_links")


@query(f"with {EDGES_SQL} select target as node, count(*) as backlinks, round(sum(weight), 4) as weight from edges where edge_type = 'contains' group by 1")
def jn_backlinks(spark, sf_dir):
    """Incoming edges of each node."""
    return edges(spark, sf_dir).where("edge_type = 'contains'").groupBy(F.col("target").alias("node")).agg(F.count("*").alias("backlinks"), F.round(F.sum("weight"), 4).alias("weight"))


@query("""with mine as (select s_suppkey as id, s_acctbal as version from supplier where s_suppkey % 5 <> 0), theirs as (select s_suppkey as id, case when s_suppkey % 3 = 0 then s_acctbal + 1 else s_acctbal end as version from supplier where s_suppkey % 7 <> 0)
select coalesce(m.id, t.id) as id, case when m.id is null then 'new' when t.id is null then 'deleted' when t.version > m.version then 'drifted' else 'same' end as state from mine m full join theirs t on m.id = t.id""")
def syn_reconcile(spark, sf_dir):
    """A local and a remote listing: new, deleted, drifted or the same."""
    s = table(spark, sf_dir, "supplier")
    mine = s.where("s_suppkey % 5 <> 0").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("version"))
    theirs = s.where("s_suppkey % 7 <> 0").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal")).alias("version"))
    m, t = mine.alias("m"), theirs.alias("t")
    state = F.when(F.col("m.id").isNull(), "new").when(F.col("t.id").isNull(), "deleted").when(F.col("t.version") > F.col("m.version"), "drifted").otherwise("same")
    return m.join(t, F.col("m.id") == F.col("t.id"), "full_outer").select(F.coalesce("m.id", "t.id").alias("id"), state.alias("state"))


@query("""select d.doc_id as file_id, e.vec_id is not null as hit from documents d left join embeddings e on e.vec_id = d.doc_id and e.label % 2 = d.doc_id % 2""")
def jn_cache_lookup(spark, sf_dir):
    """Whether a file's vector is cached under its key and model."""
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "embeddings")
    return d.join(e, (d["doc_id"] == e["vec_id"]) & (e["label"] % 2 == d["doc_id"] % 2), "left").select(d["doc_id"].alias("file_id"), F.col("vec_id").isNotNull().alias("hit"))


@query("""with packs as (select o_custkey as pack_id, list(o_orderkey order by o_orderkey) as ids from orders group by 1), valid as (select distinct l_orderkey as id from lineitem where l_quantity > 30)
select pack_id, len(ids) as n_before, (select count(*) from (select unnest(ids) as id) u where u.id in (select id from valid)) as n_after from packs""")
def set_valid_refs(spark, sf_dir):
    """References of packs without the ids of what is gone: arrays are exploded, joined and gathered, so no id set is broadcast whole."""
    refs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pack_id"), F.col("o_orderkey").alias("id"))
    valid = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("valid_id")).distinct()
    joined = refs.join(valid, refs["id"] == valid["valid_id"], "left")
    return joined.groupBy("pack_id").agg(F.count("*").alias("n_before"), F.count("valid_id").alias("n_after"))


# Aggregates


@query(f"with {FILES_SQL} select filetype, extraction_status, count(*) as n from files group by all")
def agg_type_status(spark, sf_dir):
    return files(spark, sf_dir).groupBy(F.coalesce("filetype", F.lit("unknown")).alias("filetype"), F.coalesce("extraction_status", F.lit("unknown")).alias("extraction_status")).agg(F.count("*").alias("n"))


@query(f"""with {EVENTS_SQL} select user_id, count(*) filter (where action = 'view') as summaries, count(*) filter (where action = 'click') as exports, count(*) filter (where action = 'purchase') as refreshes,
 count(*) filter (where action = 'signup') as shares from ev where created_at >= timestamp '2024-01-15' group by 1""")
def agg_usage_windows(spark, sf_dir):
    """Uses of each action since the period began, in one pass."""
    since = events(spark, sf_dir).where(F.col("created_at") >= F.lit("2024-01-15").cast("timestamp"))
    n = lambda action: F.count_if(F.col("action") == action)
    return since.groupBy("user_id").agg(n("view").alias("summaries"), n("click").alias("exports"), n("purchase").alias("refreshes"), n("signup").alias("shares"))


@query(f"""with {USERS_SQL} select count(*) filter (where created_at >= timestamp '2024-02-01') as today, count(*) filter (where created_at >= date_trunc('week', timestamp '2024-02-01')) as this_week,
 count(*) filter (where created_at >= date_trunc('month', timestamp '2024-01-20')) as this_month, count(*) as total from users""")
def agg_signups(spark, sf_dir):
    u, now = users(spark, sf_dir), as_of()
    since = lambda at: F.count_if(F.col("created_at") >= at)
    return u.agg(since(F.date_trunc("day", now)).alias("today"), since(F.date_trunc("week", now)).alias("this_week"), since(F.date_trunc("month", as_of("2024-01-20 00:00:00"))).alias("this_month"), F.count("*").alias("total"))


@query(f"""with {EVENTS_SQL} select count(*) filter (where action = 'error') as failed, count(*) filter (where action = 'purchase') as succeeded,
 coalesce(round(count(*) filter (where action = 'purchase') / nullif(count(*) filter (where action in ('purchase', 'error')), 0), 3), 1.0) as success_rate
 from ev where created_at >= timestamp '2024-01-20' and created_at < timestamp '2024-01-21'""")
def agg_success_rate(spark, sf_dir):
    """Finished jobs of a day and their success rate; 1 without any."""
    day = events(spark, sf_dir).where((F.col("created_at") >= F.lit("2024-01-20").cast("timestamp")) & (F.col("created_at") < F.lit("2024-01-21").cast("timestamp")))
    done = day.agg(F.count_if(F.col("action") == "error").alias("failed"), F.count_if(F.col("action") == "purchase").alias("succeeded"))
    return done.withColumn("success_rate", F.when(F.col("failed") + F.col("succeeded") > 0, F.round(F.col("succeeded") / (F.col("failed") + F.col("succeeded")), 3)).otherwise(1.0))


@query(f"with {TAGS_SQL} select tag, count(distinct file_id) as n_files, round(least(0.9, 0.3 + 0.6 * count(distinct file_id) / (select count(distinct file_id) from tags)), 6) as importance from tags group by 1 having count(distinct file_id) >= 2")
def agg_tag_files(spark, sf_dir):
    """Files of each tag, and the tag's importance; tags of one file say nothing."""
    t = tags(spark, sf_dir)
    total = t.agg(F.countDistinct("file_id").alias("total"))
    return t.groupBy("tag").agg(F.countDistinct("file_id").alias("n_files")).where("n_files >= 2").withColumn("total", total.scalar()).select("tag", "n_files", F.round(F.least(F.lit(0.9), 0.3 + 0.6 * F.col("n_files") / F.col("total")), 6).alias("importance"))


@query(f"with {USERS_SQL} select plan, count(*) as n_users, count(*) filter (where is_active) as n_active, round(sum(balance), 2) as balance from planned group by 1")
def agg_users_by_plan(spark, sf_dir):
    plan = scoring.effective_plan(F.col("is_admin"), F.col("subscription_status"), F.col("current_period_end"), as_of())
    return users(spark, sf_dir).groupBy(plan.alias("plan")).agg(F.count("*").alias("n_users"), F.count_if("is_active").alias("n_active"), F.round(F.sum("balance"), 2).alias("balance"))


@query(f"""with {FILES_SQL}, used as (select user_id, count(*) as n_files, round(sum(strlen(extracted_text)) / 1048576.0, 2) as storage_mb from files group by 1)
select user_id, n_files, storage_mb, 50 as file_limit, n_files >= 50 as files_full, round(100.0 * n_files / 50, 1) as percent from used""")
def agg_quota(spark, sf_dir):
    """What a tenant uses against the limits of the free plan."""
    used = files(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n_files"), F.round(F.sum(F.octet_length("extracted_text")) / 1048576.0, 2).alias("storage_mb"))
    limit = scoring.plan_limit(F.lit("free"), "files")
    return used.select("user_id", "n_files", "storage_mb", limit.alias("file_limit"), (F.col("n_files") >= limit).alias("files_full"), F.round(100.0 * F.col("n_files") / limit, 1).alias("percent"))


@query(f"with {EVENTS_SQL} select user_id, year(created_at)::int as year, month(created_at)::int as month, count(*) as used, greatest(200 - count(*), 0) as remaining, count(*) > 200 as exceeded from ev group by all")
def agg_monthly_counter(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id", F.year("created_at").alias("year"), F.month("created_at").alias("month")).agg(F.count("*").alias("used"))
    return e.select("*", F.greatest(200 - F.col("used"), F.lit(0)).alias("remaining"), (F.col("used") > 200).alias("exceeded"))


@query("select label as cluster_id, count(*) as members, min(vec_id) as first_file from embeddings group by 1")
def agg_cluster_members(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster_id")).agg(F.count("*").alias("members"), F.min("vec_id").alias("first_file"))


@query("select (select count(*) from documents) as files, (select count(*) from embeddings) as vectors, (select count(*) from pages) as pages, (select count(*) from conversations) as turns, (select count(*) from events where event_type = 'error') as errors")
def agg_overview(spark, sf_dir):
    """Counts of several tables as one row: scalar subqueries."""
    n = lambda name, alias, where="true": table(spark, sf_dir, name).where(where).agg(F.count("*")).scalar().alias(alias)
    return spark.range(1).select(n("documents", "files"), n("embeddings", "vectors"), n("pages", "pages"), n("conversations", "turns"), n("events", "errors", "event_type = 'error'"))


@query("select coalesce(p_type, 'other') as family, count(*) as n, string_agg(p_name, '|' order by p_partkey) filter (where nth <= 20) as items from (select *, row_number() over (partition by coalesce(p_type, 'other') order by p_partkey) as nth from part) group by 1")
def agg_family_lists(spark, sf_dir):
    """Nodes by family: how many, and the first twenty."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.coalesce("p_type", F.lit("other")).alias("family"))
    first = p.withColumn("nth", F.row_number().over(Window.partitionBy("family").orderBy("p_partkey"))).where("nth <= 20")
    items = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    lists = first.groupBy("family").agg(F.array_join(items, "|").alias("items"))
    return p.groupBy("family").agg(F.count("*").alias("n")).join(lists, "family")


@query(f"with {EVENTS_SQL} select action, count(*) as n, round(avg(value), 4) as mean, min(k) as low, max(k) as high, count(distinct user_id) as n_users from ev group by 1")
def agg_tool_usage(spark, sf_dir):
    return events(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"), F.min("k").alias("low"), F.max("k").alias("high"), F.countDistinct("user_id").alias("n_users"))


# Rankings


@query(f"""with {EVENTS_SQL}, ranked as (select *, row_number() over (partition by user_id order by created_at, event_id) as user_pos from ev where action = 'view')
select event_id, user_id, user_pos from ranked order by user_pos, created_at, event_id limit 100""")
def win_fair_queue(spark, sf_dir):
    """The next hundred jobs: every user's first before any user's second."""
    e = events(spark, sf_dir).where("action = 'view'")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("created_at", "event_id"))
    return e.withColumn("user_pos", pos).orderBy("user_pos", "created_at", "event_id").limit(100).select("event_id", "user_id", "user_pos")


@query(f"""with {EVENTS_SQL} select event_id, user_id, row_number() over w as position, round(sum(value) over (w rows unbounded preceding), 2) as eta from ev where action = 'click' window w as (partition by user_id order by created_at, event_id)""")
def win_running_eta(spark, sf_dir):
    """A job's place in its user's queue, and what waits before it in seconds."""
    w = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    return events(spark, sf_dir).where("action = 'click'").select("event_id", "user_id", F.row_number().over(w).alias("position"), F.round(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("eta"))


@query(f"with {FILES_SQL} select file_id, user_id, row_number() over (partition by user_id order by uploaded_at desc, file_id) > 20 as locked from files")
def win_lock_excess(spark, sf_dir):
    """The newest twenty files of a tenant stay open, the rest are locked."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("uploaded_at"), "file_id"))
    return files(spark, sf_dir).select("file_id", "user_id", (n > 20).alias("locked"))


@query(f"""with {FILES_SQL}, base as (select *, file_id % 3 = 0 as was_locked from files), c as (select user_id, count(*) filter (where not was_locked) as open_n from base group by 1),
r as (select b.*, row_number() over (partition by b.user_id order by uploaded_at desc, file_id) as n from base b where was_locked)
select r.file_id, r.user_id from r join c using (user_id) where n <= 40 - open_n""")
def win_unlock(spark, sf_dir):
    """The newest locked files that fit while a tenant has room."""
    f = files(spark, sf_dir).withColumn("was_locked", F.col("file_id") % 3 == 0)
    room = f.groupBy("user_id").agg((40 - F.count_if(~F.col("was_locked"))).alias("room"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("uploaded_at"), "file_id"))
    return f.where("was_locked").withColumn("n", n).join(room, "user_id").where("n <= room").select("file_id", "user_id")


@query(f"""with {MEMORIES_SQL}, c as (select user_id, count(*) as n_all from memories group by 1), r as (select *, row_number() over (partition by user_id order by updated_at, memory_id) as n from memories where not is_pinned)
select memory_id, r.user_id from r join c using (user_id) where n <= n_all - 20""")
def win_archive_oldest(spark, sf_dir):
    """The oldest memories, pinned ones aside, beyond twenty of a user."""
    m = memories(spark, sf_dir)
    total = m.groupBy("user_id").agg(F.count("*").alias("n_all"))
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("updated_at", "memory_id"))
    return m.where("not is_pinned").withColumn("n", n).join(total, "user_id").where("n <= n_all - 20").select("memory_id", "user_id")


@query(f"""with {MEMORIES_SQL}, r as (select *, row_number() over (partition by user_id order by updated_at desc, memory_id) as n from memories) select memory_id, user_id, is_pinned from r where n <= 5 or is_pinned""")
def win_latest_pinned(spark, sf_dir):
    """The latest five memories of a user and all pinned ones."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "memory_id"))
    return memories(spark, sf_dir).withColumn("n", n).where("n <= 5 or is_pinned").select("memory_id", "user_id", "is_pinned")


@query(f"""with {EVENTS_SQL}, h as (select *, lag(k) over (partition by user_id order by created_at, event_id) as before, row_number() over (partition by user_id order by created_at, event_id) as n from ev)
select event_id, user_id, k from h where n = 1 or k is distinct from before""")
def win_change_history(spark, sf_dir):
    """A value's history: the rows where it differs from the one before."""
    w = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    h = events(spark, sf_dir).withColumns({"before": F.lag("k").over(w), "n": F.row_number().over(w)})
    return h.where((F.col("n") == 1) | ~F.col("k").eqNullSafe(F.col("before"))).select("event_id", "user_id", "k")


@query(f"""with {EVENTS_SQL} select event_id, user_id, action as phase, (floor(epoch(lead(created_at) over (partition by user_id order by created_at, event_id))) - floor(epoch(created_at)))::bigint as seconds from ev""")
def win_phase_durations(spark, sf_dir):
    """How long each phase lasted: the next one of a user ends it."""
    w = Window.partitionBy("user_id").orderBy("created_at", "event_id")
    seconds = F.unix_timestamp(F.lead("created_at").over(w)) - F.unix_timestamp("created_at")
    return events(spark, sf_dir).select("event_id", "user_id", F.col("action").alias("phase"), seconds.alias("seconds"))


@query(f"with {EVENTS_SQL} select user_id, action, max(event_id) as last_id, arg_max(value, (created_at, event_id)) as last_value from ev group by all")
def win_latest_audit(spark, sf_dir):
    """The latest row of each user and kind, without a sort."""
    return events(spark, sf_dir).groupBy("user_id", "action").agg(F.max("event_id").alias("last_id"), F.max_by("value", F.struct("created_at", "event_id")).alias("last_value"))


@query(f"""with {EDGES_SQL}, d as (select source as node, target as other, weight, 0 as side from edges union all select target, source, weight, 1 from edges),
r as (select *, row_number() over (partition by node order by side, weight desc, other) as n from d where node like 'p%') select node, other, side, n from r where n <= 5""")
def win_edge_cap(spark, sf_dir):
    """At most five edges a node: outgoing ones first, heavier ones first."""
    e = edges(spark, sf_dir)
    out = e.select(F.col("source").alias("node"), F.col("target").alias("other"), "weight", F.lit(0).alias("side"))
    both = out.unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("other"), "weight", F.lit(1).alias("side"))).where("node like 'p%'")
    n = F.row_number().over(Window.partitionBy("node").orderBy("side", F.desc("weight"), "other"))
    return both.withColumn("n", n).where("n <= 5").select("node", "other", "side", "n")


# Functions of texts, times and scores


@query(r"select doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{0E00}-\x{0E7F}]+')) as n_tokens, list_aggregate(regexp_extract_all(lower(text), '[a-z0-9]+|[\x{0E00}-\x{0E7F}]+')[1:5], 'string_agg', ' ') as head from documents")
def txt_tokenize(spark, sf_dir):
    t = text.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.when(F.size(t) > 0, F.array_join(F.slice(t, 1, 5), " ")).alias("head"))


@query(r"select doc_id, case when length(text) >= 50 and not starts_with(text, '[') and trim(regexp_replace(lower(text), '\s+', ' ', 'g')) <> '' then sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) end as hash from documents")
def txt_content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query(r"""with s as (select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x, e' \n\t\r')), lambda x: x <> '') as s from documents)
select doc_id, len(s) as n, s[1] as first_sentence from s""")
def txt_sentences(spark, sf_dir):
    s = text.sentences(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0)).alias("first_sentence"))


@query("""select doc_id, len(c) as n_chunks, list_sum(list_transform(c, lambda x: length(x)))::bigint as chars, c[-1] as last_chunk from (
 select doc_id, case when length(text) <= 15000 then [text] else list_transform(range(0, ceil(length(text) / 10000.0)::bigint), lambda i: case when i = 0 then '' else right(substr(text, (i - 1) * 10000 + 1, 10000), 500) end || substr(text, i * 10000 + 1, 10000)) end as c from documents)""")
def txt_long_chunks(spark, sf_dir):
    """Chunks for summaries, with their overlaps."""
    c = text.long_chunks(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(c).cast("long").alias("n_chunks"), F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"), F.element_at(c, -1).alias("last_chunk"))


@query(r"""with s as (select doc_id, text, list_transform(list_filter(list_transform(string_split(regexp_replace(text, '([.!?\n])\s+', '\1' || chr(31), 'g'), chr(31)), lambda x: trim(x, e' \n\t\r')), lambda x: x <> ''), lambda x: [x]) as s from documents),
c as (select doc_id, case when length(text) = 0 then [] when length(text) < 500 then [text] else list_reduce(list_prepend([''], s), lambda acc, x: case when length(acc[-1]) + length(x[1]) + 1 <= 500 then list_append(acc[:-2], trim(acc[-1] || ' ' || x[1])) else list_append(list_filter(acc, lambda y: y <> ''), x[1]) end) end as c from s)
select doc_id, unnest(range(0, len(c))) as chunk_index, unnest(c) as chunk from c""")
def txt_search_chunks(spark, sf_dir):
    """Chunks for search, a row each."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(text.search_chunks_of("text")).alias("chunk_index", "chunk"))
    return d.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk")


@query("""with m as (select doc_id, case doc_id % 6 when 0 then '' when 1 then '[Empty file]' when 2 then '[PDF is encrypted]' when 3 then '[OCR error: x]' when 4 then '[Extractor unavailable]' else text end as t from documents)
select doc_id, case when trim(t) = '' then 'empty' when not starts_with(t, '[') then 'ok' when lower(t) like '[empty%' then 'empty' when lower(t) like '%encrypted%' then 'encrypted' when lower(t) like '%ocr error%' then 'ocr_failed' when lower(t) like '%extractor unavailable%' then 'unsupported' else 'ok' end as status from m""")
def txt_status(spark, sf_dir):
    made = F
    for i, value in enumerate(("", "[Empty file]", "[PDF is encrypted]", "[OCR error: x]", "[Extractor unavailable]")):
        made = made.when(F.col("doc_id") % 6 == i, value)
    return table(spark, sf_dir, "documents").select("doc_id", text.extraction_status(made.otherwise(F.col("text"))).alias("status"))


@query("""with m as (select event_id, case event_id % 5 when 0 then 'Request timed out' when 1 then 'HTTP 429: slow down' when 2 then 'tesseract is missing' when 3 then 'Connection reset' else 'odd' end as m from events)
select event_id, case when m ilike '%timed out%' then 'TIMEOUT' when m like '%429%' then 'QUOTA_EXCEEDED' when m like '%tesseract%' then 'OCR_FAIL' when m ilike '%connection%' then 'NETWORK' else 'UNKNOWN' end as code from m""")
def txt_error_code(spark, sf_dir):
    made = F
    for i, value in enumerate(("Request timed out", "HTTP 429: slow down", "tesseract is missing", "Connection reset")):
        made = made.when(F.col("event_id") % 5 == i, value)
    return table(spark, sf_dir, "events").select("event_id", text.error_code(made.otherwise("odd")).alias("code"))


@query(f"with {USERS_SQL} select user_id, regexp_replace(email, '^(.{{0,2}})[^@]*@', '\\1****@') as masked from users")
def txt_masked_email(spark, sf_dir):
    return users(spark, sf_dir).select("user_id", text.masked_email(F.col("email")).alias("masked"))


@query("""select doc_id, case when instr(lower(text), 'license') > 0 then substr(text, greatest(instr(lower(text), 'license') - 50, 1), 300) end as snippet, case when length(text) > 80 then left(text, 80) || '…' else text end as preview from documents""")
def txt_snippet(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.snippet(F.col("text"), "license").alias("snippet"), text.preview(F.col("text"), 80).alias("preview"))


@query("""select p_partkey, list_aggregate(list_distinct_ordered, 'string_agg', ' ') as tokens from (
 select p_partkey, list_filter(string_split_regex(lower(p_name || '-final_v2.' || p_type), '[-_.\\s]+'), lambda x, i: x <> '' and x not in ('final', 'v2', 'old', 'new') and not regexp_full_match(x, '[0-9]{1,3}') and list_position(string_split_regex(lower(p_name || '-final_v2.' || p_type), '[-_.\\s]+'), x) = i) as list_distinct_ordered from part)""")
def txt_filename_tokens(spark, sf_dir):
    name = F.concat(F.lower("p_name"), F.lit("-final_v2."), F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.filename_tokens(name), " ").alias("tokens"))


@query()
def txt_html_text(spark, sf_dir):
    """Text of pages; SQL has no HTML parser, tests hold it against small pages."""
    return table(spark, sf_dir, "pages").select("page_id", text.html_text_of("html").alias("text"))


@query(f"""with {FILES_SQL} select file_id, case when d <= 7 then 'current' when d <= 30 then 'aging' else 'stale' end as freshness, round(case when d <= 7 then 15.0 when d >= 365 then 0.0 else 15.0 * (1 - (d - 7) / 358.0) end, 6) as recency
from (select file_id, floor((epoch(timestamp '2024-02-01') - epoch(uploaded_at)) / 86400) as d from files)""")
def dt_freshness(spark, sf_dir):
    at, now = F.col("uploaded_at"), as_of()
    return files(spark, sf_dir).select("file_id", scoring.freshness(at, now).alias("freshness"), F.round(scoring.recency(at, now), 6).alias("recency"))


@query(f"""with {FILES_SQL}, s as (select file_id, greatest(0, least(100, round_even(case when length(extracted_text) = 0 then 0 else least(40.0, 10 * log10(length(extracted_text))) end + 30 * ((file_id % 11) / 10.0)
 + (select case when d <= 7 then 15.0 when d >= 365 then 0.0 else 15.0 * (1 - (d - 7) / 358.0) end from (select floor((epoch(timestamp '2024-02-01') - epoch(uploaded_at)) / 86400) as d)) + case when sot then 10 else 0 end + least(5.0, 0.5 * (file_id % 13)), 0)))::int as score from files)
select file_id, score, case when score >= 70 then 'high' when score >= 40 then 'medium' else 'low' end as label from s""")
def mth_importance(spark, sf_dir):
    score = scoring.importance(F.length("extracted_text"), (F.col("file_id") % 11) / 10.0, F.col("uploaded_at"), as_of(), F.col("source_of_truth"), F.col("file_id") % 13)
    return files(spark, sf_dir).select("file_id", score.alias("score")).withColumn("label", scoring.importance_label(F.col("score")))


@query("""with o as (select user_id, list(value order by ts, event_id) as d from events where event_type = 'view' group by 1)
select user_id, list_reduce(list_prepend(30.0::double, list_transform(d, lambda x: x::double)), lambda cur, x: round(0.8 * cur + 0.2 * least(x, 60.0), 2)) as ewma from o""")
def mth_ewma(spark, sf_dir):
    """A running average per user in the order of the events; the last one of each."""
    steps = running_averages(events(spark, sf_dir).where("action = 'view'"), ["user_id"], ["created_at", "event_id"], "value", 60.0, 30.0)
    return steps.groupBy("user_id").agg(F.max_by("average", F.struct("created_at", "event_id")).alias("ewma"))


def running_averages(rows: DataFrame, group: list[str], order: list[str], value: str, cap: float, start: float) -> DataFrame:
    """``rows`` with column average: 4/5 of the one before and 1/5 of the value, capped, rounded to hundredths at each step; negative and null values
    change nothing. A fold over ranges of the groups' rows, whose state are hundredths."""
    most = round(100 * cap)

    def advance(states: np.ndarray, row: tuple) -> np.ndarray:
        if row[0] is None or row[0] < 0:
            return states
        return (2 * (4 * states + min(round(100 * row[0]), most)) + 5) // 10  # fifths are never halves

    found = folded(rows, group, order, [value], max(most, round(100 * start)) + 1, round(100 * start), advance)
    return found.withColumn("average", F.col("after") / 100).drop("before", "after")


@query("""with p as (select p_partkey, case p_partkey % 8 when 0 then 'pdf' when 1 then 'docx' when 2 then 'mp3' when 3 then 'mp4' when 4 then 'jpg' when 5 then 'md' when 6 then 'html' else 'xyz' end as ext from part)
select p_partkey, ext, case when ext in ('mp3', 'mp4', 'jpg') then 'ai_ingest' when ext = 'xyz' then 'vault' else 'local' end as processor, case ext when 'docx' then 6 when 'mp3' then 20 when 'mp4' then 100 when 'jpg' then 2 else 0 end as cost,
 case when ext in ('jpg', 'md', 'html') then 1 when ext in ('pdf', 'docx') then 2 else 3 end as priority from p""")
def src_routing(spark, sf_dir):
    """Processor, cost and priority by file type."""
    kinds = ("pdf", "docx", "mp3", "mp4", "jpg", "md", "html", "xyz")
    name = F.concat(F.lit("dir.v2/file."), F.upper(F.element_at(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 8 + 1).cast("int"))))
    p = table(spark, sf_dir, "part").select("p_partkey", text.extension(name).alias("ext"))
    r = scoring.route(F.col("ext"))
    return p.select("p_partkey", "ext", r["processor"].alias("processor"), r["cost"].alias("cost"), scoring.priority_class(F.col("ext")).alias("priority"))


@query("select event_id, (props->>'$.k')::bigint as k, props like '%\"k\"%' as has_k from events")
def arr_json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.k").isNotNull().alias("has_k"))
