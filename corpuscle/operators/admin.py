"""Queries of administration and listings: filters by hints and actors, totals by tenant, usage against limits, tokens, shares, pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring, text
from corpuscle.operators.mutations import json_ids
from corpuscle.operators.relational import EDGES_SQL, EVENTS_SQL, FILES_SQL, MEMORIES_SQL, USERS_SQL
from corpuscle.plans.views import CHATS_SQL, NODES_SQL, PACKS_SQL, SUGGESTIONS_SQL, TOKENS_SQL
from corpuscle.sources import store
from corpuscle.sources.tables import as_of, chats, cluster_map, edges, events, files, memories, nodes, packs, profiles, suggestions, table, tenant_edges, tokens, users

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Filters


@query(f"with {FILES_SQL} select file_id, filename from files where user_id = 'src3'")
def src_scoped(spark: SparkSession, sf_dir: str, user_id: str = "src3") -> DataFrame:
    """A scan of one tenant; the filter reaches the Parquet files."""
    return files(spark, sf_dir).where(F.col("user_id") == user_id).select("file_id", "filename")


@query(f"with {FILES_SQL} select file_id, case file_id % 6 when 0 then true when 1 then true when 2 then true when 3 then true when 4 then false else false end as supported from files")
def src_supported(spark, sf_dir):
    """Whether files are of a format that is read, or go to the vault by name alone."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("txt", "pdf", "mp3", "png", "exe", "")]), (F.col("file_id") % 6 + 1).cast("int"))
    return files(spark, sf_dir).select("file_id", (scoring.route(ext)["processor"] != "vault").alias("supported"))


@query(f"with {MEMORIES_SQL}, r as (select *, row_number() over (partition by user_id order by updated_at desc, memory_id) as k from memories where title ilike '%topic 1%' or content ilike '%en%') select user_id, memory_id, k from r where k <= 10")
def flt_auto_context(spark, sf_dir, words: str = "en", most: int = 10):
    """The newest memories of each user that hold the words, ten at most."""
    found = memories(spark, sf_dir).where(F.col("title").ilike("%topic 1%") | F.col("content").ilike(f"%{words}%"))
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "memory_id"))
    return found.withColumn("k", k).where(F.col("k") <= min(most, 10)).select("user_id", "memory_id", "k")


@query(f"with {FILES_SQL}, r as (select user_id, file_id, filename, row_number() over (partition by user_id order by uploaded_at desc, file_id) as k from files where filename ilike '%1%') select user_id, file_id, filename from r where k <= 5")
def flt_filename_hint(spark, sf_dir, hint: str = "1"):
    """Files whose name holds a hint, the newest five of each tenant."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("uploaded_at"), "file_id"))
    return files(spark, sf_dir).where(F.col("filename").ilike(f"%{hint}%")).withColumn("k", k).where("k <= 5").select("user_id", "file_id", "filename")


@query(f"with {EVENTS_SQL} select event_id, action, user_id from ev where action = 'purchase' and user_id between 10 and 60 and user_id % 7 = 3 order by created_at desc, event_id limit 50")
def flt_audit(spark, sf_dir, action: str = "purchase", page: int = 50):
    """Audit rows by type, user and actor; each condition is optional."""
    e = events(spark, sf_dir).where((F.col("action") == action) & F.col("user_id").between(10, 60) & (F.col("user_id") % 7 == 3))
    return e.orderBy(F.desc("created_at"), "event_id").limit(min(max(page, 1), 200)).select("event_id", "action", "user_id")


@query(f"with {EDGES_SQL}, {NODES_SQL} select n.node, n.label, count(e.source) as n_edges from nodes n left join edges e on e.target = n.node and e.edge_type = 'contains' where n.family = 'entity' group by all")
def flt_family(spark, sf_dir, family: str = "entity", edge_type: str = "contains"):
    """Nodes of a family and their incoming edges of a type."""
    n = nodes(spark, sf_dir).where(F.col("family") == family).select("node", "label")
    e = edges(spark, sf_dir).where(F.col("edge_type") == edge_type).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n_edges"))
    return n.join(e, "node", "left").select("node", "label", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


@query("""select c_custkey as user_id, c_mktsegment = 'BUILDING' or c_custkey % 4 = 0 or c_custkey % 6 = 0 or c_custkey % 10 = 0 or c_custkey % 11 = 0 or c_custkey % 13 = 0 as complete from customer""")
def flt_profile_complete(spark, sf_dir):
    """Profiles of which any of seven fields says something; empty texts and lists say nothing."""
    said = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    named = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    texts = [said(c) for c in ("identity", "goals", "background", "type_code", "enneagram")]
    complete = F.lit(False)
    for test in [*texts, named("strengths"), named("virtues")]:
        complete = complete | test
    return profiles(spark, sf_dir).select("user_id", complete.alias("complete"))


@query(f"with {SUGGESTIONS_SQL} select status, count(*) as n, min(suggestion_id) as first_id from suggestions where suggestion_id % 4 = 1 group by 1")
def flt_by_action(spark, sf_dir):
    """Selections grouped by what is to be done with them."""
    return suggestions(spark, sf_dir).where("suggestion_id % 4 = 1").groupBy("status").agg(F.count("*").alias("n"), F.min("suggestion_id").alias("first_id"))


# Joins


@query(f"with {CHATS_SQL}, {EVENTS_SQL} select e.event_id, c.chat_id, c.user_id from ev e join chats c on c.chat_id = e.event_id % 120 where c.user_id <> 'src4'")
def jn_log_chats(spark, sf_dir):
    """Log rows with the chat they belong to; those without one go."""
    e, c = events(spark, sf_dir).withColumn("chat_id", F.col("event_id") % 120), chats(spark, sf_dir).where("user_id <> 'src4'")
    return e.join(c.select("chat_id", F.col("user_id").alias("chat_user")), "chat_id").select("event_id", "chat_id", F.col("chat_user").alias("user_id"))


def collections(members: DataFrame, packs_: DataFrame) -> DataFrame:
    """cluster_id, files, relevance, packs: counts of members (file_id, cluster_id, relevance), and of packs that name the cluster."""
    m = members.groupBy("cluster_id").agg(F.count("*").alias("files"), F.round(F.avg("relevance"), 6).alias("relevance"))
    p = packs_.select(F.explode(json_ids(F.col("source_cluster_ids"))).alias("cluster_id")).groupBy("cluster_id").agg(F.count("*").alias("packs"))
    return m.join(p, "cluster_id", "left").select("cluster_id", "files", "relevance", F.coalesce("packs", F.lit(0)).alias("packs"))


@query(f"with {PACKS_SQL}, m as (select label as cluster_id, count(*) as files, round(avg(round(abs(embedding[1]), 6)), 6) as relevance from embeddings group by 1), p as (select cluster_id, count(*) as packs from packs group by 1) select m.cluster_id::bigint as cluster_id, files, relevance, coalesce(packs, 0) as packs from m left join p using (cluster_id)")
def jn_collections(spark, sf_dir):
    """Clusters with how many files they hold and how many packs are made of them."""
    from corpuscle.sources.tables import cluster_map

    return collections(cluster_map(spark, sf_dir).withColumn("cluster_id", F.col("cluster_id").cast("long")), packs(spark, sf_dir))


@query("select label::bigint as cluster_id, vec_id as file_id, round(abs(embedding[1]), 6) as relevance, row_number() over (partition by label order by vec_id) as position from embeddings")
def jn_collection_files(spark, sf_dir):
    """The files of each cluster, a row each, with their position: no cluster becomes one array."""
    from corpuscle.sources.tables import cluster_map

    position = F.row_number().over(Window.partitionBy("cluster_id").orderBy("file_id"))
    return cluster_map(spark, sf_dir).select(F.col("cluster_id").cast("long").alias("cluster_id"), "file_id", F.col("relevance").cast("double").alias("relevance"), position.alias("position"))


def labelled(edges_: DataFrame, nodes_: DataFrame, end: str) -> DataFrame:
    """``edges_`` with ``label``, that of the node at ``end``, or a question mark."""
    return edges_.join(nodes_.select(F.col("node").alias(end), "label"), end, "left").withColumn("label", F.coalesce("label", F.lit("?")))


@query(f"with {EDGES_SQL}, {NODES_SQL} select e.source, e.target, coalesce(n.label, '?') as label from edges e left join nodes n on n.node = e.target and n.family is not null where e.source like 'o1%'")
def jn_neighbour_labels(spark, sf_dir):
    """Edges with their neighbour's label; nodes without a family aren't shown by name."""
    return labelled(edges(spark, sf_dir).where("source like 'o1%'"), nodes(spark, sf_dir).where("family is not null"), "target").select("source", "target", "label")


@query(f"with {EDGES_SQL}, {NODES_SQL} select e.target as node, 'in' as direction, n.label, e.edge_type from edges e join nodes n on n.node = e.source where e.target like 's%' union all select e.source, 'out', n.label, e.edge_type from edges e join nodes n on n.node = e.target where e.source like 'p1%'")
def jn_link_labels(spark, sf_dir):
    """Backlinks and outgoing links with the label of the other end."""
    e, n = edges(spark, sf_dir), nodes(spark, sf_dir)
    side = lambda rows, own, other, way: rows.join(n.select(F.col("node").alias(other), "label"), other).select(F.col(own).alias("node"), F.lit(way).alias("direction"), "label", "edge_type")
    return side(e.where("target like 's%'"), "target", "source", "in").unionByName(side(e.where("source like 'p1%'"), "source", "target", "out"))


@query("""with p as (select p_partkey as id, lower(p_name) as label from part), c as (select label, min(id) as first_id, count(*) as members from p group by 1 having count(*) > 1),
linked as (select distinct l_orderkey % 2000 as a, l_partkey as b from lineitem)
select p.label, p.id, c.first_id, c.members, exists (select 1 from linked l where (l.a = p.id and l.b = c.first_id) or (l.a = c.first_id and l.b = p.id)) as linked from p join c using (label)""")
def jn_same_label_classes(spark, sf_dir):
    """Entities of one label as classes with their first member, and which are linked to it already; all other pairs follow
    from the class, but for those that jn_same_label_known has."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("label"))
    return with_links(p, table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2000).alias("a"), F.col("l_partkey").alias("b")))


def with_links(entities: DataFrame, links: DataFrame) -> DataFrame:
    """label, id, first_id, members, linked: ``entities`` (id, label) of labels that several have; whether ``links`` (a, b) has one, either way, between
    it and the first. Links are looked at where they lie: those that don't end at a first member go before anything is counted or moved, as classes are a
    table of known size."""
    counted = entities.groupBy("label").agg(F.min("id").alias("first_id"), F.count("*").alias("members")).where("members > 1")
    classes = store.write_table(counted, store.new_path(entities.sparkSession, "classes"))
    way = lambda x, y: F.struct(F.col(x).alias("id"), F.col(y).alias("first_id"))
    both = links.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x")).select("x.*")
    found = both.join(classes.select("first_id"), "first_id", "left_semi").distinct().select("id", "first_id", F.lit(True).alias("linked"))
    return entities.join(classes, "label").join(found, ["id", "first_id"], "left").select("label", "id", "first_id", "members", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("""with p as (select p_partkey as id, lower(p_name) as label from part), linked as (select distinct l_orderkey % 2000 as a, l_partkey as b from lineitem)
select distinct x.label, least(a, b) as a_id, greatest(a, b) as b_id from linked join p x on x.id = a join p y on y.id = b and y.label = x.label where a <> b""")
def jn_same_label_known(spark, sf_dir):
    """The exceptions to jn_same_label_classes: any two members of a class that are linked already, either way, the smaller id first."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("label"))
    links = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2000).alias("a"), F.col("l_partkey").alias("b")).where("a <> b")
    pairs = links.select(F.least("a", "b").alias("a_id"), F.greatest("a", "b").alias("b_id")).distinct()
    ends = lambda name: p.select(F.col("id").alias(name), F.col("label").alias(f"label_{name}"))
    found = pairs.join(ends("a_id"), "a_id").join(ends("b_id"), "b_id").where("label_a_id = label_b_id")
    return found.select(F.col("label_a_id").alias("label"), "a_id", "b_id")


@query(f"""with {FILES_SQL}, local as (select file_id, file_id || '_' || filename as name, extracted_text from files where file_id % 3 <> 0), listed as (select 'x' || file_id as drive_id, file_id || '_' || filename as name from files where file_id % 4 = 1)
select file_id, drive_id, case when drive_id is not null then 'relinked' when extracted_text = '' then 'error' else 'pushed' end as fate from local left join listed using (name)""")
def jn_push_set(spark, sf_dir):
    """Files never pushed: those that the other side has by name are linked again, others are pushed, those without content fail."""
    f = files(spark, sf_dir).withColumn("name", F.concat_ws("_", F.col("file_id").cast("string"), "filename"))
    listed = f.where("file_id % 4 = 1").select("name", F.concat(F.lit("x"), F.col("file_id").cast("string")).alias("drive_id"))
    fate = F.when(F.col("drive_id").isNotNull(), "relinked").when(F.col("extracted_text") == "", "error").otherwise("pushed")
    return f.where("file_id % 3 <> 0").join(listed, "name", "left").select("file_id", "drive_id", fate.alias("fate"))


@query(f"with {FILES_SQL}, disk as (select 'summaries/' || file_id || '.summary.md' as path from files where file_id % 2 = 0) select path from disk where regexp_extract(path, '([^/]*)$', 1) not in (select file_id || '.summary.md' from files where summarised)")
def jn_disk_orphans(spark, sf_dir):
    """Summary files on disk that no file refers to."""
    f = files(spark, sf_dir)
    disk = f.where("file_id % 2 = 0").select(F.concat(F.lit("summaries/"), F.col("file_id").cast("string"), F.lit(".summary.md")).alias("path"))
    known = f.where("summarised").select(F.concat(F.col("file_id").cast("string"), F.lit(".summary.md")).alias("base"))
    return disk.withColumn("base", F.regexp_extract("path", "([^/]*)$", 1)).join(known, "base", "left_anti").select("path")


@query(f"with {FILES_SQL}, hits as (select event_id, event_id % 1300 as file_id, 'src' || event_id % 20 as user_id from events) select event_id, file_id from hits h where exists (select 1 from files f where f.file_id = h.file_id and f.user_id = h.user_id)")
def jn_hit_owner(spark, sf_dir):
    """Search hits whose file is the tenant's own."""
    hits = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 1300).alias("file_id"), F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string")).alias("user_id"))
    return hits.join(files(spark, sf_dir).select("file_id", "user_id"), ["file_id", "user_id"], "left_semi").select("event_id", "file_id")


@query(f"""with {FILES_SQL}, h as (select file_id, sha256(trim(extracted_text, ' ' || chr(10) || chr(9) || chr(13))) as h, case when file_id % 4 = 0 then 'm1' else 'm2' end as model from files),
cache as (select sha256(trim(extracted_text, ' ' || chr(10) || chr(9) || chr(13))) as h, 'm2' as model, min(file_id) as vector_of from files where file_id % 3 = 0 group by all)
select file_id, model, cache.vector_of, cache.h is not null as hit from h left join cache using (h, model)""")
def jn_embedding_cache(spark, sf_dir):
    """Cached vectors by the hash of the stripped text and the model; what isn't there is to be embedded."""
    stripped = F.regexp_replace("extracted_text", r"^\s+|\s+$", "")
    f = files(spark, sf_dir).select("file_id", F.sha2(stripped, 256).alias("h"), F.when(F.col("file_id") % 4 == 0, "m1").otherwise("m2").alias("model"))
    cache = f.where("file_id % 3 = 0").groupBy("h").agg(F.min("file_id").alias("vector_of")).withColumn("model", F.lit("m2"))
    return f.join(cache, ["h", "model"], "left").select("file_id", "model", "vector_of", F.col("vector_of").isNotNull().alias("hit"))


@query("""with p as (select page_id, sha256(html) as key, case when page_id % 2 = 0 then 'fast' else 'premium' end as mode from pages), c as (select distinct sha256(html) as key, 'fast' as mode from pages where page_id % 5 <> 0)
select page_id, mode, c.key is not null as hit from p left join c using (key, mode)""")
def jn_parse_cache(spark, sf_dir):
    """Parsed files by the SHA-256 of their bytes and the mode."""
    p = table(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("key"), F.when(F.col("page_id") % 2 == 0, "fast").otherwise("premium").alias("mode"))
    c = p.where("page_id % 5 <> 0").select("key", F.lit("fast").alias("mode"), F.lit(True).alias("there")).distinct()
    return p.join(c, ["key", "mode"], "left").select("page_id", "mode", F.col("there").isNotNull().alias("hit"))


# Totals


@query(f"with {USERS_SQL} select count(*) filter (where is_active) as active, count(*) filter (where not is_active) as inactive, count(*) filter (where status = 'starter_active') as paying, count(*) filter (where status = 'starter_past_due') as past_due, count(*) filter (where status = 'starter_canceled') as canceled from users")
def agg_subscriptions(spark, sf_dir):
    """Active and inactive accounts, and three kinds of subscriptions: one pass."""
    status = lambda s: F.count_if(F.col("subscription_status") == s)
    return users(spark, sf_dir).agg(F.count_if("is_active").alias("active"), F.count_if(~F.col("is_active")).alias("inactive"), status("starter_active").alias("paying"), status("starter_past_due").alias("past_due"), status("starter_canceled").alias("canceled"))


@query(f"""with {FILES_SQL}, {PACKS_SQL}, {SUGGESTIONS_SQL}, {TOKENS_SQL}, u as (select distinct user_id from files),
te as (select distinct 'src' || l_orderkey % 20 as user_id, 'o' || l_orderkey as source, 'p' || l_partkey as target from lineitem union select distinct 'src' || l_orderkey % 20, 'p' || l_partkey, 's' || l_suppkey from lineitem),
ne as (select user_id, count(*) as n from te group by 1), nn as (select user_id, count(*) as n from (select user_id, source as node from te union select user_id, target from te) group by 1),
nc as (select user_id, count(distinct label) as n from files join embeddings on vec_id = file_id group by 1)
select user_id, (select count(*) from files f where f.user_id = u.user_id) as files, (select count(*) from packs p where p.user_id = u.user_id) as packs,
(select count(*) from suggestions s where s.user_id = u.user_id and status = 'pending') as pending, (select count(*) from tokens t where t.user_id = u.user_id and revoked_at is null) as tokens,
coalesce(nc.n, 0) as clusters, coalesce(nn.n, 0) as nodes, coalesce(ne.n, 0) as edges from u left join nc using (user_id) left join nn using (user_id) left join ne using (user_id)""")
def agg_tenant_overview(spark, sf_dir):
    """A row of seven counts for each tenant, of one aggregate over all entities."""
    one = lambda df, what: df.groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", F.lit(what).alias("what"), "n")
    own, e = files(spark, sf_dir), tenant_edges(spark, sf_dir)
    f = one(own, "files")
    clusters = own.select("user_id", "file_id").join(cluster_map(spark, sf_dir), "file_id").select("user_id", "cluster_id").distinct()
    nodes = e.select("user_id", F.explode(F.array("source", "target")).alias("node")).distinct()
    counted = {"packs": packs(spark, sf_dir), "pending": suggestions(spark, sf_dir).where("status = 'pending'"), "tokens": tokens(spark, sf_dir).where("revoked_at is null"), "clusters": clusters, "nodes": nodes, "edges": e}
    rows = reduce(DataFrame.unionByName, [f, *(one(df, what) for what, df in counted.items())])
    totals = [F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w) for w in ("files", *counted)]
    return rows.groupBy("user_id").agg(*totals).join(f.select("user_id"), "user_id", "left_semi")


@query(f"""with {EVENTS_SQL}, {USERS_SQL}, m as (select user_id, count(*) filter (where action = 'view') as summaries, count(*) filter (where action = 'click') as exports, count(*) filter (where action = 'signup') as refreshes, count(*) filter (where action = 'purchase') as packs,
count(distinct k) as files, floor(sum((value * 100)::bigint) / 1024) / 100 as storage_mb from ev where created_at >= timestamp '2024-01-01' group by 1),
l as (select * from (values ('free', 10, 50, 500, 50, 100, 0), ('starter', 50, 500, 10240, 1000, 3000, 100), ('admin', 999999, 999999, 999999, 999999, 999999, 999999)) v(plan, packs_limit, files_limit, storage_limit, summaries_limit, exports_limit, refreshes_limit))
select m.*, plan, packs_limit, files_limit, storage_limit, summaries_limit, exports_limit, refreshes_limit, (packs >= packs_limit)::int + (files >= files_limit)::int + (storage_mb >= storage_limit)::int + (summaries >= summaries_limit)::int + (exports >= exports_limit)::int + (refreshes >= refreshes_limit)::int as full_ from m join planned using (user_id) join l using (plan)""".replace("select m.*, plan,", "select m.user_id, m.packs, m.files, m.storage_mb, m.summaries, m.exports, m.refreshes, plan,"))
def agg_usage_summary(spark, sf_dir):
    """What each user has used of six things, the limit of each by plan, and how many are full."""
    e = events(spark, sf_dir).where(F.col("created_at") >= F.lit("2024-01-01").cast("timestamp"))
    n = lambda a: F.count_if(F.col("action") == a)
    used = e.groupBy("user_id").agg(n("purchase").alias("packs"), F.countDistinct("k").alias("files"), (F.floor(F.sum(F.round(F.col("value") * 100).cast("long")) / 1024) / 100).alias("storage_mb"), n("view").alias("summaries"), n("click").alias("exports"), n("signup").alias("refreshes"))
    plan = scoring.effective_plan(F.col("is_admin"), F.col("subscription_status"), F.col("current_period_end"), as_of())
    rows = used.join(users(spark, sf_dir).select("user_id", plan.alias("plan")), "user_id")
    kinds = {"packs": "packs", "files": "files", "storage_mb": "storage", "summaries": "summaries", "exports": "exports", "refreshes": "refreshes"}
    rows = rows.withColumns({f"{short}_limit": scoring.plan_limit(F.col("plan"), what) for what, short in kinds.items()})
    full = sum(((F.col(what) >= F.col(f"{short}_limit")).cast("int") for what, short in kinds.items()), F.lit(0))
    return rows.withColumn("full_", full)


@query(f"with {EDGES_SQL}, {NODES_SQL} select coalesce(family, 'other') as family, node, label, count(*) over (partition by coalesce(family, 'other')) as members from nodes")
def agg_family_items(spark, sf_dir):
    """All nodes by family, a row each with the family's size: families have no bound, so they become no lists."""
    n = nodes(spark, sf_dir).withColumn("family", F.coalesce("family", F.lit("other")))
    sizes = n.groupBy("family").agg(F.count("*").alias("members"))
    return n.join(F.broadcast(sizes), "family").select("family", "node", "label", "members")  # a row a family: a handful


@query("""with t as (select l_suppkey % 30 as user_id, l_orderkey as file_id, l_shipmode as tag from (select *, l_returnflag as l_shipmode from lineitem) where l_linenumber = 3), n as (select user_id, count(distinct file_id) as total from t group by 1)
select user_id, tag, count(distinct file_id) as n from t join n using (user_id) group by user_id, tag, total having count(distinct file_id) >= case when total <= 3 then 1 else 2 end""")
def agg_tenant_tags(spark, sf_dir):
    """Tags of two files at least; of one, where the tenant has three files or fewer."""
    t = table(spark, sf_dir, "lineitem").where("l_linenumber = 3").select((F.col("l_suppkey") % 30).alias("user_id"), F.col("l_orderkey").alias("file_id"), F.col("l_returnflag").alias("tag"))
    total = t.groupBy("user_id").agg(F.countDistinct("file_id").alias("total"))
    used = t.groupBy("user_id", "tag").agg(F.countDistinct("file_id").alias("n")).join(total, "user_id")
    return used.where(F.col("n") >= F.when(F.col("total") <= 3, 1).otherwise(2)).select("user_id", "tag", "n")


@query(f"with {EVENTS_SQL}, a as (select * from ev where action <> 'view') select event_id, action, (select count(*) from a) as total from a order by created_at desc, event_id limit 200 offset 40")
def srt_audit_page(spark, sf_dir, limit: int = 500, offset: int = 40):
    """A page of the audit log with the number of all its rows; limits are clamped to 1..200."""
    a = events(spark, sf_dir).where("action <> 'view'")
    page = a.orderBy(F.desc("created_at"), "event_id").offset(max(offset, 0)).limit(min(max(limit, 1), 200))
    return page.withColumn("total", a.agg(F.count("*")).scalar()).select("event_id", "action", "total")


@query(f"with {EVENTS_SQL}, m as (select user_id, year(created_at)::int as year, month(created_at)::int as month, count(*) as used from ev where action = 'click' group by all) select *, round(used * 100.0 / 5, 1)::double as percent, greatest(5 - used, 0) as remaining, used >= 5 as exceeded from m")
def agg_monthly_quota(spark, sf_dir, limit: int = 5):
    """Messages of a month against its limit: percent, what remains, whether it is used up."""
    m = events(spark, sf_dir).where("action = 'click'").groupBy("user_id", F.year("created_at").alias("year"), F.month("created_at").alias("month")).agg(F.count("*").alias("used"))
    return m.withColumns({"percent": F.round(F.col("used") * 100.0 / limit, 1).cast("double"), "remaining": F.greatest(limit - F.col("used"), F.lit(0)), "exceeded": F.col("used") >= limit})


@query(f"with {FILES_SQL} select distinct user_id, exists (select 1 from files g where g.user_id = f.user_id and g.processing_status = 'ready' and g.file_kind = 'processed') as any_ready from files f")
def agg_exists(spark, sf_dir):
    """Which tenants have anything to work with: whether, not how many."""
    f = files(spark, sf_dir)
    return f.groupBy("user_id").agg(F.bool_or((F.col("processing_status") == "ready") & (F.col("file_kind") == "processed")).alias("any_ready"))


@query(f"with {FILES_SQL} select file_id, user_id, (select count(*) from files where not summarised) > 50 as truncated from files where not summarised order by uploaded_at desc, file_id limit 50")
def srt_unprocessed(spark, sf_dir, most: int = 50):
    """The newest files that wait, fifty at most, and whether there are more."""
    f = files(spark, sf_dir).where("not summarised")
    return f.orderBy(F.desc("uploaded_at"), "file_id").limit(most).withColumn("truncated", f.agg(F.count("*") > most).scalar()).select("file_id", "user_id", "truncated")


# Tokens, shares, accounts


@query(f"""with {TOKENS_SQL}, asked as (select event_id, sha256('token ' || event_id % 400) as h from events) select event_id, t.user_id, case when t.token_id is null then 'unknown' when revoked_at is not null then 'revoked' else 'valid' end as verdict from asked a left join tokens t on t.token_hash = a.h""")
def ten_tokens(spark, sf_dir):
    """Presented tokens held against the hashes that are kept."""
    asked = table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat(F.lit("token "), (F.col("event_id") % 400).cast("string")), 256).alias("token_hash"))
    verdict = F.when(F.col("token_id").isNull(), "unknown").when(F.col("revoked_at").isNotNull(), "revoked").otherwise("valid")
    return asked.join(tokens(spark, sf_dir), "token_hash", "left").select("event_id", "user_id", verdict.alias("verdict"))


@query(f"with {TOKENS_SQL} select user_id, count(*) filter (where revoked_at is null) as active, count(*) filter (where revoked_at is not null) as revoked from tokens group by 1")
def agg_tokens(spark, sf_dir):
    """Active and revoked tokens of each tenant."""
    return tokens(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("revoked_at").isNull()).alias("active"), F.count_if(F.col("revoked_at").isNotNull()).alias("revoked"))


@query(f"""with {PACKS_SQL}, s as (select event_id as share_id, event_id * 3 % 1500 as pack_id, event_type = 'error' as revoked, ts from events)
select share_id, s.pack_id, p.title, len(p.ids) as n_sources, revoked, case when revoked then null else case when length(p.title || ' of ' || p.user_id) > 12 then left(p.title || ' of ' || p.user_id, 12) || '…' else p.title || ' of ' || p.user_id end end as preview
from s join packs p using (pack_id) order by revoked, ts desc, share_id limit 100""")
def ten_shares(spark, sf_dir):
    """Shares with their pack, revoked ones last; only those that stand show a preview."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("share_id"), (F.col("event_id") * 3 % 1500).alias("pack_id"), (F.col("event_type") == "error").alias("revoked"), "ts")
    shown = text.preview(F.concat("title", F.lit(" of "), "user_id"), 12)
    s = e.join(packs(spark, sf_dir), "pack_id")
    return s.orderBy("revoked", F.desc("ts"), "share_id").limit(100).select("share_id", "pack_id", "title", F.size(json_ids(F.col("source_file_ids"))).cast("long").alias("n_sources"), "revoked", F.when(~F.col("revoked"), shown).alias("preview"))


@query(f"""with {USERS_SQL}, {EVENTS_SQL}, e as (select user_id, count(*) as n, max(created_at) as last_at, max(event_id) filter (where action = 'purchase') as last_purchase from ev group by 1), o as (select o_custkey as user_id, count(*) as packs, round(sum(o_totalprice), 2) as spent from orders group by 1)
select user_id, email, plan, coalesce(n, 0) as n_events, last_at, last_purchase, coalesce(packs, 0) as packs, coalesce(spent, 0) as spent from planned left join e using (user_id) left join o using (user_id)""")
def ten_user_detail(spark, sf_dir):
    """Accounts with their plan, what they did last and what they own."""
    plan = scoring.effective_plan(F.col("is_admin"), F.col("subscription_status"), F.col("current_period_end"), as_of())
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"), F.max(F.when(F.col("action") == "purchase", F.col("event_id"))).alias("last_purchase"))
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("packs"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    u = users(spark, sf_dir).select("user_id", "email", plan.alias("plan")).join(e, "user_id", "left").join(o, "user_id", "left")
    return u.select("user_id", "email", "plan", F.coalesce("n", F.lit(0)).alias("n_events"), "last_at", "last_purchase", F.coalesce("packs", F.lit(0)).alias("packs"), F.coalesce("spent", F.lit(0.0)).alias("spent"))
