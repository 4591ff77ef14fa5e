"""Changes as new snapshots: appended logs, deletions with all references, claims, suggestions taken or dropped, hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring
from corpuscle.operators.relational import EDGES_SQL, EVENTS_SQL, FILES_SQL, MEMORIES_SQL
from corpuscle.plans.views import CHATS_SQL, NODES_SQL, PACKS_SQL, SUGGESTIONS_SQL
from corpuscle.sources.tables import chats, edges, events, files, memories, nodes, packs, profiles, suggestions, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def json_ids(column):
    """Numbers of a JSON array; none where it is no array."""
    return F.coalesce(F.from_json(column, "array<long>"), F.array().cast("array<long>"))


def as_json(ids):
    return F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ","), F.lit("]"))


def without_ids(rows: DataFrame, key: str, column: str, gone: DataFrame) -> DataFrame:
    """``rows`` whose JSON array ``column`` lost the ids in ``gone`` (id), by a join of the single ids; order stays. Arrays are rows' own."""
    each = rows.select(key, F.posexplode(json_ids(F.col(column))).alias("at", "id")).join(gone, "id", "left_anti")
    kept = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("kept"))
    return rows.join(kept, key, "left").withColumn(column, as_json(F.coalesce("kept", F.array().cast("array<long>")))).drop("kept")


# Logs


@query(f"with {EVENTS_SQL} select user_id::varchar as actor, action as what, created_at as at from ev union all select 'system', 'order_' || o_orderstatus, o_orderdate from orders where o_totalprice > 200000")
def snk_append_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with rows appended: what was there stays as it is."""
    log = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("actor"), F.col("action").alias("what"), F.col("created_at").alias("at"))
    new = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.lit("system").alias("actor"), F.concat(F.lit("order_"), "o_orderstatus").alias("what"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return log.unionByName(new)


@query("""select event_id, left(repeat(props, 1 + event_id::int % 60), 500) as params, round(value * 10)::bigint as latency_ms, case when event_type = 'error' then 'error' else 'success' end as status from events""")
def snk_tool_log(spark, sf_dir):
    """Rows of the log of tool calls: parameters cut to 500 characters, latency, status."""
    e = table(spark, sf_dir, "events")
    params = F.left(F.repeat("props", (1 + F.col("event_id") % 60).cast("int")), F.lit(500))
    return e.select("event_id", params.alias("params"), F.round(F.col("value") * 10).cast("long").alias("latency_ms"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"))


# Deletions

#: Files that are deleted: every fiftieth.
_GONE_SQL = "gone as (select doc_id as id from documents where doc_id % 50 = 7)"


def _gone(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("doc_id % 50 = 7").select(F.col("doc_id").alias("id"))


def _filtered_sql(condition: str) -> str:
    """SQL of the packs' and chats' arrays without the ids that a condition over ``x`` names."""
    one = lambda kind, key, view: f"""select '{kind}' as kind, v.{key} as id, '[' || coalesce(string_agg(e.x::varchar, ',' order by e.i), '') || ']' as refs from {view} v
left join (select * from (select {key}, unnest(ids) as x, generate_subscripts(ids, 1) as i from {view}) where not ({condition})) e on e.{key} = v.{key} group by v.{key}"""  # noqa: E731
    return one("pack", "pack_id", "packs") + "\nunion all " + one("chat", "chat_id", "chats")


@query(f"with {_GONE_SQL}, {PACKS_SQL}, {CHATS_SQL} {_filtered_sql('x in (select id from gone)')}")
def snk_delete_references(spark, sf_dir):
    """A deletion of files, as packs and chats see it: their arrays lose the ids."""
    gone = _gone(spark, sf_dir)
    p = without_ids(packs(spark, sf_dir).select("pack_id", "source_file_ids"), "pack_id", "source_file_ids", gone)
    c = without_ids(chats(spark, sf_dir).select("chat_id", "selected_file_ids"), "chat_id", "selected_file_ids", gone)
    row = lambda kind, df, id_, refs: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(refs).alias("refs"))
    return row("pack", p, "pack_id", "source_file_ids").unionByName(row("chat", c, "chat_id", "selected_file_ids"))


@query(f"""with {_GONE_SQL}, {EDGES_SQL}, {NODES_SQL}, {SUGGESTIONS_SQL}, g as (select 'p' || id as node from gone)
select 'nodes' as entity, count(*) as left_ from nodes where node not in (select node from g) union all
select 'edges', count(*) from edges where source not in (select node from g) and target not in (select node from g) union all
select 'suggestions', count(*) from suggestions where source not in (select node from g) and target not in (select node from g)""")
def snk_delete_nodes(spark, sf_dir):
    """A deletion of files, as the graph sees it: nodes go, with the edges and suggestions that touch them."""
    gone = _gone(spark, sf_dir).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("node"))
    left = lambda entity, df: df.agg(F.lit(entity).alias("entity"), F.count("*").alias("left_"))
    apart = lambda df: df.join(gone, df["source"] == gone["node"], "left_anti").join(gone, F.col("target") == gone["node"], "left_anti")
    return left("nodes", nodes(spark, sf_dir).join(gone, "node", "left_anti")).unionByName(left("edges", apart(edges(spark, sf_dir)))).unionByName(left("suggestions", apart(suggestions(spark, sf_dir))))


@query(f"""with {FILES_SQL}, {PACKS_SQL}, {SUGGESTIONS_SQL}, t as (select 'src' || n_nationkey as user_id from nation where n_nationkey % 6 = 1)
select 'files' as entity, user_id, count(*) as left_ from files where user_id not in (select user_id from t) group by all union all
select 'packs', user_id, count(*) from packs where user_id not in (select user_id from t) group by all union all
select 'suggestions', user_id, count(*) from suggestions where user_id not in (select user_id from t) group by all""")
def snk_delete_tenants(spark, sf_dir):
    """A cascade: every entity loses the rows of the tenants that go."""
    gone = table(spark, sf_dir, "nation").where("n_nationkey % 6 = 1").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("user_id"))
    found = None
    for entity, df in (("files", files(spark, sf_dir)), ("packs", packs(spark, sf_dir)), ("suggestions", suggestions(spark, sf_dir))):
        left = df.select("user_id").join(gone, "user_id", "left_anti").groupBy("user_id").agg(F.count("*").alias("left_")).select(F.lit(entity).alias("entity"), "user_id", "left_")
        found = left if found is None else found.unionByName(left)
    return found


@query(f"""with {FILES_SQL}, n as (select file_id, user_id, row_number() over (partition by user_id, sha256(trim(regexp_replace(lower(extracted_text), '\\s+', ' ', 'g'))) order by uploaded_at, file_id) as k, length(extracted_text) as n from files)
select file_id, user_id from n where k = 1 or n < 50""")
def dup_skip(spark, sf_dir):
    """Duplicates resolved by keeping the first of each text of a tenant; texts that have no hash all stay."""
    from corpuscle.functions import text

    f = files(spark, sf_dir).select("file_id", "user_id", "uploaded_at", text.content_hash(F.col("extracted_text")).alias("hash"))
    first = f.where("hash is not null").groupBy("user_id", "hash").agg(F.min(F.struct("uploaded_at", "file_id")).alias("first"))
    skipped = f.join(first, ["user_id", "hash"]).where(F.col("file_id") != F.col("first.file_id")).select("file_id")
    return f.join(skipped, "file_id", "left_anti").select("file_id", "user_id")


@query(f"with {MEMORIES_SQL} select memory_id, user_id from memories where not (turn = 1 and conv_id % 3 = 0)")
def mem_delete(spark, sf_dir):
    """Memories without those that are deleted."""
    m = memories(spark, sf_dir)
    gone = m.where("turn = 1 and conv_id % 3 = 0").select("memory_id")
    return m.join(gone, "memory_id", "left_anti").select("memory_id", "user_id")


@query(f"""with {MEMORIES_SQL}, pinned as (select user_id, count(*) as n from memories where is_pinned and conv_id < 30 group by 1),
w as (select m.*, row_number() over (partition by m.user_id order by updated_at, memory_id) as k from memories m where not is_pinned and turn = 2 and conv_id < 30)
select w.memory_id, w.user_id, k + coalesce(p.n, 0) <= 3 as granted from w left join pinned p using (user_id)""")
def mem_pins(spark, sf_dir, most: int = 3):
    """Wishes to pin memories, in order of time: granted while a user has under ``most`` pins."""
    m = memories(spark, sf_dir).where("conv_id < 30")
    have = m.where("is_pinned").groupBy("user_id").agg(F.count("*").alias("n"))
    w = m.where("not is_pinned and turn = 2").withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy("updated_at", "memory_id")))
    return w.join(have, "user_id", "left").select("memory_id", "user_id", (F.col("k") + F.coalesce("n", F.lit(0)) <= most).alias("granted"))


# Claims and exports


@query(f"""with {FILES_SQL}, {PACKS_SQL}, c as (select pack_id, 'src' || (pack_id + 7) % 20 as claimant, unnest(ids) as file_id from packs where not is_locked and pack_id % 5 = 0),
s as (select c.*, f.file_id is not null as there, coalesce(strlen(f.extracted_text), 0) as size, case when f.file_id % 6 = 0 then 'locked' when f.file_id % 9 = 1 then 'external' when f.extracted_text = '' then 'missing' else 'copied' end as fate from c left join files f using (file_id)),
g as (select pack_id, claimant, count(*) filter (where there and fate = 'copied') as copied, count(*) filter (where there and fate in ('external', 'missing')) as skipped, coalesce(sum(size) filter (where there and fate = 'copied'), 0)::bigint as bytes,
      string_agg(sha256(claimant || chr(31) || file_id)[1:12], ',' order by file_id) filter (where there and fate = 'copied') as new_ids from s group by all),
u as (select user_id as claimant, count(*) as n_packs from packs group by 1)
select pack_id, claimant, copied, skipped, bytes, case when n_packs >= 90 then 'PACK_LIMIT_REACHED' when bytes > 20000 then 'STORAGE_LIMIT_REACHED' else 'ok' end as verdict, case when n_packs < 90 and bytes <= 20000 then new_ids end as new_ids from g join u using (claimant)""")
def snk_claim_pack(spark, sf_dir, most_packs: int = 90, room: int = 20000):
    """Shared packs claimed by another tenant: copies under new ids, without locked, external and missing files; nothing where a quota is full."""
    p = packs(spark, sf_dir)
    claims = p.where("not is_locked and pack_id % 5 = 0").select("pack_id", F.concat(F.lit("src"), ((F.col("pack_id") + 7) % 20).cast("string")).alias("claimant"), F.explode(json_ids(F.col("source_file_ids"))).alias("file_id"))
    f = files(spark, sf_dir).select("file_id", F.octet_length("extracted_text").alias("size"), F.when(F.col("file_id") % 6 == 0, "locked").when(F.col("file_id") % 9 == 1, "external").when(F.col("extracted_text") == "", "missing").otherwise("copied").alias("fate"))
    s = claims.join(f, "file_id", "left")
    copied, new = F.col("fate") == "copied", F.substring(F.sha2(F.concat_ws("\u001f", "claimant", F.col("file_id").cast("string")), 256), 1, 12)
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(copied, F.struct("file_id", new.alias("new"))))), lambda x: x["new"]), ",")
    g = s.groupBy("pack_id", "claimant").agg(F.count_if(copied).alias("copied"), F.count_if(F.col("fate").isin("external", "missing")).alias("skipped"), F.coalesce(F.sum(F.when(copied, F.col("size"))), F.lit(0)).cast("long").alias("bytes"), F.nullif(ids, F.lit("")).alias("new_ids"))
    held = p.groupBy(F.col("user_id").alias("claimant")).agg(F.count("*").alias("n_packs"))
    verdict = F.when(F.col("n_packs") >= most_packs, "PACK_LIMIT_REACHED").when(F.col("bytes") > room, "STORAGE_LIMIT_REACHED").otherwise("ok")
    return g.join(held, "claimant").withColumn("verdict", verdict).select("pack_id", "claimant", "copied", "skipped", "bytes", "verdict", F.when(F.col("verdict") == "ok", F.col("new_ids")).alias("new_ids"))


@query("""select 'profiles/' || c_custkey || '.json' as path, '{"user_id":' || c_custkey || case when c_mktsegment = 'BUILDING' then ',"identity":"' || c_name || '"' else '' end || case when c_custkey % 4 = 0 then ',"goals":"learn"' when c_custkey % 4 = 1 then ',"goals":""' else '' end || '}' as body from customer""")
def snk_export_records(spark, sf_dir):
    """Artefacts for an external store: a path and a JSON body each, without nulls. ``df.write`` takes them from here."""
    p = profiles(spark, sf_dir)
    return p.select(F.concat(F.lit("profiles/"), F.col("user_id").cast("string"), F.lit(".json")).alias("path"), F.to_json(F.struct("user_id", "identity", "goals")).alias("body"))


@query(f"with {FILES_SQL} select file_id, case when processing_status = 'ready' and user_id = 'src5' then 'uploaded' else processing_status end as status from files")
def snk_rollback(spark, sf_dir, failed: str = "src5"):
    """A failed run of a tenant undone: its files stand where they stood before."""
    f = files(spark, sf_dir)
    return f.select("file_id", F.when((F.col("processing_status") == "ready") & (F.col("user_id") == failed), "uploaded").otherwise(F.col("processing_status")).alias("status"))


# The graph


@query(f"""with {SUGGESTIONS_SQL} select source, target, 'semantically_related' as edge_type, 0.8::double as weight, 'user_accepted' as provenance from suggestions where status = 'pending' and suggestion_id % 3 = 0""")
def grf_accept(spark, sf_dir):
    """Edges of the suggestions that are accepted."""
    s = suggestions(spark, sf_dir).where("status = 'pending' and suggestion_id % 3 = 0")
    return s.select("source", "target", F.lit("semantically_related").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit("user_accepted").alias("provenance"))


@query(f"""with {SUGGESTIONS_SQL} select suggestion_id, case when status = 'pending' and suggestion_id % 3 = 0 then 'accepted' when status = 'pending' and suggestion_id % 3 = 1 then 'dismissed' else status end as status from suggestions""")
def grf_decide(spark, sf_dir):
    """Suggestions after decisions; what was decided before stays."""
    open_, third = F.col("status") == "pending", F.col("suggestion_id") % 3
    return suggestions(spark, sf_dir).select("suggestion_id", F.when(open_ & (third == 0), "accepted").when(open_ & (third == 1), "dismissed").otherwise(F.col("status")).alias("status"))


def touching(edges_: DataFrame) -> DataFrame:
    """node, other: every edge from both ends."""
    return edges_.select(F.col("source").alias("node"), F.col("target").alias("other")).unionByName(edges_.select(F.col("target").alias("node"), F.col("source").alias("other")))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, {SUGGESTIONS_SQL}, b as (select source as node, target as other from edges union all select target, source from edges)
select node, object_type from nodes n where object_type <> 'source_file' and not exists (select 1 from b where b.node = n.node and b.other like 'o1%') and not exists (select 1 from suggestions s where s.status = 'pending' and (s.source = n.node or s.target = n.node))""")
def jn_orphan_derived(spark, sf_dir):
    """Derived nodes that hang on no living file and that no open suggestion names; files with a key that begins with 1 live."""
    n = nodes(spark, sf_dir).where("object_type <> 'source_file'").select("node", "object_type")
    held = touching(edges(spark, sf_dir)).where("other like 'o1%'").select("node")
    named = suggestions(spark, sf_dir).where("status = 'pending'")
    named = named.select(F.col("source").alias("node")).unionByName(named.select(F.col("target").alias("node")))
    return n.join(held, "node", "left_anti").join(named, "node", "left_anti")


@query(f"""with {EDGES_SQL}, {NODES_SQL}, ghosts as (select node from nodes where object_type = 'source_file' and substr(node, 2)::bigint not in (select o_orderkey from orders where o_orderstatus <> 'F')),
e as (select * from edges where source not in (select node from ghosts) and target not in (select node from ghosts)),
anchored as (select distinct target as node from e where source like 'o%'),
loose as (select node from nodes where object_type = 'entity' and node not in (select node from anchored))
select 'ghost' as phase, node from ghosts union all select 'loose', node from loose""")
def grf_ghost_cleanup(spark, sf_dir):
    """A clean-up in two phases: nodes of files that are gone, with their edges; then entities that no file holds any more."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    alive = table(spark, sf_dir, "orders").where("o_orderstatus <> 'F'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    ghosts = n.where("object_type = 'source_file'").join(alive, "node", "left_anti").select("node")
    left = e.join(ghosts, e["source"] == ghosts["node"], "left_anti").join(ghosts, F.col("target") == ghosts["node"], "left_anti")
    loose = n.where("object_type = 'entity'").join(left.where("source like 'o%'").select(F.col("target").alias("node")), "node", "left_anti").select("node")
    return ghosts.select(F.lit("ghost").alias("phase"), "node").unionByName(loose.select(F.lit("loose").alias("phase"), "node"))


@query(f"""with {EDGES_SQL}, empty as (select s_suppkey from supplier where s_suppkey not in (select l_suppkey from lineitem where l_suppkey % 3 <> 0 and l_quantity > 48)), g as (select 's' || s_suppkey as node from empty)
select s_suppkey as cluster_id, (select count(*) from edges e where e.target = 's' || s_suppkey) as edges_gone from empty""")
def grf_empty_clusters(spark, sf_dir):
    """Clusters without members, and how many edges go with each."""
    full = table(spark, sf_dir, "lineitem").where("l_suppkey % 3 <> 0 and l_quantity > 48").select(F.col("l_suppkey").alias("s_suppkey"))
    empty = table(spark, sf_dir, "supplier").join(full, "s_suppkey", "left_anti").select(F.col("s_suppkey").alias("cluster_id"))
    gone = edges(spark, sf_dir).groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"))
    return empty.withColumn("node", F.concat(F.lit("s"), F.col("cluster_id").cast("string"))).join(gone, "node", "left").select("cluster_id", F.coalesce("n", F.lit(0)).alias("edges_gone"))


@query(f"with {CHATS_SQL}, {PACKS_SQL} {_filtered_sql('x not in (select doc_id from documents)')}")
def set_valid_arrays(spark, sf_dir):
    """The arrays of packs and chats without ids that no file has."""
    known = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    found = None
    for kind, df, key, column in (("pack", packs(spark, sf_dir), "pack_id", "source_file_ids"), ("chat", chats(spark, sf_dir), "chat_id", "selected_file_ids")):
        df = df.select(key, column)
        unknown = df.select(F.explode(json_ids(F.col(column))).alias("id")).distinct().join(known, "id", "left_anti")
        rows = without_ids(df, key, column, unknown).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(column).alias("refs"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query(f"""with {FILES_SQL}, r as (select file_id, user_id, row_number() over (partition by user_id order by uploaded_at desc, file_id) as k from files)
select file_id, user_id, case when user_id in ('src1', 'src2') then 'starter' else 'free' end as plan, k > case when user_id in ('src1', 'src2') then 500 else 50 end as is_locked from r""")
def ten_change_plan(spark, sf_dir):
    """Files after a change of plans: the newest stay open, what is over a plan's limit is locked."""
    plan = F.when(F.col("user_id").isin("src1", "src2"), "starter").otherwise("free")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("uploaded_at"), "file_id"))
    return files(spark, sf_dir).select("file_id", "user_id", plan.alias("plan"), (k > scoring.plan_limit(plan, "files")).alias("is_locked"))
