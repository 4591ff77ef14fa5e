"""Queue, ingestion, organising, retrieval and graph queries that combine the smaller operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring, text
from corpuscle.operators.mutations import json_ids, touching
from corpuscle.operators.relational import EDGES_SQL, EVENTS_SQL, FILES_SQL
from corpuscle.plans.views import NODES_SQL, PACKS_SQL
from corpuscle.sources.documents import outcomes, records_of
from corpuscle.sources.tables import as_of, cluster_map, edges, events, files, nodes, packs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Uploads and the queue


@query(f"""with {FILES_SQL}, u as (select *, strlen(extracted_text) as size, file_id % 12 = 5 as vault, row_number() over (partition by user_id order by uploaded_at, file_id) as k, count(*) filter (where file_id % 12 <> 5) over (partition by user_id order by uploaded_at, file_id rows unbounded preceding) as queued from files)
select file_id, case when size = 0 then 'EMPTY_FILE' when size > 30000 then 'FILE_TOO_LARGE' when k > 50 then 'QUOTA_EXCEEDED' when not vault and queued > 10 then 'QUEUE_FULL' when file_id % 97 = 1 then 'DISK_FULL' when vault then 'vault' else 'queued' end as verdict from u""")
def src_admission(spark: SparkSession, sf_dir: str, largest: int = 30000) -> DataFrame:
    """Uploads of each tenant in order: the first rule that one breaks, else the vault for formats that aren't read, else the queue."""
    size, vault = F.octet_length("extracted_text"), F.col("file_id") % 12 == 5
    w = Window.partitionBy("user_id").orderBy("uploaded_at", "file_id")
    f = files(spark, sf_dir).withColumns({"k": F.row_number().over(w), "queued": F.count_if(~vault).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    verdict = (
        F.when(size == 0, "EMPTY_FILE").when(size > largest, "FILE_TOO_LARGE").when(F.col("k") > scoring.PLAN_LIMITS["free"]["files"], "QUOTA_EXCEEDED")
        .when(~vault & (F.col("queued") > scoring.PLAN_LIMITS["free"]["queue"]), "QUEUE_FULL").when(F.col("file_id") % 97 == 1, "DISK_FULL").when(vault, "vault").otherwise("queued")
    )
    return f.select("file_id", verdict.alias("verdict"))


@query(f"""with {FILES_SQL}, l as (select file_id, case file_id % 4 when 0 then file_id || '_' || filename when 1 then 'plain name.pdf' when 2 then 'abc_x.md' else '_odd' end as name, case file_id % 3 when 0 then 'application/pdf' when 1 then 'text/markdown' else 'image/odd' end as mime from files)
select file_id, case file_id % 4 when 0 then file_id::varchar when 2 then 'abc' end as linked_id, case file_id % 4 when 0 then substr(name, strpos(name, '_') + 1) when 2 then 'x.md' else name end as original, case file_id % 3 when 0 then 'pdf' when 1 then 'md' else 'txt' end as filetype from l""")
def src_import_listing(spark, sf_dir):
    """An external listing: names that begin with an id give it and the original name; types by MIME, text where it is unknown."""
    i = F.col("file_id")
    f = files(spark, sf_dir)
    name = F.when(i % 4 == 0, F.concat_ws("_", i.cast("string"), "filename")).when(i % 4 == 1, "plain name.pdf").when(i % 4 == 2, "abc_x.md").otherwise("_odd")
    mime = F.when(i % 3 == 0, "application/pdf").when(i % 3 == 1, "text/markdown").otherwise("image/odd")
    kinds = F.create_map(*[F.lit(x) for pair in (("application/pdf", "pdf"), ("text/plain", "txt"), ("text/markdown", "md")) for x in pair])
    split = lambda n: F.regexp_extract(name, "^([^_ ]+)_(.+)$", n)
    return f.select("file_id", F.nullif(split(1), F.lit("")).alias("linked_id"), F.coalesce(F.nullif(split(2), F.lit("")), name).alias("original"), F.coalesce(F.try_element_at(kinds, mime), F.lit("txt")).alias("filetype"))


@query(f"""with {FILES_SQL} select file_id, case when length(trim(extracted_text)) = 0 then 'empty' else 'ok' end as status, case when filetype in ('en', 'fr', 'de', 'es') then 'vault' end as processor, 0 as cost, case when length(extracted_text) >= 50 then 'uploaded' else 'uploaded' end as next_status,
case when length(extracted_text) > 20000 then 'large' end as warning from files where processing_status = 'uploaded'""")
def que_process(spark, sf_dir):
    """Queued files processed: extraction's status, processor and cost by type, the status that follows, a warning for large texts."""
    f = files(spark, sf_dir).where("processing_status = 'uploaded'")
    route, status = scoring.route(F.col("filetype")), text.extraction_status(F.col("extracted_text"))
    following = F.when(status == "encrypted", "error").otherwise("uploaded")
    return f.select("file_id", status.alias("status"), route["processor"].alias("processor"), route["cost"].alias("cost"), following.alias("next_status"), F.when(F.length("extracted_text") > 20000, "large").alias("warning"))


@query(r"""with {FILES_SQL}, j as (select file_id, processing_status as s, processing_status = 'uploaded' as queued, file_id % 17 = 0 as gone, case when trim(extracted_text, e' \n\t\r') = '' then '[Empty file]' else trim(extracted_text, e' \n\t\r') end as t from files)
select file_id, case when queued and not gone then length(t) else 0 end as chars, case when queued and not gone and length(t) >= 50 and not starts_with(t, '[') then sha256(trim(regexp_replace(lower(t), '\s+', ' ', 'g'))) end as content_hash,
case when queued and not gone then case when t = '[Empty file]' then 'empty' else 'ok' end end as extraction_status, case when queued and gone then 'error' else s end as processing_status, case when queued and gone then 'raw file gone: ' || file_id || '.txt' end as extract_error from j""".replace("{FILES_SQL}", FILES_SQL))
def que_run(spark, sf_dir):
    """Queued jobs run over their raw files, here the documents' texts as text files, of which some are gone: typed records, hashes, statuses and errors."""
    f = files(spark, sf_dir)
    name = F.concat(F.col("file_id").cast("string"), F.lit(".txt"))
    raw = f.where("file_id % 17 <> 0").select(name.alias("path"), name.alias("filename"), F.length("extracted_text").cast("long").alias("length"), F.encode("extracted_text", "utf-8").alias("content"), F.lit("txt").alias("ext"), scoring.route(F.lit("txt")).alias("route"))
    status = F.when(F.col("processing_status") == "uploaded", "queued").otherwise(F.col("processing_status"))
    done = outcomes(f.select("file_id", name.alias("raw_name"), status.alias("processing_status")), records_of(raw))
    return done.select("file_id", F.coalesce(F.length("extracted_text"), F.lit(0)).cast("long").alias("chars"), "content_hash", "extraction_status", "processing_status", "extract_error")


#: Average seconds of the three classes of jobs to begin with.
CLASS_SECONDS = (5, 60, 300)


def queue_etas(jobs: DataFrame) -> DataFrame:
    """``jobs`` (job_id, day, queued_at, seconds) with position and wait over the whole queue.

    Sums of days come first, one row a day; then each day is summed up by itself: no window holds the whole queue."""
    days = jobs.groupBy("day").agg(F.count("*").alias("n"), F.sum("seconds").alias("s"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # a row a day
    days = days.select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s_before"))
    inside = Window.partitionBy("day").orderBy("queued_at", "job_id")
    placed = jobs.withColumns({"k": F.row_number().over(inside), "t": F.sum("seconds").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    return placed.join(F.broadcast(days), "day").select("job_id", (F.col("n_before") + F.col("k")).alias("position"), (F.col("s_before") + F.col("t")).alias("wait_seconds"))


@query(f"""with {EVENTS_SQL}, q as (select event_id as job_id, created_at, case action when 'view' then 5 when 'click' then 60 else 300 end as seconds from ev)
select job_id, row_number() over w as position, sum(seconds) over w as wait_seconds, case when row_number() over w <= 3 then null when sum(seconds) over w > 60 then 'position ' || row_number() over w || ', about ' || sum(seconds) over w // 60 || ' minutes' else 'position ' || row_number() over w || ', about ' || sum(seconds) over w || ' seconds' end as why
from q window w as (order by created_at, job_id rows unbounded preceding)""")
def que_status(spark, sf_dir):
    """Position, waiting time and an explanation for each job of the queue, by the averages of its class."""
    e = events(spark, sf_dir)
    seconds = F.when(F.col("action") == "view", CLASS_SECONDS[0]).when(F.col("action") == "click", CLASS_SECONDS[1]).otherwise(CLASS_SECONDS[2])
    q = queue_etas(e.select(F.col("event_id").alias("job_id"), F.to_date("created_at").alias("day"), F.col("created_at").alias("queued_at"), seconds.cast("long").alias("seconds")))
    about = F.when(F.col("wait_seconds") > 60, F.concat(F.floor(F.col("wait_seconds") / 60).cast("string"), F.lit(" minutes"))).otherwise(F.concat(F.col("wait_seconds").cast("string"), F.lit(" seconds")))
    return q.withColumn("why", F.when(F.col("position") > 3, F.concat(F.lit("position "), F.col("position").cast("string"), F.lit(", about "), about)))


# Organising


@query(f"""with {FILES_SQL}, o as (select file_id, user_id, filename, length(extracted_text) as n from files where not summarised and extracted_text <> '' and file_kind = 'processed' and extraction_status = 'ok')
select o.file_id, coalesce('cluster ' || e.label, 'noise ' || o.file_id) as cluster, case when e.vec_id is null then 1.0 else round(abs(e.embedding[1]), 6) end::double as relevance, case when n > 5500 then 'mapreduce' else 'simple' end as mode from o left join embeddings e on e.vec_id = o.file_id""")
def org_new(spark, sf_dir):
    """An incremental run: files without a summary with the cluster they go to (noise to one of its own, of relevance 1) and how they are summarised."""
    f = files(spark, sf_dir).where("not summarised and extracted_text <> '' and file_kind = 'processed' and extraction_status = 'ok'")
    c = cluster_map(spark, sf_dir)
    placed = f.join(c, "file_id", "left")
    cluster = F.coalesce(F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")), F.concat(F.lit("noise "), F.col("file_id").cast("string")))
    mode = F.when(F.length("extracted_text") > 5500, "mapreduce").otherwise("simple")
    return placed.select("file_id", cluster.alias("cluster"), F.coalesce(F.col("relevance").cast("double"), F.lit(1.0)).alias("relevance"), mode.alias("mode"))


@query(f"""with {FILES_SQL}, s as (select e.label as cluster_id, f.filename, row_number() over (partition by e.label order by round(abs(e.embedding[1]), 6) desc, f.file_id) as k, count(*) over (partition by e.label) as members from embeddings e join files f on f.file_id = e.vec_id)
select cluster_id::int as cluster_id, max(filename) filter (where k = 1) as title, string_agg(filename, '|' order by k) filter (where k <= 3) as samples, any_value(members) as members from s where k <= 3 group by 1""")
def clu_labels(spark, sf_dir):
    """Titles of clusters without a model: the name of the first of three samples; a model would be given the samples."""
    c = cluster_map(spark, sf_dir).join(files(spark, sf_dir).select("file_id", "filename"), "file_id")
    k = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("relevance"), "file_id"))
    sizes = c.groupBy("cluster_id").agg(F.count("*").alias("members"))
    top = c.withColumn("k", k).where("k <= 3").groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("k", "filename"))).alias("s"))
    return top.join(sizes, "cluster_id").select("cluster_id", F.col("s")[0]["filename"].alias("title"), F.array_join(F.transform("s", lambda x: x["filename"]), "|").alias("samples"), "members")


@query(f"""with {FILES_SQL} select file_id, case when trim(extracted_text) = '' then null else length(extracted_text) end as embedded_chars, case when trim(extracted_text) = '' then 'skipped' else 'embedded' end as fate from files where file_id % 2 = 1 and file_kind = 'processed'""")
def emb_batch(spark, sf_dir):
    """Texts that a batch embeds, with what stands for the vector here: blanks get none."""
    f = files(spark, sf_dir).where("file_id % 2 = 1 and file_kind = 'processed'")
    blank = F.trim("extracted_text") == ""
    return f.select("file_id", F.when(~blank, F.length("extracted_text")).cast("long").alias("embedded_chars"), F.when(blank, "skipped").otherwise("embedded").alias("fate"))


@query(f"""with {FILES_SQL}, t as (select *, case file_id % 4 when 0 then '' when 1 then '[]' when 2 then 'null' else '["a"]' end as tags from files) select file_id, case when summarised then 'summary' else 'body' end as source, case when d <= 7 then 'current' when d <= 30 then 'aging' else 'stale' end as freshness
from (select *, floor((epoch(timestamp '2024-02-01') - epoch(uploaded_at)) / 86400) as d from t) where tags in ('', '[]', 'null')""")
def enr_all(spark, sf_dir):
    """Files that bulk enrichment takes: those without tags, with what is read of them and how fresh they are."""
    tags = F.when(F.col("file_id") % 4 == 0, "").when(F.col("file_id") % 4 == 1, "[]").when(F.col("file_id") % 4 == 2, "null").otherwise('["a"]')
    f = files(spark, sf_dir).where(tags.isin("", "[]", "null"))
    return f.select("file_id", F.when(F.col("summarised"), "summary").otherwise("body").alias("source"), scoring.freshness(F.col("uploaded_at"), as_of()).alias("freshness"))


# Retrieval


@query(f"""with {FILES_SQL}, c as (select f.*, coalesce('cluster ' || e.label, '—') as cluster from files f left join embeddings e on e.vec_id = f.file_id),
r as (select *, row_number() over (partition by user_id order by uploaded_at desc, file_id) as k from c where processing_status = 'ready' and file_kind = 'processed' and extraction_status = 'ok')
select user_id, k, '- ' || filename || ' (cluster: ' || cluster || ', ' || length(extracted_text) || ' chars)' as line from r where k <= 30""")
def ret_builder_inventory(spark, sf_dir, most: int = 30):
    """Lines of what a pack builder is shown: the newest thirty files of a tenant that can be used, with cluster and length."""
    c = cluster_map(spark, sf_dir).select("file_id", F.concat(F.lit("cluster "), F.col("cluster_id").cast("string")).alias("cluster"))
    usable = files(spark, sf_dir).where("processing_status = 'ready' and file_kind = 'processed' and extraction_status = 'ok'")
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("uploaded_at"), "file_id"))
    rows = usable.withColumn("k", k).where(F.col("k") <= most).join(c, "file_id", "left")
    line = F.concat(F.lit("- "), "filename", F.lit(" (cluster: "), F.coalesce("cluster", F.lit("—")), F.lit(", "), F.length("extracted_text").cast("string"), F.lit(" chars)"))
    return rows.select("user_id", "k", line.alias("line"))


@query(f"""with {FILES_SQL}, {PACKS_SQL}, s as (select pack_id, unnest(ids) as file_id from packs where pack_id % 4 = 0)
select s.pack_id, s.file_id, length(case when f.summarised then left(extracted_text, 300) else left(extracted_text, 3000) end) as chars, md5(case when f.summarised then left(extracted_text, 300) else left(extracted_text, 3000) end) as digest from s join files f using (file_id)""")
def ret_pack_sources(spark, sf_dir, most: int = 3000):
    """What each source gives to its pack: its summary, else the first 3,000 characters; regenerating a pack reads the same again."""
    s = packs(spark, sf_dir).where("pack_id % 4 = 0").select("pack_id", F.explode(json_ids(F.col("source_file_ids"))).alias("file_id"))
    part = F.when(F.col("summarised"), F.left("extracted_text", F.lit(300))).otherwise(F.left("extracted_text", F.lit(most)))
    return s.join(files(spark, sf_dir), "file_id").select("pack_id", "file_id", F.length(part).cast("long").alias("chars"), F.md5(part).alias("digest"))


@query(f"""with {FILES_SQL}, {PACKS_SQL}, r as (select user_id, 'file' as layer, file_id as id, row_number() over (partition by user_id order by uploaded_at desc, file_id) as k from files where processing_status = 'ready'
union all select user_id, 'pack', pack_id, row_number() over (partition by user_id order by pack_id) from packs where not is_locked) select * from r where k <= case layer when 'file' then 2000 else 3 end""")
def ret_layers(spark, sf_dir):
    """The layers of a tenant's context as one table: ready files up to 2,000, open packs up to three."""
    k = lambda *order: F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    f = files(spark, sf_dir).where("processing_status = 'ready'").select("user_id", F.lit("file").alias("layer"), F.col("file_id").alias("id"), k(F.desc("uploaded_at"), "file_id").alias("k")).where("k <= 2000")
    p = packs(spark, sf_dir).where("not is_locked").select("user_id", F.lit("pack").alias("layer"), F.col("pack_id").alias("id"), k("pack_id").alias("k")).where("k <= 3")
    return f.unionByName(p)


@query(f"""with {EDGES_SQL}, {NODES_SQL}, chosen as (select 'o' || o_orderkey as node from orders where o_orderkey % 50 = 1), d as (select source as node, target as other, 0 as way, weight from edges union all select target, source, 1, weight from edges),
r as (select d.*, row_number() over (partition by d.node order by way, weight desc, other) as k from d join chosen using (node)), c as (select * from r where k <= 5)
select c.node, c.other, n.label, count(*) over (partition by c.other) as shared from c join nodes n on n.node = c.other""")
def grf_evidence(spark, sf_dir, most: int = 5):
    """The sub-graph of chosen files: five edges of each, outgoing first, with labels, and how many chosen files share a neighbour."""
    chosen = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 1").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    e = edges(spark, sf_dir)
    way = lambda own, other, n: e.select(F.col(own).alias("node"), F.col(other).alias("other"), F.lit(n).alias("way"), "weight")
    both = way("source", "target", 0).unionByName(way("target", "source", 1)).join(chosen, "node", "left_semi")
    k = F.row_number().over(Window.partitionBy("node").orderBy("way", F.desc("weight"), "other"))
    capped = both.withColumn("k", k).where(F.col("k") <= most)
    shared = capped.groupBy("other").agg(F.count("*").alias("shared"))
    return capped.join(shared, "other").join(nodes(spark, sf_dir).select(F.col("node").alias("other"), "label"), "other").select("node", "other", "label", "shared")


# The graph


@query(f"with {EDGES_SQL}, {NODES_SQL} select (select count(*) from nodes where object_type = 'source_file') as file_nodes, (select count(distinct l_orderkey) from lineitem) as files, (select count(*) from nodes where object_type = 'source_file') = (select count(distinct l_orderkey) from lineitem) as up_to_date")
def grf_rebuild(spark, sf_dir):
    """Whether a graph stands for all files already, so that building it again can be left out."""
    n = nodes(spark, sf_dir).where("object_type = 'source_file'").agg(F.count("*").alias("file_nodes"))
    n = n.withColumn("files", table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_orderkey")).scalar())
    return n.withColumn("up_to_date", (F.col("file_nodes") == F.col("files")) & (F.col("files") > 0))


@query("""select l_orderkey as file_id, l_returnflag || ' ' || l_linestatus as topic, 0.6::double as weight, 0.9::double as confidence, l_linenumber as nth from lineitem where l_linenumber <= 5""")
def grf_topic_edges(spark, sf_dir):
    """An edge for each of a file's first five topics; one that is named twice gives two, as the build does."""
    topics = F.concat_ws(" ", "l_returnflag", "l_linestatus")
    return table(spark, sf_dir, "lineitem").where("l_linenumber <= 5").select(F.col("l_orderkey").alias("file_id"), topics.alias("topic"), F.lit(0.6).alias("weight"), F.lit(0.9).alias("confidence"), F.col("l_linenumber").alias("nth"))


@query("""with w as (select doc_id, unnest(list_distinct(list_filter(string_split(text, ' '), lambda x: regexp_full_match(x, '[A-Z][a-z]{3,}')))) as name from documents), r as (select *, row_number() over (partition by doc_id order by name) as k from w)
select doc_id as file_id, name, 'mentions' as edge_type, 0.8::double as weight, 0.7::double as confidence from r where k <= 20""")
def grf_mentions(spark, sf_dir, most: int = 20):
    """Edges to the entities a text names, twenty at most, each of two letters or more. Capitalised words stand for a model's entities."""
    d = table(spark, sf_dir, "documents")
    names = F.slice(F.array_sort(F.array_distinct(F.filter(F.split("text", " "), lambda x: x.rlike("^[A-Z][a-z]{3,}$")))), 1, most)
    found = d.select(F.col("doc_id").alias("file_id"), F.explode(names).alias("name")).where("length(name) >= 2")
    return found.select("file_id", "name", F.lit("mentions").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit(0.7).alias("confidence"))


@query(f"""with {EDGES_SQL}, {NODES_SQL}, g as (select node, count(*) as degree from (select source as node from edges union all select target from edges) group by 1)
select n.node, n.label, g.degree, case n.object_type when 'source_file' then 'order of ' || o.o_orderpriority when 'entity' then p.p_type else 'balance ' || s.s_acctbal::decimal(12,2) end as summary from nodes n join g using (node)
left join orders o on n.object_type = 'source_file' and o.o_orderkey = substr(n.node, 2)::bigint left join part p on n.object_type = 'entity' and p.p_partkey = substr(n.node, 2)::bigint left join supplier s on n.object_type = 'project' and s.s_suppkey = substr(n.node, 2)::bigint""")
def grf_details(spark, sf_dir):
    """Nodes with their degree and a summary that depends on their type."""
    n, key = nodes(spark, sf_dir), F.substring("node", 2, 20).cast("long")
    degree = touching(edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("degree"))
    told = lambda t, id_, kind, summary: table(spark, sf_dir, t).select(F.col(id_).alias("key"), F.lit(kind).alias("object_type"), summary.alias("summary"))
    summaries = (
        told("orders", "o_orderkey", "source_file", F.concat(F.lit("order of "), "o_orderpriority"))
        .unionByName(told("part", "p_partkey", "entity", F.col("p_type")))
        .unionByName(told("supplier", "s_suppkey", "project", F.concat(F.lit("balance "), F.col("s_acctbal").cast("decimal(12,2)").cast("string"))))
    )
    return n.withColumn("key", key).join(degree, "node").join(summaries, ["key", "object_type"], "left").select("node", "label", "degree", "summary")


@query("""select s_suppkey as lens_id, case when s_suppkey % 4 = 3 then null else (array['file', 'entity', 'project'])[(s_suppkey % 3 + 1)::int] end as family, case when s_suppkey % 4 = 3 then null else 'contains' end as edge_type from supplier""")
def grf_lenses(spark, sf_dir):
    """Saved filters read from their JSON; a broken one filters nothing."""
    i = F.col("s_suppkey")
    family = F.element_at(F.array(F.lit("file"), F.lit("entity"), F.lit("project")), (i % 3 + 1).cast("int"))
    made = F.when(i % 4 == 3, "{broken").otherwise(F.concat(F.lit('{"family":"'), family, F.lit('","edge_type":"contains"}')))
    spec = F.from_json(made, "family string, edge_type string")
    return table(spark, sf_dir, "supplier").select(i.alias("lens_id"), spec["family"].alias("family"), spec["edge_type"].alias("edge_type"))


@query(f"""with {EDGES_SQL} select distinct source, target from edges where edge_type = 'derived_from' or source like 'o2%'""")
def set_distinct_edges(spark, sf_dir):
    """Edges by their ends, each pair once."""
    return edges(spark, sf_dir).where("edge_type = 'derived_from' or source like 'o2%'").select("source", "target").dropDuplicates(["source", "target"])


