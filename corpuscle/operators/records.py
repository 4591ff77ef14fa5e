"""Records of the service: profiles, packs, memory updates, shares, intents, history, cache and reference clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import text
from corpuscle.operators.relational import EDGES_SQL, EVENTS_SQL, FILES_SQL, MEMORIES_SQL
from corpuscle.sources.tables import edges, events, files, memories, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Intents of a message, in the order they are tried: how keywords are looked for, and which.
INTENTS = (
    ("help", "start", ("/help", "ช่วยเหลือ", "วิธีใช้", "help", "/start")),
    ("get_file", "in", ("ขอไฟล์", "ส่งไฟล์", "ขอ file", "send file", "download", "ดาวน์โหลด")),
    ("search", "prefix", ("หาไฟล์", "ค้นหา", "search", "find", "หา ", "ค้น ", "หาไฟล์เรื่อง")),
    ("list_files", "is", ("ดูไฟล์", "โชว์ไฟล์", "ไฟล์ของฉัน", "ไฟล์ทั้งหมด", "ไฟล์ในตู้", "ไฟล์อะไรบ้าง", "ไฟล์มีอะไรบ้าง", "รายการไฟล์", "list", "list files", "show files", "my files", "all files")),
    ("stats", "in", ("กี่ไฟล์", "ทั้งหมด", "stats", "สถานะ", "status", "ฉันมี", "i have", "ดูตู้")),
    ("upload_help", "is", ("อัปโหลด", "upload", "ส่งไฟล์ยังไง", "วิธีส่งไฟล์")),
    ("settings", "is", ("ตั้งค่า", "settings", "จัดการบัญชี")),
    ("contact", "is", ("ติดต่อ", "contact", "support", "ช่วยเหลือเทคนิค")),
)


def intent(message):
    """What a message asks for; a web address comes before all keywords, chat is what is left."""
    low = F.trim(F.lower(F.coalesce(message, F.lit(""))))
    rule = F.when(message.rlike(r"https?://\S+"), "url_upload")
    for name, how, words in INTENTS:
        tests = {
            "is": lambda w: low == w,
            "in": lambda w: F.contains(low, F.lit(w)),
            "start": lambda w: (low == w) | F.startswith(low, F.lit(w + " ")),
            "prefix": lambda w: F.startswith(low, F.lit(w)) | F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(f" {w} ")),
        }[how]
        any_ = F.lit(False)
        for w in words:
            any_ = any_ | tests(w)
        rule = rule.when(any_, name)
    return rule.otherwise("chat")


@query("""with m as (select event_id, case event_id % 6 when 0 then 'see https://x.org/a' when 1 then 'Help me' when 2 then 'please download it' when 3 then 'Find the report' when 4 then 'my files' else 'hello' end as m from events)
select event_id, case when m like '%https://%' then 'url_upload' when m ilike 'help %' then 'help' when m ilike '%download%' then 'get_file' when m ilike 'find%' then 'search' when m = 'my files' then 'list_files' else 'chat' end as intent from m""")
def txt_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F
    for i, m in enumerate(("see https://x.org/a", "Help me", "please download it", "Find the report", "my files")):
        made = made.when(F.col("event_id") % 6 == i, m)
    return table(spark, sf_dir, "events").select("event_id", intent(made.otherwise("hello")).alias("intent"))


def wing_valid(core, wing):
    """A wing is a neighbour of its core on the circle 1..9, or absent."""
    return core.between(1, 9) & (wing.isNull() | (wing == F.pmod(core - 2, F.lit(9)) + 1) | (wing == F.pmod(core, F.lit(9)) + 1))


def top_five_problem(chosen, known):
    """Why a list of up to five known, distinct names is not valid; null where it is."""
    unknown = F.array_except(chosen, known)
    return F.when(F.size(chosen) > 5, "TOO_MANY").when(F.size(F.array_distinct(chosen)) < F.size(chosen), "DUPLICATE").when(F.size(unknown) > 0, F.array_join(unknown, ","))


@query("""select p_partkey, (p_size % 10)::int as core, (p_partkey % 11)::int as wing, (p_size % 10) between 1 and 9 and ((p_partkey % 11) = ((p_size % 10 - 2 + 9) % 9) + 1 or (p_partkey % 11) = (p_size % 10) % 9 + 1) as valid from part""")
def mth_profile_valid(spark, sf_dir):
    core, wing = (F.col("p_size") % 10).cast("int"), (F.col("p_partkey") % 11).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", core.alias("core"), wing.alias("wing"), wing_valid(core, wing).alias("valid"))


@query("""select o_custkey as pack_id, count(*) + count(distinct o_orderstatus) as source_count, count(*) >= 3 as shareable, string_agg(o_orderkey::varchar, ',' order by o_orderkey) as ids from orders group by 1""")
def arr_pack_sources(spark, sf_dir):
    """Sources of packs: files and clusters counted together."""
    o = table(spark, sf_dir, "orders")
    ids = F.array_join(F.array_sort(F.collect_list("o_orderkey")).cast("array<string>"), ",")
    return o.groupBy(F.col("o_custkey").alias("pack_id")).agg((F.count("*") + F.countDistinct("o_orderstatus")).alias("source_count"), (F.count("*") >= 3).alias("shareable"), ids.alias("ids"))


@query(f"""with {FILES_SQL} select user_id || '-' || file_id // 10 as pack_id, '### ' || user_id || '-' || file_id // 10 || chr(10) || string_agg(case when summarised then left(extracted_text, 60) else left(extracted_text, 30) end, chr(10) order by file_id) as block from files group by user_id, file_id // 10""")
def ret_pack_text(spark, sf_dir):
    """The text of a pack of ten files: its sources' summaries, or the beginnings of their texts."""
    f = files(spark, sf_dir).withColumn("pack_id", F.concat_ws("-", "user_id", F.floor(F.col("file_id") / 10).cast("string")))
    part = F.when(F.col("summarised"), F.left("extracted_text", F.lit(60))).otherwise(F.left("extracted_text", F.lit(30)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("file_id", part.alias("t")))), lambda x: x["t"])
    return f.groupBy("pack_id").agg(F.concat(F.lit("### "), F.first("pack_id"), F.lit("\n"), F.array_join(parts, "\n")).alias("block"))


@query(f"with {MEMORIES_SQL} select memory_id, case when turn = 1 then 'new title' else title end as title, case when turn % 2 = 0 then left(content, 10) else content end as content, is_pinned or turn = 2 as is_pinned from memories")
def mem_update(spark, sf_dir):
    """Fields that an update brings replace old ones, others stay."""
    new = {"title": F.when(F.col("turn") == 1, "new title"), "content": F.when(F.col("turn") % 2 == 0, F.left("content", F.lit(10))), "is_pinned": F.when(F.col("turn") == 2, F.lit(True))}
    return memories(spark, sf_dir).select("memory_id", *[F.coalesce(v, c).alias(c) for c, v in new.items()])


@query(f"""with {EDGES_SQL}, kept as (select * from edges where source not in ('o1', 'o2', 'o3') and target not in ('o1', 'o2', 'o3')) select (select count(*) from kept) as edges_left, (select count(*) from lineitem where l_orderkey not in (1, 2, 3)) as refs_left""")
def snk_delete_cascade(spark, sf_dir):
    """A file's deletion: its nodes' edges and its references go."""
    gone = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    nodes = gone.select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("node"))
    e = edges(spark, sf_dir)
    kept = e.join(nodes, e["source"] == nodes["node"], "left_anti").join(nodes, F.col("target") == nodes["node"], "left_anti")
    lines = table(spark, sf_dir, "lineitem")
    refs = lines.join(gone, lines["l_orderkey"] == gone["id"], "left_anti")
    return kept.agg(F.count("*").alias("edges_left")).withColumn("refs_left", refs.agg(F.count("*")).scalar())


@query(f"""with {EVENTS_SQL} select user_id, count(*) filter (where action = 'view') as views, count(*) filter (where action = 'click') as clones, max(event_id) filter (where action = 'click') as last_clone from ev group by 1 order by views desc, user_id limit 50""")
def snk_share_counters(spark, sf_dir):
    """Counters of shares as counts of their events, most viewed first."""
    e = events(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("action") == "view").alias("views"), F.count_if(F.col("action") == "click").alias("clones"), F.max(F.when(F.col("action") == "click", F.col("event_id"))).alias("last_clone"))
    return e.orderBy(F.desc("views"), "user_id").limit(50)


@query("""select e.event_id, coalesce(c.c_name, '?') as actor, e.event_type from events e left join customer c on c.c_custkey = e.user_id and c.c_custkey % 4 <> 0""")
def jn_audit_actor(spark, sf_dir):
    """Audit rows with their actor's name, where there is one."""
    e, c = table(spark, sf_dir, "events"), table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0")
    return e.join(c, e["user_id"] == c["c_custkey"], "left").select("event_id", F.coalesce("c_name", F.lit("?")).alias("actor"), "event_type")


@query("""select s.s_suppkey as suggestion, n.n_name as source_label, r.r_name as target_label from supplier s join nation n on n.n_nationkey = s.s_nationkey join region r on r.r_regionkey = n.n_regionkey where s.s_acctbal > 0""")
def jn_suggestion_labels(spark, sf_dir):
    """Suggestions with both ends' labels; without either they go."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    joined = s.where("s_acctbal > 0").join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return joined.select(F.col("s_suppkey").alias("suggestion"), F.col("n_name").alias("source_label"), F.col("r_name").alias("target_label"))


@query("""with n as (select count(*) as total from documents), a as (select count(*) as waiting from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id)) select total, waiting, total - waiting as done, waiting > 50 as truncated from n, a""")
def agg_unprocessed(spark, sf_dir):
    """How many files wait, and whether a list of fifty would be cut."""
    d, s = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    waiting = d.join(s, "doc_id", "left_anti").agg(F.count("*").alias("waiting"))
    return d.agg(F.count("*").alias("total")).withColumn("waiting", waiting.scalar()).select("total", "waiting", (F.col("total") - F.col("waiting")).alias("done"), (F.col("waiting") > 50).alias("truncated"))


@query("""with e as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events) select user_id, event_id, n from e where n <= 3""")
def srt_history(spark, sf_dir):
    """The latest three rows of each user's history."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").withColumn("n", n).where("n <= 3").select("user_id", "event_id", "n")


@query("""select o_orderkey, o_orderstatus = 'F' as revoked from orders order by o_orderstatus = 'F', o_orderdate desc, o_orderkey limit 100""")
def srt_revoked_last(spark, sf_dir):
    """Shares by an expression: revoked ones last, newer ones first."""
    o = table(spark, sf_dir, "orders").withColumn("revoked", F.col("o_orderstatus") == "F")
    return o.orderBy("revoked", F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", "revoked")


@query("""select doc_id, json_valid(j) as valid, case when json_valid(j) then (j->>'$.a')::int end as a from (select doc_id, case doc_id % 3 when 0 then '{"a": ' || doc_id || '}' when 1 then '{"a": 7}' else 'none' end as j from documents)""")
def txt_json_salvage(spark, sf_dir):
    """JSON in answers: fences removed, else the outermost braces taken; what still is none is null."""
    j = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('```json\n{"a": '), F.col("doc_id").cast("string"), F.lit("}\n```"))).when(F.col("doc_id") % 3 == 1, 'Sure: {"a": 7} done').otherwise("none")
    body = F.regexp_extract(j, r"(?s)(\{.*\}|\[.*\])", 1)
    parsed = F.from_json(F.when(body != "", body), "a int")
    return table(spark, sf_dir, "documents").select("doc_id", parsed.isNotNull().alias("valid"), parsed["a"].alias("a"))


@query("""with c as (select vec_id, label from embeddings), b as (select vec_id as node_id from c where vec_id not in (select doc_id from labels)), v as (select distinct label from c where vec_id in (select doc_id from labels))
select (select count(*) from b) as ghost_nodes, (select count(distinct label) from c) - (select count(*) from v) as empty_clusters""")
def grf_orphans(spark, sf_dir):
    """A dry run of the orphan sweep: ghost nodes and clusters left empty."""
    c, f = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "labels").select("doc_id")
    ghosts = c.join(f, c["vec_id"] == f["doc_id"], "left_anti").agg(F.count("*").alias("ghost_nodes"))
    alive = c.join(f, c["vec_id"] == f["doc_id"], "left_semi").select("label").distinct()
    return ghosts.withColumn("empty_clusters", c.select("label").distinct().join(alive, "label", "left_anti").agg(F.count("*")).scalar())


@query()
def src_page_markers(spark, sf_dir):
    """Pages as ingested files: text, status and hash."""
    t = text.html_text_of("html")
    return table(spark, sf_dir, "pages").withColumn("text", t).select("page_id", F.length("text").alias("chars"), text.extraction_status(F.col("text")).alias("status"), text.content_hash(F.col("text")).alias("hash"))
