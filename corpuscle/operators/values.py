"""Queries of the value functions: texts, JSON arrays, times and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.functions import scoring, text, values
from corpuscle.sources.tables import as_of, events, files, memories, table
from corpuscle.operators.relational import EVENTS_SQL, FILES_SQL, MEMORIES_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Texts

#: A document with headings, made of a text: its first part, then a section of each length given, in characters.
SECTIONS = (3000, 1500, 900, 9000, 400, 16000, 1999, 2000)
_SECTIONED_SQL = "d.text || " + " || ".join(f"chr(10) || '{'#' * (i % 6 + 1)} part {i}' || chr(10) || repeat(left(d.text, 50) || ' ', {n} // 51)" for i, n in enumerate(SECTIONS))


@query(f"""with recursive d as (select doc_id, text from documents where length(text) >= 50 and position('#' in text) = 0),
t as (select doc_id, {_SECTIONED_SQL} as t from d),
p as (select doc_id, list_filter(string_split(regexp_replace(t, '(?m)^(#{{1,6}}\\s)', chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x) <> '') as p from t),
m as (select doc_id, p, 1 as i, []::varchar[] as out_ from p
  union all
  select doc_id, p, case when i < len(p) and length(p[i + 1]) < 2000 and length(p[i]) + length(p[i + 1]) <= 10000 then i + 2 else i + 1 end,
         list_append(out_, case when i < len(p) and length(p[i + 1]) < 2000 and length(p[i]) + length(p[i + 1]) <= 10000 then p[i] || chr(10) || chr(10) || p[i + 1] else p[i] end)
  from m where i <= len(p)),
c as (select doc_id, out_ from m where i > len(p)),
s as (select doc_id, flatten(list_transform(out_, lambda x: case when length(x) <= 15000 then [x] else list_transform(range(0, (length(x) + 9999) // 10000), lambda k: substr(x, (k * 10000 + 1)::bigint, 10000)) end)) as s from c)
select doc_id, len(s) as n_chunks, list_transform(range(1, len(s) + 1), lambda i: length(s[i]) + case when i > 1 then least(500, length(s[i - 1])) else 0 end)::varchar as lengths,
       sha256(array_to_string(list_transform(range(1, len(s) + 1), lambda i: case when i > 1 then right(s[i - 1], 500) else '' end || s[i]), '|')) as digest from s""")
def txt_heading_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of long documents with headings: cut before each, small neighbours merged, long ones sliced, overlaps put before."""
    d = table(spark, sf_dir, "documents").where("length(text) >= 50 and position('#' in text) = 0")
    body = F.col("text")
    for i, n in enumerate(SECTIONS):
        body = F.concat(body, F.lit(f"\n{'#' * (i % 6 + 1)} part {i}\n"), F.repeat(F.concat(F.left("text", F.lit(50)), F.lit(" ")), F.lit(n // 51)))
    chunks = d.select("doc_id", text.long_chunks(body).alias("c"))
    lengths = F.concat(F.lit("["), F.array_join(F.transform("c", lambda x: F.length(x).cast("string")), ", "), F.lit("]"))
    return chunks.select("doc_id", F.size("c").cast("long").alias("n_chunks"), lengths.alias("lengths"), F.sha2(F.array_join("c", "|"), 256).alias("digest"))


@query(f"""with {MEMORIES_SQL}, s as (select memory_id, string_split_regex(regexp_replace(content, '([.!?ฯ])\\s+', '\\1' || chr(1), 'g'), chr(1)) as s from memories)
select memory_id, len(s) as n_sentences, sha256(array_to_string(s, '|')) as digest from s""")
def txt_prose_sentences(spark, sf_dir):
    """Sentences of contents as they stand, for summaries."""
    s = memories(spark, sf_dir).select("memory_id", text.prose_sentences(F.col("content")).alias("s"))
    return s.select("memory_id", F.size("s").cast("long").alias("n_sentences"), F.sha2(F.array_join("s", "|"), 256).alias("digest"))


@query("""with t as (select event_id, case event_id % 5 when 0 then 'S u b s c r i p t i o n  of ' || event_id when 1 then 'a b c and  A 1 B 2' when 2 then 'พ ัน ก ่อน' when 3 then 'one' || chr(9) || ' two   three' else 'plain text ' || event_id end as t from events)
select event_id, case event_id % 5 when 0 then 'Subscription of ' || event_id when 1 then 'abcand A1B2' when 2 then 'พัน ก่อน' when 3 then 'one two three' else t end as repaired from t""")
def txt_spacing(spark, sf_dir):
    """Texts with wrong blanks, repaired."""
    e, n = table(spark, sf_dir, "events"), F.col("event_id").cast("string")
    kind = lambda i: F.col("event_id") % 5 == i
    broken = F.when(kind(0), F.concat(F.lit("S u b s c r i p t i o n  of "), n)).when(kind(1), "a b c and  A 1 B 2").when(kind(2), "พ ัน ก ่อน").when(kind(3), "one\t two   three").otherwise(F.concat(F.lit("plain text "), n))
    return e.select("event_id", text.thai_spacing(broken).alias("repaired"))


@query("""select doc_id, length(t) + (doc_id % 10 = 0)::int >= 50 and (doc_id % 10 = 0 or (length(t) - length(replace(t, ' ', ''))) / length(t) >= 0.25) as needs_cleaning
from (select doc_id, text, case when doc_id % 4 = 1 then array_to_string(string_split(left(text, 400), ''), ' ') else text end as t from documents)""")
def txt_needs_cleaning(spark, sf_dir):
    """Texts that were extracted badly: every tenth has a private character in it, every fourth is spaced out."""
    i = F.col("doc_id")
    spaced = F.when(i % 4 == 1, F.array_join(F.split(F.left("text", F.lit(400)), ""), " ")).otherwise(F.col("text"))
    t = F.when(i % 10 == 0, F.concat(F.left(spaced, F.lit(20)), F.lit(""), F.substring(spaced, F.lit(21), F.length(spaced)))).otherwise(spaced)
    return table(spark, sf_dir, "documents").select("doc_id", text.needs_cleaning(t).alias("needs_cleaning"))


#: Messages and exceptions of failures, one after the other.
FAILURES = (
    ("File is ENCRYPTED", None), ("x", "FileNotFoundError"), ("read timed out", None), ("", "MemoryError"), ("bad byte", "UnicodeDecodeError"), ("HTTP 429", None),
    ("Google says\n503", None), ("google: auth needed", None), ("404 model\nNOT_FOUND", None), ("Permission denied", None), ("x", "ClientError"), ("tesseract missing", None), ("connection reset", None), (None, None),
)
_FAILED_SQL = "(values " + ", ".join(f"({i}, {'null' if m is None else repr(m).replace(chr(92) + 'n', chr(10))}, {'null' if n is None else repr(n)})" for i, (m, n) in enumerate(FAILURES)) + ") f(i, message, name)"


@query(f"""select e.event_id, case when f.i = 0 then 'ENCRYPTED' when name = 'FileNotFoundError' then 'FILE_MISSING' when message = 'read timed out' then 'TIMEOUT' when name = 'MemoryError' then 'OUT_OF_MEMORY'
when name like 'Unicode%' then 'ENCODING' when message = 'HTTP 429' then 'QUOTA_EXCEEDED' when message like 'Google says%' then 'GEMINI_UNAVAILABLE' when message like 'google:%' then 'GEMINI_AUTH' when message like '404%' then 'MODEL_DEPRECATED'
when message ilike 'permission%' then 'PERMISSION_DENIED' when name = 'ClientError' then 'CLIENT_ERROR' when message like 'tess%' then 'OCR_FAIL' when message like 'conn%' then 'NETWORK' else 'UNKNOWN' end as code,
coalesce(message in ('read timed out', 'HTTP 429', 'connection reset') or message like 'Google says%', false) as may_pass from events e join {_FAILED_SQL} on e.event_id % {len(FAILURES)} = f.i""")
def txt_failures(spark, sf_dir):
    """Codes of failures by message and exception, and whether they may pass."""
    rows = spark.createDataFrame([(i, m, n) for i, (m, n) in enumerate(FAILURES)], "i long, message string, name string")
    e = table(spark, sf_dir, "events").withColumn("i", F.col("event_id") % len(FAILURES))
    return e.join(F.broadcast(rows), "i").select("event_id", text.error_code(F.col("message"), F.col("name")).alias("code"), text.may_pass(F.col("message")).alias("may_pass"))


@query("""select event_id, case event_id % 6 when 0 then '{"a":' || event_id || ',"b":[1,2]}' when 1 then '{"a":7}' when 2 then '[1,2]' when 3 then '{"x":{"y":1}}' end as found from events""")
def txt_json_part(spark, sf_dir):
    """The JSON of answers, whatever its schema: fenced, between words, an array, nested, broken or none."""
    n, kind = F.col("event_id").cast("string"), lambda i: F.col("event_id") % 6 == i
    answer = (
        F.when(kind(0), F.concat(F.lit('```json\n{"a":'), n, F.lit(',"b":[1,2]}\n```'))).when(kind(1), 'Sure: {"a":7} done').when(kind(2), "list: [1,2].")
        .when(kind(3), '{"x":{"y":1}}').when(kind(4), '{"a": 1').otherwise("none")
    )
    return table(spark, sf_dir, "events").select("event_id", text.json_part(answer).alias("found"))


@query("""with n as (select event_id, case event_id % 4 when 0 then repeat('ก', 120) || '.pdf' when 1 then repeat('aก', event_id::int % 200) || '.tar.gz' when 2 then repeat('é', 200) else 'short.txt' end as name, event_id || '_' as prefix from events),
p as (select *, case when position('.' in name) > 0 then '.' || regexp_extract(name, '\\.([^.]*)$', 1) else '' end as ext from n),
s as (select *, left(name, length(name) - length(ext)) as stem, 255 - strlen(prefix) - strlen(ext) as room from p)
select event_id, strlen(f) as n_bytes, sha256(f) as digest from (select event_id, prefix || (select coalesce(max(left(stem, k::int)) filter (where strlen(left(stem, k::int)) <= room), '') from range(0, length(stem) + 1) r(k)) || ext as f from s)""")
def txt_fitting_filename(spark, sf_dir):
    """File names whose stem is cut to what a file system takes, between characters."""
    i = F.col("event_id")
    name = F.when(i % 4 == 0, "ก" * 120 + ".pdf").when(i % 4 == 1, F.concat(F.repeat(F.lit("aก"), (i % 200).cast("int")), F.lit(".tar.gz"))).when(i % 4 == 2, "é" * 200).otherwise("short.txt")
    f = text.fitting_filename(name, F.concat(i.cast("string"), F.lit("_")))
    return table(spark, sf_dir, "events").select("event_id", F.octet_length(f).cast("long").alias("n_bytes"), F.sha2(f, 256).alias("digest"))


# JSON arrays


@query("""select event_id, case event_id % 4 when 0 then 2 when 1 then 0 when 2 then 1 else 0 end as n, case event_id % 4 when 0 then 'a,b' when 2 then '1' else '' end as items from events""")
def arr_parse(spark, sf_dir):
    """JSON arrays of strings; what is none is empty."""
    made = F.when(F.col("event_id") % 4 == 0, '["a","b"]').when(F.col("event_id") % 4 == 1, "[broken").when(F.col("event_id") % 4 == 2, "[1]")
    a = values.json_array(made)
    return table(spark, sf_dir, "events").select("event_id", F.size(a).alias("n"), F.array_join(a, ",").alias("items"))


@query("""with w as (select doc_id, string_split(' ' || replace(left(text, 200), chr(10), ' '), ' ') as w from documents)
select doc_id, array_to_string(list_filter(list_transform(w[1:5], lambda x: lower(trim(x))), lambda x: length(x) >= 2), '|') as topics from w""")
def arr_topics(spark, sf_dir):
    """The first five topics of files, normalised."""
    words = F.split(F.concat(F.lit(" "), F.replace(F.left("text", F.lit(200)), F.lit("\n"), F.lit(" "))), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(values.topics(words), "|").alias("topics"))


_PACKED_SQL = "g as (select l_orderkey as pack_id, list(l_partkey order by l_linenumber, l_partkey) as ids from lineitem group by 1)"


def _packed(spark, sf_dir):
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pack_id")).agg(F.transform(parts, lambda x: x["l_partkey"]).alias("ids"))


@query(f"""with {_PACKED_SQL} select pack_id, list_contains(ids, 17) as has, len(list_filter(ids, lambda x: x <> 17)) as rest, len(list_filter(ids, lambda x: x::varchar like '%17%')) > 0 as any_like from g""")
def arr_contains_remove(spark, sf_dir):
    """Membership, removal and search in the arrays of packs."""
    g = _packed(spark, sf_dir)
    return g.select("pack_id", F.array_contains("ids", 17).alias("has"), F.size(values.without(F.col("ids"), F.lit(17))).alias("rest"), values.any_contains(F.col("ids").cast("array<string>"), "17").alias("any_like"))


@query(f"""with {_PACKED_SQL} select pack_id, case when len(ids) > 5 then 'TOO_MANY' when len(list_distinct(ids)) < len(ids) then 'DUPLICATE' when len(list_filter(ids, lambda x: x > 100 or x < 1)) > 0
then array_to_string(list_filter(ids, lambda x: x > 100 or x < 1), ',') end as problem from g""")
def arr_top_five(spark, sf_dir):
    """Why a list of five isn't valid: too many, twice the same, or not known."""
    from corpuscle.operators.records import top_five_problem

    ids = F.col("ids").cast("array<string>")
    return _packed(spark, sf_dir).select("pack_id", top_five_problem(ids, F.transform(F.sequence(F.lit(1), F.lit(100)), lambda x: x.cast("string"))).alias("problem"))


@query(f"""with {FILES_SQL} select file_id, case when sot then '{{"filetype":"' || filetype || '","sot":true,"size":' || length(extracted_text) || '}}' else '{{"filetype":"' || filetype || '","size":' || length(extracted_text) || '}}' end as metadata from files""")
def arr_json_object(spark, sf_dir):
    """Metadata of nodes as JSON objects; what is null stays out."""
    meta = values.json_object(filetype=F.col("filetype"), sot=F.when(F.col("source_of_truth"), F.lit(True)), size=F.length("extracted_text"))
    return files(spark, sf_dir).select("file_id", meta.alias("metadata"))


@query(f"""with {FILES_SQL}, n as (select filetype, extraction_status as s, count(*) as n from files group by all) select filetype, string_agg(s || '=' || n, ',' order by s) as statuses, sum(n)::bigint as total from n group by 1""")
def arr_status_map(spark, sf_dir):
    """Counts of files as a map of statuses by type."""
    counted = files(spark, sf_dir).groupBy("filetype", F.coalesce("extraction_status", F.lit("unknown")).alias("s")).agg(F.count("*").alias("n"))
    mapped = counted.groupBy("filetype").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("m"), F.sum("n").alias("total"))
    shown = F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return mapped.select("filetype", shown.alias("statuses"), "total")


# Times


@query("""select event_id, strftime(ts::timestamp - to_hours(case when event_id % 3 = 1 then 7 else 0 end), '%Y-%m-%d %H:%M:%S') as listed, event_id % 5 = 0 or case when event_id % 3 = 1 then event_id % 2 = 0 and 7 < 6 or 6 > 7 else true end as drifted
from events where event_id % 3 <> 2
union all select event_id, null, event_id % 5 = 0 from events where event_id % 3 = 2""")
def dt_drift(spark, sf_dir):
    """Times of an external listing, as UTC, and whether they are newer than what is cached: six hours before the plain time; every fifth is not known."""
    e, i = events(spark, sf_dir), F.col("event_id")
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss")
    listed = values.rfc3339(F.when(i % 3 == 0, F.concat(stamp, F.lit("Z"))).when(i % 3 == 1, F.concat(stamp, F.lit(".000+07:00"))).otherwise("no time"))
    cached = F.when(i % 5 != 0, F.col("created_at") - F.expr("interval 6 hours"))
    return e.select("event_id", F.date_format(listed, "yyyy-MM-dd HH:mm:ss").alias("listed"), values.drifted(cached, listed).alias("drifted"))


@query("""select event_id, epoch(timestamp '2024-01-30 12:00:00') - epoch(date_trunc('second', ts)) <= 1800 and epoch(timestamp '2024-01-30 12:00:00') - epoch(date_trunc('second', ts)) > -86400 as session_alive, greatest(60, least(3600, event_id * 7 % 5000)) as link_seconds from events""")
def dt_expiry(spark, sf_dir):
    """Sessions of thirty minutes that still live, and how long links do."""
    now = as_of("2024-01-30 12:00:00")
    recent = F.unix_timestamp(now) - F.unix_timestamp("created_at") > -86400
    return events(spark, sf_dir).select("event_id", (values.alive(F.col("created_at"), now, 1800) & recent).alias("session_alive"), values.link_seconds(F.col("event_id") * 7 % 5000).alias("link_seconds"))


# Numbers


@query("""select vec_id, len(embedding) * 4 as n_bytes, len(embedding) as n, round(embedding[1]::double, 6) as first_value, true as same from embeddings""")
def mth_vector_bytes(spark, sf_dir):
    """Vectors as bytes and back."""
    e = table(spark, sf_dir, "embeddings").withColumn("raw", values.vector_bytes("embedding")).withColumn("back", values.bytes_vector("raw"))
    return e.select("vec_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.size("back").cast("long").alias("n"), F.round(F.element_at("back", 1).cast("double"), 6).alias("first_value"), (F.col("back") == F.col("embedding")).alias("same"))


@query(f"""with {EVENTS_SQL} select event_id, least(30, 2 * power(2, k % 7)) as seconds, least(30, 2 * power(2, k % 7)) + round((event_id * 37 % 1000) / 1000.0 * 0.5, 6) as with_jitter, k % 7 < 3 as again from ev where k is not null""")
def mth_backoff(spark, sf_dir):
    """Waiting times of attempts, with a jitter that comes from outside, and whether there is another attempt."""
    e, k = events(spark, sf_dir).where("k is not null"), F.col("k") % 7
    jitter = F.round((F.col("event_id") * 37 % 1000) / 1000.0 * 0.5, 6)
    return e.select("event_id", scoring.backoff_seconds(k).alias("seconds"), (scoring.backoff_seconds(k) + jitter).alias("with_jitter"), (k < 3).alias("again"))


#: Names of personality types that are valid: four letters, each one of two.
TYPE_LETTERS = ("EI", "NS", "FT", "JP")


@query("""with t as (select p_partkey, substr('EIX', (p_partkey % 3 + 1)::bigint, 1) || substr('NS', (p_partkey // 3 % 2 + 1)::bigint, 1) || substr('FT', (p_partkey // 6 % 2 + 1)::bigint, 1) || substr('JPx', (p_partkey // 12 % 3 + 1)::bigint, 1) || case p_partkey % 5 when 0 then '-A' when 1 then '-T' when 2 then '-Q' else '' end as code from part)
select p_partkey, code, regexp_full_match(upper(code), '[EI][NS][FT][JP](-[AT])?') as valid from t""")
def mth_type_code(spark, sf_dir):
    """Type codes: four letters of two choices each, and an identity if one is given."""
    i = F.col("p_partkey")
    pick = lambda letters, by: F.substring(F.lit(letters), (F.floor(i / by) % len(letters) + 1).cast("int"), F.lit(1))
    code = F.concat(pick("EIX", 1), pick("NS", 3), pick("FT", 6), pick("JPx", 12), F.when(i % 5 == 0, "-A").when(i % 5 == 1, "-T").when(i % 5 == 2, "-Q").otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code"), scoring.type_code_valid(code).alias("valid"))


@query(f"""with {FILES_SQL}, s as (select file_id, filename, left(extracted_text, 80) as summary, string_split(lower(left(extracted_text, 40)), ' ')[1:5] as topics, extracted_text, [filetype, user_id] as tags from files),
q as (select *, (case when contains(lower(filename), 'en') then .5 else 0 end) as a, (case when contains(lower(summary), 'en') then .4 else 0 end) as b, (case when len(list_filter(topics, lambda t: contains(t, 'en'))) > 0 then .3 else 0 end) as c,
(case when not contains(lower(summary), 'en') and contains(lower(extracted_text), 'en') then .3 else 0 end) as d, (case when len(list_filter(tags, lambda t: contains(lower(t), 'en'))) > 0 then .2 else 0 end) as e from s)
select file_id, round(least(1, a + b + c + d + e), 3)::double as score from q where a + b + c + d + e > 0""")
def mth_fallback_score(spark, sf_dir):
    """The weighted fallback of a search: names, summaries, topics, bodies where no summary told, tags."""
    f = files(spark, sf_dir)
    topics = F.slice(F.split(F.lower(F.left("extracted_text", F.lit(40))), " "), 1, 5)
    score = scoring.fallback_score("en", F.col("filename"), F.left("extracted_text", F.lit(80)), topics, F.col("extracted_text"), F.array("filetype", "user_id"))
    return f.select("file_id", score.alias("score")).where("score > 0")


@query("""select n::int as n, case when n < 5 then null else least(30, greatest(2, n - 2)) end::int as components, case when n < 5 then null else least(15, n - 1) end::int as neighbours from range(1, 60) r(n)""")
def mth_reduced_dimensions(spark, sf_dir):
    """Components and neighbours of a reduction by the number of vectors; few vectors stay as they are."""
    n = F.col("id").cast("int")
    components, neighbours = scoring.reduced_dimensions(n)
    return spark.range(1, 60).select(n.alias("n"), components.alias("components"), neighbours.alias("neighbours"))
