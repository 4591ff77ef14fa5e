"""Entity tables of a document service, made of the fixture tables.

Every function takes (spark, folder of Parquet tables). Columns that no fixture has are derived, so that each row is reproducible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The point in time that "now" stands for: a parameter, never the clock.
AS_OF = "2024-02-01 00:00:00"


def as_of(value: str = AS_OF):
    return F.lit(value).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, user_id, filename, filetype, uploaded_at, extracted_text, source_of_truth, summarised, status columns."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = docs.join(labels.select("doc_id", "quality"), "doc_id", "left")
    return joined.select(
        F.col("doc_id").alias("file_id"),
        F.col("source").alias("user_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), "lang").alias("filename"),
        F.col("lang").alias("filetype"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("doc_id").cast("int"))).alias("uploaded_at"),
        F.col("text").alias("extracted_text"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("source_of_truth"),
        F.col("quality").isNotNull().alias("summarised"),
        F.when(F.col("doc_id") % 7 == 0, "vault_only").otherwise("processed").alias("file_kind"),
        F.when(F.length("text") < 50, "empty").when(F.col("doc_id") % 11 == 0, "ocr_failed").otherwise("ok").alias("extraction_status"),
        F.when(F.col("doc_id") % 13 == 0, "deleted_in_drive").when(F.col("quality").isNotNull(), "ready").otherwise("uploaded").alias("processing_status"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, created_at, user_id, action, value, k."""
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("created_at"), "user_id", F.col("event_type").alias("action"), "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context memories, made of conversation turns: updated 45 minutes apart, the third of each conversation 3 hours later."""
    turns = table(spark, sf_dir, "conversations")
    minutes = F.col("turn") * 45 + F.when(F.col("turn") >= 3, 180).otherwise(0)
    return turns.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("memory_id"),
        F.concat(F.lit("topic "), (F.col("conv_id") % 25).cast("string")).alias("title"),
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("user_id"),
        "conv_id",
        "turn",
        F.col("role").alias("platform"),
        F.col("text").alias("content"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("conv_id").cast("int"), F.lit(0), minutes.cast("int"))).alias("updated_at"),
        ((F.col("conv_id") + F.col("turn")) % 10 == 0).alias("is_pinned"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, made of customers: subscription by market segment, period end by key."""
    status = F.create_map(*[F.lit(x) for pair in (("BUILDING", "free"), ("AUTOMOBILE", "starter_active"), ("MACHINERY", "starter_past_due"), ("HOUSEHOLD", "starter_canceled")) for x in pair])
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"),
        F.concat(F.lower(F.regexp_replace("c_name", "[^A-Za-z0-9]", ".")), F.lit("@example.org")).alias("email"),
        (F.col("c_custkey") % 97 == 0).alias("is_admin"),
        (F.col("c_custkey") % 10 != 3).alias("is_active"),
        F.coalesce(F.try_element_at(status, F.col("c_mktsegment")), F.lit("free")).alias("subscription_status"),
        F.when(F.col("c_custkey") % 2 == 0, F.lit("2024-03-01").cast("timestamp")).otherwise(F.lit("2024-01-15").cast("timestamp")).alias("current_period_end"),
        (F.lit("2024-02-01").cast("timestamp") - F.make_dt_interval((F.col("c_custkey") % 60).cast("int"))).alias("created_at"),
        F.col("c_acctbal").alias("balance"),
    )


def cluster_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, cluster_id, relevance of the vectors' files."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("label").alias("cluster_id"), F.round(F.abs(F.element_at("embedding", 1)), 6).alias("relevance"))


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, tag: part types of the parts of an order, distinct."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("file_id"), F.concat_ws(" ", "p_brand", "p_type").alias("tag")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, target, edge_type, weight: orders contain parts, and parts come from suppliers."""
    lines = table(spark, sf_dir, "lineitem")
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    contains = lines.groupBy(node("o", "l_orderkey").alias("source"), node("p", "l_partkey").alias("target")).agg(F.round(F.max("l_quantity") / 50, 6).alias("weight")).select("source", "target", F.lit("contains").alias("edge_type"), "weight")
    derived = lines.select(node("p", "l_partkey").alias("source"), node("s", "l_suppkey").alias("target")).distinct().select("source", "target", F.lit("derived_from").alias("edge_type"), F.lit(0.9).alias("weight"))
    return contains.unionByName(derived)


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack_id, user_id, title, source_file_ids and source_cluster_ids (JSON arrays as texts), is_locked: packs of orders, their parts as files."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    ids = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("l_partkey")).cast("array<string>"), ","), F.lit("]"))
    sources = lines.groupBy("l_orderkey").agg(ids.alias("source_file_ids"))
    return orders.join(sources, orders["o_orderkey"] == sources["l_orderkey"]).select(
        F.col("o_orderkey").alias("pack_id"),
        F.concat(F.lit("src"), (F.col("o_orderkey") % 20).cast("string")).alias("user_id"),
        F.concat(F.lit("pack "), F.col("o_orderkey").cast("string")).alias("title"),
        "source_file_ids",
        F.concat(F.lit("["), (F.col("o_custkey") % 12).cast("string"), F.lit("]")).alias("source_cluster_ids"),
        (F.col("o_orderkey") % 9 == 0).alias("is_locked"),
    )


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chat_id, user_id, question, selected_file_ids: the first turns of conversations."""
    c, id_ = table(spark, sf_dir, "conversations").where("turn = 0"), F.col("conv_id")
    ids = F.concat(F.lit("["), (id_ * 3 % 1500).cast("string"), F.lit(","), (id_ * 7 % 1500).cast("string"), F.lit("]"))
    return c.select(id_.alias("chat_id"), F.concat(F.lit("src"), (id_ % 20).cast("string")).alias("user_id"), F.col("text").alias("question"), ids.alias("selected_file_ids"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, object_type, family, label: the ends of ``edges``; every fifth part has no family."""
    e = edges(spark, sf_dir)
    ends = e.select(F.col("source").alias("node")).unionByName(e.select(F.col("target").alias("node"))).distinct()
    kind = F.left("node", F.lit(1))
    key = F.substring("node", 2, 20)
    return ends.select(
        "node",
        F.when(kind == "o", "source_file").when(kind == "p", "entity").otherwise("project").alias("object_type"),
        F.when(kind == "o", "file").when((kind == "p") & (key.cast("long") % 5 != 0), "entity").when(kind == "s", "project").alias("family"),
        F.concat(F.when(kind == "o", "order ").when(kind == "p", "part ").otherwise("supplier "), key).alias("label"),
    )


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """suggestion_id, user_id, source, target, status: suggested relations, one an event."""
    e, id_ = table(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        id_.alias("suggestion_id"),
        F.concat(F.lit("src"), (id_ % 20).cast("string")).alias("user_id"),
        F.concat(F.lit("o"), (id_ % 700).cast("string")).alias("source"),
        F.concat(F.lit("p"), (id_ * 7 % 900).cast("string")).alias("target"),
        F.when(F.col("event_type").isin("view", "click"), "pending").when(F.col("event_type") == "purchase", "accepted").otherwise("dismissed").alias("status"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_id, user_id, token_hash, revoked_at: access tokens, of which hashes alone are kept."""
    c, id_ = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        id_.alias("token_id"),
        F.concat(F.lit("src"), (id_ % 20).cast("string")).alias("user_id"),
        F.sha2(F.concat(F.lit("token "), id_.cast("string")), 256).alias("token_hash"),
        F.when(id_ % 7 == 0, F.lit("2024-01-20").cast("timestamp")).alias("revoked_at"),
    )


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id and seven fields, any of which may be empty."""
    c, id_ = table(spark, sf_dir, "customer"), F.col("c_custkey")
    return c.select(
        id_.alias("user_id"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_name")).alias("identity"),
        F.when(id_ % 4 == 0, "learn").when(id_ % 4 == 1, "").alias("goals"),
        F.lit(None).cast("string").alias("background"),
        F.when(id_ % 6 == 0, "INTJ").alias("type_code"),
        F.when(id_ % 10 == 0, "5w4").alias("enneagram"),
        F.when(id_ % 11 == 0, F.array(F.lit("Focus"))).otherwise(F.array().cast("array<string>")).alias("strengths"),
        F.when(id_ % 13 == 0, F.array(F.lit("Hope"))).alias("virtues"),
    )


def tenant_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, source, target, edge_type, weight: ``edges`` by the tenant of the order they come from."""
    lines = table(spark, sf_dir, "lineitem")
    user = F.concat(F.lit("src"), (F.col("l_orderkey") % 20).cast("string")).alias("user_id")
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    contains = lines.groupBy(user, node("o", "l_orderkey").alias("source"), node("p", "l_partkey").alias("target")).agg(F.round(F.max("l_quantity") / 50, 6).alias("weight"))
    derived = lines.select(user, node("p", "l_partkey").alias("source"), node("s", "l_suppkey").alias("target")).distinct()
    kind = lambda df, name, weight: df.select("user_id", "source", "target", F.lit(name).alias("edge_type"), weight.alias("weight"))
    return kind(contains, "contains", F.col("weight")).unionByName(kind(derived, "derived_from", F.lit(0.9)))
