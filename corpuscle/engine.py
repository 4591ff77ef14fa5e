"""One entrance to the operators by tool name, over a folder of tables.

    Engine(spark, "/data", user_id="src1").call("search_knowledge", query="solar", n=5)

Tools return DataFrames, so their results can be filtered, joined and written like any other. With a tenant given, every tool filters each
table by it before anything is computed; without one, all tenants are seen. Tools that change something return the new snapshot of the table
they change, to be written in place of the old one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuscle.functions import scoring, text, values
from corpuscle.operators import admin, graph, records, search
from corpuscle.operators.enrich import map_reduce_summary
from corpuscle.sources import tables


class UnknownTool(KeyError):
    """No tool of that name."""


class Engine:
    def __init__(self, spark: SparkSession, sf_dir: str, user_id: str | None = None, as_of: str = tables.AS_OF):
        self.spark, self.sf_dir, self.user_id, self.as_of = spark, sf_dir, user_id, as_of

    def _own(self, df: DataFrame) -> DataFrame:
        """The tenant's rows."""
        return df if self.user_id is None else df.where(F.col("user_id") == self.user_id)

    def _files(self) -> DataFrame:
        return self._own(tables.files(self.spark, self.sf_dir))

    def _memories(self) -> DataFrame:
        return self._own(tables.memories(self.spark, self.sf_dir))

    def _packs(self) -> DataFrame:
        return self._own(tables.packs(self.spark, self.sf_dir))

    def _edges(self) -> DataFrame:
        return self._own(tables.tenant_edges(self.spark, self.sf_dir))

    def _nodes(self) -> DataFrame:
        """Nodes at an end of the tenant's edges, with the tenant."""
        e = self._edges()
        ends = e.select("user_id", F.col("source").alias("node")).unionByName(e.select("user_id", F.col("target").alias("node"))).distinct()
        return ends.join(tables.nodes(self.spark, self.sf_dir), "node")

    def _members(self) -> DataFrame:
        """user_id, file_id, cluster_id, relevance of the tenant's files."""
        return self._files().select("file_id", "user_id").join(tables.cluster_map(self.spark, self.sf_dir), "file_id")

    def _index(self) -> search.Index:
        """The tenant's part of the stored index."""
        return search.index_of(self.spark, self.sf_dir).of(self._own)

    # Files

    def list_files(self, kind: str = "all", include_deleted: bool = False) -> DataFrame:
        f = self._files()
        f = f if kind == "all" else f.where(F.col("file_kind") == kind)
        f = f if include_deleted else f.where("processing_status <> 'deleted_in_drive'")
        return f.orderBy(F.desc("uploaded_at"), "file_id").drop("extracted_text")

    def get_file_content(self, file_id: int, offset: int = 0, limit: int = 3000) -> DataFrame:
        limit, offset = min(max(limit, 100), 10000), max(offset, 0)
        n = F.length("extracted_text")
        return self._files().where(F.col("file_id") == file_id).select("file_id", "filename", F.substring("extracted_text", offset + 1, limit).alias("content"), n.alias("total_chars"), (n > offset + limit).alias("has_more"))

    def get_file_link(self, file_id: int, seconds: int = 600) -> DataFrame:
        """Until when a link to a file would live: a minute to an hour."""
        until = F.unix_timestamp(tables.as_of(self.as_of)) + values.link_seconds(F.lit(seconds))
        return self._files().where(F.col("file_id") == file_id).select("file_id", "filename", F.timestamp_seconds(until).alias("expires_at"))

    def get_file_summary(self, file_id: int) -> DataFrame:
        return self._files().where(F.col("file_id") == file_id).select("file_id", text.auto_summary(F.col("extracted_text")).alias("summary"))

    def export_file_to_chat(self, file_id: int) -> DataFrame:
        return self._files().where((F.col("file_id") == file_id) & (F.col("file_kind") == "processed")).select("file_id", "filename", F.concat(F.lit("# "), "filename", F.lit("\n\n"), "extracted_text").alias("message"))

    def upload_text(self, file_id: int, filename: str, content: str) -> DataFrame:
        """The files with a new one, whose text is given."""
        old = self._files()
        new = self.spark.createDataFrame([(file_id, filename, content)], "file_id long, filename string, extracted_text string").withColumns({
            "user_id": F.lit(self.user_id), "filetype": text.extension(F.col("filename")), "uploaded_at": tables.as_of(self.as_of), "source_of_truth": F.lit(False), "summarised": F.lit(False),
            "file_kind": F.lit("processed"), "extraction_status": text.extraction_status(F.col("extracted_text")), "processing_status": F.lit("uploaded"),
        })
        return old.unionByName(new.select(old.columns))

    def delete_file(self, file_id: int) -> DataFrame:
        return self._files().where(F.col("file_id") != file_id)

    def reprocess_file(self, file_id: int) -> DataFrame:
        """The files with one queued again, if it is the tenant's."""
        return self._files().withColumn("processing_status", F.when(F.col("file_id") == file_id, "queued").otherwise(F.col("processing_status")))

    def update_file_tags(self, file_id: int, tags: list[str]) -> DataFrame:
        """file_id, tags: normalised, of the tenant's file."""
        return self._files().where(F.col("file_id") == file_id).select("file_id", values.topics(F.array(*[F.lit(t) for t in tags]), len(tags)).alias("tags"))

    def enrich_metadata(self) -> DataFrame:
        f = self._files().where("processing_status <> 'deleted_in_drive'")
        return f.select("file_id", F.when(F.col("source_of_truth"), "trusted").otherwise("plain").alias("trust"), scoring.freshness(F.col("uploaded_at"), tables.as_of(self.as_of)).alias("freshness"))

    def find_duplicates(self, threshold: float = 0.8) -> DataFrame:
        return search.semantic_duplicates(self._files(), threshold)

    # Collections and packs

    def list_collections(self) -> DataFrame:
        return admin.collections(self._members().withColumn("cluster_id", F.col("cluster_id").cast("long")), self._packs())

    def list_context_packs(self) -> DataFrame:
        return self._packs().select("pack_id", "title", "is_locked", (F.size(values.json_array(F.col("source_file_ids"))) + F.size(values.json_array(F.col("source_cluster_ids")))).alias("source_count"))

    def get_context_pack(self, pack_id: int) -> DataFrame:
        return self._packs().where(F.col("pack_id") == pack_id)

    def create_context_pack(self, title: str, file_ids: list[int]) -> DataFrame:
        """The text of a pack of the tenant's files: each one's summary, or else the first 3,000 characters."""
        f = self._files().where(F.col("file_id").isin(file_ids))
        part = F.when(F.col("summarised"), text.auto_summary(F.col("extracted_text"))).otherwise(F.left("extracted_text", F.lit(3000)))
        parts = F.transform(F.array_sort(F.collect_list(F.struct("file_id", part.alias("t")))), lambda x: x["t"])
        return f.groupBy().agg(F.lit(title).alias("title"), F.sort_array(F.collect_list("file_id")).alias("file_ids"), F.array_join(parts, "\n\n").alias("block"))

    def delete_pack(self, pack_id: int) -> DataFrame:
        return self._packs().where(F.col("pack_id") != pack_id)

    def build_context(self, budget: int = 12000) -> DataFrame:
        from corpuscle.operators import service

        return service.budget_pack(self._files(), budget)

    # Search and graph

    def search_knowledge(self, query: str, n: int = 8) -> DataFrame:
        """Hits, or else the fallback; with packs and nodes by name."""
        return search.knowledge(self._index(), self._files(), self._packs(), self._nodes(), query, n)

    def explore_graph(self, node: str | None = None, depth: int = 1) -> DataFrame:
        """Nodes by family with its size; or the neighbourhood of a node, with labels."""
        if node is None:
            n = self._nodes().withColumn("family", F.coalesce("family", F.lit("other"))).select("family", "node", "label").distinct()
            return n.join(n.groupBy("family").agg(F.count("*").alias("members")), "family")
        start = self.spark.createDataFrame([(node,)], "node string")
        found = graph.neighbourhood(self._edges().drop("user_id"), start, depth)[0]
        return found.join(self._nodes().select("node", "label").distinct(), "node").select("node", "hop", "label")

    def build_graph(self) -> DataFrame:
        """Nodes of the tenant's files, clusters, packs, tags and entities, with their importance."""
        f, clusters = self._files(), self._members().select("cluster_id").distinct()
        own = f.select("file_id").join(tables.tags(self.spark, self.sf_dir), "file_id")
        return graph.build_nodes(f, clusters, own, own.agg(F.countDistinct("file_id").alias("total")), self._packs(), graph.named_entities(f), graph.file_insights(f, tables.as_of()))

    def run_organize(self) -> DataFrame:
        """Summaries of the files that have none, with the deterministic summary for a model."""
        waiting = self._files().where("not summarised and extracted_text <> '' and file_kind = 'processed' and extraction_status = 'ok'")
        return map_reduce_summary(waiting, text.auto_summary)

    def get_overview(self) -> DataFrame:
        one = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
        pending = self._own(tables.suggestions(self.spark, self.sf_dir)).where("status = 'pending'")
        tokens = self._own(tables.tokens(self.spark, self.sf_dir)).where("revoked_at is null")
        rows = one(self._files(), "files")
        for df, what in ((self._packs(), "packs"), (self._nodes(), "nodes"), (self._edges(), "edges"), (self._memories(), "contexts"), (pending, "suggestions"), (tokens, "tokens"), (self._members().select("cluster_id").distinct(), "clusters")):
            rows = rows.unionByName(one(df, what))
        return rows

    # Memories and profile

    def list_contexts(self, search: str = "") -> DataFrame:
        m = self._memories()
        return m.where(F.col("title").ilike(f"%{search}%") | F.col("content").ilike(f"%{search}%")).orderBy(F.desc("updated_at"), "memory_id")

    def auto_context(self, words: str, limit: int = 5) -> DataFrame:
        return self.list_contexts(words).limit(min(limit, 10))

    def load_context(self, n: int = 5) -> DataFrame:
        """The newest memories of each tenant and all pinned ones, which come first."""
        k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "memory_id"))
        return self._memories().withColumn("k", k).where((F.col("k") <= n) | F.col("is_pinned")).orderBy(F.desc("is_pinned"), "k", "memory_id").drop("k")

    def save_context(self, memory_id: str, title: str, content: str) -> DataFrame:
        """The memories with one more; where the tenant has an active one of this title from the last two hours, it takes the content in."""
        m, now = self._memories(), tables.as_of(self.as_of)
        recent = (F.col("title") == title) & (F.unix_timestamp(now) - F.unix_timestamp("updated_at")).between(0, 7200)
        target = m.where(recent).agg(F.max_by("memory_id", "updated_at").alias("target_id"))
        joined = m.join(target, m["memory_id"] == target["target_id"], "left")
        hit = F.col("target_id").isNotNull()
        merged = joined.withColumns({"content": F.when(hit, F.concat_ws("\n\n", "content", F.lit(content))).otherwise(F.col("content")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(m.columns)
        new = target.where("target_id is null").select(F.lit(memory_id).alias("memory_id"), F.lit(title).alias("title"), F.lit(self.user_id).alias("user_id"), F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("tool").alias("platform"), F.lit(content).alias("content"), now.alias("updated_at"), F.lit(False).alias("is_pinned"))
        return merged.unionByName(new)

    def update_context(self, memory_id: str, title: str | None = None, content: str | None = None) -> DataFrame:
        at = F.col("memory_id") == memory_id
        return self._memories().withColumns({c: F.when(at & F.lit(v is not None), F.lit(v)).otherwise(F.col(c)) for c, v in (("title", title), ("content", content))})

    def delete_context(self, memory_id: str) -> DataFrame:
        return self._memories().where(F.col("memory_id") != memory_id)

    def add_note(self, node: str, label: str) -> DataFrame:
        """The tenant's nodes with a note; one of that name gets the new label."""
        n = self._nodes().select("user_id", "node", "object_type", "family", "label")
        note = self.spark.createDataFrame([(self.user_id, node, "note", "note", label)], "user_id string, node string, object_type string, family string, label string")
        return n.where(F.col("node") != node).unionByName(note)

    def get_profile(self) -> DataFrame:
        p = tables.profiles(self.spark, self.sf_dir).withColumn("user_id", F.concat(F.lit("src"), F.col("user_id").cast("string")))
        return self._own(p)

    def update_profile(self, **fields: str) -> DataFrame:
        """The profile with the fields that are given; a type code that is none is an error of that row: it stays as it was."""
        p = self.get_profile()
        new = {c: F.lit(v) for c, v in fields.items() if c in ("identity", "goals", "background", "type_code", "enneagram")}
        if "type_code" in new:
            new["type_code"] = F.when(scoring.type_code_valid(new["type_code"]), new["type_code"]).otherwise(F.col("type_code"))
        return p.withColumns(new) if new else p

    def detect_intent(self, messages: DataFrame, column: str = "text") -> DataFrame:
        return messages.withColumn("intent", records.intent(F.col(column)))

    def list_suggestions(self) -> DataFrame:
        return self._own(tables.suggestions(self.spark, self.sf_dir)).where("status = 'pending'")

    def tools(self) -> dict[str, Callable[..., DataFrame]]:
        return {n: getattr(self, n) for n in vars(type(self)) if not n.startswith("_") and n not in ("call", "tools")}

    def call(self, tool: str, **params) -> DataFrame:
        if tool not in self.tools():
            raise UnknownTool(tool)
        return self.tools()[tool](**params)


def register_functions(spark: SparkSession) -> None:
    """The text functions that SQL users need, by name."""
    spark.udf.register("search_chunks", text.search_chunks_of)
    spark.udf.register("html_text", text.html_text_of)
