"""The training-data pipeline: stages that each read what the one before wrote.

1. language_id: documents without a letter, or without a language that is likelier than all others together, go.
2. near_dedup: of each component of near copies, one document stays: of those with the component's smallest doc_id, nulls last, the first by text hash.
   Components are those of op10's SimHash fingerprints; among what these leave, those of a Jaccard similarity of five-word shingles of 0.8 or more.
3. suffix_dedup: passages of over 50 words that occur elsewhere too are cut, wherever they stand; documents stay.
4. mixing: documents are repeated, cut or left out until sources have their target weights.
5. bpe: the texts as token ids.

All stages but the last return the columns of documents, with n_chars brought up to date. Nulls, ties, repeated rows and empty tables behave
as each operator's docstring says; columns beyond those of documents are not carried on.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corpuscle.llm import bpe, language_id, mixing, near_copies, simhash, suffix_dedup
from corpuscle.llm.tables import keep, map_slices, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least share of the best language.
LEAST_SCORE = 0.5


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language. The model is learned from the stage's own input, outside the held-out fold."""
    docs = docs.select(*COLUMNS)
    model = spark.sparkContext.broadcast(language_id.train(docs))

    text = COLUMNS.index("text")

    def accepted(rows: pa.RecordBatch) -> pa.RecordBatch:
        found = model.value.score(rows.column(text).to_pylist())
        return rows.filter(pa.array([lang != language_id.UND and score >= LEAST_SCORE for lang, score in found], pa.bool_()))

    return map_slices(docs, docs.schema, accepted)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component: that of the smallest doc_id, nulls last, then of the smallest text hash. Of repeated rows the first stays.

    What stays is decided on ids and text hashes; only then are the texts read."""
    key = ["_unnamed", "_id", "_hash"]  # of the join and of the window, so that texts move once
    docs = docs.select(*COLUMNS, F.col("doc_id").isNull().alias("_unnamed"), F.coalesce("doc_id", F.lit(0)).cast("long").alias("_id"), F.xxhash64("text").alias("_hash"))
    rank = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    kept = docs
    for near in (simhash.near_copies, near_copies.near_copies):
        with scratch(spark):
            names = near(kept).groupBy("root").agg(F.min(rank).alias("least"))
            names = names.select(F.col("least.unnamed").alias("_unnamed"), F.coalesce("least.doc_id", F.lit(0)).alias("_id"), F.col("least.text_hash").alias("_hash"))
            names = keep(names, "names", outer=True)
        kept = docs.join(names, key, "left_semi")
    # Rows of one id and text: the first stays. Elsewhere windows hold one row.
    order = Window.partitionBy(*key).orderBy("text", "source", "lang", "n_chars")
    return kept.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of over 50 words that occur elsewhere. The rule counts words and not bytes, as op7's contract does: such
    passages begin at some 250 bytes."""
    return _sized(suffix_dedup.deduplicated(docs.select(*COLUMNS), suffix_dedup.PASSAGES))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each time that words of a document are taken."""
    return _sized(mixing.mixed_texts(docs.select(*COLUMNS)))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and the ids of the text, with their number."""
    path = bpe.vocabulary_path()

    def encoded(rows: pa.RecordBatch) -> dict:
        ids = [bpe.encoder(path).ids(t) for t in rows.column(3).to_pylist()]
        return {"doc_id": rows.column(0), "source": rows.column(1), "lang": rows.column(2), "ids": ids, "n_tokens": [len(x) for x in ids]}

    kept = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "source", "lang", "text")
    return map_slices(kept, T.StructType.fromDDL("doc_id long, source string, lang string, ids array<int>, n_tokens long"), encoded)


STAGES = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL has no tokenizer and no forward algorithm: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
