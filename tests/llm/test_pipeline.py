"""The pipeline's stages against what each must do to its own input."""

import duckdb
import pandas as pd
from pyspark.sql import types as T

import corpus_pipeline as pipeline
from corpuscle.llm import bpe, registry, simhash
from corpuscle.llm.tables import BATCH_BYTES, map_slices
from tests.llm.test_operators import linked


def test_stages_in_turn(spark, odd):
    docs, counts = odd, {}
    for name, stage in pipeline.STAGES:
        before = docs.toPandas()
        docs = pipeline.keep(stage(spark, docs, ""), name)
        after = docs.toPandas()
        counts[name] = len(after)
        if name != "bpe":
            assert tuple(docs.columns) == pipeline.COLUMNS
        if name == "language_id":
            assert set(before.doc_id.dropna()) - set(after.doc_id.dropna()) >= {20, 21, 22, 23}
            assert {0, 1, 2, 3, 25, 26} <= set(after.doc_id.dropna())
        if name == "near_dedup":
            fps = [simhash.fingerprint(t) for t in before.text]
            least: dict = {}
            for i, root in zip(before.doc_id, linked(fps), strict=True):
                least[root] = min(least.get(root, i), i) if not pd.isna(i) else least.get(root, i)
            want = sorted(-1 if pd.isna(i) else i for i in least.values())
            assert sorted(-1 if pd.isna(i) else i for i in after.doc_id) == want
            assert 26 not in want and 25 in want
        if name == "suffix_dedup":
            assert len(after) == len(before)
            assert (after.n_chars == after.text.str.len()).all()
            assert after.n_chars.sum() < before.text.str.len().sum()
        if name == "bpe":
            e = bpe.encoder(bpe.vocabulary_path())
            assert sorted(map(list, after.ids)) == sorted(e.whole.encode(t, add_special_tokens=False).ids for t in before.text)
    assert counts["language_id"] >= counts["near_dedup"] == counts["suffix_dedup"]


def test_empty_table_goes_through(spark, none):
    docs = none
    for name, stage in pipeline.STAGES:
        docs = pipeline.keep(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_warc_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{sf}/pages.parquet'")
    columns = "page_id payload_bytes payload_digest record_type refers_to".split()
    rows = lambda df: [tuple(None if pd.isna(v) else str(v).removesuffix(".0") for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None)]
    key = lambda r: [x or "" for x in r]
    got, want = registry.queries()["op6_warc"](spark, sf).toPandas(), con.sql(registry.oracle_sql()["op6_warc"]).df()
    assert sorted(map(key, rows(got))) == sorted(map(key, rows(want)))


def test_near_dedup_goes_by_fingerprints_and_by_sets(spark):
    """Texts 1 and 2 have one SimHash and unlike sets of shingles; 3 and 4 have like sets; 5 is alone."""
    tail = lambda name: " ".join(f"{name}{i}" for i in range(20))
    long = [f"word{i}" for i in range(300)]
    texts = [f"{'w ' * 100}{tail('x')}", f"{'w ' * 100}{tail('y')}", " ".join(long), " ".join([*long[:150], "other", *long[151:]]), tail("z")]
    assert simhash.fingerprint(texts[0]) == simhash.fingerprint(texts[1])
    docs = spark.createDataFrame([(i + 1, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in pipeline.near_dedup_stage(spark, docs, "").collect()) == [1, 3, 5]


def test_texts_reach_python_in_batches_bounded_by_bytes(spark):
    """16 MB of texts were one Arrow batch, of which executor and worker each held copies."""
    docs = spark.createDataFrame([(i, "x" * (1 << 18)) for i in range(64)], "doc_id long, text string").coalesce(1)
    made = map_slices(docs, T.StructType.fromDDL("n_bytes long"), lambda part: {"n_bytes": [part.nbytes] * part.num_rows})
    sizes = [r.n_bytes for r in made.collect()]
    assert len(sizes) == 64 and max(sizes) <= BATCH_BYTES + (1 << 19)


def test_ids_keep_no_strings_of_words():
    e = bpe.ForcedBoundaryBpe(bpe.vocabulary_path())
    text = "Naïve words, words <|endoftext|> and 12 more: Ωmega　ﬁ"
    assert e.ids(text).tolist() == e.encode(text) == e.whole.encode(text, add_special_tokens=False).ids
    assert e.ids(None).tolist() == [] and not e.known and len(e.packed) > 5
