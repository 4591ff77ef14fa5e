"""Fixed cases of functions whose results are known by hand."""

from datetime import datetime

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.functions import scoring, text
from corpuscle.operators.embedding import shares_text
from corpuscle.operators.graph import neighbourhood, sweep
from corpuscle.operators.service import budget_fold
from corpuscle.operators.vectors import dimensions


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("n", "score"), [(0, 0), (1000, 30), (10000, 40), (10**6, 40)])
def test_importance_of_length(spark, n, score):
    now = F.lit("2025-06-01").cast("timestamp")
    old = F.lit("2020-01-01").cast("timestamp")
    assert value(spark, scoring.importance(F.lit(n), F.lit(0.0), old, now, F.lit(False), F.lit(0))) == score


@pytest.mark.parametrize(("centre", "score"), [(-1.0, 0), (0.5, 15), (1.0, 30), (2.0, 30)])
def test_importance_of_centrality(spark, centre, score):
    now, old = F.lit("2025-06-01").cast("timestamp"), F.lit("2020-01-01").cast("timestamp")
    assert value(spark, scoring.importance(F.lit(0), F.lit(centre), old, now, F.lit(False), F.lit(0))) == score


@pytest.mark.parametrize(("days", "points"), [(7, 15.0), (365, 0.0), (186, 7.5)])
def test_recency(spark, days, points):
    now = F.lit("2025-06-01").cast("timestamp")
    at = now - F.make_dt_interval(F.lit(days))
    assert value(spark, scoring.recency(at, now)) == pytest.approx(points, abs=0.01)


def test_labels(spark):
    assert [value(spark, scoring.importance_label(F.lit(n))) for n in (39, 40, 69, 70)] == ["low", "medium", "medium", "high"]


def test_running_average(spark):
    fold = lambda d: value(spark, scoring.ewma(F.array(*map(F.lit, d)), F.lit(300.0), F.lit(90.0)))
    assert fold([10.0]) == 74.0
    assert fold([10.0, 400.0]) == 119.2
    assert fold([-5.0]) == 90.0


def test_hash_ignores_case_and_space(spark):
    a = "Some words that are long enough to have a hash, all told."
    h = lambda t: value(spark, text.content_hash(F.lit(t)))
    assert h(a) == h(a.upper().replace(" ", " \n\t ")) is not None
    assert h("x" * 49) is None
    assert h("[" + a) is None


def test_chunks():
    assert text.search_chunks(None) == [] == text.search_chunks("")
    assert text.search_chunks(" short ") == [" short "]
    sentences = ["Word " * 30 + "end." for _ in range(8)]
    chunks = text.search_chunks(" ".join(sentences))
    assert all(len(c) <= 500 for c in chunks)
    assert "".join(chunks).replace(" ", "") == "".join(sentences).replace(" ", "")
    assert text.search_chunks("a" * 600 + "\n\n" + "b" * 20) == ["a" * 600, "b" * 20]


def test_a_text_of_exactly_a_chunk_goes_by_sentences():
    """As in SQL, line ends between sentences become blanks from a chunk's length on."""
    for whole in ("a" * 300 + ".\n" + "b" * 198, "a" * 300 + ".\n" + "b" * 197 + " "):
        assert len(whole) == 500 and text.search_chunks(whole) == [whole.replace("\n", " ").strip()]


def test_shares_are_written_as_in_sql(spark):
    vector = [0.00089, 0.00004999, 1.0, 0.235, 0.0, 0.0001, 0.000001]
    row = spark.createDataFrame([(vector,)], "v array<double>").select(shares_text("v").alias("t")).first()
    said = [f"{i:x}:{duckdb.sql(f'select round({v}::double, 5)::varchar').fetchall()[0][0]}" for i, v in enumerate(vector) if v > 0]
    assert row["t"] == " ".join(said)


def test_long_chunks(spark):
    n = lambda k: [len(c) for c in value(spark, text.long_chunks(F.lit("x" * k)))]
    assert n(0) == [0]
    assert n(10000) == [10000]
    assert n(15000) == [15000]
    assert n(25000) == [10000, 10500, 5500]


def test_text_functions(spark):
    v = lambda c: value(spark, c)
    assert v(text.without_markdown(F.lit("# Title\n**bold** and *it* `code` [a](b)\n- item"))) == "Title\nbold and it code a (b)\n• item"
    assert v(text.extension(F.lit("a.b/c.TXT"))) == "txt"
    assert v(text.extension(F.lit("a.b/c"))) == ""
    assert v(text.filename_tokens(F.lit("MyDesign-final_12_2024.psd"))) == ["my", "design", "2024", "psd"]
    assert v(text.error_code(F.lit("Google API: 503"))) == "GEMINI_UNAVAILABLE"
    assert v(text.extraction_status(F.lit("[OCR error: bad]"))) == "ocr_failed"
    assert v(text.extraction_status(F.lit("  "))) == "empty"
    assert v(text.auto_summary(F.lit("# Plan\nnoise\n- do it"))) == "Plan | do it"
    assert v(text.thai_spacing(F.lit("ก ำ a b c d"))) is not None
    assert text.html_text("<p>a<script>x</script></p><p>b &amp; c</p>") == "a\nb & c"


def test_dimensions():
    assert [dimensions(n) for n in (3, 4, 5, 10, 31, 50)] == [None, None, 3, 8, 29, 30]


def test_neighbourhood_leaves_outermost_edges(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("b", "d", 1.0), ("c", "d", 1.0)], "source string, target string, weight double")
    nodes, touched = neighbourhood(e, spark.createDataFrame([("a",)], "node string"), 2)
    assert {r["node"] for r in nodes.collect()} == {"a", "b", "c", "d"}
    assert {(r["source"], r["target"]) for r in touched.collect()} == {("a", "b"), ("b", "c"), ("b", "d")}


def test_sweep_twice_is_sweep_once(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "source string, target string")
    gone = spark.createDataFrame([("b",)], "node string")
    once = sweep(e, gone)
    assert once.count() == 1 == sweep(once, gone).count()


def test_budget_passes_over_what_does_not_fit(spark):
    parts = F.array(*[F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).alias("n")) for i, n in enumerate((60, 50, 30))])
    got = value(spark, budget_fold(parts, 100))
    assert (got["used"], got["taken"]) == (90, [0, 2])


def test_age_is_floored(spark):
    at, now = F.lit(datetime(2024, 1, 1, 12)), F.lit(datetime(2024, 1, 3, 11))
    assert value(spark, scoring.age_days(at, now)) == 1




def test_long_chunks_cut_a_text_once(spark):
    """Functions over arrays have no common subexpressions: a chunk's overlap must not cut the whole text again."""
    plan = spark.createDataFrame([("a",)], "t string").select(text.long_chunks(F.col("t")).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
