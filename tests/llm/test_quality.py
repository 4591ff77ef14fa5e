"""The byte-level network against plain loops, its gradient against differences, and held-out labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpuscle.llm import quality
from corpuscle.llm.language_id import held_out


@pytest.fixture(scope="module")
def network():
    made = quality.ByteNetwork.start()
    rng = np.random.default_rng(5)
    for name in ("bias", "second_bias", "out_bias"):
        made.weights[name] = rng.normal(size=made.weights[name].shape).astype(np.float32) * 0.1
    return made


def plainly(network, text):
    """The network written out: every position, every chunk."""
    w = network.weights
    raw = (text or "").encode()
    blocks = max(1, -(-len(raw) // quality.BLOCK))
    symbols = list(raw) + [quality.PAD] * (blocks * quality.BLOCK - len(raw) + quality.WIDTH)
    found = [sum(w["embedding"][symbols[i + k]] @ w["filters"][k] for k in range(quality.WIDTH)) for i in range(blocks * quality.BLOCK)]
    starts, covered = [0], set()
    while starts[-1] + quality.SPAN < blocks:
        starts.append(min(starts[-1] + quality.STEP, blocks - quality.SPAN))
    chunks = []
    for s in starts:
        inside = range(s * quality.BLOCK, min(s + quality.SPAN, blocks) * quality.BLOCK)
        covered |= set(inside)
        hidden = np.maximum(np.max([found[i] for i in inside], 0) + w["bias"], 0)
        chunks.append(np.maximum(hidden @ w["second"] + w["second_bias"], 0))
    assert covered == set(range(blocks * quality.BLOCK))  # chunks overlap and cover the whole text
    odds = np.concatenate([np.max(chunks, 0), np.mean(chunks, 0)]) @ w["out"] + w["out_bias"][0] + network.constant
    return 1 / (1 + np.exp(-odds))


def test_scores_equal_plain_loops(network, odd_rows, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 128)  # several pieces a text
    texts = [r[1] for r in odd_rows if r[0] != 30] + ["x" * n for n in (63, 64, 65, 255, 256, 257, 384, 385)] + ["é" * 200, "\0" * 70]
    assert network.score(texts) == pytest.approx([plainly(network, t) for t in texts], abs=1e-5)


def test_scores_do_not_depend_on_the_batch(network, odd_rows):
    texts = [r[1] for r in odd_rows]
    assert network.score(texts) == pytest.approx([network.score([t])[0] for t in texts], abs=1e-6)


def test_gradient_equals_differences(network):
    texts, labels = quality.Texts(["the first", "ab " * 200, "", "something longer than one block, " * 9]), np.array([1.0, 0.0, 1.0, 0.0])

    def loss(weights):
        made = quality.ByteNetwork(weights)
        odds = made.above(texts, made.block_maxima(texts)[texts.members].max(1))[-1].astype(float)
        return np.mean(np.log1p(np.exp(odds)) - labels * odds)

    exact = {k: v.astype(np.float64) for k, v in network.weights.items()}
    found = quality.ByteNetwork(exact).gradient(texts, labels)
    rng = np.random.default_rng(1)
    for name, g in found.items():
        assert g.shape == exact[name].shape
        for flat in {int(np.abs(g).argmax()), *rng.integers(0, g.size, 3).tolist()}:
            at = np.unravel_index(flat, g.shape)
            by = []
            for step in (1e-3, -1e-3):
                moved = {k: v.copy() for k, v in exact.items()}
                moved[name][at] += step
                by.append(loss(moved))
            assert g[at] == pytest.approx((by[0] - by[1]) / 2e-3, rel=0.05, abs=1e-4), name


def test_quality_of_held_out_documents(spark):
    found = quality.op11_quality(spark, "/root/testdata/sf0.01")
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").where("held_out and quality is not null").toPandas()
    good, bad = rows[rows.quality == 1], rows[rows.quality == 0]
    assert np.mean([np.mean(g > bad.score) for g in good.score]) > 0.95  # area under the curve
    assert (good.predicted == 1).mean() > 0.95
    assert ((found.toPandas().score >= 0.7) == (found.toPandas().predicted == 1)).all()


def test_quality_of_odd_documents(spark, odd, none, odd_rows, monkeypatch):
    monkeypatch.setattr(quality, "ROUNDS", 2)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(12)] + [(None, 1, 0), (26, None, 0), (25, 1, 1), (25, 0, 1)], "doc_id long, quality int, toxic int")
    network = quality.train(odd, labels)
    found = quality.scores(odd, network).toPandas()
    assert len(found) == len(odd_rows)
    assert found.score.between(0, 1).all()
    by_id = found.groupby(found.doc_id.fillna(-1)).score.agg(["min", "max"])
    assert (by_id["min"] == by_id["max"]).all()  # repeated rows
    assert by_id.loc[20, "min"] == by_id.loc[21, "min"]  # null and empty
    assert quality.scores(none, network).count() == 0
    again = quality.train(odd.repartition(5), labels)
    assert quality.scores(odd, again).toPandas().sort_values(["doc_id", "score"]).score.to_numpy() == pytest.approx(found.sort_values(["doc_id", "score"]).score.to_numpy(), abs=1e-5)
    for few, want in ((labels.where("quality = 1"), 1.0), (labels.where("quality = 0"), 0.0), (labels.limit(0), 0.0)):
        assert set(quality.scores(odd, quality.train(odd, few)).toPandas().score) == {want}


def test_fold_rows_are_not_learned_from(spark, odd):
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    outside = labels.where(~held_out()).withColumn("quality", F.lit(1)).unionByName(labels.where(held_out()).withColumn("quality", F.lit(0)))
    assert quality.train(odd, outside).weights is None  # one class is left
