"""Online variational LDA on blocks of documents."""

import math

import numpy as np
import pytest
from pyspark.ml import clustering
from pyspark.ml.linalg import Vectors

from loomwork.operators import lda, similarity, topics
from loomwork.plans import queries as Q


def digamma(x):
    below = 0.0
    while x < 60:
        below, x = below + 1 / x, x + 1
    return math.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - below


def test_exp_digamma():
    xs = [0.02, 0.05, 0.3, 1.0, 2.5, 7.0, 49.0, 1e3, 1e6]
    assert lda.exp_digamma(np.array(xs)) == pytest.approx([math.exp(digamma(x)) for x in xs], rel=1e-9)


def test_extrapolated_inference(monkeypatch):
    """Documents end where an update no longer changes them, of the same likelihood as by updates alone, after a third of them at most."""
    draw = np.random.default_rng(3)
    k, n, alpha = 5, 40, np.full(5, 0.2)
    topics_ = draw.dirichlet(np.full(300, 20.0), k).T  # much alike, as in the first rounds of a training
    ids = np.array([draw.choice(300, n, replace=False, p=(p := topics_[:, d % k] + topics_[:, (d + 1) % k]) / p.sum()) for d in range(60)])
    counts = draw.integers(1, 4, ids.shape).astype(float)
    counts[::2, 30:] = 0  # shorter documents
    words, begun, plain, found = topics_[ids], draw.gamma(100, 0.01, (60, k)), lda.weights, {}
    for leaps in (0, lda.LEAPS):
        updated = []
        monkeypatch.setattr(lda, "LEAPS", leaps)
        monkeypatch.setattr(lda, "TOLERANCE", 1e-6)
        monkeypatch.setattr(lda, "weights", lambda g, updated=updated: updated.append(len(g)) or plain(g))
        theta, ratio = lda.infer(words, counts, begun, alpha)
        gamma = theta * np.einsum("bn,bnk->bk", ratio, words) + alpha
        again = plain(gamma) * np.einsum("bn,bnk->bk", counts / np.einsum("bnk,bk->bn", words, plain(gamma)), words) + alpha
        assert np.abs(again - gamma).max() < 1e-4 and (ratio[::2, 30:] == 0).all()
        share = gamma / gamma.sum(axis=1, keepdims=True)
        found[leaps] = sum(updated), (counts * np.log(np.einsum("bnk,bk->bn", words, share))).sum()
    (most, before), (least, after) = found.values()
    assert least < most / 3 and after == pytest.approx(before, rel=1e-3)


def test_like_the_library(spark):
    """Topics of the library's quality, over words that no draw may leave out; documents without words count but give nothing."""
    draw = np.random.default_rng(5)
    rows = []
    for d in range(120):
        own = draw.integers(0, 20, 30) + 20 * (d % 3)
        ids, counts = np.unique(own, return_counts=True)
        rows.append((Vectors.sparse(60, ids.tolist() if d % 40 else [], counts.astype(float).tolist() if d % 40 else []),))
    data = spark.createDataFrame(rows, ["features"]).repartition(3).cache()
    kw = {"k": 3, "maxIter": 15, "seed": 1, "optimizer": "online", "subsamplingRate": 0.8, "optimizeDocConcentration": False, "learningOffset": 4.0}
    ours, theirs = lda.LDA(**kw).fit(data), clustering.LDA(**kw).fit(data)
    assert ours.logPerplexity(data) == pytest.approx(theirs.logPerplexity(data), rel=0.05)
    assert ours.estimatedDocConcentration() == theirs.estimatedDocConcentration() and ours.getOrDefault("maxIter") == 15
    assert ours.topicsMatrix().toArray().sum() == pytest.approx(theirs.topicsMatrix().toArray().sum(), rel=0.2)
    again = lda.LDA(**kw).fit(data)
    assert np.allclose(again.topicsMatrix().toArray(), ours.topicsMatrix().toArray())
    assert sorted(sorted({i // 20 for i in r.termIndices}) for r in ours.describeTopics(5).collect()) == [[0], [1], [2]]
    data.unpersist()


def test_counts_of_one_file_go_to_all_tasks(spark, monkeypatch):
    sizes, fit = [], topics.LDA.fit
    monkeypatch.setattr(topics.LDA, "fit", lambda self, data: sizes.append(data.rdd.glom().map(len).collect()) or fit(self, data))
    rows = spark.createDataFrame([(f"words about topic{i % 3} number{i % 5} again",) for i in range(400)], "tokens string").coalesce(1)
    topics.train(rows, topics.Parameters(3, iterations=1), Q.Config())
    assert sum(sizes[0]) == 400 and max(sizes[0]) < 100


def test_free_text_meets_stored_shapes(spark, monkeypatch):
    """Score and threshold both ask for the shapes: inference is not run for each of them."""
    plans, plain = [], similarity.similar_to_vector
    monkeypatch.setattr(similarity, "similar_to_vector", lambda shapes, *rest: plans.append(shapes._jdf.queryExecution().optimizedPlan().toString()) or plain(shapes, *rest))
    assert Q.QUERIES["free_text_similar"](spark, "/root/testdata/sf0.001").count()
    assert len(plans) == 1 and "UDF" not in plans[0]
