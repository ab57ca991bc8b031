"""Online variational LDA whose inference runs on blocks of documents in numpy.

The library infers document by document in hundreds of updates each, whose time goes into a digamma of up to 49 divisions. Here blocks of
documents of like length are inferred at once in far fewer; prior, first topics, learning rate, share of documents and tolerance are the library's.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import clustering
from pyspark.ml.clustering import LDAModel, LocalLDAModel
from pyspark.ml.linalg import DenseMatrix, MatrixUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from loomwork.plans.lineage import folder
from loomwork.plans.shipping import ship

#: Mean change of a document's weights that ends its inference, and the shape of their first draw, as in the library.
TOLERANCE, SHAPE = 1e-3, 100.0
#: Extrapolated steps of a document at most, and how far one may go.
LEAPS, FARTHEST = 200, 64.0
#: Cells (documents x words x topics) of a block, and of a piece of the sums that tasks hand over.
BLOCK, PIECE = 1 << 18, 1 << 14


def exp_digamma(x: np.ndarray) -> np.ndarray:
    """exp(digamma(x)) for x > 0: eight steps up by two fractions, then the asymptotic series."""
    u = x * (x + 7)
    steps = (2 * x + 7) * ((2 * u + 6) / (u * (u + 6)) + (2 * u + 22) / ((u + 10) * (u + 12)))
    y = x + 8
    r = 1 / y
    q = r * r
    return y * np.exp(-r / 2 - q * (1 / 12 - q * (1 / 120 - q * (1 / 252 - q * (1 / 240 - q / 132)))) - steps)


def weights(gamma: np.ndarray) -> np.ndarray:
    """exp(E[log theta]) of each row."""
    return exp_digamma(gamma) / exp_digamma(gamma.sum(axis=1, keepdims=True))


def infer(words: np.ndarray, counts: np.ndarray, gamma: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topic weights of each document of a block, and its counts divided by their norms, where its weights no longer change.

    words: exp(E[log beta]) of the words of each document (documents x words x topics); counts are 0 where a document has fewer words.
    Updates converge slowly, hundreds to a document, so two of them in a row give a longer step along their line (squared extrapolation, by
    document); what ends a document is the change by an update, as ever, and after LEAPS such steps only updates follow.
    """
    theta_of, ratio_of = np.empty_like(gamma), np.empty_like(counts)
    at, running, n, first = np.arange(len(gamma)), np.ones(len(gamma), bool), 0, None
    theta = weights(gamma)
    ratio = counts / (np.matmul(words, theta[:, :, None])[:, :, 0] + 1e-100)
    while len(at):
        last, n = gamma, n + 1
        gamma = theta * np.matmul(ratio[:, None, :], words)[:, 0, :] + alpha
        change = gamma - last
        done = running & ~(np.abs(change).mean(axis=1) > TOLERANCE)
        ahead = gamma
        if n % 2 and n > 1:
            first = last, change
        elif n > 2 and n <= 2 * LEAPS:
            start, step = first
            bend = change - step
            far = np.clip(np.sqrt((step * step).sum(axis=1) / np.maximum((bend * bend).sum(axis=1), 1e-300)), 1, FARTHEST)[:, None]
            ahead = np.where(done[:, None] | (far == 1), gamma, np.maximum(start + 2 * far * step + far * far * bend, alpha))
        gamma = ahead
        theta = weights(gamma)
        ratio = counts / (np.matmul(words, theta[:, :, None])[:, :, 0] + 1e-100)
        if done.any():
            theta_of[at[done]], ratio_of[at[done]] = theta[done], ratio[done]
            running &= ~done
            if running.sum() <= 0.8 * len(at):  # what is done is carried along until it pays to leave it out
                at, words, counts, gamma, theta, ratio = (x[running] for x in (at, words, counts, gamma, theta, ratio))
                first = first and tuple(x[running] for x in first)
                running = np.ones(len(at), bool)
    return theta_of, ratio_of


def blocks(lengths: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Places of documents of like length, about BLOCK cells at once; documents without words are left out."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    end = len(order)
    while end:
        begin = max(0, end - max(1, BLOCK // (int(lengths[order[end - 1]]) * k)))
        yield order[begin:end]
        end = begin


def sums(batches: Iterator[pa.RecordBatch], beta: np.ndarray, alpha: np.ndarray, rate: float, seed: list[int]) -> Iterator[pa.RecordBatch]:
    """What the drawn documents of a partition give to each word and topic, in pieces. A document may be drawn several times."""
    draw = np.random.default_rng([*seed, TaskContext.get().partitionId()])
    k, total, n = len(alpha), np.zeros_like(beta), 0
    for batch in batches:
        lists = batch.column(0)
        ids, counts = lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy()
        lengths = lists.value_lengths().to_numpy()
        starts = np.cumsum(lengths) - lengths
        times = draw.poisson(rate, len(lengths))
        for docs in blocks(np.where(times > 0, lengths, 0), k):
            there = np.arange(lengths[docs].max()) < lengths[docs][:, None]
            cells = np.where(there, starts[docs][:, None] + np.arange(there.shape[1]), 0)
            theta, ratio = infer(beta[ids[cells]], np.where(there, counts[cells], 0.0), draw.gamma(SHAPE, 1 / SHAPE, (len(docs), k)), alpha)
            for i, doc in enumerate(docs):
                m = lengths[doc]
                total[ids[starts[doc] : starts[doc] + m]] += np.multiply.outer(ratio[i, :m] * times[doc], theta[i])
            n += len(docs)
    if n:
        flat = total.reshape(-1)
        places = range(0, len(flat), PIECE)
        yield pa.RecordBatch.from_arrays([pa.array(places, pa.int64()), pa.array([flat[p : p + PIECE].tobytes() for p in places], pa.binary())], ["place", "sums"])


def added(pieces: pa.Table) -> pa.Table:
    """The sum of the pieces of one place."""
    total = sum(np.frombuffer(x.as_py()) for x in pieces["sums"])
    return pa.table({"place": pieces["place"][:1], "sums": pa.array([total.tobytes()], pa.binary())})


def words_of(features: str) -> tuple[Column, Column]:
    """Places and counts of a vector; a dense one has all places."""
    v = F.unwrap_udt(F.col(features))
    places = F.when(v["type"] == 0, v["indices"]).otherwise(F.transform(v["values"], lambda _, i: i))
    return places.alias("places"), v["values"].alias("counts")


class LDA(clustering.LDA):
    """The library's LDA; the online optimizer with a fixed prior runs here."""

    def _fit(self, dataset: DataFrame) -> LDAModel:
        if self.getOptimizer() != "online" or self.getOptimizeDocConcentration():
            return super()._fit(dataset)
        first = super(LDA, self.copy({self.maxIter: 0}))._fit(dataset)  # the library's settings and first topics
        eta = self.getOrDefault("topicConcentration") if self.isSet("topicConcentration") else 1 / self.getK()
        alpha, topics = first.estimatedDocConcentration().toArray(), first.topicsMatrix().toArray()
        n, rate = dataset.count(), self.getSubsamplingRate()
        counts = dataset.select(*words_of(self.getFeaturesCol()))
        ship(dataset.sparkSession)
        context = dataset.sparkSession.sparkContext
        for k in range(1, self.getMaxIter() + 1):
            beta = np.ascontiguousarray(exp_digamma(topics) / exp_digamma(topics.sum(axis=0)))
            sent, seed = context.broadcast(beta), [self.getSeed() & (2**63 - 1), k]
            given = counts.mapInArrow(lambda batches: sums(batches, sent.value, alpha, rate, seed), "place long, sums binary")  # noqa: B023
            pieces = given.groupBy("place").applyInArrow(added, "place long, sums binary").collect()
            sent.destroy()
            if pieces:
                got = np.concatenate([np.frombuffer(r.sums) for r in sorted(pieces, key=lambda r: r.place)]).reshape(topics.shape) * beta
                weight = (self.getLearningOffset() + k) ** -self.getLearningDecay()
                topics = (1 - weight) * topics + weight * (got * (n / np.ceil(rate * n)) + eta)
        return with_topics(dataset, first, topics, self.getMaxIter())


def with_topics(dataset: DataFrame, model: LDAModel, topics: np.ndarray, iterations: int) -> LDAModel:
    """The model with other topics (words x topics), by the form it is saved in."""
    spark = dataset.sparkSession
    path = f"{folder(spark)}/lda-{uuid.uuid4()}"
    model.write().save(f"{path}/first")
    about = json.loads(spark.read.text(f"{path}/first/metadata").first().value)
    about["paramMap"]["maxIter"] = iterations
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/last/metadata")
    matrix = DenseMatrix(*topics.shape, topics.reshape(-1, order="F"))
    rows = spark.read.parquet(f"{path}/first/data")
    held = spark.createDataFrame([(matrix,)], StructType([StructField("topicsMatrix", MatrixUDT(), False)]))
    rows.drop("topicsMatrix").crossJoin(held).select(*rows.columns).coalesce(1).write.parquet(f"{path}/last/data")
    return LocalLDAModel.load(f"{path}/last")
