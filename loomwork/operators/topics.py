"""Topic models: training, inference, description, settings search."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, replace

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDAModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, RegexTokenizer, StopWordsRemover
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators.lda import LDA
from loomwork.plans.config import Config
from loomwork.plans.lineage import cut


@dataclass(frozen=True)
class Parameters:
    k: int
    alpha: float = -1.0
    beta: float = -1.0
    iterations: int = 10


def basic(n: int, config: Config) -> Parameters:
    """k = floor(2 sqrt(floor(n / 2))), 2 where that is 0."""
    return Parameters(int(2 * math.sqrt(n // 2)) or 2, iterations=config.max_iterations)


def manual(n: int, config: Config) -> Parameters:
    return Parameters(config.topics, config.alpha, config.beta, config.max_iterations)


def searched(words: DataFrame, n: int, config: Config, budget: int | None = None) -> Parameters:
    """Seeded search over (k, alpha, beta): the front of least perplexity and least topic overlap, then its knee."""
    source = random.Random(config.seed)
    start = basic(n, config)
    tried = []
    for _ in range(min(budget or config.max_evaluations, config.max_evaluations)):
        k = max(2, round(start.k * source.uniform(0.5, 1.5)))
        p = Parameters(k, source.uniform(0.01, 1.0), source.uniform(0.01, 1.0), config.max_iterations)
        model = train(words, p, config)
        tried.append((model.stages[-1].logPerplexity(model.transform(words)), overlap(model), p))
    front = pareto([(a, b) for a, b, _ in tried])
    low = [min(tried[i][m] for i in front) for m in (0, 1)]
    high = [max(tried[i][m] for i in front) for m in (0, 1)]
    knee = min(front, key=lambda i: sum((tried[i][m] - low[m]) / (high[m] - low[m] or 1) for m in (0, 1)))
    return tried[knee][2]


def pareto(points: list[tuple[float, float]]) -> list[int]:
    """Indices of the points that no other is at least as good as in both and better in one."""
    return [
        i for i, p in enumerate(points)
        if not any(q[0] <= p[0] and q[1] <= p[1] and q != p for q in points)
    ]


def overlap(model: PipelineModel, words: int = 10) -> float:
    """Mean share of words that two topics have in common."""
    tops = [set(r.termIndices) for r in model.stages[-1].describeTopics(words).collect()]
    shared = [len(a & b) / max(len(a), 1) for i, a in enumerate(tops) for b in tops[i + 1 :]]
    return sum(shared) / len(shared) if shared else 0.0


def choose(words: DataFrame, config: Config) -> Parameters:
    """Parameters by the configured optimizer; unknown names mean basic."""
    n = words.count()
    if config.optimizer == "nsga":
        return searched(words, n, config)
    return {"basic": basic, "manual": manual}.get(config.optimizer, basic)(n, config)


def stages(config: Config) -> list:
    """The text side of the pipeline: tokens, stop words, counts."""
    return [
        RegexTokenizer(inputCol="tokens", outputCol="words", pattern="[\\W]+", minTokenLength=X.MIN_TOKEN),
        StopWordsRemover(inputCol="words", outputCol="kept", stopWords=X.stop_words(config.stopwords), caseSensitive=False),
        CountVectorizer(inputCol="kept", outputCol="features", vocabSize=config.vocabulary_size, minDF=1.0),
    ]


def train(corpus: DataFrame, parameters: Parameters, config: Config, subsampling: float = 0.8) -> PipelineModel:
    """Online variational LDA on corpus (tokens).

    The counts of words are taken once and stored: each iteration of the optimizer reads its documents again, and would split all texts anew.
    """
    lda = LDA(
        featuresCol="features", topicDistributionCol="topics", optimizer="online", k=parameters.k, maxIter=parameters.iterations,
        seed=config.seed, subsamplingRate=subsampling, optimizeDocConcentration=False,
    )
    if parameters.alpha > 0:
        lda.setDocConcentration([parameters.alpha])
    if parameters.beta > 0:
        lda.setTopicConcentration(parameters.beta)
    words = Pipeline(stages=stages(config)).fit(corpus)
    counts, tasks = words.transform(corpus.select("tokens")).select("features"), 3 * corpus.sparkSession.sparkContext.defaultParallelism
    if counts.rdd.getNumPartitions() < tasks:  # few files or groups of rows: their counts are dealt to all tasks
        counts = counts.repartition(tasks, F.rand(config.seed))
    counted = cut(counts)
    return PipelineModel(stages=[*words.stages, lda.fit(counted)])


def lda_of(model: PipelineModel) -> LDAModel:
    return model.stages[-1]


def vocabulary_of(model: PipelineModel) -> list[str]:
    return next(s for s in model.stages if isinstance(s, CountVectorizerModel)).vocabulary


def describe(model: PipelineModel, domain: str, words: int = 100, described: int = 10) -> DataFrame:
    """topics: uri, id (the model's own index), description, elements, scores."""
    vocab = F.array(*(F.lit(w) for w in vocabulary_of(model)))  # at most the configured vocabulary size
    rows = lda_of(model).describeTopics(words)
    elements = F.transform("termIndices", lambda i: F.get(vocab, i))
    out = rows.select(
        X.uri("domains", domain, "topics", F.col("topic").cast("string")).alias("uri"), F.col("topic").cast("long").alias("id"),
        elements.alias("elements"), F.col("termWeights").alias("scores"),
    )
    return out.withColumn("description", F.concat_ws(" ", F.slice("elements", 1, described)))


def infer(model: PipelineModel, corpus: DataFrame) -> DataFrame:
    """shapes: id, uri, type, vector of each resource (all zero for a resource without known words)."""
    got = model.transform(corpus.withColumn("tokens", F.coalesce("tokens", F.lit(""))))
    return got.select(
        X.java_hash(F.col("resource")).alias("id"), F.col("resource").alias("uri"), F.lower("type").alias("type"),
        vector_to_array("topics").alias("vector"),
    )


def words_of_topics(topics: DataFrame, words: int) -> DataFrame:
    """All topics with their first words, as a ranking."""
    return topics.select("uri", "id", "description", F.slice("elements", 1, words).alias("elements"), F.slice("scores", 1, words).alias("scores"))


def config_with(config: Config, **changes) -> Config:
    return replace(config, **changes)
