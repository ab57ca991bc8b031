"""Comparison of the topics of domains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import ranking
from loomwork.plans.config import Criteria
from loomwork.plans.shipping import ship


#: Topics of a domain that are broadcast at most.
MOST_BROADCAST = 10_000


def topics(left: DataFrame, right: DataFrame, words: int = 100) -> DataFrame:
    """topics x topics (both bounded by the models' k): rank similarity of their words.

    left, right: domain, uri, elements -> domain_uri, domain_topic_uri, topic_uri, score. The pairs, which the models' k
    bound, are dealt by topic; only the other domain's topics are broadcast, and only up to `MOST_BROADCAST` of them.
    """
    a = left.select(F.col("uri").alias("topic_uri"), F.slice("elements", 1, words).alias("a"))
    b = right.select(F.col("domain").alias("domain_uri"), F.col("uri").alias("domain_topic_uri"), F.slice("elements", 1, words).alias("b"))
    ship(left.sparkSession)
    few = b.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    pairs = a.repartition("topic_uri").crossJoin(F.broadcast(b) if few else b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            score = [ranking.tau_similarity(list(x), list(y)) for x, y in zip(p["a"], p["b"])]
            yield p[["domain_uri", "domain_topic_uri", "topic_uri"]].assign(score=score)

    return pairs.mapInPandas(run, "domain_uri string, domain_topic_uri string, topic_uri string, score double")


def domains(comparisons: DataFrame, wanted: list[str], criteria: Criteria = Criteria()) -> DataFrame:
    """comparisons (domain, domain_uri, ..., score, date): each pair of wanted domains read from the newer one.

    score > threshold, best `max` rows of each pair; domains without comparisons do not count.
    """
    rows = comparisons.where(F.col("domain").isin(wanted))
    dates = rows.groupBy("domain").agg(F.max("date").alias("newest"))
    own = rows.where(F.col("domain_uri").isin(wanted) & (F.col("score") > criteria.threshold)).join(F.broadcast(dates), "domain")
    other = dates.select(F.col("domain").alias("domain_uri"), F.col("newest").alias("other_newest"))
    newer = (F.col("newest") > F.col("other_newest")) | ((F.col("newest") == F.col("other_newest")) & (F.col("domain") < F.col("domain_uri")))
    kept = own.join(F.broadcast(other), "domain_uri").where(newer)
    best = Window.partitionBy("domain", "domain_uri").orderBy(F.desc("score"), "topic_uri", "domain_topic_uri")
    return kept.withColumn("place", F.row_number().over(best)).where(F.col("place") <= criteria.max).select("domain", "domain_uri", "topic_uri", "domain_topic_uri", "score")
