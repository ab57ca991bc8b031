"""The long table (resource, topic, score) and the queries on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.config import Criteria


def build(shapes: DataFrame, topics: DataFrame) -> DataFrame:
    """A row per resource and topic; topics are few (the model's k), so they are broadcast."""
    cells = shapes.where(F.col("vector").isNotNull()).select(
        F.col("uri").alias("resource_uri"), F.col("type").alias("resource_type"), F.posexplode("vector").alias("pos", "score")
    )
    names = F.broadcast(topics.select(F.col("id").alias("pos"), F.col("uri").alias("topic_uri")))
    return cells.join(names, "pos").select("resource_uri", "resource_type", "topic_uri", "score")


def relevant_resources(distributions: DataFrame, topic_uri: str, criteria: Criteria = Criteria()) -> DataFrame:
    """The resources of a topic, best first (threshold and types do not apply)."""
    rows = distributions.where(F.col("topic_uri") == topic_uri)
    return rows.orderBy(F.desc("score"), "resource_uri").limit(criteria.max).select("resource_uri", "score")


def topic_mix(shapes: DataFrame, topics: DataFrame, uri: str, criteria: Criteria = Criteria(), words: int = 10) -> DataFrame:
    """The topics of a resource, best first, with their first words."""
    cells = shapes.where(F.col("uri") == uri).select(F.posexplode("vector").alias("id", "score"))
    named = cells.join(F.broadcast(topics.select(F.col("id").cast("int").alias("id"), "uri", "elements")), "id")
    rows = named.orderBy(F.desc("score"), "id").limit(criteria.max)
    return rows.select(F.col("uri").alias("topic_uri"), F.col("id").cast("string").alias("description"), "score", F.slice("elements", 1, words).alias("words"))


def annotations(distributions: DataFrame, topics: DataFrame) -> DataFrame:
    """Words of a resource: the first ceil(10 w + 0.5) words of a topic of weight w, each with its score times w."""
    named = distributions.join(F.broadcast(topics.select(F.col("uri").alias("topic_uri"), "elements", "scores")), "topic_uri")
    n = F.ceil(F.col("score") * 10 + 0.5).cast("int")
    words = F.slice(F.arrays_zip("elements", "scores"), F.lit(1), n)
    rows = named.select("resource_uri", "resource_type", F.col("score").alias("weight"), F.explode(words).alias("w"))
    return rows.select(
        "resource_uri", "resource_type", F.lit("tag").alias("type"), F.col("w.elements").alias("value"), (F.col("w.scores") * F.col("weight")).alias("score")
    )


def tags_of(annotated: DataFrame, uri: str, criteria: Criteria = Criteria()) -> DataFrame:
    """Mean positive score of each word of a resource, best first."""
    rows = annotated.where((F.col("resource_uri") == uri) & (F.col("score") > 0))
    best = rows.groupBy("value").agg(F.avg("score").alias("score"))
    return best.orderBy(F.desc(F.round("score", 9)), "value").limit(criteria.max)
