"""Tags of a domain: one score per word over all its topics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import vectors as V


def of_domain(topics: DataFrame) -> DataFrame:
    """Pairwise-mean fold of a word's scores in the order of topic ids. A word's group has one row a topic at most."""
    rows = topics.select("id", F.explode(F.arrays_zip("elements", "scores")).alias("w"))
    groups = rows.select("id", F.col("w.elements").alias("word"), F.col("w.scores").alias("score")).groupBy("word")
    ordered = groups.agg(F.array_sort(F.collect_list(F.struct("id", "score"))).alias("all"))
    return ordered.select("word", V.pairwise_fold(F.transform("all", lambda x: x["score"])).alias("score"))


def top(tags: DataFrame, n: int) -> DataFrame:
    return tags.orderBy(F.desc("score"), "word").limit(n)
