"""Shapes (topic vectors) and what is read off them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.functions import vectors as V


def of_subdomains(members: DataFrame, shapes: DataFrame) -> DataFrame:
    """members (subdomain, uri) -> a shape per subdomain: the mean of its members' vectors, normalised to 1.

    Partial sums by position are combined before the shuffle, so a large subdomain is never gathered.
    Null and all-zero vectors take no part.
    """
    own = shapes.where(F.col("vector").isNotNull() & (V.total(F.col("vector")) > 0)).select("uri", "vector")
    cells = members.join(own, "uri").select("subdomain", F.posexplode("vector").alias("pos", "x"))
    means = cells.groupBy("subdomain", "pos").agg(F.avg("x").alias("x"))
    whole = means.groupBy("subdomain").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    vector = F.transform("cells", lambda c: c["x"])
    return whole.select(
        F.abs(X.java_hash(F.col("subdomain"))).alias("id"), F.col("subdomain").alias("uri"), F.lit("domain").alias("type"),
        V.normalised(vector).alias("vector"),
    )


def dominant(shapes: DataFrame) -> DataFrame:
    """Adds `topic`: the index of the largest value, the later one among equals; null for null or all-zero vectors."""
    useful = V.total(F.col("vector")) > 0
    return shapes.withColumn("topic", F.when(useful, V.argmax_last(F.col("vector"))))


def of_length(shapes: DataFrame, k: int) -> DataFrame:
    return shapes.where(F.size("vector") == k)


def page(shapes: DataFrame, size: int = 20, after: int | None = None) -> DataFrame:
    """The next `size` shapes by id."""
    rows = shapes if after is None else shapes.where(F.col("id") > after)
    return rows.orderBy("id").limit(size)


def page_of_topic(shapes: DataFrame, topic: int, kind: str, size: int = 20, after: str | None = None) -> DataFrame:
    """The next `size` shapes of a dominant topic and type, by uri."""
    rows = dominant(shapes).where((F.col("topic") == topic) & (F.col("type") == kind))
    return (rows if after is None else rows.where(F.col("uri") > after)).orderBy("uri").limit(size)


def of_uri(shapes: DataFrame, uri: str) -> DataFrame:
    return shapes.where(F.col("uri") == uri)


def upserted(old: DataFrame, new: DataFrame, key: str = "uri") -> DataFrame:
    """Rows of new replace those of old with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)
