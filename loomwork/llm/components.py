"""Connected components by alternating star contraction.

Each round is two joins and two grouped minima over the edge table. The minima
combine before the shuffle, and the joins deal the edges of common nodes to all
tasks, so a node with very many edges is never gathered in one; the number of
rounds grows with the logarithm of the largest component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.base import checkpoint, labelled


def _star(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (u, v), `total` at most: every v of u, with the least of u and its v as `low`."""
    low = pairs.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
    return labelled(pairs, low, "u", F.xxhash64("v"), total).withColumn("low", F.least("u", "low"))


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    return edges.select(turned.alias("e")).select("e.u", "e.v")


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v) of longs -> (node, component): the least node reachable, for every node that has an edge.

    Self loops are ignored; null ends are ignored; an empty table gives an empty table.
    """
    edges = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    edges = checkpoint(edges.distinct())
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        large = _star(_both_ways(edges), 2 * before[0]).where(F.col("v") > F.col("u"))
        large = large.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u != v").distinct()
        starred = _star(large, 2 * before[0])
        small = starred.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            starred.select("u", F.col("low").alias("v"))
        )
        edges = checkpoint(small.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
