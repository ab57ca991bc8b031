"""Paths and ranks over a similarity graph held as two DataFrames.

edges: src, dst, score. Every loop is one join and one grouped minimum a round,
with the lineage cut in the shared checkpoint folder, and stops when nothing
changes; only counts reach the driver.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.functions import vectors as V
from loomwork.operators import paths, similarity
from loomwork.plans.lineage import cut


#: Links of a partition, about.
LINKS = 2_000_000
#: By how much a cost may exceed a bound, since both are rounded.
SPARE = 1e-7


def edges_of(similarities: DataFrame, least: float | None = None) -> DataFrame:
    rows = similarities.select(F.col("resource_uri_1").alias("src"), F.col("resource_uri_2").alias("dst"), "score")
    return rows if least is None else rows.where(F.col("score") > least)


def usable(edges: DataFrame, least: float) -> DataFrame:
    return edges.where(F.col("score") > least)


def vertices_of(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices, and the ends of edges that have none, as ("Missing", "item")."""
    ends = edges.select(F.col("src").alias("uri")).union(edges.select("dst")).distinct()
    missing = ends.join(vertices, "uri", "left_anti").select("uri", F.lit("Missing").alias("name"), F.lit("item").alias("type"))
    return vertices.select("uri", F.col("uri").alias("name"), "type").unionByName(missing)


def bfs(
    edges: DataFrame, starts: list[str], ends: list[str], least: float = 0.0, max_length: int | None = 10, max_results: int | None = 10
) -> DataFrame:
    """All paths of the least number of hops from any start to any end over edges with score > least.

    Returns nodes (array of uris), scores (of the edges; 1.0 for the first node) and hops, ordered by the path.
    max_length bounds the hops, max_results the paths; None is no bound. A start that is an end is a path of one node.
    Vertices are met hop by hop, each once. Then the edges that lead to an end are gathered backwards, and paths are made of these alone,
    so there are never more beginnings of paths than paths.
    """
    spark = edges.sparkSession
    usable = cut(edges.where(F.col("score") > least).select("src", "dst", "score"))
    frontier = met = spark.createDataFrame([(s,) for s in sorted(set(starts))], "uri string")
    n = total = len(set(starts))
    levels = [frontier]
    while (hit := frontier.where(F.col("uri").isin(ends))).isEmpty():
        if not n or len(levels) - 1 == max_length:
            return spark.createDataFrame([], "nodes array<string>, scores array<double>, hops int")
        step = usable.join(paths.sent(frontier, n), F.col("uri") == F.col("src")).select(F.col("dst").alias("uri")).distinct()
        frontier = cut(step.join(paths.sent(met, total), "uri", "left_anti"))
        n = frontier.count()
        met, total = cut(met.union(frontier)), total + n
        levels.append(frontier)
    kept, n, links = hit, len(set(ends)), []
    for level in reversed(levels[:-1]):
        into = usable.join(paths.sent(kept.select(F.col("uri").alias("dst")), n), "dst")
        links.append(cut(into.join(level, F.col("src") == F.col("uri"), "left_semi").select("src", "dst", "score")))
        kept = cut(links[-1].select(F.col("src").alias("uri")).distinct())
        n = kept.count()
    found = kept.select("uri", F.array("uri").alias("nodes"), F.array(F.lit(1.0)).alias("scores"))
    for step in reversed(links):
        found = found.join(step, F.col("uri") == F.col("src")).select(
            F.col("dst").alias("uri"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("scores", F.array("score")).alias("scores")
        )
        if max_results is not None:  # a beginning has a path at least, and paths sort by their beginnings
            found = found.orderBy("nodes", "scores").limit(max_results)
    found = found.select("nodes", "scores", F.lit(len(links)).alias("hops")).orderBy("nodes", "scores")
    return found if max_results is None else found.limit(max_results)


def hops(edges: DataFrame, start: str, end: str, max_hops: int = 1000) -> DataFrame:
    """The number of hops from start to end along the edges; no row where there is no way."""
    spark = edges.sparkSession
    frontier = spark.createDataFrame([(start,)], "uri string")
    met = frontier
    for n in range(max_hops + 1):
        if not frontier.where(F.col("uri") == end).isEmpty():
            return spark.createDataFrame([(start, end, n)], "start string, end string, hops int")
        step = frontier.join(edges.select(F.col("src").alias("uri"), "dst"), "uri").select(F.col("dst").alias("uri")).distinct()
        frontier = cut(step.join(met, "uri", "left_anti"))
        if frontier.isEmpty():
            break
        met = cut(met.union(frontier))
    return spark.createDataFrame([], "start string, end string, hops int")


def shortest(edges: DataFrame, start: str, end: str, weight: str = "score", max_rounds: int = 1000) -> DataFrame:
    """The way of least total weight: nodes, cost; equal costs go to the path that sorts first.

    Weight is the score itself by default, so unlike steps are preferred among those above a threshold;
    "1-score" prefers alike ones. Weights are 0 and more. Filter the edges before, and the length of the path after.
    The edges are stored once; what costs more than the best way known to the end is not gone on with.
    """
    spark = edges.sparkSession
    w = F.col("score") if weight == "score" else 1 - F.col("score")
    usable = cut(edges.select("src", "dst", w.alias("w")))
    label = F.struct(F.col("cost"), F.col("nodes"))
    best = spark.createDataFrame([(start, 0.0, [start])], "uri string, cost double, nodes array<string>")
    frontier, n, total, most = best, 1, 1, 0.0 if start == end else math.inf
    for _ in range(max_rounds):
        step = usable.join(paths.sent(frontier, n), F.col("uri") == F.col("src")).where(F.col("cost") + F.col("w") <= most).select(
            F.col("dst").alias("uri"), (F.col("cost") + F.col("w")).alias("cost"), F.concat("nodes", F.array("dst")).alias("nodes")
        )
        new = step.groupBy("uri").agg(F.min(label).alias("l")).select("uri", "l.cost", "l.nodes")
        old = best.select("uri", F.col("cost").alias("old"), F.col("nodes").alias("old_nodes"))
        better = new.join(paths.sent(old, total), "uri", "left").where(
            F.col("old").isNull() | (F.col("cost") < F.col("old")) | ((F.col("cost") == F.col("old")) & (F.col("nodes") < F.col("old_nodes")))
        )
        frontier = cut(better.select("uri", "cost", "nodes"))
        n, arrived = frontier.agg(F.count("*"), F.min(F.when(F.col("uri") == end, F.col("cost")))).first()
        if not n:
            break
        best = cut(best.join(paths.sent(frontier.select("uri"), n), "uri", "left_anti").unionByName(frontier))
        if arrived is not None:
            most = arrived
            frontier = frontier.where(F.col("cost") <= most)
        total = best.count()
    return best.where(F.col("uri") == end).select("nodes", "cost")


def pagerank(edges: DataFrame, reset: float = 0.01, rounds: int = 20, start: float = 1.0, every: int = 5) -> DataFrame:
    """rank = reset + (1 - reset) * sum of rank / out-degree, not normalised; scores of edges do not matter.

    src and dst may be of any type; numbers are quicker than text. Links and nodes are dealt by vertex, sorted and kept once, in the partitions
    that the ranks of each round come in: a round shuffles nothing but what the links of a partition give to each vertex, then a row a vertex.
    """
    edges = cut(edges.select("src", "dst"))
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, edges.count() // LINKS + 1)
    links = edges.repartition(parts, "src").distinct().sortWithinPartitions("src").persist()
    ends = links.groupBy(F.col("src").alias("uri")).agg(F.count("*").alias("n")).unionByName(links.select(F.col("dst").alias("uri"), F.lit(0).alias("n")).distinct())
    nodes = ends.repartition(parts, "uri").groupBy("uri").agg(F.sum("n").alias("n")).sortWithinPartitions("uri").persist()
    ranks = nodes.select("uri", F.lit(start).alias("rank"), "n")
    for k in range(rounds):
        given = links.join(ranks.select("uri", (F.col("rank") / F.when(F.col("n") > 0, F.col("n"))).alias("share")).hint("merge"), F.col("src") == F.col("uri"))
        got = given.groupBy("dst").agg(F.sum("share").alias("got")).repartition(parts, "dst")
        ranks = nodes.join(got.hint("merge"), F.col("uri") == F.col("dst"), "left").select("uri", (reset + (1 - reset) * F.coalesce("got", F.lit(0.0))).alias("rank"), "n")
        if k % every == every - 1:
            ranks = cut(ranks).repartition(parts, "uri")
    ranks = cut(ranks.select("uri", "rank"))
    links.unpersist()
    nodes.unpersist()
    return ranks


def scored(found: DataFrame, shapes: DataFrame) -> DataFrame:
    """Paths (nodes, ...) with node scores: 1.0, then the similarity of each node with the one before; sums and folds of them."""
    steps = found.select("nodes", F.posexplode("nodes").alias("pos", "uri"))
    vec = shapes.select("uri", "vector")
    named = steps.join(vec, "uri")
    before = named.select("nodes", (F.col("pos") + 1).alias("pos"), F.col("vector").alias("last"))
    pairs = named.join(before, ["nodes", "pos"], "left")
    score = F.when(F.col("pos") == 0, 1.0).otherwise(V.js_similarity(F.col("vector"), F.col("last")))
    each = pairs.select("nodes", F.struct("pos", "uri", score.alias("score")).alias("s")).groupBy("nodes").agg(F.array_sort(F.collect_list("s")).alias("s"))
    scores = F.transform("s", lambda x: x["score"])
    return each.select("nodes", scores.alias("scores"), V.total(scores).alias("acc_score"), V.pairwise_fold(scores).alias("avg_score"), F.size("nodes").alias("length"))


def two_level(
    shapes: DataFrame, members: DataFrame, in_sector: DataFrame, centres: DataFrame, start: str, end: str,
    least: float = 0.5, max_length: int = 10, max_results: int = 10, types: list[str] | None = None, weight: str = "score",
) -> DataFrame:
    """Paths of sectors first, then paths of resources inside the sectors on one of them and between neighbours.

    shapes: uri, type, vector; members: uri, cluster (a resource may be in several); in_sector: similarities with `sector`;
    centres: uri, type, vector, where type is that of the resources whose mean it is, or `centroid` for all of a sector.
    Sector ways are tried in order of weight, `max_results` of them, until one holds paths of resources: the `max_results` best of these
    are returned, by `place`. With `types`, both the centroids of these types alone and the resources between the ends are used.
    """
    spark = shapes.sparkSession
    of = {start: [], end: []}
    for r in members.where(F.col("uri").isin(start, end)).distinct().collect():
        of[r.uri].append(str(r.cluster))
    empty = spark.createDataFrame([], "place int, nodes array<string>, scores array<double>, acc_score double, avg_score double, length int, cost double")
    w = F.col("score") if weight == "score" else 1 - F.col("score")
    nodes = members.select("uri", F.col("cluster").cast("string").alias("sector")).join(shapes, "uri")
    if types:  # both ends of an edge; the ends of the path are asked for whatever their type
        nodes = nodes.where(F.col("type").isin(types) | F.col("uri").isin(start, end))
    known = lambda n: F.col(f"resource_type_{n}").isin(types) | F.col(f"resource_uri_{n}").isin(start, end)
    for way in sector_ways(centres, of[start], of[end], least / 2, max_results, max_length, types, weight):
        sectors_on = list(way.nodes)
        inside = in_sector.where(F.col("sector").cast("string").isin(sectors_on))
        edges = edges_of(inside.where(known(1) & known(2)) if types else inside, least)
        if len(sectors_on) > 1:
            steps = spark.createDataFrame(list(zip(sectors_on[1:], sectors_on)), "sector string, other string")
            edges = edges.unionByName(edges_of(similarity.across(nodes.where(F.col("sector").isin(sectors_on)), steps, least)))
        found = paths.several(edges.select("src", "dst", w.alias("w")), [start], [end], max_results, max_length)
        if not found.isEmpty():
            return scored(found, shapes).join(found, "nodes").select("place", "nodes", "scores", "acc_score", "avg_score", "length", "cost").orderBy("place")
    return empty


def sector_edges(centres: DataFrame, least: float, types: list[str] | None = None) -> DataFrame:
    """Edges of sectors by their centroids of the wanted types (without any: of all resources); of several types the most alike counts."""
    near = similarity.of_centroids(of_types(centres, types)).where(F.col("score") >= least)
    return edges_of(near).groupBy("src", "dst").agg(F.max("score").alias("score"))


def of_types(centres: DataFrame, types: list[str] | None) -> DataFrame:
    return centres.where((F.col("type").isin(types) if types else F.col("type") == "centroid") & F.col("vector").isNotNull()).select("uri", "type", "vector")


def sector_ways(
    centres: DataFrame, starts: list[str], ends: list[str], least: float, most: int = 10, max_length: int = 10, types: list[str] | None = None, weight: str = "score",
) -> Iterator[paths.Path]:
    """What paths.in_order() gives over sector_edges(), one way after the other, without the edges that none of these ways can take.

    The edges of the ends are all made, one row a sector and end. Ways of at most two of them bound the cost of what is asked for: the first
    way alone, then all. Other edges are made only where what they cost with the least that leads to them and from them stays within it.
    """
    if not starts or not ends or most < 1:
        return
    wanted = cut(of_types(centres, types))
    hubs = sorted({*starts, *ends})
    of_hubs = cut(hub_edges(wanted, hubs, least).select("src", "dst", (F.col("score") if weight == "score" else 1 - F.col("score")).alias("w")))
    for asked in sorted({1, most}):
        inner = inner_edges(wanted, of_hubs, starts, ends, least, asked, weight, len(set(types or [""]))) if max_length > 3 else None
        edges = of_hubs if inner is None else of_hubs.unionByName(inner)
        found = 0
        for found, way in enumerate(paths.in_order(edges, starts, ends, asked, max_length), 1):
            if found > 1 or asked == 1:
                yield way
        if not found:
            return


def hub_edges(wanted: DataFrame, hubs: list[str], least: float) -> DataFrame:
    """The edges of sector_edges() that have a hub at one end or both."""
    own = F.broadcast(wanted.where(F.col("uri").isin(hubs)).select(F.col("uri").alias("hub"), "type", F.col("vector").alias("own")))
    score = V.js_similarity(F.col("own"), F.col("vector"))
    near = cut(wanted.join(own, "type").where("uri <> hub").select("hub", "uri", score.alias("score"))).where(F.col("score") >= least)
    both = F.explode(F.array(F.struct(F.col("hub").alias("src"), F.col("uri").alias("dst")), F.struct(F.col("uri").alias("src"), F.col("hub").alias("dst"))))
    return near.select(both.alias("e"), "score").groupBy("e.src", "e.dst").agg(F.max("score").alias("score"))


def inner_edges(wanted: DataFrame, of_hubs: DataFrame, starts: list[str], ends: list[str], least: float, asked: int, weight: str, kinds: int) -> DataFrame | None:
    """Edges (src, dst, w) between other sectors than starts and ends that one of the first `asked` ways may take; None where it is known that there are none."""
    first = of_hubs.where(F.col("src").isin(starts)).select(F.col("src").alias("a"), F.col("dst").alias("uri"), F.col("w").alias("to"))
    last = of_hubs.where(F.col("dst").isin(ends)).select(F.col("src").alias("uri"), F.col("dst").alias("z"), F.col("w").alias("past"))
    leave, arrive = first.agg(F.min("to")).first()[0], last.agg(F.min("past")).first()[0]
    if leave is None or arrive is None:
        return None
    two = first.join(last, "uri").where("a <> z").select((F.col("to") + F.col("past")).alias("to"))
    short = first.where(F.col("uri").isin(ends)).select("to").unionByName(two).orderBy("to").limit(asked).collect()
    short = [0.0] * len({*starts} & {*ends}) + [r.to for r in short]
    limit = sorted(short)[asked - 1] + SPARE if len(short) >= asked else math.inf
    light = max(least, 0.0) if weight == "score" else 0.0
    if leave + light + arrive > limit:
        return None
    known = first.groupBy("uri").agg(F.min("to").alias("to")).join(last.groupBy("uri").agg(F.min("past").alias("past")), "uri", "full")
    rows = wanted.where(~F.col("uri").isin([*starts, *ends])).join(known, "uri", "left")
    rows = rows.withColumn("to", F.least("to", F.lit(leave + light))).withColumn("past", F.least("past", F.lit(arrive + light)))  # by one edge, or by more
    rows = rows.where((F.col("to") + light + arrive <= limit) | (F.col("past") + light + leave <= limit))
    there, back = F.col("to_1") + F.col("past_2"), F.col("to_2") + F.col("past_1")
    near = similarity.squared(rows, "type", ("to", "past"), F.least(there, back) + light <= limit)
    key = ["square", "on"] if kinds < 2 else ["square"]  # of one type, no pair is shuffled
    best = near.groupBy(*key, "resource_uri_1", "resource_uri_2", "to_1", "past_1", "to_2", "past_2").agg(F.max("score").alias("score")).where(F.col("score") >= least)
    w = (F.col("score") if weight == "score" else 1 - F.col("score")).alias("w")
    ways = F.explode(F.array(*(F.struct(F.col(f"resource_uri_{a}").alias("src"), F.col(f"resource_uri_{b}").alias("dst"), c.alias("rest")) for a, b, c in (("1", "2", there), ("2", "1", back)))))
    return best.select(ways.alias("e"), w).where(F.col("e.rest") + F.col("w") <= limit).select("e.src", "e.dst", "w")


def ordered(found: DataFrame) -> DataFrame:
    """Several paths (length, acc_score, nodes): the shorter first, then the one whose scores sum to less, then by nodes."""
    return found.orderBy("length", F.round("acc_score", 9), "nodes")


def between_centroids(centres: DataFrame, start: str, end: str, least: float, max_length: int = 10, max_results: int = 10, types: list[str] | None = None) -> DataFrame:
    """All paths of the least number of hops between two centroids over similarities > least, of the wanted types."""
    near = similarity.of_centroids(centres.where(F.col("type").isin(types)) if types else centres)
    return bfs(edges_of(near, least), [start], [end], least, max_length, max_results)


def joined_edges(edges: list[DataFrame]) -> DataFrame:
    """Set union of the edges of sectors along a path."""
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out.distinct()


def across_joined_sectors(sectored: DataFrame, in_sector: DataFrame, way: list[str], start: str, end: str, least: float) -> DataFrame:
    """The shortest path over the joined edges of sectors that overlap one after the other."""
    joined_sectors([sectored.where(F.col("sector") == s).select("uri") for s in way])
    edges = joined_edges([edges_of(in_sector.where(F.col("sector") == s), least) for s in way])
    return shortest(edges, start, end)


def joined_sectors(nodes: list[DataFrame]) -> DataFrame:
    """Set union of the nodes of sectors along a path; neighbours must share nodes."""
    for a, b in zip(nodes, nodes[1:]):
        if a.select("uri").intersect(b.select("uri")).isEmpty():
            raise ValueError("neighbouring sectors share no node")
    out = nodes[0]
    for n in nodes[1:]:
        out = out.union(n)
    return out.distinct()
