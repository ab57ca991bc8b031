"""Several loopless paths of least weight, in order.

Every path found is the best of a set of paths: those with a given beginning (its
root) that do not go on to some given nodes. Without the path itself, the set falls
into one set for each node where another way can leave it (a spur), and these sets
share no path. So the sets of many paths are searched together, as one frontier
keyed by (set, vertex) with one label each: a round is one join and one grouped minimum over
the edges, whatever their number. Of a large graph only the edges near both ends are
searched (`near`), and few vertices are broadcast to the edges, so that these are not
shuffled. The least weight that is left from each vertex to
the end is known before; it leaves out vertices that cannot reach the end, and labels
that cannot come below the last path that is still wanted. What reaches the driver
are paths: at most as many as are asked for, times their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.lineage import cut

#: Names of the ends that join several starts and several ends; no uri is like them.
FIRST, LAST = "\0first", "\0last"
#: Digits of the weights of paths: sums in another order are the same to so many.
DIGITS = 9
#: Vertices that are broadcast to the edges at most; more meet them in a shuffle.
FEW = 200_000


class Path(NamedTuple):
    """Order: weight, length, nodes. costs: the weight up to each node."""

    cost: float
    length: int
    nodes: tuple[str, ...]
    costs: tuple[float, ...]


def sent(vertices: DataFrame, n: int) -> DataFrame:
    """The `n` rows of vertices, ready to be joined with edges."""
    return F.broadcast(vertices) if n <= FEW else vertices


def within(edges: DataFrame, seeds: list[str], hops: int, src: str = "src", dst: str = "dst") -> tuple[DataFrame, int]:
    """uri of the vertices at most so many hops from a seed, and their number."""
    met = frontier = edges.sparkSession.createDataFrame([(s,) for s in sorted(set(seeds))], "uri string")
    total = n = len(set(seeds))
    for _ in range(hops):
        step = edges.join(sent(frontier, n), F.col("uri") == F.col(src)).select(F.col(dst).alias("uri")).distinct()
        frontier = cut(step.join(sent(met, total), "uri", "left_anti"))
        n = frontier.count()
        if not n:
            break
        met, total = cut(met.union(frontier)), total + n
    return met, total


def near(edges: DataFrame, starts: list[str], ends: list[str], steps: int) -> DataFrame:
    """All edges that a way of at most `steps` steps from a start to an end may take, some twice.

    Those of its first half leave vertices less than half as many steps from a start, the others lead to vertices as near to an end.
    """
    first = (steps + 1) // 2
    touching = lambda end, found: edges.join(sent(*found), F.col("uri") == F.col(end), "left_semi")
    out = touching("src", within(edges, starts, first - 1))
    return out.unionByName(touching("dst", within(edges, ends, steps - first - 1, "dst", "src"))) if steps > first else out


def left_to_end(edges: DataFrame, end: str, max_length: int) -> DataFrame:
    """uri, rest: the least weight of a way of less than max_length steps from each vertex that has one to the end. edges: src, dst, w."""
    spark = edges.sparkSession
    rest = frontier = spark.createDataFrame([(end, 0.0)], "uri string, rest double")
    n = 1
    for _ in range(max_length - 1):
        step = edges.join(sent(frontier, n), F.col("uri") == F.col("dst")).groupBy(F.col("src").alias("uri")).agg(F.min(F.col("rest") + F.col("w")).alias("rest"))
        better = step.join(rest.withColumnRenamed("rest", "old"), "uri", "left").where("old is null or rest < old").select("uri", "rest")
        frontier = cut(better)
        n = frontier.count()
        if not n:
            break
        rest = rest.unionByName(frontier).groupBy("uri").agg(F.min("rest").alias("rest"))
    return rest


class Set(NamedTuple):
    """Paths that begin with root (weights up to its nodes: costs) and do not go on to a node of `taken`."""

    root: tuple[str, ...]
    costs: tuple[float, ...]
    taken: frozenset[str]

    def without(self, path: Path) -> list[Set]:
        """The same paths but for one of them, as sets that share none."""
        out = [Set(self.root, self.costs, self.taken | {path.nodes[len(self.root)]})]
        return out + [Set(path.nodes[:i], path.costs[:i], frozenset({path.nodes[i]})) for i in range(len(self.root) + 1, path.length)]


def _best(usable: DataFrame, sets: list[Set], end: str, max_length: int, most: float) -> list[tuple[Path, Set]]:
    """The best path of each set that has one of `most` weight."""
    spark = usable.sparkSession
    label = "place int, uri string, cost double, nodes array<string>, costs array<double>, taken array<string>"
    frontier = spark.createDataFrame([(i, s.root[-1], s.costs[-1], list(s.root), list(s.costs), sorted(s.taken)) for i, s in enumerate(sets)], label)
    known = frontier.select("place", "uri", "cost")
    best: dict[int, Path] = {}
    n = len(sets)
    for _ in range(max_length - 1):
        step = usable.join(sent(frontier, n), F.col("uri") == F.col("src")).where(~F.array_contains("nodes", F.col("dst")) & ~F.array_contains("taken", F.col("dst")))
        cost = F.round(F.col("cost") + F.col("w"), DIGITS)
        step = step.where((F.size("nodes") < max_length) & (F.round(cost + F.col("rest"), DIGITS) <= most)).select(
            "place", F.col("dst").alias("uri"), F.struct(cost.alias("cost"), F.concat("nodes", F.array("dst")).alias("nodes"), F.concat("costs", F.array(cost)).alias("costs")).alias("l")
        )
        new = step.groupBy("place", "uri").agg(F.min("l").alias("l")).select("place", "uri", "l.*")
        old = known.groupBy("place", "uri").agg(F.min("cost").alias("old"))
        better = new.join(old, ["place", "uri"], "left").where("old is null or cost < old")
        frontier = cut(better.select("place", "uri", "cost", "nodes", "costs", F.array().cast("array<string>").alias("taken")))
        arrived = F.when(F.col("uri") == end, F.struct("place", "cost", "nodes", "costs"))  # one a set at most
        n, paths = frontier.agg(F.count(F.when(F.col("uri") != end, 1)), F.collect_list(arrived)).first()
        for r in paths:
            path = Path(r.cost, len(r.nodes), tuple(r.nodes), tuple(r.costs))
            best[r.place] = min(best.get(r.place, path), path)
        if not n:
            break
        known = known.unionByName(frontier.select("place", "uri", "cost"))
        frontier = frontier.where(F.col("uri") != end)
    return [(p, sets[i]) for i, p in best.items()]


def in_order(edges: DataFrame, starts: list[str], ends: list[str], most: int = 10, max_length: int = 10) -> Iterator[Path]:
    """edges (src, dst, w, weights of 0 and more) -> up to `most` loopless paths of at most max_length nodes, one after the other as they are asked for.

    Weights count to nine digits. From any start to any end; a start that is an end is a path of one node. Of parallel edges the lightest counts.
    Equal weights: the path with fewer nodes, then the one that sorts first.
    """
    if not starts or not ends or most < 1:
        return
    spark = edges.sparkSession
    joined = [(FIRST, s, 0.0) for s in sorted(set(starts))] + [(e, LAST, 0.0) for e in sorted(set(ends))]
    edges = cut(edges.where("src <> dst").select("src", "dst", F.col("w").cast("double").alias("w")))
    if edges.count() > FEW:
        edges = near(edges, starts, ends, max(max_length - 1, 1))
    edges = cut(edges.groupBy("src", "dst").agg(F.min("w").alias("w")).unionByName(spark.createDataFrame(joined, "src string, dst string, w double")))
    length = max_length + 2
    usable = cut(edges.join(left_to_end(edges, LAST, length).withColumnRenamed("uri", "dst"), "dst"))
    # best paths of sets; those of `opened` have had their sets divided
    waiting = [(p, s, False) for p, s in _best(usable, [Set((FIRST,), (0.0,), frozenset())], LAST, length, float("inf"))]
    for given in range(1, most + 1):
        if not waiting:
            return
        path, own, opened = waiting.pop(0)
        yield Path(path.cost, path.length - 2, path.nodes[1:-1], path.costs[1:-1])
        wanted = most - given
        if opened or not wanted:
            continue
        limit = waiting[wanted - 1][0].cost if len(waiting) >= wanted else float("inf")
        soon = [w for w in waiting[:wanted] if not w[2]]  # the sets of all that may be asked for next, at once
        sets = own.without(path) + [s for p, o, _ in soon for s in o.without(p)]
        waiting = [(p, o, d or k < wanted) for k, (p, o, d) in enumerate(waiting)]
        waiting = sorted([*waiting, *((p, s, False) for p, s in _best(usable, sets, LAST, length, limit))], key=lambda w: w[0])


def several(edges: DataFrame, starts: list[str], ends: list[str], most: int = 10, max_length: int = 10) -> DataFrame:
    """The paths of in_order(): place (from 1), nodes, cost."""
    rows = [(k, list(p.nodes), p.cost) for k, p in enumerate(in_order(edges, starts, ends, most, max_length), 1)]
    return edges.sparkSession.createDataFrame(rows, "place int, nodes array<string>, cost double")
