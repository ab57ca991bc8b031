"""Several paths against plain enumeration."""

import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import graph, paths

EXAMPLE = [
    ("uri1", "uri3", 0.5), ("uri3", "uri6", 0.5), ("uri1", "uri4", 0.8), ("uri4", "uri7", 0.5), ("uri4", "uri6", 0.9), ("uri2", "uri4", 0.5),
    ("uri4", "uri5", 0.5), ("uri4", "uri3", 0.8), ("uri6", "uri9", 0.8), ("uri7", "uri9", 0.8), ("uri5", "uri7", 0.5),
]


def enumerated(edges, starts, ends, most, max_length):
    light = {}
    for a, b, w in edges:
        if a != b:
            light[a, b] = min(w, light.get((a, b), w))
    out, stack = [], [((s,), 0.0) for s in set(starts)]
    while stack:
        nodes, cost = stack.pop()
        if nodes[-1] in ends:
            out.append((round(cost, 9), len(nodes), nodes))
        if len(nodes) < max_length:
            stack += [((*nodes, b), cost + w) for (a, b), w in light.items() if a == nodes[-1] and b not in nodes]
    return [(n, c) for c, _, n in sorted(out)[:most]]


def table(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string, w double")


def test_example_in_order(spark):
    got = [("".join(u[3:] for u in p.nodes), p.cost) for p in paths.in_order(table(spark, EXAMPLE), ["uri1"], ["uri9"])]
    assert got == [("1369", 1.8), ("1479", 2.1), ("1469", 2.5), ("14579", 2.6), ("14369", 2.9)]
    assert list(paths.in_order(table(spark, EXAMPLE), ["uri1"], ["uri2"])) == []
    assert [p.nodes for p in paths.in_order(table(spark, EXAMPLE), ["uri1"], ["uri1"])] == [("uri1",)]
    assert list(paths.in_order(table(spark, EXAMPLE), [], ["uri1"])) == []


@pytest.mark.parametrize("seed", range(2))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = "abcdefg"
    edges = [(rng.choice(nodes), rng.choice(nodes), rng.choice([0.0, 0.25, 0.5, 0.5, 1.0, 1.75])) for _ in range(26)]
    starts, ends = rng.sample(nodes, 2), rng.sample(nodes, 2)
    most, longest = 5, rng.choice([3, 4])
    got = [(p.nodes, p.cost) for p in paths.in_order(table(spark, edges), starts, ends, most, longest)]
    # a path may pass through a start or an end on its way, as it may through any other node
    assert got == enumerated(edges, starts, ends, most, longest)


def test_second_way_of_sectors(spark):
    """The cheapest way of sectors holds no path of resources; the next one does."""
    unit = lambda *x: [v / sum(x) for v in x]
    rows = [("a", "item", unit(8, 1, 1), "1"), ("p", "part", unit(1, 1, 8), "2"), ("b", "item", unit(4, 4, 2), "3"), ("z", "item", unit(1, 8, 1), "4")]
    rows += [("m", "item", unit(1, 3, 9), "2")]
    sectored = spark.createDataFrame(rows, "uri string, type string, vector array<double>, sector string")
    shapes = sectored.drop("sector")
    members = sectored.select("uri", F.col("sector").alias("cluster"))
    inside = spark.createDataFrame([], "resource_uri_1 string, resource_type_1 string, resource_uri_2 string, resource_type_2 string, score double, sector string")
    centres = spark.createDataFrame([("1", "centroid", unit(8, 1, 1)), ("2", "centroid", unit(2, 2, 8)), ("3", "centroid", unit(4, 4, 2)), ("4", "centroid", unit(1, 8, 1))], "uri string, type string, vector array<double>")
    between = {(r.src, r.dst): r.score for r in graph.sector_edges(centres, 0.0).collect()}
    least = 0.6
    alike = {(r.src, r.dst): r.score for r in graph.edges_of(graph.similarity.in_sector(sectored.withColumn("one", F.lit(1)), "one", both_ways=True)).collect()}
    assert between["1", "2"] + between["2", "4"] < between["1", "3"] + between["3", "4"]  # the way over 2 comes first
    assert alike["a", "m"] < least and alike["a", "b"] > least and alike["b", "z"] > least
    got = graph.two_level(shapes, members, inside, centres, "a", "z", least=least, max_results=5).collect()
    assert [(r.place, r.nodes) for r in got] == [(1, ["a", "b", "z"])]
    assert got[0].cost == pytest.approx(alike["a", "b"] + alike["b", "z"])
    assert graph.two_level(shapes, members, inside, centres, "a", "z", least=0.99).isEmpty()
    assert graph.two_level(shapes, members, inside, centres, "a", "nowhere").isEmpty()


@pytest.mark.parametrize("few", [3, 10**6])
def test_only_near_edges_are_searched(spark, monkeypatch, few):
    """Of a long chain, edges away from both ends are left out; the paths stay those of plain enumeration."""
    monkeypatch.setattr(paths, "FEW", few)
    chain = [(f"n{i:02}", f"n{i + 1:02}", 1.0) for i in range(40)]
    short = [("n00", "x", 0.5), ("x", "n03", 0.5), ("n01", "n03", 0.25), ("n03", "n00", 0.1), ("n20", "n03", 0.0), ("x", "y", 0.0), ("y", "n03", 2.0)]
    rows = table(spark, chain + short)
    for steps in (1, 2, 3, 4):
        got = [(p.nodes, p.cost) for p in paths.in_order(rows, ["n00"], ["n03"], 9, steps + 1)]
        assert got == enumerated(chain + short, ["n00"], ["n03"], 9, steps + 1)
    left = {(r.src, r.dst) for r in paths.near(rows, ["n00"], ["n03"], 3).collect()}
    assert left == {("n00", "n01"), ("n00", "x"), ("n01", "n02"), ("n01", "n03"), ("x", "n03"), ("x", "y"), ("n02", "n03"), ("n20", "n03"), ("y", "n03")}


@pytest.mark.parametrize("few", [0, 10**6])
def test_shortest_stops_at_the_cost_of_the_end(spark, monkeypatch, few):
    """A long tail that costs more than the way to the end takes no rounds; ties and cheaper ways of more steps still count."""
    monkeypatch.setattr(paths, "FEW", few)
    stored = []
    monkeypatch.setattr(graph, "cut", lambda df, own=graph.cut: stored.append(1) or own(df))
    edges = [("a", "z", 0.9), ("a", "b", 0.25), ("b", "c", 0.25), ("c", "z", 0.25), ("a", "d", 0.5), ("d", "z", 0.25)]
    tail = [(f"t{i:02}", f"t{i + 1:02}", 0.25) for i in range(30)] + [("a", "t00", 0.25)]
    rows = spark.createDataFrame(edges + tail, "src string, dst string, score double")
    assert [tuple(r) for r in graph.shortest(rows, "a", "z").collect()] == [(["a", "b", "c", "z"], 0.75)]
    assert len(stored) < 15
    assert [tuple(r) for r in graph.shortest(rows, "a", "a").collect()] == [(["a"], 0.0)]
    assert graph.shortest(rows, "z", "a").isEmpty()


def test_ranks_shuffle_no_links(spark):
    """Rounds more or fewer do not change what is shuffled of the links; ranks are those of plain sums, for vertices of any type."""
    rng = random.Random(5)
    links = {(rng.randrange(30), rng.randrange(30)) for _ in range(80)} | {(1, 99), (99, 98)}
    out = {u: sum(a == u for a, _ in links) for u, _ in links}
    want = dict.fromkeys({u for e in links for u in e}, 1.0)
    for _ in range(7):
        want = {v: 0.01 + 0.99 * sum(want[a] / out[a] for a, b in links if b == v) for v in want}
    plans = []
    for kind in ("long", "string"):
        rows = spark.createDataFrame([(a, b) for a, b in [*links, (1, 99)]], "src long, dst long").select(F.col("src").cast(kind), F.col("dst").cast(kind))
        real = graph.cut

        def noted(df):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return real(df)

        graph.cut = noted
        try:
            got = {int(r.uri): r.rank for r in graph.pagerank(rows, rounds=7, every=5).collect()}
        finally:
            graph.cut = real
        assert got == pytest.approx(want)
    # the first cut is that of the edges; links come from where they are kept, already dealt, and never under an exchange of their own
    assert all("Exchange" in p and "InMemoryTableScan" in p for p in plans[1:3])
    for p in plans[1:3]:
        lines = p.splitlines()
        scans = [i for i, line in enumerate(lines) if "InMemoryTableScan" in line and "src" in line]
        assert scans and not any("Exchange" in lines[i - 1] or "Sort " in lines[i - 1] for i in scans)


CASES = [("score", ["item"], ["s00"], ["s19"], 0.3, 5), ("1-score", ["item", "part"], ["s01", "s02"], ["s15", "s02"], 0.3, 4)]


@pytest.mark.parametrize("weight, types, starts, ends, least, longest", CASES)
def test_sector_ways_are_those_over_all_edges(spark, monkeypatch, weight, types, starts, ends, least, longest):
    """Only edges that the ways asked for may take are made, by squares of a grid; the ways are those over the edges of all pairs."""
    monkeypatch.setattr(graph.similarity, "SQUARE", 9)
    rng = random.Random(7)
    unit = lambda x: [v / sum(x) for v in x]
    # bumps along 12 dimensions: the ends have little in common, so ways of more steps are found
    bump = lambda at: unit([2.0 ** -abs(i - at) + rng.random() / 50 for i in range(12)])
    rows = [(f"s{k:02}", t, bump(k * 11 / 19)) for k in range(20) for t in ("item", "part") if t == "item" or k % 3]
    centres = spark.createDataFrame(rows, "uri string, type string, vector array<double>")
    edges = [(r.src, r.dst, r.score if weight == "score" else 1 - r.score) for r in graph.sector_edges(centres, least, types).collect()]
    got = [(p.nodes, p.cost) for p in graph.sector_ways(centres, starts, ends, least, 3, longest, types, weight)]
    want = enumerated(edges, starts, ends, 3, longest)
    assert [n for n, _ in got] == [n for n, _ in want] and max(len(n) for n, _ in got) > 2
    assert [c for _, c in got] == pytest.approx([c for _, c in want], abs=1e-8)  # costs are rounded at each step


def test_edges_of_sectors_that_no_way_takes_are_not_made(spark, monkeypatch):
    """Sectors whose ends are alike: the first way needs no edge but those of the ends, and no task holds the pairs of all sectors."""
    rng = random.Random(3)
    unit = lambda x: [v / sum(x) for v in x]
    centres = spark.createDataFrame([(f"s{k:03}", "item", unit([1 + rng.random() for _ in range(8)])) for k in range(300)], "uri string, type string, vector array<double>")
    used, plain = [], paths.in_order
    monkeypatch.setattr(graph.paths, "in_order", lambda edges, *a: used.append(edges.count()) or plain(edges, *a))
    assert next(graph.sector_ways(centres, ["s000"], ["s299"], 0.1, 2, 10, ["item"])).nodes == ("s000", "s299")
    assert used == [2 * (299 + 298)]
    monkeypatch.setattr(graph.similarity, "SQUARE", 30)
    pairs = graph.similarity.of_centroids(centres)
    held = [len(p) for p in pairs.rdd.glom().collect()]
    assert sum(held) == 300 * 299 and max(held) < 300 * 299 / 4
