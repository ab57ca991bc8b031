"""Pairs of alike resources.

All pairs are formed only inside a sector, which the sector operator bounds;
sectors meet by an equi-join on the sector, each unordered pair once, and are
mirrored afterwards. Entropies are computed once a row, so a pair costs one
logarithm a dimension.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.functions import vectors as V
from loomwork.plans.config import Criteria
from loomwork.plans.lineage import cut

#: Rows on each side of a square of pairs, about.
SQUARE = 250


def _sided(rows: DataFrame, side: str, *more: str | Column) -> DataFrame:
    own = rows.withColumn("h", V.entropy(F.col("vector")))
    return own.select(*more, *(F.col(c).alias(f"{c}_{side}") for c in ("uri", "type", "vector", "h")))


def _score(a: str, b: str) -> Column:
    return V.js_similarity(F.col(f"vector_{a}"), F.col(f"vector_{b}"), F.col(f"h_{a}"), F.col(f"h_{b}"))


def in_sector(sectored: DataFrame, sector: str = "sector", least: float | None = None, both_ways: bool = False) -> DataFrame:
    """resource_uri_1, resource_type_1, resource_uri_2, resource_type_2, score, sector: pairs above `least` (strictly)."""
    rows = sectored.where(F.col("vector").isNotNull())
    pairs = _sided(rows, "1", sector).join(_sided(rows, "2", sector), sector).where(F.col("uri_1") < F.col("uri_2"))
    scored = pairs.select(
        F.col("uri_1").alias("resource_uri_1"), F.col("type_1").alias("resource_type_1"), F.col("uri_2").alias("resource_uri_2"),
        F.col("type_2").alias("resource_type_2"), _score("1", "2").alias("score"), F.col(sector).alias("sector"),
    )
    if least is not None:
        scored = scored.where(F.col("score") > least)
    return mirrored(scored) if both_ways else scored


def of_changed(sectored: DataFrame, changed: DataFrame) -> DataFrame:
    """What in_sector() gives both ways for the pairs with a resource of `changed` (uri): changed rows meet the rows of their sectors only."""
    rows = sectored.where(F.col("vector").isNotNull()).join(changed.select("uri", F.lit(True).alias("new")).distinct(), "uri", "left")
    pairs = _sided(rows.where("new"), "1", "sector").join(_sided(rows, "2", "sector", "new"), "sector")
    once = pairs.where("uri_1 <> uri_2 and (new is null or uri_1 < uri_2)")
    return mirrored(once.select(
        F.col("uri_1").alias("resource_uri_1"), F.col("type_1").alias("resource_type_1"), F.col("uri_2").alias("resource_uri_2"),
        F.col("type_2").alias("resource_type_2"), _score("1", "2").alias("score"), "sector",
    ))


def mirrored(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, in one pass."""
    way = [F.col(f"resource_{x}_{n}") for n in (1, 2) for x in ("uri", "type")]
    rest = [c for c in pairs.columns if not c.startswith("resource_")]
    turned = F.explode(F.array(*(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(w))) for w in (way, way[2:] + way[:2])))).alias("p")
    names = ("resource_uri_1", "resource_type_1", "resource_uri_2", "resource_type_2")
    return pairs.select(turned, *rest).select(*(F.col(f"p.c{i}").alias(n) for i, n in enumerate(names)), *rest)


def across(sectored: DataFrame, neighbours: DataFrame, least: float, sector: str = "sector") -> DataFrame:
    """Edges from each sector's neighbours to it, score > least; URIs that differ only in case are one.

    neighbours: sector, other. Two equi-joins, so the pairs are those of neighbouring sectors, whose size is bounded.
    """
    a, b = _sided(sectored, "1", sector), _sided(sectored, "2", sector)
    near = neighbours.select(F.col("sector").alias("here"), F.col("other").alias("there"))
    pairs = a.join(near, a[sector] == F.col("there")).drop(sector).join(b, F.col("here") == b[sector])
    scored = pairs.where(F.lower("uri_1") != F.lower("uri_2")).select(
        F.col("uri_1").alias("resource_uri_1"), F.col("type_1").alias("resource_type_1"), F.col("uri_2").alias("resource_uri_2"),
        F.col("type_2").alias("resource_type_2"), _score("1", "2").alias("score"),
    )
    return scored.where(F.col("score") > least)


def squared(rows: DataFrame, on: str, more: tuple[str, ...] = (), when: Column | None = None) -> DataFrame:
    """All pairs of rows (uri, type, vector) of one `on`, each once: square, on, resource_uri_1, ..., score, and c_1 and c_2 of each c in more.

    Pairs lie in the squares of a grid, which are dealt out each for itself: no task has more than a few squares, whose size is bounded,
    and a row is copied once a bucket of the grid. when: what pairs must be (uri_1, uri_2, c_1, c_2) to be scored.
    """
    rows = cut(rows.where(F.col("vector").isNotNull()))
    many = rows.count() // SQUARE + 1
    dealt = rows.withColumn("own", F.pmod(F.hash("uri"), F.lit(many))).withColumn("met", F.explode(F.sequence(F.lit(0), F.lit(many - 1))))
    key = ["square", "on"]

    def side(n: str, kept: str) -> DataFrame:
        square = (F.least("own", "met") * many + F.greatest("own", "met")).alias("square")
        own = _sided(dealt.where(kept), n, square, F.col(on).alias("on"), F.col("own").alias(f"own_{n}"), *(F.col(c).alias(f"{c}_{n}") for c in more))
        return own.repartition(many * (many + 1) // 2, *key)

    pairs = side("1", "own <= met").join(side("2", "own >= met"), key).where("own_1 < own_2 or uri_1 < uri_2")
    pairs = pairs if when is None else pairs.where(when)
    return pairs.select(
        *key, F.col("uri_1").alias("resource_uri_1"), F.col("type_1").alias("resource_type_1"), F.col("uri_2").alias("resource_uri_2"),
        F.col("type_2").alias("resource_type_2"), _score("1", "2").alias("score"), *(f"{c}_{n}" for c in more for n in "12"),
    )


def of_centroids(centres: DataFrame) -> DataFrame:
    """Both-way similarities of centroids of one type (one a sector and type); all pairs, so they grow with the square of the sectors."""
    return mirrored(squared(centres, "type").drop("square", "on"))


def one_to_all(shapes: DataFrame, uri: str, vector: list[float]) -> DataFrame:
    """Similarities of a new shape with all others, both ways; with itself 0."""
    score = F.when(F.col("uri") == uri, 0.0).otherwise(V.js_similarity(F.col("vector"), V.literal(vector)))
    rows = shapes.select(F.lit(uri).alias("resource_uri_1"), F.lit("item").alias("resource_type_1"), F.col("uri").alias("resource_uri_2"), F.col("type").alias("resource_type_2"), score.alias("score"))
    return mirrored(rows)


def similar_to(similarities: DataFrame, uri: str, criteria: Criteria = Criteria()) -> DataFrame:
    """score >= threshold, of the first wanted type, best first."""
    rows = similarities.where((F.col("resource_uri_1") == uri) & (F.col("score") >= criteria.threshold))
    if criteria.types:
        rows = rows.where(F.col("resource_type_2") == criteria.types[0])
    return rows.orderBy(F.desc(F.round("score", 9)), "resource_uri_2").limit(criteria.max).select(F.col("resource_uri_2").alias("uri"), "score")


def alike(sectored: DataFrame, uri: str, criteria: Criteria = Criteria(), sector: str = "sector") -> DataFrame:
    """What similar_to() gives for one resource without any stored pairs: a look-up of its shape, then one scan of its sector."""
    row = sectored.where((F.col("uri") == uri) & F.col("vector").isNotNull()).select(sector, "vector").first()
    if row is None:
        return sectored.select("uri", F.lit(0.0).alias("score")).limit(0)
    own = sectored.where((F.col(sector) == row[sector]) & (F.col("uri") != uri) & F.col("vector").isNotNull())
    return similar_to_vector(own, list(row.vector), Criteria(criteria.max, criteria.threshold, criteria.types[:1]), strict=False)


def similar_to_vector(shapes: DataFrame, vector: list[float], criteria: Criteria = Criteria(), strict: bool = True) -> DataFrame:
    """Resources alike to a free text's shape: the vector is a literal, so one scan and a top-k, no join."""
    rows = shapes.where(F.col("type").isin(list(criteria.types))) if criteria.types else shapes
    h = -sum(x * math.log2(x) for x in vector if x > 0)  # once, not once a row
    scored = rows.select("uri", V.js_similarity(F.col("vector"), V.literal(vector), None, F.lit(h)).alias("score"))
    scored = scored.where(F.col("score") > criteria.threshold if strict else F.col("score") >= criteria.threshold)
    return scored.orderBy(F.desc(F.round("score", 9)), "uri").limit(criteria.max)


def between(shapes: DataFrame, a: str, b: str) -> DataFrame:
    """The similarity of two resources; no row where one is missing."""
    own = shapes.where(F.col("uri").isin(a, b))
    vec = lambda u: F.max(F.when(F.col("uri") == u, F.col("vector")))
    both = own.agg(vec(a).alias("p"), vec(b).alias("q")).where("p is not null and q is not null")
    return both.select(F.lit(a).alias("uri_1"), F.lit(b).alias("uri_2"), V.js_similarity(F.col("p"), F.col("q")).alias("score"))


def stored(similarities: DataFrame, a: str, b: str) -> DataFrame:
    return similarities.where((F.col("resource_uri_1") == a) & (F.col("resource_uri_2") == b)).select("score")


def cosine_pairs(rows: DataFrame, key: str, vector: str, block: str, least: float, places: int = 6) -> DataFrame:
    """Pairs of a block with cosine above `least`; squared norms once a row.

    Vectors of small numbers often have cosines that are exactly `least`, or end in a half beyond the `places` they are rounded to: these
    few are taken with fused sums and one root, so that they fall on the side where the SQL puts them.
    """
    v = F.col(vector)
    own = rows.select(F.col(block).alias("block"), F.col(key).alias("k"), v.alias("v"), V.dot(v, v).alias("n"))
    a, b = own.select("block", *(F.col(c).alias(f"{c}1") for c in "kvn")), own.select("block", *(F.col(c).alias(f"{c}2") for c in "kvn"))
    plain = F.try_divide(V.dot(F.col("v1"), F.col("v2")), F.sqrt(F.col("n1") * F.col("n2")))  # null for a vector of zeros
    pairs = a.join(b, "block").where("k1 < k2").select("k1", "k2", "v1", "v2", plain.alias("plain")).where(F.col("plain") > least - 1e-9)
    scaled = F.col("plain") * 10.0**places
    unsure = (F.abs(scaled - F.floor(scaled) - 0.5) < 1e-6) | (F.abs(F.col("plain") - least) < 1e-9)
    exact = V.dot_fused(F.col("v1"), F.col("v2")) / F.sqrt(V.dot_fused(F.col("v1"), F.col("v1")) * V.dot_fused(F.col("v2"), F.col("v2")))
    score = F.least(F.when(unsure, exact).otherwise(F.col("plain")), F.lit(1.0))
    return pairs.select("k1", "k2", score.alias("score")).where(F.col("score") > least)


def column_cosines(rows: DataFrame, vector: str, least: float | None = None) -> DataFrame:
    """Cosines of the columns of a matrix of row vectors: sums of products are combined before the shuffle, k x k cells leave it."""
    v = F.col(vector)
    cells = rows.select(v.alias("v"), F.posexplode(v).alias("i", "x")).select("i", "x", F.posexplode("v").alias("j", "y")).where("i <= j")
    dots = cells.groupBy("i", "j").agg(F.sum(F.col("x").cast("double") * F.col("y").cast("double")).alias("d"))
    norm = dots.where("i = j").select("i", F.sqrt("d").alias("n"))
    named = dots.where("i < j").join(F.broadcast(norm.select("i", F.col("n").alias("n1"))), "i").join(F.broadcast(norm.select(F.col("i").alias("j"), F.col("n").alias("n2"))), "j")
    out = named.where("n1 > 0 and n2 > 0").select("i", "j", (F.col("d") / (F.col("n1") * F.col("n2"))).alias("score"))
    return out if least is None else out.where(F.col("score") > least)


def column_cosines_sampled(rows: DataFrame, vector: str, key: str, least: float, oversampling: float = 10.0) -> DataFrame:
    """column_cosines() above `least` from sampled products, for tables of very many rows.

    A product of columns i and j is kept with the probability p_i * p_j, p = min(1, sqrt(g) / norm), where
    g = oversampling * ln(k) / least for k columns, and is scaled back: so each column passes about g products with
    every other one however many rows there are, and fewer the higher `least` is. Draws are hashes of `key` and the columns, so they
    repeat after a lost task. The estimate is unbiased. For entries between 0 and 1 its variance is at most the score over
    min(sqrt(g), norm of i) * min(sqrt(g), norm of j); where neither norm is above sqrt(g), as in small tables, it is exact.
    Columns of norm 0 have no pairs; rows with a null vector do not count; an empty table gives no rows.
    """
    cells = rows.where(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    each = cells.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("double") * F.col("x").cast("double")).alias("s"))
    norms = {r.i: math.sqrt(r.s) for r in each.where("s > 0").collect()}  # k values, as many as a vector has entries
    k = 1 + max(norms, default=0)
    root = math.sqrt(oversampling * math.log(max(k, 2)) / least)
    share = V.literal([min(1.0, root / norms[i]) if i in norms else 0.0 for i in range(k)])
    # what a kept entry counts for: over its norm or, where it was drawn, over the root
    scale = V.literal([1 / min(root, norms[i]) if i in norms else 0.0 for i in range(k)])
    draw = lambda *x: F.pmod(F.xxhash64("key", *x), F.lit(1 << 53)) / float(1 << 53)
    part = lambda x, i: F.struct(i.alias("i"), (x.cast("double") * F.get(scale, i)).alias("x"), F.get(share, i).alias("p"))
    entries = F.filter(F.transform("v", part), lambda e: e["x"] != 0)
    first = F.filter(entries, lambda e: (e["p"] >= 1) | (draw(e["i"]) < e["p"]))
    one = cells.select("key", entries.alias("all"), F.explode(first).alias("e")).select("key", F.col("e.i").alias("i"), F.col("e.x").alias("x"), "all")
    second = F.filter("all", lambda e: (e["i"] > F.col("i")) & ((e["p"] >= 1) | (draw(F.col("i"), e["i"]) < e["p"])))
    pairs = one.select("i", "x", F.explode(second).alias("o")).select("i", F.col("o.i").alias("j"), (F.col("x") * F.col("o.x")).alias("d"))
    return pairs.groupBy("i", "j").agg(F.sum("d").alias("score")).where(F.col("score") > least)


def precision_recall(found: DataFrame, true: DataFrame, keys: list[str]) -> DataFrame:
    """Of two tables of pairs: precision and recall of the first (null where undefined)."""
    f, t = found.select(*keys).distinct().withColumn("f", F.lit(1)), true.select(*keys).distinct().withColumn("t", F.lit(1))
    hit, nf, nt = F.sum(F.when(F.col("f").isNotNull() & F.col("t").isNotNull(), 1).otherwise(0)), F.count("f"), F.count("t")
    return f.join(t, keys, "full").agg(F.try_divide(hit, nf).alias("precision"), F.try_divide(hit, nt).alias("recall"))


def signature_quality(sectored: DataFrame, bits: Column, least: float, sector: str = "sector") -> DataFrame:
    """precision_recall() of equal signatures as a guess of the pairs of a sector above `least`; a uri is in one sector.

    Both are pairs of a sector, so they are formed once and marked; no pair is shuffled.
    """
    rows = sectored.where(F.col("vector").isNotNull()).withColumn("bits", bits)
    a, b = (_sided(rows, n, sector, F.col("bits").alias(f"bits_{n}")) for n in "12")
    pairs = a.join(b, sector).where("uri_1 < uri_2")
    marks = F.struct(F.coalesce(F.col("bits_1") == F.col("bits_2"), F.lit(False)).alias("f"), F.coalesce(_score("1", "2") > least, F.lit(False)).alias("t"))
    # as an array, since a condition would be taken below the marks and have each score computed twice
    marked = pairs.select(sector, "uri_1", "uri_2", F.inline(F.filter(F.array(marks), lambda m: m["f"] | m["t"])))
    each = marked.groupBy(sector, "uri_1", "uri_2").agg(F.max("f").alias("f"), F.max("t").alias("t"))  # within the partitions of sectors
    hit = F.sum(F.when(F.col("f") & F.col("t"), 1).otherwise(0))
    return each.agg(F.try_divide(hit, F.count_if("f")).alias("precision"), F.try_divide(hit, F.count_if("t")).alias("recall"))
