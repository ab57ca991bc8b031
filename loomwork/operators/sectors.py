"""Size-bounded sectors of the shape space, their centroids and overlaps."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import clustering
from loomwork.plans.lineage import cut

MAX_DEPTH = 8
#: Parts that a sector is split into at once: centres in the driver, whatever the number of rows.
MOST_PARTS = 32
#: Rows of a bucket, about, when a sector that cannot be split is dealt out.
BUCKET_ROWS = 100_000


def assign(
    shapes: DataFrame, size: int = 1000, iterations: int = 20, epsilon: float = 1e-5, seed: int = 42, runs: int = 1, initial: list[list[float]] | None = None,
) -> DataFrame:
    """shapes (uri, type, vector) with `sector`: recursive k-means until no sector exceeds `size` rows.

    All oversized sectors of a level are split in the same jobs, into at most `MOST_PARTS` parts each, by the cheapest of `runs` starts.
    initial: centres of the first level (a model that is at hand; as many parts), then improved like others; with no iterations they
    stay as they are. A sector that k-means cannot split (equal points), or that is still too large at the depth limit, is dealt out by
    a hash of the row, which keeps the bound. Vectors have one length; rows without one are left out.
    """
    rows = shapes.where(F.col("vector").isNotNull()).select("uri", "type", F.col("vector").cast("array<double>").alias("vector"))
    done, open_ = None, clustering.drawn(rows.withColumn("sector", F.lit("0")), seed)
    out = ("uri", "type", "vector", "sector")
    for level in range(MAX_DEPTH + 1):
        counts = open_.groupBy("sector").agg(F.count("*").alias("n"))
        k = F.least(F.lit(MOST_PARTS), F.greatest(F.lit(2), F.ceil(2 * F.col("n") / size))).cast("int")
        given = initial if level == 0 else None
        sizes = cut((counts if given else counts.where(F.col("n") > size)).withColumn("k", k))
        if sizes.isEmpty():
            left = open_.select(*out)
            return left if done is None else done.unionByName(left)
        if not given:
            small = open_.join(sizes, "sector", "left_anti").select(*out)
            done = small if done is None else done.unionByName(small)
        if level == MAX_DEPTH:
            return done.unionByName(_dealt(open_.join(sizes, "sector"), size))
        points = clustering.bucketed(open_, sizes)
        if given:
            buckets = points.agg(F.max("buckets")).first()[0]
            known = [("0", 0, j, buckets, [float(x) for x in v]) for j, v in enumerate(given)]
            first = pd.DataFrame(known, columns=[*clustering.KEYS, "vector"])
        else:
            first = clustering.held(clustering.seeds(points, runs, seed + level), points, sizes, runs)
        parts = cut(clustering.split(points, clustering.fit(points, first, iterations, epsilon)))
        split = parts.groupBy("sector").agg(F.min("part").alias("a"), F.max("part").alias("z")).where("a < z").select("sector")
        named = F.concat_ws(".", "sector", F.col("part").cast("string")).alias("sector")
        if not given:
            whole = parts.join(split, "sector", "left_anti").join(sizes, "sector")
            done = done.unionByName(_dealt(whole, size))
            parts = parts.join(split, "sector", "left_semi")
        open_ = cut(parts.select("uri", "type", "vector", "draw", named))


def _dealt(rows: DataFrame, size: int) -> DataFrame:
    """rows (uri, type, vector, sector, draw, n) in numbered pieces of at most `size` rows of their sector, in the order of the draws."""
    bucket = F.floor(F.col("draw") * F.ceil(F.col("n") / BUCKET_ROWS))
    place = F.row_number().over(Window.partitionBy("sector", "bucket").orderBy("draw", "uri")) - 1
    piece = F.concat_ws("-", F.col("bucket").cast("string"), F.floor(place / size).cast("string"))
    return rows.withColumn("bucket", bucket).withColumn("piece", piece).select("uri", "type", "vector", F.concat_ws("#", "sector", "piece").alias("sector"))


def centroids(sectored: DataFrame) -> DataFrame:
    """Mean vector of each sector: uri, type `centroid`, vector."""
    return _means(sectored, ["sector"]).select(F.col("sector").cast("string").alias("uri"), F.lit("centroid").alias("type"), "vector")


def typed_centroids(sectored: DataFrame) -> DataFrame:
    """Mean vector of each sector and type: uri, type, vector."""
    return _means(sectored, ["sector", "type"]).select(F.col("sector").cast("string").alias("uri"), "type", "vector")


def centroids_by_type(sectored: DataFrame, ordinals: dict[str, int]) -> DataFrame:
    """Mean vector of each sector and type, with id (ordinal + 1) * 10000 + sector (numeric sectors)."""
    place = F.create_map(*(x for t, k in ordinals.items() for x in (F.lit(t), F.lit(k))))
    rows = _means(sectored, ["sector", "type"])
    return rows.select(((place[F.col("type")] + 1) * 10000 + F.col("sector").cast("long")).cast("long").alias("id"), "type", "vector")


def _means(rows: DataFrame, keys: list[str]) -> DataFrame:
    cells = rows.select(*keys, F.posexplode("vector").alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("x"))
    whole = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("cells"))
    return whole.withColumn("vector", F.transform("cells", lambda c: c["x"])).drop("cells")


def membership(sectored: DataFrame) -> DataFrame:
    return sectored.select("uri", F.col("sector").alias("cluster"))


def clusters_of(members: DataFrame, uri: str) -> DataFrame:
    return members.where(F.col("uri") == uri).select("cluster")


def overlaps(members: DataFrame) -> DataFrame:
    """members (uri, cluster) -> shared members of two clusters over the size of the first, for each ordered pair that shares any."""
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n"))
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.uri") == F.col("b.uri")) & (F.col("a.cluster") != F.col("b.cluster")))
    shared = pairs.groupBy(F.col("a.cluster").alias("cluster"), F.col("b.cluster").alias("other")).agg(F.count("*").alias("shared"))
    return shared.join(sizes, "cluster").select("cluster", "other", (F.col("shared") / F.col("n")).alias("score"))


#: Centroids that are put into a row's expression at most; more are reached through the sector of the row.
MOST_CENTRES = 2000


def near_centroids(shapes: DataFrame, centres: DataFrame, ratio: float = 0.9) -> DataFrame:
    """Overlapping membership: every centroid within the least distance / ratio of a point, one narrow pass over the shapes."""
    known = centres.orderBy("uri").limit(MOST_CENTRES + 1).select("uri", "vector").collect()
    if len(known) > MOST_CENTRES:
        raise ValueError(f"over {MOST_CENTRES} centroids: split the space first and compare within its parts")
    if not known:
        return shapes.select("uri", F.lit("").alias("cluster")).limit(0)
    return clustering.memberships(shapes, [r.uri for r in known], [list(r.vector) for r in known], ratio)


def numbered(sectored: DataFrame) -> DataFrame:
    """Sector names as numbers from 0, in the order of the names (as many as there are sectors)."""
    names = sectored.select("sector").distinct()
    place = F.row_number().over(Window.orderBy("sector")) - 1
    return sectored.join(names.withColumn("cluster", place.cast("long")), "sector")


def shared(members: DataFrame, a: str, b: str) -> DataFrame:
    """The resources that belong to both clusters."""
    of = lambda c: members.where(F.col("cluster") == c).select("uri")
    return of(a).intersect(of(b))
