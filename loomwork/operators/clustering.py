"""k-means of many sets of points at once, with nearest centres found by exact bounds.

All sectors and all runs advance in one Spark job a round. Rows lie in buckets of a sector, whose size is bounded, and are shuffled
once a level; centres come to them by a broadcast of a checked size, beyond it by a cogroup, which shuffles the vectors once a round.
Only sums keyed by (sector, run, centre) leave the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.plans.lineage import cut
from loomwork.plans.shipping import ship

#: Rows of a bucket, about: what one task holds of a sector at a time.
BUCKET = 20_000
#: Rows of a task, about: a round runs no more tasks than the rows are worth, whatever the number of shuffle partitions.
TASK = 5_000
#: Rows of a sector that first centres are chosen from, about; all rows then take part in every round.
SEEDS = 1_000
#: Steps that first centres take at most on those rows before all rows are read.
WARM = 50
#: Bytes of centres that are held by the driver and broadcast at most; beyond that they are a table that meets the rows by a shuffle.
MOST_HELD = 64 << 20
#: Share of a distance by which a bound must exceed it, since both are rounded.
SLACK = 1e-9


def _length(v: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", v, v))


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centre, distance, distances computed) of each point; among equals the first.

    A centre is passed over where its norm differs from the point's by more than the least distance so far, or where it lies farther
    from the best centre so far than twice that distance: neither can be nearer, so the result is that of the plain search.
    """
    long_p, long_c = _length(points), _length(centres)
    order = np.argsort(long_c, kind="stable")
    own = order[np.minimum(np.searchsorted(long_c[order], long_p), len(centres) - 1)]
    best, computed = _length(points - centres[own]), len(points)
    spare = SLACK * (long_c.max(initial=0.0) + long_p)
    for j in range(len(centres)):
        gap = _length(centres - centres[j])
        can = np.flatnonzero((own != j) & (np.abs(long_p - long_c[j]) <= best + spare) & (gap[own] <= 2 * best + spare))
        apart = _length(points[can] - centres[j])
        better = (apart < best[can]) | ((apart == best[can]) & (j < own[can]))
        own[can[better]], best[can[better]] = j, apart[better]
        computed += len(can)
    return own, best, computed


def within(points: np.ndarray, centres: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
    """(point, centre) for every centre within the point's least distance / ratio, by the same bounds."""
    own, best, _ = nearest(points, centres)
    long_p, long_c = _length(points), _length(centres)
    reach = best / ratio
    spare = SLACK * (long_c.max(initial=0.0) + long_p)
    rows, found = [], []
    for j in range(len(centres)):
        gap = _length(centres - centres[j])
        can = np.flatnonzero((np.abs(long_p - long_c[j]) <= reach + spare) & (gap[own] - best <= reach + spare))
        hit = can[_length(points[can] - centres[j]) <= reach[can]]
        rows.append(hit)
        found.append(np.full(len(hit), j))
    return np.concatenate(rows), np.concatenate(found)


def drawn(rows: DataFrame, seed: int) -> DataFrame:
    """rows with `draw`, 0 to 1: buckets and samples go by it, a row and not a uri, so repeated uris spread too. Written, so it stays."""
    return cut(rows.withColumn("draw", F.rand(seed)))


def bucketed(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """rows (uri, type, vector, sector, draw) of the sectors of `sizes` (sector, n, k), by (sector, bucket), each bucket of about `BUCKET` rows."""
    buckets = F.ceil(F.col("n") / BUCKET).cast("int")
    placed = rows.join(sizes, "sector").withColumn("buckets", buckets).withColumn("bucket", F.floor(F.col("draw") * F.col("buckets")).cast("int"))
    picked = placed.withColumn("picked", F.pmod(F.col("draw") * 2**20, F.lit(1.0)) * F.col("n") < 2 * SEEDS)  # other digits of the draw
    spark = rows.sparkSession
    worth = max(spark.sparkContext.defaultParallelism, (sizes.agg(F.sum("n")).first()[0] or 0) // TASK + 1)
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), worth)
    return cut(picked.repartition(parts, "sector", "bucket").sortWithinPartitions("sector", "bucket"))


#: Centres of a sector and run; `buckets` is how many buckets the sector has.
KEYS = ["sector", "run", "part", "buckets"]
CENTRES = "sector string, run int, part int, buckets int, vector array<double>"


def seeds(rows: DataFrame, runs: int, seed: int) -> DataFrame:
    """First centres (sector, run, part, buckets, vector) of bucketed rows: spread out over a bounded sample (D2 sampling), then a few steps on it."""
    ship(rows.sparkSession)

    def choose(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("draw")
        points, k = np.array(p["vector"].tolist(), float), int(p["k"].iloc[0])
        out = []
        for run in range(runs):
            dice = np.random.default_rng([seed, run])
            chosen = [int(dice.integers(len(points)))]
            least = ((points - points[chosen[0]]) ** 2).sum(1)
            while len(chosen) < k and least.sum() > 0:
                chosen.append(int(dice.choice(len(points), p=least / least.sum())))
                least = np.minimum(least, ((points - points[chosen[-1]]) ** 2).sum(1))
            centres = points[chosen]
            for _ in range(WARM):
                own = nearest(points, centres)[0]
                before, centres = centres, np.array([points[own == j].mean(0) for j in range(len(centres)) if (own == j).any()])
                if np.array_equal(before, centres):
                    break
            out += [(key[0], run, j, p["buckets"].iloc[0], c.tolist()) for j, c in enumerate(centres)]
        return pd.DataFrame(out, columns=["sector", "run", "part", "buckets", "vector"])

    sample = rows.where("picked").select("sector", "draw", "k", "buckets", "vector")
    return sample.groupBy("sector").applyInPandas(choose, CENTRES)


def held(first: DataFrame, rows: DataFrame, sizes: DataFrame, runs: int) -> DataFrame | pd.DataFrame:
    """First centres in the driver, if those of all sectors are known to take at most `MOST_HELD` bytes; else written as a table."""
    wide = rows.select(F.size("vector")).first()[0]
    return first.toPandas() if sizes.agg(F.sum("k")).first()[0] * runs * wide * 8 <= MOST_HELD else cut(first)


def _meet(rows: DataFrame, centres: DataFrame | pd.DataFrame, run, ddl: str) -> DataFrame:
    """run(rows, centres of their sector): centres in the driver are broadcast and rows stay where they are, a table meets buckets by a cogroup."""
    spark = rows.sparkSession
    ship(spark)
    if isinstance(centres, pd.DataFrame):
        shared = spark.sparkContext.broadcast(dict(list(centres.groupby("sector"))))

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for p in batches:
                for sector, own in p.groupby("sector"):
                    yield run(own, shared.value[sector])

        return rows.mapInPandas(each, ddl)
    sent = centres.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    return rows.groupBy("sector", "bucket").cogroup(sent.groupBy("sector", "bucket")).applyInPandas(run, ddl)


def step(rows: DataFrame, centres: DataFrame | pd.DataFrame) -> DataFrame:
    """One round: sector, run, part, buckets, n, cost (sum of squared distances to the old centres), computed (distances), vector (the means).

    A centre that no row is nearest to goes.
    """

    def sums(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        points = np.array(p["vector"].tolist(), float)
        for r, own_c in c.groupby("run") if len(p) and len(c) else ():
            own_c = own_c.sort_values("part")
            own, apart, computed = nearest(points, np.array(own_c["vector"].tolist(), float))
            for j, (part, buckets) in enumerate(zip(own_c["part"], own_c["buckets"])):
                mine = own == j
                if mine.any():  # what was computed counts once, with the centre of the first row
                    once = computed if j == own[0] else 0
                    out.append((p["sector"].iloc[0], r, part, buckets, mine.sum(), (apart[mine] ** 2).sum(), once, points[mine].sum(0).tolist()))
        return pd.DataFrame(out, columns=["sector", "run", "part", "buckets", "n", "cost", "computed", "total"])

    got = _meet(rows.select("sector", "bucket", "vector"), centres, sums, "sector string, run int, part int, buckets int, n long, cost double, computed long, total array<double>")
    wide = range(len(centres["vector"].iloc[0] if isinstance(centres, pd.DataFrame) else centres.select("vector").first()[0]))
    totals = F.expr(f"struct({', '.join(f'sum(total[{i}]) AS t{i}' for i in wide)})").alias("t")
    whole = got.groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("computed").alias("computed"), totals)
    return whole.select(*KEYS, "n", "cost", "computed", F.expr(f"array({', '.join(f't.t{i} / n' for i in wide)})").alias("vector"))


def fit(rows: DataFrame, first: DataFrame | pd.DataFrame, iterations: int, epsilon: float) -> DataFrame | pd.DataFrame:
    """Centres (sector, run, part, buckets, vector) of the run of least cost of each sector, after rounds until no centre moves by over `epsilon`.

    The cost of a run is that of its last round; the round's centres count. No rounds: the first centres of run 0.
    """
    centres = first
    if not iterations:
        return centres[centres["run"] == 0] if isinstance(centres, pd.DataFrame) else centres.where("run = 0")
    if isinstance(centres, pd.DataFrame):
        for _ in range(iterations):
            new = step(rows, centres).toPandas()
            both = new.merge(centres, on=KEYS, suffixes=("", "_old"))
            apart = _length(np.array(both["vector"].tolist(), float) - np.array(both["vector_old"].tolist(), float))
            centres = new[[*KEYS, "cost", "vector"]]
            if apart.max(initial=0.0) <= epsilon:
                break
        costs = centres.groupby(["sector", "run"], as_index=False)["cost"].sum().sort_values(["sector", "cost", "run"])
        return centres.merge(costs.drop_duplicates("sector")[["sector", "run"]], on=["sector", "run"])
    for _ in range(iterations):
        old = centres.select(*KEYS, F.col("vector").alias("old"))
        moved = F.sqrt(F.aggregate(F.zip_with("vector", "old", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, d: acc + d))
        centres = cut(step(rows, centres).join(old, KEYS).select(*KEYS, "cost", "vector", moved.alias("moved")))
        if centres.agg(F.max("moved")).first()[0] <= epsilon:
            break
    costs = centres.groupBy("sector", "run").agg(F.sum("cost").alias("cost"))
    best = costs.groupBy("sector").agg(F.min(F.struct("cost", "run")).alias("b")).select("sector", F.col("b.run").alias("run"))
    return centres.join(best, ["sector", "run"])


def split(rows: DataFrame, centres: DataFrame | pd.DataFrame) -> DataFrame:
    """uri, type, vector, draw, sector, part: the nearest centre of the own sector."""

    def own(p: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values("part")
        if not len(p):
            return p[["uri", "type", "vector", "draw", "sector"]].assign(part=pd.Series(dtype=int))
        found = nearest(np.array(p["vector"].tolist(), float), np.array(c["vector"].tolist(), float))[0]
        return p[["uri", "type", "vector", "draw", "sector"]].assign(part=c["part"].to_numpy()[found])

    return _meet(rows, centres, own, "uri string, type string, vector array<double>, draw double, sector string, part int")


def memberships(shapes: DataFrame, names: list[str], vectors: list[list[float]], ratio: float) -> DataFrame:
    """uri, cluster: every one of few centres within the least distance / ratio of a point, one narrow pass over the shapes."""
    ship(shapes.sparkSession)
    shared = shapes.sparkSession.sparkContext.broadcast((np.array(names, object), np.array(vectors, float)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, centres = shared.value
        for p in batches:
            if len(p):
                rows, found = within(np.array(p["vector"].tolist(), float), centres, ratio)
                yield pd.DataFrame({"uri": p["uri"].to_numpy()[rows], "cluster": known[found]})

    return shapes.where(F.col("vector").isNotNull()).select("uri", "vector").mapInPandas(run, "uri string, cluster string")
