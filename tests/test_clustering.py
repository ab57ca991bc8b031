"""Clustering of all sectors at once: nearest centres by bounds, rounds, starts, bounds of sectors."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.operators import clustering, sectors
from loomwork.plans import queries as Q

SF = "/root/testdata/sf0.001"


def plain(points, centres):
    return np.sqrt(((points[:, None] - centres[None]) ** 2).sum(2))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 12), st.integers(1, 5), st.booleans())
def test_nearest_is_the_plain_search(seed, n, k, d, coarse):
    g = np.random.default_rng(seed)
    points, centres = g.normal(size=(n, d)), g.normal(size=(k, d))
    if coarse:  # many ties and equal points
        points, centres = points.round(), centres.round()
    apart = plain(points, centres)
    own, best, computed = clustering.nearest(points, centres)
    assert np.allclose(best, apart.min(1)) and np.allclose(apart[np.arange(n), own], apart.min(1)) and n <= computed <= n * (k + 1)
    if coarse:
        assert (own == apart.argmin(1)).all()
    rows, found = clustering.within(points, centres, 0.9)
    want = apart <= apart.min(1, keepdims=True) / 0.9
    close = np.isclose(apart, apart.min(1, keepdims=True) / 0.9)
    got = np.zeros_like(want)
    got[rows, found] = True
    assert (got == want)[~close].all()


def test_distances_are_skipped():
    g = np.random.default_rng(1)
    centres = g.normal(size=(30, 8)) * 10
    points = centres[g.integers(0, 30, 3000)] + g.normal(size=(3000, 8))
    assert clustering.nearest(points, centres)[2] < 0.5 * 30 * 3000


def clouds(spark, n=600):
    g = np.random.default_rng(3)
    at = np.array([[0.0, 0.0], [9.0, 0.0], [0.0, 9.0]])
    rows = [(f"u{i}", "item", (at[i % 3] + g.normal(size=2)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "uri string, type string, vector array<double>"), at


@pytest.mark.parametrize("held", [True, False])
def test_rounds_of_all_sectors_at_once(spark, monkeypatch, held):
    """One round over two sectors and two runs in several buckets, against plain sums."""
    monkeypatch.setattr(clustering, "BUCKET", 100)
    rows, _ = clouds(spark)
    two = clustering.drawn(rows.withColumn("sector", F.when(F.substring("uri", 2, 9).cast("int") < 200, "a").otherwise("b")), 1)
    sizes = two.groupBy("sector").agg(F.count("*").alias("n")).withColumn("k", F.lit(3))
    points = clustering.bucketed(two, sizes)
    assert points.groupBy("sector", "bucket").count().count() == 6
    first = clustering.seeds(points, 2, 5)
    start = {}
    for r in first.collect():
        start.setdefault((r.sector, r.run), {})[r.part] = r.vector
    centres = first.toPandas() if held else first
    got = {}
    for r in clustering.step(points, centres).collect():
        got.setdefault((r.sector, r.run), {})[r.part] = r
    assert set(start) == set(got) and len(got) == 4
    for (sector, run), parts in got.items():
        x = np.array([r.vector for r in points.where(F.col("sector") == sector).collect()])
        apart = plain(x, np.array([start[sector, run][j] for j in sorted(start[sector, run])]))
        own = apart.argmin(1)
        for j, r in parts.items():
            assert r.n == (own == j).sum() and np.allclose(r.vector, x[own == j].mean(0)) and r.cost == pytest.approx((apart.min(1)[own == j] ** 2).sum())
        assert sum(r.n for r in parts.values()) == len(x) <= sum(r.computed for r in parts.values())


def test_cheapest_start_and_given_model(spark):
    rows, at = clouds(spark)
    got = sectors.assign(rows, 300, runs=3)
    assert got.count() == 600 and got.select("uri").distinct().count() == 600
    of = lambda df: {r.uri: r.sector for r in df.collect()}
    fixed = of(sectors.assign(rows, 300, iterations=0, initial=at.tolist()))
    for r in rows.collect():
        assert fixed[r.uri] == f"0.{plain(np.array([r.vector]), at).argmin()}"
    moved = of(sectors.assign(rows, 300, initial=(at + 1).tolist()))
    assert sum(moved[u] == fixed[u] for u in fixed) >= 590


@pytest.mark.parametrize("most", [clustering.MOST_HELD, 0])
def test_jobs_do_not_grow_with_sectors(spark, monkeypatch, most):
    """Twelve times the open sectors, the same jobs (as many rounds), with centres in the driver and in a table."""
    monkeypatch.setattr(clustering, "MOST_HELD", most)
    count = spark.sparkContext.statusTracker()

    def jobs(sectors_, name):
        rows, _ = clouds(spark, 1200)
        own = rows.withColumn("sector", F.pmod(F.xxhash64("uri"), F.lit(sectors_)).cast("string"))
        spark.sparkContext.setJobGroup(name, name)
        sizes = own.groupBy("sector").agg(F.count("*").alias("n")).withColumn("k", F.lit(3))
        points = clustering.bucketed(clustering.drawn(own, 1), sizes)
        got = clustering.split(points, clustering.fit(points, clustering.held(clustering.seeds(points, 1, 1), points, sizes, 1), 3, -1.0)).collect()
        assert len(got) == 1200 and len({(r.sector, r.part) for r in got}) == 3 * sectors_
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(count.getJobIdsForGroup(name))

    assert jobs(24, "many") <= jobs(2, "few") + 2  # plans differ by a job or two


def test_equal_points_and_hot_uris_are_dealt(spark):
    rows = spark.range(500).select(F.when(F.col("id") < 400, "same").otherwise(F.concat(F.lit("u"), "id")).alias("uri"), F.lit("item").alias("type"), F.array(F.lit(0.5), F.lit(0.5)).alias("vector"))
    got = sectors.assign(rows, 40)
    sizes = [r["count"] for r in got.groupBy("sector").count().collect()]
    assert sum(sizes) == 500 and max(sizes) <= 40


def test_empty_table(spark):
    none = spark.createDataFrame([("a", "item", None)], "uri string, type string, vector array<double>")
    assert sectors.assign(none, 40).isEmpty() and sectors.assign(none.limit(0), 40).isEmpty()


def test_few_rows_take_few_tasks(spark):
    """A round has no more tasks than its rows are worth, whatever the number of shuffle partitions."""
    rows = clustering.drawn(spark.range(200).select(F.col("id").cast("string").alias("uri"), F.lit("item").alias("type"), F.array(F.rand(1), F.rand(2)).alias("vector"), F.lit("0").alias("sector")), 1)
    sizes = spark.createDataFrame([("0", 200, 2)], "sector string, n long, k int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        points = clustering.bucketed(rows, sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert points.count() == 200 and points.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
