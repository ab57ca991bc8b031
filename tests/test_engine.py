import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwork.operators import corpus, graph, sectors, shapes, similarity, topics
from loomwork.plans.config import Config, Criteria
from loomwork.plans.engine import Domain
from loomwork.sources import store as store_module
from loomwork.sources.store import SCHEMAS, Store
from loomwork.streaming import events as E


# The example graph.
EDGES = [
    ("uri1", "uri3", 0.5), ("uri3", "uri6", 0.5), ("uri1", "uri4", 0.8), ("uri4", "uri7", 0.5), ("uri4", "uri6", 0.9), ("uri2", "uri4", 0.5),
    ("uri4", "uri5", 0.5), ("uri4", "uri3", 0.8), ("uri6", "uri9", 0.8), ("uri7", "uri9", 0.8), ("uri5", "uri7", 0.5),
]


def test_basic_k():
    ks = [topics.basic(n, Config()).k for n in (1, 2, 8, 50, 200, 5000)]
    assert ks == [2, 2, 4, 10, 20, 100]
    assert topics.pareto([(1, 3), (2, 2), (3, 1), (3, 3)]) == [0, 1, 2]


def test_graph_edges(spark):
    g = spark.createDataFrame(EDGES, "src string, dst string, score double")
    assert graph.bfs(g, ["uri1"], ["uri1"]).first().nodes == ["uri1"]
    assert graph.bfs(g, ["uri1"], ["uri2"]).isEmpty() and graph.hops(g, "uri1", "uri10").isEmpty() and graph.shortest(g, "uri1", "uri8").isEmpty()
    assert graph.bfs(g, ["uri1"], ["uri9"], max_length=2).isEmpty()
    assert {tuple(r.nodes) for r in graph.bfs(g, ["uri1"], ["uri9"], 0.1).collect()} == {
        ("uri1", "uri3", "uri6", "uri9"), ("uri1", "uri4", "uri6", "uri9"), ("uri1", "uri4", "uri7", "uri9")
    }
    (best,) = graph.shortest(g, "uri1", "uri9").collect()
    assert best.nodes == ["uri1", "uri3", "uri6", "uri9"] and best.cost == pytest.approx(1.8) and graph.hops(g, "uri1", "uri9").first().hops == 3
    (near,) = graph.shortest(g, "uri1", "uri9", weight="1-score").collect()
    assert near.nodes == ["uri1", "uri4", "uri6", "uri9"] and near.cost == pytest.approx(0.5)
    nodes = graph.vertices_of(spark.createDataFrame([("uri1", "item")], "uri string, type string"), g)
    assert nodes.count() == 8 and nodes.where("name = 'Missing'").count() == 7


def test_sectors_are_bounded(spark):
    rows = spark.range(300).select(
        F.concat(F.lit("items/"), "id").alias("uri"), F.lit("item").alias("type"),
        F.when(F.col("id") < 150, F.array(F.lit(0.5), F.lit(0.5))).otherwise(F.array(F.col("id") / 300, 1 - F.col("id") / 300)).alias("vector"),
    )
    got = sectors.assign(rows, 40)
    assert got.count() == 300 and got.groupBy("sector").count().agg(F.max("count")).first()[0] <= 40


def test_empty_and_null_shapes(spark):
    rows = spark.createDataFrame([("a", "item", "s", [0.5, 0.5]), ("b", "item", "s", None), ("c", "item", "s", [0.0, 0.0])], "uri string, type string, sector string, vector array<double>")
    assert [r.topic for r in shapes.dominant(rows).orderBy("uri").collect()] == [1, None, None]
    assert similarity.in_sector(rows.where("uri <> 'c'")).isEmpty()
    with pytest.raises(ValueError):
        graph.joined_sectors([rows.where("uri = 'a'").select("uri"), rows.where("uri = 'b'").select("uri")])


def test_domain(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(120)
    rows = docs.select(F.concat(F.lit("d/items/"), "doc_id").alias("resource"), F.col("text").alias("tokens"), F.lit("d").alias("domain"), F.lit("item").alias("type"))
    rows = rows.unionByName(spark.createDataFrame([("d/items/empty", None, "d", "item")], rows.schema))
    d = Domain(spark, Store(spark, str(tmp_path / "d")), "d", Config(max_iterations=3, optimizer="manual", topics=4, sector_size=50))
    members = rows.select(F.lit("d/domains/x").alias("subdomain"), F.col("resource").alias("uri"))
    d.build(rows, members)
    own = d.store.read("shapes")
    assert own.count() == 122
    sums = {r.uri: sum(r.vector) for r in own.collect()}
    assert sums.pop("d/items/empty") == 0 and all(abs(s - 1) < 1e-6 for s in sums.values())
    assert d.store.read("distributions").count() == 122 * 4
    assert d.store.read("clusters").groupBy("cluster").count().agg(F.max("count")).first()[0] <= 50
    assert d.topics(5).count() == 4 and d.store.read("tags").groupBy("word").count().where("count > 1").isEmpty()
    uri = next(u for u in sums if "items" in u)
    assert d.topic_mix(uri).count() == 4 and d.tags(uri).count() <= 10
    similar = d.similar_to(uri, Criteria(max=3, threshold=0.1)).collect()
    assert [r.score for r in similar] == sorted((r.score for r in similar), reverse=True)
    text = rows.where(F.col("resource") == uri).first().tokens
    assert d.similar_to_text(text, Criteria(max=1)).first().score > 0.9
    assert d.similar_to_text("  ").isEmpty()
    if similar:
        assert d.path(uri, similar[0].uri, Criteria(threshold=0.1)).first().nodes[0] == uri
    before = own.count()
    d.shape(rows.where(F.col("resource") == uri).withColumn("tokens", F.lit("")))
    assert d.store.read("shapes").count() == before and d.store.read("events").count() == 1
    assert sum(d.store.read("shapes").where(F.col("uri") == uri).first().vector) == 0
    assert d.similar_to(uri).isEmpty() and d.store.read("subgraph_nodes").where(F.col("uri") == uri).isEmpty()
    d.shape(rows.where(F.col("resource") == uri).unionByName(rows.limit(3)))  # back again; what was refreshed equals what is formed anew
    fresh = similarity.in_sector(d.store.read("subgraph_nodes"), both_ways=True)
    pair = ["resource_uri_1", "resource_uri_2", "sector", F.round("score", 9)]
    assert sorted(d.store.read("subgraph_edges").select(*pair).collect()) == sorted(fresh.select(*pair).collect())
    assert d.store.read("similarities").count() == fresh.count() and d.store.read("distributions").count() == 122 * 4
    means = {r.uri: r.vector for r in sectors.centroids(d.store.read("subgraph_nodes")).collect()}
    kept = {r.uri: r.vector for r in d.store.read("centroids").collect()}
    assert kept.keys() == means.keys() and all(kept[u] == pytest.approx(means[u]) for u in means)
    assert d.store.read("clusters").count() == d.store.read("subgraph_nodes").count()
    d.store.truncate("events")
    d.store.append("events", spark.createDataFrame([("shape.created", uri, "")], "key string, resource string, time string"))
    assert d.compare_topics(d, 10).count() == 16
    assert d.item_of_document("nope") == ""
    assert '"id":"domains/d"' in d.announce() and d.store.read("events").count() == 2
    d.delete()
    assert not d.store.exists("shapes")


def test_streaming_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", f"r{i % 7}") for i in range(30)] + [("b", "r1")], "domain string, resource string").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("domain string, resource string").parquet(src)
    got = []
    q = E.run_each(E.batches(stream, most=5, delay_ms=500), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp"), once=False)
    end = time.time() + 40
    while time.time() < end and not any(r.reason == "delay" for r in got):
        time.sleep(0.5)
    q.stop()
    full = [r for r in got if r.reason == "full"]
    assert full and all(len(r.resources) == 5 for r in full)
    assert E.acknowledged(spark.createDataFrame(full)).count() == 5 * len(full)
    late = [r for r in got if r.domain == "b"]
    assert late and late[0].resources == ["r1"] and late[0].reason == "delay"


def test_store_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    tags = lambda *rows: spark.createDataFrame(rows, "word string, score double")
    assert store.read("tags").isEmpty()
    store.append("tags", tags(("a", 1.0), ("b", 2.0)))
    early = store.read("tags")
    store.upsert("tags", tags(("b", 3.0), ("c", 4.0)))
    assert early.count() == 2 and sorted(map(tuple, store.read("tags").collect())) == [("a", 1.0), ("b", 3.0), ("c", 4.0)]
    torn = tmp_path / "s" / "tags" / "v00000009"  # of a writer that was lost
    torn.mkdir()
    assert store.read("tags").count() == 3
    store.write("tags", store.read("tags").where("score > 3"))
    assert [r.word for r in store.read("tags").collect()] == ["c"] and not torn.exists()
    store.truncate("tags")
    assert not store.exists("tags")


def test_dispatcher(spark, tmp_path):
    class Fake:
        def __init__(self, name):
            self.name, self.store, self.did = name, self, []

        def exists(self, _):
            return self.name != "untrained"

        def delete(self):
            self.did.append("delete")

        def build(self, rows, members):
            self.did.append("build")

        def shape(self, rows, batch=None):
            self.did.append(sorted(r.resource for r in rows.collect()))

    got = {n: Fake(n) for n in ("a", "b", "c", "untrained")}
    rows = spark.createDataFrame([(f"r{i}", "", n, "item") for n in got for i in range(5)], "resource string, tokens string, domain string, type string")
    members = spark.createDataFrame([("s1", "r3"), ("s1", "r4"), ("s2", "r0")], "subdomain string, uri string")
    sent = [
        ("resource.added", "a", "r1", 1), ("item.updated", "a", "r1", 2), ("subdomain.added", "a", "s1", 3), ("domain.completed", "a", "a", 4),
        ("domain.deleted", "b", "b", 1), ("domain.pending", "b", "b", 2), ("item.updated", "b", "r1", 3),
        ("domain.pending", "c", "c", 1), ("domain.deleted", "c", "c", 2), ("resource.added", "untrained", "r1", 1),
    ]
    schema = "key string, domain string, resource string, ts long"
    spark.createDataFrame(sent, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    E.run_each(stream, E.Dispatcher(got.__getitem__, lambda: rows, lambda: members), str(tmp_path / "cp")).awaitTermination(90)
    assert {n: d.did for n, d in got.items()} == {"a": [["r1", "r3", "r4"]], "b": ["build"], "c": ["delete"], "untrained": ["build"]}


def test_streaming_sessions(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT 'a' AS domain, timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * 10) AS ts FROM range(5) UNION ALL SELECT 'a', timestamp'2024-01-01 02:00:00'").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("domain string, ts timestamp").parquet(src)
    got = []
    E.run_each(E.debounced(stream, "30 seconds", late="1 minute"), lambda df, _: got.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(90)
    assert [r.n for r in got] == [5]


def test_corpus_sources(spark):
    texts = corpus.of_texts(spark, [("a", "Hello world")])
    assert texts.first().content == "Hello world"
    rows = spark.createDataFrame([("items/1", " ", "d", "item"), ("items/2", "x\ny", "d", "item")], "resource string, tokens string, domain string, type string")
    assert corpus.filled(rows).where("tokens = ''").count() == 1
    assert corpus.scan_types(rows, "d", ["part"]).isEmpty()
    assert corpus.tokens_of(rows, "items/2").first().tokens == "x\ny"
    assert [r.resource for r in corpus.parts(rows).collect()] == ["items/1-0", "items/2-0", "items/2-1"]


def test_paths_keep_to_the_wanted_types(spark):
    rows = [("a", "item", [0.9, 0.1]), ("b", "part", [0.6, 0.4]), ("c", "item", [0.5, 0.5]), ("d", "item", [0.1, 0.9])]
    shapes_ = spark.createDataFrame(rows, "uri string, type string, vector array<double>")
    sectored = shapes_.withColumn("sector", F.lit("0"))
    pairs = similarity.in_sector(sectored, both_ways=True)
    one = lambda **k: [r.nodes for r in graph.two_level(shapes_, sectors.membership(sectored), pairs, sectors.centroids(sectored), "a", "d", least=0.8, **k).collect()]
    assert {tuple(n) for n in one()} == {("a", "c", "d"), ("a", "b", "c", "d")} and one(max_results=1) == one()[:1]
    assert one(types=["item"]) == [["a", "c", "d"]] and one(types=["part"]) in ([["a", "b", "d"]], [])
    assert graph.across_joined_sectors(sectored.unionByName(sectored.withColumn("sector", F.lit("1"))), pairs.unionByName(pairs.withColumn("sector", F.lit("1"))), ["0", "1"], "a", "d", 0.8).first().nodes[0] == "a"


def test_sector_numbers_are_dense(spark):
    rows = spark.createDataFrame([("x", "Aa"), ("y", "BB"), ("z", "Aa")], "uri string, sector string")  # their hashes collide
    assert {(r.uri, r.cluster) for r in sectors.numbered(rows).collect()} == {("x", 0), ("z", 0), ("y", 1)}


def test_small_changes_are_deltas(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    corpus = spark.range(30_000).select(F.concat(F.lit("r"), "id").alias("resource"), F.sha2(F.col("id").cast("string"), 256).alias("tokens"), F.lit("d").alias("domain"), F.lit("item").alias("type"))
    store.write("corpus", corpus)
    base, early = store.bytes("corpus", deltas=False), store.read("corpus")
    for k in range(5):
        store.upsert("corpus", spark.createDataFrame([(f"r{k}", "new", "d", "item"), (f"s{k}", "new", "d", "item")], SCHEMAS["corpus"]))
    assert store.bytes("corpus", deltas=False) == base and store.bytes("corpus", deltas=True) < base / 20
    assert early.count() == 30_000 and early.where("tokens = 'new'").isEmpty()  # its readers are unharmed
    now = store.read("corpus")
    assert now.count() == 30_005 and now.where("tokens = 'new'").count() == 10 and now.groupBy("resource").count().where("count > 1").isEmpty()
    torn = [p for p in (tmp_path / "s" / "corpus").glob("v*.000004*/come/_SUCCESS")]
    assert len(torn) == 1
    torn[0].unlink()  # a writer that was lost before the end of its delta
    assert store.read("corpus").count() == 30_004
    store.upsert("corpus", spark.createDataFrame([("r4", "again", "d", "item")], SCHEMAS["corpus"]))
    assert store.read("corpus").count() == 30_004 and store.read("corpus").where("resource = 'r4'").first().tokens == "again"


def test_deltas_are_merged_and_batches_count_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "MOST_DELTAS", 4)
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    event = lambda x: spark.createDataFrame([("k", x, "")], SCHEMAS["events"])
    store.append("events", event("a"), "batch0")
    for _ in range(2):
        store.append("events", event("b"), "batch1")
    assert sorted(r.resource for r in store.read("events").collect()) == ["a", "b"]
    for x in "cdefg":
        store.append("events", event(x))
    assert sorted(r.resource for r in store.read("events").collect()) == list("abcdefg")
    assert len(list((tmp_path / "s" / "events").glob("v*.*"))) < 8 and store._current("events") > 0
    pairs = [("a", "b"), ("a", "c"), ("b", "c")]
    edges = spark.createDataFrame([(x, y, 0.5, "item", "item", "0") for x, y in pairs], SCHEMAS["subgraph_edges"])
    store.write("subgraph_edges", edges)
    ends = [spark.createDataFrame([("a",)], f"resource_uri_{n} string") for n in (1, 2)]
    store.replace("subgraph_edges", ends, edges.where("resource_uri_2 = 'b'"))
    assert sorted(r[:2] for r in store.read("subgraph_edges").collect()) == [("a", "b"), ("b", "c")]


def test_counters_count_a_batch_once(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create()
    assert store.counted("items") == 0
    for batch, n in (("1", 5), ("2", 7), ("1", 5), ("2", 7), ("2", 7)):
        store.count("items", n, batch)
    store.count("parts", 3, "1")
    assert (store.counted("items"), store.counted("parts")) == (12, 3)
    store.reset("items")
    assert (store.counted("items"), store.counted("parts")) == (0, 3)


def test_sampled_column_cosines(spark):
    g = np.random.default_rng(5)
    base = g.random((6000, 3))
    dense = np.hstack((base, np.clip(base + 0.3 * g.random((6000, 3)), 0, 1), np.where(g.random((6000, 4)) < 0.02, 1.0, 0.0), np.zeros((6000, 1))))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(dense)] + [(-1, None)], "id long, vector array<double>")
    norm = np.linalg.norm(dense, axis=0)
    true = dense.T @ dense / np.maximum(np.outer(norm, norm), 1e-9)
    sampled = lambda least, more=10.0: {(r.i, r.j): r.score for r in similarity.column_cosines_sampled(rows, "vector", "id", least, more).collect()}
    got = sampled(0.5)
    root = np.sqrt(10 * np.log(10) / 0.5)
    assert root < norm[:6].min()  # the dense columns are sampled
    for i in range(11):
        for j in range(i + 1, 11):
            slack = 5 * np.sqrt(max(true[i, j], 0.01) / root**2)
            if true[i, j] > 0.5 + slack:
                assert abs(got[i, j] - true[i, j]) < slack
            elif true[i, j] < 0.5 - slack:
                assert (i, j) not in got
    assert sampled(0.5) == got  # draws repeat
    exact = sampled(0.5, 1e6)
    assert set(exact) == {(i, j) for i in range(11) for j in range(i + 1, 11) if true[i, j] > 0.5}
    assert all(abs(x - true[p]) < 1e-9 for p, x in exact.items())
    assert similarity.column_cosines_sampled(rows.limit(0), "vector", "id", 0.5).count() == 0
