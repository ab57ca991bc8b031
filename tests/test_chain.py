"""Orders that are held back, and events that drive a real domain from pending to answers."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from loomwork.plans.config import Config, Criteria
from loomwork.plans.engine import STAGES, Domain
from loomwork.sources.store import Store
from loomwork.streaming import chain as C
from loomwork.streaming import events as E

EVENTS = "key string, domain string, resource string, ts timestamp"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(second):
    return dt.datetime(2024, 1, 1, 0, 0, second)


def wait(seconds, *done):
    end = time.time() + seconds
    while time.time() < end and not all(d() for d in done):
        time.sleep(0.3)
    return all(d() for d in done)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.unset(key)


def test_held_orders(spark, rocks, tmp_path):
    src, got = str(tmp_path / "in"), []
    put = lambda *rows: spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(src)
    put(("item.updated", "b", "b1", at(1)), ("domain.pending", "a", None, at(1)), ("item.updated", "a", "a1", at(2)))
    stream = E.held(spark.readStream.schema(EVENTS).parquet(src), delay_ms=15_000)
    q = E.run_each(stream, lambda df, _: got.extend(map(tuple, df.select("domain", "action", "resource").collect())), str(tmp_path / "cp"), once=False)
    try:
        assert wait(60, lambda: ("b", "shape", "b1") in got), (got, q.exception())  # nothing awaited there: at once
        put(("domain.pending", "a", None, at(5)), ("domain.pending", "a", None, at(1)))  # restarts the delay; the repeated one does nothing
        assert wait(60, lambda: ("a", "train", None) in got), (got, q.exception())
        assert ("a", "shape", "a1") not in got  # the training has taken it in
        before = len(got)
        put(("domain.pending", "a", None, at(5)), ("item.updated", "a", "a1", at(2)), ("item.updated", "a", "a2", at(9)))  # repeated, late, new
        assert wait(60, lambda: ("a", "shape", "a2") in got)
        time.sleep(17)
        assert got[before:] == [("a", "shape", "a2")]
        put(("domain.pending", "a", None, at(20)), ("domain.deleted", "a", None, at(21)))
        assert wait(60, lambda: any(g[1] == "destroy" for g in got))
        time.sleep(17)
        assert sum(g[1] == "train" for g in got) == 1  # called off
    finally:
        q.stop()


def test_events_drive_a_domain(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60")
    rows = docs.select(F.concat(F.lit("d/items/"), "doc_id").alias("resource"), F.col("text").alias("tokens"), F.lit("d").alias("domain"), F.lit("item").alias("type"))
    members = rows.select(F.lit("d/domains/x").alias("subdomain"), F.col("resource").alias("uri"))
    stages = []

    class Watched(Domain):
        def stage(self, name, *tables):
            stages.append(name)
            if name == "shapes" and stages.count(name) == 1:
                raise ConnectionError("lost")  # the driver goes down in a stage
            super().stage(name, *tables)

    domain = lambda name: Watched(spark, Store(spark, str(tmp_path / name)), name, Config(max_iterations=2, optimizer="manual", topics=4, sector_size=50))
    chain = C.Chain(spark, str(tmp_path / "chain"), domain, lambda: rows, lambda: members)
    work = E.Dispatcher(domain, lambda: rows, lambda: members, chain)
    order = spark.createDataFrame([("d", "train", "domain.pending", None, at(1))], E.HELD)
    work(order, 7)
    work(order, 7)  # the batch is repeated
    names, checkpoint = [n for n, _ in STAGES], str(tmp_path / "cp")
    with pytest.raises(Exception, match="lost"):
        for _ in names:
            E.run_each(chain.events(), chain, checkpoint).awaitTermination()
    assert stages == ["model", "tags", "shapes"] and [r.stage for r in chain.done("d").orderBy("stage").collect()] == ["model", "tags"]
    q = E.run_each(chain.events(), chain, checkpoint, once=False)  # begun again, it goes on by itself
    try:
        assert wait(180, lambda: chain.done("d").count() == len(names))
    finally:
        q.stop()
    assert stages == ["model", "tags", "shapes", *names[2:]]
    d = domain("d")
    uri = d.store.read("subgraph_nodes").where("type = 'item'").first().uri
    answer = d.similar_to(uri, Criteria(max=3, threshold=0.0)).collect()
    assert 0 < len(answer) <= 3 and d.store.read("shapes").where("type = 'domain'").count() == 1
    counts = {t: d.store.read(t).count() for t in ("shapes", "similarities", "annotations", "topics")}
    for key, name in C.NEXT.items():  # every event once more: nothing changes
        chain(spark.createDataFrame([(key, "d", 7)], C.EVENT), 99)
    assert stages == ["model", "tags", "shapes", *names[2:]] and counts == {t: d.store.read(t).count() for t in counts}
    chain.control.upsert("progress", spark.createDataFrame([("d", 8, "model")], "domain string, version long, stage string"))
    chain.step("model.trained", "d", 6)  # an older build gives way
    assert len(stages) == 3 + len(names[2:])
