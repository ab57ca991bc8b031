"""Domain events: debounced retraining and micro-batched shaping.

Each operator takes a batch or a streaming DataFrame of events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from loomwork.plans.shipping import ship


def debounced(events: DataFrame, gap: str = "30 seconds", late: str | None = None, key: str = "domain", ts: str = "ts") -> DataFrame:
    """One row per burst of events of a domain: the job runs a gap after the last of them."""
    rows = events.withWatermark(ts, late) if late else events
    burst = F.session_window(ts, gap)
    got = rows.groupBy(burst, key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("session_window.start").alias("first"), F.col("session_window.end").alias("due"), "n")


def flushed(events: DataFrame, most: int = 1000, key: str = "domain", item: str = "resource", ts: str = "ts") -> DataFrame:
    """Batch form of the micro-batch: the k-th batch of a domain holds its resources (most-1)k+1.. by first appearance."""
    firsts = events.groupBy(key, item).agg(F.min(ts).alias(ts))
    place = F.row_number().over(Window.partitionBy(key).orderBy(ts, item)) - 1
    batch = F.floor(place / most).cast("long").alias("batch")
    return firsts.select(key, batch, item).groupBy(key, "batch").agg(F.count("*").alias("n"), F.min(item).alias("first"), F.max(item).alias("last"))


BATCH = "domain string, resources array<string>, reason string"


def batches(events: DataFrame, most: int = 1000, delay_ms: int = 30_000) -> DataFrame:
    """Streaming form: distinct resources gather in state and are passed on at `most`, or `delay_ms` after the last event.

    events: domain, resource. The state of a domain is bounded by `most` resources.
    """

    def step(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        out = []
        if state.hasTimedOut:
            out.append((key[0], sorted(held), "delay"))
            state.remove()
            held = []
        else:
            known = set(held)
            for pdf in pdfs:
                for r in pdf["resource"]:
                    if r not in known:
                        known.add(r)
                        held.append(r)
                    if len(held) >= most:
                        out.append((key[0], sorted(held), "full"))
                        held, known = [], set()
            if held:
                state.update((held,))
                state.setTimeoutDuration(delay_ms)
            elif state.exists:
                state.remove()
        if out:
            yield pd.DataFrame(out, columns=["domain", "resources", "reason"])

    ship(events.sparkSession)
    return events.groupBy("domain").applyInPandasWithState(step, BATCH, "held array<string>", "append", GroupStateTimeout.ProcessingTimeTimeout)


# Routing keys of events, and what a domain does about them.
ACTIONS = {
    "domain.pending": "train", "domain.completed": "none", "domain.deleted": "destroy", "resource.added": "shape",
    "item.updated": "shape", "part.updated": "shape", "subdomain.added": "shape",
}


def routed(events: DataFrame, pending: DataFrame | None = None) -> DataFrame:
    """events (key, domain, resource, ts) with `action`; shaping gives way to a retraining that is pending (domain)."""
    table = F.create_map(*(F.lit(x) for kv in ACTIONS.items() for x in kv))
    rows = events.withColumn("action", F.coalesce(table[F.col("key")], F.lit("none")))
    if pending is None:
        return rows
    waits = rows.join(F.broadcast(pending.select("domain").distinct().withColumn("p", F.lit(1))), "domain", "left")
    return waits.withColumn("action", F.when((F.col("action") == "shape") & F.col("p").isNotNull(), "train").otherwise(F.col("action"))).drop("p")


HELD = "domain string, action string, key string, resource string, ts timestamp"


class _Pending(StatefulProcessor):
    """State of a domain: events (as of their own time) up to which it is trained, and up to which a training is awaited."""

    def __init__(self, delay_ms: int):
        self.delay = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getValueState("times", "trained timestamp, asked timestamp")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        trained, asked = self.times.get() if self.times.exists() else (None, None)
        out, newest = [], asked
        for e in pd.concat(rows).sort_values(["ts", "key", "resource"]).itertuples(index=False):
            action = ACTIONS.get(e.key, "none")
            late = trained is not None and e.ts <= pd.Timestamp(trained)  # the last training has taken it in
            if action == "destroy":
                trained = asked = newest = None
                out.append((key[0], action, e.key, e.resource, e.ts))
            elif action == "train" and not late:
                newest = e.ts if newest is None else max(pd.Timestamp(newest), e.ts)
            elif action == "shape" and not late and newest is None:
                out.append((key[0], action, e.key, e.resource, e.ts))  # else the training that is awaited takes it in
        if newest != asked or newest is None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if newest is not None:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.delay)
        self.times.update((_plain(trained), _plain(newest)))
        yield pd.DataFrame(out, columns=["domain", "action", "key", "resource", "ts"])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, asked = self.times.get()
        self.times.update((asked, None))
        yield pd.DataFrame([(key[0], "train", "domain.pending", None, asked)], columns=["domain", "action", "key", "resource", "ts"])

    def close(self) -> None:
        pass


def _plain(ts):
    return ts.to_pydatetime() if isinstance(ts, pd.Timestamp) else ts


def held(events: DataFrame, delay_ms: int = 30_000) -> DataFrame:
    """events (key, domain, resource, ts; a stream) -> what is due: domain, action, key, resource, ts.

    An order to train is held back until `delay_ms` have passed without a newer one; each newer one restarts the delay. Shaping gives
    way to a training that is awaited. Events no newer than the last training are late or repeated and do nothing; so does a repeated order while
    its training is awaited. An order to destroy is due at once and calls off the training. The state of a domain is two times.
    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    ship(events.sparkSession)
    rows = events.select("domain", "key", "resource", "ts")
    return rows.groupBy("domain").transformWithStateInPandas(_Pending(delay_ms), HELD, "append", "processingTime")


def acknowledged(batch: DataFrame) -> DataFrame:
    """A shape.created event for each resource of a passed-on batch."""
    return batch.select(F.lit("shape.created").alias("key"), F.explode("resources").alias("resource"), "domain")


class Dispatcher:
    """What events ask of their domains, done for every micro-batch of a stream (the `work` of run_each).

    domain: the domain of a name; resources and subdomains: the present tables (resource, tokens, domain, type) and (subdomain, uri).
    The last order to train or destroy in a batch comes first, by time; then its domain's resources are shaped, unless it has just been
    trained on them. A domain without a model is trained instead. Every action may be repeated, as a batch is after a lost driver.
    Only names of domains reach the driver, not resources. Rows of held() have their action already.

    chain: where it is given (streaming.chain), a build is begun there and goes on by events of its own; the number of the batch is its version.
    """

    def __init__(self, domain: Callable, resources: Callable[[], DataFrame], subdomains: Callable[[], DataFrame] | None = None, chain=None):
        self.domain, self.resources, self.subdomains, self.chain = domain, resources, subdomains, chain

    def __call__(self, batch: DataFrame, number: int) -> None:
        rows = (batch if "action" in batch.columns else routed(batch)).where("action <> 'none'")
        order = F.max_by("action", F.when(F.col("action") != "shape", F.struct("ts", "action")))
        for row in rows.groupBy("domain").agg(order.alias("order")).orderBy("domain").collect():
            d = self.domain(row.domain)
            if row.order == "destroy":
                d.delete()
            elif self.chain and (row.order == "train" or not d.store.exists("topics")):
                self.chain.begin(row.domain, number)
            elif row.order == "train" or not d.store.exists("topics"):
                d.build(self.resources(), self.subdomains() if self.subdomains else None)
            else:
                self._shape(d, rows.where((F.col("domain") == row.domain) & (F.col("action") == "shape")), f"batch{number}")

    def _shape(self, d, asked: DataFrame, batch: str) -> None:
        wanted = asked.where("key <> 'subdomain.added'").select("resource")
        if self.subdomains:
            inside = self.subdomains().join(asked.where("key = 'subdomain.added'").select(F.col("resource").alias("subdomain")), "subdomain", "left_semi")
            wanted = wanted.union(inside.select("uri"))
        d.shape(self.resources().where(F.col("domain") == d.name).join(wanted.distinct(), "resource", "left_semi"), batch)


def run_each(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Start a query that hands every micro-batch to `work`."""
    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
