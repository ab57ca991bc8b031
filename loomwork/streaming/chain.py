"""A build whose stages call each other by events.

Each stage that is done leaves an event in a folder; a stream over that folder runs
the stage after it. A control table has a row for every (domain, version, stage)
done, where the version is the number of the batch that began the build. A stage
that the table has is not run again, a build gives way to a newer one of its
domain, and an event is one file of a fixed name, so a batch that is repeated after a
lost driver changes nothing, and a build goes on where it was.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.plans.engine import STAGES
from loomwork.sources.store import Store

EVENT = "key string, domain string, version long"
#: What begins a build, and the stage that follows each event.
BEGIN = "training.due"
NEXT = dict(zip([BEGIN, *(done for _, done in STAGES)], [*(name for name, _ in STAGES), None]))
DONE = dict(STAGES)


class Chain:
    """domain: the domain of a name; folder: where events and the control table are; resources, subdomains: the present tables."""

    def __init__(self, spark: SparkSession, folder: str, domain: Callable, resources: Callable[[], DataFrame], subdomains: Callable[[], DataFrame] | None = None):
        self.spark, self.folder, self.domain = spark, folder.rstrip("/"), domain
        self.resources, self.subdomains = resources, subdomains
        self.control = Store(spark, f"{self.folder}/control")
        self._fs(f"{self.folder}/events").mkdirs(self._path(f"{self.folder}/events"))

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _send(self, key: str, domain: str, version: int) -> None:
        """One file, once: written beside the folder and moved into it."""
        name = f"{_name(domain)}-{version:012d}-{key}.json"
        fs, target = self._fs(self.folder), self._path(f"{self.folder}/events/{name}")
        if fs.exists(target):
            return
        part = self._path(f"{self.folder}/{name}.part")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({"key": key, "domain": domain, "version": version}).encode()))
        out.close()
        fs.rename(part, target)

    def begin(self, domain: str, version: int) -> None:
        self._send(BEGIN, domain, version)

    def events(self) -> DataFrame:
        """The stream to hand to run_each() together with this chain."""
        return self.spark.readStream.schema(EVENT).json(f"{self.folder}/events")

    def done(self, domain: str) -> DataFrame:
        return self.control.read("progress").where(F.col("domain") == domain)

    def __call__(self, batch: DataFrame, number: int) -> None:
        for e in batch.where(F.col("key").isin(list(NEXT))).distinct().orderBy("domain", "version").collect():  # one a build at a time
            self.step(e.key, e.domain, e.version)

    def step(self, key: str, domain: str, version: int) -> None:
        name = NEXT[key]
        if name is None:
            return
        before = self.done(domain)
        if not before.where(F.col("version") > version).isEmpty():
            return  # a newer build of the domain has begun
        if before.where((F.col("version") == version) & (F.col("stage") == name)).isEmpty():
            self.domain(domain).stage(name, self.resources(), self.subdomains() if self.subdomains else None)
            self.control.upsert("progress", self.spark.createDataFrame([(domain, version, name)], "domain string, version long, stage string"))
        self._send(DONE[name], domain, version)


def _name(domain: str) -> str:
    """A domain's name as one of a file."""
    return domain.encode().hex()
