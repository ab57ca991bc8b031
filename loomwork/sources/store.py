"""A domain's tables as Parquet below one folder, and the models beside them.

Schemas are declared, never inferred. Sector sub-graphs are partitioned by
sector, so reading one sector prunes to its folder. A table is a folder of
versions; the last one that Spark has marked as complete counts, so a writer
lost at any time leaves the version before. That one is kept for its readers.

A small change does not write a version but a delta beside it: the keys of the
rows that go and the rows that come. Readers merge a version with its complete
deltas in their order. When these are many or large, the next change writes a new version.
A delta of a batch has the batch's name, so a batch that is repeated adds nothing.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The tables of a domain.
SCHEMAS = {
    "corpus": "resource string, tokens string, domain string, type string",
    "topics": "uri string, id long, description string, elements array<string>, scores array<double>, date string",
    "shapes": "id long, uri string, type string, vector array<double>, date string",
    "centroids": "id long, uri string, type string, vector array<double>, date string",
    "distributions": "resource_uri string, resource_type string, topic_uri string, score double, date string",
    "annotations": "resource_uri string, resource_type string, type string, value string, score double, date string",
    "similarities": "resource_uri_1 string, resource_type_1 string, resource_uri_2 string, resource_type_2 string, score double, date string",
    "centroid_similarities": "resource_uri_1 string, resource_type_1 string, resource_uri_2 string, resource_type_2 string, score double, date string",
    "comparisons": "domain_uri string, domain_topic_uri string, topic_uri string, score double, date string",
    "tags": "word string, score double",
    "clusters": "uri string, cluster long",
    "shapes_by_topic": "uri string, vector array<double>, topic long, type string",
    "bundles": "starturi string, enduri string",
    "subgraph_nodes": "uri string, type string, vector array<double>, sector string",
    "subgraph_edges": "resource_uri_1 string, resource_uri_2 string, score double, resource_type_1 string, resource_type_2 string, sector string",
    "events": "key string, resource string, time string",
    "progress": "domain string, version long, stage string",
    "counters": "name string, batch string, n long",
}
PARTITIONED = {"subgraph_nodes": ["sector"], "subgraph_edges": ["sector"], "shapes_by_topic": ["topic", "type"]}
KEYED = {"corpus": ["resource"], "shapes": ["uri"], "centroids": ["uri"], "topics": ["uri"], "tags": ["word"], "clusters": ["uri", "cluster"], "progress": ["domain", "version", "stage"], "counters": ["name", "batch"]}

#: Deltas of a version before the next change merges them, by number and by size (then as large as the version, and so many bytes at least).
MOST_DELTAS, LEAST_BYTES = 16, 1 << 20


@dataclass
class Store:
    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _folders(self, name: str) -> list[str]:
        fs, path = self._fs()
        top = path(self.path(name))
        return sorted(f.getPath().getName() for f in fs.listStatus(top)) if fs.exists(top) else []

    def _versions(self, name: str) -> list[int]:
        """Numbers of all versions of a table, complete or not, ascending."""
        return [int(f[1:]) for f in self._folders(name) if "." not in f]

    def _version_path(self, name: str, version: int) -> str:
        return f"{self.path(name)}/v{version:08d}"

    def _complete(self, folder: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(f"{folder}/_SUCCESS"))

    def _current(self, name: str) -> int | None:
        return next((v for v in reversed(self._versions(name)) if self._complete(self._version_path(name, v))), None)

    def _deltas(self, name: str, version: int) -> list[str]:
        """Complete deltas of a version, in their order."""
        first = f"v{version:08d}."
        return [f for f in (f"{self.path(name)}/{x}" for x in self._folders(name) if x.startswith(first)) if self._complete(f"{f}/come")]

    def bytes(self, name: str, deltas: bool | None = None) -> int:
        """Size of the present version with its deltas, or of its deltas alone (True), or of itself alone (False)."""
        fs, path = self._fs()
        version = self._current(name)
        if version is None:
            return 0
        wanted = ([] if deltas else [self._version_path(name, version)]) + ([] if deltas is False else self._deltas(name, version))
        return sum(fs.getContentSummary(path(f)).getLength() for f in wanted)

    def exists(self, name: str) -> bool:
        return self._current(name) is not None

    def read(self, name: str) -> DataFrame:
        """The table, empty where nothing has been written."""
        version = self._current(name)
        if version is None:
            return self.spark.createDataFrame([], SCHEMAS[name])
        of = lambda folder: self.spark.read.schema(SCHEMAS[name]).parquet(folder)
        out = of(self._version_path(name, version))
        columns = out.columns
        for delta in self._deltas(name, version):
            k = 0
            while self._complete(f"{delta}/go{k}"):
                gone = self.spark.read.parquet(f"{delta}/go{k}")
                out = out.join(gone, gone.columns, "left_anti")
                k += 1
            out = out.select(*columns).unionByName(of(f"{delta}/come").select(*columns))
        return out

    def _conform(self, name: str, df: DataFrame) -> DataFrame:
        wanted = self.spark.createDataFrame([], SCHEMAS[name]).schema
        return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))

    def _save(self, name: str, df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
        keys = PARTITIONED.get(name, [])
        out = self._conform(name, df)
        if keys:
            out = out.hint("rebalance", *keys)  # the rows of a common key go to as many tasks as their size asks for
        marked = out.write.mode(mode).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")
        marked.partitionBy(*keys).parquet(folder)

    def write(self, name: str, df: DataFrame) -> None:
        """A new version; df may read the table itself. Versions before the last complete one go, with their deltas."""
        before, known = self._current(name), self._folders(name)
        last = max((int(f[1:9]) for f in known), default=-1)
        self._save(name, df, self._version_path(name, last + 1))
        fs, path = self._fs()
        for f in known:
            if before is None or not f.startswith(f"v{before:08d}"):
                fs.delete(path(f"{self.path(name)}/{f}"), True)

    def append(self, name: str, df: DataFrame, batch: str | None = None) -> None:
        """Rows join the table, all or none; those of a batch (its name, where given) once, as long as its delta is not merged."""
        self.change(name, [], df, batch)

    def replace(self, name: str, gone: DataFrame | list[DataFrame], new: DataFrame) -> None:
        """The rows that match `gone` (or any of these) in all its columns leave the table, those of `new` join it; the others stay, and stay where they are."""
        self.change(name, [g.distinct() for g in (gone if isinstance(gone, list) else [gone])], new)

    def change(self, name: str, gone: list[DataFrame], new: DataFrame, batch: str | None = None) -> None:
        version = self._current(name)
        if version is None:
            return self.write(name, new)
        fs, path = self._fs()
        first = self._version_path(name, version)
        taken = [f for f in self._folders(name) if f.startswith(f"v{version:08d}.")]
        if batch is not None and any(f.endswith(f".{batch}") and self._complete(f"{self.path(name)}/{f}/come") for f in taken):
            return None
        number = max((int(f.split(".")[1]) for f in taken), default=-1) + 1
        folder = f"{first}.{number:06d}" + (f".{batch}" if batch is not None else "")
        for k, g in enumerate(gone):
            g.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/go{k}")
        self._save(name, new, f"{folder}/come")  # complete with this, the last of its files
        deltas = self._deltas(name, version)
        size = lambda f: fs.getContentSummary(path(f)).getLength()
        if len(deltas) >= MOST_DELTAS or sum(map(size, deltas)) > max(LEAST_BYTES, size(first)):
            self.write(name, self.read(name))
        return None

    def upsert(self, name: str, df: DataFrame) -> None:
        """Rows of df replace those of the same key; the others stay."""
        new = self._conform(name, df).dropDuplicates(KEYED[name])
        self.replace(name, new.select(*KEYED[name]), new)

    def count(self, name: str, n: int, batch: str) -> None:
        """A counter grows by what a batch has counted; a batch that is repeated adds nothing."""
        self.upsert("counters", self.spark.createDataFrame([(name, batch, n)], SCHEMAS["counters"]))

    def counted(self, name: str) -> int:
        return self.read("counters").where(F.col("name") == name).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def reset(self, name: str) -> None:
        """The counter is 0 again."""
        gone = self.spark.createDataFrame([(name,)], "name string")
        self.replace("counters", gone, self.spark.createDataFrame([], SCHEMAS["counters"]))

    def create(self) -> None:
        """An empty workspace: what was there is gone."""
        self.destroy()
        fs, path = self._fs()
        fs.mkdirs(path(self.root))

    def truncate(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(self.path(name)), True)

    def destroy(self) -> None:
        fs, path = self._fs()
        fs.delete(path(self.root), True)

    def export_csv(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(self.path(name))

    def save_model(self, model: PipelineModel) -> None:
        model.write().overwrite().save(self.path("model"))

    def load_model(self) -> PipelineModel:
        return _cached_model(self.path("model"))


_MODELS: dict[str, tuple[float, PipelineModel]] = {}
MODEL_SECONDS, MODELS = 600, 1000


def _cached_model(path: str) -> PipelineModel:
    """Loaded models are kept for ten minutes, a thousand at most."""
    now = time.time()
    for old in [p for p, (t, _) in _MODELS.items() if now - t > MODEL_SECONDS] or (list(_MODELS)[:1] if len(_MODELS) >= MODELS else []):
        del _MODELS[old]
    if path not in _MODELS:
        _MODELS[path] = (now, PipelineModel.load(path))
    return _MODELS[path][1]


def forget_models() -> None:
    _MODELS.clear()
