"""A domain's life as plain functions: build, extend, query."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import vectors as V
from loomwork.operators import compare, corpus, distributions, graph, sectors, shapes, similarity, tags, topics
from loomwork.plans.config import Config, Criteria
from loomwork.plans.lineage import cut
from loomwork.sources.store import Store, forget_models


# Stages of a build in their order, and the event that says a stage is done.
STAGES = (
    ("model", "model.trained"), ("tags", "tags.generated"), ("shapes", "shapes.created"), ("subdomains", "subdomain.shapes.created"),
    ("distributions", "distributions.created"), ("similarities", "similarities.created"),
)


def _now() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ")


@dataclass
class Domain:
    spark: SparkSession
    store: Store
    name: str
    config: Config = Config()

    def build(self, resources: DataFrame, subdomains: DataFrame | None = None) -> None:
        """Train on items, shape items and parts, then subdomains, distributions, tags, annotations and similarities.

        resources: resource, tokens, domain, type; subdomains: subdomain, uri. The stages of STAGES one after the other;
        streaming.chain runs the same ones by events.
        """
        for name, _ in STAGES:
            self.stage(name, resources, subdomains)

    def stage(self, name: str, resources: DataFrame, subdomains: DataFrame | None = None) -> None:
        """One stage of a build. It writes tables of its own from those of the stages before, so it may be repeated."""
        {
            "model": lambda: self.train(resources), "tags": self.tag, "shapes": self.shape_all, "subdomains": lambda: self.shape_subdomains(subdomains),
            "distributions": self.distribute, "similarities": self.relate,
        }[name]()

    def train(self, resources: DataFrame) -> None:
        self.store.create()
        forget_models()
        self.store.write("corpus", corpus.filled(resources.where(F.col("domain") == self.name)))
        for r in self.store.read("corpus").groupBy("type").count().collect():
            self.store.count(f"{r.type}s", r["count"], "build")
        items = self.store.read("corpus").where(F.col("type") == "item")
        model = topics.train(items, topics.choose(items, self.config), self.config)
        self.store.save_model(model)
        self.store.write("topics", topics.describe(model, self.name, self.config.words_per_topic).withColumn("date", _now()))

    def tag(self) -> None:
        self.store.write("tags", tags.of_domain(self.store.read("topics")))

    def shape_all(self) -> None:
        rows = self.store.read("corpus").where(F.col("type").isin("item", "part"))
        self.store.write("shapes", topics.infer(self.store.load_model(), rows).withColumn("date", _now()))

    def shape_subdomains(self, subdomains: DataFrame | None) -> None:
        if subdomains is not None:
            self.store.upsert("shapes", cut(shapes.of_subdomains(subdomains, self.store.read("shapes").where("type <> 'domain'")).withColumn("date", _now())))

    def distribute(self) -> None:
        table, own = self.store.read("topics"), self.store.read("shapes")
        self.store.write("distributions", distributions.build(own, table))
        self.store.write("annotations", distributions.annotations(self.store.read("distributions"), table))
        self.store.write("shapes_by_topic", shapes.dominant(own).where("topic is not null"))

    def relate(self) -> None:
        """Sectors, pairs inside them, centroids and what paths are searched in."""
        useful = self.store.read("shapes").where(V.total(F.col("vector")) > 0)
        sectored = sectors.assign(useful, self.config.sector_size, seed=self.config.seed)
        self.store.write("subgraph_nodes", sectored)
        sectored = self.store.read("subgraph_nodes")
        self.store.write("clusters", sectors.numbered(sectored))
        pairs = similarity.in_sector(sectored, both_ways=True)
        self.store.write("subgraph_edges", pairs)
        self.store.write("similarities", self.store.read("subgraph_edges"))
        self.store.write("centroids", self._centroids(sectored))
        self.store.write("centroid_similarities", similarity.of_centroids(self.store.read("centroids")))

    @staticmethod
    def _centroids(sectored: DataFrame) -> DataFrame:
        """Of each sector: the mean of all resources (type `centroid`) and of each type of them."""
        return sectors.centroids(sectored).unionByName(sectors.typed_centroids(sectored))

    def announce(self) -> str:
        """The message that the domain has been analysed, also kept among the events: name, id and time as JSON."""
        message = self.spark.range(1).select(
            F.lit("domain.analyzed").alias("key"), F.lit(f"domains/{self.name}").alias("resource"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ").alias("time"), F.lit(self.name).alias("name"),
        )
        row = message.select("key", "resource", "time", F.to_json(F.struct("name", F.col("resource").alias("id"), "time")).alias("json"))
        self.store.append("events", row)
        return row.first().json

    def shape(self, resources: DataFrame, batch: str | None = None) -> None:
        """New or changed resources: shaped by the stored model; distributions, tags and similarities follow for these alone.

        What is written grows with their sectors, not with the corpus. batch: a name under which the events of a repeated call count once.
        """
        rows = cut(corpus.filled(resources))
        uris = rows.select(F.col("resource").alias("uri")).distinct()
        self.store.upsert("corpus", rows)
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ").alias("date")
        self.store.upsert("shapes", topics.infer(self.store.load_model(), rows).withColumn("date", now))
        changed = self.store.read("shapes").join(uris, "uri", "left_semi")
        table, gone = self.store.read("topics"), uris.select(F.col("uri").alias("resource_uri"))
        self.store.replace("distributions", gone, distributions.build(changed, table))
        self.store.replace("annotations", gone, distributions.annotations(self.store.read("distributions").join(gone, "resource_uri", "left_semi"), table))
        self.store.replace("shapes_by_topic", uris, shapes.dominant(changed).where("topic is not null"))
        self._relate_changed(changed, uris)
        self.store.append("events", changed.select(F.lit("shape.created").alias("key"), F.col("uri").alias("resource"), F.col("date").alias("time")), batch)

    def _relate_changed(self, changed: DataFrame, uris: DataFrame) -> None:
        """Changed shapes join the sector of the nearest centroid and meet its rows; other pairs stay.

        All sectors are formed anew where there are none, more than `sectors.MOST_CENTRES`, or one of over twice the wanted size.
        """
        centres = self.store.read("centroids").where("type = 'centroid'")
        if not 0 < centres.count() <= sectors.MOST_CENTRES:
            return self.relate()
        useful = changed.where(V.total(F.col("vector")) > 0)
        nearest = sectors.near_centroids(useful, centres, 1.0).groupBy("uri").agg(F.min("cluster").alias("sector"))
        before = self.store.read("subgraph_nodes")
        numbers = before.join(self.store.read("clusters"), "uri").select("sector", "cluster").distinct()
        touched = cut(before.join(uris, "uri", "left_semi").select("sector").union(nearest.select("sector")).distinct())
        self.store.replace("subgraph_nodes", uris, useful.join(nearest, "uri"))
        nodes = self.store.read("subgraph_nodes")
        if nodes.groupBy("sector").agg(F.count("*").alias("n")).where(F.col("n") > 2 * self.config.sector_size).count():
            return self.relate()
        self.store.replace("clusters", uris, nodes.join(uris, "uri", "left_semi").join(numbers, "sector"))
        pairs = cut(similarity.of_changed(nodes, uris))
        ends = [uris.select(F.col("uri").alias(f"resource_uri_{n}")) for n in (1, 2)]
        for name in ("subgraph_edges", "similarities"):
            self.store.replace(name, ends, pairs)
        moved = self._centroids(nodes.join(touched, "sector", "left_semi"))
        moved = cut(moved)
        gone = touched.select(F.col("sector").alias("uri"))
        self.store.replace("centroids", gone, moved)
        centres = self.store.read("centroids").withColumn("sector", F.col("type"))
        near = cut(similarity.of_changed(centres, gone).drop("sector"))
        self.store.replace("centroid_similarities", [gone.select(F.col("uri").alias(f"resource_uri_{n}")) for n in (1, 2)], near)

    def relevant_resources(self, topic_uri: str, criteria: Criteria = Criteria()) -> DataFrame:
        return distributions.relevant_resources(self.store.read("distributions"), topic_uri, criteria)

    def topic_mix(self, uri: str, criteria: Criteria = Criteria(), words: int = 10) -> DataFrame:
        return distributions.topic_mix(self.store.read("shapes"), self.store.read("topics"), uri, criteria, words)

    def topics(self, words: int = 10) -> DataFrame:
        return topics.words_of_topics(self.store.read("topics"), words)

    def tags(self, uri: str, criteria: Criteria = Criteria()) -> DataFrame:
        return distributions.tags_of(self.store.read("annotations"), uri, criteria)

    def similar_to(self, uri: str, criteria: Criteria = Criteria()) -> DataFrame:
        return similarity.similar_to(self.store.read("similarities"), uri, criteria)

    def similar_to_text(self, content: str, criteria: Criteria = Criteria()) -> DataFrame:
        """Free text: its inferred shape against all sectors, best first; empty text has no answer."""
        own = self.store.read("subgraph_nodes")
        text = self.spark.createDataFrame([("texts/0", content, self.name, "text")], "resource string, tokens string, domain string, type string")
        vector = topics.infer(self.store.load_model(), text).first().vector if content.strip() else []
        if not sum(vector):
            return own.select("uri", F.lit(0.0).alias("score")).limit(0)
        return similarity.similar_to_vector(own, list(vector), criteria)

    def compare(self, a: str, b: str) -> DataFrame:
        return similarity.between(self.store.read("shapes"), a, b)

    def path(self, start: str, end: str, criteria: Criteria = Criteria(), max_length: int = 10) -> DataFrame:
        """The best ways between two resources, by `place`: two-level search."""
        nodes = self.store.read("subgraph_nodes")
        return graph.two_level(
            nodes.select("uri", "type", "vector"), sectors.membership(nodes), self.store.read("subgraph_edges"), self.store.read("centroids"),
            start, end, criteria.threshold, max_length, criteria.max, list(criteria.types),
        )

    def compare_topics(self, other: Domain, words: int = 100) -> DataFrame:
        mine, theirs = (d.store.read("topics").withColumn("domain", F.lit(d.name)) for d in (self, other))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssZ").alias("date")
        out = compare.topics(mine, theirs, words).withColumn("date", now)
        self.store.append("comparisons", out)
        return self.store.read("comparisons").where(F.col("domain_uri") == other.name)

    def item_of_document(self, uri: str) -> str:
        row = self.store.read("bundles").where(F.col("starturi") == uri).select("enduri").first()
        return row.enduri if row else ""

    def delete(self) -> None:
        self.store.destroy()
        forget_models()
