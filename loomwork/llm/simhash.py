"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is made of the 64 majority bits of the XXH64 values (seed 42) of
a text's word shingles. Two fingerprints at most `radius` = 2 bits apart share
a variant at most radius/2 = 1 bit from each; so each distinct fingerprint
emits its 65 variants, rows meet on the variant, and neighbouring rows of a
variant are compared. Distinct fingerprints around one variant are at most 65,
whatever the data, and lie pairwise within 2 bits, so linking neighbours in
sorted order loses no connection and emits no pairs of a large group.

Defined cases: null text = no words = fingerprint 0, linked like any other;
fewer words than a shingle = the whole sequence is the one shingle; equal texts
have equal fingerprints and meet before the variants are made; repeated rows
of a doc_id each give a row; a null doc_id takes no part in the choice of
component_id unless it is alone (then null); an empty table gives no rows;
further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from loomwork.llm.base import arrow_schema, checkpoint, labelled, map_batches, text_bytes
from loomwork.llm.components import components

SEED = 42
RADIUS = 2
#: Groups of tasks that combine their minima.
SALTS = 16


def hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of each shingle of `size` words; repeats included."""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    if n <= size:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = (ends[: n - size + 1] - np.fromiter(map(len, words[: n - size + 1]), np.int64, n - size + 1)).tolist()
    stops = ends[size - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n - size + 1)


def fingerprint(raw: bytes, size: int = 3) -> int:
    """The signed 64-bit fingerprint of a UTF-8 text."""
    h = hashes(raw, size)
    n = len(h)
    if not n:
        return 0
    count = np.zeros(64, np.int64)
    octets = h.view(np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        count += np.unpackbits(octets[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(count * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """(doc_id, fp, h): one row per row of docs; h is the XXH64 of the text (Spark's)."""
    schema = arrow_schema("doc_id long, fp long, h long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(x, size) for x in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fps, pa.int64()), b.column(2)], schema=schema)

    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("h"))
    return map_batches(slim, run, "doc_id long, fp long, h long")


def links(distinct: DataFrame) -> DataFrame:
    """distinct (fp) -> (u, v): linked fingerprints, enough of them to connect every pair within RADIUS bits."""
    ball = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64))]
    variants = distinct.select("fp", F.explode(F.array(*ball)).alias("variant"))
    near = variants.withColumn("before", F.lag("fp").over(Window.partitionBy("variant").orderBy("fp")))
    near = near.where(F.col("before").isNotNull()).select(F.col("fp").alias("u"), F.col("before").alias("v")).distinct()
    return near.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= RADIUS)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, cluster, h) for every row of docs.

    cluster is the least linked fingerprint: unlike component_id, it differs between groups that share a repeated doc_id.
    """
    # a stored number of each row deals the rows of a common fingerprint, also where ids are null or repeated
    prints = checkpoint(fingerprints(docs, text, key, size).withColumn("row", F.monotonically_increasing_id()))
    # the tasks' minima of a common fingerprint are combined by groups of tasks first
    group = F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("tasks")
    partial = prints.groupBy("fp", group).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    reps = checkpoint(partial.groupBy("fp").agg(F.min("rep").alias("rep"), F.sum("n").alias("n")))
    groups = checkpoint(components(links(reps.select("fp"))))
    # the least document of each component of fingerprints; groups has only linked fingerprints
    named = groups.withColumnRenamed("node", "fp").join(reps, "fp")
    least = named.groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("n"))
    linked = labelled(named.select("fp", "component"), least, "component", F.xxhash64("fp"), groups.count()).select("fp", "component", "least")
    label = reps.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"), F.coalesce("component", "fp").alias("cluster"), "n")
    out = labelled(prints, label, "fp", F.xxhash64("row"), prints.count())
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "cluster", "h")


def representatives(docs: DataFrame, size: int = 3) -> DataFrame:
    """Of each component the row with the least doc_id (of those, the least XXH64 of text), all columns of docs.

    Of rows equal in both, the one whose other columns come first as JSON. Rows without doc_id all stay.
    """
    groups = near_duplicates(docs, size=size).where("doc_id is not null")
    kept = groups.groupBy("cluster").agg(F.min(F.struct("doc_id", "h")).alias("k")).select(F.col("k.doc_id").alias("id"), F.col("k.h").alias("h"))
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.struct(*docs.columns).alias("row"), F.to_json(F.struct(*others)).alias("rank"))
    # copies of one row are settled in their tasks before the shuffle: one of them a task meets the names that are kept
    picked = rows.groupBy("id", "h").agg(F.min_by("row", "rank").alias("row")).join(kept, ["id", "h"])
    return picked.select("row.*").unionByName(docs.where(F.col("doc_id").isNull()))
