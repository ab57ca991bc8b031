"""From raw documents to packed training windows, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents:

1. toxicity: documents predicted toxic (score >= 0.5) go;
2. near_duplicates: of each group within 2 fingerprint bits (the shingles and the
   radius of the operator's own contract), the document with the smallest doc_id
   stays (of rows that repeat it in the group, the one that
   `simhash.representatives` defines);
3. decontamination: documents that hold a window of a benchmark item go;
4. personal_data: spans are replaced by their kind in brackets, n_chars follows;
5. packing: a row per piece of a document in its window.

A row with a null doc_id cannot be named by a group and stays in stage 2; the
other stages decide by its text alone. Rows that share an id but not a group all
stay. An empty table passes through; further columns pass through unchanged.
"""

from __future__ import annotations

import uuid

from loomwork.llm import decontam, packing, pii, simhash, toxicity
from loomwork.llm.base import shared_folder, table
from pyspark.sql import DataFrame, SparkSession


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep(docs, table(spark, sf_dir, "benchmark"))


def personal_data_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs, pii.train(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("personal_data", personal_data_out),
    ("packing", packed),
]

#: Trained models and fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every other stage is written below the shared checkpoint folder and read again."""
    top = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{top}/{k}-{name}")
            docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
