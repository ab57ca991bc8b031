"""Corpus scans, tokens, vocabulary and bags of words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as X


def scan(corpus: DataFrame, domain: str, kind: str) -> DataFrame:
    """Resources of a domain and type; both conditions reach the Parquet reader."""
    return corpus.where((F.col("domain") == domain) & (F.col("type") == kind))


def scan_types(corpus: DataFrame, domain: str | None, kinds: list[str]) -> DataFrame:
    """Resources of several types in one scan, of a domain or of all."""
    rows = corpus.where(F.col("type").isin(kinds))
    return rows if domain is None else rows.where(F.col("domain") == domain)


def by_uris(corpus: DataFrame, uris: DataFrame) -> DataFrame:
    """The resources that are listed; listed ones that do not exist drop out."""
    return corpus.join(uris.select(F.col("uri").alias("resource")).distinct(), "resource", "left_semi")


def of_texts(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    """(id, content) from memory."""
    return spark.createDataFrame(texts, "id string, content string")


def filled(corpus: DataFrame) -> DataFrame:
    """Blank tokens become empty text."""
    return corpus.withColumn("tokens", F.when(X.is_blank(F.col("tokens")), "").otherwise(F.col("tokens")))


def tokens_of(corpus: DataFrame, uri: str) -> DataFrame:
    return corpus.where(F.col("resource") == uri).select(F.coalesce("tokens", F.lit("")).alias("tokens"))


def with_words(corpus: DataFrame, stop: list[str] | None = None) -> DataFrame:
    """Adds `words`: the tokens without stop words (none are assumed)."""
    return corpus.withColumn("words", X.without_stop_words(X.tokens(F.coalesce("tokens", F.lit(""))), stop or []))


def term_counts(words: DataFrame) -> DataFrame:
    return words.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def vocabulary(words: DataFrame, size: int) -> DataFrame:
    """The `size` commonest terms (term, n); among equals the alphabetically first."""
    return term_counts(words).orderBy(F.desc("n"), "term").limit(size)


def bags(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """(uri, term, n): counts of vocabulary terms in each resource; the vocabulary is bounded, so broadcast."""
    return (
        words.select(F.col("resource").alias("uri"), F.explode("words").alias("term"))
        .join(F.broadcast(vocab.select("term")), "term", "left_semi")
        .groupBy("uri", "term").agg(F.count("*").alias("n"))
    )


def parts(corpus: DataFrame) -> DataFrame:
    """Lines of items as parts: resource .../parts/<id>-<line>."""
    lines = corpus.select("resource", "domain", F.posexplode(F.split("tokens", "\n")).alias("line", "tokens"))
    at = F.concat(F.regexp_replace("resource", "/items/", "/parts/"), F.lit("-"), F.col("line").cast("string"))
    return lines.select(at.alias("resource"), "tokens", "domain", F.lit("part").alias("type"))
