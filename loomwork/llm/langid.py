"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting and scoring both turn a group of texts into one array of code points,
hash the 1-, 2- and 3-grams of every position into 2^16 buckets, and work on
whole arrays: training adds up bucket counts per language, scoring gathers rows
of the broadcast log-probability matrix and adds them by text (the sparse
document-by-bucket matrix times the model). The matrix has 2^16 rows and a
column per language, whatever the corpus.

Training reads a bounded sample of the labelled rows: about `max_docs`, a like
share of it for each language, picked by a hash of doc_id (the documented bound;
all rows of a language that has fewer). Priors are the shares of all labelled
rows. Scoring covers every row and whole texts.

Defined cases: null text, or text without a letter (Unicode category L): `und`,
score 0; nothing learnt: `und`, score 0; a language whose rows hold no n-gram is
not learnt; ties: the first language in alphabetical order; repeated rows each
give a row; very long texts are scored in pieces that overlap by the n-gram's
reach, which changes nothing; further columns of any name do no harm; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.base import arrow_schema, groups, id_hash, map_batches

BITS = 16
REACH = 3
MAX_DOCS = 20_000
#: Share of every language's probability that is spread evenly over the buckets: an unseen n-gram then speaks for none.
SMOOTH = 0.01
#: Code points per array.
PIECE = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(points: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that ends at each position, for n = 1, 2, 3 (arrays of their own lengths)."""
    h = points.astype(np.uint64)
    out = []
    mixed = np.zeros(0, np.uint64)
    for n in range(1, REACH + 1):
        if len(h) < n:
            break
        mixed = h if n == 1 else (mixed[:-1] * np.uint64(0x9E3779B97F4A7C15)) + h[n - 1 :]
        spread = (mixed + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93)
        out.append((spread >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def buckets(text: str) -> Iterator[np.ndarray]:
    """All n-gram buckets of a text, lower-cased, piece by piece."""
    points = code_points(f" {text.lower()} ")
    for at in range(0, max(1, len(points)), PIECE):
        for n, g in enumerate(grams(points[max(0, at - REACH + 1) : at + PIECE]), start=1):
            # grams that end inside this piece
            lead = min(at, REACH - 1)
            yield g[max(0, lead - (n - 1)) :]


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probability matrix with the log prior as its last row)."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (F.pmod(id_hash(), F.lit(3)) != 1))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    per_lang = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(per_lang.values())
    if not total:
        return [], np.zeros(((1 << BITS) + 1, 0), np.float32)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    quota = max_docs / len(per_lang)
    large = {x: quota / n for x, n in per_lang.items() if n > quota}
    share = F.coalesce(F.create_map(*(F.lit(v) for kv in large.items() for v in kv))[F.col("lang")], F.lit(1.0)) if large else F.lit(1.0)
    sample = rows.where(place < share).select("text", "lang")
    ddl = "lang string, bucket int, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = counts.setdefault(lang, np.zeros(1 << BITS, np.int64))
                for g in buckets(text):
                    own += np.bincount(g, minlength=1 << BITS)
        for lang, own in counts.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], schema=schema)

    got = map_batches(sample, run, ddl).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = got.toArrow()  # at most languages * 2^16 rows
    langs = sorted(set(table["lang"].to_pylist()))
    matrix = np.zeros(((1 << BITS), len(langs)))
    column = {x: i for i, x in enumerate(langs)}
    matrix[table["bucket"].to_numpy(), [column[x] for x in table["lang"].to_pylist()]] += table["n"].to_numpy()
    logs = np.log((1 - SMOOTH) * matrix / matrix.sum(axis=0) + SMOOTH / (1 << BITS)) if langs else matrix
    prior = np.log([per_lang[x] / total for x in langs])
    return langs, np.vstack([logs, prior]).astype(np.float32)


def predict(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if not langs:
        return names, scores
    todo = [i for i, t in enumerate(texts) if t is not None and has_letter(t)]
    for a, z in groups((len(texts[i]) for i in todo), PIECE):
        sums = _sums([texts[i] for i in todo[a:z]], matrix)
        for i, s in zip(todo[a:z], sums + matrix[-1]):
            k = int(np.argmax(s))
            names[i], scores[i] = langs[k], float(1 / np.exp(s - s[k]).sum())
    return names, scores


def _sums(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """Sum of the log-probability rows of each text's n-grams."""
    if len(texts) == 1:  # maybe very long
        return np.array([sum((matrix[g].sum(axis=0, dtype=np.float64) for g in buckets(texts[0])), np.zeros(matrix.shape[1]))])
    padded = [f" {t.lower()} " for t in texts]
    lengths = np.array([len(t) for t in padded])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.zeros((len(texts), matrix.shape[1]))
    for n, g in enumerate(grams(code_points("".join(padded))), start=1):
        # a text owns the grams that start in it and do not run over its end (each text has two blanks at least)
        keep = np.ones(len(g), bool)
        for back in range(1, n):
            keep[ends[:-1] - back] = False
        # rows of the sparse matrix: gram counts by text
        text_of = np.repeat(np.arange(len(texts)), lengths)[: len(g)]
        picked, owner = g[keep], text_of[keep]
        first = np.searchsorted(owner, np.arange(len(texts)))
        has = first < np.append(first[1:], len(owner))
        rows = np.add.reduceat(matrix[picked], first[has], axis=0, dtype=np.float64) if len(picked) else None
        if rows is not None:
            out[has] += rows
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, lang_pred string, score double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, matrix = shared.value
        for b in batches:
            names, scores = predict(b.column(1).to_pylist(), langs, matrix)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, run, ddl)
