"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of the benchmark items. Per pattern length m there is
a shift table over blocks of up to three words (how far the search may jump
when a block ends a position), a byte for each of a power of two of hash values,
the least of colliding blocks; where the shift is zero the hash of the block
(its suffix) selects a bucket of test strings, sorted by that hash, which are
compared word by word. Most positions of a clean text are never looked at. The
tables cost a few dozen bytes a word of benchmark, and stay in a worker process
from task to task.

Benchmark text is read in blocks of `BLOCK_BYTES`, one at a time in the driver
and in a task. A benchmark of one block is one narrow pass over the documents;
of more, there is a job a block, whose narrow findings are written under
doc_id and a hash of the text and then joined to the documents, so neither a
task's memory nor the driver's grows with the benchmark, and rows find theirs
whatever order they come in. (One item must fit in a block's memory.)

Defined cases: null text has no words; an item without words is no pattern;
rows of one item_id count as one item; a null item_id counts as the text
"null"; repeated rows of a doc_id each give a row; no items: nothing is hit;
further columns of any name do no harm; an empty table gives no rows. There are
no ties: every occurrence of every item counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.base import arrow_schema, checkpoint, map_batches, text_bytes

WINDOW = 10
BLOCK_WORDS = 3
#: Bytes of benchmark text per pass.
BLOCK_BYTES = 16 << 20

#: Lower-cases A-Z and turns what separates words (ASCII other than letters and digits) into blanks.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_TABLE).split()


#: Factors of a block's hash, by place.
_MIX = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)


class Known(dict):
    """Numbers of words; all other words are 0."""

    def __missing__(self, x: bytes) -> int:
        return 0


class Table:
    """Shift table and suffix buckets of the patterns of one length; `ids`: the words of their items one after the other."""

    def __init__(self, m: int, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.m, self.b = m, min(BLOCK_WORDS, m)
        self.ids = ids
        at = np.concatenate([np.arange(a, a + n - self.b + 1) for a, n in zip(starts, lengths)])  # every block
        place = np.concatenate([np.arange(n - self.b + 1) for n in lengths])
        h = self.hashes(ids, at)
        self.mask = (1 << max(8, int(4 * len(at)).bit_length())) - 1
        jump = m - self.b + 1
        shift = np.full(self.mask + 1, min(jump, 255), np.uint8)
        np.minimum.at(shift, h & self.mask, np.minimum(np.maximum(m - self.b - place, 0), 255).astype(np.uint8))
        self.shift = shift
        ends = place >= m - self.b  # blocks that end a pattern
        order = np.argsort(h[ends], kind="stable")
        self.keys, self.patterns = h[ends][order], (at[ends] - (m - self.b))[order]

    def hashes(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = np.zeros(len(at), np.int64)
        for k in range(self.b):
            x ^= ids[at + k] * _MIX[k]
        return x ^ x >> 15


class Searcher:
    """The tables of all pattern lengths; `items`: (id as text, UTF-8 text)."""

    def __init__(self, items: Iterable[tuple[str, bytes]], window: int = WINDOW):
        self.words = Known()
        self.names: list[str] = []
        by_length: dict[int, list[int]] = {}
        ids, sizes = [], []
        for item, raw in items:
            w = words(raw)
            if w:
                by_length.setdefault(min(window, len(w)), []).append(len(self.names))
                self.names.append(item)
                ids.append(np.array([self.words.setdefault(x, len(self.words) + 1) for x in w], np.int64))
                sizes.append(len(w))
        self.ends = np.cumsum(np.array(sizes, np.int64))
        flat, sizes = np.concatenate(ids) if ids else np.zeros(0, np.int64), np.array(sizes, np.int64)
        starts = self.ends - sizes
        self.tables = [Table(m, flat, starts[own], sizes[own]) for m, own in sorted(by_length.items())]

    def find(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Ranges of word positions inside occurrences, merged and ascending, and the items that occur."""
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        ids = np.fromiter(map(self.words.__getitem__, w), np.int64, len(w))
        n = len(ids)
        for t in self.tables:
            m, b = t.m, t.b
            if n < m:
                continue
            h = t.hashes(ids, np.arange(n - b + 1))  # of the block that starts at each word
            jumps = t.shift[h & t.mask]
            if jumps.all():  # no block ends a pattern
                continue
            jump, at = jumps.tobytes(), m
            while at <= n:
                s = jump[at - b]
                if s:
                    at += s
                    continue
                lo, hi = np.searchsorted(t.keys, (h[at - b], h[at - b] + 1))
                if lo < hi:
                    own = ids[at - m : at]
                    hits = [p for p in t.patterns[lo:hi].tolist() if (t.ids[p : p + m] == own).all()]
                    if hits:
                        found.append((at - m, at))
                        items.update(self.names[k] for k in np.searchsorted(self.ends, hits, "right").tolist())
                at += 1
        return merged(found), items


class Block:
    """Items for the executors; a process builds the searcher once."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.items, self.window = items, window

    @cached_property
    def searcher(self) -> Searcher:
        out = Searcher(self.items, self.window)
        self.items = []
        return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(ranges):
        if out and a <= out[-1][1]:
            if z > out[-1][1]:
                out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out


def benchmark_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[int, list[tuple[str, bytes]]]]:
    """The number of blocks of about `block_bytes`, with the items of each, collected when it is asked for."""
    slim = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("id"), F.col("text").cast("string").cast("binary").alias("raw")
    ).where("raw is not null")
    total = slim.agg(F.sum(F.length("raw"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = slim if n == 1 else slim.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k)
        rows = part.toArrow()
        yield n, list(zip(rows["id"].to_pylist(), rows["raw"].to_pylist()))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"))


def _found(docs: DataFrame, items: DataFrame, window: int, block_bytes: int) -> DataFrame | None:
    """What each block finds, written: doc_id, h, spans, items, at most a row a document and block. None: there is one block."""
    sc = docs.sparkSession.sparkContext
    out = None
    for n, block in benchmark_blocks(items, block_bytes):
        if n == 1:
            return None
        shared = sc.broadcast(Block(block, window))
        hits = _search(_keyed(docs), shared).where("size(items) > 0").select("doc_id", "h", "spans", "items")
        part = checkpoint(hits.groupBy("doc_id", "h").agg(F.first("spans").alias("spans"), F.first("items").alias("items")))  # equal rows have equal findings
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (flat word ranges)."""
    sc = docs.sparkSession.sparkContext
    found = _found(docs, items, window, block_bytes)
    if found is None:
        ((_, block),) = benchmark_blocks(items, block_bytes)
        return _finished(_search(_keyed(docs), sc.broadcast(Block(block, window))))
    hits = found.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    counted = _search(_keyed(docs), sc.broadcast(Block([], window))).select("doc_id", "h", "n_words").alias("d")
    hits = hits.alias("f")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.h") == F.col("f.h"))
    return _finished(counted.join(hits, same, "left").select("d.doc_id", "d.h", "n_words", "spans", "items"))


STATE = "doc_id long, h long, n_words long, spans array<int>, items array<string>"
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>"


def _search(state: DataFrame, tables) -> DataFrame:
    schema = arrow_schema(STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = tables.value.searcher
        for b in batches:
            rows = []
            for doc, raw, h in zip(b.column(0).to_pylist(), text_bytes(b.column(1)), b.column(2).to_pylist()):
                w = words(raw)
                found, ids = search.find(w)
                rows.append((doc, h, len(w), [x for r in found for x in r], sorted(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return map_batches(state, run, STATE)


def _finished(found: DataFrame) -> DataFrame:
    schema = arrow_schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, n_words, spans, items in zip(*(b.column(k).to_pylist() for k in (0, 2, 3, 4))):
                spans, ids = spans or [], sorted(items or [])
                ranges = merged(list(zip(spans[::2], spans[1::2])))
                n = sum(z - a for a, z in ranges)
                rows.append((doc, n_words, n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0, [x for r in ranges for x in r]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return map_batches(found, run, RESULT)


def keep(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that hold no window of an item: one narrow pass, or a job for each block and an anti-join."""
    found = _found(docs, items, window, block_bytes)
    if found is None:
        ((_, block),) = benchmark_blocks(items, block_bytes)
        return _clean(docs, docs.sparkSession.sparkContext.broadcast(Block(block, window)))
    d, f = docs.alias("d"), found.select("doc_id", "h").distinct().alias("f")
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("f.h"))
    return d.join(f, same, "left_anti")


def _clean(docs: DataFrame, tables) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = tables.value.searcher
        for b in batches:
            raws = text_bytes(b.column(b.schema.get_field_index("text")))
            yield b.filter(pa.array([not search.find(words(raw))[0] for raw in raws], pa.bool_()))

    return map_batches(docs, run, docs.schema)


#: The same rows in DuckDB SQL.
ORACLE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
p AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s
        FROM i WHERE len(w) > 0)),
g AS (
  SELECT rid, m, s, array_to_string(w[s : s + m - 1], ' ') AS g
  FROM (SELECT rid, w, m, unnest(range(1, len(w) - m + 2)) AS s
        FROM d, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)),
o AS (SELECT rid, g.m, s, item_id FROM g JOIN p ON g.m = p.m AND g.g = p.g),
h AS (SELECT rid, count(DISTINCT x) AS n_hit FROM (SELECT rid, unnest(range(s, s + m)) AS x FROM o) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
      FROM (SELECT DISTINCT rid, item_id FROM o) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
