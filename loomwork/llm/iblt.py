"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are digested (parts between line ends or the punctuation
that ends clauses; longer ones are cut after words, and words after characters,
that a hash of them picks, so that one changed word moves no other cut), with a
paragraph's number among its equals, and each digest is added to one
cell in each third of the sketch: a count, a sum of digests and a sum of check
values, modulo powers of two. Sketches of two versions subtract cell by cell;
what they share cancels, and peeling cells that hold one digest recovers the
differing ones. Where peeling gets stuck, both versions are sketched again four
times larger, up to a size at which a rest would be a hash collision; digests
that even then stay are counted one by one. The likeness is the number of
shared paragraphs over that of all.

Whole batches of comparisons are sketched and peeled together as numpy arrays.

Each text is compared with its edited text and with the next document. The
documents are dealt to ranges of ids, about `RANGE_BYTES` each (`MOST_RANGES` at
most, larger ones beyond), and sorted there, a task a range; an id that fills
ranges by itself is divided by a hash of the text. A range also gets the first
document of the next one, so one shuffle of the texts is enough and no task
holds more than a batch.

Defined cases: null text = empty, which has no paragraphs and an empty sketch;
two empty texts are alike (1.0); the first document follows the last, so a
single document follows itself; a null doc_id comes first; repeated rows of one
doc_id follow each other in the order of the XXH64 of their texts (Spark's, as a
signed number), then of the texts; further columns of any name do no harm; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from loomwork.llm.base import arrow_schema, map_batches

CELLS = 18
GROWTH = 4
LARGEST = 1 << 20
BATCH = 256
#: Ids of first documents that are also given to the reader as a filter; beyond, the broadcast of a row a range selects alone.
PUSHED = 1000
#: Bytes of text in a range, and ranges, at most.
RANGE_BYTES, MOST_RANGES = 32 << 20, 10_000
SPLIT = re.compile(r"\n+|(?<=[.!?,;:])[ \t]+|(?<=[。！？；，、])")
#: Words of a paragraph, and characters of a word, from which they are cut; the cuts are about CUT apart.
LONG_PART, LONG_WORD, CUT = 24, 64, 8


def parts(text: str) -> Iterator[str]:
    """The paragraphs of a text, white space as one blank."""
    for p in SPLIT.split(text):
        words = p.split()
        if len(words) <= LONG_PART and len(p) <= LONG_WORD * 2:
            if words:
                yield " ".join(words)
            continue
        own: list[str] = []
        for w in words:
            if len(w) > LONG_WORD:
                points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                last = 0
                for k in (np.flatnonzero((points[1:] * 37 + points[:-1]) % (CUT * 4) == 0) + 2).tolist():
                    if k - last >= CUT:
                        yield " ".join([*own, w[last:k]])
                        own, last = [], k
                w = w[last:]
                if not w:
                    continue
            own.append(w)
            if len(words) > LONG_PART and zlib.crc32(w.encode("utf-8", "surrogatepass")) % CUT == 0:
                yield " ".join(own)
                own = []
        if own:
            yield " ".join(own)


def digests(text: str) -> np.ndarray:
    """One digest per paragraph; the k-th of equal paragraphs has the seed k."""
    seen: dict[str, int] = {}
    out = []
    for p in parts(text):
        k = seen.get(p, 0)
        seen[p] = k + 1
        out.append(xxh3_64_intdigest(p.encode(), k))
    return np.array(out, np.uint64)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cells(keys: np.ndarray, cells: int) -> np.ndarray:
    """3 x n: the cell of each digest in each third."""
    third = np.uint64(cells // 3)
    return np.stack([(_mix(keys, k + 1) % third).astype(np.int64) + k * (cells // 3) for k in range(3)])


def _add(sketch: list[np.ndarray], at: np.ndarray, keys: np.ndarray, signs: np.ndarray) -> None:
    """Add digests (or, with sign -1, subtract them) at 3 x n flat cells."""
    turned = signs.astype(np.uint64)  # -1 wraps around, as the sums do
    checks = _mix(keys, 7)
    for row in at:
        np.add.at(sketch[0], row, signs)
        np.add.at(sketch[1], row, keys * turned)
        np.add.at(sketch[2], row, checks * turned)


def empty(cells: int) -> list[np.ndarray]:
    return [np.zeros(cells, np.int64), np.zeros(cells, np.uint64), np.zeros(cells, np.uint64)]


def sketches(sets: list[np.ndarray], cells: int = CELLS) -> list[np.ndarray]:
    """The sketches of several digest sets, one after the other."""
    out = empty(len(sets) * cells)
    keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if len(keys):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _add(out, _cells(keys, cells) + owner * cells, keys, np.ones(len(keys), np.int64))
    return out


def as_text(sketch: list[np.ndarray], k: int, cells: int = CELLS) -> str:
    part = slice(k * cells, (k + 1) * cells)
    raw = sketch[0][part].astype("<u2").tobytes() + sketch[1][part].astype("<u8").tobytes() + sketch[2][part].astype("<u4").tobytes()
    return base64.b64encode(raw).decode()


def peel(sketch: list[np.ndarray], pairs: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of digests recovered, whether all were) per comparison, of subtracted sketches (consumed)."""
    count, total, check = sketch
    found = np.zeros(pairs, np.int64)
    active = np.flatnonzero(np.abs(count) == 1)
    for _ in range(10 * cells + 10):
        sign = count[active].astype(np.uint64)
        key = total[active] * sign
        pure = (np.abs(count[active]) == 1) & (_mix(key, 7) * sign == check[active])
        active = active[pure]
        if not len(active):
            break
        owner, key, signs = active // cells, total[active] * count[active].astype(np.uint64), count[active]
        order = np.lexsort((key, owner))
        owner, key, signs = owner[order], key[order], signs[order]
        first = np.concatenate(([True], (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])))
        owner, key, signs = owner[first], key[first], signs[first]
        found += np.bincount(owner, minlength=pairs)
        at = _cells(key, cells) + owner * cells
        _add(sketch, at, key, -signs)
        active = np.unique(at)
        active = active[np.abs(count[active]) == 1]
    rest = (count.reshape(pairs, cells) != 0).any(axis=1) | (total.reshape(pairs, cells) != 0).any(axis=1)
    return found, ~rest


def differing(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """How many digests differ in each comparison, by subtracting and peeling; larger sketches where that fails."""
    out = np.zeros(len(left), np.int64)
    todo = np.arange(len(left))
    while len(todo):
        a, b = sketches([left[i] for i in todo], cells), sketches([right[i] for i in todo], cells)
        found, done = peel([x - y for x, y in zip(a, b)], len(todo), cells)
        out[todo[done]] = found[done]
        todo = todo[~done]
        cells *= GROWTH
        if cells > LARGEST:
            for i in todo:
                out[i] = len(np.setxor1d(left[i], right[i]))
            break
    return out


def likeness(left: list[np.ndarray], right: list[np.ndarray], cells: int = CELLS) -> np.ndarray:
    """Shared over all digests of each comparison; 1 where both are empty."""
    if not left:
        return np.zeros(0)
    apart = differing(left, right, cells)
    both = (np.array([len(x) for x in left]) + np.array([len(x) for x in right]) - apart) / 2
    return np.where(both + apart > 0, both / np.maximum(both + apart, 1), 1.0)


DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(texts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows for all but the last of consecutive (doc_id, text)."""
    cur, nxt = texts[:-1], texts[1:]
    changed = [edited(a[1], b[1]) for a, b in zip(cur, nxt)]
    sets = [digests(t) for _, t in texts]
    sets_e = [digests(t) for t in changed]
    own, other = sketches(sets[:-1]), sketches(sets_e)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([d for d, _ in cur], pa.int64()), pa.array([len(t) for _, t in cur], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
            pa.array([as_text(own, k) for k in range(len(cur))], pa.string()),
            pa.array([as_text(other, k) for k in range(len(cur))], pa.string()),
            pa.array(likeness(sets[:-1], sets_e), pa.float64()), pa.array(likeness(sets[:-1], sets[1:]), pa.float64()),
        ],
        schema=schema,
    )


def deal(edges: list[float], place: Column, h: Column) -> tuple[Column, int]:
    """The range of a row, in the order of (place, h), and how many there are.

    edges: quantiles of the places, ascending. A place that recurs among them fills ranges of its own, which h divides.
    """
    x = place.cast("double")
    splits = sorted(set(edges))
    index = sum((F.when(x >= s, 1).otherwise(0) for s in splits), F.lit(0)) if len(splits) < 8 else F.lit(0)
    if len(splits) >= 8:
        index = F.array_size(F.filter(F.lit(splits), lambda s: s <= x))
    total = len(splits) + 1
    for v in splits:
        m = edges.count(v)
        if m > 1 and abs(v) < 1 << 53:  # beyond, unlike places may share a double
            sub = F.least(F.floor((h.cast("double") + float(1 << 63)) / float(1 << 64) * m), F.lit(m - 1))
            index = index + F.when(x > v, m).when(x == v, sub).otherwise(0)
            total += m
    return index.cast("int"), total


def compare_versions(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """docs (doc_id, text) -> a row of DDL per row."""
    spark = docs.sparkSession
    least = -(1 << 63)
    slim = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(least)).alias("place"), F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0]
    if size is None:
        return spark.createDataFrame([], DDL)
    ranges = ranges or min(MOST_RANGES, max(-(-size // RANGE_BYTES), 2 * spark.sparkContext.defaultParallelism))
    edges = slim.select(F.col("place").cast("double").alias("x")).approxQuantile("x", [k / ranges for k in range(1, ranges)], 0.2 / ranges)
    index, total = deal(sorted(edges), F.col("place"), F.col("h"))
    dealt = slim.withColumn("h", F.xxhash64("text")).withColumn("range", index)
    # the first document of each range that has any (one row a range)
    heads = sorted((r["range"], r.first.place, r.first.h) for r in dealt.groupBy("range").agg(F.min(F.struct("place", "h")).alias("first")).collect())
    before = [(place, h, heads[k - 1][0]) for k, (_, place, h) in enumerate(heads)]  # the first follows the last
    schema = arrow_schema(DDL)
    which = spark.createDataFrame(before, "place long, h long, range int")
    wanted = slim.where(F.col("place").isin([p for p, _, _ in before])) if len(heads) <= PUSHED else slim  # a filter that reaches the reader
    first = wanted.withColumn("h", F.xxhash64("text")).join(F.broadcast(which), ["place", "h"]).groupBy("place", "h", "range").agg(F.min("text").alias("text"))
    extra = first.select("place", "h", F.lit(None).cast("long").alias("doc_id"), "text", "range", F.lit(1).alias("extra"))
    rows = dealt.select("place", "h", "doc_id", "text", "range", F.lit(0).alias("extra")).unionByName(extra)
    rows = rows.repartitionById(total, F.col("range")).sortWithinPartitions("range", "extra", "place", "h", "text")
    rows = rows.select("doc_id", "text", "range", "extra")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for doc, text, own, extra in zip(*(b.column(k).to_pylist() for k in range(4))):
                held.append((doc, text))
                size += len(text)
                if extra:  # the end of a range
                    yield _rows(held, schema)
                    held, size = [], 0
                elif len(held) > BATCH or size > 8 << 20:
                    yield _rows(held, schema)
                    held = held[-1:]
                    size = len(held[0][1])

    return map_batches(rows, run, DDL)
