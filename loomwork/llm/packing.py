"""Packing documents into fixed windows by non-negative least squares.

A document's ids are cut into whole windows, which are sequences by themselves,
and a remainder. The remainders of a block of documents make a histogram of
lengths; shallow combinations of two or three lengths that fill a window
exactly are its columns, and non-negative least squares solves how often to use
each. The counts are rounded down, and what is left is packed greedily, the
longest first, cutting a piece where nothing fits, so that every sequence but a
block's last is full. That last one is carried into the next block; the last of
a partition is cut at powers of two and so needs no padding either.

Every partition packs its own documents, with memory bounded by a block: no
shuffle, and nothing on the driver. A sequence never spans partitions.

Defined cases: null text = empty = the end id alone; repeated rows each keep
their own pieces; a document of an exact multiple of the window leaves no
remainder; an empty table gives no rows. A text that contains the string of a
special token is tokenized by the tokenizers library, as is one that the faster
library fails on (a very long run of white space); all others by that one, with
the same vocabulary and merges, which gives the same ids (tested).
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.base import arrow_schema, map_batches

WINDOW = 2048
END = 1
#: Ids whose remainders are packed together.
BLOCK_IDS = 4_000_000
#: Commonest lengths that combinations of three are made of.
COMMON = 48

DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_ENCODERS: dict[str, tuple] = {}


class Encoder:
    """Ids of a text by the vocabulary at `path` (a tokenizers file) and its ranks at `ranks`."""

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]

    def __call__(self, text: str) -> list[int]:
        if not any(s in text for s in self.special):
            try:
                return self.fast.encode_ordinary(text)
            except BaseException as e:  # very long runs of white space overflow its stack; the panic is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return self.slow.encode(text, add_special_tokens=False).ids


def public_encoder(name: str = "byte_bpe_50k") -> Encoder:
    """The installed public vocabulary of that name; loaded once per process."""
    if name not in _ENCODERS:
        import public_tokenizers as public

        _ENCODERS[name] = Encoder(public.path(f"{name}.json"), public.path(f"{name}.tiktoken"), public.PATTERN)
    return _ENCODERS[name]


def combinations(histogram: np.ndarray, window: int = WINDOW, common: int = COMMON) -> np.ndarray:
    """Rows of three lengths (0 for none) that fill the window, from lengths that occur."""
    present = np.flatnonzero(histogram)
    has = histogram > 0
    pairs = [(0, a, window - a) for a in present[present * 2 <= window] if has[window - a]]
    top = np.sort(present[np.argsort(-histogram[present], kind="stable")[:common]])
    triples = set()
    for i, a in enumerate(top):
        for b in top[i:]:
            c = window - a - b
            if c > 0 and has[c]:
                triples.add(tuple(sorted((int(a), int(b), int(c)))))
    return np.array(pairs + sorted(triples), np.int64).reshape(-1, 3)


def solve(combos: np.ndarray, histogram: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2 (accelerated projected gradient on the sparse A)."""
    if not len(combos):
        return np.zeros(0)
    size = len(histogram)
    goal = histogram.astype(float)
    goal[0] = 0

    def times(x: np.ndarray) -> np.ndarray:
        y = sum(np.bincount(combos[:, k], weights=x, minlength=size) for k in range(3))
        y[0] = 0
        return y

    def turned(r: np.ndarray) -> np.ndarray:
        return r[combos[:, 0]] + r[combos[:, 1]] + r[combos[:, 2]]

    v = np.ones(len(combos))
    for _ in range(12):  # the largest eigenvalue of A'A sets the step
        v = turned(times(v))
        largest = np.linalg.norm(v)
        v /= largest
    step = 1 / max(largest, 1e-9)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(y - step * turned(times(y) - goal), 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


class Packer:
    """Collects remainders; `pieces` are [document number, start, length]."""

    def __init__(self, window: int = WINDOW):
        self.window = window

    def pack(self, pieces: list[tuple]) -> tuple[list[list[tuple]], list[tuple]]:
        """(full sequences, pieces of the last partial one); lengths are 1 to window - 1."""
        w = self.window
        stock: list[deque] = [deque() for _ in range(w)]
        for p in pieces:
            stock[p[2]].append(p)
        histogram = np.array([len(s) for s in stock])
        full: list[list[tuple]] = []
        combos = combinations(histogram, w)
        counts = solve(combos, histogram)
        for k in np.argsort(-counts, kind="stable"):
            n = int(counts[k] + 1e-6)
            if not n:
                break
            lengths = [int(c) for c in combos[k] if c]
            for _ in range(n):
                if any(len(stock[c]) < lengths.count(c) for c in lengths):
                    break
                full.append([stock[c].popleft() for c in lengths])
        left = sorted(c for c, s in enumerate(stock) for _ in s)
        current: list[tuple] = []
        room = w
        while left:
            at = bisect_right(left, room) - 1
            if at >= 0:
                piece = stock[left.pop(at)].popleft()
            else:  # nothing fits: cut the shortest piece
                whole = stock[left.pop(0)].popleft()
                piece = (whole[0], whole[1], room)
                rest = (whole[0], whole[1] + room, whole[2] - room)
                stock[rest[2]].append(rest)
                insort(left, rest[2])
            current.append(piece)
            room -= piece[2]
            if not room:
                full.append(current)
                current, room = [], w
        return full, current


def powers(pieces: list[tuple]) -> list[list[tuple]]:
    """Sequences of the pieces whose lengths are powers of two."""
    out = []
    queue = deque(pieces)
    total = sum(p[2] for p in pieces)
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        own = []
        while room:
            doc, start, length = queue.popleft()
            if length > room:
                queue.appendleft((doc, start + room, length - room))
                length = room
            own.append((doc, start, length))
            room -= length
        out.append(own)
    return out


def pack(docs: DataFrame, window: int = WINDOW, end: int = END, vocabulary: str = "byte_bpe_50k", block_ids: int = BLOCK_IDS) -> DataFrame:
    """docs (doc_id, text) -> a row per piece (see DDL)."""
    schema = arrow_schema(DDL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = public_encoder(vocabulary)
        packer = Packer(window)
        context = TaskContext.get()
        serial = (context.partitionId() if context else 0) << 40
        held: dict[int, tuple] = {}  # document number -> (doc_id, ids as uint32, tokens), while a remainder waits
        waiting: list[tuple] = []
        number = total = 0

        def rows(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal serial
            out = []
            for s in sequences:
                offset = 0
                for doc, start, length in s:
                    doc_id, ids, tokens, base = held[doc]
                    crc = zlib.crc32(ids[start - base : start - base + length].tobytes())
                    out.append((doc_id, start, length, crc, tokens, serial, offset))
                    offset += length
                serial += 1
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end], dtype="<u4")
                n = len(ids)
                whole = n - n % window
                held[number] = (doc_id, ids, n, 0)
                if whole:
                    yield rows([[(number, at, window)] for at in range(0, whole, window)])
                    held[number] = (doc_id, ids[whole:].copy(), n, whole)
                if n > whole:
                    waiting.append((number, whole, n - whole))
                    total += n - whole
                else:
                    del held[number]
                number += 1
                if total >= block_ids:
                    full, waiting = packer.pack(waiting)
                    yield rows(full)
                    held = {p[0]: held[p[0]] for p in waiting}
                    total = sum(p[2] for p in waiting)
        full, waiting = packer.pack(waiting)
        yield rows(full + powers(waiting))

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, run, DDL)
