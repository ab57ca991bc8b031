"""Toxicity by class-conditional Kneser-Ney bigram models.

Two models, one of toxic and one of ordinary text. A word pair is discounted
and backs off to the word's continuation count (its distinct left contexts in
the class), that to the continuation counts of the word's stems (its first
letters, which inflections share, ever fewer of them), and those to counts which
both classes share.
Discounts are taken from the counts of both classes together, in proportion, and
the mass they free is one for both; so an expression that neither class attests
well has the same likelihood under both, and says nothing.

A text's evidence is the sum of the log ratios of all its tokens, plain or less
their trimmed mean for each token (what the mix of languages and topics adds to
every word of a text alike), over its length. The score is a logistic function of it. The
discounts, the trim, the tokens added to every length and the curve are those of the
greatest likelihood over `FOLDS` folds of the training rows; no other label has
a say. A line that a text repeats counts once, in learning also one that several
texts of a class share.

Training reads a bounded sample of the labelled rows: at most `max_docs` of
each class in expectation, picked by a hash of doc_id, and about `max_bytes` of
text (the documented bounds; scoring always covers every row and whole texts).
All words and pairs of the sample are counted; one whose count is not above the
discount has the ratio of the level below.

Defined cases: a null or empty text has one token, its end; the score of an
untrained model (no labelled rows, or one class only) is the share of toxic
labels (0.0 without labels); null labels and rows without text are not learnt
from; of labels that differ for one doc_id the toxic one counts; exact copies
are learnt once; repeated rows each give a row; an empty table gives no rows;
further columns of any name do no harm; among settings of equal likelihood the first is taken.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.base import arrow_schema, id_hash, map_batches, text_bytes

MAX_DOCS = 3000
MAX_BYTES = 16 << 20
#: Discounts of stems, words and pairs that are tried: the first two lie where Kneser-Ney discounts do (what occurs twice keeps
#: a ratio); under the others a count up to the discount says nothing.
GRID = ((0.75, 0.75, 0.75), (1.5, 1.5, 1.5), (5.0, 10.0, 16.0), (10.0, 10.0, 16.0), (20.0, 20.0, 16.0))
#: Shares of a text's lowest and of its highest log ratios, left out of what counts as its ordinary level, that are tried;
#: 0 takes no level off: the plain comparison of length-normalised likelihoods.
TRIM = (0.0, 0.15, 0.1)
#: Tokens added to every length that are tried.
STEADY = (20, 60, 120, 200)
FOLDS = 4
#: First letters of a word that its inflections may share, longest first.
STEMS = (6, 5, 4, 3)


def lines(raw: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words without punctuation around them, of each distinct line."""
    text = raw.decode("utf-8", "replace").lower()
    for line in dict.fromkeys(text.split("\n")):
        words = [w.strip(b".,;:!?\"'()[]#*%&$|") for w in line.encode().split()]
        yield [w for w in words if w]


def tokens(raw: bytes) -> list[bytes]:
    """The words of all distinct lines, then one end (empty)."""
    return [*(w for line in lines(raw) for w in line), b""]


def stems(word: bytes) -> list[bytes]:
    """What a word's inflections may share, longest first; marked, so that none is equal to a word."""
    letters = word.decode("utf-8", "replace")
    return [f"{letters[:n]}~{n}".encode() for n in STEMS]


@dataclass
class Model:
    """Log-likelihood ratios ready to add up; what is not in them backs off to a level where both classes agree."""

    vocab: dict[bytes, int]  # words with a ratio of their own
    stems: dict[bytes, int]  # ids of stems with one, for all other words
    ratio: np.ndarray  # log ratio by id; the last one, of what is unknown, is 0
    keys: np.ndarray  # sorted keys of the pairs that are left after the discount
    pair: np.ndarray  # their log ratios
    trim: float
    steady: int
    slope: float
    bias: float
    floor: float

    def per_token(self, words: list[bytes]) -> float:
        get, known, none = self.vocab.get, self.stems, len(self.ratio) - 1
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for i in np.flatnonzero(ids < 0).tolist():
            ids[i] = next((known[x] for x in stems(words[i]) if x in known), none)
        part = self.ratio[ids]
        if len(self.keys):
            n = len(self.vocab)
            before = np.concatenate(([self.vocab.get(b"", n)], ids[:-1]))  # a text starts after an end
            key = np.where((before < n) & (ids < n), before * n + ids, -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            part = np.where(self.keys[at] == key, self.pair[at], part)
        return evidence(part, self.trim) / (len(part) + self.steady)

    def score(self, words: list[bytes]) -> float:
        x = self.slope * self.per_token(words) + self.bias
        return self.floor + (1 - self.floor) / (1 + math.exp(-max(-50.0, min(50.0, x))))


def evidence(part: np.ndarray, trim: float) -> float:
    """The sum of log ratios over what they would be at their trimmed mean; for 0 the plain sum."""
    if not trim:
        return float(part.sum())
    n = len(part)
    cut = int(n * trim)
    return float(part.sum() - n * np.sort(part)[cut : n - cut].mean())


class Counts:
    """The tokens of the training rows as numbers, and class counts of any part of the rows.

    A line counts where it first occurs among the rows of its class, so that copies count once.
    """

    def __init__(self, rows: list[tuple[bytes, int]]):
        words: dict[bytes, int] = {b"": 0}  # the end is the first word
        numbers, fresh, met = [], [], set()
        self.lengths = np.zeros(len(rows), np.int64)
        for i, (raw, y) in enumerate(rows):
            for line in lines(raw):
                own = np.array([words.setdefault(w, len(words)) for w in line], np.int64)
                key = (y, own.tobytes())
                numbers.append(own)
                fresh.append(np.full(len(own), key not in met))
                met.add(key)
                self.lengths[i] += len(own)
            numbers.append(np.zeros(1, np.int64))
            fresh.append(np.ones(1, bool))
            self.lengths[i] += 1
        self.labels = np.array([y for _, y in rows])
        self.words, self.size = list(words), len(words)
        # the stems of each word by level, and the next shorter stem of each stem
        self.stem_names: list[list[bytes]] = []
        self.stem_of: list[np.ndarray] = []
        for names in zip(*map(stems, self.words)):
            found: dict[bytes, int] = {}
            self.stem_of.append(np.array([found.setdefault(x, len(found)) for x in names]))
            self.stem_names.append(list(found))
        flat, self.fresh = np.concatenate(numbers), np.concatenate(fresh)  # each row ends in an end, so the next one starts after it
        self.pairs, pair_of = np.unique(np.concatenate(([0], flat[:-1])) * self.size + flat, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        self.first, self.second = self.pairs // self.size, self.pairs % self.size
        self.starts = np.cumsum(self.lengths) - self.lengths

    def of(self, rows: np.ndarray) -> list[np.ndarray]:
        """The pair counts of the two classes over some rows (a mask)."""
        own = [np.repeat(rows & (self.labels == y), self.lengths) & self.fresh for y in (0, 1)]
        return [np.bincount(self.pair_of[m], minlength=len(self.pairs)).astype(float) for m in own]

    def held(self, ratio: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The evidence of some rows by a log ratio for each pair; a column a trim."""
        parts = (ratio[self.pair_of[self.starts[i] : self.starts[i] + self.lengths[i]]] for i in np.flatnonzero(rows))
        return np.array([[evidence(x, t) for t in TRIM] for x in parts])


def smoothed(counts: list[np.ndarray], lower: list[np.ndarray], discount: float) -> list[np.ndarray]:
    """Class distributions: counts less a discount shared in proportion, whose mass goes to the lower order."""
    n = counts[0] + counts[1]
    left = np.maximum(1 - discount / np.maximum(n, 1e-9), 0)
    mass = np.minimum(n, discount).sum() / n.sum()
    return [(1 - mass) * x * left / max((x * left).sum(), 1e-9) + mass * y for x, y in zip(counts, lower)]


@dataclass
class Levels:
    """Log ratios by stem (a level each), by word and by pair, and where a count outlives the discount."""

    stems: list[np.ndarray]
    words: np.ndarray
    pairs: np.ndarray
    own_stem: list[np.ndarray]
    own_word: np.ndarray
    own_pair: np.ndarray


def levels(c: Counts, counts: list[np.ndarray], stem_discount: float, discount: float, pair_discount: float) -> Levels:
    follows = [np.bincount(c.second, weights=x > 0, minlength=c.size) for x in counts]  # distinct left contexts
    both = follows[0] + follows[1] + 0.5
    ratios, outlive = [], []
    lower = None
    # from the shortest stems, over which both classes share their counts, to the longest
    for k in reversed(range(len(STEMS))):
        of, size = c.stem_of[k], len(c.stem_names[k])
        own = [np.bincount(of, weights=x, minlength=size) for x in follows]
        shared = np.bincount(of, weights=both, minlength=size)
        if lower is None:
            lower = [shared / shared.sum()] * 2
        else:
            up = np.zeros(size, np.int64)
            up[of] = c.stem_of[k + 1]
            lower = [x[up] * shared / above[up] for x in lower]
        lower, above = smoothed(own, lower, stem_discount), shared
        ratios.insert(0, np.log(lower[1] / lower[0]))
        outlive.insert(0, own[0] + own[1] > stem_discount)
    within = both / above[c.stem_of[0]]
    words = smoothed(follows, [x[c.stem_of[0]] * within for x in lower], discount)
    n = counts[0] + counts[1]
    left = np.maximum(1 - pair_discount / np.maximum(n, 1e-9), 0)
    total = np.bincount(c.first, weights=n, minlength=c.size)
    mass = (np.bincount(c.first, weights=np.minimum(n, pair_discount), minlength=c.size) / np.maximum(total, 1))[c.first]
    kept = [x * left for x in counts]
    sums = [np.bincount(c.first, weights=k, minlength=c.size)[c.first] for k in kept]
    known = np.minimum(*sums) > 0  # contexts that both classes know; after others both back off whole
    pairs = np.zeros(len(c.pairs))
    for sign, k, s, w in zip((-1, 1), kept, sums, words):
        low = w[c.second]
        pairs += sign * np.log(np.where(known, (1 - mass) * k / np.maximum(s, 1e-9) + mass * low, low))
    return Levels(ratios, np.log(words[1] / words[0]), pairs, outlive, follows[0] + follows[1] > discount, known & (left > 0))


def fit(texts: list[tuple[bytes, int]], base_rate: float | None = None) -> Model | float:
    """A model of (UTF-8 text, label) rows, or the share of toxic rows where that is all there is to learn."""
    rows = sorted(set(texts), key=lambda r: (len(r[0]), r))
    rate = base_rate if base_rate is not None else (sum(y for _, y in rows) / len(rows) if rows else 0.0)
    fold = np.arange(len(rows)) % FOLDS
    labels = np.array([y for _, y in rows])
    if any(set(labels[fold != k].tolist()) != {0, 1} for k in range(FOLDS)):
        return float(rate)
    c = Counts(rows)
    sums = np.zeros((len(GRID), len(rows), len(TRIM)))
    for k in range(FOLDS):  # the counts of one fold at a time
        part = c.of(fold != k)
        for g, discounts in enumerate(GRID):
            sums[g, fold == k] = c.held(levels(c, part, *discounts).pairs, fold == k)
        del part
    best = None
    for own, discounts in zip(sums, GRID):
        for t, trim in enumerate(TRIM):
            for steady in STEADY:
                found = calibrate(own[:, t] / (c.lengths + steady), labels, rate)
                if best is None or found[0] > best[0][0] + 1e-9:
                    best = (found, discounts, trim, steady)
    (_, slope, bias, floor), discounts, trim, steady = best
    own = levels(c, c.of(np.ones(len(rows), bool)), *discounts)
    # a word or pair that the discount uses up has the ratio of the level below: it need not be kept
    named = own.own_word.copy()
    named[c.first[own.own_pair]] = named[c.second[own.own_pair]] = True
    at = np.flatnonzero(named)
    number = np.full(c.size, -1)
    number[at] = np.arange(len(at))
    keys = number[c.first[own.own_pair]] * len(at) + number[c.second[own.own_pair]]
    order = np.argsort(keys)
    vocab = {c.words[i]: k for k, i in enumerate(at.tolist())}
    known: dict[bytes, int] = {}
    ratio = [own.words[at]]
    for names, values, kept in zip(c.stem_names, own.stems, own.own_stem):
        for i in np.flatnonzero(kept).tolist():
            known[names[i]] = len(at) + len(known)
        ratio.append(values[kept])
    return Model(vocab, known, np.concatenate((*ratio, [0.0])), keys[order], own.pairs[own.own_pair][order], trim, steady, slope, bias, floor)


def calibrate(x: np.ndarray, y: np.ndarray, rate: float) -> tuple[float, float, float, float]:
    """Log-likelihood, slope, bias and floor of the likeliest curve floor + (1 - floor) * logistic; rows weighted to the share `rate`.

    The floor is the share of toxic labels among texts without any toxic expression (labels err).
    """
    share = y.mean()
    rate = min(max(rate, 0.01), 0.99)
    w = np.where(y == 1, rate / share, (1 - rate) / (1 - share))
    scale = max(np.percentile(x, 90) - np.percentile(x, 10), 1e-3)
    best = (-np.inf, 1 / scale, 0.0, 0.0)
    for middle in np.unique(np.percentile(x, np.arange(40, 100, 1.0))):
        for slope in np.array([2, 4, 8, 16, 32, 64]) / scale:
            curve = 1 / (1 + np.exp(np.clip(-slope * (x - middle), -50, 50)))
            for floor in (0.0, 0.02, 0.05, 0.1):
                p = np.clip(floor + (1 - floor) * curve, 1e-3, 1 - 1e-2)
                likely = float((w * np.where(y == 1, np.log(p), np.log(1 - p))).sum())
                if likely > best[0]:
                    best = (likely, float(slope), float(-slope * middle), floor)
    return best


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> Model | float:
    """Learn from labelled rows of docs whose crc32(doc_id) mod 5 is not 0."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (F.pmod(id_hash(), F.lit(5)) != 0)
    )
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return 0.0
    rate = counts.get(1, 0) / sum(counts.values())
    # as many ordinary as toxic rows, 400 at least: evidence then weighs the same on both sides
    most = {1: max_docs, 0: min(max_docs, max(400, counts.get(1, 0)))}
    share = {y: min(1.0, most[y] / n) for y, n in counts.items()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1_000_000
    sample = own.where(place < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))
    # at most about 2 * max_docs ids: a proven bound for the broadcast
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = text.join(F.broadcast(sample), "doc_id").where("text is not null").select("doc_id", "text", "toxic")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size > max_bytes:  # long texts: fewer of them
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < int(1_000_000 * max_bytes / size))
    got = rows.select("text", "toxic").toArrow()
    return fit(list(zip(text_bytes(got["text"]), got["toxic"].to_pylist())), rate)


def scores(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, score for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema("doc_id long, score double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m if isinstance(m, float) else m.score(tokens(raw)) for raw in text_bytes(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model | float, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            raws = text_bytes(b.column(b.schema.get_field_index("text")))
            yield b.filter(pa.array([(m if isinstance(m, float) else m.score(tokens(raw))) < least for raw in raws], pa.bool_()))

    return map_batches(docs, run, docs.schema)
