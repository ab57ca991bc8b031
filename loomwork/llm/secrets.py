"""Secret scans by a linear-chain conditional random field.

Base spans come from three patterns and always stay. Beside them a linear-chain
CRF tags tokens as secret begin, inside or outside, from each token's shape,
the neighbouring words (hashed) and delimiters, and features of the whole file;
Viterbi decodes the likeliest tags, and tagged runs that no base span covers are
added as kind `crf`. The CRF is trained here by maximum likelihood, on a bounded
sample of passages labelled by the base patterns, and on copies of them with the
secret respelt and with other words before it. The bounds, for training alone:
about `TRAIN_DOCS` documents by a hash of doc_id, all their passages cut at
`PIECE` tokens, and `WINDOWS` of the pieces by a hash of their text, half of
them with secrets. Every text is scanned whole.

The chain runs over every token of a whole text. Emissions are gathered in numpy
from tables by token class, gap and context. A token whose emission loses to
outside by more than any two transitions can give back is outside on every best
path; the chain splits there exactly, and Viterbi decodes the runs between.
Only training looks at passages: the stretches within 48 bytes, widened to
blanks, of a digit, a delimiter, a keyword or a run of 20 bytes without blanks.

Defined cases: null text = empty = no spans; nothing to learn from: base spans
only; repeated rows each give a row; very long texts cost time in proportion;
of equally likely tags the lower one is taken; further columns of any name do no
harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import islands
from loomwork.llm.base import arrow_schema, map_batches, text_bytes

# The base patterns, their least lengths and order.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE, LEAST_ACCESS = 6, 20
ORDER = {"assign": 0, "access": 1, "hex": 2}
KEYWORDS = (b"passw", b"secret", b"token", b"api", b"key", b"auth", b"credential", b"private")

LONG = 20
_MARKED = islands.flags('0123456789=:"')
_REACH = 48
TOKEN = re.compile(r"""[^\s"'=:,;()<>\[\]{}|]+""")
GAP = re.compile(r"""([\s"'=:,;()<>\[\]{}|]+)""")
_CUT = re.compile(r"""[\s"'=:,;()<>\[\]{}|](?=[^\s"'=:,;()<>\[\]{}|])""")
#: Characters of a text, and tokens, that are in Python lists and in float tables at once; entries of the look-ups by string.
BLOCK, STEP, CACHED = 1 << 20, 1 << 18, 300_000
KEY = re.compile(r"(?ai)passw|secret|token|api_?key|\bkey\b|_key\b|auth|credential|private")
TRAIN_DOCS = 20_000
WINDOWS = 2400
PIECE = 40
#: Buckets of the neighbouring words.
BUCKETS = 4096
TAGS = 3  # outside, begin, inside


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


def values(text: str) -> list[tuple[int, int]]:
    """Where the base patterns see the secret itself (labels of the training passages)."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out + [m.span() for m in HEX.finditer(text)]


#: Letters for what a character is: d digit, x a to f, l other lower case, u upper case, m mark, o anything else.
_KIND = bytes(ord("d" if chr(c).isdigit() else "x" if chr(c) in "abcdef" else "l" if chr(c).islower() else "u" if chr(c).isupper() else "m" if chr(c) in "+/_.-" else "o") for c in range(128)) + b"o" * 128
_DIGIT = bytes(49 if c == 100 else 48 for c in range(256))


def outline(token: str) -> tuple[str, int, int, int]:
    """Kind, size class, turns between digits and others, and marks: what the features of a token's shape depend on."""
    n = len(token)
    if not token.isascii() and any(map(str.isdigit, token)):
        token = "".join("0" if c.isdigit() else c for c in token)
    t = token.encode("ascii", "replace").translate(_KIND)
    count = t.count
    digits, hexa, upper, marks = count(b"d"), count(b"x"), count(b"u"), count(b"m")
    lower = hexa + count(b"l")
    kind = (
        "number" if digits == n
        else "hex" if digits and not upper and digits + hexa == n
        else "letters" if not digits and lower + upper + marks >= n - 1
        else "foreign" if digits + upper + lower + marks < n // 2
        else "mixed3" if digits and upper and lower
        else "mixed2" if digits and (upper or lower) and not marks
        else "marked" if marks else "other"
    )
    turns = 0
    if 0 < digits < n:
        t = t.translate(_DIGIT)
        turns = t.count(b"01") + t.count(b"10")
    size = (n >= 4) + (n >= 8) + (n >= 16) + (n >= 20) + (n >= 24) + (n >= 32) + (n >= 48)
    return kind, size, min(turns, 12) // 3, min(marks, 3)


def named(kind: str, size: int, turns: int, marks: int) -> list[str]:
    return [f"kind={kind}", f"size={size}", f"kind,size={kind},{size}", f"turns={turns}", f"marks={marks}"]


def shape(token: str) -> list[str]:
    return named(*outline(token))


def bucket(token: str) -> int:
    """What is learnt of a neighbouring word: a hash of it, in lower case."""
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS


def file_features(raw: bytes) -> list[str]:
    return [f"begin={b'-----BEGIN' in raw}", f"assigns={min(raw.count(b' = ') + raw.count(b': '), 3)}"]


def features(text: str, spans: list[tuple[int, int]], whole: list[str]) -> list[list[str]]:
    """Names of the features of each token of a passage."""
    shapes = [shape(text[a:z]) for a, z in spans]
    keys = [bool(KEY.search(text[a:z])) for a, z in spans]
    near = [bucket(text[a:z]) for a, z in spans]
    out = []
    for i, (a, z) in enumerate(spans):
        before = text[spans[i - 1][1] if i else 0 : a]
        after = text[z : spans[i + 1][0] if i + 1 < len(spans) else len(text)]
        key_before = i > 0 and keys[i - 1] or i > 1 and keys[i - 2]
        delimiter = "=" in before or ":" in before
        out.append([
            "bias", *shapes[i], *(f"{f}|{shapes[i][0]}" for f in whole),
            f"key before={key_before}", f"delimited={delimiter}", f"key,delimited={key_before},{delimiter}",
            f"quoted={before[-1:] in _QUOTES and after[:1] in _QUOTES and bool(before)}", f"is key={keys[i]}", f"delimiter after={'=' in after or ':' in after}",
            f"before {shapes[i - 1][0] if i else 'none'}", f"after {shapes[i + 1][0] if i + 1 < len(spans) else 'none'}",
            *(f"word {k} {near[i + k]}" for k in (-2, -1, 1) if 0 <= i + k < len(spans)),
        ])
    return out


_QUOTES = ('"', "'")


@dataclass
class Crf:
    """Weights by feature and tag, and by tag pair."""

    weights: dict[str, np.ndarray]
    transitions: np.ndarray

    def emissions(self, names: list[list[str]]) -> np.ndarray:
        zero = np.zeros(TAGS)
        get = self.weights.get
        return np.array([sum((get(f, zero) for f in own), zero) for own in names]).reshape(-1, TAGS)

    def decode(self, names: list[list[str]]) -> list[int]:
        return viterbi(self.emissions(names), self.transitions)

    @cached_property
    def tables(self) -> Tables:
        return Tables(self)


class Lookup(dict):
    """A function of short strings that keeps a bounded number of results."""

    def __init__(self, f):
        super().__init__()
        self.f = f

    def __missing__(self, x: str) -> int:
        got = self.f(x)
        if len(x) <= 64:
            if len(self) >= CACHED:
                self.clear()
            self[x] = got
        return got


def gap_bits(gap: str) -> int:
    """1: holds a delimiter, 2: ends in a quote, 4: begins with one."""
    return ("=" in gap or ":" in gap) + 2 * (gap[-1:] in _QUOTES) + 4 * (gap[:1] in _QUOTES)


class Tables:
    """The weights of a model summed by what a token's features depend on, each as tags 1 and 2 against outside.

    A token's class is its shape, whether it is a keyword, and its bucket as far as neighbours have learnt it.
    """

    KINDS = ("none", "number", "hex", "foreign", "letters", "mixed3", "mixed2", "marked", "other")

    def __init__(self, model: Crf):
        self.model = model
        self.number: dict[tuple, int] = {}
        size = 1024  # of the tables, doubled as classes are met; class 0 is beyond the ends of a text
        self.own, self.kind, self.key = np.zeros((size, TAGS - 1)), np.zeros(size, np.int64), np.zeros(size, bool)
        self.near = np.zeros(size, np.int64)
        self.classes, self.gaps = Lookup(self.class_of), Lookup(gap_bits)
        self.context = np.array([
            self.sum([f"key before={k}", f"delimited={d}", f"key,delimited={k},{d}", f"quoted={q}", f"delimiter after={a}"])
            for k in (False, True) for d in (False, True) for q in (False, True) for a in (False, True)
        ])
        self.before, self.after = (np.array([self.sum([f"{w} {k if k == 'none' else 'kind=' + k}"]) for k in self.KINDS]) for w in ("before", "after"))
        learnt = sorted({int(f.split()[2]) for f in model.weights if f.startswith("word ")})
        self.learnt = {x: i + 1 for i, x in enumerate(learnt)}
        self.second, self.last, self.next = (np.array([np.zeros(TAGS - 1), *(self.sum([f"word {k} {x}"]) for x in learnt)]) for k in (-2, -1, 1))
        self.whole: dict[tuple, np.ndarray] = {}
        tr = model.transitions
        self.turn = np.array([max(tr[a, s] + tr[s, c] - tr[a, 0] - tr[0, c] for a in range(TAGS) for c in range(TAGS)) for s in range(1, TAGS)])

    def sum(self, names: list[str]) -> np.ndarray:
        w = sum((self.model.weights.get(f, np.zeros(TAGS)) for f in names), np.zeros(TAGS))
        return w[1:] - w[0]

    def class_of(self, token: str) -> int:
        own, key, near = outline(token), bool(KEY.search(token)), self.learnt.get(bucket(token), 0)
        k = self.number.get((own, key, near))
        if k is None:
            k = self.number[own, key, near] = len(self.number) + 1
            if k == len(self.own):
                self.own, self.kind, self.key, self.near = (np.concatenate((x, np.zeros_like(x))) for x in (self.own, self.kind, self.key, self.near))
            self.own[k] = self.sum(["bias", *named(*own), f"is key={key}"])
            self.kind[k], self.key[k], self.near[k] = self.KINDS.index(own[0]), key, near
        return k

    def tags(self, text: str, whole: list[str]) -> tuple[np.ndarray, list[int], list[tuple[int, int, int]]]:
        """(places of tokens that are not surely outside, their tags, blocks as first token, start and end) of a text."""
        ids, gaps, blocks = [np.zeros(2, np.int32)], [], []
        at = n = 0
        while at < len(text):
            m = _CUT.search(text, at + BLOCK) if at + BLOCK < len(text) else None
            to = m.end() if m else len(text)
            parts = GAP.split(text[at:to])
            tokens, between = parts[::2], parts[1::2]
            lead = not tokens[0]
            if not at:
                gaps.append(np.array([gap_bits(between[0]) if lead and between else 0], np.uint8))
            # a later block starts with a token, an earlier one ends with a gap
            tokens = tokens[lead : len(tokens) - (len(tokens) > 1 and not tokens[-1])]
            between = between[lead:]
            ids.append(np.fromiter(map(self.classes.__getitem__, tokens), np.int32, len(tokens)))
            gaps.append(np.fromiter(map(self.gaps.__getitem__, between), np.uint8, len(between)))
            blocks.append((n, at, to))
            at, n = to, n + len(tokens)
        id_ = np.concatenate((*ids, [0]))
        gap = np.concatenate((*gaps, np.zeros(1, np.uint8)))
        key = tuple(whole)
        if key not in self.whole:
            self.whole[key] = np.array([self.sum([f"{f}|kind={k}" for f in whole]) for k in self.KINDS])
        of_file = self.whole[key]
        places, rows = [], []
        for a in range(0, n, STEP):
            z = min(a + STEP, n)
            own, last, second, following = id_[a + 2 : z + 2], id_[a + 1 : z + 1], id_[a:z], id_[a + 3 : z + 3]
            before, after = gap[a:z], gap[a + 1 : z + 1]
            context = (self.key[last] | self.key[second]) * 8 + (before & 1) * 4 + (before >> 1 & after >> 2 & 1) * 2 + (after & 1)
            em = self.own[own] + of_file[self.kind[own]] + self.context[context] + self.before[self.kind[last]] + self.after[self.kind[following]]
            em += self.second[self.near[second]] + self.last[self.near[last]] + self.next[self.near[following]]
            live = np.flatnonzero((em + self.turn >= -1e-9).any(axis=1))
            places.append(live + a)
            rows.append(em[live])
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        out: list[int] = []
        if len(place):
            em = np.concatenate(rows)
            em = np.concatenate((np.zeros((len(em), 1)), em), axis=1)
            cut = np.flatnonzero(np.diff(place) > 1) + 1
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(place)]):
                out += viterbi(em[a:z], self.model.transitions)
        return place, out, blocks


def viterbi(em: np.ndarray, tr: np.ndarray) -> list[int]:
    """The likeliest tags of a sequence between two outside tokens; ties go to the lower tag."""
    if not len(em):
        return []
    best = tr[0] + em[0]
    back = []
    for e in em[1:]:
        way = best[:, None] + tr
        back.append(way.argmax(axis=0))
        best = way.max(axis=0) + e
    tag = int((best + tr[:, 0]).argmax())
    out = [tag]
    for b in reversed(back):
        tag = int(b[tag])
        out.append(tag)
    return out[::-1]


class Batch:
    """Passages (feature names and tags of each token) as arrays."""

    def __init__(self, passages: list[tuple[list[list[str]], list[int]]]):
        self.number: dict[str, int] = {}
        for names, _ in passages:
            for own in names:
                for f in own:
                    self.number.setdefault(f, len(self.number))
        width = max(len(own) for names, _ in passages for own in names)
        n, steps = len(passages), max(len(names) for names, _ in passages)
        none = len(self.number)
        self.mask = np.arange(steps) < np.array([[len(names)] for names, _ in passages])
        self.gold = np.zeros((n, steps), np.int64)
        self.ids = np.array([[*(self.number[f] for f in own), *[none] * (width - len(own))] for names, _ in passages for own in names])
        self.between = np.zeros((TAGS, TAGS))
        for i, (_, tags) in enumerate(passages):
            self.gold[i, : len(tags)] = tags
            np.add.at(self.between, ([0, *tags], [*tags, 0]), 1)

    def likelihood(self, w: np.ndarray, tr: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the tags and its gradients by forward and backward sums; the last row of w stays 0."""
        n, steps = self.mask.shape
        em = np.zeros((n, steps, TAGS))
        em[self.mask] = w[self.ids].sum(axis=1)
        a, b = np.zeros_like(em), np.zeros_like(em)
        a[:, 0] = em[:, 0] + tr[0]
        for t in range(1, steps):
            step = _logsum(a[:, t - 1, :, None] + tr, 1) + em[:, t]
            a[:, t] = np.where(self.mask[:, t, None], step, a[:, t - 1])
        ends = _logsum(a[:, -1] + tr[:, 0], 1)
        b[:, -1] = tr[:, 0]
        for t in range(steps - 2, -1, -1):
            step = _logsum(tr + (em[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(self.mask[:, t + 1, None], step, tr[:, 0])
        p = np.exp(a + b - ends[:, None, None]) * self.mask[..., None]
        pair = np.zeros((TAGS, TAGS))
        for t in range(1, steps):
            on = self.mask[:, t]
            if on.any():
                pair += np.exp(a[on, t - 1, :, None] + tr + (em[on, t] + b[on, t])[:, None, :] - ends[on, None, None]).sum(axis=0)
        pair[0] += p[:, 0].sum(axis=0)
        pair[:, 0] += p[np.arange(n), self.mask.sum(axis=1) - 1].sum(axis=0)
        gold = np.eye(TAGS)[self.gold] * self.mask[..., None]
        delta = (gold - p)[self.mask]
        flat, width = self.ids.ravel(), self.ids.shape[1]
        g = np.stack([np.bincount(flat, np.repeat(delta[:, k], width), len(w)) for k in range(TAGS)], axis=1)
        g[-1] = 0
        value = (em * gold).sum() + (self.between * tr).sum() - ends.sum()
        return float(value), g, self.between - pair


def fit(passages: list[tuple[list[list[str]], list[int]]], rounds: int = 90, penalty: float = 0.05) -> Crf | None:
    """Maximum likelihood with an L2 penalty, by Adam over all passages at once."""
    passages = [p for p in passages if p[0]]
    if not any(any(tags) for _, tags in passages):
        return None
    batch = Batch(passages)
    w, tr = np.zeros((len(batch.number) + 1, TAGS)), np.zeros((TAGS, TAGS))
    m1, m2, v1, v2 = np.zeros_like(w), np.zeros_like(tr), np.zeros_like(w), np.zeros_like(tr)
    for k in range(1, rounds + 1):
        _, g, gt = batch.likelihood(w, tr)
        for x, grad, m, v in ((w, g - penalty * w, m1, v1), (tr, gt - penalty * tr, m2, v2)):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad * grad
            x += 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-6)
    return Crf({f: w[i].copy() for f, i in batch.number.items()}, tr)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


def pieces(raw: bytes) -> Iterator[str]:
    """The stretches of a text that training draws on, cut at `PIECE` tokens."""
    for _, text in islands.decoded(raw, islands.stretches(raw, _MARKED, _REACH, LONG, KEYWORDS)):
        ends = [m.end() for m in TOKEN.finditer(text)][PIECE - 1 :: PIECE]
        for a, z in zip([0, *ends], [*ends, len(text)]):
            if a < z:
                yield text[a:z]


def tagged(model: Crf, text: str, whole: list[str]) -> list[tuple[int, int]]:
    """The runs that Viterbi over the whole text tags as secrets."""
    place, tags, blocks = model.tables.tags(text, whole)
    held = [(i, t) for i, t in zip(place.tolist(), tags) if t]
    out: list[list[int]] = []
    done, spans, first, last = 0, [], 0, -1
    for i, tag in held:
        while done < len(blocks) and blocks[done][0] <= i:
            first, start, end = blocks[done]
            spans, done = [], done + 1
        if not spans:
            spans = [m.span() for m in TOKEN.finditer(text, start, end)]
        a, z = spans[i - first]
        if tag == 2 and last == i - 1 and out:
            out[-1][1] = z
        else:
            out.append([a, z])
        last = i
    return [(a, z) for a, z in out]


def scan(raw: bytes, model: Crf | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans the model adds) of a UTF-8 text, in code points."""
    text = raw.decode("utf-8", "replace")
    base = base_spans(text)
    added = []
    if model:
        taken = islands.Taken(base)
        added = [("crf", a, z) for a, z in tagged(model, text, file_features(raw)) if not taken.meets(a, z)]
    return base, added


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> Crf | None:
    """Labelled passages of a hashed sample of texts that hold a digit or a delimiter."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("text").rlike("[0-9=]"))
    n = docs.where(F.col("text").isNotNull()).count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_000)) / 1_000_000
    rows = rows.where(place < min(1.0, max_docs / max(n, 1)))
    ddl = "doc_id long, passage string, whole string, secret boolean"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), [x.encode() for x in b.column(1).to_pylist()]):
                whole = "\t".join(file_features(raw))
                out += [(doc, text, whole, bool(values(text))) for text in pieces(raw)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 4, schema)], schema=schema)

    got = map_batches(rows, run, ddl).groupBy("passage").agg(F.min("whole").alias("whole"), F.max("secret").alias("secret"))
    rank = F.xxhash64("passage")
    found = []
    for secret in (True, False):  # as many passages with as without secrets
        found += got.where(F.col("secret") == secret).orderBy(rank, "passage").limit(WINDOWS // 2).collect()
    learnt = []
    for r in found:
        for text, secrets in [(r.passage, values(r.passage)), *([varied(r.passage), introduced(r.passage)] if r.secret else [])]:
            tokens = [m.span() for m in TOKEN.finditer(text)]
            learnt.append((features(text, tokens, r.whole.split("\t")), labels(tokens, secrets)))
    return fit(learnt)


_ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits, "0123456789abcdef")


def varied(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The passage with its secrets spelt in another alphabet and length (fixed by the passage), and where they are.

    So the tagger learns what surrounds a secret, not only the alphabets that the base patterns know.
    """
    out, at, secrets = "", 0, []
    for a, z in sorted(values(text)):
        if a < at:
            continue
        source = random.Random(hashlib.sha256(f"{text}{a}".encode()).digest())
        alphabet = source.choice(_ALPHABETS)
        new = "".join(source.choice(alphabet) for _ in range(source.choice((16, 18, 20, 22, 24, 32, 40, 48))))
        out += text[at:a] + new
        secrets.append((len(out) - len(new), len(out)))
        at = z
    return out + text[at:], secrets


# Words and marks that may introduce a secret.
_NAMES = (
    "api key", "api_key", "access key", "auth", "authorization", "bearer", "client_secret", "client_secret_value", "credential", "credentials",
    "db_pass", "login", "passphrase", "password", "private key", "private_key", "pwd", "secret", "secret_access_key", "signing key", "token",
)
_MARKS = (" ", ": ", " = ", "=", ":", " -> ", " => ", " is ", " was ", ": '", " = '", "='", "('", "(\"")


def introduced(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The passage with its last secret respelt or turned into an ordinary word, behind other words, and where secrets are.

    After a word that no base pattern knows, an ordinary word is no secret: both kinds are learnt.
    """
    out, secrets = varied(text)
    if not secrets:
        return out, secrets
    a, z = secrets[-1]
    source = random.Random(hashlib.sha256(f"introduced{text}".encode()).digest())
    start = max((m.end() for m in re.finditer(r"\s", out[: max(0, a - 24)])), default=0)
    lead = out[start:a]
    mark = source.choice(_MARKS)
    name = source.choice(_NAMES)
    words = [w for w in re.findall(r"[A-Za-z]{3,}", text) if not KEY.search(w)] or ["missing"]
    plain = source.random() < 0.4
    value = source.choice(words).lower() if plain else out[a:z]
    close = {"'": "'", '"': '"'}.get(mark[-1], "")
    keep = lead[: len(lead) // 2].rsplit(" ", 1)[0] + " " if " " in lead[: len(lead) // 2] else ""
    head = out[:start] + keep + name + mark
    rest = out[z:].lstrip("\"'")
    new = head + value + close + rest
    base = ASSIGN.search(f"{name}{mark}{value}")
    held = [s for s in secrets[:-1] if s[1] <= start]
    if not plain or base and base.end(2) - base.start(2) >= LEAST_VALUE:
        held.append((len(head), len(head) + len(value)))
    return new, held


def labels(spans: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """Tags of the tokens: begin or inside where a secret overlaps them."""
    out = []
    before = None
    for a, z in spans:  # of a passage, so there are few of either
        own = next((s for s in secrets if a < s[1] and s[0] < z), None)
        out.append(0 if own is None else 2 if own == before else 1)
        before = own
    return out


def find(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            out = []
            for doc, raw in zip(b.column(0).to_pylist(), text_bytes(b.column(1))):
                base, added = scan(raw, m)
                kinds = [k for k, _, _ in base]
                digest = hashlib.sha256(islands.digest_text(base, ORDER).encode()).hexdigest()
                out.append((doc, *(kinds.count(k) for k in ORDER), digest, islands.digest_text(base + added, ORDER)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * len(schema), schema)], schema=schema)

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(slim, run, ddl)
