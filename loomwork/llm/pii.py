"""Personal data by a semi-Markov conditional random field.

Base spans come from four patterns (e-mail, IP, card, phone) and always stay.
Beside them a semi-Markov CRF segments each stretch of text that holds a digit
or an @: whole-span features (digit count, separators, Luhn, part values, what
stands before and after) score every candidate segment, and dynamic programming
over at most `LONGEST` tokens a segment jointly chooses boundaries and types.
Segments that no base span overlaps are added under their type.

An entity must hold an @ or at least `DIGITS` digits and begin and end on a
letter, digit, + or parenthesis: elsewhere only the type `other` of one token
is possible, so stretches without digit and @ need no look. The CRF is trained
here by stochastic gradient on the log-likelihood of a bounded sample of
passages labelled by the base patterns. The bounds, for training alone: about
`TRAIN_DOCS` documents by a hash of doc_id, all their stretches cut at `PIECE`
tokens, and `PASSAGES` of the pieces with and as many without entities, by a
hash of their text. Every text is scanned whole, each stretch by one program.

Defined cases: null text = empty = no spans; nothing to learn from: base spans
only; repeated rows each give a row; a very long stretch costs time in proportion
and memory for a number a token; of equally good segmentations the one with
fewer and earlier-ending entities is taken; further columns of any name do no
harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm import islands
from loomwork.llm.base import arrow_schema, map_batches, text_bytes

# The base patterns (written so that they match in linear time) and their order.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ORDER = {"email": 0, "ip": 1, "card": 2, "phone": 3}

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")
LONGEST = 14
DIGITS, MOST_DIGITS = 7, 24
TRAIN_DOCS = 10_000
PASSAGES = 500
PIECE = 400
EPOCHS = 4
_MARKED = islands.flags("0123456789@")
_REACH = 24


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from each @."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, z) for a, z in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_octet, m.groups()))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


TYPES = ("email", "ip", "card", "phone")


def span_features(text: str, a: int, z: int) -> list[str] | None:
    """Whole-span features of text[a:z], or None where no entity is possible."""
    s = text[a:z]
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum() or "\n" in s:
        return None
    digits = _digits(s)
    n = len(digits)
    at = s.count("@")
    if not at and n < DIGITS or at > 1 or n > MOST_DIGITS:
        return None
    letters = any(c.isalpha() for c in s)
    blank = " " in s
    marks = "".join(sorted({c for c in s if not c.isalnum()}))
    before, after = text[a - 1 : a], text[z : z + 1]
    edge = f"{_edge(before)}{_edge(after)}"
    out = [
        f"marks={marks[:8]}", f"digits={min(n, 20)}", f"at={at},letters={letters},blank={blank}", f"edge={edge}", f"plus={s[0] == '+'}",
        f"plus,digits={s[0] == '+'},{10 <= n <= 15}", f"card={not letters and 14 <= n <= 19},{14 <= n <= 19 and luhn(digits)}",
    ]
    parts = s.split(".")
    out.append(f"ip={len(parts) == 4 and all(p.isdigit() and _octet(p) for p in parts)}")
    if at:
        local, domain = s.split("@")
        out.append(f"email={bool(local) and '.' in domain and domain.rsplit('.', 1)[1].isalpha()},{blank}")
    return out


def _edge(c: str) -> str:
    return "e" if not c or c.isspace() else "d" if c.isdigit() else "a" if c.isalpha() else "@" if c in "@+" else "."


@dataclass
class SemiCrf:
    """Weights by (feature, type); tokens outside entities score 0."""

    weights: dict[tuple[str, str], float]

    def score(self, names: list[str], kind: str) -> float:
        get = self.weights.get
        return sum(get((f, kind), 0.0) for f in names) + get(("bias", kind), 0.0)


def segments(text: str, tokens: list[tuple[int, int]]) -> Iterator[tuple[int, int, list[str]]]:
    """Candidate entities (first token, token after the last, features), by last token."""
    # running counts of digits and @ rule most segments out before their text is looked at
    digits, ats = [0], [0]
    for a, z in tokens:
        digits.append(digits[-1] + (z - a if "0" <= text[a] <= "9" else 0))
        ats.append(ats[-1] + (text[a] == "@"))
    begins = [text[a].isalnum() or text[a] in "+(" for a, _ in tokens]
    for j in range(1, len(tokens) + 1):
        if not text[tokens[j - 1][1] - 1].isalnum():
            continue
        for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
            n, at = digits[j] - digits[i], ats[j] - ats[i]
            if n > MOST_DIGITS or at > 1:
                break
            if begins[i] and (at or n >= DIGITS) and (names := span_features(text, tokens[i][0], tokens[j - 1][1])):
                yield i, j, names


def decode(model: SemiCrf, n: int, candidates: Iterable[tuple[int, int, list[str]]]) -> list[tuple[int, int, str]]:
    """The best segmentation of n tokens: the entities in it. Candidates come by their last token and are not kept."""
    best, back = [0.0] * (n + 1), [None] * (n + 1)
    done = 0
    for i, j, names in candidates:
        while done < j:  # best and back are final up to done
            done += 1
            best[done] = best[done - 1]
        for kind in TYPES:
            s = model.score(names, kind)
            if s > 0 and best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, kind)
    out, j = [], done  # nothing ends later
    while j:
        if back[j] is None:
            j -= 1
        else:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
    return out[::-1]


def fit(passages: list[str], epochs: int = EPOCHS, rate: float = 0.5, penalty: float = 1e-4) -> SemiCrf | None:
    """Stochastic gradient on the log-likelihood of the base labels."""
    data = []
    for text in passages:
        tokens = [m.span() for m in TOKEN.finditer(text)]
        candidates = list(segments(text, tokens))
        starts = {a: i for i, (a, _) in enumerate(tokens)}
        ends = {z: i + 1 for i, (_, z) in enumerate(tokens)}
        gold, taken = set(), 0
        for kind, a, z in base_spans(text):
            if a in starts and z in ends and starts[a] >= taken:
                gold.add((starts[a], ends[z], kind))
                taken = ends[z]
        if candidates:
            data.append((len(tokens), candidates, gold))
    if not any(gold for _, _, gold in data):
        return None
    model = SemiCrf({("bias", k): -1.0 for k in TYPES})
    w = model.weights
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for n, candidates, gold in data:
            scored = [(i, j, names, [model.score(names, k) for k in TYPES]) for i, j, names in candidates]
            ends: dict[int, list] = {}
            starts: dict[int, list] = {}
            for c in scored:
                ends.setdefault(c[1], []).append(c)
                starts.setdefault(c[0], []).append(c)
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                alpha[j] = _log_add([alpha[j - 1], *(alpha[c[0]] + s for c in ends.get(j, ()) for s in c[3])])
            for i in range(n - 1, -1, -1):
                beta[i] = _log_add([beta[i + 1], *(beta[c[1]] + s for c in starts.get(i, ()) for s in c[3])])
            whole = alpha[n]
            for i, j, names, scores in scored:
                for kind, s in zip(TYPES, scores):
                    p = math.exp(min(0.0, alpha[i] + s + beta[j] - whole))
                    delta = ((i, j, kind) in gold) - p
                    if abs(delta) > 1e-4:
                        for f in (*names, "bias"):
                            w[f, kind] = w.get((f, kind), 0.0) * (1 - penalty) + step * delta
    return model


def _log_add(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def entities(model: SemiCrf, offset: int, text: str) -> list[tuple[str, int, int]]:
    tokens = [m.span() for m in TOKEN.finditer(text)]
    return [(kind, offset + tokens[i][0], offset + tokens[j - 1][1]) for i, j, kind in decode(model, len(tokens), segments(text, tokens))]


def passages(raw: bytes) -> list[tuple[int, str]]:
    return islands.decoded(raw, islands.stretches(raw, _MARKED, _REACH))


def pieces(raw: bytes) -> Iterator[str]:
    """The stretches of a text cut at `PIECE` tokens: what training draws on."""
    for _, text in passages(raw):
        ends = [m.end() for m in TOKEN.finditer(text)][PIECE - 1 :: PIECE]
        for a, z in zip([0, *ends], [*ends, len(text)]):
            if a < z:
                yield text[a:z]


def scan(raw: bytes, model: SemiCrf | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, spans the model adds) of a UTF-8 text, in code points."""
    around = passages(raw)
    if not around:
        return [], []
    base = base_spans(raw.decode("utf-8", "replace"))
    added: list[tuple[str, int, int]] = []
    if model:
        taken, done = islands.Taken(base), 0
        for offset, text in around:
            for kind, a, z in entities(model, offset, text):  # ascending
                if a >= done and not taken.meets(a, z):
                    added.append((kind, a, z))
                    done = z
    return base, added


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> SemiCrf | None:
    """Learn from passages of a hashed sample of the texts that hold a digit or an @."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = rows.where(F.col("text").isNotNull()).count()
    place = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1_000_000)) / 1_000_000
    rows = rows.where(place < min(1.0, max_docs / max(n, 1))).where(F.col("text").rlike("[0-9@]"))
    ddl = "passage string, entity boolean"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for raw in text_bytes(b.column(1)):
                out += [(text, bool(base_spans(text))) for text in pieces(raw)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[]] * 2, schema)], schema=schema)

    got = map_batches(rows, run, ddl).dropDuplicates(["passage"])
    rank = F.xxhash64("passage")
    found = [r.passage for e in (True, False) for r in got.where(F.col("entity") == e).orderBy(rank, "passage").limit(PASSAGES).collect()]
    return fit(sorted(found, key=lambda t: hashlib.md5(t.encode()).digest()))


DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, model: SemiCrf | None) -> DataFrame:
    """A row of DDL for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema(DDL)

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
    return map_batches(slim, run, DDL)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its upper-case kind in brackets; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, z)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SemiCrf | None) -> DataFrame:
    """docs with the personal data in `text` replaced; the other columns stay (n_chars, if there, is counted anew)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = []
            for raw in b.column(at).cast(pa.binary()).to_pylist():
                base, added = scan(raw, m) if raw else ([], [])
                text = None if raw is None else raw.decode("utf-8", "replace")
                texts.append(redacted(text, base + added) if base or added else text)
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            n = b.schema.get_field_index("n_chars")
            if n >= 0:
                b = b.set_column(n, b.schema.field(n), pa.array([None if t is None else len(t) for t in texts], b.schema.field(n).type))
            yield b

    return map_batches(docs, run, kept)
