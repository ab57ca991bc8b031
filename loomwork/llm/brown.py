"""LM scoring with Brown's class-based bigrams.

1. Every word of the training rows is counted (map-side sums per task, then a
   shuffle by word): N tokens, V types, over all training text.
2. Bigrams of the `CLUSTERED` commonest words (all others are one context) are
   counted over all training text; exchange clustering on that core moves each
   word to the class that raises the bigram likelihood most.
3. Every other training word is placed too: its followers and predecessors, by
   class, are summed over all training text (a row a word, a shuffle by word;
   of words of over `FREQUENT` occurrences among the `HEAD` commonest first by
   `LANES` parts, so no task gathers what all tasks send of one word), and it
   joins the class that they raise the bigram likelihood of most.
4. The classes of the commonest words, at most `HEAD`, are broadcast; rarer
   words get theirs in a shuffle join by word. Both parts always run, so no size
   changes the results. Class transitions are counted on the class sequences of
   all training rows.
5. A text's probability is the product over its tokens of transition(class |
   class before), smoothed by the class shares, and the add-one emission(word |
   class). Each class reserves one emission for unseen words, which are a class
   of their own that gathers them.

Defined cases: null text = empty = the end token alone; no training rows: every
count is 0, base_score 0 and score 0; repeated rows each count and each give a
row; a null doc_id hashes as empty text; an empty table gives no rows; of equally
common words the first in byte order is ranked first, of equally good classes the
first is taken; further columns of any name do no harm. The exchange ends after
`ROUNDS` rounds at most, though words might still gain by moving.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.base import arrow_schema, checkpoint, id_hash, map_batches, text_bytes

#: Words that are broadcast at most, words that are clustered, classes.
HEAD = 100_000
CLUSTERED = 2000
CLASSES = 40
ROUNDS = 6
#: Weight of the class shares in the transitions.
SHARE = 5.0
#: Distinct words a task holds before it passes its sums on.
HELD = 500_000
#: Neighbours a task holds before it passes them on.
HELD_PAIRS = 1_000_000
#: Rows of a batch that a task hands over at once, about.
PASSED = 20_000
#: Texts of a batch that a task takes up at once: Spark hands over up to 10,000.
TAKEN = 250
#: Occurrences above which a word's neighbours are summed in `LANES` parts before they meet.
FREQUENT = 100_000
LANES = 256
END = b""


def words(raw: bytes) -> list[bytes]:
    return raw.lower().split()


def in_pieces(batch: pa.RecordBatch, rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of so many (`PASSED`) rows: the JVM holds a whole one outside its heap."""
    rows = rows or PASSED
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def texts(column: pa.Array) -> Iterator[bytes]:
    """text_bytes() of a long column, `TAKEN` at a time: a second copy of a whole batch is never held."""
    for at in range(0, len(column), TAKEN):
        yield from text_bytes(column.slice(at, TAKEN))


def count_words(training: DataFrame) -> DataFrame:
    """training (text) -> (word binary, n): all tokens, the end as an empty word."""
    ddl = "word binary, n long"
    schema = arrow_schema(ddl)

    def batch(c: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for raw in texts(b.column(0)):
                c.update(words(raw))
                if len(c) > HELD:
                    yield from in_pieces(batch(c))
                    c = Counter()
            c[END] += b.num_rows
        yield from in_pieces(batch(c))

    sums = map_batches(training.select(F.col("text").cast("string").alias("text")), run, ddl)
    return sums.where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def head(counts: DataFrame, most: int = HEAD) -> list[tuple[bytes, int]]:
    """All words from a count upwards, as far as they are at most `most`; commonest first."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r.s, r.k) for r in counts.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for s, k in sizes:
        if total + k > most:
            break
        total, least = total + k, s
    if least is None:
        return []
    got = counts.where(step >= least).select("word", "n").toArrow()
    return sorted(zip(got["word"].to_pylist(), got["n"].to_pylist()), key=lambda x: (-x[1], x[0]))


def count_pairs(training: DataFrame, order: list[bytes]) -> np.ndarray:
    """Bigram counts of the words in `order`, of all others (their number is len(order)); a text starts after an end."""
    n = len(order) + 1
    shared = training.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(order)})
    end = order.index(END)
    ddl = "pair long, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(n * n, np.int64)
        get = shared.value.get
        for b in batches:
            for raw in texts(b.column(0)):
                w = words(raw)
                ids = np.fromiter((get(x, n - 1) for x in w), np.int64, len(w))
                np.add.at(table, np.concatenate(([end], ids)) * n + np.concatenate((ids, [end])), 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(table[at], pa.int64())], schema=schema)

    got = map_batches(training.select(F.col("text").cast("string").alias("text")), run, ddl)
    rows = got.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most (CLUSTERED + 1)^2 rows
    table = np.zeros(n * n)
    table[rows["pair"].to_numpy()] = rows["n"].to_numpy()
    return table.reshape(n, n)


def cluster(pairs: np.ndarray, fixed: dict[int, int], classes: int, rounds: int = ROUNDS) -> np.ndarray:
    """The class of each word by exchange; `fixed` words have classes of their own that take no others."""
    n = len(pairs)
    own = np.arange(n) % classes
    for w, c in fixed.items():
        own[w] = c
    size = max([classes, *(c + 1 for c in fixed.values())])
    member = np.eye(size)[own]
    right, left = pairs @ member, pairs.T @ member  # word x class of its followers, of its predecessors
    table = member.T @ right

    def h(x: np.ndarray) -> np.ndarray:
        return x * np.log(np.maximum(x, 1e-300))

    free = [w for w in np.argsort(-pairs.sum(axis=1), kind="stable") if w not in fixed]
    for _ in range(rounds):
        moved = 0
        for w in free:
            a, r, l, s = own[w], right[w].copy(), left[w].copy(), pairs[w, w]
            # contacts with the other words only
            r[a] -= s
            l[a] -= s
            t = table.copy()
            t[a] -= r
            t[:, a] -= l
            t[a, a] -= s
            out, into = t.sum(axis=1), t.sum(axis=0)
            gain = (h(t + r) - h(t))[:classes].sum(axis=1) + (h(t + l[:, None]) - h(t))[:, :classes].sum(axis=0)
            d = np.arange(classes)
            both = t[d, d]
            gain -= h(both + r[d]) + h(both + l[d]) - 2 * h(both)
            gain += h(both + r[d] + l[d] + s) - h(both)
            gain -= h(out[:classes] + r.sum() + s) - h(out[:classes]) + h(into[:classes] + l.sum() + s) - h(into[:classes])
            b = int(np.argmax(gain))
            if b != a and gain[b] <= gain[a] + 1e-9:
                b = a
            t[b] += r
            t[:, b] += l
            t[b, b] += s
            table = t
            if b != a:
                moved += 1
                own[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
        if not moved:
            break
    return own


class Numbers(dict):
    """New keys are numbered in the order of their first use."""

    def __missing__(self, x: bytes) -> int:
        self[x] = k = len(self)
        return k


_NEAR = np.dtype([("key", "<u2"), ("n", "<u4")])
_MOST = 2**32 - 1


def place(training: DataFrame, order: list[bytes], own: np.ndarray, table: np.ndarray, frequent: list[bytes] = ()) -> DataFrame:
    """(word, n, class) of all words that are not in `order`, by the classes of their neighbours (the rest is one more).

    The neighbours of `frequent` words are summed in parts first. Checkpointed.
    """
    size = int(own.max()) + 1
    end, rest = order.index(END), len(order)
    classes = size - 2
    member = np.eye(size)[own]
    between = member.T @ table @ member + 0.5
    gain = np.log(between) - np.log(between.sum(axis=1, keepdims=True)) - np.log(between.sum(axis=0))
    weights = np.concatenate((gain[:classes].T, gain[:, :classes]))  # follower's class, then predecessor's, by own class
    shared = training.sparkSession.sparkContext.broadcast((order, own, weights, frozenset(frequent)))
    ddl = "word binary, near binary, lane int"
    schema = arrow_schema(ddl)

    def sums(names: list[bytes], codes: list[np.ndarray], part: int) -> Iterator[pa.RecordBatch]:
        code, n = np.unique(np.concatenate(codes) if codes else np.zeros(0, np.int64), return_counts=True)
        word = code // (2 * size)
        near = np.empty(len(code), _NEAR)
        near["key"], near["n"] = code % (2 * size), n
        first = np.append(np.flatnonzero(np.diff(word, prepend=-1)), len(code))
        in_parts = shared.value[3]
        for k in range(0, len(first) - 1, PASSED):
            at = first[k : k + PASSED + 1]
            found = [names[w] for w in word[at[:-1]].tolist()]
            ends, data = ((at - at[0]) * _NEAR.itemsize).astype(np.int32), near[at[0] : at[-1]].tobytes()
            lists = pa.Array.from_buffers(pa.binary(), len(found), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            lanes = [part if w in in_parts else -1 for w in found]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), lists, pa.array(lanes, pa.int32())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, own = shared.value[:2]
        part = TaskContext.get().partitionId() % LANES
        core = {w: i for i, w in enumerate(order)}
        ids, codes, held = Numbers(core), [], 0
        for b in batches:
            for raw in texts(b.column(0)):
                w = words(raw)
                seq = np.empty(len(w) + 2, np.int64)
                seq[0] = seq[-1] = end
                seq[1:-1] = np.fromiter(map(ids.__getitem__, w), np.int64, len(w))
                at = np.flatnonzero(seq >= rest)
                if len(at):
                    kind = own[np.minimum(seq, rest)]
                    code = (seq[at] - rest) * (2 * size)
                    codes += [code + kind[at + 1], code + size + kind[at - 1]]
                    held += 2 * len(at)
                if held > HELD_PAIRS:
                    yield from sums(list(ids)[rest:], codes, part)
                    ids, codes, held = Numbers(core), [], 0
        yield from sums(list(ids)[rest:], codes, part)

    out_ddl = "word binary, n long, class int, near binary"
    out_schema = arrow_schema(out_ddl)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(word, lane, lists): the class of what is whole (lane -1), the sums of what is a part."""
        weights = shared.value[2]
        for b in batches:
            lists = [b"".join(x) for x in b.column(2).to_pylist()]
            row = np.repeat(np.arange(len(lists)), [len(x) // _NEAR.itemsize for x in lists])
            near = np.frombuffer(b"".join(lists), _NEAR)
            x = np.bincount(row * 2 * size + near["key"], near["n"], len(lists) * 2 * size).reshape(-1, 2 * size)
            n = x[:, :size].sum(axis=1).astype(np.int64)  # each token has one follower
            best = (x @ weights).argmax(axis=1).astype(np.int32)
            whole = b.column(1).to_numpy() < 0
            sums = [None if w else packed(r) for w, r in zip(whole, x)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(best, mask=~whole), pa.array(sums, pa.binary())], schema=out_schema)

    near = map_batches(training.select(F.col("text").cast("string").alias("text")), run, ddl)
    got = checkpoint(map_batches(near.groupBy("word", "lane").agg(F.collect_list("near").alias("near")), choose, out_ddl))
    parts = got.where("class is null").groupBy("word").agg(F.collect_list("near").alias("near")).select("word", F.lit(-1).alias("lane"), "near")
    return got.where("class is not null").unionByName(map_batches(parts, choose, out_ddl)).select("word", "n", "class")


def packed(sums: np.ndarray) -> bytes:
    """One word's sums by neighbour; a sum beyond 32 bits is several entries."""
    keys = np.flatnonzero(sums)
    full, left = np.divmod(sums[keys].astype(np.int64), _MOST)
    keys, n = np.concatenate((np.repeat(keys, full), keys)), np.concatenate((np.full(full.sum(), _MOST), left))
    near = np.empty(len(keys), _NEAR)
    near["key"], near["n"] = keys, n
    return near.tobytes()


@dataclass
class Model:
    """What is broadcast; log10 throughout. Ids are places in `vocab`; words outside it have the last id."""

    vocab: dict[bytes, int]
    add_one: np.ndarray  # log10(count + 1) by id; 0 outside
    emission: np.ndarray  # by id; outside the add-one share of all text, until the word's class is known
    transition: np.ndarray  # flat, class before x class; the last class is that of unseen words
    classes: int
    class_of: np.ndarray
    tokens: int
    types: int
    room: np.ndarray  # log10(tokens + types) by class; 0 for unseen words


def classify(training: DataFrame, most: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model without its transitions, and the table (word, n, class) of all training words."""
    counts = checkpoint(count_words(training))
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, types = int(row.n), int(row.v)
    if not total:
        none = counts.withColumn("class", F.lit(0))
        return Model({}, np.zeros(1), np.zeros(1), np.zeros(1), 1, np.zeros(1, np.int64), 0, 0, np.zeros(1)), none
    common = head(counts, most)
    if END not in dict(common):  # possible only for tiny or odd tables
        common.append((END, counts.where(F.length("word") == 0).first().n))
    order = [w for w, _ in common[:clustered]]
    if END not in order:
        order[-1] = END
    table = count_pairs(training, order)
    own = cluster(table, {order.index(END): classes, len(order): classes + 1}, classes)
    size = classes + 2  # the class of the rest is that of unseen words from here on
    core = training.sparkSession.createDataFrame([(bytearray(w), int(n), int(own[i])) for i, (w, n) in enumerate(zip(order, map(dict(common).get, order)))], "word binary, n long, class int")
    placed = checkpoint(core.unionByName(place(training, order, own, table, [w for w, n in common[clustered:] if n > FREQUENT])))
    sums = {r["class"]: r for r in placed.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    room = np.array([np.log10(sums[c].n + sums[c].v) if c in sums else 0.0 for c in range(size)])
    vocab = {w: i for i, (w, _) in enumerate(common)}
    least = min(n for _, n in common)
    got = placed.where(F.col("n") >= least).where(F.col("word").isNotNull()).select("word", "class")
    if len(common) < types:
        got = got.join(F.broadcast(training.sparkSession.createDataFrame([(bytearray(w),) for w in vocab], "word binary")), "word")
    class_of = np.full(len(common) + 1, size - 1)
    rows = got.toArrow()
    for w, c in zip(rows["word"].to_pylist(), rows["class"].to_pylist()):
        class_of[vocab[w]] = c
    n = np.array([c for _, c in common] + [0], np.float64)
    emission = np.log10(n + 1) - room[class_of]
    emission[-1] = -np.log10(total + types)
    return Model(vocab, np.log10(n + 1), emission, np.zeros(1), size, class_of, total, types, room), placed


def with_transitions(model: Model, rows: DataFrame) -> Model:
    """The model with the class transitions of the sequences of all training rows."""
    size = model.classes
    if not model.tokens:
        return model
    start = int(model.class_of[model.vocab[END]])
    ddl = "pair long, n long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(size * size, np.int64)
        for b in batches:
            seq = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).astype(np.int64)
            table += np.bincount(np.concatenate(([start], seq[:-1])) * size + seq, minlength=size * size)  # each ends in the end
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(table)], schema=schema)

    got = map_batches(rows.select("seq"), run, ddl).groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    between = np.zeros(size * size)
    between[got["pair"].to_numpy()] = got["n"].to_numpy()
    between = between.reshape(size, size)[:, :-1]
    n_class = between.sum(axis=0)  # as followers: every token once
    share = (n_class + 1) / (n_class.sum() + size - 1)
    known = (between + SHARE * share) / (between.sum(axis=1, keepdims=True) + SHARE)
    reserved = 1 / (10 ** model.room[:-1] + 1)
    transition = np.concatenate((known * (1 - reserved), (known * reserved).sum(axis=1, keepdims=True)), axis=1)
    return replace(model, transition=np.log10(transition).ravel())


def learn(training: DataFrame, most: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES) -> tuple[Model, DataFrame]:
    """The model and the table (word, n, class) of all training words."""
    model, counts = classify(training, most, clustered, classes)
    rows = training.select(F.lit(None).cast("long").alias("doc_id"), F.lit(False).alias("held_out"), "text")
    return with_transitions(model, sequences(rows, model, counts)), counts


def sequences(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """docs (doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, base, own (emissions), seq (a class a byte)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    ddl = "row long, doc_id long, held_out boolean, word binary, at binary, seq binary, n_tokens long, known long, base double, own double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        get, rest, end = m.vocab.get, len(m.vocab), m.vocab.get(END, len(m.vocab))
        per_token = np.log10(m.tokens + m.types + 1)

        def batch(out: tuple[list, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        for b in batches:
            out: tuple[list, ...] = tuple([] for _ in schema)
            for row, doc, held, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), texts(b.column(3))):
                w = words(raw)
                ids = np.fromiter((get(x, rest) for x in w), np.int64, len(w))
                rare = np.flatnonzero(ids == rest).tolist() if m.vocab else []
                tail: dict[bytes, list[int]] = {}
                for i in rare:
                    tail.setdefault(w[i], []).append(i)
                ids = np.append(ids, end)
                n = len(ids)
                own = float(m.emission[ids].sum())
                base = float(m.add_one[ids].sum() - n * per_token)
                # this row's own part has a key that no word is equal to
                for column, values in zip(out, ([row], [doc], [held], [b" %d" % row], [None], [m.class_of[ids].astype(np.uint8).tobytes()], [n], [n - len(rare) if m.vocab else 0], [base], [own])):
                    column.extend(values)
                k = len(tail)
                for column, values in zip(out, ([row] * k, [None] * k, [None] * k, tail.keys(), [np.array(i, "<i4").tobytes() for i in tail.values()], [None] * k, [0] * k, [0] * k, [0.0] * k, [0.0] * k)):
                    column.extend(values)
                if len(out[0]) > PASSED:
                    yield batch(out)
                    out = tuple([] for _ in schema)
            yield batch(out)

    done_ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, own double, seq binary"
    done_schema = arrow_schema(done_ddl)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        everything = np.log10(max(m.tokens + m.types, 1))
        correction = everything - m.room
        for b in (piece for whole in batches for piece in in_pieces(whole, TAKEN)):
            seqs, tails = b.column(2).to_pylist(), b.column(7)
            size = np.array([len(x) for x in seqs], np.int64)
            seq = np.frombuffer(b"".join(seqs), np.uint8).copy()
            start = np.cumsum(size) - size
            at, c, kind = tails.flatten().flatten()
            row = np.repeat(np.arange(len(seqs)), tails.value_lengths().to_numpy(zero_copy_only=False))
            k = at.cast(pa.binary()).to_pylist()
            times = np.array([len(x) // 4 for x in k], np.int64)
            c = c.fill_null(0).to_numpy(zero_copy_only=False)
            kind = kind.fill_null(m.classes - 1).to_numpy(zero_copy_only=False)  # what unseen words cost is in the transitions
            seq[np.repeat(start[row], times) + np.frombuffer(b"".join(k), "<i4")] = np.repeat(kind, times)
            extra = times * np.log10(c + 1)
            known, base, own = (
                b.column(i).to_numpy(zero_copy_only=False) + np.bincount(row, x, len(seqs))
                for i, x in ((4, times * (c > 0)), (5, extra), (6, extra + times * correction[kind]))
            )
            ends = np.append(start, len(seq)).astype(np.int32)
            whole = pa.Array.from_buffers(pa.binary(), len(seqs), [None, pa.py_buffer(ends), pa.py_buffer(seq)])
            columns = [b.column(0), b.column(1), b.column(3), pa.array(known.astype(np.int64)), pa.array(base), pa.array(own), whole]
            yield pa.RecordBatch.from_arrays(columns, schema=done_schema)

    slim = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "held_out",
        F.col("text").cast("string").alias("text"),
    )
    joined = map_batches(slim, run, ddl).join(counts.select("word", F.col("n").alias("c"), "class"), "word", "left")
    tail = F.when(F.col("at").isNotNull(), F.struct("at", "c", "class"))
    rows = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("seq").alias("seq"), F.sum("n_tokens").alias("n_tokens"),
        F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("own").alias("own"), F.collect_list(tail).alias("tail"),
    )
    return map_batches(rows.drop("row"), fill, done_ddl)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """sequences -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        start = int(m.class_of[m.vocab.get(END, len(m.vocab))])
        for b in batches:
            seqs = [np.frombuffer(x, np.uint8).astype(np.int64) for x in b.column(6).to_pylist()]
            moves = [m.transition[np.concatenate(([start], x[:-1])) * m.classes + x].sum() for x in seqs]
            own = b.column(5).to_numpy(zero_copy_only=False) + np.array(moves, np.float64)
            columns = (*(b.column(i) for i in range(4)), pa.array([m.tokens] * b.num_rows, pa.int64()), b.column(4), pa.array(own))
            yield pa.RecordBatch.from_arrays(list(columns), schema=schema)

    return map_batches(rows, run, ddl)


def training_rows(remainder: Column | None = None) -> Column:
    return (F.pmod(id_hash(), F.lit(7)) if remainder is None else remainder) != 2


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learn from the rows whose crc32(doc_id) mod 7 is not 2; score all."""
    slim = docs.select("doc_id", "text", (~training_rows()).alias("held_out"))
    model, counts = classify(slim.where(~F.col("held_out")))
    rows = checkpoint(sequences(slim, model, counts))
    return score(rows, with_transitions(model, rows.where(~F.col("held_out"))))
