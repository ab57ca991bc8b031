"""Phrases by position bitmaps, mined depth first.

Texts are cut into pieces and words, and packed into shards of one language. In a
shard every frequent word has a bitmap of its positions; pieces are one position
apart, so nothing reaches across their borders. A phrase is extended by shifting
its bitmap one position, ANDing it with the bitmap of a following word and
counting the bits that stay. Bitmaps are compressed: a sorted array of positions
where few bits are set, packed 64-bit words where many are. Bitmaps of words are
disjoint, so for array bitmaps one look-up of the shifted positions in the
shard's owner array is the AND with all words at once; packed ones are ANDed as
they are.

1. `shards`: one pass over the texts; words get numbers inside their shard.
2. Word counts are summed over shards; words of `least` occurrences get ids.
3. `pairs_of`: every shard counts the bits of its pairs of such words; the counts
   are summed over shards, and each shard is told which of its pairs are frequent.
4. `longer_of`: every shard extends its frequent pairs depth first, the subtrees of a
   block of pairs down to the last word before the next block, as long as each
   next pair is frequent too; bit counts are summed over shards.

A phrase is at most as frequent as its words and pairs, so nothing is lost. Counts
travel in rows of many (`_in_buckets`), by a hash of the phrase; a phrase sends
one count a shard. What a task holds is bounded by a shard (`SHARD_WORDS`, and a single
text beyond it) or a bucket. Nothing that grows with the corpus is broadcast or
collected. Counts are exact; products are decimals.

Defined cases: null text = empty; null lang = `und`; a text is never cut short;
repeated rows count each; words that are not valid UTF-8 are replaced in `phrase`
alone; ties go by the phrase's bytes; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.base import checkpoint, map_batches, shared_folder, text_bytes

LEAST, LONGEST, TOP = 30, 4, 2000
#: Words of a shard; it ends after the text that reaches them.
SHARD_WORDS = 4_000_000
#: A bitmap with a bit in so many positions or fewer is packed.
PACKED = 64
#: Words of the corpus for each bucket of counts, and positions whose subtrees are mined together.
BUCKET_WORDS, BLOCK = 200_000, 1 << 18

_BORDER = b"\xff\xfe\xff"  # no word: it is not valid UTF-8
_CUT = bytes.maketrans(b".,;:!?\x0a\x0b\x0c\x0d\x09", b"\n" * 10 + b" ")

SHARD = "shard long, lang string, words array<binary>, counts array<long>, codes binary"
_SHARD = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64())), ("codes", pa.binary())])
COUNTS = "bucket long, shard long, packed binary"
_COUNTS = pa.schema([("bucket", pa.int64()), ("shard", pa.int64()), ("packed", pa.binary())])


def words_of(raw: bytes) -> list[bytes]:
    """Words in lower case, with a border between pieces."""
    return raw.lower().translate(_CUT).replace(b"\n", b" " + _BORDER + b" ").split()


class _Shard:
    """Numbers of the words met so far, and the texts in these numbers."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {_BORDER: 0}
        self.texts: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        numbers = self.numbers
        self.texts.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        self.texts.append(np.zeros(1, np.int32))
        self.size += len(words)

    def row(self, number: int, lang: str) -> pa.RecordBatch:
        codes = np.concatenate(self.texts)
        counts = np.bincount(codes, minlength=len(self.numbers))
        counts[0] = 0
        columns = [[number], [lang], [list(self.numbers)], [counts], [squeezed(codes[None])]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SHARD.types)], schema=_SHARD)


def shards(docs: DataFrame, size: int = SHARD_WORDS) -> DataFrame:
    """documents -> a row for each shard: number, lang, its words and how often they occur, and its texts as numbers of words (0 between pieces)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, total = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for lang, raw in zip(batch.column("lang").to_pylist(), text_bytes(batch.column("text"))):
                if not (words := words_of(raw)):
                    continue
                held.setdefault(lang, _Shard()).add(words)
                total += len(words)
                if total >= size:
                    for name, shard in held.items():
                        yield shard.row(number, name)
                        number += 1
                    held, total = {}, 0
        for name, shard in held.items():
            yield shard.row(number, name)
            number += 1

    return map_batches(docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), run, SHARD)


# bitmaps


def packed(positions: np.ndarray, length: int) -> np.ndarray:
    """Positions as 64-bit words, the first position in the lowest bit."""
    flags = np.zeros((length + 64) // 64 * 64, bool)
    flags[positions] = True
    return np.packbits(flags, bitorder="little").view(np.uint64)


def shifted(bits: np.ndarray) -> np.ndarray:
    """All positions of a packed bitmap one further; carries go from word to word, the last one is lost."""
    out = bits << np.uint64(1)
    out[1:] |= bits[:-1] >> np.uint64(63)
    return out


def squeezed(numbers: np.ndarray) -> bytes:
    """Rows of integers of equal length, byte by byte of their places, compressed."""
    width = numbers.dtype.itemsize
    planes = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), -1, width).transpose(0, 2, 1)
    raw = np.ascontiguousarray(planes).tobytes()
    head = np.array([len(numbers), width, len(raw)], np.int64).tobytes()
    return head + pa.compress(raw, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    rows, width, size = np.frombuffer(data, np.int64, 3)
    if not size:
        return np.zeros((rows, 0), f"i{width}")
    planes = np.frombuffer(pa.decompress(data[24:], int(size), "zstd", asbytes=True), np.uint8).reshape(rows, width, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f"i{width}").reshape(rows, -1)


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that puts equal keys together (positions stay ascending), and where each key begins in it."""
    order = np.argsort(keys, kind="stable")
    placed = keys[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(len(placed), 1), bool), placed[1:] != placed[:-1])))


def pairs_of(owner: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """owner: the word at each position, -1 for none -> all pairs that occur as word * n_words + next word, and their bit counts."""
    if len(owner) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.bincount(owner[owner >= 0], minlength=n_words)
    dense = np.flatnonzero(counts * PACKED >= len(owner))
    is_dense = np.zeros(n_words + 1, bool)  # the last one is for -1
    is_dense[dense] = True
    maps = {int(w): packed(np.flatnonzero(owner == w), len(owner)) for w in dense}
    found = []
    for w, bits in maps.items():
        moved = shifted(bits)
        found += [(w * n_words + x, int(np.bitwise_count(moved & other).sum())) for x, other in maps.items()]
    first, second = owner[:-1], owner[1:]
    at = np.flatnonzero((first >= 0) & (second >= 0) & ~(is_dense[first] & is_dense[second]))
    keys, n = np.unique(first[at].astype(np.int64) * n_words + second[at], return_counts=True)
    more = np.array([f for f in found if f[1]], np.int64).reshape(-1, 2)
    return np.concatenate((keys, more[:, 0])), np.concatenate((n, more[:, 1]))


def longer_of(owner: np.ndarray, n_words: int, frequent: np.ndarray, longest: int = LONGEST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Frequent pairs of a shard (word * n_words + next word) -> words of the longer phrases made of them (rows of `longest`, -1 for none) and their bit counts.

    Depth first by blocks of pairs: their bitmaps are shifted and ANDed with the bitmap of the places where a frequent pair
    starts, then parted by the word that has the next place, down to the longest phrases.
    """
    if len(owner) < 3 or not len(frequent):
        return
    frequent = np.sort(frequent)
    keys = np.where((owner[:-1] >= 0) & (owner[1:] >= 0), owner[:-1].astype(np.int64) * n_words + owner[1:], -1)
    place = np.minimum(np.searchsorted(frequent, keys), len(frequent) - 1)
    starts = np.concatenate((frequent[place] == keys, np.zeros(longest, bool)))
    bits = np.flatnonzero(starts)
    order, begins = _grouped(keys[bits])
    bits = bits[order]
    ends = np.append(begins[1:], len(bits))
    block = 0
    while block < len(begins):
        last = max(block + 1, int(np.searchsorted(ends, begins[block] + BLOCK, "right")))
        own = bits[begins[block] : ends[last - 1]]
        labels = np.repeat(np.arange(last - block), ends[block:last] - begins[block:last])
        for m in range(2, longest):
            stays = starts[own + m - 1]
            own, labels = own[stays], labels[stays]
            if not len(own):
                break
            order, heads = _grouped(labels * n_words + owner[own + m])
            own = own[order]
            sizes = np.diff(np.append(heads, len(own)))
            labels = np.repeat(np.arange(len(heads)), sizes)
            words = np.full((len(heads), longest), -1, np.int64)
            for k in range(m + 1):
                words[:, k] = owner[own[heads] + k]
            yield words, sizes
        block = last


def _in_buckets(shard: int, words: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Phrases (rows of ids) and counts as a row for each bucket of a hash of the phrase."""
    mixed = np.zeros(len(words), np.uint64)
    for column in words.T:
        mixed = (mixed ^ column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    keys = (mixed % np.uint64(buckets)).astype(np.int64)
    order, begins = _grouped(keys)
    table = np.concatenate((words.T, counts[None].astype(np.int64)))[:, order]
    rows = [squeezed(table[:, a:z]) for a, z in zip(begins, [*begins[1:], len(order)])]
    return pa.RecordBatch.from_arrays([pa.array(keys[order[begins]]), pa.array(np.full(len(begins), shard)), pa.array(rows, pa.binary())], schema=_COUNTS)


def _summed(counts: DataFrame, least: int) -> DataFrame:
    """Rows of counts -> for each bucket what reaches `least` with its total (shard -1), and for each shard which of its phrases these are."""

    def settle(bucket: int, shards: list[int], tables: list[np.ndarray]) -> pa.RecordBatch:
        table = np.concatenate(tables, 1)
        order = np.lexsort(table[:-1])
        placed = table[:, order]
        new = np.concatenate(([True], (placed[:-1, 1:] != placed[:-1, :-1]).any(0)))
        begins = np.flatnonzero(new)
        totals = np.add.reduceat(placed[-1], begins)
        keeps = totals >= least
        kept = np.zeros(table.shape[1], bool)
        kept[order] = keeps[np.cumsum(new) - 1]
        rows = [(-1, squeezed(np.concatenate((placed[:-1, begins[keeps]], totals[None, keeps]))))] if keeps.any() else []
        at = 0
        for shard, own in zip(shards, tables):
            mine = kept[at : at + own.shape[1]]
            at += own.shape[1]
            if mine.any():
                rows.append((shard, squeezed(own[:-1, mine])))
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], schema=_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, shards, tables = None, [], []
        for batch in batches:
            for b, shard, data in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket and tables:
                    yield settle(bucket, shards, tables)
                    shards, tables = [], []
                bucket = b
                shards.append(shard)
                tables.append(unsqueezed(data))
        if tables:
            yield settle(bucket, shards, tables)

    return map_batches(counts.repartition("bucket").sortWithinPartitions("bucket"), run, COUNTS)


def _totals(settled: DataFrame) -> DataFrame:
    """ids, n of what _summed() found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("packed").to_pylist():
                *words, n = unsqueezed(data)
                words = np.stack(words, 1)
                offsets = np.concatenate(([0], np.cumsum((words >= 0).sum(1)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[words >= 0])), pa.array(n)], names=["ids", "n"])

    return map_batches(settled.where("shard = -1").select("packed"), run, "ids array<long>, n long")


def _owners(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row, shard, the frequent word that has each position (-1: none), ids of these words (ascending)."""
    for k in range(batch.num_rows):
        codes = unsqueezed(batch.column("codes")[k].as_py())[0]
        numbers, ids = (np.asarray(c) for c in batch.column("kept")[k].values.flatten())
        order = np.argsort(ids)
        place = np.full(int(codes.max()) + 1, -1, np.int32)
        place[numbers[order]] = np.arange(len(ids), dtype=np.int32)
        yield k, batch.column("shard")[k].as_py(), place[codes], ids[order]


def _pairs(rows: DataFrame, buckets: int) -> DataFrame:
    """Shards with `kept` (number, id of the frequent words) -> counts of all pairs of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, shard, owner, ids in _owners(batch):
                keys, n = pairs_of(owner, len(ids))
                if len(keys):
                    yield _in_buckets(shard, np.stack((ids[keys // len(ids)], ids[keys % len(ids)]), 1), n, buckets)

    return map_batches(rows.select("shard", "codes", "kept"), run, COUNTS)


def _longer(rows: DataFrame, longest: int, buckets: int) -> DataFrame:
    """Shards with `kept` and `pairs` (packed ids of their frequent pairs) -> counts of longer phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, shard, owner, ids in _owners(batch):
                pairs = np.concatenate([unsqueezed(p) for p in batch.column("pairs")[k].as_py()], 1)
                first, second = np.searchsorted(ids, pairs)
                named = np.append(ids, -1)  # -1 stays -1
                found = list(longer_of(owner, len(ids), first * len(ids) + second, longest))
                if found:
                    yield _in_buckets(shard, named[np.concatenate([w for w, _ in found])], np.concatenate([n for _, n in found]), buckets)

    return map_batches(rows.select("shard", "codes", "kept", "pairs"), run, COUNTS)


def counted(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, size: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: id, lang, word; phrases: ids, n, of one word and more, n >= least; totals: lang, n, all word occurrences).

    A word's id is a row number of one of the shards that have it, so it is of one language.
    """
    spark = docs.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/phrases-{uuid.uuid4().hex}"
    shards(docs, size).write.option("compression", "zstd").parquet(path)
    stored = spark.read.parquet(path)
    totals = stored.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    local = stored.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("number", "w")).select("shard", "lang", "number", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    of_word = Window.partitionBy("lang", "word")
    local = local.where("n > 0").withColumn("row", F.monotonically_increasing_id())
    local = local.select("shard", "number", "lang", "word", F.sum("n").over(of_word).alias("n"), F.min("row").over(of_word).alias("id"))
    local = checkpoint(local.where(F.col("n") >= least))
    words = local.groupBy("id").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.first("n").alias("n"))

    words_in_all = totals.agg(F.sum("n")).first()[0] or 0
    buckets = words_in_all // BUCKET_WORDS + 64
    known = local.groupBy("shard").agg(F.collect_list(F.struct("number", "id")).alias("kept"))
    shards_known = stored.select("shard", "codes").join(known, "shard")
    pairs = checkpoint(_summed(_pairs(shards_known, buckets), least))
    of_shard = pairs.where("shard >= 0").groupBy("shard").agg(F.collect_list("packed").alias("pairs"))
    longer = _summed(_longer(shards_known.join(of_shard, "shard"), longest, buckets), least)
    ones = words.select(F.array("id").alias("ids"), "n")
    return words, checkpoint(ones.unionByName(_totals(pairs)).unionByName(_totals(longer))), totals


def ranked(words: DataFrame, phrases: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """Candidates by their weakest cut, without those that a longer one explains -> lang, rank, phrase, a, l, r, n, score."""
    size = F.size("ids")
    candidates = phrases.where(size > 1).withColumnRenamed("n", "a")
    cuts = candidates.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, size).alias("right"))
    side = lambda name, n: phrases.select(F.col("ids").alias(name), F.col("n").alias(n))
    cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
    score = F.expr("cast((cast(a as decimal(20,0)) * 2000000) div (cast(l as decimal(20,0)) + r) as bigint)")
    weakest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("ids", "a").agg(weakest).select("ids", "a", "cut.score", "cut.l", "cut.r")
    parts = candidates.where(size > 2).select("a", size.alias("size"), "ids", F.explode(F.sequence(F.lit(2), size - 1)).alias("m"))
    parts = parts.select("a", "ids", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    inside = parts.groupBy(F.slice("ids", F.col("at"), F.col("m")).alias("ids")).agg(F.max("a").alias("longer"))
    left = scored.join(inside, "ids", "left").where("longer is null or cast(longer as decimal(20,0)) * 100 < cast(a as decimal(20,0)) * 80")
    spelt = left.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    named = spelt.groupBy("ids", "a", "l", "r", "score", "lang").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("spelt"))
    phrase = F.array_join(F.transform("spelt", lambda w: F.decode(w["word"], "UTF-8")), " ")
    named = named.select("lang", phrase.alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, size: int = SHARD_WORDS) -> DataFrame:
    """documents -> the best phrases of every language."""
    return ranked(*counted(docs, least, longest, size), top)


ORACLE_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents
), w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
totals as (select lang, cast(sum(len(w)) as bigint) as n from w group by lang),
starts as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
grams as (select lang, w, i, unnest(range(1, 5)) as m from starts),
f as (select lang, list_slice(w, i, i + m - 1) as p, count(*) as n from grams where i + m - 1 <= len(w) group by all),
candidates as (select lang, p, n as a from f where len(p) > 1 and n >= 30),
cuts as (select lang, p, a, unnest(range(1, len(p))) as k from candidates),
scored as (
  select c.lang, c.p, c.a, k, l.n as l, r.n as r, cast((2000000::hugeint * c.a) // (l.n + r.n) as bigint) as score
  from cuts c join f l on l.lang = c.lang and l.p = list_slice(c.p, 1, k) join f r on r.lang = c.lang and r.p = list_slice(c.p, k + 1, len(c.p))
),
weakest as (select lang, p, a, unnest(min(struct_pack(score := score, k := k, l := l, r := r))) from scored group by lang, p, a),
sizes as (select lang, p, a, unnest(range(2, len(p))) as m from candidates),
inside as (select lang, p, a, m, unnest(range(1, len(p) - m + 2)) as i from sizes),
longer as (select lang, list_slice(p, i, i + m - 1) as p, max(a) as longer from inside group by all),
named as (
  select w.lang, array_to_string(w.p, ' ') as phrase, a, l, r, score from weakest w left join longer x on x.lang = w.lang and x.p = w.p
  where longer is null or 100 * longer < 80 * a
),
placed as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from named)
select lang, rank, phrase, a, l, r, n, score from placed join totals using (lang) where rank <= 2000
"""
