"""The prefix trie of rebuilt conversations.

A conversation's turns are put in order over all tasks by ranges, so that one of any
length is spread; each task scans its range in numpy and rolls a polynomial
fingerprint over the turns (two residues of 31 bits). What a range needs of those
before it - the end of the conversation it begins in - is a few numbers a range.

All prefixes of one depth and fingerprint are a group. Each group's turns are
compared as they are: the content (fingerprint of the prefix before, role, text) of
its least conversation represents it, and where another content is met, the
two are split: the other's turn gets a hash of its own, and the fingerprints are
rolled again. As this holds at every depth, equal fingerprints then mean equal
prefixes, turn by turn.

Sums over subtrees double their reach every round: after k rounds a node holds
what lies less than 2^k below it, and adds what its descendants at exactly
that distance hold. So the rounds are the logarithm of the greatest depth.

Defined cases: null role or text is empty; turns of one number are in the order of role,
then text; rows without a conv_id belong to no conversation and are left
out; an empty table gives no node; further columns are ignored; a negative conv_id
has the base conv_id - conv_id % 5 with the sign of SQL's remainder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.base import checkpoint, labelled, map_batches

#: Two residues of 31 bits: moduli and bases.
MODULI, BASES = (2147483647, 2147483629), (1000003, 998244353)
#: Conversations share so many turns at most, with one of the same group of so many.
SHARED, FAMILY = 8, 5
#: Ids that are joined to one string at a time.
CHUNK = 50_000
MOST_ROUNDS = 50

_ORDERED = ["base", "conv_id", "inherits", "role", "text", "hash", "bytes"]
HIT = "depth long, print long, parent_print long, conv_id long, role string, text string, bytes long"
_HIT = pa.schema([("depth", pa.int64()), ("print", pa.int64()), ("parent_print", pa.int64()), ("conv_id", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("bytes", pa.int64())])


class Powers:
    """Powers of a base by any exponent: three tables of 2^16 entries each."""

    def __init__(self, base: int, modulus: int):
        self.modulus, self.tables = modulus, []
        for _ in range(3):
            table = np.ones(1 << 16, np.uint64)
            for k in range(16):  # the second half of each doubling is the first one, moved
                step = pow(base, 1 << k, modulus)
                table[1 << k : 2 << k] = table[: 1 << k] * np.uint64(step) % np.uint64(modulus)
            self.tables.append(table)
            base = pow(base, 1 << 16, modulus)

    def __call__(self, exponents: np.ndarray) -> np.ndarray:
        out = self.tables[0][exponents & 0xFFFF]
        for k in (1, 2):
            high = exponents >> 16 * k
            if high.any():
                out = out * self.tables[k][high & 0xFFFF] % np.uint64(self.modulus)
        return out


@dataclass
class State:
    """Where a scan stands: the last conversation, how many turns it has had, its sums, and hashes of the first turns of it and of its base."""

    base: int | None = None
    base_heads: list[int] = field(default_factory=list)
    conv: int | None = None
    own_heads: list[int] = field(default_factory=list)
    n: int = 0
    sums: tuple[int, ...] = (0, 0)
    only: bool = True  # no other conversation, and no other base, since the scan began
    one_base: bool = True

    def then(self, later: State, moduli=MODULI, bases=BASES) -> State:
        """The state after this scan and the one of the next range, which has begun from nothing."""
        if later.conv is None or self.conv is None:
            return self if later.conv is None else later
        same, one = later.only and later.conv == self.conv, later.one_base and later.base == self.base
        sums = tuple((a + pow(b, self.n, m) * c) % m for a, c, b, m in zip(self.sums, later.sums, bases, moduli)) if same else later.sums
        return State(
            later.base, (self.base_heads + later.base_heads)[:SHARED] if one else later.base_heads, later.conv,
            (self.own_heads + later.own_heads)[:SHARED] if same else later.own_heads, later.n + (self.n if same else 0), sums,
            self.only and same, self.one_base and one,
        )


class Scan:
    """Rolls fingerprints over ordered turns."""

    def __init__(self, moduli=MODULI, bases=BASES):
        self.moduli, self.bases = moduli, bases
        self.powers = [Powers(b, m) for b, m in zip(bases, moduli)]
        self.inverse = [pow(b, -1, m) for b, m in zip(bases, moduli)]

    def residues(self, hashes: np.ndarray) -> list[np.ndarray]:
        h = hashes.astype(np.int64).view(np.uint64)
        return [(h >> np.uint64(k)) % np.uint64(m) for k, m in zip((0, 17), self.moduli)]

    def heads(self, hashes: list[int]) -> list[tuple[int, ...]]:
        """The sums after each of the first turns, from none."""
        out, sums = [(0, 0)], (0, 0)
        values = self.residues(np.array(hashes, np.int64))
        for i in range(len(hashes)):
            sums = tuple((s + int(v[i]) * pow(b, i, m)) % m for s, v, b, m in zip(sums, values, self.bases, self.moduli))
            out.append(sums)
        return out

    def print_of(self, sums):
        """One number of two residues; 0 is the root."""
        return sums[0] | sums[1] << 31

    def run(self, state: State, base: int, conv: int, inherits: int, hashes: np.ndarray):
        """The next turns of one conversation -> state, (depth, print, print before) of its own turns (arrays; from which turn on), the same of inherited ones (list)."""
        begins = conv != state.conv
        if base != state.base:
            state.one_base = state.one_base and state.base is None
            state.base, state.base_heads = base, []
        if begins:
            state.only = state.only and state.conv is None
            state.conv, state.own_heads, state.n, state.sums = conv, [], 0, (0, 0)
        first = state.n
        if len(state.own_heads) < SHARED:
            state.own_heads = (state.own_heads + hashes[: SHARED - len(state.own_heads)].tolist())[:SHARED]
        if conv == base:
            state.base_heads, inherits = list(state.own_heads), 0
        places = np.arange(first, first + len(hashes))
        rolled, last = [], []
        for r, v in enumerate(self.residues(hashes)):
            m = np.uint64(self.moduli[r])
            total = (np.cumsum(v * self.powers[r](places) % m) + np.uint64(state.sums[r])) % m
            rolled.append(np.concatenate((np.array([state.sums[r]], np.uint64), total)))
            last.append(int(total[-1]))
        state.n, state.sums = first + len(hashes), tuple(last)
        taken = []
        shared = 0
        if inherits:  # replace the first own turns by those of the base
            heads = self.heads(state.base_heads[:inherits])
            shared = len(heads) - 1
            own = self.heads(state.own_heads[:inherits])[-1]
            if begins:
                taken = [(d, self.print_of(heads[d]), self.print_of(heads[d - 1])) for d in range(1, shared + 1)]
            for r, m in enumerate(self.moduli):
                back = np.uint64(pow(self.inverse[r], inherits - shared, m))
                rolled[r] = ((rolled[r] + np.uint64(m - own[r])) % np.uint64(m) * back + np.uint64(heads[-1][r])) % np.uint64(m)
        skip = max(0, min(len(hashes), inherits - first))
        prints = self.print_of([x.astype(np.int64) for x in rolled])
        return state, (places[skip:] + 1 - inherits + shared, prints[skip + 1 :], prints[skip:-1], skip), taken


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int, int]]:
    """(from, to, base, conversation, turns that it may inherit) of the conversations of a batch."""
    conv, base, inherits = (batch.column(c).to_numpy() for c in ("conv_id", "base", "inherits"))
    cuts = np.concatenate(([0], np.flatnonzero(conv[1:] != conv[:-1]) + 1, [len(conv)])).tolist() if len(conv) else [0]
    for a, z in zip(cuts, cuts[1:]):
        yield a, z, int(base[a]), int(conv[a]), int(inherits[a])


def ordered(conversations: DataFrame, salts: DataFrame | None = None) -> DataFrame:
    """Turns by family, base first, then conversation and turn, over all tasks; written down, so that the ranges stay as they are."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = F.xxhash64("role", "text")
    if salts is not None:
        rows = rows.join(salts, ["role", "text"], "left")
        own = F.when(F.col("salt").isNull(), own).otherwise(F.xxhash64("role", "text", "salt"))
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    shares = F.when(base == F.col("conv_id"), 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % (SHARED + 1))
    rows = rows.select("*", base.alias("base"), (base != F.col("conv_id")).alias("child"), own.alias("hash"), shares.cast("long").alias("inherits"), F.octet_length("text").cast("long").alias("bytes"))
    order = ["base", "child", "conv_id", F.col("turn").asc_nulls_first(), "role"]
    # the sampled bounds hold the beginning of a text only; equal turns may be parted anywhere
    ranges = rows.withColumn("lead", F.substring("text", 1, 32)).withColumn("place", F.monotonically_increasing_id())
    return checkpoint(ranges.repartitionByRange(*order, "lead", "place").sortWithinPartitions(*order, "text").select(*_ORDERED))


def _states(rows: DataFrame, moduli, bases) -> list[State]:
    """For each range the state of the scan before it: some numbers of each range pass through the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan, state = Scan(moduli, bases), State()
        for batch in batches:
            hashes = batch.column("hash").to_numpy()
            for a, z, base, conv, inherits in _runs(batch):
                state, _, _ = scan.run(state, base, conv, inherits, hashes[a:z])
        if state.conv is not None:
            s = state
            row = [TaskContext.get().partitionId(), s.base, s.base_heads, s.conv, s.own_heads, s.n, list(s.sums), s.only, s.one_base]
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds)], names=names)

    longs = pa.list_(pa.int64())
    names = ["part", "base", "base_heads", "conv", "own_heads", "n", "sums", "only", "one_base"]
    kinds = [pa.int64(), pa.int64(), longs, pa.int64(), longs, pa.int64(), longs, pa.bool_(), pa.bool_()]
    ddl = "part long, base long, base_heads array<long>, conv long, own_heads array<long>, n long, sums array<long>, only boolean, one_base boolean"
    found = {r.part: State(r.base, r.base_heads, r.conv, r.own_heads, r.n, tuple(r.sums), r.only, r.one_base) for r in map_batches(rows, run, ddl).collect()}
    out = [State()]
    for k in range(max(found, default=-1) + 1):
        out.append(out[-1].then(found[k], moduli, bases) if k in found else out[-1])
    return out


def _hits(rows: DataFrame, moduli, bases) -> DataFrame:
    """Every prefix of every rebuilt conversation: depth, print, print of the prefix before; role and text where the turn is the conversation's own."""
    states = [vars(s) for s in _states(rows, moduli, bases)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = states[min(TaskContext.get().partitionId(), len(states) - 1)]
        scan, state = Scan(moduli, bases), State(**begun)
        for batch in batches:
            hashes = batch.column("hash").to_numpy()
            kept, numbers, more = [], [], []
            for a, z, base, conv, inherits in _runs(batch):
                if conv != state.conv:
                    more.append((0, 0, -1, conv))
                state, (depth, own, before, skip), taken = scan.run(state, base, conv, inherits, hashes[a:z])
                kept.append(np.arange(a + skip, z))
                numbers.append((depth, own, before))
                more += [(*t, conv) for t in taken]
            if kept:
                at = pa.array(np.concatenate(kept))
                columns = [pa.array(np.concatenate(x)) for x in zip(*numbers)]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(c).take(at) for c in ("conv_id", "role", "text", "bytes"))], schema=_HIT)
            if more:
                columns = [pa.array(x, pa.int64()) for x in zip(*more)]
                rest = [pa.nulls(len(more), t) for t in _HIT.types[4:]]
                yield pa.RecordBatch.from_arrays([*columns, *rest], schema=_HIT)

    return map_batches(rows, run, HIT)


def verified(conversations: DataFrame, moduli=MODULI, bases=BASES) -> DataFrame:
    """Prefixes whose groups hold one content each, compared turn by turn; collisions are split."""
    salts = None
    for n in range(MOST_ROUNDS):
        hits = checkpoint(_hits(ordered(conversations, salts), moduli, bases))
        contents = hits.where("text is not null").groupBy("depth", "print", "parent_print", "role", "text").agg(F.min("conv_id").alias("conv_id"))
        represented = contents.groupBy("depth", "print").agg(F.count("*").alias("contents"), F.min("conv_id").alias("representative")).where("contents > 1")
        if represented.isEmpty():
            return hits
        other = contents.join(represented, ["depth", "print"]).where("conv_id <> representative").select("role", "text", F.lit(n).alias("salt"))
        salts = other if salts is None else salts.unionByName(other)
        salts = checkpoint(salts.groupBy("role", "text").agg(F.max("salt").alias("salt")))
    raise RuntimeError(f"fingerprints still collide after {MOST_ROUNDS} rounds")


def _joined_ends(hits: DataFrame) -> DataFrame:
    """node, ends_sha256: a long list of ids is joined in parts by many tasks, then only the parts pass through one digest."""
    last = hits.groupBy("conv_id").agg(F.max(F.struct("depth", "print")).alias("node")).select("node.depth", "node.print", "conv_id")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("print", pa.int64()), ("conv_id", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            depth, own, conv = (batch.column(c).to_numpy() for c in ("depth", "print", "conv_id"))
            changed = np.flatnonzero((depth[1:] != depth[:-1]) | (own[1:] != own[:-1])) + 1
            cuts = np.unique(np.concatenate(([0], changed, np.arange(0, len(conv), CHUNK), [len(conv)]))).tolist()
            rows = [(depth[a], own[a], conv[a], ",".join(map(str, conv[a:z].tolist()))) for a, z in zip(cuts, cuts[1:])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("depth", pa.int64()), ("print", pa.int64()), ("ends_sha256", pa.string())])
        node, sha = None, None
        for batch in batches:
            out = []
            for d, p, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "print", "ids"))):
                if (d, p) == node:
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, p), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip((*node, sha.hexdigest()), schema.types)], schema=schema)

    keys = ["depth", "print", "conv_id"]
    parts = map_batches(last.repartitionByRange(*keys).sortWithinPartitions(*keys), chunks, "depth long, print long, conv_id long, ids string")
    return map_batches(parts.repartition("depth", "print").sortWithinPartitions(*keys), digests, "depth long, print long, ends_sha256 string")


def _subtrees(nodes: DataFrame) -> DataFrame:
    """node, parent, n_leaves, saved_tokens (own values) -> node and the sums over its subtree."""
    state = checkpoint(nodes.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"))
    sums = ("n_leaves", "saved_tokens")
    while True:
        climbing = state.where("up is not null")
        total = climbing.count()
        if not total:
            return state.drop("up")
        given = climbing.groupBy(F.col("up").alias("node")).agg(*(F.sum(c).alias(f"more_{c}") for c in sums), F.count("*").alias("n"))
        both = checkpoint(state.join(given, "node", "left"))
        added = both.select("node", "up", *(F.expr(f"{c} + coalesce(more_{c}, 0)").alias(c) for c in sums))
        above = both.where("n is not null").select(F.col("node").alias("up"), F.col("up").alias("next"), "n")
        moved = labelled(added.where("up is not null"), above, "up", F.struct(F.lit(-1).cast("long").alias("depth"), F.xxhash64("node").alias("print")), total)
        state = checkpoint(moved.select("node", F.col("next").alias("up"), *sums).unionByName(added.where("up is null")))


def trie(conversations: DataFrame, moduli=MODULI, bases=BASES) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> a row for each node of the prefix trie of the rebuilt conversations."""
    hits = verified(conversations, moduli, bases)
    found = hits.groupBy("depth", "print").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("parent_print").alias("parent_print"), F.max("bytes").alias("bytes"))
    key = lambda depth, own: F.struct(depth.alias("depth"), own.alias("print"))
    parent = F.when(F.col("depth") > 0, key(F.col("depth") - 1, F.col("parent_print")))
    nodes = checkpoint(found.select(key(F.col("depth"), F.col("print")).alias("node"), parent.alias("parent"), "conv_id", "n_convs", "bytes"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = checkpoint(nodes.join(children, "node", "left"))
    own = nodes.select("node", "parent", F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"), F.coalesce((F.col("n_convs") - 1) * F.col("bytes"), F.lit(0).cast("long")).alias("saved_tokens"))
    sums = _subtrees(own)
    parents = nodes.where("n_children is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    spread = F.struct(F.lit(-1).cast("long").alias("depth"), F.xxhash64("node").alias("print"))
    with_parent = labelled(nodes.where("parent is not null"), parents, "parent", spread, nodes.count())
    named = with_parent.unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = _joined_ends(hits).select(F.struct("depth", "print").alias("node"), "ends_sha256")
    out = named.join(sums, "node").join(ends, "node", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        "conv_id", F.col("node.depth").alias("depth"), "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"),
    )


ORACLE_SQL = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as i
  from conversations where conv_id is not null
), own as (select conv_id, list(struct_pack(role := role, text := text) order by i) as turns from t group by conv_id),
h as (
  select conv_id, turns, conv_id - conv_id % 5 as base, cast(xor(list_reduce(
    list_concat([4294967295::ubigint], list_transform(string_split(cast(conv_id as varchar), ''), lambda c: ascii(c)::ubigint)),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::ubigint, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, z: case when x % 2 = 1 then xor(x // 2, 3988292384::ubigint) else x // 2 end)
  ), 4294967295::ubigint) % 9 as bigint) as h from own
), built as (
  select a.conv_id, list_concat(coalesce(list_slice(b.turns, 1, a.h), []), list_slice(a.turns, a.h + 1, len(a.turns))) as turns
  from h a left join own b on b.conv_id = a.base
), prefixes as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from built),
nodes as (
  select list_slice(turns, 1, depth) as p, depth, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (where len(turns) = depth), '') as ends
  from prefixes group by 1, 2
), children as (select list_slice(p, 1, depth - 1) as p, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by 1, 2),
own_values as (
  select n.*, coalesce(n_children, 0) as n_children, case when depth > 0 then (n_convs - 1) * octet_length(encode(p[depth].text)) else 0 end as saved
  from nodes n left join children c using (p, depth)
), sums as (
  select a.p, a.depth, sum(case when b.n_children = 0 then 1 else 0 end) as n_leaves, sum(b.saved) as saved_tokens
  from own_values a join own_values b on b.depth >= a.depth and list_slice(b.p, 1, a.depth) = a.p group by a.p, a.depth
)
select v.conv_id, v.depth, u.conv_id as parent_conv_id, v.n_convs, v.n_children, cast(n_leaves as bigint) as n_leaves,
  cast(saved_tokens as bigint) as saved_tokens, sha256(v.ends) as ends_sha256
from own_values v join sums s on s.p = v.p and s.depth = v.depth
left join nodes u on v.depth > 0 and u.depth = v.depth - 1 and u.p = list_slice(v.p, 1, v.depth - 1)
"""
