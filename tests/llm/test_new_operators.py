"""Phrases, pieces and prefixes against brute force, the library itself and forced collisions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm import phrases, pieces, prefixes, queries

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"

# 11


def plain_phrases(rows, least, longest=4, top=2000):
    total, found, out = Counter(), defaultdict(Counter), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                found[lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    for lang, f in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {p[i : i + m] for p, a in candidates.items() for m in range(2, len(p)) for i in range(len(p) - m + 1) if 100 * a >= 80 * f[p[i : i + m]]}
        rows = []
        for p, a in candidates.items():
            if p not in gone:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r, p.decode(), -a, x, y, total[lang], -s) for r, (s, a, p, x, y) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize(("least", "size", "top"), [(2, 40, 2000), (3, 10**6, 7)])
def test_phrases_against_counting(spark, least, size, top):
    rng = random.Random(least)
    words = ["the", "The", "a", "of", "und", "é", "x" * 50, "New", "york", "#", "\x00", "c++"]
    rows = [(None, None), ("en", ""), ("en", " ,. \t\n"), (None, "a of a of a of"), ("und", "a of, a of a of")]
    rows += [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "! "]) for _ in range(rng.randrange(60)))) for _ in range(60)]
    rows += [("en", "a a a a a a a")] * 3
    docs = spark.createDataFrame([(lang, text, 1) for lang, text in rows], "lang string, text string, n long").repartition(3)
    got = sorted(tuple(r) for r in phrases.mine(docs, least=least, size=size, top=top).collect())
    assert got == plain_phrases(rows, least, top=top) and len(got) > 5


def test_phrases_empty(spark):
    assert phrases.mine(spark.createDataFrame([], "lang string, text string")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=300))
def test_bitmaps(codes):
    owner = np.array(codes, np.int32)
    keys, n = phrases.pairs_of(owner, 4)
    true = Counter(a * 4 + b for a, b in zip(codes, codes[1:]) if a >= 0 and b >= 0)
    assert dict(zip(keys.tolist(), n.tolist())) == true and len(keys) == len(true)
    frequent = np.array([k for k, m in true.items() if m >= 2], np.int64)
    got = {}
    for words, counts in phrases.longer_of(owner, 4, frequent):
        got |= {tuple(w for w in row if w >= 0): c for row, c in zip(words.tolist(), counts.tolist())}
    runs = Counter(tuple(codes[i : i + m]) for m in (3, 4) for i in range(len(codes) - m + 1))
    assert got == {r: c for r, c in runs.items() if all(a >= 0 and b >= 0 and a * 4 + b in frequent for a, b in zip(r, r[1:]))}
    at = [i for i, c in enumerate(codes) if c == 0]
    bits = phrases.packed(np.array(at, np.int64), len(codes))
    assert np.bitwise_count(bits).sum() == len(at) and np.array_equal(phrases.shifted(bits), phrases.packed(np.array(at, np.int64) + 1, len(codes)))


def test_squeezed_round_trip():
    for table in (np.zeros((3, 0), np.int64), np.arange(-6, 6).reshape(3, 4), np.arange(7, dtype=np.int32)[None]):
        assert np.array_equal(phrases.unsqueezed(phrases.squeezed(table)), table)


# 12


@pytest.fixture(scope="module")
def library():
    import public_tokenizers as public

    return sentencepiece.SentencePieceProcessor(model_file=public.path(pieces.MODEL))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" ▁\n\té中ﬁ𝔘<s>\x00ab"), st.characters(exclude_categories=["Cs"])), max_size=60), min_size=1, max_size=6))
def test_pieces_as_the_library(library, texts):
    got = list(pieces.public_encoder()([t.encode() for t in texts]))
    ids = library.encode(texts, add_bos=True, add_eos=True)
    assert [g[0].tolist() for g in got] == ids and [g[3] for g in got] == library.decode(ids)
    for text, (_, starts, ends, _) in zip(texts, got):
        raw = text.encode()
        assert starts[1:].tolist() == ends[:-1].tolist() and starts[0] == 0 and ends[-1] == len(raw)  # spans follow each other over the whole text
        assert list(zip(starts[1:-1], ends[1:-1])) == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]  # bytes


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "nfkc", "identity"])
def test_character_maps_as_the_library(rule):
    from sentencepiece import sentencepiece_model_pb2 as proto

    library = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = pieces.Normaliser(proto.NormalizerSpec.FromString(library.serialized_normalizer_spec()))
    rng = random.Random(1)
    alphabet = ["a", "B", " ", "  ", "▁", "\n", "é", "é", "𝔘", "中", "ﬁ", "　", "​", "Ａ", "①", "ｶﾞ", "™", "\xa0", "Å", "ǅ", "½", "ffl"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(25)))
        out, origin = own(text.encode())
        points = [len(text.encode()[:k].decode("utf8", "ignore")) for k in origin]
        each = np.cumsum([0, *(len(c.encode()) for c in out.decode())])
        assert (out.decode(), [points[i] for i in each]) == library.normalize(text, with_offsets=True)


def test_pieces_query(spark, library, tmp_path):
    texts = [None, "", "one two", "one two", "x" * 5000, "word " * 3000, "déjà\n vu  ▁", "中文" * 700]
    spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_pieces(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    full = {r.doc_id: r for r in pieces.encode(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert full[2].ids == library.encode("one two", add_bos=True, add_eos=True) and full[2].ends == [0, 3, 7, 7] and full[2].decoded == "one two"


# 13


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p], digest(p)) for p, m in members.items()), key=str)


def random_turns(seed, n=400):
    rng = random.Random(seed)
    rows = [(rng.choice([None, *range(-12, 40)]), rng.choice([None, *range(6)]), rng.choice([None, "u", "a"]), rng.choice([None, "x", "y", "xx", "é"])) for _ in range(n)]
    return rows + [(7, i, "u", f"t{i % 3}") for i in range(60)] + [(5, i, "u", f"t{i % 3}") for i in range(50)]


@pytest.mark.parametrize("partitions", [4, 23])
def test_trie_against_recursion(spark, partitions):
    rows = random_turns(partitions)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the long conversations cross several ranges
        got = prefixes.trie(spark.createDataFrame([(*r, "x") for r in rows], TURNS + ", depth string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)


def test_trie_splits_collisions(spark, monkeypatch):
    rows = random_turns(3, 250)[:250]
    rounds = []
    plain = prefixes.ordered
    monkeypatch.setattr(prefixes, "ordered", lambda *a: rounds.append(1) or plain(*a))
    got = prefixes.trie(spark.createDataFrame(rows, TURNS), moduli=(1009, 1), bases=(17, 1)).collect()
    assert sorted(map(tuple, got), key=str) == plain_trie(rows)
    assert len(rounds) > 1  # some fingerprints did collide


def test_trie_empty(spark):
    assert prefixes.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefixes.trie(spark.createDataFrame([(None, 1, "u", "x")], TURNS)).collect() == []


@pytest.mark.parametrize("name", ["op11_phrases", "op13_prefixes"])
def test_new_queries_match_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = db.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, SF).toPandas()
    same = lambda df: sorted(map(str, df[sorted(df.columns)].astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(expected.columns) and len(got) == len(expected)
    norm = lambda rows: [re.sub(r"(\d)\.0\b", r"\1", r) for r in rows]
    assert norm(same(got)) == norm(same(expected))
