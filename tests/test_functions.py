import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwork.functions import ranking
from loomwork.functions import text as X
from loomwork.functions import vectors as V
from loomwork.plans.config import Config, resolve


def one(spark, **columns):
    got = spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()
    return next(iter(got.values())) if len(got) == 1 else got


def test_tokens(spark):
    assert one(spark, x=X.tokens(F.lit("zeta beta alpha zeta Êtes été gammaé abc"))) == ["zeta", "beta", "alpha", "zeta", "gamma"]


def test_java_hash(spark):
    got = one(spark, a=X.java_hash(F.lit("http://example.org/items/doc1")), b=X.java_hash(F.lit("Aa")), c=X.java_hash(F.lit("BB")), d=X.java_hash(F.lit("")))
    assert got == {"a": 1058522249, "b": 2112, "c": 2112, "d": 0}


def test_levenshtein(spark):
    got = one(spark, a=X.levenshtein_similarity(F.lit("kitten"), F.lit("sitting")), b=X.levenshtein_similarity(F.lit(""), F.lit("")))
    assert got["a"] == pytest.approx(1 - 3 / 7) and got["b"] == 1.0
    assert ranking.levenshtein("kitten", "sitting") == 3


def test_similarity_fixtures(spark):
    p, q = V.literal([0.5, 0.5]), V.literal([1.0, 0.0])
    got = one(spark, a=V.js_similarity(p, q), b=V.js_similarity(V.literal([0.0, 1.0]), q), c=V.js_similarity(p, p))
    assert got["a"] == pytest.approx(0.6887218755) and got["b"] == pytest.approx(0) and got["c"] == pytest.approx(1)


def test_arrays(spark):
    got = one(
        spark, last=V.argmax_last(V.literal([0.4, 0.2, 0.4])), first=V.argmax_first(V.literal([0.4, 0.2, 0.4])), fold=V.pairwise_fold(V.literal([1, 2, 4])),
        empty=V.pairwise_fold(F.array().cast("array<double>")), pairs=V.pair_count(F.lit(10)), changes=V.bit_changes(F.lit("1101")), none=V.bit_changes(F.lit("")),
        far=V.hamming(F.lit("karolin"), F.lit("kathrin")), odd=V.hamming(F.lit("a"), F.lit("ab")), zero=V.cosine(V.literal([0, 0]), V.literal([1, 1])),
    )
    assert got == {"last": 2, "first": 0, "fold": 2.75, "empty": None, "pairs": 45, "changes": 2, "none": 0, "far": 3, "odd": None, "zero": 0.0}


vectors = st.lists(st.floats(0.001, 1), min_size=4, max_size=4).map(lambda v: [x / sum(v) for x in v])


@settings(max_examples=15, deadline=None)
@given(vectors, vectors)
def test_similarity_properties(spark, p, q):
    a, b = V.literal(p), V.literal(q)
    got = one(spark, pq=V.js_similarity(a, b), qp=V.js_similarity(b, a), bound=V.js_upper_bound(a, b))
    assert got["pq"] == pytest.approx(got["qp"], abs=1e-12) and -1e-9 <= got["pq"] <= 1 + 1e-9
    assert got["bound"] >= got["pq"] - 1e-9
    kl = lambda x, m: sum(s * math.log2(s / t) for s, t in zip(x, m))
    mean = [(s + t) / 2 for s, t in zip(p, q)]
    assert got["pq"] == pytest.approx(1 - (kl(p, mean) + kl(q, mean)) / 2, abs=1e-9)


def test_ranking():
    words = ["alpha", "beta", "gamma"]
    assert ranking.tau_similarity(words, words) == 1.0
    assert ranking.tau_similarity(words, words[::-1]) < 0.6
    assert ranking.tau_similarity([], []) == 1.0 and ranking.tau_similarity(words, []) == 0.0
    assert 0 <= ranking.tau_similarity(words, ["delta", "eps"]) <= 1


def test_uris(spark):
    u = F.lit("http://x/items/7")
    assert one(spark, a=X.uri_id(u), b=X.uri_type(u), c=X.path_text(F.array(u, F.lit("parts/9")))) == {"a": "7", "b": "item", "c": "item(7)->part(9)"}


def test_settings():
    assert resolve({}, {}) == Config()
    got = resolve({"lda.topics": "5", "lda.alpha": "0.5"}, {"LDA_NUM_TOPICS": "9", "LDA_VOCABULARY_SIZE": "50"})
    assert (got.topics, got.alpha, got.vocabulary_size) == (5, 0.5, 50)
    assert X.stop_words(None) == [] and X.stop_words("a, b") == ["a", " b"]


def test_rankings_both_ways():
    a, b = ["alpha", "beta"], ["beta", "gamma", "alpha"]
    assert ranking.tau_similarity(a, b) == ranking.tau_similarity(b, a)
    assert ranking.tau_distance(a, a) == 0 and ranking.tau_similarity([], []) == 1 and ranking.tau_similarity(a, []) == 0
    assert ranking.tau_distance(a, a[::-1]) == 1 and 0 < ranking.tau_distance(a, b, ranking.half) < 1
    assert ranking.tau_distance(a, ["xxxx", "yyyy"], ranking.half) == ranking.tau_distance(["xxxx", "yyyy"], a, ranking.half) > 0.5


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("abcé", max_size=6), min_size=1, max_size=5), st.lists(st.text("abcd", max_size=6), min_size=1, max_size=5))
def test_word_similarities_are_those_of_each_pair(left, right):
    got = ranking.word_similarities(left, right)
    assert got.tolist() == [[ranking.word_similarity(a, b) for b in right] for a in left]
    plain = lambda a, b: ranking.word_similarity(a, b)
    assert ranking.tau_distance(left, right) == ranking.tau_distance(left, right, plain)


def test_bit_permutations(spark):
    from itertools import permutations
    from math import comb

    short = ["", "0", "1", "10", "0110", "111", "1010010"]
    got = {r.bits: r.orders for r in spark.createDataFrame([(b,) for b in [*short, None]], "bits string").select("bits", V.bit_permutations(F.col("bits")).alias("orders")).collect()}
    assert got.pop(None) is None
    assert got == {b: sorted({"".join(x) for x in permutations(b)}) for b in short}
    long = spark.createDataFrame([("1" * 3 + "0" * 59,)], "bits string").select(F.explode(V.bit_permutations(F.col("bits"))).alias("o"))
    assert long.distinct().count() == comb(62, 3)
    with pytest.raises(Exception, match="too many orders"):
        spark.createDataFrame([("10" * 31,)], "bits string").select(V.bit_permutations(F.col("bits"))).collect()


def test_signature_quality_forms_pairs_once(spark):
    """The same as the two tables of pairs compared, doubled rows and nulls included; nothing but the rows of sectors is shuffled."""
    from loomwork.operators import similarity

    rows = [(f"u{i}", "item", [float(1 + i % 3), float(1 + i * 7 % 5), 1.0], i % 4) for i in range(40)]
    rows += [rows[3], ("u3", "item", [9.0, 1.0, 1.0], 3), ("u7", "item", None, 3), (None, "item", [1.0, 1.0, 1.0], 1), ("u50", "item", [1.0, 1.0, 1.0], None)]
    table = spark.createDataFrame(rows, "uri string, type string, vector array<double>, sector long").withColumn("vector", V.normalised(F.col("vector")))
    bits = V.bit_signature(F.col("vector"), 0.05, 0.25)
    b = table.select("uri", "sector", bits.alias("bits"))
    found = b.join(b.withColumnRenamed("uri", "other"), ["sector", "bits"]).where("uri < other").select(F.col("uri").alias("resource_uri_1"), F.col("other").alias("resource_uri_2"))
    want = similarity.precision_recall(found, similarity.in_sector(table, least=0.9), ["resource_uri_1", "resource_uri_2"]).collect()
    got = similarity.signature_quality(table, bits, 0.9)
    assert got.collect() == want and 0 < want[0].recall < 1
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # sectors meet in a shuffle, as those of a large table do
    try:
        plan = similarity.signature_quality(table, bits, 0.9)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert dealt and not any("uri" in line.split("hashpartitioning")[1] for line in dealt)
    assert [tuple(r) for r in similarity.signature_quality(table.limit(0), bits, 0.9).collect()] == [(None, None)]
