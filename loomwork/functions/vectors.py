"""Functions of number arrays as column expressions: they stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def normalised(v: Column) -> Column:
    """The array over its total, which is taken once (bound to a variable of its own)."""
    held = F.transform(F.array(v), lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x, lambda t: F.transform(a, lambda x: x / t)))
    return F.get(held, F.lit(0))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    """exp(t x) normalised to 1; null stays null."""
    return normalised(F.transform(v, lambda x: F.exp(x.cast("double") * temperature)))


def entropy(v: Column) -> Column:
    """Base 2, 0 log 0 = 0."""
    return F.aggregate(v, F.lit(0.0), lambda acc, p: acc - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def js_divergence(p: Column, q: Column, hp: Column | None = None, hq: Column | None = None) -> Column:
    """H(mean) - mean of entropies; pass the entropies where they are known, and a pair costs one log a dimension."""
    mean = F.zip_with(p, q, lambda a, b: (a + b) / 2)
    return entropy(mean) - ((entropy(p) if hp is None else hp) + (entropy(q) if hq is None else hq)) / 2


def js_similarity(p: Column, q: Column, hp: Column | None = None, hq: Column | None = None, form: str = "linear") -> Column:
    """1 - divergence, or 10 to the minus divergence (`form="power"`)."""
    d = js_divergence(p, q, hp, hq)
    return F.pow(F.lit(10.0), -d) if form == "power" else 1 - d


def literal(values: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in values))


def dot(p: Column, q: Column) -> Column:
    return total(F.zip_with(p, q, lambda a, b: a.cast("double") * b.cast("double")))


def fused(x: Column, y: Column, t: Column) -> Column:
    """x * y + t rounded once: the product and the sum with what each of them rounds off (Veltkamp, Dekker, Knuth)."""
    high = lambda a: a * 134217729.0 - (a * 134217729.0 - a)
    p, s = x * y, t + x * y
    (xh, xl), (yh, yl) = ((high(a), a - high(a)) for a in (x, y))
    off = ((xh * yh - p) + xh * yl + xl * yh) + xl * yl
    return s + (((t - (s - (s - t))) + (p - (s - t))) + off)


def dot_fused(p: Column, q: Column) -> Column:
    """dot() with one rounding an entry, as compiled SQL engines have it; slow, for the few values that hang on the last bit."""
    pairs = F.zip_with(p, q, lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, z: fused(z["a"], z["b"], acc))


def cosine(p: Column, q: Column) -> Column:
    """0 where a vector is all zero."""
    norm = F.sqrt(dot(p, p)) * F.sqrt(dot(q, q))
    return F.when(norm > 0, dot(p, q) / norm).otherwise(0.0)


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ, of two strings of one length; null for other lengths."""
    apart = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.aggregate(apart, F.lit(0), lambda acc, x: acc + x))


def argmax_last(v: Column) -> Column:
    """0-based; among equals the last."""
    return F.size(v) - F.array_position(F.reverse(v), F.array_max(v)).cast("int")


def argmax_first(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)).cast("int") - 1


def pairwise_fold(v: Column) -> Column:
    """((a + b) / 2 + c) / 2 ... in the order of the array; null where it is empty."""
    rest = F.slice(v, 2, F.greatest(F.size(v) - 1, F.lit(0)))
    return F.when(F.size(v) > 0, F.aggregate(rest, F.try_element_at(v, F.lit(1)), lambda acc, x: (acc + x) / 2))


def bit_signature(v: Column, limit: float, ratio: float) -> Column:
    """Slopes of successive values: 1 up, 0 down, nothing where the change is at most ratio * limit."""
    least = limit * ratio
    steps = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: b - a)
    return F.array_join(F.transform(F.filter(steps, lambda d: F.abs(d) > least), lambda d: F.when(d > 0, "1").otherwise("0")), "")


def bit_changes(bits: Column) -> Column:
    """How often neighbouring bits differ."""
    b = F.filter(F.split(bits, ""), lambda c: c != "")
    n = F.greatest(F.size(b) - 1, F.lit(0))
    apart = F.zip_with(F.slice(b, 1, n), F.slice(b, 2, n), lambda x, y: (x != y).cast("int"))
    return F.aggregate(apart, F.lit(0), lambda acc, x: acc + x)


def bit_neighbours(bits: Column) -> Column:
    """The signatures that differ in one bit, in the order of the bit."""
    flipped = lambda i: F.concat(
        F.substring(bits, F.lit(1), i - 1), F.when(F.substring(bits, i, F.lit(1)) == "1", "0").otherwise("1"), F.substring(bits, i + 1, F.length(bits))
    )
    return F.when(F.length(bits) > 0, F.transform(F.sequence(F.lit(1), F.length(bits)), flipped)).otherwise(F.array().cast("array<string>"))


#: Orders of a signature's bits that are listed at most (12 of 24 places hold ones in 2,704,156 ways).
MOST_ORDERS = 3_000_000


def bit_permutations(bits: Column) -> Column:
    """All orders of the bits of a signature, ascending: as many as there are ways to place its ones; null in, null out.

    Grown bit by bit, and only beginnings that the bits left can complete, so the work is that of the result. More than
    `MOST_ORDERS` orders raise an error.
    """
    n, ones = F.length(bits), F.length(F.regexp_replace(bits, "0", ""))
    few = F.least(ones, n - ones)
    ways = F.aggregate(F.sequence(F.lit(0), n), F.lit(1.0), lambda acc, i: F.when((i > 0) & (i <= few), acc * (n - i + 1) / i).otherwise(acc))
    one = lambda s: F.length(F.regexp_replace(s, "0", ""))
    longer = lambda s: F.filter(F.array(F.concat(s, F.lit("0")), F.concat(s, F.lit("1"))), lambda x: (one(x) <= ones) & (F.length(x) - one(x) <= n - ones))
    start = F.array(F.lit(""))
    orders = F.aggregate(F.sequence(F.lit(0), n), start, lambda acc, i: F.when(i > 0, F.flatten(F.transform(acc, longer))).otherwise(acc))
    return F.when(F.round(ways) > MOST_ORDERS, F.raise_error(F.lit("too many orders of a signature"))).otherwise(F.when(bits.isNotNull(), orders))


def relationship_similarity(a: Column, b: Column) -> Column:
    """Similarity of the weights of two lists of (uri, weight), each put in the order of uris; 0 where empty or of two sizes."""
    weights = lambda x: F.transform(F.array_sort(x), lambda r: r["weight"])
    usable = (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(usable, js_similarity(weights(a), weights(b))).otherwise(0.0)


def pair_count(n: Column) -> Column:
    """Unordered pairs of n things."""
    return n * (n - 1) / 2


def js_upper_bound(p: Column, q: Column) -> Column:
    """An upper bound of the similarity by total variation: cheaper than a log a dimension."""
    tv = total(F.zip_with(p, q, lambda a, b: F.abs(a - b))) / 2
    return 1 - tv * tv / (2 * math.log(2))
