"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_TOKEN = 4


def tokens(text: Column, min_length: int = MIN_TOKEN) -> Column:
    """Lower-cased words between runs of non-word characters (ASCII), `min_length` characters at least."""
    return F.filter(F.split(F.lower(text), r"[\W]+"), lambda t: F.length(t) >= min_length)


def stop_words(listed: str | None) -> list[str]:
    """The words of a comma-separated list, not trimmed; none where it is unset."""
    return listed.split(",") if listed else []


def without_stop_words(words: Column, stop: list[str]) -> Column:
    """Drop listed words whatever their case."""
    low = [w.lower() for w in stop]
    return F.filter(words, lambda t: ~F.lower(t).isin(low)) if low else words


def is_blank(text: Column) -> Column:
    """Null, empty, or nothing but characters up to U+0020 (blanks, tabs, line ends and other controls)."""
    return text.isNull() | text.rlike(r"\A[\x00-\x20]*\z")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty strings are alike."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def java_hash(text: Column) -> Column:
    """The 32-bit polynomial hash with factor 31 over the UTF-16 units, as a signed number."""
    span = 1 << 32

    def step(acc: Column, c: Column) -> Column:
        p = F.ascii(c)
        high, low = 0xD800 + F.floor((p - 0x10000) / 0x400), 0xDC00 + (p - 0x10000) % 0x400
        return F.when(p < 0x10000, (acc * 31 + p) % span).otherwise(((acc * 31 + high) % span * 31 + low) % span)

    rolled = F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"), step)
    return (rolled + (span >> 1)) % span - (span >> 1)


def on_route(u: Column, route: str) -> Column:
    """Whether the URI passes a route, as in .../items/..."""
    return u.contains(f"/{route}/")


def uri(*parts: str | Column) -> Column:
    return F.concat_ws("/", *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def uri_id(u: Column) -> Column:
    return F.element_at(F.split(u, "/"), -1)


def uri_type(u: Column) -> Column:
    """item, part, domain, ... from the route before the id (its plural s dropped)."""
    return F.regexp_replace(F.lower(F.element_at(F.split(u, "/"), -2)), "s$", "")


def path_text(uris: Column) -> Column:
    """item(a)->part(b) of an array of URIs."""
    named = F.transform(uris, lambda u: F.concat(uri_type(u), F.lit("("), uri_id(u), F.lit(")")))
    return F.array_join(named, "->")
