"""Generalised Kendall's tau between word rankings with an element similarity.

Two rankings are compared over the words of both. Words match by Levenshtein
similarity; a pair of positions counts against the similarity by how discordant
it is, weighted by how alike the paired words are. The distance is normalised
to 0..1 and the similarity is 1 minus it. Pure numpy: rankings are a topic's
words, bounded by words per topic.
"""

from __future__ import annotations

import numpy as np


def levenshtein(a: str, b: str) -> int:
    if len(a) < len(b):
        a, b = b, a
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def word_similarity(a: str, b: str) -> float:
    longest = max(len(a), len(b))
    return 1.0 if not longest else 1 - levenshtein(a, b) / longest


def word_similarities(left: list[str], right: list[str]) -> np.ndarray:
    """word_similarity of all words of `left` with all of `right`: one step for all pairs a pair of places, not one a pair of words."""
    sizes = np.array([len(w) for w in left])[:, None], np.array([len(w) for w in right])[None, :]
    codes = []
    for words in (left, right):
        grid = np.full((len(words), max(map(len, words), default=0)), -1, np.int64)
        for i, w in enumerate(words):
            grid[i, : len(w)] = [ord(c) for c in w]
        codes.append(grid)
    a, b = codes
    shape = len(left), len(right)
    # row[j]: the distance of the first i letters of each left word to the first j of each right word
    row = np.broadcast_to(np.arange(b.shape[1] + 1, dtype=np.int32)[:, None, None], (b.shape[1] + 1, *shape)).copy()
    found = np.take_along_axis(row, np.broadcast_to(sizes[1], shape)[None], 0)[0]
    out = np.where(sizes[0] == 0, found, 0)
    for i in range(1, a.shape[1] + 1):
        last = row[0].copy()
        row[0] = i
        for j in range(1, b.shape[1] + 1):
            apart = a[:, i - 1, None] != b[None, :, j - 1]
            last, row[j] = row[j].copy(), np.minimum(np.minimum(row[j], row[j - 1]) + 1, last + apart)
        found = np.take_along_axis(row, np.broadcast_to(sizes[1], shape)[None], 0)[0]
        out = np.where(sizes[0] == i, found, out)
    longest = np.maximum(*np.broadcast_arrays(*sizes))
    return np.where(longest > 0, 1 - out / np.maximum(longest, 1), 1.0)


def half(a: str, b: str) -> float:
    """The constant element similarity: 1 for the same word, else a half."""
    return 1.0 if a == b else 0.5


def tau_distance(left: list[str], right: list[str], alike=word_similarity) -> float:
    """0 for equal rankings, up to 1 for disjoint or reversed ones; the same both ways; two empty rankings are equal.

    Over all pairs of words of both rankings: a word stands at its place, or, where the other ranking does not have it,
    at that of the word most like it (of several the first), as surely as the two are alike; without any likeness, nowhere.
    A pair costs 1 less its two words' sureness, or all of it where the rankings order it in opposite ways.
    """
    if not left or not right:
        return 0.0 if not left and not right else 1.0
    words = sorted(set(left) | set(right))
    places, sure = np.zeros((2, len(words))), np.ones(len(words))
    for k, ranking in enumerate((left, right)):
        at = {w: i for i, w in reversed(list(enumerate(ranking)))}
        absent = [i for i, w in enumerate(words) if w not in at]
        places[k] = [at.get(w, 0) for w in words]
        if not absent:
            continue
        missing = [words[i] for i in absent]
        likeness = word_similarities(missing, ranking) if alike is word_similarity else np.array([[alike(w, x) for x in ranking] for w in missing])
        places[k, absent] = likeness.argmax(axis=1)
        sure[absent] *= likeness.max(axis=1)
    if len(words) == 1:
        return float(1 - sure[0])
    i, j = np.triu_indices(len(words), 1)
    one, two = np.sign(places[0, i] - places[0, j]), np.sign(places[1, i] - places[1, j])
    kept = np.where(one * two < 0, 0.0, np.where(one == two, 1.0, 0.5)) * sure[i] * sure[j]
    return float(1 - kept.mean())


def tau_similarity(left: list[str], right: list[str], alike=word_similarity) -> float:
    """1 for equal rankings, towards 0 for disjoint or reversed ones."""
    return 1 - tau_distance(left, right, alike)
