"""Finding the few places of a text that a tagger has to look at.

A text's bytes are classified by table look-up in numpy; only the stretches
around bytes (or long tokens) that can belong to a secret or to personal data
are handed to the Python-side models. Offsets are code points.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def flags(characters: str) -> np.ndarray:
    """A look-up table that marks those ASCII characters."""
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


def stretches(raw: bytes, marked: np.ndarray, reach: int, long_token: int = 0, words: tuple[bytes, ...] = ()) -> list[tuple[int, int]]:
    """Byte ranges, disjoint and ascending, that hold every marked byte, every run without blanks of `long_token`
    bytes and every one of `words` (lower case, found in any case), with `reach` bytes to both sides, widened to blanks.
    """
    if not raw:
        return []
    octets = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(marked[octets])
    space = None
    if long_token:
        space = np.concatenate(([-1], np.flatnonzero(_SPACE[octets]), [len(raw)]))
        gaps = np.diff(space) - 1
        hit = np.flatnonzero(gaps >= long_token)
        if len(hit):
            at = np.concatenate((at, space[hit] + 1, space[hit + 1] - 1))
    if words:
        low = raw.lower()
        found = []
        for w in words:
            k = low.find(w)
            while k >= 0:
                found += [k, k + len(w) - 1]
                k = low.find(w, k + 1)
        if found:
            at = np.concatenate((at, found))
    if not len(at):
        return []
    at = np.sort(at)
    if space is None:
        space = np.concatenate(([-1], np.flatnonzero(_SPACE[octets]), [len(raw)]))
    # widened to the blanks beyond the reach
    left = space[np.maximum(np.searchsorted(space, at - reach, "right") - 1, 0)] + 1
    right = space[np.minimum(np.searchsorted(space, at + reach, "left"), len(space) - 1)]
    out: list[tuple[int, int]] = []
    cut = np.flatnonzero(np.concatenate(([True], left[1:] > np.maximum.accumulate(right)[:-1])))
    reached = np.maximum.accumulate(right)
    for a, z in zip(cut, np.append(cut[1:], len(at))):
        out.append((int(left[a]), int(reached[z - 1])))
    return out


def decoded(raw: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, str]]:
    """(code-point offset, text) of byte ranges that end at blanks."""
    out = []
    offset = at = 0
    for a, z in ranges:
        offset += len(raw[at:a].decode("utf-8", "replace"))
        text = raw[a:z].decode("utf-8", "replace")
        out.append((offset, text))
        offset += len(text)
        at = z
    return out


def digest_text(spans: list[tuple[str, int, int]], order: dict[str, int]) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{k}:{a}:{z}" for k, a, z in sorted(spans, key=lambda s: (s[1], order.get(s[0], len(order)), s[2])))


class Taken:
    """Ranges that later ones must not overlap; a look-up and an addition at the end cost little."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, z in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], z)
            else:
                self.starts.append(a)
                self.ends.append(z)

    def meets(self, a: int, z: int) -> bool:
        k = bisect_left(self.starts, z) - 1
        return k >= 0 and self.ends[k] > a
