"""Offset-preserving SentencePiece encoding and decoding.

A text is normalised here: at every place the longest entry of the model's
compiled character map that matches is replaced, and each byte of the outcome
remembers the source byte it comes from. The pieces, found on the normalised
text, are then projected through that record to byte spans of the original.

The library segments the normalised text, by a copy of the model whose own
normaliser is switched off. Where no piece of the vocabulary holds a blank mark
after another character, no merge can cross the start of a word, so a text is cut
there, and a word that occurs again takes its pieces from a bounded memory; with
any other vocabulary texts are segmented whole. Decoding is the library's own.

Every text is a row by itself: no shuffle, memory bounded by a group of texts.

Defined cases: null text = empty = begin and end id alone; invalid UTF-8 bytes
become U+FFFD each, as in the library; repeated rows are encoded each; an empty
table gives no rows; further columns are ignored. No text is cut short.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm.base import arrow_schema, groups, map_batches, text_bytes

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words that a task remembers, and their characters at most.
REMEMBERED, WORD_LENGTH = 1_000_000, 64

DDL = "doc_id long, ids array<int>, starts array<long>, ends array<long>, decoded string"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, spans_sha256 string"


class CharacterMap:
    """The compiled character map: a double-array trie of byte strings, and what they become.

    Fixed format: length of the trie as unsigned 32 bits, its units of 32 bits, then replacements that end with a zero byte.
    """

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.values = blob[4 + size :]
        #: Bytes that some entry starts with.
        self.first = np.zeros(256, bool)
        if self.units:
            root = self._child(self.units[0])
            for b in range(256):
                at = root ^ b
                self.first[b] = at < len(self.units) and self._label(self.units[at]) == b and b > 0

    @staticmethod
    def _child(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    @staticmethod
    def _label(unit: int) -> int:
        return unit & 0x800000FF

    def longest(self, raw: bytes, start: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest entry at `start`, or None."""
        if not self.units:
            return None
        units, found = self.units, None
        at = self._child(units[0])
        for k in range(start, len(raw)):
            at ^= raw[k]
            if at >= len(units) or self._label(units[at]) != raw[k]:
                break
            unit = units[at]
            at ^= self._child(unit)
            if unit >> 8 & 1:
                found = units[at] & 0x7FFFFFFF, k + 1 - start
        if found is None:
            return None
        value, length = found
        return self.values[value : self.values.index(b"\0", value)], length


class Normaliser:
    """The rules of a model's normaliser; call it with bytes for (normalised bytes, source offset of each of them and of the end)."""

    def __init__(self, spec, as_suffix: bool = False, symbols: tuple[str, ...] = ()):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.dummy, self.strip, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.as_suffix = as_suffix
        #: Strings that stay as they are, longest first.
        self.symbols = sorted((s.encode() for s in symbols), key=len, reverse=True)
        self.space = MARK.encode() if self.escape else b" "

    def __call__(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        if not raw:
            return b"", np.zeros(1, np.int64)
        octets = np.frombuffer(raw, np.uint8)
        if not (self.strip or self.symbols or self.map.first[octets].any() or _invalid(raw)):
            return self._plain(raw, octets)
        return self._walked(raw)

    def _plain(self, raw: bytes, octets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """No entry of the map can match: only blanks change."""
        out = raw.replace(b" ", self.space)
        origin = np.arange(len(raw), dtype=np.int64)
        inner = (octets & 0xC0) == 0x80
        if inner.any():  # the bytes of a character come from its first one
            origin[inner] = 0
            np.maximum.accumulate(origin, out=origin)
        if len(out) > len(raw):
            origin = np.repeat(origin, np.where(octets == 32, len(self.space), 1))
        before, after = (b"", self.space) if self.as_suffix else (self.space, b"")
        if not self.dummy:
            before = after = b""
        ends = np.full(len(after) + 1, len(raw), np.int64)
        return before + out + after, np.concatenate((np.zeros(len(before), np.int64), origin, ends))

    def _prefix(self, raw: bytes, at: int) -> tuple[bytes, int]:
        """What stands for the characters at a place, and how many bytes they take."""
        for s in self.symbols:
            if raw.startswith(s, at):
                return s, len(s)
        if self.map.first[raw[at]] and (found := self.map.longest(raw, at)):
            return found
        lead = raw[at]
        n = 1 if lead < 0x80 else 2 if lead >> 5 == 6 else 3 if lead >> 4 == 14 else 4 if lead >> 3 == 30 else 1
        own = raw[at : at + n]
        return ("�".encode(), 1) if _invalid(own) else (own, n)

    def _walked(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        at = 0
        if self.strip:
            while at < len(raw):
                piece, n = self._prefix(raw, at)
                if piece != b" ":
                    break
                at += n
            if at == len(raw):
                return b"", np.zeros(1, np.int64)
        out, origin = bytearray(), []

        def add(what: bytes) -> None:
            out.extend(what)
            origin.extend([at] * len(what))

        if self.dummy and not self.as_suffix:
            add(self.space)
        after_space = self.strip
        while at < len(raw):
            piece, n = self._prefix(raw, at)
            if after_space:
                piece = piece.lstrip(b" ")
            if piece:
                add(piece.replace(b" ", self.space))
                after_space = piece.endswith(b" ")
            at += n
            after_space = after_space and self.strip
        if self.strip:
            while out.endswith(self.space):
                at = origin[len(out) - len(self.space)]
                del out[len(out) - len(self.space) :]
                del origin[len(out) :]
        if self.dummy and self.as_suffix:
            add(self.space)
        return bytes(out), np.array([*origin, at], np.int64)


def _invalid(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return True
    return False


class Encoder:
    """Ids, byte spans and decoded texts by the model at `path`."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            blob = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=blob)
        model = proto.ModelProto.FromString(blob)
        kinds = proto.ModelProto.SentencePiece
        symbols = tuple(p.piece for p in model.pieces if p.type == kinds.USER_DEFINED)
        self.normalise = Normaliser(model.normalizer_spec, model.trainer_spec.treat_whitespace_as_suffix, symbols)
        spec = model.normalizer_spec
        spec.name, spec.precompiled_charsmap = "identity", b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.lengths = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.words = None if any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in model.pieces) else re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        #: Ids of all remembered words one after the other, the bytes each stands for, and where each word begins.
        self.ids = self.widths = np.zeros(0, np.int64)
        self.begins = np.zeros(1, np.int64)

    def _segment(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of normalised texts one after the other, the bytes that each stands for, and how many ids a text has."""
        found = self.bare.encode(texts, num_threads=1) if texts else []
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, counts.sum())
        widths = self.lengths[ids]
        if (ids == self.unknown).any():  # such a piece is as long as what it stands for
            widths = np.array([len(p.encode()) for t in texts for p in self.bare.encode(t, out_type=str)], np.int64)
        return ids, widths, counts

    def _parts(self, normal: str) -> list[str]:
        """Where a text is cut: words without their mark, or, where marks follow each other, with marks (one more than they have)."""
        if not self.words or not normal:
            return [MARK + normal] if normal else []
        if normal.startswith(MARK) and not normal.endswith(MARK) and MARK + MARK not in normal:
            return normal[1:].split(MARK)
        return [MARK + w for w in self.words.findall(normal)]

    def _pieces(self, normal: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and widths of all pieces of normalised texts, and how many each text has."""
        parts = [self._parts(t) for t in normal]
        flat = list(chain.from_iterable(parts))
        if len(self.known) > REMEMBERED:
            self._forget()
        used = np.fromiter(map(self.known.get, flat, repeat(-1)), np.int64, len(flat))
        ids, widths, begins = self.ids, self.widths, self.begins
        if len(missing := np.flatnonzero(used < 0).tolist()):
            new = dict.fromkeys(flat[i] for i in missing)
            kept = [w for w in new if len(w) <= WORD_LENGTH]
            long = [w for w in new if len(w) > WORD_LENGTH]  # only for now
            for words in (kept, long):
                more, wide, counts = self._segment([w[1:] if w.startswith(MARK) else MARK + w for w in words])
                ids, widths = np.concatenate((ids, more)), np.concatenate((widths, wide))
                new.update(zip(words, range(len(begins) - 1, len(begins) - 1 + len(words))))
                begins = np.concatenate((begins, begins[-1] + np.cumsum(counts)))
                if words is kept:
                    self.ids, self.widths, self.begins = ids, widths, begins
                    self.known.update(new if not long else ((w, new[w]) for w in kept))
            used[missing] = [new[flat[i]] for i in missing]
        each = begins[used + 1] - begins[used]
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[used] - ends + each, each)
        borders = np.concatenate(([0], ends))[np.cumsum([0, *map(len, parts)])]
        return ids[at], widths[at], np.diff(borders)

    def __call__(self, raws: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """For each text: ids with begin and end, first and last byte of their spans, decoded text."""
        normal = [self.normalise(r) for r in raws]
        ids, widths, counts = self._pieces([n.decode() for n, _ in normal])
        borders = np.concatenate(([0], np.cumsum(counts)))
        out = []
        for k, (raw, (_, origin)) in enumerate(zip(raws, normal)):
            own = slice(borders[k], borders[k + 1])
            stops = origin[np.concatenate(([0], np.cumsum(widths[own])))]
            full = np.concatenate(([self.library.bos_id()], ids[own], [self.library.eos_id()]))
            out.append((full, np.concatenate(([0], stops[:-1], [len(raw)])), np.concatenate(([0], stops[1:], [len(raw)]))))
        decoded = self.library.decode([full.tolist() for full, _, _ in out], num_threads=1)
        for (full, a, z), text in zip(out, decoded):
            yield full, a, z, text


_ENCODERS: dict[str, Encoder] = {}


def public_encoder(name: str = MODEL) -> Encoder:
    """By the installed public model of that name; loaded once per process."""
    if name not in _ENCODERS:
        import public_tokenizers as public

        _ENCODERS[name] = Encoder(public.path(name))
    return _ENCODERS[name]


def _mapped(docs: DataFrame, ddl: str, model: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, schema = public_encoder(model), arrow_schema(ddl)
        for batch in batches:
            ids, raws = batch.column("doc_id").to_pylist(), text_bytes(batch.column("text"))
            for a, z in groups(map(len, raws)):
                rows = [row(d, raw, *got) for d, raw, got in zip(ids[a:z], raws[a:z], encode(raws[a:z]))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return map_batches(docs.select("doc_id", "text"), run, ddl)


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """documents -> doc_id, ids, starts and ends (bytes of the original text, of each id), decoded."""
    return _mapped(docs, DDL, model, lambda d, raw, ids, a, z, text: (d, ids, a, z, text))


def _digest(d: int, raw: bytes, ids: np.ndarray, a: np.ndarray, z: np.ndarray, text: str) -> tuple:
    sha = lambda data: hashlib.sha256(data).hexdigest()
    spans = np.stack((a, z), 1).astype("<u4").tobytes()
    return d, len(ids), sha(ids.astype("<u4").tobytes()), sha(text.encode()), len(raw), sha(spans)


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """What encode() finds, as digests: of the ids, of the decoded text (UTF-8) and of the spans (start, end of each id), unsigned little-endian 32 bits."""
    return _mapped(docs, DIGESTS, model, _digest)
