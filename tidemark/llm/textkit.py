"""Words of Arrow text columns as numpy spans and 64-bit hashes.

These helpers run inside Spark tasks (``mapInArrow``). They see one slice of a
record batch at a time, so memory follows the slice (``SLICE_BYTES`` or one
longer text), not the partition. Bytes are marked by arrays of one byte each
and hashed in stretches of ``SLICE_BYTES``; what a long text needs beside is a
few numbers for each of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are handled in slices of about so many bytes; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20

_SEED = np.random.Generator(np.random.PCG64(20240201))
_BYTE = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = int(_SEED.integers(1, 1 << 61)) * 8 + 5
_BACK = pow(_STEP, -1, 1 << 64)
_GRAM = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans, true for the bytes of the inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words as [^\x20\x09-\x0D]+ and as [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
NOT_SPACE = ~byte_set((0x20, 0x20), (0x09, 0x0D))
LETTER_OR_DIGIT = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Bytes with A-Z lower-cased, and as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers of a number, n at most ``SLICE_BYTES`` + 1."""
    if base not in _powers:
        out = np.full(SLICE_BYTES + 1, base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges whose texts hold about ``limit`` bytes at most."""
    texts = batch.column(column)
    sizes = np.asarray(pc.binary_length(texts).fill_null(0), np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


class Text:
    """Bytes of a text column; a null is an empty text."""

    def __init__(self, texts: pa.Array, fold: np.ndarray = SAME):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, at, data = texts.buffers()
        n = len(texts)
        offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        self.n = n
        self.offsets = offsets - offsets[0]
        self.raw = raw
        self.data = raw if fold is SAME else fold[raw]

    def runs(self, table: np.ndarray) -> Spans:
        """Maximal runs of the table's bytes, none across two texts."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = table[self.data]
        cuts = self.offsets[1:-1]
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        first[cuts] |= inside[1:-1][cuts]
        last[cuts - 1] |= inside[1:-1][cuts - 1]
        return Spans(self, np.flatnonzero(first), np.flatnonzero(last) + 1)

    def lines(self) -> Spans:
        """Pieces between newlines, as splitting at each of them gives them."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.offsets[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([self.offsets[1:], breaks]))
        spans = Spans(self, starts, ends)
        doc = np.sort(np.concatenate([np.arange(self.n), self.doc_of(breaks)]))
        spans.doc = doc
        return spans

    def doc_of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1

    def count(self, table: np.ndarray) -> np.ndarray:
        """Bytes of the table in each text."""
        inside = table[self.data]
        return np.array([np.count_nonzero(inside[a:b]) for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True)], np.int64)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges in reading order, none within another; equal bytes have equal hashes."""
        total = np.zeros(len(starts), np.uint64)
        at = 0
        while at < len(starts):
            base = int(starts[at])
            to = int(np.searchsorted(ends, base + SLICE_BYTES, "right"))
            if to > at:
                own = self._sums(base, int(ends[to - 1]))
                first = starts[at:to] - base
                total[at:to] = (own[ends[at:to] - base] - own[first]) * _power(_BACK, SLICE_BYTES + 1)[first]
            else:  # one long range, piece by piece
                to = at + 1
                for begin in range(base, int(ends[at]), SLICE_BYTES):
                    piece = self._sums(begin, min(begin + SLICE_BYTES, int(ends[at])))[-1]
                    total[at] += piece * np.uint64(pow(_STEP, begin - base, 1 << 64))
            at = to
        return mix(total + (ends - starts).astype(np.uint64))

    def _sums(self, begin: int, end: int) -> np.ndarray:
        """Prefix sums of the bytes from ``begin`` to ``end``, each times a power of its place."""
        out = np.zeros(end - begin + 1, np.uint64)
        np.cumsum(_BYTE[self.data[begin:end]] * _power(_STEP, end - begin), out=out[1:])
        return out


class Spans:
    """Byte ranges of a ``Text`` in reading order, with the text each is in."""

    def __init__(self, text: Text, starts: np.ndarray, ends: np.ndarray):
        self.text, self.starts, self.ends = text, starts, ends
        self.doc = text.doc_of(starts)

    def hashes(self) -> np.ndarray:
        return self.text.hashes(self.starts, self.ends)

    def counts(self) -> np.ndarray:
        """Spans in each text."""
        return np.bincount(self.doc, minlength=self.text.n)

    def firsts(self) -> np.ndarray:
        """Index of each text's first span, and one past the last."""
        return np.concatenate([[0], np.cumsum(self.counts())])


def grams(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and the index of the first word of each."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    out = hashes[at]
    for j in range(1, k):
        out = out * _GRAM + hashes[at + j]
    return mix(out), at


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return h.view(np.int64)
