"""Packing of tokenized documents into sequences of fixed length.

Tokenizing and cutting run per document. Pieces are then packed by length
alone: the counts of each length, at most ``CAPACITY`` numbers whatever the
input, are planned on the driver by exact-complement hashing, and every piece
finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared.prefix import prefix_sums
from ..shared.scratch import Scratch
from .textkit import NOT_SPACE, Text, byte_set, slices

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Texts are tokenized in slices of so many bytes; so many distinct chunks are remembered.
SLICE, REMEMBERED = 1 << 22, 400_000
#: First bytes of white space outside ASCII, as UTF-8 has it.
_WIDE = byte_set((0xC2, 0xC2), (0xE1, 0xE3))
_WIDE_SPACE = {b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80\xa8", b"\xe2\x80\xa9", b"\xe2\x80\xaf", b"\xe2\x81\x9f", b"\xe3\x80\x80"} | {b"\xe2\x80" + bytes([i]) for i in range(0x80, 0x8B)}


class Tokenizer:
    """Byte-level BPE of whole texts, each distinct chunk tokenized once.

    A chunk is a run of other characters with the space before it, or white
    space between such runs; the vocabulary's pattern never joins two chunks.
    Texts with white space outside ASCII or with an added token of the
    vocabulary, which has its own id wherever it stands, are tokenized whole.
    """

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as vocabulary:
            self.added = {token["content"]: token["id"] for token in json.load(vocabulary)["added_tokens"]}

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.model = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.added)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _learn(self, chunk: bytes) -> int:
        ids = self.model.encode_ordinary(chunk.decode())
        place = len(self.index)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
        if place == len(self.starts):
            self.starts, self.lengths = (np.concatenate([x, np.zeros(len(x), np.int64)]) for x in (self.starts, self.lengths))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[place], self.lengths[place] = self.used, len(ids)
        self.used += len(ids)
        self.index[chunk] = place
        return place

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        text = Text(texts)
        if len(self.index) > REMEMBERED:
            self._forget()
        starts = chunks(text)[0]
        # Chunks follow each other without gaps, so they are one Arrow array over the texts' bytes; equal ones are found by comparing these.
        ends = pa.py_buffer(np.append(starts, len(text.raw)).astype(np.int64))
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, ends, pa.py_buffer(text.raw)]).dictionary_encode()
        known = self.index.get
        places = np.array([p if (p := known(chunk)) is not None else self._learn(chunk) for chunk in found.dictionary.to_pylist()], np.int64)
        places = places[found.indices.to_numpy()] if len(starts) else np.zeros(0, np.int64)
        length = self.lengths[places]
        upto = np.concatenate([[0], np.cumsum(length)])
        ids = self.flat[np.repeat(self.starts[places] - upto[:-1], length) + np.arange(upto[-1])]
        cuts = upto[np.searchsorted(starts, text.offsets)]
        out = [ids[cuts[i] : cuts[i + 1]] for i in range(text.n)]
        for i in {*wide_spaced(text), *holding(text, [t.encode() for t in self.added])}:
            whole = text.raw[text.offsets[i] : text.offsets[i + 1]].tobytes().decode()
            out[i] = np.array(self.model.encode(whole, allowed_special="all"), np.uint32)
        return out


def wide_spaced(text: Text) -> list[int]:
    """Texts that hold white space outside ASCII."""
    at = np.flatnonzero(_WIDE[text.raw])
    raw = text.raw
    found = [i for i in at.tolist() if raw[i : i + 2].tobytes() in _WIDE_SPACE or raw[i : i + 3].tobytes() in _WIDE_SPACE]
    return np.unique(text.doc_of(np.array(found, np.int64))).tolist() if found else []


def holding(text: Text, tokens: list[bytes]) -> list[int]:
    """Texts that hold one of ``tokens``."""
    raw, found = text.raw.tobytes(), set()
    for token in tokens:
        at = raw.find(token)
        while at >= 0:
            i = int(text.doc_of(np.array([at], np.int64))[0])
            if at + len(token) <= text.offsets[i + 1]:
                found.add(i)
                at = raw.find(token, int(text.offsets[i + 1]))
            else:
                at = raw.find(token, at + 1)
    return sorted(found)


def chunks(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges that cover the texts without gaps and that tokenize alike alone and together."""
    words = text.runs(NOT_SPACE)
    begin, doc = words.starts, words.doc
    led = np.zeros(len(begin), bool)
    inner = begin > text.offsets[doc]
    led[inner] = text.raw[begin[inner] - 1] == 0x20
    start = begin - led
    # White space before each word: all but its last character, and that one where it isn't a space.
    after = np.concatenate([[0], words.ends[:-1]]) if len(begin) else begin
    after = np.maximum(after, text.offsets[doc])
    alone = (begin > after) & ~led
    gap_end = np.where(alone, begin - 1, start)
    gap = gap_end > after
    # White space at the end of a text.
    last = np.maximum.accumulate(np.concatenate([[0], words.ends]))[words.firsts()[1:]] if text.n else np.zeros(0, np.int64)
    last = np.maximum(last, text.offsets[:-1])
    tail = last < text.offsets[1:]
    starts = np.concatenate([start, after[gap], begin[alone] - 1, last[tail]])
    ends = np.concatenate([words.ends, gap_end[gap], begin[alone], text.offsets[1:][tail]])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _pieces(path: str | None, capacity: int, end: int, keep_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize = Tokenizer(path)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                rows: tuple[list, ...] = ([], [], [], [], [], [])
                for i, ids in enumerate(tokenize(part.column("text"))):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    cut = (len(ids) - 1) % capacity + 1
                    for piece, to in enumerate(range(cut, len(ids) + 1, capacity)):
                        at = max(0, to - capacity) if piece else 0
                        for column, value in zip(rows, (i, piece, at, to - at, zlib.crc32(ids[at:to]), ids[at:to]), strict=True):
                            column.append(value)
                own, piece, at, length, crc, ids = rows
                columns = [part.column("doc_id").take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (at, length, crc))]
                if keep_ids:
                    columns.append(pa.array([x.view(np.int32) for x in ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


class Sums:
    """Hash tables from each sum up to the capacity to the pairs and the triples of lengths that make it, longest first.

    A triple is its longest length and a pair of the rest's sum, so the table of
    triples holds the longest lengths alone. The tables are made of the lengths
    that there are; what has been used up meanwhile is passed over.
    """

    def __init__(self, left: np.ndarray, capacity: int):
        self.left = left
        have = np.flatnonzero(left)
        long, short = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
        fit = (short <= long) & (long + short <= capacity)
        long, short = long[fit], short[fit]
        self.pairs = self._table(long + short, long)
        # The least longer length among a sum's pairs says which third lengths are the longest with one of them.
        least = {total: int(found[-1]) for total, found in self.pairs.items()}
        sums = np.array(sorted(least), np.int64)
        first, rest = (x.ravel() for x in np.meshgrid(have, sums, indexing="ij"))
        fit = (first + rest <= capacity) & (np.array([least[s] for s in sums.tolist()], np.int64)[np.searchsorted(sums, rest)] <= first)
        self.triples = self._table((first + rest)[fit], first[fit])

    @staticmethod
    def _table(total: np.ndarray, longest: np.ndarray) -> dict[int, np.ndarray]:
        order = np.lexsort((-longest, total))
        total, longest = total[order], longest[order]
        sums, at = np.unique(total, return_index=True)
        return dict(zip(sums.tolist(), np.split(longest, at[1:]), strict=True)) if len(sums) else {}

    def pair(self, total: int, most: int) -> Iterator[tuple[int, int]]:
        """Pairs of that sum of which both lengths are left, the longer one at most ``most``."""
        long = self.pairs.get(total, np.zeros(0, np.int64))
        for a in long[(long <= most) & (self.left[long] > 0) & (self.left[total - long] > 0)].tolist():
            yield a, total - a

    def triple(self, total: int, most: int) -> Iterator[tuple[int, int, int]]:
        long = self.triples.get(total, np.zeros(0, np.int64))
        for a in long[(long <= most) & (self.left[long] > 0)].tolist():
            for b, c in self.pair(total - a, a):
                yield a, b, c


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Sequences for so many pieces of each length: (lengths, how often).

    From the longest length down, the gap that a piece leaves is looked up
    among single lengths and in the tables of pair and triple sums, and a
    combination that fills it exactly is consumed as often as its counts allow.
    What finds no exact combination is placed by best fit, longest first.
    """
    left = np.asarray(counts, np.int64).copy()
    sums = Sums(left, capacity)
    done: list[tuple[tuple[int, ...], int]] = []

    def take(lengths: tuple[int, ...]) -> bool:
        need = np.bincount(lengths, minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int((left[used] // need[used]).min())
        if times:
            left[used] -= times * need[used]
            done.append((lengths, times))
        return bool(times)

    def fills(length: int) -> bool:
        gap = capacity - length
        if gap == 0:
            return take((length,))
        if left[gap] and take((length, gap)):
            return True
        return any(take((length, *rest)) for rest in sums.pair(gap, length)) or any(take((length, *rest)) for rest in sums.triple(gap, length))

    for length in range(capacity, 0, -1):
        while left[length] and fills(length):
            pass
    # Best fit: open sequences by gap.
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        while left[length]:
            fit = np.flatnonzero(gaps[length:])
            if len(fit):
                gap = length + int(fit[0])
                lengths, times = open_[gap].pop()
                gaps[gap] = bool(open_[gap])
                # Only as many as there are pieces get one.
                used = min(times, int(left[length]))
                if used < times:
                    open_[gap].append((lengths, times - used))
                    gaps[gap] = True
            else:
                gap, lengths = capacity, ()
                used = max(1, int(left[length]) // (capacity // length))
            left[length] -= used
            rest = gap - length
            open_.setdefault(rest, []).append(((*lengths, length), used))
            gaps[rest] = rest > 0
    return done + [x for found in open_.values() for x in found]


class Places:
    """Where the piece of a given rank among those of its length goes."""

    def __init__(self, sequences: list[tuple[tuple[int, ...], int]]):
        slots: dict[int, list[tuple[int, int, int]]] = {}
        ranks: dict[int, int] = {}
        base = 0
        for lengths, times in sequences:
            offset = 0
            for length in lengths:
                slots.setdefault(length, []).append((ranks.get(length, 0), base, offset))
                ranks[length] = ranks.get(length, 0) + times
                offset += length
            base += times
        self.slots = {length: np.array(found, np.int64).T for length, found in slots.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        for own in np.unique(length):
            at = np.flatnonzero(length == own)
            first, base, place = self.slots[int(own)]
            slot = np.searchsorted(first, rank[at], "right") - 1
            sequence[at] = base[slot] + rank[at] - first[slot]
            offset[at] = place[slot]
        return sequence, offset


def _placed(places: Places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, scratch: Scratch, path: str | None = None, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """Pieces of the tokenized documents and their places in sequences.

    Reads (doc_id, text); further columns are ignored. A document's ids end
    with ``end``; a null or empty text has that id alone. A document longer
    than ``capacity`` is cut into pieces of that length of which the first may
    be shorter. Returns doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and ids where ``keep_ids``. Repeated rows are packed as often as
    they come, very long texts whole. An empty table gives no pieces.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    pieces = docs.select("doc_id", "text").mapInArrow(_pieces(path, capacity, end, keep_ids), schema)
    pieces = scratch.keep(pieces, "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():  # at most one row for each length up to the capacity
        counts[row["length"]] = row["count"]
    places = Places(plan(counts, capacity))
    ranked = prefix_sums(scratch, pieces, ["length"], [F.col("doc_id"), F.col("piece")], F.lit(1).cast("long"), "ranked", "rank")
    names = [n.split()[0] for n in schema.split(", ")]
    out = ranked.select(*names, "rank").mapInArrow(_placed(places), f"{schema}, sequence_id long, offset long")
    scratch.drop("pieces")
    return out
