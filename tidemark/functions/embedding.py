"""Feature-hash embeddings of texts, and cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions, seeds, and the constants of the 64-bit hash.
DIM, SEEDS = 256, 4
_OFFSET, _SEED_STEP, _PRIME = 14695981039346656037, 6364136223846793005, np.uint64(1099511628211)
_ALL = (1 << 64) - 1


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits, _ and -, of two bytes or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{IsAlphabetic}\p{N}_-]+"), lambda w: F.octet_length(w) >= 2)


class Words:
    """Distinct words as bytes, to be hashed all at once."""

    def __init__(self, words: pa.StringArray):
        raw = words.cast(pa.large_binary())
        _, offsets, data = raw.buffers()
        at = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        self.at, self.size = at[:-1], np.diff(at)
        self.data = np.frombuffer(data, np.uint8).astype(np.uint64) if data is not None else np.zeros(0, np.uint64)

    def onto(self, state: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Seeded FNV-1a states, a row for each of ``words``, after the bytes of that word."""
        size, at = self.size[words], self.at[words]
        order = np.argsort(-size, kind="stable")
        state, at, size = state[order], at[order], size[order]
        for place in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -place))
            state[:live] = (state[:live] ^ self.data[at[:live] + place][:, None]) * _PRIME
        out = np.empty_like(state)
        out[order] = state
        return out


def first_states(n: int) -> np.ndarray:
    """The states before any byte: a column for each seed."""
    return np.tile(np.array([(_OFFSET + seed * _SEED_STEP) & _ALL for seed in range(SEEDS)], np.uint64), (n, 1))


def _spread(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight dimensions that each row of hashes falls on, and their signs."""
    dims = np.concatenate([h % np.uint64(DIM), (h >> np.uint64(16)) % np.uint64(DIM)], 1).astype(np.int64)
    signs = 1.0 - 2.0 * np.concatenate([(h >> np.uint64(8)) & np.uint64(1), (h >> np.uint64(24)) & np.uint64(1)], 1).astype(float)
    return dims, signs


def embed_words(lists: pa.ListArray) -> np.ndarray:
    """Unit vectors of lists of words; zero for an empty list.

    Words weigh one each and neighbouring pairs, joined by a blank, one half,
    over the list's length. A pair's hash goes on from the first word's.
    """
    n = len(lists)
    flat = lists.flatten().dictionary_encode()
    code = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = Words(flat.dictionary)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(n), size)
    out = np.zeros(n * DIM)
    n_words = len(flat.dictionary)
    alone = words.onto(first_states(n_words), np.arange(n_words))
    pair = np.flatnonzero(doc[:-1] == doc[1:]) if len(doc) else np.zeros(0, np.int64)
    distinct, which = np.unique(code[pair] * max(n_words, 1) + code[pair + 1], return_inverse=True)
    blank = (alone[distinct // max(n_words, 1)] ^ np.uint64(0x20)) * _PRIME
    joined = words.onto(blank, distinct % max(n_words, 1))
    for h, own, place, weight in ((alone, doc, code, 1.0), (joined, doc[pair], which, 0.5)):
        dims, signs = _spread(h)
        share = weight / np.maximum(size, 1)[own]
        for column in range(dims.shape[1]):
            out += np.bincount(own * DIM + dims[place, column], signs[place, column] * share, n * DIM)
    out = out.reshape(n, DIM)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


def with_embedding(df: DataFrame, text: str, into: str = "embedding", packed: bool = False) -> DataFrame:
    """``df`` with the embedding (array of float) of a column of texts.

    Words are split by the JVM; the different texts of each Arrow batch are
    embedded once, and hashing is vectorized over their distinct words.
    ``packed`` embeddings are binary (see ``pack``).
    """
    marked = df.withColumn("_words", words(F.col(text)))
    schema = marked.drop("_words").withColumn(into, F.lit(None).cast("binary" if packed else "array<float>")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column(text).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            _, first, which = np.unique(code, return_index=True, return_inverse=True)
            lists = batch.column("_words").take(pa.array(first))
            vectors = np.concatenate([np.zeros((0, DIM), np.float32), *(embed_words(lists.slice(at, 256)).astype(np.float32) for at in range(0, len(lists), 256))])
            plain = batch.drop_columns(["_words"])
            for at in range(0, batch.num_rows, 256):
                mine = vectors[which[at : at + 256]]
                made = pack(mine) if packed else pa.ListArray.from_arrays(pa.array(np.arange(0, mine.size + 1, DIM), pa.int32()), pa.array(mine.ravel()))
                yield pa.RecordBatch.from_arrays([*plain.slice(at, 256).columns, made], [*plain.schema.names, into])

    return marked.mapInArrow(run, schema)


def pack(vectors: np.ndarray) -> pa.Array:
    """Rows of single precision as bytes: the length, places and values of what isn't zero. A short text's vector is mostly zeros."""
    n, length = vectors.shape
    row, at = np.nonzero(vectors)
    head, cell = 4, np.dtype([("at", "<u4"), ("value", "<f4")]).itemsize
    ends = np.append(0, np.cumsum(head + cell * np.bincount(row, minlength=n)))
    out = np.empty(int(ends[-1]), np.uint8)
    out[(ends[:-1, None] + np.arange(head)).ravel()] = np.full(n, length, "<u4").view(np.uint8)
    cells = np.empty((len(row), 2), "<u4")
    cells[:, 0], cells[:, 1] = at, vectors[row, at].astype("<f4").view("<u4")
    inside = np.ones(len(out), bool)
    inside[(ends[:-1, None] + np.arange(head)).ravel()] = False
    out[inside] = cells.view(np.uint8).ravel()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def unpack(packed: list[bytes]) -> np.ndarray:
    """The rows that were packed; shorter ones end with zeros."""
    size = np.array([len(b) // 8 for b in packed], np.int64)
    cells = np.frombuffer(b"".join(b[4:] for b in packed), "<u4").reshape(-1, 2)
    out = np.zeros((len(packed), max((int.from_bytes(b[:4], "little") for b in packed), default=0)), np.float32)
    out[np.repeat(np.arange(len(packed)), size), cells[:, 0]] = np.ascontiguousarray(cells[:, 1]).view("<f4")
    return out


def with_packed(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    """``df`` with its embeddings packed, if they aren't."""
    if dict(df.dtypes)[embedding] == "binary":
        return df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(embedding)
            made = pack(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(lists), -1)) if len(lists) else pa.array([], pa.binary())
            yield batch.set_column(batch.schema.names.index(embedding), embedding, made)

    return df.mapInArrow(run, df.withColumn(embedding, F.lit(None).cast("binary")).schema)


def _valid(values: pa.Array) -> pa.Buffer:
    """The bits that say which values are there."""
    return pa.array(values.is_valid().to_numpy(zero_copy_only=False)).buffers()[1]


def with_bytes(df: DataFrame, embedding: str, into: str = "bytes") -> DataFrame:
    """``df`` with an embedding as the bytes that files and other programs exchange: single precision, lowest byte first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(embedding)
            ends = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) * 4)).astype(np.int32)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype("<f4")
            made = pa.Array.from_buffers(pa.binary(), len(lists), [_valid(lists), pa.py_buffer(ends), pa.py_buffer(values)])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, into])

    return df.mapInArrow(run, df.withColumn(into, F.lit(None).cast("binary")).schema)


def from_bytes(df: DataFrame, stored: str, into: str = "embedding") -> DataFrame:
    """``df`` with the embedding of such bytes; up to three bytes at the end that make no number are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(stored)
            size = pc.binary_length(raw).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.append(0, np.cumsum(size // 4)).astype(np.int32)
            numbers = b"".join(v[: n // 4 * 4] for v, n in zip(raw.fill_null(b"").to_pylist(), size.tolist(), strict=True))
            made = pa.Array.from_buffers(pa.list_(pa.float32()), len(raw), [_valid(raw), pa.py_buffer(ends)], children=[pa.array(np.frombuffer(numbers, "<f4"))])
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, into])

    return df.mapInArrow(run, df.withColumn(into, F.lit(None).cast("array<float>")).schema)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors that are empty, zero or of different lengths."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))
