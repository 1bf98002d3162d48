"""Hard negatives by exact integer inner products, several candidates in one multiplication.

Kronecker packing: the components of a block's candidates are biased so that
none is negative, and the same component of all candidates is laid into
separate fields of one wide integer. Multiplying each of these integers once by
the anchor's (biased) component and adding up gives all inner products at once,
as no field can overflow into the next. The bias is then taken off, which
leaves the exact scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared.scratch import Scratch
from .vectors import LEAST, MOST, by_length, floors, usable

#: Rows of a block of candidates and of a chunk of anchors.
BLOCK, CHUNK = 2048, 128
#: Blocks that a chunk of anchors is sent to at once.
TOGETHER = 8
#: Units of a component, positives of an anchor, negatives of a positive, and the band of scores in percent of the positive's.
SCALE, POSITIVES, NEGATIVES, BAND = 256, 5, 3, (50, 95)

_PACKED = "block long, length int, ids array<long>, labels array<long>, wide int, components binary"


class Packed:
    """Candidates' components in the fields of wide integers, one integer for each component."""

    def __init__(self, values: np.ndarray, most: int):
        """``values``: a row for each candidate; ``most``: the largest size of an anchor's component."""
        self.n, self.length = values.shape
        self.bias = max(0, -int(values.min())) if values.size else 0
        self.anchor_bias = most
        high = int(values.max()) + self.bias if values.size else 0
        bits = (max(1, self.length) * 2 * most * high).bit_length()
        self.bytes = next(w for w in (4, 8, 16 * (1 + bits // 128)) if 8 * w >= bits)
        self.sums = sum((values[:, j].astype(object) for j in range(self.length)), np.zeros(self.n, object)) if self.bytes > 4 else values.sum(1)
        self.wide = [self._pack(values[:, j]) for j in range(self.length)]

    def _pack(self, column: np.ndarray) -> int:
        if self.bytes > 8:
            return int.from_bytes(b"".join((int(x) + self.bias).to_bytes(self.bytes, "little") for x in column), "little")
        return int.from_bytes((column.astype(np.uint64) + np.uint64(self.bias)).astype(f"<u{self.bytes}").tobytes(), "little")

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner products with an anchor, as long; what is beyond its range counts as its end."""
        given = [int(a) + self.anchor_bias for a in anchor]
        total = 0
        for a, column in zip(given, self.wide, strict=True):
            total += a * column
        raw = total.to_bytes(self.n * self.bytes, "little")
        # (a + A)(v + B) = a v + B (a + A) + A v, summed over the components.
        off = self.bias * sum(given)
        if self.bytes == 4:
            return np.frombuffer(raw, "<u4").astype(np.int64) - off - self.anchor_bias * self.sums
        fields = [int.from_bytes(raw[i : i + self.bytes], "little") - off for i in range(0, len(raw), self.bytes)]
        exact = np.array(fields, object) - self.anchor_bias * self.sums
        return np.array([min(max(int(x), LEAST + 1), MOST) for x in exact], np.int64)


def _pack_rows(size: int, scale: float):
    """Blocks of up to ``size`` rows of one vector length, ordered by id with missing ids last."""

    def made(number: int, length: int, ids: np.ndarray, named: np.ndarray, labels: np.ndarray, values: np.ndarray) -> list:
        order = np.lexsort((ids, ~named))
        values = values[order]
        wide = next(w for w in (1, 2, 4, 8) if not values.size or (values.min() >= -(1 << (8 * w - 1)) and values.max() < 1 << (8 * w - 1)))
        return [number, length, pa.array(ids[order], mask=~named[order]), labels[order], wide, values.astype(f"<i{wide}").tobytes()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made_so_far, waiting = TaskContext.get().partitionId() << 32, 0, {}
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        names = ["block", "length", "ids", "labels", "wide", "components"]

        def out(length: int, parts: list) -> pa.RecordBatch:
            row = made(task + made_so_far, length, *(np.concatenate(x) for x in parts))
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names)

        for batch in batches:
            ids = batch.column("id")
            named, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            for length, rows in by_length(batch, "vector").items():
                values = floors(batch, "vector", rows, length, scale)
                at = 0
                while at < len(rows):
                    parts = waiting.setdefault(length, [[], [], [], []])
                    room = size - sum(map(len, parts[0]))
                    take = rows[at : at + room]
                    for part, x in zip(parts, (ids[take], named[take], labels[take], values[at : at + room]), strict=True):
                        part.append(x)
                    at += len(take)
                    if len(take) == room:
                        yield out(length, waiting.pop(length))
                        made_so_far += 1
        for length, parts in waiting.items():
            yield out(length, parts)
            made_so_far += 1

    return run


def _packed(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows dealt evenly to tasks, whatever their keys are, and packed as they come."""
    n = rows.count()
    return rows.repartition(max(1, -(-n // (4 * size)))).mapInArrow(_pack_rows(size, scale), _PACKED)


def _met(chunks: DataFrame, blocks: DataFrame, groups: int) -> DataFrame:
    """Each chunk of anchors beside each block of vectors of its length, by an equi-join on groups of blocks.

    A merge join at every size: what the repeated chunks hold is more than the
    optimizer knows, so it might take them for small enough to be broadcast.
    """
    group = F.pmod(F.xxhash64("block"), F.lit(groups)).alias("group")
    sent = chunks.withColumnRenamed("block", "chunk").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    for c in ("ids", "labels", "wide", "components"):
        sent = sent.withColumnRenamed(c, f"anchor_{c}")
    return sent.join(blocks.select(group, "length", "ids", "labels", "wide", "components").hint("merge"), ["group", "length"])


def _row(batch: pa.RecordBatch, at: int, prefix: str = "") -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Ids (in order), labels and components of a block or a chunk."""
    ids, labels = batch.column(f"{prefix}ids")[at].values, batch.column(f"{prefix}labels")[at].values.to_numpy(zero_copy_only=False)
    raw = np.frombuffer(batch.column(f"{prefix}components")[at].as_buffer(), f"<i{batch.column(f'{prefix}wide')[at].as_py()}")
    return ids, labels, raw.reshape(len(ids), -1).astype(np.int64)


def _best(scores: np.ndarray, allowed: np.ndarray, k: int) -> list[int]:
    """Places of the k highest allowed scores; of equal ones those that come first."""
    left, out = np.where(allowed, scores, LEAST), []
    while len(out) < k and len(left):
        at = int(left.argmax())
        if left[at] == LEAST:
            break
        out.append(at)
        left[at] = LEAST
    return out


def _largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


def _same_label(k: int):
    """The k best other rows of each anchor's label in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                chunk = batch.column("chunk")[at].as_py()
                ids, labels, values = _row(batch, at)
                anchor_ids, anchor_labels, anchors = _row(batch, at, "anchor_")
                named = ids.is_valid().to_numpy(zero_copy_only=False)
                number = ids.fill_null(0).to_numpy(zero_copy_only=False)
                most, found = _largest(anchors), []
                for label in np.unique(anchor_labels):
                    own = np.flatnonzero(labels == label)
                    if not len(own):
                        continue
                    packed = Packed(values[own], most)
                    for i in np.flatnonzero(anchor_labels == label):
                        scores = packed.scores(anchors[i])
                        other = ~named[own] | (number[own] != anchor_ids[i].as_py())
                        found += [(int(i), int(own[j]), int(scores[j])) for j in _best(scores, other, k)]
                anchor, place, score = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(anchor), chunk)), pa.array(anchor), anchor_ids.take(pa.array(anchor)), ids.take(pa.array(place)), pa.array(score)],
                    ["chunk", "at", "anchor_id", "positive_id", "positive_score"],
                )

    return run


def _in_band(k: int, band: tuple[int, int]):
    """For each positive of each anchor the k best rows of other labels in each block whose scores lie in its band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = batch.column("chunk")[row].as_py()
                ids, labels, values = _row(batch, row)
                anchor_ids, anchor_labels, anchors = _row(batch, row, "anchor_")
                wanted: dict[int, list] = {}
                for p in batch.column("positives")[row].as_py():
                    if p["positive_score"] >= 0:  # no number is between half and 95 % of a negative one
                        wanted.setdefault(p["at"], []).append((p["place"], p["positive_score"]))
                packed, found = None, []
                for at, positives in wanted.items():
                    other = labels != anchor_labels[at]
                    if not other.any():
                        continue
                    packed = packed or Packed(values, _largest(anchors))
                    scores = packed.scores(anchors[at])
                    for place, score in positives:
                        low, high = -(-band[0] * score // 100), band[1] * score // 100
                        found += [(at, place, int(j), int(scores[j])) for j in _best(scores, other & (scores >= low) & (scores <= high), k)]
                at, place, j, score = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), chunk)), pa.array(at), pa.array(place), ids.take(pa.array(j)), pa.array(score)], ["chunk", "at", "place", "negative_id", "negative_score"])

    return run


def mine(vectors: DataFrame, anchor: Column, scratch: Scratch, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: float = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, band: tuple[int, int] = BAND) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), exactly, for the rows that ``anchor`` names.

    Components are floor(``scale`` * component); scores are integer inner
    products. An anchor's positives are its ``positives`` highest rows of the
    same label, its negatives for each of them the ``negatives`` highest rows of
    other labels with band[0] % <= negative / positive <= band[1] %. Higher
    scores come first, ties by smaller id.

    Rows without label or vector, or with a missing or non-finite component,
    take no part; a row without id can be a candidate and comes last among
    ties. Rows of the anchor's own id are no candidates of its label; else rows
    of one id, equal rows too, count each for itself, as candidates and as
    anchors. Vectors of another length than the anchor's are no candidates, and
    empty vectors score 0. Components and scores beyond a long count as its
    ends. An empty table gives no rows; further columns are ignored.

    Rows are dealt evenly and packed into blocks as they stream, and chunks of
    anchors meet all blocks by an equi-join: once for the positives, once for
    the negatives. Each block gives its best few for each anchor, and what is
    shuffled is cut again by each task before. Neither labels nor ids are keys
    of a shuffle of vectors, so hot ones need no care.
    """
    rows = vectors.where(F.col(label).isNotNull() & usable(vector)).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    blocks = scratch.keep(_packed(rows.select("id", "label", "vector"), BLOCK, scale), "blocks")
    chunks = scratch.keep(_packed(rows.where("anchor").select("id", "label", "vector"), CHUNK, scale), "chunks")
    n = blocks.count()
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, min(n, max(2 * parts, -(-n // TOGETHER))))

    def first(found: DataFrame, by: list[str], score: str, tie: str, k: int, name: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc_nulls_last(tie))
        return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)

    same = _met(chunks, blocks, groups).mapInArrow(_same_label(positives), "chunk long, at long, anchor_id long, positive_id long, positive_score long")
    same = scratch.keep(first(same, ["chunk", "at"], "positive_score", "positive_id", positives, "place"), "positives")
    wanted = same.groupBy(F.col("chunk").alias("block")).agg(F.collect_list(F.struct("at", "place", "positive_score")).alias("positives"))
    other = _met(chunks.join(wanted, "block"), blocks, groups).mapInArrow(_in_band(negatives, band), "chunk long, at long, place long, negative_id long, negative_score long")
    other = first(other, ["chunk", "at", "place"], "negative_score", "negative_id", negatives, "rank")
    return other.join(same, ["chunk", "at", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
