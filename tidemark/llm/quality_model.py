"""Quality scores learned from preference pairs by a Bradley-Terry model.

A text's worth is a weighted sum of its features; the chance that one text is
preferred to another is the logistic function of the difference. Every labelled
text outside the held-out fold is in pairs of a good and a bad one, which teach
the weights (``fit``). The threshold is the level that separates all of them
best, and the score is scaled so that it lies at ``CUT``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared.scratch import Scratch
from .quality_rules import measure
from .textkit import LOWER, NOT_SPACE, Text, byte_set, slices

#: Score from which a text is predicted to be good, and the folds by crc32 of the id of which 0 is held out.
CUT, FOLDS = 0.3, 5
#: Preference pairs drawn from rows at hand.
PAIRS = 40_000
#: Rows of a cell in which pairs are made, rows of the other label that each meets, and levels that a threshold is sought among.
CELL, MEET, LEVELS = 2_048, 8, 4_096
#: Tasks that add up the sums of all others.
ADDERS = 8

_UPPER, _DIGIT = byte_set((0x41, 0x5A)), byte_set((0x30, 0x39))
_POINT = byte_set(*((ord(c), ord(c)) for c in ".,;:'\"()"))
_LOUD = byte_set(*((ord(c), ord(c)) for c in "!?"))
_ODD = byte_set(*((ord(c), ord(c)) for c in "#*$%&|<>@^~_=+[]{}\\/"))
_WIDE = byte_set((0xC0, 0xFF))


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for each text; nothing but the text is read."""
    n_words, chars, symbols, n_lines, dup_lines, repeated = (m.astype(float) for m in measure(texts))
    text = Text(texts, LOWER)
    plain = Text(texts)
    words = text.runs(NOT_SPACE)
    hashes = words.hashes()
    order = np.lexsort((hashes, words.doc))
    d, h = words.doc[order], hashes[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    distinct = np.bincount(d[fresh], minlength=text.n)
    size = words.ends - words.starts
    per_word = 1 / np.maximum(n_words, 1)
    per_char = 1 / np.maximum(chars, 1)
    tail = plain.count(np.ones(256, bool)) - chars
    long_words = np.bincount(words.doc[size > 14], minlength=text.n)
    short_words = np.bincount(words.doc[size <= 2], minlength=text.n)
    mean = np.bincount(words.doc, weights=size, minlength=text.n) * per_word
    spread = np.sqrt(np.maximum(np.bincount(words.doc, weights=size.astype(float) ** 2, minlength=text.n) * per_word - mean**2, 0))
    table = [
        np.log1p(n_words), (n_words < 20).astype(float), (n_words < 5).astype(float), mean, spread, long_words * per_word, short_words * per_word,
        *(np.sqrt(plain.count(t) * per_char) for t in (_UPPER, _DIGIT, _POINT, _LOUD, _ODD, _WIDE)), np.sqrt(symbols * per_char),
        dup_lines / np.maximum(n_lines, 1), repeated * per_word, distinct * per_word, np.log1p(n_words / np.maximum(n_lines, 1)), tail * per_char,
    ]
    return np.stack(table, 1)


@dataclass
class Ranking:
    """Features' centers and scales, weights, and the threshold."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def worth(self, x: np.ndarray) -> np.ndarray:
        return _expand((x - self.center) / self.scale) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.worth(x) - self.threshold + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _expand(z: np.ndarray) -> np.ndarray:
    """Features, clipped, with their squares, so that too much can be as bad as too little."""
    z = np.clip(z, -5, 5)
    return np.concatenate([z, z * z], 1)


def fit_pairs(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, rounds: int = 25) -> Ranking:
    """Weights by Newton's method on the logistic loss of feature differences, for few rows at hand; ``fit`` takes a table of them."""
    center, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = _expand((x - center) / scale)
    weights = np.zeros(z.shape[1])
    if not good.any() or good.all():
        return Ranking(center, scale, weights, 0.0 if not good.any() else -1.0)
    rng = np.random.Generator(np.random.PCG64(7))
    best, worst = (rng.choice(np.flatnonzero(side), pairs) for side in (good, ~good))
    d = z[best] - z[worst]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(d @ weights, -40, 40)))
        slope = d.T @ (1 - p) / pairs - ridge * weights
        bend = (d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(weights))
        step = np.linalg.solve(bend, slope)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    worth = z @ weights
    # The quantile of worth that separates the sample best, good and bad weighing alike; the lowest of equals.
    levels = np.quantile(worth, np.linspace(0, 1, 401))
    ordered = [np.sort(worth[side]) for side in (good, ~good)]
    kept = 1 - np.searchsorted(ordered[0], levels) / good.sum()
    dropped = np.searchsorted(ordered[1], levels) / (~good).sum()
    return Ranking(center, scale, weights, float(levels[np.argmax(kept + dropped)]))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = features(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "x"])


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sums(rows: DataFrame, of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum of an array of numbers over all record batches: one row leaves each task, and ``ADDERS`` tasks add these up whole.

    Numbers are added in their order, so that it doesn't matter which row comes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                total = total + of(batch)
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["s"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_added(batch.column("s")).tolist()], pa.list_(pa.float64()))], ["s"])

    found = rows.mapInArrow(run, "s array<double>").repartition(ADDERS).mapInArrow(added, "s array<double>").toArrow()
    return _added(found.column("s").combine_chunks()) if found.num_rows else np.zeros(0)


def _added(lists: pa.Array) -> np.ndarray:
    return np.sort(_matrix(lists, len(lists[0])), 0).sum(0)


def fit(rows: DataFrame, scratch: Scratch, ridge: float = 1e-3, rounds: int = 25) -> Ranking:
    """The ranking of all rows (doc_id, label, x): centers, scales, weights and threshold are sums over every one of them.

    Rows are dealt to cells by a hash of their ids, of about ``CELL`` rows where
    both labels are common enough. In a cell every row of the commoner label
    is held against ``MEET`` of the other, taken in turn, so each row is in some
    pair. Each round of Newton's method is one pass, of which the slope and the
    curvature come back. The threshold separates all rows best, good and bad
    weighing alike, among levels across the range of worths, the lowest of
    equals.
    """
    width = features(pa.array([], pa.string())).shape[1]
    rows = scratch.keep(rows.withColumn("good", F.col("label") == 1), "measured")
    moments = _sums(rows, lambda b: np.concatenate([[b.num_rows, pc.sum(b.column("good")).as_py()], _matrix(b.column("x"), width).sum(0)]))
    n, n_good = (int(v) for v in moments[:2]) if len(moments) else (0, 0)
    if not n:
        return fit_pairs(np.zeros((0, width)), np.zeros(0, bool))
    center = moments[2:] / n
    scale = np.maximum(np.sqrt(_sums(rows, lambda b: ((_matrix(b.column("x"), width) - center) ** 2).sum(0)) / n), 1e-6)
    weights = np.zeros(2 * width)
    if n_good in (0, n):
        return Ranking(center, scale, weights, 0.0 if n_good == 0 else -1.0)
    # Some 32 rows of the rarer label a cell, so that a cell without one is not to be expected.
    cells = max(1, min(n // CELL, min(n_good, n - n_good) // 32))
    cell = F.pmod(F.xxhash64("doc_id"), F.lit(cells)).alias("cell")
    dealt = rows.groupBy(cell).agg(F.sort_array(F.collect_list(F.struct("doc_id", "good", "x"))).alias("r")).select("cell", F.col("r.good").alias("good"), F.col("r.x").alias("x"))
    dealt = scratch.keep(dealt, "cells")

    def slope(at: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
        def of(batch: pa.RecordBatch) -> np.ndarray:
            total = np.zeros(1 + len(at) + len(at) ** 2)
            for row in range(batch.num_rows):
                z = _expand((_matrix(batch.column("x")[row].values, width) - center) / scale)
                good = batch.column("good")[row].values.to_numpy(zero_copy_only=False).astype(bool)
                best, worst = np.flatnonzero(good), np.flatnonzero(~good)
                most = max(len(best), len(worst))
                for turn in range(MEET) if len(best) and len(worst) else ():
                    # The longer side in its order, the other in turn; nothing but the places differs between the two.
                    moved = [turn, 0] if len(best) < len(worst) else [0, turn]
                    i, j = (side[(np.arange(most) + by) % len(side)] for side, by in zip((best, worst), moved, strict=True))
                    d = z[i] - z[j]
                    p = 1 / (1 + np.exp(-np.clip(d @ at, -40, 40)))
                    total += np.concatenate([[most], d.T @ (1 - p), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
            return total

        return of

    for _ in range(rounds):
        sums = _sums(dealt, slope(weights))
        pairs, first, second = sums[0], sums[1 : 1 + 2 * width], sums[1 + 2 * width :].reshape(2 * width, -1)
        if not pairs:
            break
        step = np.linalg.solve(second / pairs + ridge * np.eye(2 * width), first / pairs - ridge * weights)
        weights = weights + step
        if np.abs(step).max() < 1e-6:
            break
    model = Ranking(center, scale, weights, 0.0)
    # No worth lies beyond the clipped features' reach, so levels need no pass of their own.
    low, high = (float((np.minimum if least else np.maximum)(weights[:width] * -5, weights[:width] * 5).sum() + (np.minimum if least else np.maximum)(weights[width:] * 25, 0).sum()) for least in (True, False))
    for narrow in (False, True):
        levels = np.linspace(low, high, LEVELS + 1)

        def counts(batch: pa.RecordBatch, levels: np.ndarray = levels) -> np.ndarray:
            place = np.searchsorted(levels, model.worth(_matrix(batch.column("x"), width)), "right")
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            return np.concatenate([np.bincount(place[side], minlength=LEVELS + 2).astype(float) for side in (good, ~good)])

        found = _sums(rows, counts).reshape(2, -1)
        below = np.cumsum(found, 1)[:, :-1] / [[n_good], [n - n_good]]
        if not narrow:  # first the stretch that worths lie in, then levels within it
            held = np.flatnonzero(found.sum(0))
            low, high = float(levels[max(held[0] - 1, 0)]), float(levels[min(held[-1], LEVELS)])
    return Ranking(center, scale, weights, float(levels[np.argmax(below[1] - below[0])]))


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """Fit on all labelled rows outside the held-out fold; of several labels of an id the larger counts.

    Texts are measured where they lie, and only features meet the labels, by a
    merge join at every size, so no text is shuffled.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (fold != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    measured = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(_measured, "doc_id long, x array<double>")
    return fit(measured.join(known.hint("merge"), "doc_id"), Scratch(docs.sparkSession, "quality"))


def _scored(model: Ranking):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(model.scores(features(part.column("text"))))], ["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Ranking) -> DataFrame:
    """(doc_id, held_out, score, predicted): a row for each row of ``docs``.

    Reads (doc_id, text); further columns are ignored. A null or empty text is
    scored by its features like any other, a very long one by all of its words,
    repeated rows each for itself. A null doc_id is not held out. An empty table
    gives no rows.
    """
    found = docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Ranking) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores ``CUT`` or more.

    A null or empty text is judged by its features like any other, a very long
    one by all its words. Repeated rows stay or go together, and an empty table
    stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield part.filter(pa.array(model.scores(features(part.column("text"))) >= CUT))

    return docs.mapInArrow(run, docs.schema)
