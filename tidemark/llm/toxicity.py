"""Toxicity by cumulative-link ordinal regression on sparse features: words and parts of words.

Severity grades are ordered: 0 is clean, 1 to ``GRADES`` - 1 rising severity.
One weight vector is shared by all thresholds: P(grade >= k) is the logistic
function of (features . weights - threshold k), with rising thresholds. The
result is the expected severity, the sum of those probabilities.

Features are the words, and the pieces of ``PIECES`` bytes of words with their
borders, that stand in more toxic rows than chance explains. Each is tested for
itself (hypergeometric tail), and as many are taken as keep the expected share
of chance finds below ``FALSE_SHARE`` (Benjamini and Hochberg): none needs a
share of the toxic rows, so what a small language has counts as what a large
one has. Forms of one stem share pieces, so forms that no labelled row has, or
too few, are known by them.

Labels say only toxic or not. Toxic rows are graded by how many of those features
they hold. The grades are therefore no judgement independent of the features:
they tell the thresholds to rise with the amount of toxic wording, no more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared.scratch import Scratch
from .labelled import FIT_ROWS, labelled_sample
from .textkit import LETTER_OR_DIGIT, LOWER, Text, mix, signed, slices

GRADES = 4
#: Bytes of the pieces of words, of which each word's first and last border are one.
PIECES = (4, 5, 6)
#: Share of the chosen features that chance may have put there.
FALSE_SHARE = 0.05
#: Standard deviation of the weights' prior.
PRIOR = 4.0
#: Probability from which a text counts as toxic.
TOXIC = 0.5


_SALT = np.random.Generator(np.random.PCG64(20240301)).integers(1, 1 << 63, (max(PIECES) + 1, 257), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BORDER = 256


def word_pieces(texts: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words and pieces of words of each text: (text, hash, count), by text and hash, and all words of each text.

    A piece counts as often as the words that hold it. With ``known``, sorted
    hashes, only these are looked for. Pieces are cut from the distinct words
    of all the texts.
    """
    spans = Text(texts, LOWER).runs(LETTER_OR_DIGIT)
    hashes = signed(spans.hashes())
    word, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size = spans.ends[first] - spans.starts[first]
    ends = np.cumsum(size + 2)
    at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size - 2, size + 2)
    letters = np.full(len(at), _BORDER)
    inside = (at > 0) & (at <= np.repeat(size, size + 2))
    letters[inside] = spans.text.data[(np.repeat(spans.starts[first], size + 2) + at - 1)[inside]]
    owner = np.repeat(np.arange(len(word)), size + 2)
    owners, found = [np.arange(len(word))], [word]
    for n in PIECES:
        begin = np.flatnonzero(at + n <= np.repeat(size, size + 2) + 2)
        piece = np.full(len(begin), n, np.uint64)
        for i in range(n):
            piece = (piece + _SALT[i, letters[begin + i]]) * _SALT[n, i]
        owners.append(owner[begin])
        found.append(signed(mix(piece)))
    owners, found = np.concatenate(owners), np.concatenate(found)
    if known is not None:
        place = np.minimum(np.searchsorted(known, found), max(len(known) - 1, 0))
        hit = known[place] == found if len(known) else np.zeros(len(found), bool)
        owners, found = owners[hit], found[hit]
    order = np.lexsort((found, owners))
    owners, found = owners[order], found[order]
    fresh = np.append(True, (owners[1:] != owners[:-1]) | (found[1:] != found[:-1]))[: len(found)]
    owners, found = owners[fresh], found[fresh]
    # Words of each text, then the features of each of its words.
    pair, times = np.unique(spans.doc * max(len(word), 1) + which, return_counts=True)
    doc, own = pair // max(len(word), 1), pair % max(len(word), 1)
    start, many = np.searchsorted(owners, own), np.bincount(owners, minlength=len(word))[own]
    each = np.repeat(start - np.cumsum(many) + many, many) + np.arange(many.sum())
    doc, feature, count = np.repeat(doc, many), found[each], np.repeat(times, many)
    order = np.lexsort((feature, doc))
    doc, feature, count = doc[order], feature[order], count[order]
    cuts = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (feature[1:] != feature[:-1]))[: len(doc)])
    return doc[cuts], feature[cuts], np.add.reduceat(count, cuts) if len(cuts) else count[:0], spans.counts()


@dataclass
class Ordinal:
    """Features (sorted hashes of words and pieces), their weights, and the rising thresholds."""

    words: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def reaches(self, texts: pa.Array) -> np.ndarray:
        """P(grade >= k) of each text, a row for each text and a column for each k."""
        doc, feature, count, total = word_pieces(texts, self.words)
        z = np.bincount(doc, self.weights[np.searchsorted(self.words, feature)] * np.log1p(count), len(total))
        return _logistic(z[:, None] - self.thresholds)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, grade: np.ndarray, times: np.ndarray, grades: int = GRADES, prior: float = PRIOR, steps: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the largest posterior of the grades, by Adam.

    Features are sparse: ``value`` at (row, column). Row i counts ``times``[i]
    times. Weights have a normal prior of that standard deviation, so a word
    of few rows moves a text less than one of many.
    """
    n = times.sum()
    counts = np.array([times[grade >= k].sum() / n for k in range(1, grades)]).clip(1 / (2 * n), 1 - 1 / (2 * n))
    theta = np.zeros(width + grades - 1)
    cuts = -np.log(counts / (1 - counts))
    theta[width] = cuts[0]
    theta[width + 1 :] = np.log(np.maximum(np.diff(cuts), 1e-2))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        g = loss_slope(theta, row, column, value, width, grade, times, grades, prior)[1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:width], _thresholds(theta[width:])


def _thresholds(theta: np.ndarray) -> np.ndarray:
    return theta[0] + np.concatenate([[0], np.cumsum(np.exp(theta[1:]))])


def loss_slope(theta: np.ndarray, row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, grade: np.ndarray, times: np.ndarray, grades: int, prior: float) -> tuple[float, np.ndarray]:
    """Mean loss (likelihood and prior) and its slope, by weights, first threshold and logarithms of the gaps."""
    total, rows = times.sum(), np.arange(len(grade))
    z = np.bincount(row, value * theta[column], len(grade))
    reach = np.concatenate([np.ones((len(grade), 1)), _logistic(z[:, None] - _thresholds(theta[width:])), np.zeros((len(grade), 1))], 1)
    p = np.maximum(reach[rows, grade] - reach[rows, grade + 1], 1e-12)
    bend = reach * (1 - reach)
    d = np.zeros((len(grade), grades + 1))
    d[rows, grade] += bend[rows, grade] / p
    d[rows, grade + 1] -= bend[rows, grade + 1] / p
    d = -d[:, 1:grades] * times[:, None] / total  # of the loss, by (score - threshold k)
    g = np.empty_like(theta)
    g[:width] = np.bincount(column, value * d.sum(1)[row], width) + theta[:width] / (prior**2 * total)
    g[width] = -d.sum()
    g[width + 1 :] = [-d[:, k:].sum() * np.exp(theta[width + k]) for k in range(1, grades - 1)]
    return -(times * np.log(p)).sum() / total + (theta[:width] ** 2).sum() / (2 * prior**2 * total), g


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, alike, text): with one hash of the least three of a row's words' hashes, which copies mostly share."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Text(part.column("text"), LOWER).runs(LETTER_OR_DIGIT)
            hashes, firsts = mix(words.hashes()), words.firsts()
            least = [np.unique(hashes[a:b])[:3] for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
            alike = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in least]
            yield pa.RecordBatch.from_arrays([part.column("label"), pa.array(alike, pa.int64()), part.column("text")], ["label", "alike", "text"])


def _held(known: np.ndarray | None):
    """(feature, n): in how many of the texts of a slice each feature is; of the ``known`` ones, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                feature, n = np.unique(word_pieces(part.column("text"), known)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(n)], ["feature", "n"])

    return run


def _in_texts(rows: DataFrame, known: np.ndarray | None = None) -> DataFrame:
    found = rows.select("text").mapInArrow(_held(known), "feature long, n long")
    return found.groupBy("feature").agg(F.sum("n").alias("n"))


def _places(known: np.ndarray):
    """(row, label, copies, feature, count) of the known features in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, feature, count, _ = word_pieces(part.column("text"), known)
                own = pa.array(doc)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(own) for c in ("row", "label", "copies")), pa.array(feature), pa.array(count.astype(np.int64))], ["row", "label", "copies", "feature", "count"])

    return run


def tail(found: np.ndarray, rows: np.ndarray, toxic: int, total: int) -> np.ndarray:
    """Chance that a word of so many ``rows`` stands in ``found`` toxic ones or more, if toxic rows have it as often as others."""
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, total + 1)))])
    choose = lambda n, k: log_factorial[n] - log_factorial[k] - log_factorial[n - k]
    out = np.ones(len(found))
    for i in np.flatnonzero(found * total > rows * toxic):
        x = np.arange(found[i], min(rows[i], toxic) + 1)
        out[i] = np.exp(choose(toxic, x) + choose(total - toxic, rows[i] - x) - choose(total, rows[i])).sum()
    return out


def significant(chance: np.ndarray, words: np.ndarray, share: float = FALSE_SHARE) -> np.ndarray:
    """Which cases, each of so many words with that chance, are beyond chance by Benjamini and Hochberg."""
    order = np.argsort(chance, kind="stable")
    good = np.flatnonzero(chance[order] <= share * np.cumsum(words[order]) / max(words.sum(), 1))
    return chance <= (chance[order][good[-1]] if len(good) else -1.0)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, rows: int = FIT_ROWS) -> Ordinal:
    """Fit on up to ``rows`` labelled rows; without toxic rows no text is toxic.

    All of them teach. Rows whose three least word hashes agree, as copies'
    mostly do, weigh one together, and features are counted in the first of
    them, so that the words of one text with many copies don't look telling.
    The driver gets the features that two toxic rows or more have, and the
    places of the chosen ones in the sample.
    """
    found = labelled_sample(docs, labels, "toxic", rows).mapInArrow(_alike, "label int, alike long, text string")
    return fit(scratch.keep(found.withColumn("row", F.monotonically_increasing_id()), "sample"), scratch)


def fit(sample: DataFrame, scratch: Scratch) -> Ordinal:
    """Choose the features, grade the toxic rows, and fit: from (row, label, alike, text); rows of one ``alike`` and label weigh one."""
    same = ["alike", "toxic"]
    sample = sample.withColumn("toxic", F.col("label") == 1)
    copies = scratch.keep(sample.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.min("row").alias("row")), "copies")
    sizes = np.zeros(2, np.int64)
    for r in copies.groupBy("toxic").count().collect():
        sizes[int(r["toxic"])] = r["count"]
    total, toxic = int(sizes.sum()), int(sizes[1])
    if not toxic or toxic == total:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.array([10.0 - 20 * bool(toxic) + k for k in range(GRADES - 1)]))
    firsts = sample.join(copies.select("row"), "row", "left_semi")
    bad = _in_texts(firsts.where("toxic")).where("n >= 2").toArrow().sort_by("feature")
    candidates, bad = bad.column("feature").to_numpy(), bad.column("n").to_numpy()
    clean = _in_texts(firsts.where("not toxic"), candidates).toArrow()
    in_rows = bad.copy()
    in_rows[np.searchsorted(candidates, clean.column("feature").to_numpy())] += clean.column("n").to_numpy()
    # How many features there are in all is needed for the share of chance finds only, and so estimated.
    every = firsts.select("text").mapInArrow(_held(None), "feature long, n long").agg(F.approx_count_distinct("feature", 0.02)).first()[0]
    cases, which, many = np.unique(np.stack([bad, in_rows]), axis=1, return_inverse=True, return_counts=True)
    chance = np.append(tail(*cases, toxic, total), 1.0)
    telling = significant(chance, np.append(many, max(0, every - len(candidates))))[:-1]
    chosen = candidates[telling[which.ravel()]]
    weighed = sample.join(copies.drop("row"), same).select("row", "label", "copies", "text")
    places = weighed.mapInArrow(_places(chosen), "row long, label int, copies long, feature long, count long").toArrow().sort_by([("row", "ascending"), ("feature", "ascending")])
    scratch.drop("sample", "copies")
    at, row = np.unique(places.column("row").to_numpy(), return_inverse=True)
    known, column = np.unique(places.column("feature").to_numpy(), return_inverse=True)
    count = places.column("count").to_numpy().astype(float)
    is_toxic = np.zeros(len(at), bool)
    is_toxic[row] = places.column("label").to_numpy() == 1
    share = np.ones(len(at))
    share[row] = 1 / places.column("copies").to_numpy()
    hits = np.bincount(row, count, len(at))
    cuts = np.quantile(hits[is_toxic], [i / (GRADES - 1) for i in range(1, GRADES - 1)]) if is_toxic.any() else np.zeros(GRADES - 2)
    grade = np.where(is_toxic, 1 + np.searchsorted(cuts, hits), 0)
    # Rows without a chosen word are alike but for their grade: one row for the clean ones, one for the toxic.
    rest = np.maximum([total - toxic - share[~is_toxic].sum(), toxic - share[is_toxic].sum()], 0)
    weights, thresholds = fit_ordinal(row, column, np.log1p(count), len(known), np.append(grade, [0, 1]), np.append(share, rest))
    return Ordinal(known, weights, thresholds)


def _scored(model: Ordinal):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                reach = model.reaches(part.column("text"))
                grade = (reach >= 0.5).sum(1)
                columns = [pa.array(reach.sum(1)), pa.array(reach[:, 0]), pa.array(grade.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "severity", "p_toxic", "grade"])

    return run


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """(doc_id, severity, p_toxic, grade, toxic): a row for each row of ``docs``.

    Reads (doc_id, text); further columns are ignored. Severity is expected
    severity from 0 to ``GRADES`` - 1. A null or empty text has no features and
    so the severity that the thresholds alone give, which is close to 0. All
    words of a very long text count. Repeated rows and ids are scored each for
    itself, and an empty table gives no rows.
    """
    found = docs.select("doc_id", "text").mapInArrow(_scored(model), "doc_id long, severity double, p_toxic double, grade int")
    return found.withColumn("toxic", F.col("p_toxic") >= TOXIC)
